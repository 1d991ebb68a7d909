"""License scans by canonical digest lookup.

A text's canonical form: copyright lines go, A-Z become lower case, spellings that mean the same become one, and
punctuation and white space become single spaces. The SHA-256 of the whole canonical text is joined to the
digests of known licences, which come from their texts by the same expressions. Lines get the same
lookup against known one-line notices ("Released under the MIT License."), without exploding the texts.

The join broadcasts the known digests while there are at most KNOWN_BOUND of them, which is counted first, and is a
plain hash join beyond that. Everything is DataFrame expressions over one scan of the documents.

Defined cases: null and empty texts, and texts of punctuation or copyright lines alone, have the empty
canonical text and no licence; very long texts are made canonical whole; repeated rows give repeated results; of known licences with one canonical text the
least identifier counts; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import text_of

#: Most known digests that are broadcast.
KNOWN_BOUND = 100_000

# Spellings that mean the same, as whole words of lower case.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Wording of common short licences and notices.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {holders}BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ISC_START = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
LICENCES = {
    "0BSD": f"{_ISC_START}.\n{_ISC_END}",
    "BSD-2-Clause": _BSD_START + _BSD_1 + _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END,
    "ISC": f"{_ISC_START}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "MIT": f"{_MIT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
    f"substantial portions of the Software.\n{_AS_IS.format(holders='OR COPYRIGHT HOLDERS ')}",
    "MIT-0": f"{_MIT}.\n{_AS_IS.format(holders='OR COPYRIGHT HOLDERS ')}",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn "
    "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    f"{_AS_IS.format(holders='')}\nFor more information, please refer to <https://unlicense.org>",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n3. This notice may not be removed or altered from any source distribution.",
}
# Digests of the canonical forms of long public licences, whose texts aren't kept here.
DIGESTS = {
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71": "GFDL-1.2",
    "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License"],
}

COPYRIGHT_LINE = r"(?im)^[^a-z0-9\n©(]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by[ \t])|©|\(c\)[ \t]*[0-9<\[{]|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
#: Runs of anything but lower-case letters, digits and characters beyond ASCII other than signs of general punctuation.
BETWEEN = r"[^a-z0-9\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3003}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form: words with one space between them."""
    flat = F.translate(F.regexp_replace(text, COPYRIGHT_LINE, ""), UPPER, LOWER)
    # a space on both sides of every word, so that a spelling is replaced wherever it is a whole word
    spaced = F.regexp_replace(flat, BETWEEN, "  ")
    one = F.concat(F.lit(" "), spaced, F.lit(" "))
    for old, new in SPELLINGS.items():
        one = F.replace(one, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(one, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """digest, license_id of the known licences, by text or by digest, and of texts (license_id, text), whatever their number."""
    rows = spark.createDataFrame(list(LICENCES.items()), "license_id string, text string")
    if texts is not None:
        rows = rows.unionByName(texts.select("license_id", "text"))
    found = rows.where("text is not null").select(digest(F.col("text")).alias("digest"), "license_id")
    long = spark.createDataFrame(list(DIGESTS.items()), "digest string, license_id string")
    return found.unionByName(long).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """doc_id, license_id (of the whole text, or null), notice_ids (sorted, of lines), canonical_sha256 for every row of docs.

    known: digest and license_id, one row a digest. notices: a bounded parameter, which goes into the plan as constants.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_digests(spark)
    text = text_of(docs["text"])
    # only lines with one of these words are made canonical
    hint = r"(?i)licen[sc]e|public domain"
    lines = F.when(text.rlike(hint), F.filter(F.split(text, "\n"), lambda x: x.rlike(hint))).otherwise(F.array().cast("array<string>"))
    phrases = spark.createDataFrame([(i, t) for i, ts in notices.items() for t in ts], "id string, text string")
    table = phrases.groupBy(canonical(F.col("text")).alias("k")).agg(F.min("id").alias("v")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m")
    )
    rows = docs.select("doc_id", digest(text).alias("canonical_sha256"), lines.alias("lines")).withColumn("known_lines", table.scalar())
    found = F.filter(F.transform("lines", lambda x: F.try_element_at(F.col("known_lines"), canonical(x))), lambda v: v.isNotNull())
    rows = rows.select("doc_id", "canonical_sha256", F.array_sort(F.array_distinct(found)).alias("notice_ids"))
    names = known.select(F.col("digest").alias("canonical_sha256"), "license_id")
    if known.limit(KNOWN_BOUND + 1).count() <= KNOWN_BOUND:
        names = F.broadcast(names)
    return rows.join(names, "canonical_sha256", "left").select("doc_id", "license_id", "notice_ids", "canonical_sha256")
