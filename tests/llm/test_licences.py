import textwrap
from pathlib import Path

import duckdb
import pytest

from hearthline.llm import entry, licences


def rewrapped(text, width, start="Copyright (c) 2019-2024 Some One <a@b.example>\n\n", comment=""):
    lines = [x for part in text.split("\n") for x in textwrap.wrap(part, width)]
    return start + "\n".join(comment + x for x in lines) + "\n"


def test_known_texts_are_found_in_any_dress(spark):
    rows = []
    for i, (name, text) in enumerate(licences.LICENCES.items()):
        dressed = [
            text, text.upper(), rewrapped(text, 61), rewrapped(text, 33, "© 1999 X\nAll rights reserved.\n", " * "),
            rewrapped(text, 70, "Copyright 2001 The Y Authors\nCOPYRIGHT (C) 1998 by Z\n").replace('"', "“"), text.replace("acknowledgment", "acknowledgement").replace(" license", " licence"),
        ]
        rows += [(10 * i + j, t, name) for j, t in enumerate(dressed)]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", "Copyright 2020 X", "MIT License", licences.LICENCES["MIT"] + " more", licences.LICENCES["MIT"][:-9], "words"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = {r.doc_id: r.license_id for r in licences.scan(df).collect()}
    assert got == {d: n for d, _, n in rows}


def test_notices_repeats_and_more_texts(spark):
    text = "Some prose.\n  released under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nnot licensed under anything"
    df = spark.createDataFrame([(1, text), (1, text), (2, "a b\nlicensed"), (3, None)], "doc_id long, text string")
    out = licences.scan(df).collect()
    assert sorted((r.doc_id, r.notice_ids) for r in out) == [(1, ["CC-BY-NC-4.0", "MIT"])] * 2 + [(2, []), (3, [])]
    own = spark.createDataFrame([("Own-1", "My own words.\nCopyright 2000 Me"), ("Own-0", "my OWN words"), ("None", None)], "license_id string, text string")
    known = licences.known_digests(spark, own)
    found = licences.scan(spark.createDataFrame([(7, "My, own; words")], "doc_id long, text string"), known).first()
    assert found.license_id == "Own-0"
    assert licences.scan(df.limit(0)).count() == 0


def test_a_plain_join_beyond_the_bound_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*licences.LICENCES.values(), None, "x"])], "doc_id long, text string")
    want = sorted(licences.scan(df).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(licences, "KNOWN_BOUND", 2)
    assert sorted(licences.scan(df).collect(), key=lambda r: r.doc_id) == want


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(entry.oracle_sql()["op1_license_digests"])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[k] for k in sorted(names)) for r in rel.fetchall()), key=str)
    out = entry.op1_license_digests(spark, sf)
    assert sorted(out.columns) == sorted(names)
    assert sorted((tuple(r[k] for k in sorted(names)) for r in out.collect()), key=str) == want


FOLDER = Path("/usr/share/common-licenses")
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the texts of long licences aren't installed")
def test_long_licences_by_digest(spark):
    rows = []
    for i, (file, name) in enumerate(FILES.items()):
        text = (FOLDER / file).read_text(encoding="utf-8")
        rows += [(3 * i, text, name), (3 * i + 1, text.upper().replace("\n", "\r\n"), name), (3 * i + 2, text[:-200], None)]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert got == {d: n for d, _, n in rows}
