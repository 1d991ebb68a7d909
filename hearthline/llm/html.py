"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path (tag, class and id of the element and all around it), and
its text runs outside articles; an article is one token with the length of its text. A token's occurrence vector is how often each page of the host has it; tokens of one host
with equal vectors form a class (Arasu and Garcia-Molina 2003). A class is valid if the elements around its tokens all
belong to one class, in which it is then nested; the class of the page's root and the valid classes below it are the host's
template. Its slots are what varies. Identical pages of a host are one page to the template, so copies don't look like a template.

The template decides on text: runs that are tokens of it are boilerplate, except where what varies stands directly around them (SHARE), as
in the parent of an article's blocks; an element of it whose slots hold links mostly (LINKED), several each time, is a menu or a list
of other pages; all other slots are content. A host's main slots are those that hold MOST of what varies on the pages that have them. Where a main slot is an article or a main
part by its tag, only it is read; where it isn't, what pages mark as articles are cards or teasers beside it and are left out. Tags break the tie where no main slot was deduced,
or the page hasn't it: what is marked as an article is read if it is as long as all other slots, and else these.
Elements whose tag or role says menu, header, footer, form, script or the like are left out everywhere, an article's own header element too. Names (class, id) break ties: one that consists
of such words only leaves its element out outside the content slot, unless it holds MOST of what varies on the host; inside the content slot only
names of adverts, consent and reader comments count, and names of two such words (share-buttons), never a single word like header or related.

Vectors are never built: a token's two sums of 32-bit hashes of (page, count) stand for it, so that counting is a
map-side aggregate and a host with a third of all pages is no hot group. A host's template is a few dozen numbers; the
templates are broadcast while there are at most HOSTS of at most NUMBERS in all, which is counted first, and joined by host beyond that.

Defined cases: null and empty html gives an empty text; a url without a host counts as host ""; pages without text in an
article fall back to all text but menus and boilerplate, then to all text outside menus and the like, then to what only names mark; unclosed and stray tags,
cut-off pages and unknown references are read as browsers do, roughly; a tag or comment that never ends goes to the page's end; every step is linear in
the page's length, however long and however deep (elements over DEEP levels down count as their ancestor there); repeated rows get equal results; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import REDUCER_BUCKETS, persisted, slices

#: Most templates that are broadcast.
HOSTS = 100_000
#: Pages that a text run must be on to be part of a template.
LEAST = 5
#: Share of what varies inside an element that stands in it outside further holders, where its constant runs are content too.
SHARE = 0.7
#: Share of what varies on a host that an element holds whose name is not believed.
MOST = 0.5
#: Share of an element's text that stands in links, and links each time it occurs, from which it is a menu or a list of other pages.
LINKED, LINKS = 0.8, 3
#: Levels of elements that are told apart.
DEEP = 200
#: Most numbers in templates that are broadcast.
NUMBERS = 1 << 20
#: Tokens that a task holds back for its sums.
HELD = 300_000

# A value is quoted right after "=" only, to the next quote however far; without one the quote is part of the tag like any character.
# Possessive, so that a tag is read once; one that never ends goes to the page's end.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
USED = frozenset("class id role hidden style aria-hidden".split())
#: Characters of attributes that are looked up again.
KNOWN = 1000
PART = re.compile(r"[a-z]+|\d+")

# Elements and words by their role.
RAW = frozenset("script style template textarea title iframe select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager paging login search".split()
)
ADVERT_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter sidebar sidebars".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
# Parts that leave the meaning of the others in a name.
NEUTRAL_WORDS = frozenset(
    "site main top bottom left right global primary secondary inner outer box bar block list lists link links item items form button buttons icon icons media "
    "container wrap wrapper area post posts article articles stories".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements that hold blocks side by side.
HOLDERS = frozenset("div section center td dd details fieldset".split())

ELEMENT, TEXT = 0, 1
# What leaves an element out: nothing, its name outside the content slot, its name anywhere, its name as reader comments, its tag or role.
PLAIN, WEAK, NAMED, COMMENT, CHROME, CONTENT = 0, 1, 2, 3, 4, 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) >> 1


#: The token around all of a page.
ROOT = _hash("#page")


class _Element:
    """block: index in the stack of the nearest block, itself included. barred: inside a menu or the like by tag, or an article. entry: an article or main part itself."""

    __slots__ = ("tag", "path", "level", "chrome", "content", "named", "block", "barred", "depth", "linked", "entry")

    def __init__(self, tag: str, path: int, level: int, content: bool, named: bool, block: int = 0, barred: bool = False, depth: int = 0, linked: bool = False, entry: bool = False):
        self.tag, self.path, self.level, self.chrome, self.content, self.named = tag, path, level, level > PLAIN, content, named
        self.block, self.barred, self.depth, self.linked, self.entry = block, barred, depth, linked, entry


def _named(names: list[str], words: frozenset[str]) -> int:
    """How much a name says that consists of these words, and others that add nothing: 2 for words of adverts or several words, 1 for one word, 0 for no such name."""
    most = 0
    for name in names:
        parts = [x for x in PART.findall(name) if not x.isdigit()]
        if any(x in words for x in parts) and all(x in CHROME_WORDS or x in NEUTRAL_WORDS for x in parts):
            most = max(most, 2 if len(parts) > 1 or parts[0] in ADVERT_WORDS else 1)
    return most


_roles: dict[tuple[str, str], tuple[str, int]] = {}


def _role(tag: str, attributes: str) -> tuple[str, int]:
    """The element's signature, and its role."""
    if (known := _roles.get((tag, attributes))) is not None:
        return known
    found = {k: (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes) if (k := m[1].lower()) in USED} if attributes else {}
    label = " ".join(found.get(k, "") for k in ("class", "id")).lower()
    names = label.split()
    role = found.get("role", "").lower()
    unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in CONTENT_TAGS or role in ("main", "article"):
        kind = CHROME if unseen else COMMENT if _named(names, COMMENT_WORDS) else CONTENT
    elif tag in ("html", "body"):
        kind = PLAIN
    elif tag in CHROME_TAGS or role in CHROME_ROLES or unseen:
        kind = CHROME
    elif _named(names, COMMENT_WORDS):
        kind = COMMENT
    elif said := _named(names, CHROME_WORDS):
        kind = NAMED if said > 1 else WEAK
    else:
        kind = PLAIN
    # numbers in ids, and long ones in classes, differ from page to page
    classes, own = re.sub("[0-9]{3,}", "0", found.get("class", "").lower()), re.sub("[0-9]+", "0", found.get("id", "").lower())
    out = (f"{tag} {classes} {own} {role}", kind)
    if len(attributes) <= KNOWN:
        if len(_roles) > 100_000:
            _roles.clear()
        _roles[tag, attributes] = out
    return out


def read(html: str, freed: set[int] | frozenset[int] = frozenset()) -> Iterator[tuple[str, _Element, str]]:
    """Events of a page: ("open" or "close", element, ""), ("text", innermost element, decoded run) and ("break", element, ""). freed: paths whose names don't count."""
    root = _Element("#page", ROOT, PLAIN, False, False)
    stack, at, open_ = [root], 0, Counter()

    def pop_to(i: int) -> Iterator[tuple[str, _Element, str]]:
        while len(stack) > i:
            e = stack.pop()
            open_[e.tag] -= 1
            yield "close", e, ""

    while at < len(html):
        m = TAG.search(html, at)
        run = html[at : m.start() if m else len(html)]
        if run:
            yield "text", stack[-1], unescape(run) if "&" in run else run
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if open_[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        yield from pop_to(i)
                        if tag in BLOCKS:
                            yield "break", stack[-1], ""
                        break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in VOID:
            yield ("break", stack[-1], "") if tag == "hr" else ("text", stack[-1], " ")
            continue
        block = tag in BLOCKS
        if block:
            closes = ("p", tag) if tag in ("li", "td", "th", "tr", "dd", "dt", "option") else ("p",)
            around = stack[-1].block
            if around and stack[around].tag in closes:
                yield from pop_to(around)
            yield "break", stack[-1], ""
        signature, kind = _role(tag, attributes)
        above = stack[-1]
        path = _hash(above.path, signature) if block and above.depth < DEEP else above.path
        if kind == WEAK:
            kind = PLAIN if above.content else NAMED
        level, named = max(above.level, kind if kind != CONTENT else PLAIN), kind == NAMED and block
        if named and path in freed and above.level <= NAMED:
            level = PLAIN
        # an article inside something that only its name marks is the article all the same
        if kind == CONTENT and above.chrome and not above.barred:
            level = PLAIN
        element = _Element(
            tag, path, level, kind == CONTENT or above.content, named, len(stack) if block else above.block,
            above.barred or tag in CHROME_TAGS or tag in CONTENT_TAGS, above.depth + block, above.linked or tag == "a", kind == CONTENT and not above.content,
        )
        stack.append(element)
        open_[tag] += 1
        yield "open", element, ""
    yield from pop_to(1)


def _vector(page: int, count: int) -> tuple[int, int]:
    h = _hash(page, count)
    return h & 0xFFFFFFFF, h >> 32 & 0x7FFFFFFF


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums for each token of each host."""
    names = ["host", "token", "parent", "kind", "holder", "holders", "blocks", "pages", "n", "v1", "v2", "chars", "text", "linked", "links"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 8]
    sums: dict[tuple[str, int], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, t, *x) for (h, t), x in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in slices(batches, "html"):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            # of a token: where it is, how often, characters that vary, all, those in links, and links
            page, own = xxhash.xxh3_64_intdigest(html.encode("utf-8", "replace")), {ROOT: [0, ELEMENT, 0, [ROOT], [ROOT], 1, 0, 0, 0, 0]}
            # holders from the page, or from the innermost element that its name marks; and all blocks
            above, holders, blocks = [ROOT], [[ROOT]], [[ROOT]]
            for event, e, text in read(html):
                if event == "open" and e.tag in BLOCKS:
                    around, inside = holders[-1], blocks[-1]
                    if e.level <= NAMED and e.entry and e.path not in around:
                        around = [*around, e.path]
                    elif e.level <= NAMED and not e.content and e.path != above[-1]:
                        around = [e.path] if e.named else [*around, e.path] if e.tag in HOLDERS else around
                        inside = [*inside, e.path]
                    if e.path not in own:
                        own[e.path] = [above[-1], ELEMENT, holders[-1][-1], around if around is not holders[-1] else None, inside if inside is not blocks[-1] else None, 0, 0, 0, 0, 0]
                    own[e.path][5] += 1
                    above.append(e.path)
                    holders.append(around)
                    blocks.append(inside)
                elif event == "open" and e.tag == "a" and e.level <= NAMED and not e.content:
                    own[e.path][9] += 1
                elif event == "close" and e.tag in BLOCKS:
                    above.pop()
                    holders.pop()
                    blocks.pop()
                elif event == "text" and e.level <= NAMED and (flat := " ".join(text.split())):
                    if e.content:
                        own[holders[-1][-1]][6] += len(flat) if not e.chrome else 0
                        continue
                    holder = holders[-1][-1]
                    x = own.setdefault(_hash(e.path, flat, "text"), [e.path, TEXT, holder, None, None, 0, 0, 0, 0, 0])
                    x[5] += 1
                    x[6] += len(flat)
                    own[holder][6] += len(flat)
                    own[e.path][7] += len(flat)
                    own[e.path][8] += len(flat) if e.linked else 0
            for token, (parent, kind, holder, around, inside, count, *numbers) in own.items():
                a, b = _vector(page, count)
                x = sums.setdefault((host, token), [parent, kind, holder, around, inside, 0, 0, 0, 0, 0, 0, 0, 0])
                for i, v in enumerate((1, count, a, b, *numbers), 5):
                    x[i] += v
        if len(sums) > HELD:
            yield flush()
            sums = {}
    if sums:
        yield flush()


PROFILE = (
    "host string, token long, parent long, kind int, holder long, holders array<long>, blocks array<long>, pages long, n long, v1 long, v2 long, "
    "chars long, text long, linked long, links long"
)


def different(pages: DataFrame) -> DataFrame:
    """host, html of the different pages of each host. Only pages whose hash's bucket has a copied page are shuffled; see reduce_by_keys."""
    marked = pages.select("host", "html").where("html is not null").withColumn("k", F.xxhash64("host", "html")).withColumn("b", F.pmod("k", F.lit(REDUCER_BUCKETS)).cast("int"))
    hits = F.broadcast(persisted(marked.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b").distinct(), "html-copied"))
    copied = marked.join(hits, "b", "left_semi").select("host", "html").distinct()
    return marked.join(hits, "b", "left_anti").select("host", "html").unionAll(copied)


#: What a host's template says.
PARTS = ("slots", "fixed", "freed", "menus", "main")


def templates(pages: DataFrame) -> DataFrame:
    """host, slots (paths of elements whose constant runs are content too), freed (paths whose names don't count), fixed (text tokens of the
    template), menus (paths of elements whose slots are links mostly), main (paths of slots that hold most of what varies). pages: host, html."""
    sums = different(pages).mapInArrow(profile, PROFILE)
    tokens = sums.groupBy("host", "token").agg(
        *[F.min(c).alias(c) for c in ("parent", "kind", "holder", "holders", "blocks")],
        *[F.sum(c).alias(c) for c in ("pages", "n", "v1", "v2", "chars", "text", "linked", "links")],
    )
    tokens = persisted(tokens.where((F.col("kind") == ELEMENT) | (F.col("pages") >= LEAST)), "html-tokens")
    vector = ["pages", "n", "v1", "v2"]
    of = F.xxhash64(*vector)
    tokens = tokens.withColumn("class", of)
    around = tokens.where(F.col("kind") == ELEMENT).select("host", F.col("token").alias("parent"), F.col("class").alias("outer"))
    nested = tokens.join(around, ["host", "parent"], "left")
    inner = F.when(F.coalesce(F.col("outer") != F.col("class"), F.lit(True)), F.coalesce("outer", F.lit(0)))
    classes = nested.groupBy("host", "class").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("kind") == ELEMENT).alias("elements"), F.min(inner).alias("a"), F.max(inner).alias("b"),
        F.bool_or(F.col("token") == ROOT).alias("root"),
    ).where("size > 1 and elements > 0 and (a = b or root)")
    constant = persisted(tokens.where(F.col("kind") == TEXT).join(classes, ["host", "class"], "left_semi").select("host", "token", "holder", "chars"), "html-constant")
    fixed = constant.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    # what varies directly in an element, and in all holders inside it
    still = constant.groupBy("host", F.col("holder").alias("token")).agg(F.sum("chars").alias("still"))
    varying = tokens.where("holders is not null").join(still, ["host", "token"], "left").withColumn("varies", F.col("chars") - F.coalesce("still", F.lit(0))).where("varies > 0")
    total = varying.groupBy("host").agg(F.sum("varies").alias("total"))
    inside = varying.select("host", F.explode("holders").alias("token"), F.col("varies").alias("v")).groupBy("host", "token").agg(F.sum("v").alias("inside"))
    holding = varying.where(F.col("token") != ROOT).join(inside, ["host", "token"]).where(F.col("varies") >= SHARE * F.col("inside"))
    a_page = tokens.where(F.col("token") == ROOT).select("host", F.col("pages").alias("of_host")).join(total, "host").select("host", (F.col("total") / F.col("of_host")).alias("a_page"))
    main = holding.where(F.col("pages") >= LEAST).join(a_page, "host").where(F.col("inside") / F.col("pages") >= MOST * F.col("a_page"))
    main = main.groupBy("host").agg(F.collect_set("token").alias("main"))
    slots = holding.groupBy("host").agg(F.collect_set("token").alias("slots"))
    named = tokens.where((F.get("holders", F.lit(0)) == F.col("token")) & (F.col("token") != ROOT)).join(inside, ["host", "token"]).join(total, "host")
    freed = named.where(F.col("inside") > MOST * F.col("total")).groupBy("host").agg(F.collect_set("token").alias("freed"))
    # links and text in an element and all that it holds
    whole = tokens.where("blocks is not null").select("host", F.explode("blocks").alias("token"), "text", "linked", "links")
    whole = whole.groupBy("host", "token").agg(F.sum("text").alias("text"), F.sum("linked").alias("linked"), F.sum("links").alias("links"))
    lists = tokens.where((F.col("kind") == ELEMENT) & (F.col("token") != ROOT) & (F.col("pages") >= LEAST)).select("host", "token", "n").join(whole, ["host", "token"])
    menus = lists.where((F.col("linked") >= LINKED * F.col("text")) & (F.col("links") >= LINKS * F.col("n"))).groupBy("host").agg(F.collect_set("token").alias("menus"))
    none = F.array().cast("array<long>")
    out = tokens.where(F.col("token") == ROOT).select("host")
    for part in (slots, freed, fixed, menus, main):
        out = out.join(part, "host", "left")
    return persisted(out.select("host", *[F.coalesce(c, none).alias(c) for c in PARTS]), "html-templates")


#: How a text was chosen: as the main slot, as what the page marks, or as what else isn't a menu or the like.
BY_SLOT, BY_MARK, BY_REST = "slot", "mark", "rest"


def main_part(
    html: str | None, slots: set[int], fixed: set[int], freed: set[int] | frozenset[int] = frozenset(), menus: set[int] | frozenset[int] = frozenset(), main: set[int] | frozenset[int] = frozenset()
) -> tuple[str, str]:
    """Blocks of a page's content in page order, one a line, and how they were chosen."""
    if not html:
        return "", BY_REST
    # main slots that are marked, all that the page marks, other slots; both without menus and boilerplate; boilerplate too; and what only names mark
    lines: tuple[list[str], ...] = ([], [], [], [], [], [])
    open_: tuple[list[str], ...] = ([], [], [], [], [], [])
    inside = listed = 0
    in_main = has_main = False

    def end_block() -> None:
        for runs, out in zip(open_, lines, strict=True):
            if runs and (flat := " ".join("".join(runs).split())):
                out.append(flat)
            runs.clear()

    for event, e, text in read(html, freed):
        if event == "text":
            if e.level == CHROME:
                continue
            open_[5].append(text)
            if e.chrome:
                continue
            flat = " ".join(text.split())
            if e.content:
                open_[1].append(text)
                if in_main:
                    open_[0].append(text)
            slot = not listed and (inside or not (fixed and flat and _hash(e.path, flat, "text") in fixed))
            if not e.content and slot:
                open_[2].append(text)
            if e.content or slot:
                open_[3].append(text)
            open_[4].append(text)
        elif event == "break":
            end_block()
        elif e.tag in BLOCKS:
            if event == "close":
                end_block()
            step = 1 if event == "open" else -1
            inside += step if e.path in slots else 0
            listed += step if e.path in menus else 0
            if e.entry:
                in_main = event == "open" and e.path in main
            elif e.path in main:
                has_main = True
    end_block()
    if lines[0] or has_main and lines[2]:
        return "\n".join(lines[0] or lines[2]), BY_SLOT
    if lines[1]:
        size = lambda x: sum(map(len, x))
        return ("\n".join(lines[1]), BY_MARK) if size(lines[1]) >= size(lines[2]) else ("\n".join(lines[2]), BY_REST)
    return "\n".join(next((x for x in lines[3:] if x), [])), BY_REST


def main_text(html: str | None, *template: set[int]) -> str:
    return main_part(html, *template)[0]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, chosen (slot, mark or rest) for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    found = templates(rows)
    hosts, numbers = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(F.size(c) for c in PARTS)), F.lit(0))).first()
    if hosts <= HOSTS and numbers <= NUMBERS:
        found = F.broadcast(found)
    joined = rows.join(found, "host", "left")
    page = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_part(h, *(set(x or ()) for x in parts)) for h, *parts in zip(*(batch.column(k).to_pylist() for k in ("html", *PARTS)), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([c for _, c in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "chosen"])

    return joined.select("page_id", "url", "html", *PARTS).mapInArrow(run, f"page_id {page}, url string, text string, n_chars long, chosen string")
