"""Main text of web pages, with a suffix array over the pages of a host.

A page becomes blocks of text, each marked by the elements around it: in the article, not marked, or
surely not content (menus, page headers, footers, sidebars, notices, adverts, forms, reader comments;
scripts, styles and markup give no block). A suffix array over the token streams of a host's pages finds runs
of at least ``RUN`` tokens that stand on ``PAGES`` or more distinct pages; on a host too large for one array
these are counted by their hashes over the whole host. In pages that have no marked article such runs are boilerplate, and
the runs between them stay. An article that is marked stays whole: what many pages quote is still part
of it.

A null or empty html, or one without content, gives an empty text. A null url counts as one host without a
name. Repeated rows are all kept and are one page to the search for repeats. An empty table gives an empty
table. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import gram_hashes, hashes_of, in_batches, stored
from corpusdeck.llm.substrings import sorted_suffixes

RUN, PAGES = 6, 3
#: Pages and characters of html in one suffix array, and large hosts up to which their names are broadcast.
SHARD_PAGES, SHARD_CHARS = 512, 6_000_000
BROADCAST_HOSTS = 50_000

ARTICLE, PLAIN, ASIDE, WRAPPED = 0, 1, 2, 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|math|textarea|select|button|iframe|object|canvas|video|audio|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = re.compile(r"class|id|role|hidden", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names and name parts of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var wbr img".split()
)
SKIPPED = frozenset("nav footer aside form fieldset dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs masthead footer contentinfo sidebar complementary widget cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments"
    " respond reply disqus form search pagination pager copyright disclaimer".split()
)
OPINIONS = frozenset("comment comments reply respond disqus".split())
BEFORE = frozenset("site main page top bottom left right global primary secondary post entry article blog web user reader sticky fixed mobile desktop".split())
AFTER = frozenset(
    "top bottom left right inner outer wrapper wrap container box bar area block section list item items link links unit slot text content title"
    " body panel row column group holder zone module media icons icon button buttons posts articles stories news primary secondary mobile desktop"
    " fixed sticky small large".split()
)
LISTS = frozenset("ul ol dl menu".split())
RICH = frozenset("p h1 h2 h3 h4 h5 h6 article main".split())


@dataclass(slots=True, eq=False)
class Area:
    """An open element whose content is not the page's."""

    #: Hidden or reader comments: an article inside counts no more than the rest.
    hard: bool
    form: bool
    #: Menus, which end with their first block where no end tag follows.
    menu: bool
    first: int
    rich: bool = False
    closed: bool = False
    bound: int | None = None


def _mark(name: str) -> str | None:
    """What a class, id or role stands for: all its parts are marks, but for known words before and after,
    so that ``site-footer`` is one and ``has-footer`` or ``content-sidebar-wrap`` is not."""
    parts = [x for x in re.split(r"[^a-z0-9]+", HUMP.sub("-", name).lower()) if x]
    while parts and parts[0] in BEFORE:
        del parts[0]
    while parts and (parts[-1] in AFTER or parts[-1].isdigit()):
        del parts[-1]
    if not parts or not all(x in MARKS or x == "header" for x in parts):
        return None
    return next((x for x in parts if x in OPINIONS), next((x for x in parts if x in MARKS), "header"))


def _role(name: str, attrs: str, inside: bool) -> tuple[int | None, bool]:
    """What an element says about its content, and whether that holds for an article inside too."""
    marks: set[str | None] = set()
    main = name in ("article", "main")
    for m in ATTR.finditer(attrs) if NAMED.search(attrs) else ():
        kind = m[1].lower()
        if kind == "hidden":
            return ASIDE, True
        if kind in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            main |= kind == "role" and value.lower() in ("main", "article")
            marks.update(map(_mark, value.split()))
    if main:
        return (ASIDE, True) if marks & OPINIONS else (ARTICLE, False)
    if name in ("body", "html"):
        return None, False
    if marks & MARKS or "header" in marks and not inside or name in SKIPPED or name == "header" and not inside:
        return ASIDE, bool(marks & OPINIONS)
    return None, False


def _parts(page: str) -> Iterator[tuple[str, tuple[Area, ...], int | None]]:
    """Each block's text, the areas around it, and how many of them are around its article, if it has one.
    What areas say of their end is right when the page is through."""
    stack: list[tuple[str, Area | int | None]] = []
    held: list[str] = []
    areas: list[Area] = []
    articles: list[int] = []
    count = 0

    def flush() -> Iterator[tuple[str, tuple[Area, ...], int | None]]:
        nonlocal count
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                yield text, tuple(areas), articles[-1] if articles else None
                count += 1
            held.clear()

    def pop(closed: bool) -> None:
        name, what = stack.pop()
        if isinstance(what, Area):
            areas.remove(what)
            what.closed = closed
        elif what is not None:
            articles.pop()
        around = stack[-1][1] if stack else None
        if name not in INLINE and isinstance(around, Area) and around.menu and around.bound is None:
            around.bound = count

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            held.append(text)
            continue
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if name not in INLINE:
            yield from flush()
        if m["end"]:
            if any(open_ == name for open_, _ in stack):
                while True:
                    last = stack[-1][0]
                    # A block that ends takes its own open elements with it, an inline one only itself.
                    pop(last == name)
                    if last == name:
                        break
            continue
        if name in VOID or m["attrs"].endswith("/") and name in INLINE:
            continue
        if stack and name not in INLINE:
            while stack and stack[-1][0] in INLINE and any(o == "p" for o, _ in stack):
                pop(True)
            if stack and (stack[-1][0] == "p" or name == "li" == stack[-1][0]):
                pop(True)
            around = stack[-1][1] if stack else None
            if isinstance(around, Area) and around.menu and around.bound is None and count > around.first and name not in LISTS:
                around.bound = count
        if areas and name in RICH:
            for area in areas:
                area.rich = True
        role, hard = _role(name, m["attrs"], bool(articles))
        what: Area | int | None = None
        if role is not None:
            yield from flush()
        if role == ASIDE:
            what = Area(hard, name == "form", name in ("nav", "menu", "header"), count)
            areas.append(what)
        elif role == ARTICLE:
            what = len(areas)
            articles.append(what)
        stack.append((name, what))
    yield from flush()


def blocks(page: str) -> list[tuple[int, str]]:
    """``(mark, text)`` of the blocks of a page, in order.

    A form around paragraphs or headings with more text than all that stands outside of such areas is the
    page's frame, not a form. A menu or page header without an end tag ends with its first block. An article
    inside an area is the page's where none stands outside of one and there is no more text without a mark;
    not so in hidden parts and reader comments."""
    found = list(_parts(page))
    outside = sum(len(text) for text, areas, _ in found if not areas)
    own: dict[Area, int] = {}
    for text, areas, _ in found:
        if len(areas) == 1 and areas[0].form and areas[0].rich:
            own[areas[0]] = own.get(areas[0], 0) + len(text)
    frames = {area for area, n in own.items() if n > outside}

    def holds(area: Area, at: int) -> bool:
        return area.hard or area not in frames and (area.closed or area.bound is None or at < area.bound)

    marks = []
    for at, (_, areas, article) in enumerate(found):
        live = [holds(a, at) for a in areas]
        if article is None:
            marks.append(ASIDE if any(live) else PLAIN)
        elif any(live[article:]) or any(a.hard for a in areas[:article]):
            marks.append(ASIDE)
        else:
            marks.append(WRAPPED if any(live[:article]) else ARTICLE)
    size = [0] * 4
    for mark, (text, _, _) in zip(marks, found, strict=True):
        size[mark] += len(text)
    wrapped = ASIDE if size[ARTICLE] or size[WRAPPED] < size[PLAIN] else ARTICLE
    return [(wrapped if mark == WRAPPED else mark, text) for mark, (text, _, _) in zip(marks, found, strict=True)]


def has_article(page: str) -> bool:
    """Whether a block of the page is marked as its article; read no further than needed."""
    if any(not areas and article is not None for _, areas, article in _parts(page)):
        return True
    return any(mark == ARTICLE for mark, _ in blocks(page))


def repeated(streams: list[list[str]]) -> list[np.ndarray]:
    """For each page's blocks the words, block by block and with one place after each block, that lie in
    a run of ``RUN`` tokens standing on ``PAGES`` or more distinct pages."""
    ids: dict[str, int] = {}
    pages: dict[bytes, int] = {}
    parts, owners = [], []
    for blocks_ in streams:
        own: list[int] = []
        for b in blocks_:
            own += [ids.setdefault(w, len(ids) + 1) for w in b.split(" ")]
            own.append(0)
        part = np.array(own, np.int64)
        parts.append(part)
        owners.append(pages.setdefault(xxhash.xxh3_128_digest(part.tobytes()), len(pages)))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if not sizes.sum():
        return parts
    # A symbol of its own ends each page, so that no run goes over it.
    symbols = np.concatenate([np.append(p, len(ids) + 1 + k) for k, p in enumerate(parts)])
    page = np.repeat(owners, sizes + 1)
    order, rank = sorted_suffixes(symbols, RUN)
    pairs = np.unique(rank * (len(pages) + 1) + page)
    many = np.bincount(pairs // (len(pages) + 1), minlength=len(symbols) + 1)[rank] >= PAGES
    depth = np.zeros(len(symbols) + RUN + 1, np.int64)
    at = np.flatnonzero(many)
    depth[at] += 1
    np.subtract.at(depth, at + RUN, 1)
    covered = np.cumsum(depth)[: len(symbols)] > 0
    ends = np.cumsum(sizes + 1)
    return [covered[e - n - 1 : e - 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def unique_words(words: list[str], covered: np.ndarray) -> list[str]:
    """What is not covered. A run from the block before that ends with a few words of this one is not
    this block's."""
    if covered.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]))).reshape(-1, 2)
    gone = np.zeros(len(words), bool)
    for a, b in edges[np.diff(edges, axis=1)[:, 0] >= RUN]:
        gone[a:b] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def main_text(marked: list[tuple[int, str]], covered: np.ndarray) -> str:
    if any(mark == ARTICLE for mark, _ in marked):
        return " ".join(text for mark, text in marked if mark == ARTICLE)
    kept, at = [], 0
    for mark, text in marked:
        words = text.split(" ")
        if mark == PLAIN:
            kept += unique_words(words, covered[at : at + len(words)])
        at += len(words) + 1
    return " ".join(kept)


def _runs(page: list[str]) -> np.ndarray:
    """Hash of the run at each place of a page's blocks, laid out as in :func:`repeated`."""
    return gram_hashes(hashes_of([w for b in page for w in [*b.encode().split(b" "), b""]]), RUN)


def _marked() -> Column:
    """Whether a page has an article; a mark is a byte, two hexadecimal digits."""
    return F.hex("marks").rlike(f"^(..)*{ARTICLE:02X}")


def _repeated_runs(parsed: DataFrame) -> DataFrame:
    """``(place, at)``: where in the pages without an article a run starts that stands on ``PAGES`` or more
    distinct pages of its host. Runs are counted over the whole host; no task holds a host."""

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(_runs(b)) for b in batch.column(1).to_pylist()]
        hosts = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(r) for r in own])))
        return pa.RecordBatch.from_arrays([hosts, pa.array(np.concatenate(own).view(np.int64))], ["host", "run"])

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [_runs(b) for b in batch.column(2).to_pylist()]
        row = pa.array(np.repeat(np.arange(len(own)), [len(r) for r in own]))
        at = np.concatenate([np.arange(len(r)) for r in own])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(own).view(np.int64)), pa.array(at, pa.int64())],
            ["host", "place", "run", "at"],
        )

    unmarked = parsed.filter(~_marked())
    asked = parsed.join(unmarked.select("host").distinct(), "host", "left_semi")
    # No block holds a line break.
    once = asked.select("host", F.sha2(F.array_join("blocks", "\n"), 256).alias("same"), "blocks").dropDuplicates(["host", "same"])
    found = once.select("host", "blocks").mapInArrow(in_batches(runs), "host string, run long")
    often = found.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= PAGES).select("host", "run")
    stand = unmarked.select("host", "place", "blocks").mapInArrow(in_batches(places), "host string, place long, run long, at long")
    return stand.join(often, ["host", "run"], "left_semi").select("place", "at")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Repeats are looked for on hosts that have a page without an article; the pages of all other hosts take one
    map and are neither shuffled nor stored. A host's pages meet in one task, in one suffix array; the runs of a
    host of more than ``SHARD_PAGES`` pages or ``SHARD_CHARS`` characters are counted over all its tasks, with
    the same result."""
    parsed_schema = "page_id long, url string, host string, place long, marks binary, blocks array<string>"
    names = [x.split()[0] for x in parsed_schema.split(", ")]
    made = "page_id long, url string, text string, n_chars long"

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, texts = [], []
        for source in batch.column(4).to_pylist():
            found = blocks(source)
            marks.append(bytes(m for m, _ in found))
            texts.append([t for _, t in found])
        columns = [*batch.columns[:4], pa.array(marks, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def result(rows: list[dict], covered: list[np.ndarray]) -> pa.RecordBatch:
        texts = [main_text(list(zip(r["marks"], r["blocks"], strict=True)), c) for r, c in zip(rows, covered, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["page_id"] for r in rows], pa.int64()),
                pa.array([r["url"] for r in rows], pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["host"] != held[-1]["host"]:
                    yield result(held, repeated([r["blocks"] for r in held]))
                    held = []
                held.append(row)
        if held:
            yield result(held, repeated([r["blocks"] for r in held]))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        covered = []
        for r in rows:
            depth = np.zeros(sum(b.count(" ") + 2 for b in r["blocks"]) + RUN + 1, np.int64)
            at = np.array(r["at"] or [], np.int64)
            depth[at] += 1
            np.subtract.at(depth, at + RUN, 1)
            covered.append(np.cumsum(depth) > 0)
        return result(rows, covered)

    def survey(batch: pa.RecordBatch) -> pa.RecordBatch:
        sources = batch.column(1).to_pylist()
        chars, bare = pa.array([len(x) for x in sources], pa.int64()), pa.array([not has_article(x) for x in sources], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), chars, bare], names=["host", "chars", "bare"])

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        return result(rows, [np.zeros(0, bool)] * len(rows))

    def parsed(df: DataFrame) -> DataFrame:
        return df.select("page_id", "url", "host", "place", "html").mapInArrow(in_batches(parse), parsed_schema)

    given = pages.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        F.monotonically_increasing_id().alias("place"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    seen = given.select("host", "html").mapInArrow(in_batches(survey), "host string, chars long, bare boolean")
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.max("bare").alias("bare"))
    large = (F.col("n") > SHARD_PAGES) | (F.col("chars") > SHARD_CHARS)
    asked = stored(hosts.filter("bare").select("host", large.alias("large")), "asked-hosts")
    kinds = {r["large"]: r["n"] for r in asked.groupBy("large").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds:
        return parsed(given).mapInArrow(in_batches(own), made)
    if sum(kinds.values()) <= BROADCAST_HOSTS:
        sized = given.join(F.broadcast(asked), "host", "left")
        part = {kind: parsed(sized.filter(kind)) for kind in ("large is null", "not large", "large")}
    else:
        # Texts, not pages, are moved to the many hosts.
        sized = stored(parsed(given).join(asked, "host", "left"), "sized-pages")
        part = {kind: sized.filter(kind).drop("large").select(*names) for kind in ("large is null", "not large", "large")}
    alone = part["large is null"].mapInArrow(in_batches(own), made)
    together = part["not large"].repartition("host").sortWithinPartitions("host")
    out = alone.union(together.mapInArrow(extract, made)) if False in kinds else alone
    if True not in kinds:
        return out
    whole = stored(part["large"], "large-pages")
    runs = _repeated_runs(whole).groupBy("place").agg(F.collect_list("at").alias("at"))
    # Pages with an article need no runs and stay where they are.
    marked = whole.filter(_marked()).withColumn("at", F.lit(None).cast("array<long>"))
    other = whole.filter(~_marked()).join(runs, "place", "left").select(*marked.columns)
    return out.union(marked.mapInArrow(in_batches(counted), made)).union(other.mapInArrow(in_batches(counted), made))
