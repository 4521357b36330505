"""Main text of web pages by wrapper induction over all pages of a host.

The block trees of a host's pages are aligned by simple tree matching (ordered trees, largest
matching, repeated neighbours as one node) into the host's wrapper, and every page is then aligned
with it. A text that stands at one node of the wrapper in the pages that can prove it is template;
what varies is content. Pages that are near copies of another prove nothing and are left out, so
that the text of copies does not become template.

Nodes of the wrapper carry labels: navigation, headers, footers, sidebars, notices, adverts,
forms, comments and the like are no content even where they vary from page to page, and where a
page marks its article, content lies in it. There a text has to stand in all of at least
``region_pages`` pages to be template, elsewhere in more than half of at least two.

Pages are taken in the order of their hash, those with and without a marked article apart. A near
copy has more than half (without marked article nine tenths) of its characters in texts that an
earlier page holds too, where that page is the first to hold one of them or holds just the same
texts. So a page is compared with as many others as it has texts, not with all of its host.

No task takes all pages of a host: texts, near copies and standing texts are counted by key, and
the trees, without texts and each layout once, are merged in groups of ``FAN`` layouts. Wrappers are
a stored table, so the planner broadcasts them only while they are small, and otherwise joins by
host, where the pages of a hot host can be split.
"""
from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, stored
from repograph.llm.dom import (
    Group, absorb, aligned, blocks, grouped, mark_constant, parse, put_texts, settle, text_hash)

REGION_PAGES = 8
COPIED = {True: 0.5, False: 0.9}   # share of a near copy's characters, with and without marked article
FAN = 128                     # layouts that one task merges
LINKED = 0.8                  # share of linked characters from which a block is a menu item


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", ""))


def _number(text: str) -> int:
    """A text's hash as Spark's bigint."""
    n = int(text_hash(text), 16)
    return n - (1 << 64) if n >> 63 else n


def _name(number: int) -> str:
    return f"{number & (1 << 64) - 1:x}"


def features(html: str) -> tuple[bool, int, int, dict[int, int], Group]:
    """(marks an article, characters, hash equal for pages of the same texts, characters of each
    text, tree) of a page; texts of the tree outside the article count 0 characters."""
    root = parse(html)
    regions = settle(root)
    tree = grouped(regions or [root]) if len({r.label for r in regions}) < 2 else grouped([root])
    texts = {_number(t): len(t) for r in regions or [root] for t, _, _ in blocks(r)}
    size = sum(texts.values())
    same = _number(" ".join(map(str, sorted(texts))) if size else "html " + html)
    if len({r.label for r in regions}) > 1:
        texts = {_number(t): 0 for t, _, _ in blocks(root)} | texts
    return bool(regions), size, same, texts, tree


def copied_from(shared: list[tuple[int, int, int]], need: float) -> tuple[bool, list[int]]:
    """Of a page's (first page, text, characters) that earlier pages hold: whether one of these is
    the first to hold more than ``need`` characters, or else those that can hold so many."""
    own = Counter()
    for q, _, n in shared:
        own[q] += n
    if any(n > need for n in own.values()):
        return True, []
    out, total = [], 0
    for q in sorted(own):                   # a page holds no text that first stands in a later one
        total += own[q]
        if total > need:
            out.append(q)
    return False, out


def merged_layouts(layouts: Iterable[str]) -> Group:
    wrapper = None
    for layout in layouts:
        tree = Group.of_list(json.loads(layout))
        if wrapper is None:
            wrapper = tree
        else:
            absorb(wrapper, tree)
    return wrapper


def least_pages(regions: bool, n: int, region_pages: int) -> int:
    """In how many of ``n`` pages a template text stands; 0 if they prove nothing."""
    return (n if n >= region_pages else 0) if regions else (n // 2 + 1 if n >= 2 else 0)


def induce(pages: list[str], region_pages: int = REGION_PAGES) -> str | None:
    """The wrapper of a host's pages as JSON: [without, with marked article], each a tree of labels
    and template texts; null if nothing can be proved to be template. What ``host_wrappers`` does
    by keys, for pages in the order of their hashes that fit in memory."""
    kinds: dict[bool, dict] = {False: {}, True: {}}
    for h, html in enumerate(pages):
        regions, size, same, texts, tree = features(html)
        kinds[regions].setdefault(same, (h, size, texts, tree))
    out: list = [None, None]
    for regions, found in kinds.items():
        first: dict = {}
        kept = []
        for h, size, texts, tree in sorted(found.values(), key=lambda p: p[0]):
            need = COPIED[regions] * size
            shared = [(first[t][0], t, n) for t, n in texts.items() if n and t in first]
            copy, others = copied_from(shared, need)
            if not copy and not any(sum(n for _, t, n in shared if q in first[t][1]) > need for q in others):
                kept.append((texts, tree))
            for t, n in texts.items():
                if n:
                    first.setdefault(t, (h, set()))[1].add(h)
        least = least_pages(regions, len(kept), region_pages)
        if not least:
            continue
        trees = [t for _, t in kept if t.label == kept[0][1].label]
        wrapper = merged_layouts(dict.fromkeys(json.dumps(t.labels()) for t in trees))
        wrapper.numbered()
        counts = Counter((w.at, t) for tree in trees for w, p in aligned(wrapper, tree) for t in p.texts)
        marks = defaultdict(list)
        for (at, t), n in counts.items():
            if n >= least:
                marks[at].append(t)
        if marks:
            put_texts(wrapper, marks)
            out[regions] = wrapper.to_list()
    return json.dumps(out) if any(out) else None


def main_text(html: str, wrapper: list | None = None) -> str:
    """The article of a page: its content blocks in page order, joined by newlines."""
    root = parse(html)
    regions = settle(root)
    tops = regions or [root]
    template = wrapper[bool(regions)] if wrapper else None
    if template:
        template = Group.of_list(template)
        page = grouped(tops if len({r.label for r in tops}) < 2 else [root])
        if page.label == template.label:
            mark_constant(template, page)
    out = []
    for top in tops:
        for text, linked, node in blocks(top):
            if not regions and linked >= LINKED * len(text):
                continue
            if template and node.group and node.group.constant and text_hash(text) in node.group.constant:
                continue
            out.append(text)
    return "\n".join(out)


KIND = ["host", "regions"]


def _read_pages(batches: Iterator) -> Iterator:
    """(host, regions, h, size, same, texts, tree) of (host, h, html)."""
    schema = pa.schema([("host", pa.string()), ("regions", pa.bool_()), ("h", pa.int64()), ("size", pa.int64()),
                        ("same", pa.int64()), ("texts", pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int32())]))),
                        ("tree", pa.string())])
    for b in arrow_batches(batches):
        rows = []
        for html in b.column(2).to_pylist():
            regions, size, same, texts, tree = features(html)
            rows.append((regions, size, same, [{"t": t, "n": n} for t, n in texts.items()], json.dumps(tree.to_list())))
        regions, size, same, texts, tree = map(list, zip(*rows)) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(regions, pa.bool_()), b.column(1), *(
                pa.array(v, schema.field(f).type) for f, v in
                (("size", size), ("same", same), ("texts", texts), ("tree", tree)))], schema=schema)


def _compared(batches: Iterator) -> Iterator:
    """Of (host, regions, h, need, shared): (host, regions, h, need, q, t, n), the texts that page
    ``q`` may hold; a null ``q`` where the page is known to be a near copy."""
    schema = pa.schema([("host", pa.string()), ("regions", pa.bool_()), ("h", pa.int64()), ("need", pa.float64()),
                        ("q", pa.int64()), ("t", pa.int64()), ("n", pa.int32())])
    for b in arrow_batches(batches, 1 << 20):
        rows = []
        for row in b.to_pylist():
            shared = [(s["q"], s["t"], s["n"]) for s in row.pop("shared")]
            copy, others = copied_from(shared, row["need"])
            if copy:
                rows.append({**row, "q": None, "t": None, "n": None})
            for q in others:
                rows += [{**row, "q": q, "t": t, "n": n} for f, t, n in shared if f <= q]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def _near_copies(pages: DataFrame) -> DataFrame:
    """Stored (host, regions, h) of the near copies."""
    texts = pages.select(*KIND, "h", "size", F.inline("texts")).where("n > 0")
    first = stored(texts.groupBy(*KIND, "t").agg(F.min("h").alias("q"), F.max("h").alias("last"))
                   .where("q < last").drop("last"), "first-pages")
    need = F.when(F.col("regions"), F.lit(COPIED[True])).otherwise(F.lit(COPIED[False])) * F.col("size")
    shared = texts.join(first, [*KIND, "t"]).where("q < h").groupBy(*KIND, "h", need.alias("need")).agg(
        F.collect_list(F.struct("q", "t", "n")).alias("shared"), F.sum("n").alias("n"))
    compared = stored(shared.where("n > need").drop("n").mapInArrow(
        _compared, "host string, regions boolean, h long, need double, q long, t long, n int"), "compared-pages")
    held = texts.select(*KIND, F.col("h").alias("q"), "t")
    copies = compared.where("q is not null").join(held, [*KIND, "q", "t"]).groupBy(*KIND, "h", "need", "q").agg(
        F.sum("n").alias("n")).where("n > need")
    return stored(compared.where("q is null").select(*KIND, "h").union(copies.select(*KIND, "h")).distinct(),
                  "near-copies")


def _layouts(batches: Iterator) -> Iterator:
    """(host, regions, h, label, layout) of (host, regions, h, tree)."""
    for b in arrow_batches(batches):
        trees = [Group.of_list(json.loads(t)) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([t.label for t in trees], pa.string()),
             pa.array([json.dumps(t.labels()) for t in trees], pa.string())],
            names=[*KIND, "h", "label", "layout"])


def _merge(group: pa.Table) -> pa.Table:
    layout = merged_layouts(group.sort_by("h").column("layout").to_pylist())
    return pa.table({"host": group["host"][:1], "regions": group["regions"][:1],
                     "h": pa.array([min(group["h"].to_pylist())], pa.int64()),
                     "layout": pa.array([json.dumps(layout.to_list())], pa.string())})


def _merged(layouts: DataFrame) -> DataFrame:
    """Stored (host, regions, h, layout): one layout of each kind of pages, in as many rounds as
    groups of ``FAN`` need."""
    schema = "host string, regions boolean, h long, layout string"
    while True:
        parts = layouts.groupBy(*KIND).agg(F.ceil(F.count("*") / FAN).alias("parts"))
        most = parts.agg(F.max("parts")).first()[0] or 0
        dealt = layouts.join(parts, KIND).withColumn("part", F.pmod(F.xxhash64("layout"), "parts")).drop("parts")
        layouts = stored(dealt.groupBy(*KIND, "part").applyInArrow(_merge, schema), "layouts")
        if most <= 1:
            return layouts


def _standing(batches: Iterator) -> Iterator:
    """(host, regions, at, t) of (host, regions, tree, layout, often): where in the layout the
    texts that are frequent enough stand in each page."""
    known: dict = {}
    for b in arrow_batches(batches):
        out: list = []
        for host, regions, tree, layout, often in zip(*(c.to_pylist() for c in b.columns)):
            if (key := (host, regions)) not in known:
                if len(known) >= 1000:
                    known.clear()
                wrapper = Group.of_list(json.loads(layout))
                wrapper.numbered()
                known[key] = wrapper, {_name(t): t for t in often}
            wrapper, names = known[key]
            page = Group.of_list(json.loads(tree))
            if page.label == wrapper.label:
                out += [(host, regions, w.at, names[t]) for w, p in aligned(wrapper, page) for t in p.texts if t in names]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=[*KIND, "at", "t"])


def _wrapper(group: pa.Table) -> pa.Table:
    """The wrapper of a host from (host, regions, at, t, layout) sorted by page kind and place."""
    out: list = [None, None]
    rows = sorted(zip(*(group[c].to_pylist() for c in ("regions", "at", "t", "layout"))))
    for regions, of in groupby(rows, lambda r: r[0]):
        marks = defaultdict(list)
        for _, at, t, layout in of:
            marks[at].append(_name(t))
        wrapper = Group.of_list(json.loads(layout))
        wrapper.numbered()
        put_texts(wrapper, marks)
        out[regions] = wrapper.to_list()
    return pa.table({"host": group["host"][:1], "wrapper": pa.array([json.dumps(out)], pa.string())})


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  region_pages: int = REGION_PAGES) -> DataFrame:
    """Stored (host, wrapper) of the hosts in whose pages a template can be proved."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("h"),
                        F.col(html_col).alias("html")).where(F.col("html") != "")
    read = rows.mapInArrow(_read_pages, "host string, regions boolean, h long, size long, same long, "
                                        "texts array<struct<t:long,n:int>>, tree string")
    # pages of the same texts are copies of the first of them
    read = stored(read.groupBy(*KIND, "same").agg(F.min_by(F.struct("h", "size", "texts", "tree"), "h").alias("p"))
                  .select(*KIND, "p.*"), "wrapper-pages")
    kept = read.join(_near_copies(read), [*KIND, "h"], "left_anti")

    n = F.col("n")
    least = F.when(F.col("regions"), F.when(n >= region_pages, n)).when(n >= 2, F.floor(n / 2) + 1)
    enough = stored(kept.groupBy(*KIND).agg(F.count("*").alias("n")).select(*KIND, least.alias("least"))
                    .where("least is not null"), "page-kinds")
    often = kept.select(*KIND, F.inline("texts")).groupBy(*KIND, "t").agg(F.count("*").alias("c")).where(
        F.col("c") >= min(2, region_pages)).join(enough, KIND).where("c >= least").groupBy(*KIND, "least").agg(F.collect_list("t").alias("often"))
    often = stored(often, "frequent-texts")
    kept = kept.join(often.select(*KIND), KIND).select(*KIND, "h", "tree")
    layouts = kept.mapInArrow(_layouts, "host string, regions boolean, h long, label string, layout string")
    layouts = stored(layouts.groupBy(*KIND, "label", "layout").agg(F.min("h").alias("h")), "layouts")
    roots = layouts.groupBy(*KIND).agg(F.min_by("label", "h").alias("label"))
    layouts = _merged(layouts.join(roots, [*KIND, "label"]).select(*KIND, "h", "layout")).select(*KIND, "layout")

    standing = kept.join(layouts.join(often, KIND), KIND).select(*KIND, "tree", "layout", "often").mapInArrow(
        _standing, "host string, regions boolean, at long, t long")
    marks = standing.groupBy(*KIND, "at", "t").agg(F.count("*").alias("c")).join(often, KIND).where("c >= least")
    return stored(marks.join(layouts, KIND).select(*KIND, "at", "t", "layout").groupBy("host").applyInArrow(
        _wrapper, "host string, wrapper string"), "wrappers")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      region_pages: int = REGION_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Blocks are those of HTML's block elements; a line break or any other inline element is white
    space or nothing inside its block. Only blocks with no text are left out of a page's article.

    Defined results: null and empty html have an empty text; a null URL, or one without host,
    belongs to the host with the empty name; equal pages count once for their host's wrapper, and
    repeated rows each have a row; an empty table gives no rows.
    """
    wrappers = host_wrappers(pages, url_col, html_col, region_pages)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(wrappers, "host", "left").select("id", "url", "html", "wrapper")
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        known: dict = {}
        for b in arrow_batches(batches):
            texts = []
            for html, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if wrapper is not None and wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(html or "", known.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    found = rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
    return found.withColumnRenamed("id", id_col)
