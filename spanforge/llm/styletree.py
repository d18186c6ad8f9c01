"""Main text of web pages by a site style tree.

The DOM trees of a site's pages are laid over each other. An element node is a path of tags from the root, once with and once without the elements' classes. It collects the styles in which it occurs (its sequence of child tags, runs taken as one) and the segments of its own text (what stands between punctuation marks). With m pages that have the node, two importances come from entropies to the base m:

* presentation: the entropy of its styles over the pages; a node that always looks the same has 0;
* content: 1 less the mean entropy of its different segments, a segment on n pages having log n / log m. Segments that recur on all pages have 0, those of a single page 1. As the mean goes over different segments, copies of a page don't make its article a template: they add no segment.

A node's importance is 1 - gamma of its presentation and gamma of its content. Nodes below a threshold are noise; their text is removed from every page of the site, and with it each branch that has nothing else.

Every node is judged twice: by its own site, where that has enough pages, and by the tree of all sites laid over each other, which knows menus and notices of sites that are too small to repeat theirs. A site whose tree finds nothing important that the tree of all sites finds important too (all its pages are copies of few) tells nothing by itself. Where an element's path with classes is on too few pages to be judged, as when classes differ from page to page, its path of tags alone is. Nodes on fewer than `least_pages` pages aren't judged, and stay. What only the meaning of words could tell, such as comments that never recur, stays too.

Only markup decides besides: heads, scripts, styles, templates and the labels of controls are no text. No tag, class, role or id stands for content or noise; classes only part nodes.

Statistics are counts over all pages, aggregated before they are shuffled: a site with a third of all pages costs its reducers no more rows than it has different segments. Nodes that are noise are broadcast while they are few; else they are joined with the nodes of each page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)", re.S)
UNFINISHED = re.compile("/?[a-zA-Z]")
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SEGMENTS = re.compile(r"(?:[^\w\s,'’\-]|_)+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Tags whose text runs on with what is around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_ENDS_AT = frozenset("button td th li div article section main body".split())
#: Siblings that end each other, within the nearest of the containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What a browser doesn't show as text, or shows on a control.
NO_TEXT = frozenset("head noscript template select datalist button svg canvas object audio video".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())


@dataclass(frozen=True)
class Config:
    gamma: float = 0.9
    site_threshold: float = 0.45  # least importance of a node that a site's own tree keeps
    common_threshold: float = 0.75  # the same of the tree of all sites
    least_pages: int = 10  # that have a node, for it to be judged
    broadcast_nodes: int = 200_000


def site(url: str | None) -> str:
    """Host of a URL, in lower case; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def key(text: str, above: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), above)


def _named(x: int) -> int:
    """Names of nodes with classes are odd, those without are even."""
    return x | 1


def _plain(x: int) -> int:
    return x & ~1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass
class Block:
    nodes: tuple[int, int]  # of the element that holds it: by tags and classes, by tags alone; the same where its path has no class
    text: str


class Page:
    """Blocks of text in page order, and the style of each element. Never raises on malformed markup; memory grows with the markup, however deep it is."""

    def __init__(self, markup: str):
        self.blocks: list[Block] = []
        self.styles: set[tuple[int, int]] = set()  # (node, style)
        # open block elements: tag, node with classes, node without, style of each so far, last child of each, whether its path has a class
        self.open: list[list] = [["", 1, 0, 0, 0, "", "", False]]
        self.places: dict[str, list[int]] = {}  # of open tags in the list above
        self.silent = 0  # open elements without text
        self.buffer: list[str] = []
        self._read(markup)
        self._pop_to(0)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            self.buffer = []
            if text and not self.silent:
                _, named, plain, *_, classed = self.open[-1]
                self.blocks.append(Block((named, plain if classed else named), text))

    def _pop_to(self, size: int) -> None:
        self._flush()
        for tag, named, plain, style, plain_style, _, _, classed in reversed(self.open[size:]):
            if tag:
                self.places[tag].pop()
            self.silent -= tag in NO_TEXT
            self.styles.add((named, style))
            if classed:
                self.styles.add((plain, plain_style))
        del self.open[size:]

    def _nearest(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close(self, tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Ends open elements up to the outermost of the given tags above the nearest stop."""
        open_ = [p for t in tags if (p := self.places.get(t))]
        if open_:
            stop = max(map(self._nearest, stops))
            found = [p[i] for p in open_ if (i := bisect_right(p, stop)) < len(p)]
            if found:
                self._pop_to(min(found))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            return
        if tag == "br" or tag == "wbr":
            self.buffer.append(" " if tag == "br" else "")
            return
        if tag in VOID and tag != "hr":
            return
        if tag not in IN_HEAD and (head := self._nearest("head")):
            self._pop_to(head)
        if tag in CLOSES_P:
            self._close({"p"}, P_ENDS_AT)
        if tag in ENDS:
            self._close(*ENDS[tag])
        self._flush()
        if tag == "hr":
            return
        label = tag
        if attributes and (m := CLASS.search(attributes)):
            label = ".".join([tag, *sorted(set((m[1] or m[2] or m[3] or "").split()))])
        above = self.open[-1]
        # the style is that of the sequence of children, in which a run of equal ones is one
        if above[5] != label:
            above[3], above[5] = key(label, above[3]), label
        if above[6] != tag:
            above[4], above[6] = key(tag, above[4]), tag
        self.places.setdefault(tag, []).append(len(self.open))
        self.silent += tag in NO_TEXT
        self.open.append([tag, _named(key(label, above[1])), _plain(key(tag, above[2])), 0, 0, "", "", above[7] or label != tag])

    def _end(self, tag: str) -> None:
        if tag not in INLINE and (at := self._nearest(tag)):
            self._pop_to(at)

    def _read(self, markup: str) -> None:
        at, size = 0, len(markup)
        while at < size:
            m = TOKEN.match(markup, at)
            at = m.end()
            if m[4] == "<" and UNFINISHED.match(markup, at):
                # a tag with an open quote ends at the next ">", one without an end is no text
                at = markup.find(">", at) + 1 or size
            elif m[4] is not None:
                self.buffer.append(m[4])
            elif m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                else:
                    self._start(tag, m[3])
                    if tag in RAW:
                        stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(markup, at)
                        self._end(tag)
                        at = stop.end() if stop else size


def segments(text: str) -> set[str]:
    """What stands between punctuation marks, in lower case."""
    return {s for x in SEGMENTS.split(text.lower()) if (s := x.strip())}


#: Kinds of observations: a style of a node, a segment of its text, and that it has text.
STYLE, SEGMENT, TEXT = 0, 1, 2


def observations(page: Page) -> set[tuple[int, int, int]]:
    """(node, kind, what) of a page, once each."""
    found = {(node, STYLE, style) for node, style in page.styles}
    for b in page.blocks:
        parts = [key(s) for s in segments(b.text)]
        for node in set(b.nodes):
            found.add((node, TEXT, 0))
            found.update((node, SEGMENT, p) for p in parts)
    return found


def nodes(pages: DataFrame, config: Config = Config(), url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, node, pages, presentation, content, importance) of each node with text, of each site's tree and, under a null host, of the tree of all sites. host and node are hashes; pages are those on which the node has text."""
    common.prepare(pages.sparkSession)
    schema = pa.schema([("host", pa.int64()), ("node", pa.int64()), ("kind", pa.int32()), ("what", pa.int64()), ("n", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = defaultdict(Counter)
        held = 0

        def emit() -> pa.RecordBatch:
            rows = [(host, *o, n) for host, of in seen.items() for o, n in of.items()]
            seen.clear()
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

        for batch in batches:
            for url, markup in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
                of = seen[key(site(url))]
                before = len(of)
                of.update(observations(Page(markup)))
                held += len(of) - before
                if held > 200_000:
                    yield emit()
                    held = 0
        yield emit()

    parts = pages.select(F.col(url_column), F.col(html_column)).mapInArrow(apply, "host long, node long, kind int, what long, n long")
    each = common.stored(parts.groupBy("host", "node", "kind", "what").agg(F.sum("n").alias("n")))
    everywhere = each.groupBy("node", "kind", "what").agg(F.sum("n").alias("n")).select(F.lit(None).cast("long").alias("host"), "node", "kind", "what", "n")

    def tree(counts: DataFrame) -> DataFrame:
        of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
        n, log = F.col("n").cast("double"), F.log(F.col("n"))
        found = counts.groupBy("host", "node").agg(of(STYLE, n).alias("held"), of(STYLE, n * log).alias("nlogn"), of(SEGMENT, F.lit(1.0)).alias("segments"), of(SEGMENT, log).alias("logs"), of(TEXT, F.col("n")).alias("pages"))
        presentation = F.when(F.col("held") > 1, F.greatest(F.lit(0.0), F.lit(1.0) - F.col("nlogn") / F.col("held") / F.log("held"))).otherwise(1.0)
        content = F.when((F.col("pages") > 1) & (F.col("segments") > 0), F.lit(1.0) - F.col("logs") / F.col("segments") / F.log("pages")).otherwise(1.0)
        importance = F.lit(1 - config.gamma) * F.col("presentation") + F.lit(config.gamma) * F.col("content")
        return found.where("pages IS NOT NULL").select("host", "node", "pages", presentation.alias("presentation"), content.alias("content")).withColumn("importance", importance)

    return tree(each).unionByName(tree(everywhere))


def judged(found: DataFrame, config: Config = Config()) -> DataFrame:
    """(host, node, removed) of the nodes that are removed, host null: on every site; and of those with classes that stay, as these aren't judged by their tags."""
    enough = common.stored(found.where(F.col("pages") >= config.least_pages))
    of_all, own = enough.where("host IS NULL"), enough.where("host IS NOT NULL")
    good = of_all.where(F.col("importance") >= config.common_threshold)
    # sites that find something important which is so everywhere
    telling = own.where(F.col("importance") >= config.site_threshold).join(good.select("node"), "node", "left_semi").select("host").distinct()
    low = own.where(F.col("importance") < config.site_threshold).join(telling, "host", "left_semi")
    gone = of_all.where(F.col("importance") < config.common_threshold).unionByName(low).select("host", "node", F.lit(True).alias("removed"))
    return gone.unionByName(good.where(F.col("node").bitwiseAND(F.lit(1)) == 1).select("host", "node", F.lit(False).alias("removed")))


def text_of(page: Page, verdict) -> str:
    """Blocks that stay. verdict tells of a node whether it is removed, or None where it isn't judged."""

    def gone(nodes: tuple[int, int]) -> bool:
        found = verdict(nodes[0])
        return bool(verdict(nodes[1])) if found is None else found

    return "\n\n".join(b.text for b in page.blocks if not gone(b.nodes))


def extract(pages: DataFrame, config: Config = Config(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text) of every row; text is empty where nothing is left.

    A null html is empty, a null or odd url has an empty host, which is a site like any other. Repeated ids and rows are kept, each with its own text, as are null ids. Pages of any length or depth are read whole. Tables of few pages keep what doesn't recur in them. An empty table has no row. Other columns aren't read.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    slim = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("h"))
    known = common.stored(judged(nodes(pages, config, url_column, html_column), config))
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    if known.count() <= config.broadcast_nodes:
        sent = common.Shared(spark, {(r["host"], r["node"]): r["removed"] for r in known.collect()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = sent.value.get
            for batch in batches:
                urls, texts = batch.column(1).to_pylist(), []
                for url, markup in zip(urls, common.texts(batch.column(2))):
                    host = _signed(key(site(url)))
                    texts.append(text_of(Page(markup), lambda node: get((host, _signed(node))) or get((None, _signed(node)))))  # noqa: B023
                yield common.like(schema, [batch.column(0).to_pylist(), urls, texts])

        source = slim
    else:
        source = _with_verdicts(slim, known)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                verdicts = [{v["node"]: v["removed"] for v in found or ()} for found in batch.column(3).to_pylist()]
                texts = [text_of(Page(markup), lambda node, of=of: of.get(_signed(node))) for markup, of in zip(common.texts(batch.column(2)), verdicts)]
                yield common.like(schema, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts])

    out = source.mapInArrow(apply, "id long, url string, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text")


def _with_verdicts(slim: DataFrame, known: DataFrame) -> DataFrame:
    """slim with the verdicts on each page's nodes. Pages are known by hashes of their url and html, so that equal ones are asked for once; a page's nodes are joined with the judged ones, and nothing of a site is gathered but what one page has."""
    schema = pa.schema([("page", pa.int64()), ("host", pa.int64()), ("node", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, _signed(key(site(url))), _signed(node)) for page, url, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2))) for node in sorted({n for b in Page(markup).blocks for n in b.nodes})]
            yield common.like(schema, [[r[i] for r in rows] for i in range(3)])

    page = F.xxhash64("url", "h")
    asked = slim.select(page.alias("page"), "url", "h").mapInArrow(apply, "page long, host long, node long").distinct()
    everywhere = asked.join(known.where("host IS NULL").select("node", "removed"), "node").select("page", "node", "removed")
    own = asked.join(known.where("host IS NOT NULL"), ["host", "node"]).select("page", "node", "removed")
    each = everywhere.unionByName(own).groupBy("page", "node").agg(F.max("removed").alias("removed"))
    found = each.groupBy("page").agg(F.collect_list(F.struct("node", "removed")).alias("verdicts"))
    return slim.withColumn("page", page).join(found, "page", "left").select("id", "url", "h", "verdicts")


def query(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
