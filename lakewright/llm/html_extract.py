"""Main text of web pages by wrapper induction.

Every page is a tree of blocks (`dom`). The pages of a host are folded into its wrapper: two trees are aligned by
simple tree matching, neighbours of one kind are one slot, and each slot keeps on how many pages it stands, how much
text and linked text it holds, and its text as long as that never changed. A slot whose text never changes is
template, one that varies is content, unless its place says that it is a menu, form, advert, notice or comment.
The wrapper decides; a page is aligned with it once more and gives the blocks that stand in content slots.

On a slot: within an article, main or content element (fixed names, in this order) text stays; only text that such an
element holds directly is dropped where it never changes on MANY pages, as near copies of one article on a host make
its headings and paragraphs look constant too. Where no page declares such an element, slots that vary and are not mostly links are content.
A page whose host is unknown (null or relative url) is its own wrapper, and one page alone has no template.

Each task folds its pages into one wrapper for each host that it meets, at most HOSTS at a time, so what is shuffled is wrappers,
never pages; rounds of folding at most some FAN of them end in one for each host, however many pages it has.
All pages take part. A wrapper's size is bounded by the kinds of elements, not by the number of pages.

Null html is empty and gives an empty text. Repeated rows each give a row; null ids and urls stay. A long page is whole
within one task. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import written

HOSTS, FAN = 512, 64
#: Pages from which a constant text counts as template, outside and inside of declared content.
FEW, MANY = 3, 8
HOT_HOSTS, HOT_PAGES = 1 << 14, 256
#: Elements whose text is an article's own wherever they stand in it (fixed values).
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote td th figcaption".split())
KINDS = "amcv"
WRAPPERS = "host string, wrapper string"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dom.Slot] = {}

    def out() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array([json.dumps(w.packed(), separators=(",", ":")) for w in known.values()], pa.string())], ["host", "wrapper"])
        known.clear()
        return found

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for host, page in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns], strict=True):
                found = dom.wrapper(dom.parse(page))
                before = known.get(host)
                known[host] = dom.merged(before, found) if before else found
                if len(known) >= HOSTS:
                    yield out()
    if known:
        yield out()


def _fold_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one (host, part)."""
    now, own = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([json.dumps(own.packed(), separators=(",", ":"))], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, part, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = dom.Slot.unpacked(json.loads(packed))
            if (host, part) == now:
                own = dom.merged(own, found)
                continue
            if now is not None:
                yield out()
            now, own = (host, part), found
    if now is not None:
        yield out()


def induce(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> host, wrapper (packed): a written table with a row for each known host."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host <> '' and html <> ''")
    found = written(rows.mapInArrow(_fold_pages, WRAPPERS), "he-wrappers")
    while True:
        most = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= 1:
            return found
        parts = -(-most // FAN)
        dealt = found.select("host", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.lit(parts)).alias("part"), "wrapper")
        found = written(dealt.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_fold_wrappers, WRAPPERS), "he-wrappers")


class Verdict:
    """A slot of a wrapper with what becomes of its text: the kind of content it is, or empty."""

    __slots__ = ("key", "role", "kind", "kids")

    def __init__(self, key: str, role: str, kind: str, kids: list[Verdict]):
        self.key, self.role, self.kind, self.kids = key, role, kind, kids

    def packed(self) -> list:
        return [self.key, self.role, self.kind, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(x: list) -> Verdict:
        return Verdict(x[0], x[1], x[2], [Verdict.unpacked(k) for k in x[3]])


def _declares(slot: dom.Slot) -> bool:
    """Whether an article or main element stands below."""
    return any(k.role in ("a", "m") or _declares(k) for k in slot.kids)


def judged(slot: dom.Slot, parent: dom.Slot | None = None, kind: str = "v") -> Verdict:
    """What a wrapper says of each of its slots."""
    if not slot.key:
        constant = slot.mark != "*"
        tag = parent.key.split(".")[0] if parent else ""
        if kind == "v":
            drop = (constant and slot.pages >= FEW) or 2 * slot.linked > slot.chars
        else:
            drop = constant and slot.pages >= MANY and tag not in PROSE
        return Verdict("", "", "" if drop else kind, [])
    if slot.role == "x" or (slot.role == "y" and not _declares(slot)) or (slot.role == "h" and kind not in ("a", "m")):
        return Verdict(slot.key, slot.role, "", [])  # what stands below is no content
    if slot.role in ("a", "m", "c") and KINDS.index(slot.role) < KINDS.index(kind):
        kind = slot.role
    return Verdict(slot.key, slot.role, kind, [judged(k, slot, kind) for k in slot.kids])


def blocks(node: dom.Node, verdict: Verdict) -> Iterator[tuple[str, str]]:
    """(kind, text) of the slots of a page that its wrapper calls content, in page order."""
    groups = dom.runs(node.kids)
    of: dict[int, Verdict | None] = {}
    for x, y in dom.aligned([_Run(g) for g in groups], verdict.kids):
        if x is not None:
            # where a list was folded by kinds, order does not tell: any slot of that kind
            y = y or next((v for v in verdict.kids if v.key == x.key and v.role == x.role), None)
            for k in x.nodes:
                of[id(k)] = y
    for k in node.kids:
        slot = of[id(k)]
        if slot is None or not slot.kind:
            continue
        if not k.key:
            yield slot.kind, k.text
        else:
            yield from blocks(k, slot)


class _Run:
    """A run of nodes as one node, for the alignment."""

    __slots__ = ("key", "role", "nodes")

    def __init__(self, nodes: list[dom.Node]):
        self.key, self.role, self.nodes = nodes[0].key, nodes[0].role, nodes

    @property
    def kids(self) -> list[_Run]:
        return [_Run(g) for g in dom.runs(self.nodes[0].kids)]


def main_text(page: str, verdict: Verdict | None) -> str:
    root = dom.parse(page)
    verdict = verdict or judged(dom.wrapper(root))
    found = list(blocks(root, verdict))
    best = min((KINDS.index(k) for k, _ in found), default=0)
    return "\n".join(t for k, t in found if KINDS.index(k) == best)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Verdict] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows = []
            for page_id, url, page, packed in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns], strict=True):
                verdict = known.get(packed) if packed else None
                if packed and verdict is None:
                    if len(known) >= HOSTS:
                        known.clear()
                    verdict = known[packed] = judged(dom.Slot.unpacked(json.loads(packed)))
                text = main_text(page, verdict)
                rows.append((page_id, url, text, len(text)))
            kinds = (pa.int64(), pa.string(), pa.large_string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """pages (page_id long, url, html) -> page_id, url, text, n_chars (code points). wrappers: what induce gave for these hosts.

    A host with more than 256 pages, and more than one in 2^14 of all, is hot. There are at most 2^14, so their names are
    broadcast; their pages are dealt over parts, and their wrapper is repeated for each.
    """
    wrappers = wrappers if wrappers is not None else induce(pages)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    counts = written(own.groupBy("host").agg(F.count("*").alias("n")), "he-counts")
    most = max(HOT_PAGES, (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_HOSTS)
    hot = F.broadcast(counts.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = own.join(hot, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("int"))
    each = wrappers.join(hot, "host", "left").select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = dealt.join(each, ["host", "part"], "left").select("page_id", "url", "html", "wrapper")
    return met.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
