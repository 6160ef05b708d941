"""Long repeats across a corpus: what the suffix and the recompression operator share.

A window is W consecutive units (bytes or words) of one document. Both operators
pick an anchor inside each window by the window's content alone, so equal windows
have equal anchors at equal places. Neighbouring windows with one anchor form a
run; its context is the text from its first window's start to its last one's end.

1. On the map side every block of texts is cut into runs. Of equal contexts in a
   block only the earliest is shipped, the others are settled at once: a context
   that a third of the corpus holds is shipped once a block.
2. Contexts meet by their anchor in buckets. Equal contexts settle all windows of
   the later ones. Where an anchor has several contexts, the earliest of each goes on.
   Anchors that a sample shows to be hot are dealt by anchor and context before the
   exchange, and the earliest of each of their contexts goes on.
3. Those few go back to their texts, their windows are compared one by one.
4. What was found is cut out of the texts; where the others pass through unchanged, only the texts named are shuffled for it.

Records travel as packed columns, so Spark moves few large rows. Each job's
result is a table in the shared folder; each task depends on its input alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinplan.llm.blocks import Block, text_blocks
from twinplan.llm.common import FEW, first_of_groups, lean, merge_spans, parts, where_few, written

#: Contexts of one anchor from which on its windows are compared as suffixes of their own.
HOT = 2000
#: Documents that the splitters are sampled from, at least (and a quarter of the partitions), and anchors of each.
SAMPLE_DOCS, SAMPLE_ANCHORS = 1000, 64
#: A seed of more records than one task shall hold, as LEAST sampled anchors or more tell, is dealt by its contexts.
HELD, LEAST = 500_000, 8

RUN = (("seed", "u8"), ("ctx", "u8"), ("rid", "i8"), ("start", "u4"), ("n", "u2"), ("at", "u2"))
SPAN = (("rid", "i8"), ("start", "u4"), ("end", "u4"))
PARTIAL = (("rid", "i8"), ("seed", "u8"), ("start", "u4"), ("n", "u2"), ("at", "u2"), ("hot", "u1"))


@dataclass
class Piece:
    """Texts, or a stretch of one long text: bytes, bounds, the rows they come from, and units before the stretch."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    base: int


def packed(part: np.ndarray, columns: dict[str, np.ndarray], layout, kind: str) -> pa.RecordBatch:
    """A row for each part that has records: part, kind, and the records' columns one after the other."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True]) if len(order) else np.zeros(1, np.int64)
    sorted_columns = [columns[name][order].astype(t) for name, t in layout]
    rows = [b"".join([c[a:b].tobytes() for c in sorted_columns]) for a, b in zip(cut, cut[1:])]
    ids = [int(part[order[a]]) for a in cut[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.string()), pa.array(rows, pa.binary())], ["part", "kind", "data"])


def unpacked(rows: list[bytes], layout) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in layout)
    found: dict[str, list[np.ndarray]] = {name: [np.zeros(0, t)] for name, t in layout}
    for row in rows:
        n, at = len(row) // width, 0
        for name, t in layout:
            size = np.dtype(t).itemsize * n
            found[name].append(np.frombuffer(row, t, n, at))
            at += size
    return {name: np.concatenate(x) for name, x in found.items()}


PACKED = "part int, kind string, data binary"


def settle(keys: tuple[np.ndarray, ...], rid: np.ndarray, start: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, and for its places: the group's number and whether the record is a later one of its group.

    own: an earlier start in the same document counts; else only another document of smaller rid does.
    """
    order, new, group = first_of_groups(*keys, rid, start)
    if not len(order):
        return order, group, np.zeros(0, bool)
    new = np.r_[True, np.zeros(len(order) - 1, bool)]
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    later = ~new if own else rid[order] != rid[order[new]][group]
    return order, group, later


def by_rid(rid: np.ndarray, n: int) -> np.ndarray:
    return np.mod(rid ^ (rid >> 3) ^ (rid >> 7) ^ (rid >> 15) ^ (rid >> 31), n).astype(np.int32)


def part_of_rid(n: int) -> Column:
    """by_rid() as a column."""
    c = F.col("rid")
    for k in (3, 7, 15, 31):
        c = c.bitwiseXOR(F.shiftright("rid", k))
    return F.pmod(c, F.lit(n)).cast("int")


def spans_batch(rid: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.RecordBatch:
    return packed(by_rid(rid, n), {"rid": rid, "start": start, "end": end}, SPAN, "span")


class Router:
    """Ranges of leading tokens, cut at sampled splitters. Where splitters repeat, the ranges between them share their token by seed.

    Hot seeds are those that the sample shows to have more records than a task
    shall hold. Their records are dealt over all partitions by their context, so
    equal contexts meet and no task holds all contexts of such a seed; the windows
    of those that stay are then compared one by one, which for fewer would cost
    more than it saves.
    """

    def __init__(self, cuts: np.ndarray, hot: np.ndarray = np.zeros(0, np.uint64)):
        self.cuts, self.hot = cuts, hot

    def part(self, lead: np.ndarray, seed: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.cuts, lead, "left"), np.searchsorted(self.cuts, lead, "right")
        return (lo + (seed % (hi - lo + 1).astype(np.uint64)).astype(np.int64)).astype(np.int32)

    def is_hot(self, seed: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(seed), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, seed), len(self.hot) - 1)] == seed

    def part_of_context(self, lead: np.ndarray, seed: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
        return np.where(self.is_hot(seed), (context % np.uint64(n)).astype(np.int32), self.part(lead, seed))


@lean
def _leads(batches: Iterator[pa.RecordBatch], unit) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        for piece in unit.pieces(block):
            r = unit.runs(piece)
            order = np.lexsort((r["seed"], r["doc"]))
            doc = r["doc"][order]
            head = np.flatnonzero(np.r_[True, np.diff(doc) > 0]) if len(doc) else np.zeros(0, np.int64)
            nth = np.arange(len(doc)) - np.repeat(head, np.diff(np.r_[head, len(doc)]))
            pick = order[nth < SAMPLE_ANCHORS]
            yield pa.RecordBatch.from_arrays([pa.array(r[c][pick].view(np.int64)) for c in ("lead", "seed")], ["lead", "seed"])


def router(keyed: DataFrame, unit, n: int) -> Router:
    """Splitters and hot seeds from a sample that grows with the partitions alone: SAMPLE_ANCHORS leading tokens of each of its documents."""
    total = keyed.count()
    share = min(1.0, max(SAMPLE_DOCS, n // 4) / max(total, 1))
    few = keyed.filter(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = few.mapInArrow(partial(_leads, unit=unit), "lead long, seed long").toArrow()
    leads, seeds = (np.sort(np.asarray(found.column(c)).view(np.uint64)) for c in ("lead", "seed"))
    if not len(leads):
        return Router(np.zeros(0, np.uint64))
    seed, count = np.unique(seeds, return_counts=True)
    return Router(leads[(np.arange(1, n) * len(leads)) // n], seed[(count >= LEAST) & (count / share > HELD)])


@lean
def _ship(batches: Iterator[pa.RecordBatch], unit, route: Router, n: int) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        rids = np.asarray(block.rows.column("rid"))
        for piece in unit.pieces(block):
            r = unit.runs(piece)
            rid, start = rids[r["doc"]], r["start"]
            order, _, later = settle((r["seed"], r["ctx"]), rid, start, unit.own)
            gone, stay = order[later], order[~later]
            yield spans_batch(rid[gone], start[gone], start[gone] + r["n"][gone] - 1 + unit.W, n)
            columns = {k: r[k][stay] for k in ("seed", "ctx", "start", "n", "at")} | {"rid": rid[stay]}
            yield packed(route.part_of_context(r["lead"][stay], r["seed"][stay], r["ctx"][stay], n), columns, RUN, "run")


@lean
def _meet(batches: Iterator[pa.RecordBatch], unit, route: Router, n: int) -> Iterator[pa.RecordBatch]:
    runs: list[bytes] = []
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        runs += [d for k, d in zip(kinds, batch.column("data").to_pylist()) if k == "run"]
        spans = batch.filter(pa.array([k == "span" for k in kinds], pa.bool_()))
        if spans.num_rows:
            yield spans
    if not runs:
        return
    r = unpacked(runs, RUN)
    del runs
    order, group, later = settle((r["seed"], r["ctx"]), r["rid"], r["start"], unit.own)
    gone = order[later]
    start = r["start"][gone].astype(np.int64)
    yield spans_batch(r["rid"][gone], start, start + r["n"][gone] - 1 + unit.W, n)
    # contexts of each anchor
    stay, group = order[~later], group[~later]
    seed = r["seed"][stay]
    edge = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1], True])
    contexts = group[edge[1:] - 1] - group[edge[:-1]] + 1
    many = np.repeat(contexts, np.diff(edge))
    spread = route.is_hot(seed)  # its other contexts are in other tasks
    on = (many > 1) | spread
    pick = stay[on]
    columns = {k: r[k][pick] for k in ("rid", "seed", "start", "n", "at")} | {"hot": ((many > HOT) | spread)[on].astype(np.uint8)}
    yield packed(by_rid(r["rid"][pick], n), columns, PARTIAL, "partial")


def _with_texts(keyed: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """Records first, then the texts of the same part: one shuffle, no join."""
    texts = keyed.select(part_of_rid(n).alias("part"), F.lit("text").alias("kind"), F.lit(None).cast("binary").alias("data"), "rid", "id", "text")
    no = {"rid": "long", "id": "long", "text": "string"}
    records = records.select("part", "kind", "data", *[F.lit(None).cast(t).alias(c) for c, t in no.items()])
    return records.unionByName(texts).repartitionById(n, F.col("part")).sortWithinPartitions("kind")


def _records_then_blocks(batches: Iterator[pa.RecordBatch], layout) -> Iterator[tuple[Block, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Each block of texts with the records sorted by rid, and where those of each text begin and end."""
    held: list[bytes] = []
    records = None
    for batch in batches:
        is_text = np.array([k == "text" for k in batch.column("kind").to_pylist()], bool)
        held += [d for d, t in zip(batch.column("data").to_pylist(), is_text) if not t]
        if not is_text.any():
            continue
        if records is None:
            records = unpacked(held, layout)
            held.clear()
            order = np.lexsort((records["start"], records["rid"]))
            records = {k: v[order] for k, v in records.items()}
        for block in text_blocks(iter([batch.filter(pa.array(is_text))])):
            rids = np.asarray(block.rows.column("rid"))
            yield block, records, np.searchsorted(records["rid"], rids, "left"), np.searchsorted(records["rid"], rids, "right")


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (size[0] of them), lo[1], ..."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before, size) + np.repeat(lo, size)


@lean
def _reopen(batches: Iterator[pa.RecordBatch], unit, route: Router, n: int) -> Iterator[pa.RecordBatch]:
    for block, records, lo, hi in _records_then_blocks(batches, PARTIAL):
        pick = ranges(lo, hi - lo)
        if len(pick):
            yield from unit.reopen(block, np.repeat(np.arange(block.n), hi - lo), {k: v[pick] for k, v in records.items()}, route, n)


@lean
def _compare(batches: Iterator[pa.RecordBatch], unit, n: int) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        held += [d for k, d in zip(kinds, batch.column("data").to_pylist()) if k == "window"]
        spans = batch.filter(pa.array([k == "span" for k in kinds], pa.bool_()))
        if spans.num_rows:
            yield spans
    if held:
        yield unit.compare(held, n)


@lean
def _cut(batches: Iterator[pa.RecordBatch], unit, how: str) -> Iterator[pa.RecordBatch]:
    for block, records, lo, hi in _records_then_blocks(batches, SPAN):
        spans = []
        for a, b in zip(lo, hi):
            spans.append(merge_spans(records["start"][a:b].astype(np.int64), records["end"][a:b].astype(np.int64)))
        yield unit.cut(block, spans, how)


@lean
def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that spans name, once a task."""
    found = np.zeros(0, np.int64)
    for batch in batches:
        found = np.unique(np.r_[found, unpacked(batch.column("data").to_pylist(), SPAN)["rid"]])
    yield pa.RecordBatch.from_arrays([pa.array(found)], ["rid"])


def _spans(keyed: DataFrame, unit, n: int) -> DataFrame:
    """What is to be removed, packed by part_of_rid()."""
    route = router(keyed, unit, n)
    to_parts = lambda df: df.repartitionById(n, F.col("part"))
    shipped = keyed.select("rid", "text").mapInArrow(partial(_ship, unit=unit, route=route, n=n), PACKED)
    met = written(to_parts(shipped).mapInArrow(partial(_meet, unit=unit, route=route, n=n), PACKED), "met")
    opened = _with_texts(keyed, met.filter("kind = 'partial'"), n).mapInArrow(partial(_reopen, unit=unit, route=route, n=n), PACKED)
    compared = written(to_parts(opened).mapInArrow(partial(_compare, unit=unit, n=n), PACKED), "compared")
    return met.filter("kind = 'span'").unionByName(compared)


def remove_repeats(keyed: DataFrame, unit, how: str, schema: str) -> DataFrame:
    """For each row of with_rid(): what unit.cut() returns of its text and the spans to remove."""
    keyed = keyed.select("rid", "id", "text")
    n = parts(keyed.sparkSession, keyed)
    return _with_texts(keyed, _spans(keyed, unit, n), n).mapInArrow(partial(_cut, unit=unit, how=how), schema)


def cut_rows(keyed: DataFrame, unit) -> DataFrame:
    """rid, row and kept (the text without its repeats, null where it has none) for each row of with_rid(rows=True).

    Most texts have no repeat. The numbers of those that have one go to the rows, so
    that the others are not shuffled; only where they are more than FEW all rows are.
    """
    texts = keyed.select("rid", "id", "text")
    n = parts(keyed.sparkSession, texts)
    spans = _spans(texts, unit, n)
    named = written(spans.select("data").mapInArrow(_named, "rid long").distinct(), "named")
    some, rest = keyed, None
    if named.count() <= FEW:
        some, rest = (keyed.join(where_few(named), "rid", how) for how in ("left_semi", "left_anti"))
    new = _with_texts(some, spans, n).mapInArrow(partial(_cut, unit=unit, how="text"), "rid long, text string").select("rid", F.col("text").alias("kept"))
    out = some.select("rid", "row").join(new, "rid", "left")
    return out if rest is None else out.unionByName(rest.select("rid", "row", F.lit(None).cast("string").alias("kept")))
