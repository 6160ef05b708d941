"""Exact Jaccard join of documents' shingle sets, in regions around pivots.

A document's set: its distinct shingles of `words` words, SIZE unless given (A-Z lower-cased); with
fewer words, all of them as one; without words, empty and linked with nothing.
Two documents link when 100 * intersection >= PERCENT * union. A row gets the
smallest id reachable by links.

Unrelated documents are all at distance 1 from one another and from every pivot,
so no pivot tells them apart; first come the regions in which distances say
something. Sets that share too few of their first shingles with any other are
alone (see _ask). Linked sets lack few shingles of one another, so when the
shingles are dealt to more parts than that, one part has the same shingles in
both. What equal parts connect, by steps between sizes that a link can span, is
one region, and no link leaves it (see _signatures). Single shingles would not
do: unrelated texts share some, more of them the larger the table is, until most
sets are one region. Inside of a region pivots make Voronoi cells, farthest first:

* a set within the link distance of a pivot is linked there and then;
* a set goes to its nearest pivot's cell, and by the triangle inequality to each
  cell whose pivot is at most twice the link distance farther: two linked sets
  always meet in the nearer one's cell;
* cells are joined in the same way while that divides them, else compared
  through an inverted index that yields exact intersection sizes.

In each block of texts one of equal sets stands for all of them, and of the
documents that share a shingle one is shipped with it; a group of any size thus
weighs as many rows as there are blocks. A region of more than BOUND rows is
dealt to several tasks (see _split_regions). Sets are of 64-bit hashes.

Repeated rows are links like others; a class is named by the row that comes first
by id (nulls last), then text. Null and empty texts are alone, with n 0. An empty
table gives an empty result; columns other than id and text, whatever their
names, pass through dedup() unchanged. A text's set is held whole by its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm.blocks import POWERS_WORD, Block, text_blocks, word_hashes, words_of
from twinplan.llm.common import FEW, Rolling, first_of_groups, lean, mix, parts, rows_without, where_few, with_rid, written
from twinplan.llm.components import components
from twinplan.llm.repeats import PACKED, by_rid, packed, part_of_rid, ranges, unpacked

SIZE, PERCENT = 4, 85
#: Documents in the sample that tells frequent shingles from rare ones, and how many frequent ones are named.
SAMPLE_DOCS, FREQUENT = 10_000, 300_000
#: A cell of at most so many sets is compared directly; pivots of a larger one.
LEAF, PIVOTS = 64, 12
#: A region of more rows is split over tasks: of a cell, one task indexes about so many sets. Pivots beyond the last are left out.
BOUND, LAST_PIVOT = 1000, 60

SHARED = (("shingle", "u8"), ("root", "i8"), ("least", "u4"), ("most", "u4"))
PLACED = (("rid", "i8"), ("region", "i8"))
#: A shingle by 31 bits, which can only count too many as shared, and in the lowest bit whether it asks; the place of its text in the block.
ASKED = (("shingle", "u4"), ("place", "u2"))
NEEDED = (("head", "i8"), ("place", "u2"), ("rid", "i8"), ("n", "u4"), ("need", "u4"), ("seen", "u4"))
ANSWER = (("head", "i8"), ("place", "u2"), ("seen", "u4"))


def shingle_sets(block: Block, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block, and their bounds."""
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + 32, block.data).astype(np.uint8)
    words = words_of(Block(None, data, block.offsets))
    roll = Rolling(word_hashes(data, words), POWERS_WORD)
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = ranges(words.first[:-1], count)
    doc = np.repeat(np.arange(block.n), count)
    h = roll.of(at, np.minimum(at + size, words.first[doc + 1]))
    order, new, _ = first_of_groups(doc, h)
    pick = order[new]
    return h[pick], np.searchsorted(doc[pick], np.arange(block.n + 1))


class Order:
    """A common order of shingles: by the number of sampled documents that have them, then by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        self.shingles, self.counts = shingles, counts

    def key(self, h: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(h), np.uint64)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
            hit = self.shingles[at] == h
            seen[hit] = self.counts[at[hit]]
        return np.minimum(seen, np.uint64(255)) << np.uint64(56) | mix(h) >> np.uint64(8)


@lean
def _sampled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        h, _ = shingle_sets(block, size)
        value, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])


def common_order(keyed: DataFrame, size: int = SIZE) -> Order:
    """From some SAMPLE_DOCS documents: at most FREQUENT shingles that several of them have."""
    share = min(1.0, SAMPLE_DOCS / max(keyed.count(), 1))
    few = keyed.filter(F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    rows = (
        few.mapInArrow(partial(_sampled, size=size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
        .orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    )
    found = np.array([(r["shingle"], r["n"]) for r in rows], np.int64).reshape(-1, 2)
    shingles = np.ascontiguousarray(found[:, 0]).view(np.uint64)
    order = np.argsort(shingles)
    return Order(shingles[order], found[order, 1].astype(np.uint64))


def _prefixes(h: np.ndarray, first: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set that a linked set must share one of, and their set."""
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((order.key(h), owner))
    length = np.where(size > 0, _may_miss(size, percent) + 1, 0)
    pick = by[ranges(first[:-1], length)]
    return h[pick], owner[pick]


def _may_miss(size: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of this size a linked set may lack."""
    return size - (percent * size + 99) // 100


def _size_classes(percent: int) -> np.ndarray:
    """The least size of each class, from 1 on, up to 2**31: linked sets are of one class or of neighbouring ones."""
    least = [1, 2]
    while least[-1] < 1 << 31:
        least.append(max(least[-1] + 1, 100 * (least[-1] - 1) // percent + 1))
    return np.array(least, np.int64)


def _signatures(h: np.ndarray, first: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of which two linked sets have one in common, and their set.

    Linked sets of at most `most` shingles differ in at most `may` ones, as 100 I >=
    percent (|x| + |y| - I). The shingles that the sample does not show to be
    frequent are dealt to more than `may` parts by hash. A set that fills more
    than `may` parts shares the whole of one with any linked set, and a part of
    several shingles hardly ever equals an unrelated set's. Sets that fill fewer,
    as they are short of rare shingles, have their first shingles as well, of which
    two linked ones share one. Pairs meet in the class of the larger one, so a set
    stands in its own and in the next.
    """
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    rare = order.key(h) >> np.uint64(56) == 0
    token, holder = mix(h[rare] ^ np.uint64(0x2545F4914F6CDD1D)), owner[rare]
    least, values, owners, few = _size_classes(percent), [], [], np.zeros(len(size), bool)
    for step in (0, 1):
        at = np.searchsorted(least, size, "right") + step
        may = 2 * (100 - percent) * (least[at] - 1) // (100 + percent)
        n = np.where(size > 0, may + 1 + may // 8, 0)
        start = np.cumsum(n) - n
        part = start[holder] + ((token >> np.uint64(32)) % n[holder].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(int(n.sum()), np.uint64)
        np.add.at(sums, part, mix(token + np.uint64(0x9E3779B97F4A7C15)))
        full = np.flatnonzero(np.bincount(part, minlength=len(sums)))
        of = np.repeat(np.arange(len(size)), n)[full]
        values.append(mix(sums[full] ^ mix((at[of] << 32 | full - start[of]).astype(np.uint64))))
        owners.append(of)
        few |= np.bincount(of, minlength=len(size)) <= may
    value, of = _prefixes(h, first, order, percent)
    on = few[of]
    return np.concatenate([*values, value[on]]), np.concatenate([*owners, of[on]])


@lean
def _ask(batches: Iterator[pa.RecordBatch], order: Order, percent: int, words: int, n: int) -> Iterator[pa.RecordBatch]:
    """Which of a set's first shingles does another set have?

    Of the first m = may_miss + need shingles of a set, a linked set has `need`
    at least; each stands there no later than at m + what that one may hold
    besides. So sets show as many, and one with fewer shared ones among its
    first m has no link.
    """
    for block in text_blocks(batches):
        rids = np.asarray(block.rows.column("rid"))
        h, first = shingle_sets(block, words)
        size = np.diff(first)
        miss = _may_miss(size, percent)
        looked = lambda size: _may_miss(size, percent) * 3 // 2 + 1
        own, shown = np.minimum(looked(size), size), np.minimum(looked(100 * size // percent) + miss, size)
        owner = np.repeat(np.arange(block.n), size)
        by = np.lexsort((order.key(h), owner))
        place = np.arange(len(h)) - first[owner]
        on = place < shown[owner]
        shingle, owner, asks = h[by[on]], owner[on], (place < own[owner])[on]
        value, at, which, count = np.unique(shingle, return_index=True, return_inverse=True, return_counts=True)
        here = (count > 1)[which] & asks
        seen = np.bincount(owner[here], minlength=block.n)
        head = np.full(block.n, rids[0])
        yield packed(by_rid(head, n), {"head": head, "place": np.arange(block.n), "rid": rids, "n": size, "need": own - miss, "seen": seen}, NEEDED, "needed")
        short = mix(value) >> np.uint64(33) << np.uint64(1) | (asks[at] & (count == 1)).astype(np.uint64)
        rows = packed((value % np.uint64(n)).astype(np.int32), {"shingle": short, "place": owner[at]}, ASKED, "asked")
        named = [rids[:1].tobytes() + d for d in rows.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("kind"), pa.array(named, pa.binary())], ["part", "kind", "data"])


@lean
def _answer(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        held += [d for k, d in zip(kinds, batch.column("data").to_pylist()) if k == "asked"]
        needed = batch.filter(pa.array([k == "needed" for k in kinds], pa.bool_()))
        if needed.num_rows:
            yield needed
    width = sum(np.dtype(t).itemsize for _, t in ASKED)
    heads = np.frombuffer(b"".join([d[:8] for d in held]), np.int64)
    row = np.repeat(np.arange(len(held)), [(len(d) - 8) // width for d in held])
    r = unpacked([d[8:] for d in held], ASKED)
    del held
    _, which, count = np.unique(r["shingle"] >> 1, return_inverse=True, return_counts=True)
    on = (r["shingle"] & 1 == 1) & (count[which] > 1)
    key, seen = np.unique(row[on].astype(np.int64) << 16 | r["place"][on], return_counts=True)
    head = heads[key >> 16]
    yield packed(by_rid(head, n), {"head": head, "place": key & 0xFFFF, "seen": seen}, ANSWER, "answer")


@lean
def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {"needed": [], "answer": []}
    for batch in batches:
        for k, d in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            held[k].append(d)
    needed, answers = unpacked(held["needed"], NEEDED), unpacked(held["answer"], ANSWER)
    heads, block = np.unique(needed["head"], return_inverse=True)
    key = block.astype(np.int64) << 16 | needed["place"]
    order = np.argsort(key)
    asked = np.searchsorted(heads, answers["head"]).astype(np.int64) << 16 | answers["place"]
    seen = needed["seen"][order].astype(np.int64)
    np.add.at(seen, np.searchsorted(key[order], asked), answers["seen"].astype(np.int64))
    size = needed["n"][order].astype(np.int64)
    on = (size > 0) & (seen >= needed["need"][order])
    yield pa.RecordBatch.from_arrays([pa.array(needed["rid"][order]), pa.array(size), pa.array(on)], ["rid", "n", "on"])


def _chains(shingle: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """order, and for its places the number of a chain: records of one shingle whose sizes, least to most, leave no gap that no link spans.

    Linked sets differ in size by PERCENT at most, so they are in one chain.
    """
    order = np.lexsort((least, shingle))
    if not len(order):
        return order, order
    s, lo, hi = shingle[order], least[order].astype(np.int64), most[order].astype(np.int64)
    other = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(other) - 1
    # the largest size so far within each shingle: a running maximum that starts anew, as groups are set apart
    reach = np.maximum.accumulate(group << 33 | hi) & (1 << 33) - 1
    gap = np.r_[True, 100 * reach[:-1] < percent * lo[1:]]
    return order, np.cumsum(other | gap) - 1


def _least_label(group: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For owners connected by common groups: the least owner of each one's component."""
    label = np.arange(n)
    if not len(group):
        return label
    by = np.argsort(group, kind="stable")
    g, o = group[by], owner[by]
    head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[head, len(g)])
    while True:
        least = np.minimum.reduceat(label[o], head)
        new = label.copy()
        np.minimum.at(new, o, np.repeat(least, size))
        new = new[new]
        if (new == label).all():
            return label
        label = new


@lean
def _cover(batches: Iterator[pa.RecordBatch], order: Order, percent: int, words: int, n: int) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        rids = np.asarray(block.rows.column("rid"))
        sets, first = shingle_sets(block, words)
        h, owner = _signatures(sets, first, order, percent)
        size = np.diff(first)[owner]
        rank = np.argsort(rids, kind="stable")
        place = np.empty(block.n, np.int64)
        place[rank] = np.arange(block.n)
        by, chain = _chains(h, size, size, percent)
        label = _least_label(chain, place[owner[by]], block.n)[place]
        root = rids[rank[label]]
        moved = np.flatnonzero(root != rids)
        yield packed(by_rid(rids[moved], n), {"rid": rids[moved], "region": root[moved]}, PLACED, "placed")
        if not len(h):
            continue
        head = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
        last = np.r_[head[1:], len(chain)] - 1
        value = h[by[head]]
        yield packed(
            (value % np.uint64(n)).astype(np.int32),
            {"shingle": value, "root": root[owner[by[head]]], "least": size[by[head]], "most": size[by[last]]}, SHARED, "shared",
        )


@lean
def _meet(batches: Iterator[pa.RecordBatch], percent: int, n: int) -> Iterator[pa.RecordBatch]:
    """What a partition's chains connect, as one star for each of its components: fewer edges than it has roots."""
    held = []
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        held += [d for k, d in zip(kinds, batch.column("data").to_pylist()) if k == "shared"]
        placed = batch.filter(pa.array([k == "placed" for k in kinds], pa.bool_()))
        if placed.num_rows:
            yield placed
    r = unpacked(held, SHARED)
    by, chain = _chains(r["shingle"], r["least"], r["most"], percent)
    root, at = np.unique(r["root"][by], return_inverse=True)
    label = _least_label(chain, at, len(root))
    on = np.flatnonzero(label != np.arange(len(root)))
    if len(on):
        yield packed(by_rid(root[on], n), {"rid": root[on], "region": root[label[on]]}, PLACED, "edge")


@lean
def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a partition, and its edges once each."""
    held: dict[str, list[bytes]] = {"placed": [], "edge": []}
    for batch in batches:
        for k, d in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
            held[k].append(d)
    for kind, rows in held.items():
        r = unpacked(rows, PLACED)
        pairs = np.unique(np.stack([r["rid"], r["region"]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(pairs), pa.string()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["kind", "a", "b"])


@lean
def _sets(batches: Iterator[pa.RecordBatch], words: int, n: int) -> Iterator[pa.RecordBatch]:
    """For texts with a region: of equal sets in a block one as a packed set, the others as members; for the rest, the result."""
    for block in text_blocks(batches):
        h, first = shingle_sets(block, words)
        size = np.diff(first)
        rids, regions = np.asarray(block.rows.column("rid")), np.asarray(block.rows.column("region").fill_null(-1))
        has = np.asarray(block.rows.column("region").is_valid()) & (size > 0)
        sums = np.r_[np.uint64(0), np.cumsum(h)]
        sums2 = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
        one, two = sums[first[1:]] - sums[first[:-1]], sums2[first[1:]] - sums2[first[:-1]]
        at = np.flatnonzero(has)
        order, _, _ = first_of_groups(one[at], two[at], size[at], regions[at], rids[at])
        order = at[order]
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            same[1:] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (one, two, size, regions)])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
        rep = rids.copy()
        rep[order] = rids[order[head]] if len(order) else rep[order]
        kind = np.where(has, "member", "done").astype(object)
        ships = order[~same]
        kind[ships] = "set"
        data = [None] * block.n
        for i in ships.tolist():
            data[i] = h[first[i] : first[i + 1]].tobytes()
        part = by_rid(rids, n)
        part[ships] = by_rid(regions[ships], n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(kind, pa.string()), block.rows.column("region"), block.rows.column("rid"), block.rows.column("id"), pa.array(size.astype(np.int64)), pa.array(rep), pa.array(data, pa.binary())],
            ["part", "kind", "region", "rid", "id", "n", "rep", "data"],
        )


# --- the join in a region ----------------------------------------------------------


class Region:
    """The sets of a region, their inverted index, and the links found so far."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.m = percent, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        _, self.of = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(self.m), self.size)
        by = np.argsort(self.of, kind="stable")
        self.postings = owner[by]
        self.bounds = np.r_[0, np.cumsum(np.bincount(self.of))]
        self.label = np.arange(self.m)

    def common(self, x: int) -> np.ndarray:
        """Intersection sizes of set x with every set of the region."""
        own = self.of[self.first[x] : self.first[x + 1]]
        lo = self.bounds[own]
        return np.bincount(self.postings[ranges(lo, self.bounds[own + 1] - lo)], minlength=self.m)

    def linked(self, x: int, common: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (self.size + self.size[x] - common)

    def link(self, x: int, others: np.ndarray) -> None:
        names = np.unique(self.label[np.r_[x, others]])
        if len(names) > 1:
            self.label[np.isin(self.label, names)] = names[0]

    def compare(self, cell: np.ndarray) -> None:
        """All links with a set of the cell, but between sets that are connected already."""
        names, n = np.unique(self.label[cell], return_counts=True)
        if len(names) < 2:
            return
        largest = names[n.argmax()]
        inside = np.zeros(self.m, bool)
        inside[cell] = True
        for x in cell[self.label[cell] != largest].tolist():
            hits = np.flatnonzero(self.linked(x, self.common(x)) & inside)
            self.link(x, hits)

    def join(self, cell: np.ndarray) -> None:
        if len(cell) <= LEAF:
            return self.compare(cell)
        far = (100 - self.percent) / 100  # the link distance
        frequency = np.diff(self.bounds)
        weight = np.add.reduceat(frequency[self.of], self.first[:-1]) / self.size
        pivot, rows, nearest = int(cell[weight[cell].argmax()]), [], np.full(len(cell), 2.0)
        for _ in range(PIVOTS):
            common = self.common(pivot)
            self.link(pivot, np.flatnonzero(self.linked(pivot, common)))
            distance = 1 - common[cell] / (self.size[cell] + self.size[pivot] - common[cell])
            rows.append(distance)
            nearest = np.minimum(nearest, distance)
            if nearest.max() <= 2 * far:
                break
            pivot = int(cell[nearest.argmax()])
        table = np.stack(rows)
        member = table <= nearest + 2 * far + 1e-9
        counts = member.sum(1)
        if counts.sum() > 2 * len(cell) or counts.max() > 0.8 * len(cell):
            return self.compare(cell)
        for k in range(len(rows)):
            self.join(cell[member[k]])


@lean
def _join_regions(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[tuple]] = {}

    def solved(region: int) -> pa.RecordBatch:
        rows = sorted(found.pop(region), key=lambda r: r[0])
        sets: dict[bytes, int] = {}
        which = [sets.setdefault(r[3], len(sets)) for r in rows]
        index = Region([np.frombuffer(s, np.uint64) for s in sets], percent)
        index.join(np.arange(index.m))
        # rows come by rid, so the first row of a label has its least rid
        least: dict[int, tuple] = {}
        label = index.label.tolist()
        best = [least.setdefault(label[w], r) for w, r in zip(which, rows)]
        return pa.RecordBatch.from_arrays(
            [pa.array(["set"] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([b[1] for b in best], pa.int64()), pa.array([b[0] for b in best], pa.int64())],
            ["kind", "rid", "id", "n", "rep", "component", "first"],
        )

    last = None
    for batch in batches:
        is_set = pa.array([k == "set" for k in batch.column("kind").to_pylist()], pa.bool_())
        settled = batch.filter(pc.invert(is_set))
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays([settled.column(c) for c in ("kind", "rid", "id", "n", "rep", "id", "rid")], ["kind", "rid", "id", "n", "rep", "component", "first"])
        batch = batch.filter(is_set)
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for region, *row in zip(*[part.column(c).to_pylist() for c in ("region", "rid", "id", "n", "data")]):
                if last is not None and region != last:
                    yield solved(last)
                found.setdefault(region, []).append(tuple(row))
                last = region
    if last is not None:
        yield solved(last)


# --- regions over several tasks ------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows sorted by keys: each key with its rows, which are read as they are used."""
    rows = (
        row for batch in batches for at in range(0, batch.num_rows, 200)
        for row in zip(*[batch.slice(at, 200).column(c).to_pylist() for c in [*keys, *columns]])
    )
    for key, group in groupby(rows, lambda r: r[: len(keys)]):
        yield key, (r[len(keys) :] for r in group)


@lean
def _place(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links among a share of a region's sets and its pivots, and of each set its cell and, as bits, the cells it is routed to."""
    for (region, _), group in _groups(batches, ["region", "salt"], ["is_set", "rid", "data"]):
        rows = sorted(group)
        pivots = sum(not r[0] for r in rows)
        rids = np.array([r[1] for r in rows], np.int64)
        index = Region([np.frombuffer(r[2], np.uint64) for r in rows], percent)
        index.join(np.arange(index.m))
        least = np.full(index.m, np.iinfo(np.int64).max)
        np.minimum.at(least, index.label, rids)
        cell, to = np.zeros(index.m, np.int64), np.ones(index.m, np.int64)
        if used := min(pivots, LAST_PIVOT):
            common = np.stack([index.common(x) for x in range(used)])
            distance = 1 - common / (index.size + index.size[:used, None] - common)
            cell = distance.argmin(0)
            window = distance <= distance.min(0) + 2 * (100 - percent) / 100 + 1e-9
            to = (window << np.arange(used)[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([region] * index.m, pa.int64()), pa.array(rids), pa.array([r[0] for r in rows], pa.bool_()), pa.array(least[index.label]), pa.array(cell), pa.array(to)],
            ["region", "rid", "is_set", "least", "cell", "to"],
        )


@lean
def _compare_strays(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of strays with the sets of a part of a cell, as pairs of labels. The strays follow the sets and are held one at a time."""
    for _, group in _groups(batches, ["region", "cell", "salt", "is_stray"], ["label", "data"]):
        if not _[-1]:
            held = [(label, np.frombuffer(data, np.uint64)) for label, data in group]
            key, labels = _[:-1], np.array([label for label, _ in held])
            values, of = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
            size = np.array([len(x) for _, x in held])
            postings = np.repeat(np.arange(len(held)), size)[np.argsort(of, kind="stable")]
            bounds = np.r_[0, np.cumsum(np.bincount(of))]
            continue
        if _[:-1] != key:
            continue  # no set has this part of the cell
        found: set[tuple[int, int]] = set()
        for label, data in group:
            x = np.frombuffer(data, np.uint64)
            at = np.minimum(np.searchsorted(values, x), len(values) - 1)
            at = at[values[at] == x]
            common = np.bincount(postings[ranges(bounds[at], bounds[at + 1] - bounds[at])], minlength=len(size))
            hits = (100 * common >= percent * (size + len(x) - common)) & (labels != label)
            found.update((label, other) for other in np.unique(labels[hits]).tolist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found))], ["a", "b"])


def _split_regions(sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The rows of _join_regions for sets of regions of m rows, more than one task shall hold.

    1. A region's sets are dealt to tasks, and its pivots, a sample, are sent to each. Links found there make labels.
    2. A link not found yet has a stray at one end: a set whose label is not the region's most frequent.
    3. Each set goes to its nearest pivot's cell, a cell to several tasks where it is large. Strays go to all tasks of
       each cell whose pivot is at most twice the link distance farther than their nearest, so they meet all their links.
    """
    share = F.col("m") / F.lit(BOUND)
    dealt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    pivots = sets.filter(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("m"))
    shares = sets.select("region", F.pmod(F.xxhash64("rid", F.lit(6)), F.ceil(share)).alias("salt"), F.lit(True).alias("is_set"), "rid", "data").unionByName(
        pivots.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(share) - 1)).alias("salt"), F.lit(False).alias("is_set"), "rid", "data")
    )
    placed = written(
        shares.repartitionById(n, dealt("region", "salt")).sortWithinPartitions("region", "salt")
        .mapInArrow(partial(_place, percent=percent), "region long, rid long, is_set boolean, least long, cell long, to long"),
        "placed",
    )
    edges = placed.select(F.col("rid").alias("a"), F.col("least").alias("b"))
    labels = components(edges)
    named = written(
        placed.filter("is_set").join(labels, F.col("rid") == F.col("node"), "left").select("region", "rid", "cell", "to", F.coalesce("component", "rid").alias("label")), "labels"
    )
    most = named.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("region").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
    cells = named.groupBy("region", "cell").agg(F.ceil(F.count(F.lit(1)) / BOUND).alias("tasks")).groupBy("region").agg(F.collect_list(F.struct("cell", "tasks")).alias("cells"))
    # a row for each large region, of at most LAST_PIVOT cells: so few that a region's rows need not meet in one task
    plans = written(most.filter("labels > 1").join(cells, "region"), "plans")
    known = named.join(where_few(plans, FEW // LAST_PIVOT), "region").join(sets.select("rid", "data"), "rid")
    own = F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]["tasks"]
    homes = known.select("region", "cell", F.pmod(F.xxhash64("rid", F.lit(7)), own).alias("salt"), F.lit(False).alias("is_stray"), "label", "data")
    strays = known.filter("label != most.label").select(
        "region", "label", "data", F.explode(F.filter("cells", lambda c: F.call_function("shiftright", F.col("to"), c["cell"].cast("int")).bitwiseAND(F.lit(1)) == 1)).alias("c")
    )
    strays = strays.select("region", "c.cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.tasks") - 1)).alias("salt"), F.lit(True).alias("is_stray"), "label", "data")
    met = homes.unionByName(strays).repartitionById(n, dealt("region", "cell", "salt")).sortWithinPartitions("region", "cell", "salt", "is_stray")
    more = written(met.mapInArrow(partial(_compare_strays, percent=percent), "a long, b long"), "stray_links")
    first = components(edges.unionByName(more))
    solved = sets.join(first, F.col("rid") == F.col("node"), "left").select("rid", "id", "n", F.coalesce("component", "rid").alias("first"))
    ids = sets.select(F.col("rid").alias("first"), F.col("id").alias("component"))
    return solved.join(ids, "first").select(F.lit("set").alias("kind"), "rid", "id", "n", F.col("rid").alias("rep"), "component", "first")


def classes(keyed: DataFrame, percent: int = PERCENT, words: int = SIZE) -> DataFrame:
    """For each row of with_rid(): rid, id, n (size of its set), component and first (id and rid of the first row it is connected with).

    Only first names a class: ids may repeat or be null, and are not to be compared with rids.
    """
    spark = keyed.sparkSession
    keyed = keyed.select("rid", "id", "text")
    n = parts(spark, keyed)
    order = common_order(keyed, words)
    asked = keyed.select("rid", "text").mapInArrow(partial(_ask, order=order, percent=percent, words=words, n=n), PACKED).repartitionById(n, F.col("part"))
    answered = asked.mapInArrow(partial(_answer, n=n), PACKED).repartitionById(n, F.col("part"))
    decided = written(answered.mapInArrow(_decide, "rid long, n long, on boolean"), "decided")
    alone = decided.filter("not on").join(keyed.select("rid", "id"), "rid").select("rid", "id", "n", F.col("id").alias("component"), F.col("rid").alias("first"))
    rest = written(keyed.join(where_few(decided.filter("on").select("rid")), "rid", "left_semi"), "rest")
    return alone.unionByName(_classes(rest, order, percent, words, n))


def _classes(keyed: DataFrame, order: Order, percent: int, words: int, n: int) -> DataFrame:
    cover = keyed.select("rid", "text").mapInArrow(partial(_cover, order=order, percent=percent, words=words, n=n), PACKED)
    met = cover.repartitionById(n, F.col("part")).mapInArrow(partial(_meet, percent=percent, n=n), PACKED).repartitionById(n, F.col("part"))
    met = written(met.mapInArrow(_plain, "kind string, a long, b long"), "cover")
    placed = met.filter("kind = 'placed'").select(F.col("a").alias("rid"), F.col("b").alias("root"))
    between = components(met.filter("kind = 'edge'").select("a", "b"))
    # every row of a region: its root's component, or its root, or itself
    inner = placed.join(between.withColumnRenamed("node", "root"), "root", "left").select("rid", F.coalesce("component", "root").alias("region"))
    roots = between.select(F.col("node").alias("rid"), F.col("component").alias("region"))
    every = inner.unionByName(roots)
    heads = every.select(F.col("region").alias("rid"), "region").distinct()
    regions = written(every.unionByName(heads), "regions")
    texts = keyed.join(where_few(regions, FEW // 2), "rid", "left")
    layout = "part int, kind string, region long, rid long, id long, n long, rep long, data binary"
    sets = texts.select("rid", "id", "text", "region").mapInArrow(partial(_sets, words=words, n=n), layout)
    large = written(regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BOUND), "large")
    split = None
    if large.take(1):
        sets = written(sets, "sets")
        split = sets.filter("kind = 'set'").join(where_few(large), "region").select("region", "m", "rid", "id", "n", "data")
        sets = sets.join(where_few(large).select("region", F.lit(True).alias("large")), "region", "left").filter("kind != 'set' or large is null").drop("large")
    joined = written(
        sets.repartitionById(n, F.col("part")).sortWithinPartitions("kind", "region")
        .mapInArrow(partial(_join_regions, percent=percent), "kind string, rid long, id long, n long, rep long, component long, first long"),
        "joined",
    )
    if split is not None:
        joined = joined.unionByName(_split_regions(split, percent, n))
    members, rest = joined.filter("kind = 'member'").drop("component", "first"), joined.filter("kind != 'member'")
    found = rest.filter("kind = 'set'").select("rep", "component", "first")
    return rest.select("rid", "id", "n", "component", "first").unionByName(members.join(found, "rep").select("rid", "id", "n", "component", "first"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = SIZE) -> DataFrame:
    """The first row of each class by rid (id, nulls last, then text), all columns."""
    keyed = with_rid(docs, id_col, text_col, rows=True)
    return rows_without(keyed, classes(keyed, percent, words).filter("rid != first"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(with_rid(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words
  FROM documents
), w AS (
  SELECT doc_id, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS word FROM t
), windows AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM w
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM windows WHERE i + 4 <= n OR (n < 4 AND i = 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
