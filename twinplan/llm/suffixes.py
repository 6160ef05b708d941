"""Repeated byte strings by a sparse suffix array, range-partitioned.

Each byte that a W-byte string covers which also starts earlier (smaller id, or
same text and earlier start) is removed; strings are judged on the input. Texts
are their UTF-8 bytes; null reads as empty; matches never cross texts.

Suffixes are taken at anchors: in each window the K-byte seed with the least
hash, the leftmost of equals. Every window has one, so no repeat is missed, and
only some 2 / (W - K + 2) of all suffixes are sorted. Sampled splitters deal
them into buckets by their leading bytes; ties of a splitter are dealt on by
seed, so equal suffixes always share a bucket and no repeat straddles two: at a
boundary only the two buckets' leading tokens have to be compared, which the
splitters have done. In a bucket contexts are matched by hash: a sort of the
64-bit seed and context hashes puts equal ones side by side, and most repeats are
settled so, without a suffix being sorted by its bytes. Only windows of seeds with
several contexts are compared by a multikey quicksort of their 8-byte tokens,
which looks at a next token only where all before it are equal.
A seed that the sample shows to be hot is dealt by its contexts before the
exchange, and a seed with very many contexts is not kept together: each of its
windows is dealt as a suffix of its own, once a block.

Equal contexts are told by 128 bits (seed and context hash), single windows by
their bytes. Ids that repeat or are null are ordered as with_rid() says, so of
repeated rows the first keeps its text. An empty table gives an empty result. A
text of any length is worked on in stretches that overlap by a window. Columns
other than id and text, whatever their names, pass through strip() unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm.blocks import Block, byte_hashes, byte_hashes_2
from twinplan.llm.common import merge_spans, with_rid
from twinplan.llm.repeats import Piece, Router, cut_rows, packed, ranges, remove_repeats, settle, spans_batch

#: Bytes of a long text that are worked on at once.
STRETCH = 1 << 20
#: Bits of a key for the place in the block: more than a stretch has bytes.
BITS = 24


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do; bytes past the end count as 0."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[at + k]
    return out


@dataclass(frozen=True)
class Bytes:
    W: int = 100
    K: int = 32
    own: bool = True

    def pieces(self, block: Block) -> Iterator[Piece]:
        if block.n == 1 and len(block.data) > STRETCH:
            for base in range(0, len(block.data) - self.W + 1, STRETCH):
                data = block.data[base : base + STRETCH + self.W - 1]
                yield Piece(data, np.array([0, len(data)]), np.zeros(1, np.int64), base)
        else:
            yield Piece(block.data, block.offsets, np.arange(block.n), 0)

    def runs(self, piece: Piece) -> dict[str, np.ndarray]:
        data, offsets, W, K = piece.data, piece.offsets, self.W, self.K
        none = {k: np.zeros(0, t) for k, t in (("seed", "u8"), ("ctx", "u8"), ("lead", "u8"), ("doc", "i8"), ("start", "i8"), ("n", "i8"), ("at", "i8"))}
        total = len(data) - W + 1
        if total <= 0:
            return none
        roll = byte_hashes(data)
        places = np.arange(len(data) - K + 1)
        seeds = roll.of(places, places + K)
        bits = np.uint64(BITS)  # as many in every block, so that all blocks rank alike
        key = (seeds >> bits) << bits | places.astype(np.uint64)
        least = sliding_min(key, W - K + 1)[:total]
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = np.zeros(total, bool)
        size = np.diff(offsets)
        full = size >= W
        valid[ranges(offsets[:-1][full], size[full] - W + 1)] = True
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return none
        # a run ends where the next begins or the windows of its text do
        doc = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(np.r_[first[1:], total], offsets[doc + 1] - W + 1) - 1
        a = anchor[first]
        return {
            "seed": seeds[a], "ctx": byte_hashes_2(data).of(first, last + W), "lead": leading(data, a), "doc": piece.row[doc],
            "start": first - offsets[doc] + piece.base, "n": last - first + 1, "at": a - first,
        }

    def reopen(self, block: Block, doc: np.ndarray, r: dict[str, np.ndarray], route: Router, n: int) -> Iterator[pa.RecordBatch]:
        at = block.offsets[doc] + r["start"]
        size = r["n"].astype(np.int64)
        cold = r["hot"] == 0
        yield self._ship(block, at[cold], size[cold], r["rid"][cold], r["start"][cold], route.part(leading(block.data, at[cold] + r["at"][cold]), r["seed"][cold]))
        hot = np.flatnonzero(~cold)
        if len(hot):
            at, rid, start = ranges(at[hot], size[hot]), np.repeat(r["rid"][hot], size[hot]), ranges(r["start"][hot].astype(np.int64), size[hot])
            one, two = byte_hashes(block.data).of(at, at + self.W), byte_hashes_2(block.data).of(at, at + self.W)
            order, _, later = settle((one, two), rid, start, self.own)
            gone, stay = order[later], order[~later]
            yield spans_batch(rid[gone], start[gone], start[gone] + self.W, n)
            yield self._ship(block, at[stay], np.ones(len(stay), np.int64), rid[stay], start[stay], route.part(leading(block.data, at[stay]), one[stay]))

    def _ship(self, block: Block, at, size, rid, start, part) -> pa.RecordBatch:
        """Contexts with their bytes: in each row the records' columns, then their bytes, and at its end the number of records."""
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True]) if len(order) else np.zeros(1, np.int64)
        rows, ids = [], []
        for a, b in zip(cut, cut[1:]):
            o = order[a:b]
            text = block.data[ranges(at[o], size[o] + self.W - 1)]
            rows.append(rid[o].astype("i8").tobytes() + start[o].astype("u4").tobytes() + size[o].astype("u2").tobytes() + text.tobytes() + len(o).to_bytes(8, "little"))
            ids.append(int(part[o[0]]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(["window"] * len(ids), pa.string()), pa.array(rows, pa.binary())], ["part", "kind", "data"])

    def compare(self, held: list[bytes], n: int) -> pa.RecordBatch:
        rid, start, size, texts = [], [], [], []
        for row in held:
            m = int.from_bytes(row[-8:], "little")
            rid.append(np.frombuffer(row, "i8", m))
            start.append(np.frombuffer(row, "u4", m, 8 * m).astype(np.int64))
            size.append(np.frombuffer(row, "u2", m, 12 * m).astype(np.int64))
            texts.append(np.frombuffer(row, np.uint8, len(row) - 8 - 14 * m, 14 * m))
        rid, start, size, data = (np.concatenate(x) for x in (rid, start, size, texts))
        first = np.cumsum(size + self.W - 1) - (size + self.W - 1)
        at = ranges(first, size)
        rid, start = np.repeat(rid, size), ranges(start, size)
        group, some = multikey_groups(data, at, self.W)
        order, _, later = settle((group.astype(np.uint64),), rid[some], start[some], self.own)
        gone = some[order[later]]
        return spans_batch(rid[gone], start[gone], start[gone] + self.W, n)

    def cut(self, block: Block, spans: list[tuple[np.ndarray, np.ndarray]], how: str) -> pa.RecordBatch:
        rows, rids, ids = [], [], block.rows.column("id")
        for i, (s, e) in enumerate(spans):
            text = block.data[block.offsets[i] : block.offsets[i + 1]]
            if how == "text":
                if len(s):
                    rids.append(int(block.rows.column("rid")[i].as_py()))
                    rows.append(_without_whole(text, s, e))
            elif len(s):
                left = _without(text, s, e)
                rows.append((len(text), int((e - s).sum()), len(s), hashlib.sha256(left).hexdigest()))
            else:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
        if how == "text":
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(rows, pa.string())], ["rid", "text"])
        sizes, removed, n, digest = zip(*rows)
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, long), pa.array(removed, long), pa.array(n, long), pa.array(digest)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _without(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    data, at, out = text.tobytes(), 0, []
    for a, b in zip(s.tolist(), e.tolist()):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _without_whole(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> str:
    """The text without the characters that lie whole in the spans."""
    if len(s):
        heads = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)]
        s, e = heads[np.searchsorted(heads, s, "left")], heads[np.searchsorted(heads, e, "right") - 1]
        ok = s < e
        return _without(text, s[ok], e[ok]).decode("utf-8")
    return text.tobytes().decode("utf-8")


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive keys; past the end as if the largest number followed."""
    n = len(key)
    rows = -(-(n + w) // w)
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    table = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def multikey_groups(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of `width` bytes at the given places: which have an equal, and the number of their group.

    A multikey quicksort, level by level: strings equal so far are parted by
    their next 8 bytes; those alone in their part leave.
    """
    some = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    for depth in range(0, width, 8):
        token = np.zeros(len(some), np.uint64)
        for k in range(depth, min(depth + 8, width)):
            token = token << np.uint64(8) | padded[at[some] + k]
        order = np.lexsort((token, group))
        t, g = token[order], group[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])][: len(order)]
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1 if len(order) else np.zeros(0, bool)
        some, group = some[order[several]], number[several]
    return group, some


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Bytes = Bytes()) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of what is kept, for each row of docs."""
    return remove_repeats(with_rid(docs, id_col, text_col), unit, "digest", "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Bytes = Bytes()) -> DataFrame:
    """docs with the repeats cut out of the text; a character goes if all its bytes do. A null text stays null."""
    return cut_rows(with_rid(docs, id_col, text_col, rows=True), unit).select(
        *[(F.coalesce("kept", F.col("row")[c].cast("string")) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
), b AS (
  SELECT doc_id, unnest(range(octet_length(data))) AS i, data, octet_length(data) AS n FROM t
), windows AS (
  SELECT doc_id, i, CASE WHEN i + 100 <= n THEN md5_number(hex(array_slice(data, i + 1, i + 100))) END AS k, hex(array_slice(data, i + 1, i + 1)) AS byte FROM b
), firsts AS (
  SELECT k, min(struct_pack(d := doc_id, i := i)) AS place FROM windows WHERE k IS NOT NULL GROUP BY k
), starts AS (
  SELECT v.doc_id, v.i, v.byte, coalesce(f.place <> struct_pack(d := v.doc_id, i := v.i), false) AS later FROM windows v LEFT JOIN firsts f ON f.k = v.k
), gone AS (
  SELECT doc_id, i, byte, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM starts
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM gone
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, count(*) FILTER (head) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS bytes FROM spans GROUP BY doc_id
)
SELECT t.doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.bytes, ''))) AS kept_sha256
FROM t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
