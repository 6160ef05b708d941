"""Repeated word sequences by recompression.

A window is W consecutive words of one document. Each word is removed that a
window covers whose word sequence also starts in a document of smaller id;
windows are judged on the input. Null has no words.

Rounds of recompression name what stands in the texts: first every maximal run of
one symbol, then every pair of a left and a right symbol (a bit of the symbol's
own hash and the round says which it is). A name is a hash of what it names, so
names are global without a dictionary: equal word sequences get equal symbols
wherever they stand, but for symbols at their ends that depend on what lies
outside. How far each symbol's existence depends on its surroundings is carried
along, so it is known exactly which symbols lie in the consistent interior of a
window. The longest of these (ties: the least hash, then the leftmost) is the
window's anchor. Words themselves are symbols, so each window has one.

Shared high-level symbols reveal candidates; equal contexts around them verify
whole stretches by 128 bits, and the rest is verified window by window by two
64-bit hashes, each of a word hash of its own.

The rounds run on the map side, block by block: as a name is a hash of what it
names, every block gives it alike, and no round has to ask the others.

Ids that repeat or are null are ordered as with_rid() says: of repeated rows the
first keeps its words. Texts without a word have n_words 0 and the digest of the
empty text. An empty table gives an empty result; other columns, whatever their
names, are not looked at. A text of any length is worked on in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinplan.llm.blocks import IS_SPACE, POWERS_WORD, POWERS_WORD_2, Block, word_hashes, words_of
from twinplan.llm.common import Rolling, mix, with_rid
from twinplan.llm.repeats import Piece, Router, packed, ranges, remove_repeats, settle, spans_batch, unpacked

ROUNDS = 4
#: Bits of a rank for the place in the block: more symbols than a stretch can have.
BITS = 24
STRETCH = 1 << 20
WINDOW = (("one", "u8"), ("two", "u8"), ("rid", "i8"), ("start", "u4"))


@dataclass(frozen=True)
class WordWindows:
    W: int = 50
    own: bool = False

    def __post_init__(self):
        if not 1 <= self.W <= 127:
            raise ValueError("a window has 1 to 127 words: a symbol's rank has 7 bits for its length")

    def pieces(self, block: Block) -> Iterator[Piece]:
        if block.n > 1 or len(block.data) <= STRETCH:
            yield Piece(block.data, block.offsets, np.arange(block.n), 0)
            return
        # a long text in stretches that begin at a word; each repeats the W - 1 last words of the one before
        at = base = 0
        while at < len(block.data):
            end = min(at + STRETCH, len(block.data))
            if end < len(block.data):
                gaps = np.flatnonzero(IS_SPACE[block.data[end:]][: len(block.data) - end])
                end = end + int(gaps[0]) if len(gaps) else len(block.data)
            data = block.data[at:end]
            yield Piece(data, np.array([0, len(data)]), np.zeros(1, np.int64), base)
            if end >= len(block.data):
                return
            words = words_of(Block(block.rows, data, np.array([0, len(data)])))
            n = len(words.start)
            back = max(n - self.W + 1, min(n, 1))
            if back >= n:
                at, base = end, base + n
            else:
                at, base = at + int(words.start[back]), base + back

    def runs(self, piece: Piece) -> dict[str, np.ndarray]:
        W = self.W
        words = words_of(Block(None, piece.data, piece.offsets))
        symbols = word_hashes(piece.data, words)
        n, first = len(symbols), words.first
        size = np.diff(first)
        full = size >= W
        starts = ranges(first[:-1][full], size[full] - W + 1)
        if not len(starts):
            return {k: np.zeros(0, t) for k, t in (("seed", "u8"), ("ctx", "u8"), ("lead", "u8"), ("doc", "i8"), ("start", "i8"), ("n", "i8"), ("at", "i8"))}
        name, begin, end, lo, hi = self._symbols(symbols, words.doc)
        order = np.argsort(begin, kind="stable")
        name, begin, end, lo, hi = (x[order] for x in (name, begin, end, lo, hi))
        # windows that see a symbol's whole surroundings and lie in one text
        left = np.maximum(hi - W, first[words.doc[begin]])
        right = np.minimum(lo, first[words.doc[begin] + 1] - W)
        ok = left <= right
        name, begin, end, left, right = (x[ok] for x in (name, begin, end, left, right))
        last = np.uint64((1 << BITS) - 1)  # as many bits in every block, so that all blocks rank alike
        rank = (end - begin).astype(np.uint64) << np.uint64(57) | mix(name) >> np.uint64(7 + BITS) << np.uint64(BITS) | (last - np.arange(len(name), dtype=np.uint64))
        best = covering_max(left, right, rank, n)[starts]
        anchor = (last - (best & last)).astype(np.int64)
        doc = words.doc[starts]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
        head = np.flatnonzero(new)
        count = np.diff(np.r_[head, len(starts)])
        at, a = starts[head], anchor[head]
        return {
            "seed": mix(name[a] ^ (end - begin)[a].astype(np.uint64)), "ctx": Rolling(word_hashes(piece.data, words, 1), POWERS_WORD_2).of(at, at + count - 1 + W), "lead": name[a],
            "doc": piece.row[doc[head]], "start": at - first[doc[head]] + piece.base, "n": count, "at": begin[a] - at,
        }

    def _symbols(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols of all rounds that can lie in a window's interior: name, first word, end, and the words that its existence depends on."""
        n = len(symbols)
        name, begin, end = symbols, np.arange(n), np.arange(1, n + 1)
        lo, hi = begin, end
        found = [(name, begin, end, lo, hi)]
        for k in range(ROUNDS):
            for name, begin, end, lo, hi, made in self._round(name, begin, end, lo, hi, doc, k):
                fits = made & (hi - lo <= self.W)
                found.append(tuple(x[fits] for x in (name, begin, end, lo, hi)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _round(self, name, begin, end, lo, hi, doc, k):
        def beside(lo, hi, begin, end):
            """What the neighbours depend on; a text's edge counts as a word outside of it, which no window sees."""
            here = doc[begin]
            left = np.r_[-1, lo[:-1]]
            edge = np.r_[True, here[1:] != here[:-1]]
            left[edge] = begin[edge] - 1
            right = np.r_[hi[1:], -1]
            edge = np.r_[here[1:] != here[:-1], True]
            right[edge] = end[edge] + 1
            return left, right

        # runs: a maximal run is known only with both neighbours
        here = doc[begin]
        follows = np.r_[False, (name[1:] == name[:-1]) & (here[1:] == here[:-1])]
        head = np.flatnonzero(~follows)
        size = np.diff(np.r_[head, len(name)])
        tail = head + size - 1
        left, right = beside(lo, hi, begin, end)
        made = size > 1
        name2 = np.where(made, mix(name[head] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), name[head])
        name, begin, end, lo, hi = name2, begin[head], end[tail], np.minimum(left[head], lo[head]), np.maximum(right[tail], hi[tail])
        yield name, begin, end, lo, hi, made

        # pairs: left symbol, right symbol
        is_left = (mix(name ^ np.uint64(0xA24BAED4963EE407 + k)) & np.uint64(1)).astype(bool)
        here = doc[begin]
        joins = np.r_[is_left[:-1] & ~is_left[1:] & (here[1:] == here[:-1]), False] if len(name) else np.zeros(0, bool)
        second = np.r_[False, joins[:-1]]
        left, right = beside(lo, hi, begin, end)
        lo_alone, hi_alone = np.where(is_left, lo, np.minimum(lo, left)), np.where(is_left, np.maximum(hi, right), hi)
        keep = np.flatnonzero(~second)
        pair = joins[keep]
        after = np.minimum(keep + 1, len(name) - 1)
        name2 = np.where(pair, mix(name[keep] * np.uint64(0xD6E8FEB86659FD93) + mix(name[after])), name[keep])
        begin2, end2 = begin[keep], np.where(pair, end[after], end[keep])
        lo2 = np.where(pair, np.minimum(lo[keep], lo[after]), lo_alone[keep])
        hi2 = np.where(pair, np.maximum(hi[keep], hi[after]), hi_alone[keep])
        yield name2, begin2, end2, lo2, hi2, pair

    def reopen(self, block: Block, doc: np.ndarray, r: dict[str, np.ndarray], route: Router, n: int) -> Iterator[pa.RecordBatch]:
        words = words_of(block)
        one = Rolling(word_hashes(block.data, words), POWERS_WORD)
        two = Rolling(word_hashes(block.data, words, 1), POWERS_WORD_2)
        size = r["n"].astype(np.int64)
        start = ranges(r["start"].astype(np.int64), size)
        at, rid = start + np.repeat(words.first[doc], size), np.repeat(r["rid"], size)
        one, two = one.of(at, at + self.W), two.of(at, at + self.W)
        order, _, later = settle((one, two), rid, start, self.own)
        gone, stay = order[later], order[~later]
        yield spans_batch(rid[gone], start[gone], start[gone] + self.W, n)
        yield packed((one[stay] % np.uint64(n)).astype(np.int32), {"one": one[stay], "two": two[stay], "rid": rid[stay], "start": start[stay]}, WINDOW, "window")

    def compare(self, held: list[bytes], n: int) -> pa.RecordBatch:
        r = unpacked(held, WINDOW)
        order, _, later = settle((r["one"], r["two"]), r["rid"], r["start"], self.own)
        gone = order[later]
        start = r["start"][gone].astype(np.int64)
        return spans_batch(r["rid"][gone], start, start + self.W, n)

    def cut(self, block: Block, spans: list[tuple[np.ndarray, np.ndarray]], how: str) -> pa.RecordBatch:
        n, removed, digest = [], [], []
        for i, (s, e) in enumerate(spans):
            words = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            n.append(len(words))
            removed.append(int((e - s).sum()))
            if len(s):
                left, at = [], 0
                for a, b in zip(s.tolist(), e.tolist()):
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            digest.append(b" ".join(words).decode() if how == "text" else hashlib.sha256(b" ".join(words)).hexdigest())
        long = pa.int64()
        return pa.RecordBatch.from_arrays(
            [block.rows.column("id"), pa.array(n, long), pa.array(removed, long), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept"]
        )


def covering_max(left: np.ndarray, right: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """For each place, the largest rank of the intervals [left, right] that hold it, 0 where none does."""
    level = np.floor(np.log2(right - left + 1)).astype(np.int64)
    top = int(level.max(initial=0))
    table = np.zeros((top + 1, n), np.uint64)
    np.maximum.at(table, (level, left), rank)
    np.maximum.at(table, (level, right - (1 << level) + 1), rank)
    for k in range(top, 0, -1):
        half = 1 << (k - 1)
        np.maximum(table[k - 1], table[k], out=table[k - 1])
        np.maximum(table[k - 1][half:], table[k][:-half], out=table[k - 1][half:])
    return table[0]


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: WordWindows = WordWindows(), how: str = "digest") -> DataFrame:
    """id, n_words, n_removed and kept, for each row of docs: the kept words joined by one space (how="text") or their SHA-256."""
    return remove_repeats(with_rid(docs, id_col, text_col), unit, how, "id long, n_words long, n_removed long, kept string")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM t
), windows AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER ahead = 50 THEN md5(string_agg(word, ' ') OVER ahead) END AS k FROM w
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), firsts AS (
  SELECT k, min(doc_id) AS doc_id FROM windows WHERE k IS NOT NULL GROUP BY k
), starts AS (
  SELECT v.doc_id, v.i, coalesce(f.doc_id < v.doc_id, false) AS later FROM windows v LEFT JOIN firsts f ON f.k = v.k
), gone AS (
  SELECT doc_id, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM starts
), kept AS (
  SELECT w.doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY w.i) FILTER (NOT gone) AS text
  FROM w JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
