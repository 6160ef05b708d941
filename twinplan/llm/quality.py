"""Quality rules: base counts, and a linear-chain CRF that labels lines as content or boilerplate.

Words are runs without space, tab, LF, VT, FF, CR; lines are split at LF; null
reads as empty. Each line with a word is one position of the chain; its features
are indicators of binned counts. A document is kept when the base rules pass and
the words of lines that Viterbi decoding marks as content are at least
MIN_CONTENT of its words.

Training: at most TRAIN_DOCS labelled documents (those whose id and text hash
lowest) and of each at most TRAIN_LINES consecutive lines (from a place that the
text's hash tells), both documented bounds of the sample. Labels are of documents,
states are of lines, so lines get theirs in two steps: a model of single lines is
fitted to the documents' labels; then a line that it gives to the other state with
more than SURE takes that state. So boilerplate inside of good documents and
content inside of bad ones are labelled as such, and the chain learns the
transitions between them. It is fitted by full log-likelihood with forward and
backward passes, and Adam. Without labels of both kinds the CRF marks every line
as content, so the base rules alone decide.

A text without words has n_words 0, fails the base rules and is not kept.
Repeated ids are rows like others, and each is judged by its text; null ids have
no label. An empty table gives an empty result. Columns that are not named in the
call, whatever their names, are carried through by keep() and change nothing. All
work is on whole texts, block by block, in arrays as large as the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from twinplan.llm.blocks import POWERS_WORD, Block, stretch_hashes, text_blocks, word_hashes, words_of
from twinplan.llm.common import Rolling, first_of_groups, lean, mix

TRAIN_DOCS, TRAIN_LINES = 4000, 256
SURE = 0.9
MIN_CONTENT = 0.5
MIN_WORDS = 50

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes for the features: 1 lower, 2 upper, 3 digit, 4 symbol, 5 full stop and the like, 6 other mark, 7 first byte of a longer character.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 6
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[list(b".?")] = 5
_CLASS[0xC2:0xF5] = 7
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

#: name, upper edges of the bins; a value falls in the first bin whose edge it is below.
BINS = (
    ("words", (3, 6, 12, 25, 60)),
    ("upper", (0.05, 0.2, 0.6)),
    ("symbols", (0.005, 0.03, 0.1)),
    ("digits", (0.01, 0.1)),
    ("marks", (0.01, 0.03, 0.08, 0.15)),
    ("stops", (0.2, 0.5, 0.9, 1.5)),
    ("length", (3.0, 4.5, 6.0, 9.0)),
    ("again", (0.02, 0.2, 0.5)),
    ("repeat", (0.1, 0.5)),
    ("earlier", (0.5,)),
)
_SIZES = [len(edges) + 1 for _, edges in BINS]
N_FEATURES = sum(_SIZES)
_BASE = np.cumsum([0, *_SIZES])[:-1]


def counts_of(block: Block) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The base counts of each text, and of each line with a word: doc, words and the indices of its features."""
    data, offsets = block.data, block.offsets
    n, words = block.n, words_of(block)
    n_words = np.diff(words.first)
    chars = np.r_[0, np.cumsum(_FIRST_BYTE[data])]
    word_chars = _sums(chars[words.end] - chars[words.start], words.first)
    n_symbols = np.diff(np.r_[0, np.cumsum(_IS_SYMBOL[data])][offsets])

    again = repeated_words(data, words)
    n_repeat = _sums(again.astype(np.int64), words.first)

    # lines: cut at each LF and at each text's end
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offsets[:-1], breaks + 1])
    owner = np.sort(np.r_[np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    end = np.r_[start[1:], len(data)]
    cut = np.searchsorted(breaks, end - 1)
    at_break = (cut < len(breaks)) & (end > start)
    at_break[at_break] = breaks[cut[at_break]] == end[at_break] - 1
    end = end - at_break
    lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = hi > lo
    start, end, owner, lo, hi = (x[full] for x in (start, end, owner, lo, hi))

    order, new, _ = first_of_groups(owner.astype(np.uint64), stretch_hashes(data, start, end), stretch_hashes(data, start, end, 1))
    earlier = np.zeros(len(start), bool)
    earlier[order[~new]] = True
    n_dup = np.bincount(owner, earlier, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)

    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    lines = {"doc": owner, "words": hi - lo, "features": _features(data, words, again, start, end, lo, hi, earlier)}
    return base, lines


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][first])


def repeated_words(data: np.ndarray, words) -> np.ndarray:
    """Whether each word lies in a 3-word window that its text has twice or more."""
    again = np.zeros(len(words.start), bool)
    if len(again) < 3:
        return again
    symbols = word_hashes(data, words)
    at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
    doc = mix(words.doc[at].astype(np.uint64))
    one = Rolling(symbols, POWERS_WORD).of(at, at + 3) ^ doc
    order = np.argsort(one)
    same = np.zeros(len(at), bool)
    equal = one[order[1:]] == one[order[:-1]]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    at = at[same]
    # the few that look repeated are held against a second hash
    two = mix(word_hashes_again(data, words, at))
    order, new, group = first_of_groups(words.doc[at].astype(np.uint64), one[same], two)
    size = np.bincount(group, minlength=1)
    at = at[order[size[group] > 1]] if len(at) else at
    for k in range(3):
        again[at + k] = True
    return again


def word_hashes_again(data: np.ndarray, words, at: np.ndarray) -> np.ndarray:
    return sum(mix(stretch_hashes(data, words.start[at + k], words.end[at + k], 1)) * np.uint64(2 * k * k + 3) for k in range(3)) if len(at) else np.zeros(0, np.uint64)


def _features(data, words, again, start, end, lo, hi, earlier) -> np.ndarray:
    kind = _CLASS[data]
    share = [np.r_[0, np.cumsum(kind == k)] for k in range(1, 8)]
    lower, upper, digit, symbol, stop, mark, wide = (s[end] - s[start] for s in share)
    letters, all_chars, n = lower + upper + wide, lower + upper + wide + digit + symbol + stop + mark, hi - lo
    symbols = word_hashes(data, words)
    twice = np.zeros(len(symbols), bool)
    twice[1:] = (symbols[1:] == symbols[:-1]) & (words.doc[1:] == words.doc[:-1])
    count = lambda flags: (lambda c: c[hi] - c[lo])(np.r_[0, np.cumsum(flags)])
    # upper: of the ASCII letters, for others' case is not looked at
    values = {
        "words": n,
        "upper": upper / np.maximum(lower + upper, 1),
        "symbols": symbol / np.maximum(all_chars, 1),
        "digits": digit / np.maximum(all_chars, 1),
        "marks": (mark + symbol) / np.maximum(all_chars, 1),
        "stops": 10 * stop / np.maximum(n, 1),
        "length": letters / np.maximum(n, 1),
        "again": count(again) / np.maximum(n, 1),
        "repeat": count(twice) / np.maximum(n, 1),
        "earlier": earlier.astype(float),
    }
    out = np.empty((len(start), len(BINS)), np.int32)
    for k, (name, edges) in enumerate(BINS):
        out[:, k] = _BASE[k] + np.searchsorted(edges, values[name], "right")
    return out


class Chain:
    """A linear-chain CRF over the states boilerplate (0) and content (1)."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step
        self.trained = emit is not None

    @staticmethod
    def _layout(doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For lines sorted by document: at each depth of the chains, the places of the lines, longest chains first."""
        if not len(doc):
            return np.zeros(0, np.int64), []
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[head, len(doc)])
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")
        return head, [head[: alive[t]] + t for t in range(size[0])]

    def decode(self, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Viterbi: the state of each line."""
        state = np.ones(len(doc), np.int8)
        if not self.trained or not len(doc):
            return state
        score = self.emit[features].sum(1)
        _, depths = self._layout(doc)
        back = np.zeros((len(doc), 2), np.int8)
        best = score[depths[0]]
        ends = []
        for t in range(1, len(depths)):
            at, before = depths[t], best[: len(depths[t])]
            if len(at) < len(best):
                ends.append((depths[t - 1][len(at) :], best[len(at) :]))
            paths = before[:, :, None] + self.step
            back[at] = paths.argmax(1)
            best = paths.max(1) + score[at]
        ends.append((depths[-1], best))
        for at, b in ends:
            state[at] = b.argmax(1)
        for t in range(len(depths) - 1, 0, -1):
            at = depths[t]
            state[at - 1] = back[at, state[at]]
        return state

    def fit(self, doc: np.ndarray, features: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
        """Maximises the log-likelihood of the labels of lines sorted by document."""
        _, depths = self._layout(doc)
        n = len(doc)
        right_emit = np.zeros_like(self.emit)
        for k in range(features.shape[1]):
            np.add.at(right_emit, (features[:, k], label), 1.0)
        follows = np.flatnonzero(doc[1:] == doc[:-1])
        right_step = np.zeros((2, 2))
        np.add.at(right_step, (label[follows], label[follows + 1]), 1.0)
        weights = np.concatenate([self.emit.ravel(), self.step.ravel()])
        m = v = np.zeros_like(weights)
        for i in range(1, rounds + 1):
            emit, step = weights[: self.emit.size].reshape(-1, 2), weights[self.emit.size :].reshape(2, 2)
            score = emit[features].sum(1)
            ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
            ahead[depths[0]] = score[depths[0]]
            for at in depths[1:]:
                ahead[at] = np.logaddexp(ahead[at - 1, :1] + step[0], ahead[at - 1, 1:] + step[1]) + score[at]
            for at in depths[:0:-1]:
                x = score[at] + behind[at]
                behind[at - 1] = np.logaddexp(step[:, 0] + x[:, :1], step[:, 1] + x[:, 1:])
            both = ahead + behind
            total = np.logaddexp(both[:, 0], both[:, 1])
            p = np.exp(both - total[:, None])
            seen = np.stack([sum(np.bincount(features[:, k], p[:, s], minlength=N_FEATURES) for k in range(features.shape[1])) for s in (0, 1)], 1)
            x = ahead[follows][:, :, None] + step + (score + behind)[follows + 1][:, None, :] - total[follows][:, None, None]
            grad = np.concatenate([(right_emit - seen).ravel(), (right_step - np.exp(x).sum(0)).ravel()]) / n - ridge * weights
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            weights = weights + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return Chain(weights[: self.emit.size].reshape(-1, 2), weights[self.emit.size :].reshape(2, 2))


@lean
def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        _, lines = counts_of(block)
        cut = np.searchsorted(lines["doc"], np.arange(block.n + 1))
        first = cut[:-1] + np.asarray(block.rows.column("hash")).view(np.uint64) % np.maximum(np.diff(cut) - TRAIN_LINES + 1, 1).astype(np.uint64)
        first = first.astype(np.int64)
        flat = lines["features"].astype(np.uint8)
        features = [flat[a : min(a + TRAIN_LINES, b)].tobytes() for a, b in zip(first, cut[1:])]
        yield pa.RecordBatch.from_arrays([block.rows.column("quality"), pa.array(features, pa.binary())], ["quality", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> Chain:
    """Fits the chain on at most `most` labelled documents; an id with labels of both kinds counts as bad."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("id", "text"))
    # an id may repeat, so rows are chosen and not ids: only their hashes are sorted, and at most `most` of them meet the texts again
    chosen = slim.select("id", "hash").join(known, "id").groupBy("hash", "id").agg(F.min("quality").alias("quality")).orderBy("hash", "id").limit(most)
    rows = (
        slim.join(F.broadcast(chosen), ["id", "hash"]).groupBy("id", "hash").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
        .mapInArrow(_line_rows, "quality int, features binary").orderBy("features", "quality").collect()
    )
    rows = [r for r in rows if r["features"]]
    if {r["quality"] for r in rows} != {0, 1}:
        return Chain()
    features = [np.frombuffer(r["features"], np.uint8).reshape(-1, len(BINS)).astype(np.int32) for r in rows]
    size = [len(f) for f in features]
    doc, features, label = np.repeat(np.arange(len(rows)), size), np.concatenate(features), np.repeat([r["quality"] for r in rows], size)
    return Chain().fit(doc, features, line_labels(features, label))


def line_labels(features: np.ndarray, label: np.ndarray, sure: float = SURE) -> np.ndarray:
    """The states of lines, from their documents' labels and a model of single lines fitted to these."""
    single = Chain().fit(np.arange(len(label)), features, label)
    score = single.emit[features].sum(1)
    content = 1 / (1 + np.exp(score[:, 0] - score[:, 1]))
    return np.where(content > sure, 1, np.where(content < 1 - sure, 0, label))


_OUT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"


def judge(block: Block, chain: Chain, least: float) -> dict[str, np.ndarray]:
    base, lines = counts_of(block)
    content = chain.decode(lines["doc"], lines["features"])
    words = np.bincount(lines["doc"], lines["words"] * content, minlength=block.n).astype(np.int64)
    n = base["n_words"]
    failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * n)
    return {k: v.astype(np.int64) for k, v in base.items()} | {"content_words": words, "base_failed": failed, "kept": ~failed & (words >= least * n)}


@lean
def _verdicts(batches: Iterator[pa.RecordBatch], chain: Chain, least: float) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        out = {"id": block.rows.column("id")} | {k: pa.array(v) for k, v in judge(block, chain, least).items()}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


@lean
def _kept_rows(batches: Iterator[pa.RecordBatch], chain: Chain, least: float) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        yield pa.RecordBatch.from_arrays([block.rows.column("row")], ["row"]).filter(pa.array(judge(block, chain, least)["kept"]))


def rules(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_CONTENT) -> DataFrame:
    """A row for each row of docs: id, the base counts, content_words, base_failed, kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(partial(_verdicts, chain=chain, least=least), _OUT)


def keep(docs: DataFrame, chain: Chain, text_col: str = "text", least: float = MIN_CONTENT) -> DataFrame:
    """The rows of docs that are kept, with all their columns; no shuffle."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(partial(_kept_rows, chain=chain, least=least), StructType([StructField("row", docs.schema)])).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rules(docs, train(docs, labels)).withColumnRenamed("id", "doc_id")
