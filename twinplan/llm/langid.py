"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; each language has its own
piece probabilities, learned by expectation maximisation. The probability of a
word is the sum over every way to cut it into pieces (the forward algorithm);
that of a text is the product over its words. A text's words are its maximal
runs of letters (str.isalpha), lower-cased, each with a word mark in front;
runs of any length are summed whole. A letter that no piece spells costs the
same in each language.

Training: expectation maximisation over all word forms of about TRAIN_DOCS
documents a language, which is the only bound; each round is one job for all
languages, and the driver gets a number for each language and piece.

Null texts and texts without a letter get `und` with score 0. The score is the
posterior probability of the language named. Without any training row every
text is `und`. Ties go to the language that sorts first. Repeated rows, null
ids and other columns, whatever their names, change nothing; an empty table
gives an empty result. The model goes to the tasks as one broadcast value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm.blocks import Block, stretch_hashes, text_blocks
from twinplan.llm.common import Powers, Rolling, discard, mix, where_few, written

VOCABULARY = "piece_bpe_32k.model"
#: About this many training documents a language, chosen by the hash of their id.
TRAIN_DOCS = 400
MARK = "▁"
ROUNDS, UNKNOWN = 4, 1e-7
#: Words are summed in groups of so many letters times languages; a longer word is a group of its own, taken in stretches of that many.
GROUP = 1 << 20
#: A forward sum below SMALL is scaled up by 1 / SMALL, and its logarithm noted.
SMALL = 1e-150

_POWERS_CHAR = Powers(71)


@cache
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(path: str) -> list[str]:
    """The lower-case pieces of the vocabulary that can be part of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    good = (p for p in every if p == p.lower() and all(c.isalpha() for c in p.removeprefix(MARK)))
    return sorted(p for p in good if p)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return mix(chars.astype(np.uint64) + np.uint64(1)), np.cumsum([0, *map(len, words)])


class Lattice:
    """All cuts of some words into pieces: an edge for each piece that fits, grouped by where it ends and how long it is.

    before: so many letters of each word stand before the sums begin (their pieces end in an earlier stretch).
    """

    def __init__(self, words: list[str], index: dict[int, tuple[np.ndarray, np.ndarray]], unknown: int, before: int = 0):
        symbols, first = _codes(words)
        self.size, self.before = np.diff(first), before
        self.longest = max(index, default=1)
        self.n, self.edges = len(words), []
        roll = Rolling(symbols, _POWERS_CHAR)
        at = np.arange(len(symbols))
        word = np.repeat(np.arange(self.n), self.size)
        place = at - first[word]
        left = self.size[word] - place
        found = []
        for length in sorted({1, *index}):
            fits = at[(left >= length) & (place + length > before)]
            if not len(fits):
                continue
            piece = np.full(len(fits), unknown if length == 1 else -1, np.int32)
            if length in index:
                hashes, ids = index[length]
                h = roll.of(fits, fits + length)
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                piece[hit] = ids[k[hit]]
            ok = piece >= 0
            fits, piece = fits[ok], piece[ok]
            found.append((place[fits] + length, np.full(len(fits), length), word[fits], piece))
        if found:
            end, length, word, piece = (np.concatenate(x) for x in zip(*found))
            key = end * (self.longest + 1) + length
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0, True])
            self.edges = [(int(end[o[0]]), int(length[o[0]]), word[o], piece[o]) for o in (order[a:b] for a, b in zip(cut, cut[1:]))]

    def forward(self, p: np.ndarray, start: np.ndarray | None = None, log: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """alpha[position, word, language], and the logarithm of what each is to be multiplied with.

        start: the sums of the positions up to `before`, all to be multiplied by exp(log).
        """
        alpha = np.zeros((int(self.size.max(initial=0)) + 1, self.n, p.shape[1]))
        lacks, now, least = np.zeros_like(alpha), self.before, np.log(p.min(initial=1.0))
        alpha[: now + 1] = 0 if start is None else start
        if start is None:
            alpha[0] = 1
        lacks[: now + 1] = log
        scale = np.zeros(alpha.shape[1:]) + log

        def rescale(at: int) -> None:
            if start is None and at * least > np.log(SMALL):
                return
            w, k = np.nonzero((alpha[at] < SMALL) & (alpha[at] > 0))
            if len(w):
                lo = max(0, at - self.longest + 1)
                alpha[lo : at + 1, w, k] /= SMALL
                scale[w, k] += np.log(SMALL)
                lacks[lo : at + 1, w, k] += np.log(SMALL)

        for end, length, word, piece in self.edges:
            if end != now:
                rescale(now)
                now = end
                lacks[now] = scale
            alpha[end, word] += alpha[end - length, word] * p[piece]
        rescale(now)
        return alpha, lacks

    def total(self, p: np.ndarray) -> np.ndarray:
        alpha, lacks = self.forward(p)
        each = np.arange(self.n)
        return np.log(np.maximum(alpha[self.size, each], 1e-300)) + lacks[self.size, each]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language."""
        alpha, lacks = (x[:, :, 0] for x in self.forward(p))
        each = np.arange(self.n)
        beta = np.zeros_like(alpha)  # scaled so that alpha * beta is the share of a word's weight that passes a position
        beta[self.size, each] = weight / np.maximum(alpha[self.size, each], 1e-300)
        seen = np.zeros(len(p))
        for end, length, word, piece in reversed(self.edges):
            x = beta[end, word] * p[piece, 0] * np.exp(lacks[end - length, word] - lacks[end, word])
            beta[end - length, word] += x
            seen += np.bincount(piece, alpha[end - length, word] * x, minlength=len(p))
        return seen


def totals(words: list[str], index: dict[int, tuple[np.ndarray, np.ndarray]], unknown: int, p: np.ndarray) -> np.ndarray:
    """The logarithm of each word's sum over all its cuts, a column for each language, in bounded memory."""
    out, room = np.zeros((len(words), p.shape[1])), max(1, GROUP // max(1, p.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * (len(words[order[j]]) + 1) <= room:
            j += 1
        some = order[i:j]
        if len(words[some[0]]) > room:
            out[some[0]] = _total_of_long(words[some[0]], index, unknown, p, room)
        else:
            out[some] = Lattice([words[k] for k in some], index, unknown).total(p)
        i = j
    return out


def _total_of_long(word: str, index, unknown: int, p: np.ndarray, room: int) -> np.ndarray:
    """The same for one word by stretches: each begins with the sums of the last positions of the one before."""
    back, start, log, at = max(index, default=1), None, 0.0, 0
    room = max(room, back)
    while True:
        before = min(back, at)
        part = Lattice([word[at - before : at + room]], index, unknown, before)
        alpha, lacks = part.forward(p, start, log)
        at += room
        last = int(part.size[0])
        if at >= len(word):
            return np.log(np.maximum(alpha[last, 0], 1e-300)) + lacks[last, 0]
        start, log = alpha[last - min(back, last) : last + 1], lacks[last]


class Model:
    def __init__(self, langs: list[str], vocabulary: list[str], p: np.ndarray):
        self.langs, self.p, self.unknown = langs, p, len(vocabulary)
        self.index = _index(vocabulary)
        self._known, self._rows = np.zeros(0, np.uint64), np.zeros((0, len(langs)))

    def __getstate__(self):
        return {**self.__dict__, "_known": self._known[:0], "_rows": self._rows[:0]}

    def words(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Log probabilities of words given by their hashes; spell(i) names word i. Remembers up to half a million words."""
        if len(self._known) > 500_000:
            self._known, self._rows = self._known[:0], self._rows[:0]
        at = np.searchsorted(self._known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != hashes[inside]
        if new.any():
            fresh = np.flatnonzero(new)
            rows = totals([MARK + spell(i) for i in fresh], self.index, self.unknown, self.p)
            known = np.concatenate([self._known, hashes[fresh]])
            order = np.argsort(known)
            self._known, self._rows = known[order], np.concatenate([self._rows, rows])[order]
            at = np.searchsorted(self._known, hashes)
        return self._rows[at]


def _index(vocabulary: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(p) for p in vocabulary])
    symbols, first = _codes(vocabulary)
    h = Rolling(symbols, _POWERS_CHAR).of(first[:-1], first[1:])
    out = {}
    for length in np.unique(size):
        ids = np.flatnonzero(size == length)
        order = np.argsort(h[ids])
        out[int(length)] = (h[ids][order], ids[order].astype(np.int32))
    return out


def letter_runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Start, end and text of each run of letters of the lower-cased texts; whether each text has a letter; and those texts."""
    bounds, data = block.offsets.tolist(), block.data.tobytes()
    low = [data[a:b].decode("utf-8", "replace").lower().encode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
    joined = b" ".join(low) + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = (data >= 97) & (data <= 122)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            on = more >= k
            code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
        on = _letters()[code]
        inside[lead[on]] = True
        for k in (1, 2, 3):
            inside[lead[on & (more >= k)] + k] = True
    edge = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in low)]), start, "right") - 1
    has = np.zeros(block.n, bool)
    has[doc] = True
    return start, end, doc, has, joined


def _runs_of_block(block: Block):
    start, end, doc, has, joined = letter_runs(block)
    form, first, which = np.unique(stretch_hashes(np.frombuffer(joined, np.uint8), start, end), return_index=True, return_inverse=True)
    return form, lambda i: joined[start[first[i]] : end[first[i]]].decode("utf-8", "replace"), which, doc, has


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        langs = block.rows.column("lang").to_pylist()
        form, spell, which, doc, _ = _runs_of_block(block)
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])[doc] if len(doc) else np.zeros(0, np.int64)
        key, n = np.unique(which * len(names) + code, return_counts=True)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([names[k % len(names)] for k in key], pa.string()), "word": pa.array([spell(k // len(names)) for k in key], pa.string()), "n": pa.array(n, pa.int64())}
        )


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def _expected(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray], index, unknown: int) -> Iterator[pa.RecordBatch]:
    """How often the pieces are used in a task's word forms: a row for each language."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        words, weight = [MARK + w for w in batch.column("word").to_pylist()], np.asarray(batch.column("n")).astype(float)
        for name in sorted(set(lang)):
            held = []
            own = sorted(np.flatnonzero(lang == name).tolist(), key=lambda i: len(words[i]))
            for k, i in enumerate(own):
                held.append(i)
                if len(held) * (len(words[i]) + 1) > GROUP // 4 or k + 1 == len(own):
                    seen[name] = seen.get(name, 0) + Lattice([words[j] for j in held], index, unknown).expected(p[name], weight[held])
                    held = []
    for name, n in seen.items():
        at = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "piece", "n"])


def train(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Learns from rows whose remainder is not 0: all word forms of about `most` documents a language.

    Documents are chosen by a hash of id and text, so an id that many rows share does not bring them all.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter((remainder("id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    spread = F.pmod(F.xxhash64("id", "text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language goes to the texts; joined by language, a third of all texts could meet in one task
    chosen = rows.join(where_few(counts), "lang").filter(spread < F.lit(float(most)) / F.col("n")).select("text", "lang")
    forms = written(chosen.mapInArrow(_count_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "forms")
    names = sorted(r["lang"] for r in forms.select("lang").distinct().collect())
    if not names:
        return Model([], [], np.zeros((1, 0)))
    every = pieces(vocabulary or public_tokenizers.path(VOCABULARY))
    index = _index(every)
    p = {n: np.r_[np.full(len(every), 1.0 / len(every)), UNKNOWN][:, None] for n in names}
    for _ in range(ROUNDS):
        found = (
            forms.mapInArrow(partial(_expected, p=p, index=index, unknown=len(every)), "lang string, piece int, n double")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        )
        lang, piece, n = np.array(found.column("lang").to_pylist(), object), np.asarray(found.column("piece")), np.asarray(found.column("n"))
        for name in names:
            seen = np.full(len(every), 0.05)
            on = lang == name
            seen[piece[on]] += n[on]
            p[name][:-1, 0] = seen / seen.sum()
    discard(forms, counts)
    return Model(names, every, np.hstack([p[n] for n in names]))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        form, spell, which, doc, has = _runs_of_block(block)
        n = len(model.langs)
        named, score = ["und"] * block.n, np.zeros(block.n)
        if n:
            rows = model.words(form, spell)
            total = np.stack([np.bincount(doc, rows[which, k], minlength=block.n) for k in range(n)], 1) if len(form) else np.zeros((block.n, n))
            best = total.argmax(1)
            posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            named = [model.langs[b] if h else "und" for b, h in zip(best, has)]
            score = np.where(has, posterior, 0.0)
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("id"), block.rows.column("held_out"), pa.array(named, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"]
        )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out (false where the id is null), lang_pred, score. Only the text is looked at."""
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return slim.mapInArrow(partial(_predict, model=model), "id long, held_out boolean, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).withColumnRenamed("id", "doc_id")
