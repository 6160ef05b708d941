"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus's word counts (all of it, combined before the shuffle) name its most
frequent words, LEXICON at most. They are compiled, with the ids that the merges
give them, into one minimal automaton that shares prefixes and suffixes; each arc
carries how many words precede it, so a path's sum is the word's number, and
that leads to its ids. The automaton is a few arrays in one file, which each
worker memory-maps. A word that the automaton does not accept is merged exactly,
pair by pair in rank order. So every word gets the ids of the merges, whatever
the lexicon holds.

Texts are normalised and cut as the tokenizer file says: its special tokens are
found in the raw text first; then NFC, lower case character by character, and
the file's split pattern. Null reads as empty; an empty text has no ids and
decodes to the empty text. Ids decode to their tokens joined by a space, for the
file has no decoder.

Words of over LONGEST bytes are not in the lexicon and are merged, whatever their
length. The file that a worker maps is of its own making, from the broadcast
automaton, and gone when the mapping is; nothing else reads it. Repeated rows and
null ids are rows like others; an empty table gives an empty result; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm.common import written

VOCABULARY = "word_bpe_49k.json"
#: The most words that are compiled; it bounds the automaton, some 12 MB.
LEXICON = 1 << 18
#: Bytes of the longest word in the lexicon, which bounds what the driver compiles.
LONGEST = 64
#: The most words that a worker remembers besides.
MEMORY = 400_000
END = "</w>"
NO_PAIR = (1 << 60, 0)
#: White space of the common characters, as the tokenizer file's pattern has it.
_SPACE = r"\t-\r \x85\xa0"
#: Characters outside these may be classed or normalised otherwise in another Unicode version: the library itself does their texts' first steps.
_UNCOMMON = re.compile("[^\\0-ӿ‐-‧‰-⁞₠-₿、-〿ぁ-ゖ゠-ヿ一-鿿가-힣]")


class Bpe:
    """The vocabulary and merges of a tokenizer file, and exact merging."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + END] for c in letters]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"^\s", "^" + _SPACE)).findall
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token stands as itself, after a NUL NUL that no word has at its start."""
        if self.cut and any(t in text for t in self.special):
            out = []
            for part in self.cut(text):
                out += ["\0\0" + part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _UNCOMMON.search(text):
            return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        return self.find(text.lower())

    def merge(self, word: str) -> list[int]:
        """The ids of one word: its lowest-ranked pair is merged, the leftmost of equals, until no pair is left."""
        if word.startswith("\0\0") and word[2:] in self.special:
            return [self.special[word[2:]]]
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        if len(ids) > 100:
            return self._merge_long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best, at = NO_PAIR, 0
            for k, pair in enumerate(zip(ids, ids[1:])):
                found = pairs.get(pair)
                if found is not None and found < best:
                    best, at = found, k
            if best is NO_PAIR:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*found, k) for k in range(n - 1) if (found := pairs.get((ids[k], ids[k + 1]))) is not None]
        heap = [(rank, k, made, ids[k], ids[k + 1]) for rank, made, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (found := pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the others from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


# --- the lexicon ---------------------------------------------------------------


def compile_lexicon(words: Iterable[str], ids_of) -> bytes:
    """A minimal acyclic automaton over the words' bytes with id outputs, as one file's content.

    Words are added in byte order; what a word no longer shares with the next is
    replaced by an equal state if there is one.
    """
    spelled = sorted({w.encode("utf-8"): w for w in words}.items())
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []

    def frozen(state: list) -> int:
        key = (state[0], *state[1])
        if (known := register.get(key)) is None:
            known = register[key] = len(arcs_of)
            arcs_of.append((state[0], tuple(state[1])))
        return known

    path, last = [[False, []]], b""
    for data, _ in [*spelled, (b"", "")]:
        common = 0
        for a, b in zip(data, last):
            if a != b:
                break
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], frozen(path[depth])))
            del path[depth]
        path += [[False, []] for _ in range(len(data) - common)]
        path[-1][0] = path[-1][0] or bool(data)
        last = data
    root = frozen(path[0])

    below = np.zeros(len(arcs_of), np.int64)  # words from each state on; children are frozen before parents
    state, label, target, skipped = [], [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        n = int(final)
        for byte, to in arcs:
            state.append(s), label.append(byte), target.append(to), skipped.append(n)
            n += int(below[to])
        below[s] = n
    ids = [ids_of(w) for _, w in spelled]
    arrays = {
        "key": np.array(state, np.int64) * 256 + np.array(label, np.int64),
        "target": np.array(target, np.int32),
        "skipped": np.array(skipped, np.int32),
        "final": np.array([f for f, _ in arcs_of], np.uint8),
        "first": np.cumsum([0, *map(len, ids)]).astype(np.int32),
        "ids": np.array([i for x in ids for i in x], np.int32),
    }
    head = json.dumps({"root": root, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    out = len(head).to_bytes(8, "little") + head
    for v in arrays.values():
        out += v.tobytes() + b"\0" * (-v.nbytes % 8)
    return out


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, content: bytes):
        with tempfile.NamedTemporaryFile() as f:  # the mapping outlives the name
            f.write(content)
            f.flush()
            raw = np.memmap(f.name, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + size].tobytes())
        at, self.root = 8 + size, head["root"]
        for name, kind, n in head["arrays"]:
            nbytes = np.dtype(kind).itemsize * n
            setattr(self, name, raw[at : at + nbytes].view(kind))
            at += nbytes + -nbytes % 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not accept it; all words walk it side by side."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        number, state = np.zeros(len(words), np.int64), np.full(len(words), self.root, np.int64)
        alive = np.flatnonzero(size > 0)
        out = np.full(len(words), -1, np.int64)
        depth = 0
        while len(alive) and len(self.key):
            key = state[alive] * 256 + data[first[alive] + depth]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            alive, arc = alive[ok], arc[ok]
            number[alive] += self.skipped[arc]
            state[alive] = self.target[arc]
            depth += 1
            done = size[alive] == depth
            ended = alive[done]
            accepted = ended[self.final[state[ended]] == 1]
            out[accepted] = number[accepted]
            alive = alive[~done]
        return out

    def ids_at(self, number: int) -> list[int]:
        return self.ids[self.first[number] : self.first[number + 1]].tolist()


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, counts = load(path), Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(bpe.words(text or ""))
            if len(counts) > MEMORY:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON) -> list[str]:
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_count, path=path), "word string, n long")
    short = F.octet_length("word") <= LONGEST  # longer ones are merged, not looked up
    total = written(counted.filter(short).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "counts")
    # how many words have each count (larger counts in classes): the least count that still leaves at most `most` words
    size = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(16 * F.log2(F.col("n") / 1024)))
    least, held = None, 0
    for r in total.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("size")).collect():
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    return [] if least is None else [r["word"] for r in total.filter(F.col("n") >= least).select("word").collect()]


# --- encoding and decoding -------------------------------------------------------


class Coder:
    """Encodes through the lexicon; remembers each word's ids as text and its tokens as text."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > MEMORY:
            self.ids.clear()
            self.tokens.clear()
        new = [w for w in words if w not in self.ids]
        for word, number in zip(new, self.lexicon.numbers([w.encode("utf-8") for w in new]).tolist()):
            ids = self.lexicon.ids_at(number) if number >= 0 else self.bpe.merge(word)
            self.ids[word] = " ".join(map(str, ids))
            self.tokens[word] = " ".join([self.bpe.tokens[i] for i in ids])


def decode(bpe: Bpe, ids: Iterable[int]) -> str:
    return " ".join(bpe.tokens[i] for i in ids if i in bpe.tokens)


_worker: dict = {}


def _coder(path: str, content) -> Coder:
    """One for each worker process and lexicon."""
    key = (path, content.id)
    if _worker.get("key") != key:
        _worker.update(key=key, coder=Coder(load(path), Lexicon(content.value)))
    return _worker["coder"]


def _encode(batches: Iterator[pa.RecordBatch], path: str, content, full: bool) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, content)
    for batch in batches:
        texts = batch.column("text")
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words = [coder.bpe.words(t or "") for t in texts.slice(at, 256).to_pylist()]
            coder.learn(set().union(*words))
            ids = [" ".join([coder.ids[w] for w in x]) for x in words]
            out = {"id": part.column("id"), "n_tokens": pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64())}
            if full:
                out["ids"] = pa.array([np.array(i.split(), np.int32) for i in ids], pa.list_(pa.int32()))
                out["decoded"] = pa.array([" ".join([coder.tokens[w] for w in x]) for x in words], pa.string())
            else:
                out["ids_sha256"] = pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids])
                out["decoded_sha256"] = pa.array([hashlib.sha256(" ".join([coder.tokens[w] for w in x]).encode()).hexdigest() for x in words])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = LEXICON, digests: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_tokens, and ids and decoded, or with digests their SHA-256."""
    path = path or public_tokenizers.path(VOCABULARY)
    content = compile_lexicon(frequent_words(docs, path, text_col, most), load(path).merge)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return slim.mapInArrow(partial(_encode, path=path, content=_Shared(shared, hashlib.sha256(content).hexdigest()), full=not digests), f"id long, n_tokens long, {rest}")


class _Shared:
    """A broadcast with a name that stays the same in every worker."""

    def __init__(self, shared, name: str):
        self.shared, self.id = shared, name

    @property
    def value(self) -> bytes:
        return self.shared.value


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, digests=True).withColumnRenamed("id", "doc_id")
