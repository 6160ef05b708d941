"""Texts made to fool hashes, base counts against brute force, odd tables, and very long texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from twinplan.llm import jaccard, quality, recompress, repeats, suffixes
from twinplan.llm.blocks import Block, stretch_hashes, text_blocks
from twinplan.llm.common import with_rid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def thue_morse(letters, doublings):
    word = letters[0]
    for _ in range(doublings):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse("ab", 11)
    words = [f"w{k}" for k in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*words, one])), (2, " ".join([*words, two])), (3, one), (4, two), (5, f"{one}\n{two}\n{one}")], SCHEMA)
    removed = {r["id"]: r["n_removed"] for r in recompress.remove(docs).collect()}
    assert removed == dict.fromkeys(range(1, 6), 0)
    classes = {r["id"]: r["component"] for r in jaccard.classes(with_rid(docs)).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}  # 46 of the 48 shingles of the first two are shared, those with the last word are not
    assert {r["id"]: r["component"] for r in jaccard.classes(with_rid(docs), percent=97).collect()} == {k: k for k in range(1, 6)}
    assert {r["id"]: r["n_dup_lines"] for r in quality.rules(docs, quality.Chain()).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_hashes_do_not_depend_on_the_place():
    text = "ab abc abcdefgh abcdefghi "
    data = np.frombuffer((text * 3).encode(), np.uint8)
    ends = [m.span() for m in WORD.finditer(text * 3)]
    start, end = np.array(ends).T
    for lane in (0, 1):
        h = stretch_hashes(data, start, end, lane).reshape(3, -1)
        assert (h == h[0]).all() and len(set(h[0])) == 4
    assert not (stretch_hashes(data, start, end) == stretch_hashes(data, start, end, 1)).any()


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def test_base_counts(spark):
    rnd = random.Random(9)
    words = ["a", "b", "é#", "日本", "x|y", "z", " ", "…"] + [f"w{k}" for k in range(30)]
    texts = [None, "", " \n\t", "a", "a\n\na\n a\na\r\n", "\x0b\x0c", "…\n…"]
    texts += ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t", " \n "]) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    rows = [(None if k == 3 else k % 40, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r["id"] is None, r["id"] or 0, *(r[c] for c in names)) for r in quality.rules(docs, quality.Chain()).collect())
    assert got == sorted((i is None, i or 0, *base(t)) for i, t, _ in rows)
    kept = quality.keep(docs, quality.Chain())
    assert kept.columns == docs.columns and kept.count() == sum(not base(t)[-1] for _, t, _ in rows)
    assert quality.rules(docs.limit(0), quality.Chain()).count() == 0


def chain(seed):
    rnd = np.random.default_rng(seed)
    return quality.Chain(rnd.normal(size=(quality.N_FEATURES, 2)), rnd.normal(size=(2, 2)))


def lines(rnd, sizes):
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, quality._BASE + np.stack([rnd.integers(0, n, len(doc)) for n in quality._SIZES], 1)


def paths(n):
    return [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]


def score(c, features, states):
    return sum(c.emit[f, s].sum() for f, s in zip(features, states)) + sum(c.step[a, b] for a, b in zip(states, states[1:]))


def test_viterbi_against_all_paths():
    doc, features = lines(np.random.default_rng(2), [1, 5, 2, 7, 3])
    c = chain(1)
    got = c.decode(doc, features)
    for d in range(5):
        own = features[doc == d]
        best = max(paths(len(own)), key=lambda s: score(c, own, s))
        assert got[doc == d].tolist() == best


def test_fitting_raises_the_likelihood_and_learns_transitions():
    rnd = np.random.default_rng(5)
    doc, features = lines(rnd, [6] * 40)
    label = np.tile([1, 1, 1, 0, 0, 0], 40)
    features[:, 0] = quality._BASE[0] + label

    def likelihood(c):
        return np.mean([score(c, features[doc == d], label[doc == d]) - np.logaddexp.reduce([score(c, features[doc == d], s) for s in paths(6)]) for d in range(40)])

    fitted = quality.Chain().fit(doc, features, label)
    assert likelihood(fitted) > -0.2 > likelihood(quality.Chain())
    assert fitted.step[0, 0] > fitted.step[0, 1] and fitted.step[1, 1] > fitted.step[0, 1]
    # lines that look like the other kind take its state
    mixed = np.where(doc < 20, 1, 0)
    features[:, 0] = quality._BASE[0] + np.where(rnd.random(len(doc)) < 0.95, mixed, 1 - mixed)
    told = quality.line_labels(features, mixed, sure=0.6)
    assert 0 < (told != mixed).sum() < 60


def test_training_sample(spark):
    good, bad = "the fox ran over the hill.\n" * 3 + " ".join(f"w{k}" for k in range(60)), "BUY | NOW #1\n" * 30
    rows = [(1, f"{good} {k}") for k in range(40)] + [(2, bad)] * 40 + [(None, bad), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    c = quality.train(docs, labels, most=100)
    assert c.trained
    assert {r["id"] for r in quality.rules(docs, c).filter("kept").collect()} == {1}
    assert not quality.train(docs, labels.filter("quality = 1")).trained
    assert not quality.train(docs.limit(0), labels).trained


def bytes_removed(rows):
    seen, out = set(), {}
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[i] = sum(gone)
    return out


@pytest.mark.parametrize(("held", "least"), [(500_000, 8), (1, 2)])
def test_hot_seeds(spark, held, least, monkeypatch):
    """A passage that all documents hold with other words around it, dealt by seed and dealt by context."""
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "LEAST", least)
    rnd = random.Random(3)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = some(70)
    rows = [(k, f"{some(k % 5 * 20)} {passage[: 300 + k]} {some(30)}") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert {r["id"]: r["n_removed"] for r in suffixes.remove(docs).collect()} == bytes_removed(rows)
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, t in rows:
        w = t.split()
        want[i] = len({j for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for j in range(s, s + 50)})
    assert {r["id"]: r["n_removed"] for r in recompress.remove(docs).collect()} == want


def test_very_long_texts(spark):
    """Texts of more bytes than are worked on at once; the second repeats the first one's end across a cut."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(640_000)]
    end = " ".join(words[-1000:])
    rows = [(1, " ".join(words)), (2, f"x {end} y"), (3, "q" * 5_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == (len(rows[0][1]), 0, 0, sha(rows[0][1]))
    assert got[2][1:] == (len(end) + 1, 1, sha("x y"))
    assert got[3][1:3] == (4_999_999, 1)
    assert {r["id"]: (r["n_words"], r["n_removed"]) for r in recompress.remove(docs).collect()} == {1: (640_000, 0), 2: (1002, 1000), 3: (1, 0)}


def test_windows_have_a_bound():
    with pytest.raises(ValueError, match="127"):
        recompress.WordWindows(W=128)
    assert list(text_blocks(iter([]))) == [] and Block(None, np.zeros(0, np.uint8), np.array([0, 0])).n == 1
