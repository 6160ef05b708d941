"""The forward algorithm against all segmentations, its scaling, expectation maximisation by counting, and held-out accuracy."""

import math
import random

import numpy as np
import pytest

from twinplan.llm import langid
from twinplan.llm.langid import MARK, Lattice, Model, _index, totals

VOCABULARY = [MARK, MARK + "a", "a", "b", "ab", "ba", "aab", "abab", "bbbb", "abababababababababab"]


def probabilities(langs, seed=1):
    rnd = np.random.default_rng(seed)
    p = rnd.random((len(VOCABULARY) + 1, langs)) / 20
    p[-1] = langid.UNKNOWN
    return p


def cuts(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in VOCABULARY or k == 1:
            for rest in cuts(word[k:]):
                yield [word[:k], *rest]


def piece(text):
    return VOCABULARY.index(text) if text in VOCABULARY else len(VOCABULARY)


def enumerated(word, p):
    return np.array([sum(math.prod(p[piece(x), k] for x in c) for c in cuts(word)) for k in range(p.shape[1])])


@pytest.mark.parametrize("group", [1 << 20, 8])
def test_forward_sums_all_segmentations(group, monkeypatch):
    monkeypatch.setattr(langid, "GROUP", group)
    rnd, p, index = random.Random(2), probabilities(3), _index(VOCABULARY)
    words = [MARK + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(20)] + [MARK + "ab" * 8]
    got = totals(words, index, len(VOCABULARY), p)
    assert np.allclose(got, [np.log(enumerated(w, p)) for w in words])


def test_long_runs_are_summed_whole(monkeypatch):
    p, index = probabilities(2), _index(VOCABULARY)
    word = MARK + "abcab" * 4000
    whole = Lattice([word], index, len(VOCABULARY)).total(p)
    monkeypatch.setattr(langid, "GROUP", 1000)
    assert np.allclose(totals([word], index, len(VOCABULARY), p)[0], whole[0])
    half = Lattice([MARK + "abcab" * 2000], index, len(VOCABULARY)).total(p)
    assert whole[0, 0] < half[0, 0] < -10_000


@pytest.mark.parametrize("repeat", [1, 60])
def test_expected_uses_by_counting(repeat):
    p, index, word = probabilities(1), _index(VOCABULARY), MARK + "abab"
    total, seen = enumerated(word, p)[0], np.zeros(len(p))
    for c in cuts(word):
        for x in c:
            seen[piece(x)] += math.prod(p[piece(y), 0] for y in c) / total * 3
    assert np.allclose(Lattice([word], index, len(VOCABULARY)).expected(p, np.array([3.0])), seen)
    # of a word whose sums have to be rescaled, each letter is still in one piece
    long = MARK + "cab" * repeat
    found = Lattice([long], index, len(VOCABULARY)).expected(p, np.array([1.0]))
    assert math.isclose(sum(n * len(x) for n, x in zip(found, [*VOCABULARY, "c"])), len(long))


def test_letters(spark):
    texts = ["Zoë—naïve “co-op” 12", "…—“”", "²", None, "", "日本", "x" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = Model(["a", "b"], VOCABULARY, probabilities(2))
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert [got[i][0] == "und" for i in range(7)] == [False, True, True, True, True, False, False]
    assert all((s == 0) == (n == "und") and 0 <= s <= 1 for n, s in got.values())
    block = next(langid.text_blocks(iter(docs.limit(1).select("text").toArrow().to_batches())))
    start, end, _, _, joined = langid.letter_runs(block)
    assert [joined[a:b].decode() for a, b in zip(start, end)] == ["zoë", "naïve", "co", "op"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.selectExpr("doc_id as id", "lang", "length(text) as n"), "id")
    rows = [r for r in got.filter("held_out and lang is not null and lang_pred != 'und' and n > 100").collect()]
    assert len(rows) > 50 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_hot_and_null_ids_train(spark):
    rows = [(1 if k % 3 else None, "der die das" if k % 2 else "the a of", "de" if k % 2 else "en") for k in range(60)] + [(2, "x", None), (None, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most=10)
    assert set(model.langs) <= {"de", "en"}
    assert langid.predict(docs, model).count() == len(rows)
    assert langid.train(docs.limit(0)).langs == []
