"""Regions split over tasks against brute force."""

import random

import numpy as np
import pytest
from tests.llm.test_near_duplicates import firsts

from twinplan.llm import jaccard
from twinplan.llm.common import with_rid


def region(rnd):
    """One region: a large cluster, chains that lead away from it, and clusters of their own that share words with it."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    out = [[*base[:k], word(), *base[k + 1 :]] for k in rnd.choices(range(100), k=60)]
    for _ in range(6):
        at = list(base)
        for _ in range(12):
            k = rnd.randrange(100)
            at = [*at[:k], word(), *at[k + 1 :]]
            out.append(at)
    for _ in range(6):
        other = [*base[:55], *[word() for _ in range(45)]]
        out += [[*other[:-1], word()] for _ in range(8)]
    rnd.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(900 + i, " ".join(out[i])) for i in range(5)]


@pytest.mark.parametrize("bound", [7, 60])
def test_split_regions(spark, bound, monkeypatch):
    monkeypatch.setattr(jaccard, "BOUND", bound)
    shares = []
    split = jaccard._split_regions
    monkeypatch.setattr(jaccard, "_split_regions", lambda sets, *a: shares.append(sets.count()) or split(sets, *a))
    rows = region(random.Random(3))
    want = firsts(rows, 85, 4)
    got = {r["id"]: (r["component"], r["first"]) for r in jaccard.classes(with_rid(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {i: (rows[k][0],) * 2 for (i, _), k in zip(rows, want)}
    assert shares and shares[0] > bound and len(set(want)) > 3


def test_linked_sets_share_a_signature():
    rnd = np.random.default_rng(5)
    values = lambda n: rnd.integers(0, 1 << 63, n).astype(np.uint64)
    linked = 0
    for percent in (80, 85):
        for n in [*range(1, 40), 57, 120, 333, 700]:
            for frequent in (0.0, 0.5, 1.0):
                base = values(n)
                often = np.sort(base[rnd.random(n) < frequent])
                order = jaccard.Order(often, np.full(len(often), 3, np.uint64))
                # as different as a link allows: shingles left out, put in, or both
                out = int(rnd.integers(0, n - -(-percent * n // 100) + 1))
                more = max(0, 100 * (n - out) // percent - n)
                other = np.concatenate([rnd.permutation(base)[out:], values(more)])
                common = n - out
                assert 100 * common >= percent * (n + len(other) - common)
                value, owner = jaccard._signatures(np.concatenate([np.sort(base), np.sort(other)]), np.array([0, n, n + len(other)]), order, percent)
                assert set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())
                linked += out + more > 0
    assert linked > 100


def test_shared_passages_do_not_make_a_region(spark, monkeypatch):
    """Pairs of near copies, each of which shares a few shingles with the next pair, are a region each."""
    monkeypatch.setattr(jaccard, "BOUND", 20)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 5)
    large = []
    split = jaccard._split_regions
    monkeypatch.setattr(jaccard, "_split_regions", lambda sets, *a: large.append(sets.count()) or split(sets, *a))
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = [[word() for _ in range(70)] for _ in range(80)]
    texts = [[*a, *b[20:34]] for a, b in zip(texts, [*texts[1:], texts[0]])]
    rows = [(i, " ".join(t)) for i, t in enumerate([x for t in texts for x in (t, [*t[:-1], word()])])]
    want = firsts(rows, 85, 4)
    got = {r["id"]: r["first"] for r in jaccard.classes(with_rid(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {i: rows[k][0] for (i, _), k in zip(rows, want)} and len(set(got.values())) == 80
    assert not large
