"""Edges against all choices of edges, and batches against their rules."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from twinplan.llm import packing
from twinplan.llm.common import with_rid


def padding(edges, lengths):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def least(lengths, most):
    names = sorted(set(lengths))
    return min(padding([*some, names[-1]], lengths) for k in range(min(most, len(names))) for some in combinations(names[:-1], k))


@pytest.mark.parametrize("seed", range(12))
def test_best_edges(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 30), rnd.randint(4000, 9000)]) for _ in range(rnd.randint(1, 14))]
    names = sorted(set(lengths))
    most = rnd.randint(1, 5)
    edges = packing.best_edges(names, [lengths.count(n) for n in names], most)
    assert len(edges) <= most and edges[-1] == names[-1] and edges == sorted(edges)
    assert padding(edges, lengths) == least(lengths, most)


def test_batches(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([0, 1, 2, 3, 7, 8, 30, 31, 5000, 5001, 6000]) for _ in range(300)]
    rows = [(None if k % 7 == 0 else k % 50, None if n == 0 and k % 2 else " ".join(["w"] * n), 1, 2) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, rid int")
    got = packing.pack(with_rid(docs), buckets=4, budget=60, shard=16).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(sizes)
    full = [r for r in got if r["n_tokens"]]
    assert sum(r["padding"] for r in full) == least([n for n in sizes if n], 4)
    batches = defaultdict(list)
    for r in full:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches[r["batch_id"]].append(r)
    for batch in batches.values():
        edge = batch[0]["bucket_len"]
        assert {r["bucket_len"] for r in batch} == {edge} and len(batch) <= max(1, 60 // edge)
        assert sorted(r["place"] for r in batch) == list(range(len(batch)))
    # one batch of a shard at most is short
    short = sum(len(b) < max(1, 60 // b[0]["bucket_len"]) for b in batches.values())
    assert short <= len({(r["batch_id"] >> 24) for r in full})
    assert all(r["batch_id"] is None and r["bucket_len"] == 0 for r in got if not r["n_tokens"])
    assert packing.pack(with_rid(docs.limit(0))).count() == 0
