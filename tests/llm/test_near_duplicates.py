"""The near-duplicate stage against brute force, where ids repeat, are null, or equal row numbers."""

import random
import re
from collections import Counter

import pytest

from twinplan.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbered(rows):
    """The rows in the order of with_rid(): id (nulls last), then text (nulls first)."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def firsts(rows, percent, size):
    """For each row, in order, the place of the first row it is connected with by links."""
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if v == hi else v for v in label]
    return label


def texts(rnd, families, copies):
    """Near copies of `families` unrelated texts, then texts that have no copy."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(families):
        base = [word() for _ in range(60)]
        for k in range(copies):
            out.append(" ".join([*base[:-1], word()] if k else base))
    return out + [" ".join(word() for _ in range(60)) for _ in range(30)]


def kinds(rnd):
    some = texts(rnd, 6, 4)
    rnd.shuffle(some)
    return {
        "hot id": [(7 if i % 3 else i, t) for i, t in enumerate(some)],
        "null ids": [(None if i % 2 else i, t) for i, t in enumerate(some)],
        "all null": [(None, t) for t in [*some, "", None, "short one"]],
        "ids like row numbers": [(None if i < 20 else i - 20 + len(some) - 20, t) for i, t in enumerate(some)],
    }


@pytest.mark.parametrize("kind", ["hot id", "null ids", "all null", "ids like row numbers"])
def test_one_row_of_each_class_stays(spark, kind):
    rows = kinds(random.Random(5))[kind]
    ordered = numbered(rows)
    want = Counter(r for i, (r, first) in enumerate(zip(ordered, firsts(ordered, 80, 5))) if i == first)
    got = jaccard.dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, words=5).collect()
    assert Counter(map(tuple, got)) == want
