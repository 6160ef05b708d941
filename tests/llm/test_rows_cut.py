"""Rows whose text has no repeat are not shuffled when repeats are cut out."""

import random

import pytest

from twinplan.llm import repeats, suffixes


def without(rows):
    """The texts, in the order of their ids, without the bytes of 100-byte strings that also start earlier."""
    seen, out = set(), {}
    for i, t in rows:
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(t[s : s + 100])
        out[i] = "".join(c for c, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize("few", [repeats.FEW, 0])
def test_only_rows_with_a_repeat_meet_their_spans(spark, monkeypatch, few):
    monkeypatch.setattr(repeats, "FEW", few)
    sent = []
    with_texts = repeats._with_texts
    monkeypatch.setattr(repeats, "_with_texts", lambda keyed, *a: sent.append(keyed.count()) or with_texts(keyed, *a))
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(130)
    rows = [(i, text(300) + (passage if i in (3, 11, 20) else "")) for i in range(40)]
    want = without(rows)
    got = suffixes.strip(spark.createDataFrame([(i, t, i % 3) for i, t in rows], "doc_id long, text string, more int"))
    assert {r["doc_id"]: (r["text"], r["more"]) for r in got.collect()} == {i: (t, i % 3) for i, t in want.items()}
    assert sum(want[i] != t for i, t in rows) == 2
    assert sent[-1] == (2 if few else 40)
