"""The pipeline as a whole against brute force, with ids that repeat and ids that are null."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_near_duplicates import firsts, numbered, texts

from twinplan.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table():
    rnd = random.Random(11)
    some = texts(rnd, 5, 4)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    some = [f"{t} {passage}" if k % 5 == 0 else t for k, t in enumerate(some)]
    some += some[:8] + some[30:36] + ["too short to stay"] * 3 + ["", None]
    rnd.shuffle(some)
    return [(None if k % 4 == 0 else 7 if k % 4 == 1 else k, t) for k, t in enumerate(some)]


def brute(rows):
    """Without labels the base rules alone decide; of them only the one on 50 words tells these texts apart."""
    rows = numbered([r for r in rows if len(WORD.findall(r[1] or "")) >= 50])
    equal = {}
    for r in rows:
        equal.setdefault(r[1], r)
    rows = numbered(equal.values())
    rows = [r for k, (r, first) in enumerate(zip(rows, firsts(rows, 80, 5))) if k == first]
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        out.append((i, len(WORD.findall(bytes(x for x, g in zip(b, gone) if not g).decode()))))
    return out


def test_pipeline(spark, tmp_path):
    rows = table()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter(want)
    assert len(want) > 30 and len({n for _, n in want}) > 2
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches[r["batch_id"]].append(r)
    for batch in batches.values():
        assert sorted(r["place"] for r in batch) == list(range(len(batch)))
        assert len({r["bucket_len"] for r in batch}) == 1
        assert len(batch) == 1 or len(batch) * batch[0]["bucket_len"] <= packing.BUDGET
