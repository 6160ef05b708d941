"""Repeated and null ids, null and empty texts, ties, repeated rows, columns with clashing names, and empty tables, with values."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from tests.llm.test_near_duplicates import firsts, numbered

from twinplan.llm import bpe, exact, jaccard, lines, recompress, suffixes, warc
from twinplan.llm.common import clean, fresh_path, with_rid, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rid string, id int, row string, part long, kind string, n_tokens int"


def rows():
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    some = [" ".join(rnd.choice(words) for _ in range(n)) for n in (70, 70, 120, 8, 8, 3)]
    near = [some[0].rsplit(" ", 1)[0] + " zz", some[3].replace(" ", "  "), some[3] + " zz", "\n".join([some[4], some[3], "", "  ", some[4]])]
    texts = [None, "", " \n\t", *some, *some[:4], *near, some[2][:400] + some[1]]
    out = [(None if k % 4 == 3 else k % 5, t) for k, t in enumerate(texts)]
    return [(i, t, "r", k, "w", k, "text", 1) for k, (i, t) in enumerate([*out, *out[:3], out[4]])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ordered():
    return numbered([r[:2] for r in rows()])


def test_suffixes(odd):
    seen, want = set(), []
    for i, t in ordered():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(x for x, g in zip(b, gone) if not g))))
    assert Counter(map(tuple, suffixes.remove(odd).collect())) == Counter(want) and sum(w[2] for w in want) > 500
    assert suffixes.strip(odd).columns == odd.columns and suffixes.strip(odd).filter("text is null").count() == sum(t is None for _, t in ordered())
    assert suffixes.remove(odd.limit(0)).count() == 0


def test_recompression(odd):
    first, want = {}, []
    split = [(k, i, WORD.findall(t or "")) for k, (i, t) in enumerate(ordered())]
    for k, _, w in split:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), k)
    for k, i, w in split:
        gone = {j for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < k for j in range(s, s + 50)}
        want.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    assert Counter(map(tuple, recompress.remove(odd).collect())) == Counter(want) and sum(w[2] for w in want) > 100
    assert recompress.remove(odd.limit(0)).count() == 0


def test_classes(odd):
    some = ordered()
    label = firsts(some, 85, 4)
    got = Counter((r["id"], r["n"], r["component"]) for r in jaccard.classes(with_rid(odd)).collect())
    sets = [WORD.findall(t or "") for _, t in some]
    size = [len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if len(w) > 3 else int(bool(w)) for w in sets]
    assert got == Counter((i, n, some[k][0]) for (i, _), n, k in zip(some, size, label)) and len(set(label)) < len(label) - 4
    assert jaccard.classes(with_rid(odd.limit(0))).count() == 0
    assert jaccard.dedup(odd).columns == odd.columns and jaccard.dedup(odd.limit(0)).count() == 0


def within_one(a, b):
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a == b or a[n + 1 :] == b[n + 1 :] or a[n + 1 :] == b[n:] or a[n:] == b[n + 1 :]


@pytest.mark.parametrize("least", [6, 2])
def test_lines(odd, least):
    split = [(k, i, t, None if t is None else t.split("\n")) for k, (i, t) in enumerate(ordered())]
    seen, want = [], []
    for _, i, t, parts in split:
        kept = []
        for part in parts or []:
            w = WORD.findall(part)
            gone = any(w == v or min(len(w), len(v)) >= least and within_one(w, v) for v in seen)
            if w and w not in seen:
                seen.append(w)
            if not w or not gone:
                kept.append(part)
        want.append((i, len(parts or []), len(parts or []) - len(kept), None if t is None else "\n".join(kept)))
    got = [(r["id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.drop_lines(with_rid(odd), least).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 5
    assert lines.drop_lines(with_rid(odd.limit(0))).count() == 0


def test_long_lines_and_one_word_edits(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHORT", 4)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(9)}" for _ in range(150)]
    forms = [base, base[:70] + base[71:], base[:70] + ["x"] + base[70:], [*base[:9], "y", *base[10:]], base[2:], [*base[:9], "y", *base[10:100], "z", *base[101:]], base[::-1]]
    docs = spark.createDataFrame([(k, " ".join(f)) for k, f in enumerate(forms)], "doc_id long, text string")
    want, seen = {}, []
    for k, f in enumerate(forms):
        want[k] = int(any(within_one(f, v) for v in seen))
        seen.append(f)
    assert {r["id"]: r["n_removed"] for r in lines.drop_lines(with_rid(docs)).collect()} == want and 2 < sum(want.values()) < 6


def test_equal_texts(odd):
    some = ordered()
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in some]
    best = {}
    for k, b in enumerate(bare):
        best[b] = min(best.get(b, k), k, key=lambda j: (-len(some[j][1] or ""), j))
    got = exact.verdicts(with_rid(odd)).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((i, some[best[b]][0], bare.count(b), best[b] == k, sha(b)) for k, ((i, _), b) in enumerate(zip(some, bare)))
    assert exact.dedup(odd).count() == len(best) and exact.dedup(odd.limit(0)).count() == 0


def test_encoding_and_archives_of_odd_tables(spark, odd):
    assert {r["n_tokens"] for r in bpe.encode(odd).filter("text is null").collect()} <= {0} if "text" in bpe.encode(odd).columns else bpe.encode(odd).count() == len(rows())
    assert bpe.encode(odd.limit(0)).count() == 0
    pages = odd.selectExpr("doc_id as page_id", "text as html", "cast(null as string) as url", "id as digest", "rid as size")
    folder = fresh_path(spark, "warc")
    warc.write(pages, folder, least=5, roll=300)
    got = warc.read(spark, folder).collect()
    payloads = Counter((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for i, t in ordered())
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"]) for r in got) == payloads
    empty = fresh_path(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_every_stage(spark, odd, tmp_path):
    """Each stage takes what has repeated and null ids, and nothing; all but the last give the columns they got."""
    spark.createDataFrame([(0, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            got = stage(spark, table, str(tmp_path))
            assert got.columns == odd.columns or name == "packing"
            assert got.count() <= table.count()


def test_clean_deletes_what_was_written(spark):
    table = written(spark.range(3), "held")
    assert table.count() == 3
    clean(spark)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        table.count()
