"""Operators against brute force on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import re

import pytest

from twinplan.llm import bpe, exact, jaccard, langid, lines, packing, quality, recompress, suffixes, warc
from twinplan.llm.common import fresh_path, with_rid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([30, 90, 160]))] for _ in range(8)]
    out = []
    for i in range(150):
        b, k = list(rnd.choice(base)), rnd.random()
        if k < 0.5:
            for _ in range(rnd.randint(0, 4)):
                b[rnd.randrange(len(b))] = rnd.choice(words)
        elif k < 0.6:
            b = [words[0]] * rnd.randint(0, 150)
        elif k < 0.7:
            b = b[: rnd.randint(0, 40)] + rnd.choice(base)
        text = None if 0.7 < k < 0.73 else rnd.choice([" ", "\n", " \t"]).join(b)
        out.append((3 * i - 40, text))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_suffixes(docs, rows):
    seen, expected = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    assert {r["id"]: tuple(r)[1:] for r in suffixes.remove(docs).collect()} == expected


def test_stripped_texts(docs, rows):
    sizes = {r["id"]: (r["n_bytes"], r["n_removed"]) for r in suffixes.remove(docs).collect()}
    for r in suffixes.strip(docs).collect():
        before = dict(rows)[r["doc_id"]]
        n, gone = sizes[r["doc_id"]]
        assert (r["text"] is None) == (before is None)
        # a character of two bytes may stay with one of them in a span
        assert before is None or n - gone <= len(r["text"].encode()) <= n - gone + 2 * before.count("é")
        assert gone or r["text"] == before


def test_recompression(docs, rows):
    first, expected = {}, {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        expected[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    assert {r["id"]: tuple(r)[1:] for r in recompress.remove(docs).collect()} == expected


@pytest.mark.parametrize(("leaf", "size", "percent"), [(64, 4, 85), (4, 4, 85), (4, 5, 80)])
def test_jaccard(docs, rows, leaf, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j > i and a and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard.classes(with_rid(docs), percent, size).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_bpe(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.public_tokenizers.path(bpe.VOCABULARY))
    extra = [(9001, "ΑΣ don't I'LL<|endoftext|>x"), (9002, "a" * 400), (9003, "日本 😀 ½ⅷ"), (9004, "")]
    got = {r["id"]: r for r in bpe.encode(docs.union(docs.sparkSession.createDataFrame(extra, SCHEMA))).collect()}
    for i, text in rows + extra:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["ids"], got[i]["n_tokens"]) == (ids, len(ids))
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, "ab", 3), (2, None, 4), (3, "", 5)], "doc_id long, text string, rid int")
    keyed = with_rid(odd)
    assert sorted(r["kept"] for r in exact.verdicts(keyed).collect()) == [False, False, False, True, True]
    assert exact.dedup(odd).columns == odd.columns
    for table in (odd, odd.limit(0)):
        n, keyed = table.count(), with_rid(table)
        assert suffixes.strip(table).count() == n
        assert recompress.remove(table).count() == n
        assert packing.pack(keyed).count() == n
        assert lines.drop_lines(keyed).count() == n
        assert quality.rules(table, quality.Chain()).filter("kept").count() == 0
        assert {r["lang_pred"] for r in langid.predict(table, langid.Model([], [], langid.np.zeros((1, 0)))).collect()} <= {"und"}


def test_warc_is_the_same_however_dealt(spark):
    rows = [(k, f"http://a/{k}", ("x" * 1500 if k % 3 else f"page {k}" * 40)) for k in range(60)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for n in (2, 5):
        folder = fresh_path(spark, "warc")
        manifest = warc.write(pages.repartition(n), folder, roll=4000)
        found.append(sorted((r["name"], r["bytes"], r["sha256"]) for r in manifest.collect()))
        got = warc.read(spark, folder).collect()
        assert len(got) == 61 and {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {59}
    assert found[0] == found[1] and len(found[0]) > 1


def test_best_edges():
    assert packing.best_edges([1, 2, 9, 10], [5, 5, 1, 1], 2) == [2, 10]
    assert packing.best_edges([4, 7], [1, 1], 5) == [4, 7]
