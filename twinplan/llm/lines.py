"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Texts are cut at LF; a line's words are its runs without space, tab, VT, FF, CR;
null reads as empty. A line is dropped when an earlier one (smaller id, or same
text and further up) has the same words, or, where both have min_words words or
more, when one word inserted, deleted or replaced turns one into the other.
Lines are judged on the input. Lines without a word always stay.

The unit of edit is the word and the bound is one; min_words (MIN_WORDS unless
given) keeps short lines, in which one word is a large part, from being dropped
for another than themselves.

1. Equal lines: a combined aggregate leaves the earliest of each.
2. A pair within one edit shares its first or its last half word for word. Lines
   that share neither half with another are settled here; most are. The others
   are written with their words.
3. They emit their deletion neighbourhood: for each place, the hash of the
   words before it with that of the words after the word there (a deletion), and
   of the words before it with those from there on (the line itself, as what a
   longer line becomes). Only places outside a shared half are emitted.
4. Lines with an equal variant, named by 128 bits, go with the earliest of them,
   one pair for each line and variant; the pair's edit distance is verified on
   the words, and the later line is dropped. A group of any size makes no more
   pairs than it has lines.

Work is linear in the number of lines, and in a line's words but for the hashes
of its beginnings and ends, which take n ** 1.5 steps. Hot halves and hot
variants are counted by combined aggregates, and the joins on them are split by
Spark's adaptive execution.

Repeated rows are dropped line by line but the first; of repeated or null ids
with_rid() says which is first. An empty table gives an empty result; columns
other than id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm.common import discard, with_rid, written

MIN_WORDS = 6
#: Words up to which a line's hashes are summed in one go.
SHORT = 64


def words_of_line(line: Column) -> Column:
    for mark in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _lines(keyed: DataFrame) -> DataFrame:
    return keyed.select("rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))


def _zone(words: Column, z: Column, side: int) -> Column:
    start = F.lit(1) if side == 0 else F.size(words) - z + 1
    return F.xxhash64(F.lit(side), z, F.slice(words, start, z))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def _steps(hashes: Column) -> Column:
    return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda a, h: F.array_append(a, F.element_at(a, -1).bitwiseXOR(h)))


def _chain(words: Column, seed: int) -> Column:
    """Hashes of the first 0, 1, 2, ... words: each word is hashed with its place, and the hashes are joined by XOR."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(F.lit(seed), i, w))

    def in_blocks(h: Column) -> Column:
        # appending copies an array, so a long line is summed in blocks of about the root of its length
        size = F.ceil(F.sqrt(F.size(h))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(h), size), lambda at: _steps(F.slice(h, at, size)))
        join = lambda b: _let(_steps(F.transform(b, lambda x: F.element_at(x, -1))), lambda before: F.flatten(
            F.transform(b, lambda x, i: F.transform(F.slice(x, 2, F.size(x) - 1), lambda y: y.bitwiseXOR(F.get(before, i))))
        ))
        return F.concat(F.array(F.lit(0).cast("long")), _let(blocks, join))

    return F.when(F.size(words) <= SHORT, _steps(hashes)).otherwise(_let(hashes, in_blocks))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced, or nothing, turns a into b."""
    def rest(at: Column) -> Column:
        behind = lambda x, k: F.slice(x, at + k, F.size(x))
        return (behind(a, 1) == behind(b, 1)) | (behind(a, 1) == behind(b, 0)) | (behind(a, 0) == behind(b, 1))

    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return _let(differs, lambda at: F.when(at == 0, F.lit(True)).otherwise(rest(F.greatest(at, F.lit(1)))))


def _variants(words: Column, first_half: Column, last_half: Column) -> Column:
    """Keys of the deletions and of the line itself at each place that may differ."""
    n = F.size(words)
    columns = {f"{side}{k}": F.col(f"{side}{k}") for side in "pq" for k in (1, 2)}

    def key(before: Column, behind: Column) -> Column:
        return F.struct(*[
            F.xxhash64(F.lit(k), F.element_at(columns[f"p{k}"], before.cast("int") + 1), F.element_at(columns[f"q{k}"], behind.cast("int") + 1)).alias(f"k{k}") for k in (1, 2)
        ])
    lo, hi = F.when(first_half & ~last_half, F.floor((n - 1) / 2)).otherwise(0), F.when(last_half & ~first_half, n - F.floor((n - 1) / 2)).otherwise(n)
    deletions = F.transform(F.sequence(lo.cast("int"), F.greatest(lo.cast("int"), hi.cast("int") - 1)), lambda i: key(i, n - i - 1))
    itself = F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda i: key(i, n - i))
    return F.concat(deletions, itself)


def first_lines(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid and stay: the places of the lines that stay because of their words (lines without a word aside)."""
    slim = keyed.select("rid", "text")
    lines = _lines(slim).withColumn("words", words_of_line(F.col("line"))).withColumn("n", F.size("words"))
    half, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    long, words = F.col("n") >= min_words, F.col("words")
    halves = {f"{name}{side}": F.when(ok, _zone(words, z, side)) for name, z, ok in (("half", half, long), ("less", less, long & (less < half))) for side in (0, 1)}
    hashed = lines.filter("n > 0").select(F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "rid", "at", *[c.alias(k) for k, c in halves.items()])
    distinct = written(
        hashed.groupBy("k1", "k2").agg(F.min(F.struct("rid", "at", *halves)).alias("first")).select("first.*"), "distinct_lines"
    )
    zones = F.array(*[F.struct(F.lit(int(k[-1])).alias("side"), F.col(k).alias("zone")) for k in halves])
    every = distinct.filter("half0 is not null").select("rid", "at", F.inline(zones)).filter("zone is not null")
    shared = every.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("zone")
    near = (
        every.join(shared, "zone", "left_semi").groupBy("rid", "at")
        .agg(F.max(F.col("side") == 0).alias("first_half"), F.max(F.col("side") == 1).alias("last_half"))
        .groupBy("rid").agg(F.collect_list(F.struct("at", "first_half", "last_half")).alias("near"))
    )
    picked = lambda ls: F.transform("near", lambda x: F.struct(x["at"].alias("at"), x["first_half"].alias("first_half"), x["last_half"].alias("last_half"), words_of_line(F.get(ls, x["at"])).alias("words")))
    near_lines = written(slim.join(near, "rid").select("rid", F.inline(_let(F.split("text", "\n", -1), picked))), "near_lines")
    variants = written(
        near_lines.select(
            "rid", "at", "words", "first_half", "last_half",
            *[_chain(F.col("words"), k).alias(f"p{k}") for k in (1, 2)], *[_chain(F.reverse("words"), 100 + k).alias(f"q{k}") for k in (1, 2)],
        )
        .select("rid", "at", F.explode(_variants(F.col("words"), F.col("first_half"), F.col("last_half"))).alias("v"))
        .select("rid", "at", "v.k1", "v.k2"),
        "variants",
    )
    least = variants.groupBy("k1", "k2").agg(F.min(F.struct("rid", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", "first")
    pairs = variants.join(least, ["k1", "k2"]).filter((F.col("rid") != F.col("first.rid")) | (F.col("at") != F.col("first.at"))).select("rid", "at", "first").distinct()
    of = lambda rid, at, words: near_lines.select(F.col("rid").alias(rid), F.col("at").alias(at), F.col("words").alias(words))
    verified = (
        pairs.select("rid", "at", F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at"))
        .join(of("rid", "at", "later"), ["rid", "at"]).join(of("first_rid", "first_at", "earlier"), ["first_rid", "first_at"])
        .filter(within_one_edit(F.col("later"), F.col("earlier")))
    )
    dropped = written(verified.select("rid", "at").distinct(), "dropped_lines")
    stay = distinct.select("rid", "at").join(dropped, ["rid", "at"], "left_anti").groupBy("rid").agg(F.collect_list("at").alias("stay"))
    out = written(stay, "first_lines")
    discard(variants, distinct, near_lines, dropped)
    return out


def drop_lines(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each row of with_rid(): rid, id, n_lines, n_removed and the text that is left; null stays null."""
    rows = keyed.select("rid", "id", "text").join(first_lines(keyed, min_words), "rid", "left").withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))

    def left(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda line, i: F.when(F.btrim(line, F.lit(" \t\x0b\x0c\r")) == "", i)), lambda i: i.isNotNull())
        places = F.array_sort(F.concat("stay", blank))
        return F.struct(F.size(lines).alias("n"), F.transform(places, lambda i: F.get(lines, i)).alias("lines"))

    kept = rows.select("rid", "id", _let(F.split("text", "\n", -1), lambda ls: F.when(ls.isNotNull(), left(ls))).alias("left"))
    return kept.select(
        "rid", "id", F.coalesce("left.n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("left.n") - F.size("left.lines"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("left.lines", "\n").alias("text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(with_rid(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM split
), w AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[ \t\x0b\x0c\r]+'), lambda v: v <> '') AS words FROM l
), firsts AS (
  SELECT words, len(words) AS n, min(struct_pack(doc_id := doc_id, pos := pos)) AS place FROM w WHERE len(words) > 0 GROUP BY words
), places AS (
  SELECT *, unnest(range(n + 1)) AS i FROM firsts WHERE n >= 6
), variants AS (
  SELECT place, md5(array_to_string(words[1:i], ' ') || chr(10) || array_to_string(words[i + 2:], ' ')) AS k FROM places WHERE i < n
  UNION ALL
  SELECT place, md5(array_to_string(words[1:i], ' ') || chr(10) || array_to_string(words[i + 1:], ' ')) FROM places
), later AS (
  SELECT DISTINCT v.place FROM variants v JOIN (SELECT k, min(place) AS place FROM variants GROUP BY k) f ON v.k = f.k AND v.place <> f.place
), kept AS (
  SELECT w.doc_id, w.pos, w.line FROM w
  WHERE len(words) = 0 OR struct_pack(doc_id := doc_id, pos := pos) IN (SELECT place FROM firsts EXCEPT SELECT place FROM later)
), texts AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(x), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(x), 0) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN split s ON s.doc_id = d.doc_id LEFT JOIN texts t ON t.doc_id = d.doc_id
"""
