"""Optimal length buckets and token-budget batches.

A text's length is its number of words (runs without space, tab, LF, VT, FF, CR;
null has none). The global histogram goes to the driver: a row for each length
that occurs, so it has at most as many rows as the longest text has words, and
no more with more documents of the same lengths. Dynamic programming over it
chooses the BUCKETS upper edges, fewer where fewer lengths occur, that minimise
the total padding; the recurrence is a lower envelope of lines, so a bucket
costs one pass. Of equally good edges any may be chosen, the same on each run.

In a bucket of edge e a batch takes max(1, BUDGET // e) texts. A bucket is cut by
a hash of the row into shards of some SHARD rows; batches form inside each shard
by position, so no task holds a whole bucket, and a shard's last batch may be
short. Texts without a word are in no batch: bucket_len 0, batch_id null. A text
longer than the budget is a batch of its own.

Repeated rows and null ids are rows like others (see with_rid); an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinplan.llm.blocks import text_blocks, words_of
from twinplan.llm.common import lean, with_rid, written

BUCKETS, BUDGET, SHARD = 16, 1 << 16, 1 << 14


@lean
def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        n = np.diff(words_of(block).first)
        yield pa.RecordBatch.from_arrays([block.rows.column("rid"), block.rows.column("id"), pa.array(n.astype(np.int64))], ["rid", "id", "n_tokens"])


def best_edges(edge: list[int], count: list[int], most: int) -> list[int]:
    """Upper edges of at most `most` buckets with the least total of edge times count; edge is ascending."""
    m = len(edge)
    if m <= most:
        return list(edge)
    before = np.cumsum([0, *count]).tolist()
    cost = [0] + [float("inf")] * m
    choice = []
    for _ in range(most):
        # cost[i] - before[i] * x are lines of falling slope, asked at rising x
        new, back, hull, head = [0] * (m + 1), [0] * (m + 1), [], 0
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] != float("inf"):
                line = (-before[i], cost[i], i)
                while len(hull) - head >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = edge[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                a, b, i = hull[head]
                new[j], back[j] = x * before[j] + a * x + b, i
            else:
                new[j] = float("inf")
        new[0] = float("inf")
        choice.append((new, back))
        cost = new
    k = min(range(most), key=lambda k: choice[k][0][m])
    out, j = [], m
    while j > 0:
        out.append(edge[j - 1])
        j = choice[k][1][j]
        k -= 1
    return out[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(keyed: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """For each row of with_rid(): rid, id, n_tokens, bucket_len, batch_id, place (in the batch, from 0), padding."""
    lengths = written(keyed.select("rid", "id", "text").mapInArrow(_lengths, "rid long, id long, n_tokens long"), "lengths")
    full = lengths.filter("n_tokens > 0")
    histogram = full.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    length, count = (histogram.column(c).to_pylist() for c in ("n_tokens", "n"))
    edges = best_edges(length, count, buckets)
    upto = np.cumsum([0, *count])[np.searchsorted(length, [0, *edges], "right")].tolist()
    rows = {e: b - a for e, a, b in zip(edges, upto, upto[1:])}
    bucket = F.lit(0).cast("long")
    for e in reversed(edges):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(bucket)
    shards = F.coalesce(*[F.when(F.col("bucket_len") == e, F.lit(-(-n // shard))) for e, n in rows.items()], F.lit(1))
    number = F.coalesce(*[F.when(F.col("bucket_len") == e, F.lit(k)) for k, e in enumerate(edges)], F.lit(0))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    dealt = full.withColumn("bucket_len", bucket).withColumn("hash", F.xxhash64("rid")).withColumn("shard", F.pmod("hash", shards.cast("long")))
    at = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("hash", "rid")) - 1
    placed = dealt.withColumn("at", at.cast("long")).select(
        "rid", "id", "n_tokens", "bucket_len",
        (F.shiftleft(number.cast("long"), 56) + F.shiftleft(F.col("shard"), 24) + F.floor(F.col("at") / room)).alias("batch_id"),
        (F.col("at") % room).alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
    empty = lengths.filter("n_tokens = 0").select(
        "rid", "id", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("padding")
    )
    return placed.unionByName(empty)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_rid(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("rid").withColumnRenamed("id", "doc_id")
