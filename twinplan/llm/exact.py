"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after white space (space, tab, LF, VT,
FF, CR) is deleted; null counts as empty. Of equal texts the row with the most
code points in its original text stays, then that with the smallest id (null
ids last; of repeated ids any one).

1. Each row is reduced to (rid, id, code points, SHA-256 of the normalised
   text), written once to the shared folder.
2. DataFrame.stat.freqItems, Spark's Misra-Gries counters, names at most
   1 / support digests, among them all that have more than that share of rows.
3. An exact, map-side combined aggregate verifies them and finds their winners.
   At most 1 / support rows: broadcast. Rows with such digests are settled by
   the map side alone and never shuffled.
4. Every other digest has at most that share of the rows and goes through one
   ordinary shuffle.

Empty tables give empty results; columns other than id and text, whatever their
names, pass through dedup() unchanged. A text is hashed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinplan.llm.common import SPACES, parts, rows_without, with_rid, written

#: Share of all rows from which on a digest counts as heavy; 1 / support counters are kept. With more than 1 / SUPPORT partitions it is a partition's share, down to LEAST.
SUPPORT, LEAST = 1e-3, 1e-4


def digests(keyed: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return keyed.select(
        "rid", "id", F.length(text).cast("long").alias("n_code_points"), F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256")
    )


def verdicts(keyed: DataFrame, support: float | None = None) -> DataFrame:
    """rid, id, keep_rid, keep_id, group_size, kept, text_sha256, of each row of with_rid()."""
    if support is None:
        support = max(LEAST, min(SUPPORT, 1 / parts(keyed.sparkSession, keyed)))
    d = written(digests(keyed), "digests")
    best = F.min(F.struct((-F.col("n_code_points")).alias("less"), F.col("rid"), F.col("id")))
    frequent = d.stat.freqItems(["text_sha256"], support).select(F.explode(F.array_distinct("text_sha256_freqItems")).alias("text_sha256"))
    heavy = written(  # once: the counters may differ from run to run, the winners and the removal must not
        d.join(F.broadcast(frequent), "text_sha256")
        .groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")),
        "heavy",
    )
    settled = d.join(F.broadcast(heavy), "text_sha256")
    light = d.join(F.broadcast(heavy), "text_sha256", "left_anti")
    same = Window.partitionBy("text_sha256")
    shuffled = light.withColumns({"best": best.over(same), "group_size": F.count(F.lit(1)).over(same)})
    return settled.unionByName(shuffled).select(
        "rid", "id",
        F.col("best.rid").alias("keep_rid"), F.col("best.id").alias("keep_id"),
        "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keyed = with_rid(docs, id_col, text_col, rows=True)
    return rows_without(keyed, verdicts(keyed, support).filter("not kept"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(with_rid(docs)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
