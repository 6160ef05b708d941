"""Connected components by alternating stars, in DataFrame functions, one table a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinplan.llm.common import lean, written


#: Up to so many edges (16 bytes each) one task finds the components; beyond, rounds over the whole cluster do.
ONE_TASK = 500_000


@lean
def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [np.stack([np.asarray(b.column("u")), np.asarray(b.column("v"))]) for b in batches if b.num_rows]
    if not pairs:
        return
    name, at = np.unique(np.concatenate(pairs, 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(name))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(name))
    yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(name[label[on]])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the edges (a, b), but the components' least nodes.

    Large stars and small stars take turns until nothing changes, which takes a
    number of rounds about logarithmic in the longest path. A star's least node
    is found by a combined aggregate.
    """
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        return written(now.repartition(1).mapInArrow(_in_one_task, "node long, component long"), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.*").filter("u != v").distinct(), "edges")
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(r)
