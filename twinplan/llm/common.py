"""Helpers shared by the training-data operators: shared storage, row keys, sizes, text blocks."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, and nothing else: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, with its scheme: spark.checkpoint.dir.

    Only where that is unset and all runs in one process, it is a folder of our
    own; on a cluster other machines would not see that, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!//)", "file:///", full).rstrip("/")


#: The tables that this driver has written and not deleted.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe from lost executors.

    Results are lazy and read such tables, so an operator deletes only those that
    its result does not need; clean() deletes the rest once results are used.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _WRITTEN.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


def clean(spark: SparkSession) -> None:
    """Deletes every table of written(). Results of operators that are not used yet cannot be computed afterwards."""
    while _WRITTEN:
        _delete(spark, _WRITTEN[-1])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if folder in _WRITTEN:
        _WRITTEN.remove(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose plans nothing refers to any more.

    Spark deletes them when the driver's garbage is collected, which by itself may
    come long after; on full disks that is too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns what this process has freed to the system; where the C library has no malloc_trim, only Arrow's part."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For functions of mapInArrow: once a task's last batch is out, its memory is given back.

    Workers wait for other tasks, as many as an executor ever had at once; what
    they have freed but not returned would count against it all that time.
    """

    @functools.wraps(f)
    def run(*args, **kwargs):
        yield from f(*args, **kwargs)
        give_back()

    return run


def parts(spark: SparkSession, df: DataFrame | None = None, times: float = 1.0) -> int:
    """How many partitions a keyed shuffle gets: the session's setting, and no fewer than times the input's splits."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, int(df.rdd.getNumPartitions() * times)) if df is not None else n


def is_key(df: DataFrame, name: str) -> bool:
    """Whether the column is never null and never repeats: one pass over the column alone, combined before the shuffle."""
    return not df.groupBy(F.col(name).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k is null or n > 1").take(1)


def with_rid(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """Columns rid (long, unique), id and text; with rows, also row: all columns of df as one struct.

    Where the ids are unique and not null, rid is the id. Where ids repeat or
    are null, rid numbers the rows in the order id (nulls last), text (nulls
    first), so that every later tie is broken the same way on each run. Ids must
    be numbers that a long holds; Spark refuses others.
    """
    slim = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if rows else []),
    )
    rest = slim.columns
    if is_key(df, id_col):
        return slim.select(F.col("id").alias("rid"), *rest)
    spark, order = df.sparkSession, [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = written(
        slim.repartitionByRange(parts(spark, df), *order, F.rand(7)).sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id() % F.lit(1 << 33)}),
        "numbered",
    )
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    if not sizes:
        return dealt.select(F.lit(0).cast("long").alias("rid"), *rest)
    return dealt.join(running_total(spark, [(r["part"], r["n"]) for r in sizes]), "part").select((F.col("before") + F.col("at")).alias("rid"), *rest)


def running_total(spark: SparkSession, sizes: list[tuple[int, int]]) -> DataFrame:
    """part and before (the total of the parts before it): a row for each partition, which bounds what is broadcast."""
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    return F.broadcast(spark.createDataFrame([(part, b) for (part, _), b in zip(sizes, before)], "part int, before long"))


#: Row numbers that an anti-join may broadcast (8 bytes each); more are joined by a shuffle.
FEW = 4_000_000


def where_few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of row numbers, to be joined to texts: broadcast where it has few rows, so that texts stay where they are; else hashed after a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("shuffle_hash")


def rows_without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of with_rid(rows=True) whose rid is not in dropped, with their own columns.

    Few rows are dropped as a rule, so they go to the texts and not the texts to
    them; only where they are more than FEW do both meet in a shuffle.
    """
    return keyed.join(where_few(written(dropped.select("rid"), "dropped")), "rid", "left_anti").select("row.*")


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int) -> tuple[np.uint64, np.uint64]:
    """An odd 64-bit base made from seed, and its inverse modulo 2**64."""
    b = (int(mix(np.array([seed], np.uint64))[0]) << 1 | 1) & (1 << 64) - 1
    return np.uint64(b), np.uint64(pow(b, -1, 1 << 64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, seed: int):
        self.base, self.inverse = odd(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse)], dtype=np.uint64)
        return self.up, self.down


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols in constant time each."""

    def __init__(self, symbols: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def first_of_groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order (stable, by keys, the first key leading), and for each place of it: whether a group begins, and the group's number."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    return order, new, np.cumsum(new) - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted and merged where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, s[1:] > e[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]
    return s[new], e[last]


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)
