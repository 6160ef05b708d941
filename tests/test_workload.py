"""Every query with SQL of its own gives what DuckDB gives, names and rows; verdicts against the arithmetic of counters."""

import random
from collections import Counter
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinplan import workload
from twinplan.operators import compare as C

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = db.sql(workload.ORACLES[name])
    got = workload.QUERIES[name](spark, FOLDER)
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(expected.project(listed).fetchall())


def bags(seed):
    rnd = random.Random(seed)
    rows = [(k, v) for k in (None, 0, 1, -3) for v in (None, "", "x", "X", "x ")]
    some = [rnd.choice(rows) for _ in range(rnd.choice([0, 3, 12]))]
    other = rnd.sample(some, len(some)) if seed % 3 else [rnd.choice(rows) for _ in range(rnd.randint(0, 12))]
    if seed % 3 == 2 and other:
        other[rnd.randrange(len(other))] = rnd.choice(rows)
    return some, other


def test_verdicts_of_random_bags(spark):
    """Thirty pairs in two jobs; the helper columns' names are taken by the tables' own."""
    schema = "`side` int, `de``lta d` string"
    pairs = {f"p{seed}": bags(seed) for seed in range(30)}
    frames = {n: tuple(spark.createDataFrame(x, schema) for x in p) for n, p in pairs.items()}
    want = {}
    for name, (a, b) in pairs.items():
        only_a, only_b = Counter(a) - Counter(b), Counter(b) - Counter(a)
        want[name] = (len(a), len(b), only_a.total(), only_b.total())
    assert {len(set(w[2:])) for w in want.values()} == {1, 2}
    for strategy in ("grouped_counts", "except_all"):
        found = C.compare_all(frames, strategy)
        assert {n: tuple(getattr(e, c) for c in C.COUNTS) for n, e in found.items()} == want
    assert C.verdict(*frames["p1"], "no such strategy").columns == list(C.COUNTS)


def test_a_failing_pair_is_alone(spark):
    good = spark.createDataFrame([(1,)], "x int")
    broken = good.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    floating = good.select(F.col("x").cast("double"))
    found = C.compare_all({"good": (good, good), "broken": (good, broken), "floating": (floating, floating), "renamed": (good, good.toDF("y"))})
    assert found["good"].status == "SNAPSHOT_EQUIVALENT" and found["renamed"] == C.Equality(False)
    assert isinstance(found["floating"], TypeError) and isinstance(found["broken"], Exception) and not isinstance(found["broken"], TypeError)


def test_schemas(spark):
    base = spark.createDataFrame([(1, "a")], "x int, y string")
    same = [base, base.select("x", "y")]
    other = [base.select("y", "x"), base.selectExpr("cast(x as long) x", "y"), base.toDF("X", "y"), base.select("x")]
    assert all(C.schemas_equal(base.schema, d.schema) for d in same) and not any(C.schemas_equal(base.schema, d.schema) for d in other)
    assert C.ordered_schema([(2, "b", "character varying(9)"), (0, "a", "INT4"), (1, "c", "numeric(10, 2)"), (3, "d", "timestamp(3) without time zone")]) == [
        ("a", "int"), ("c", "decimal(10,2)"), ("b", "varchar(9)"), ("d", "timestamp_ntz(3)"),
    ]


def test_rows_of_counts(spark):
    row = lambda *v, names=C.COUNTS: spark.createDataFrame([v], ", ".join(f"{n} long" for n in names)).first()
    assert C.Equality.of_row(row(3, 3, 0, 0)).status == "SNAPSHOT_EQUIVALENT"
    for bad in (row(3, 2, 0, 0), row(1, 1, -1, -1), row(1, 1, 0, None), row(1, 1, 0, names=C.COUNTS[:3]), row(1, 1, 0, 0, 0, names=(*C.COUNTS, "more"))):
        with pytest.raises(ValueError):
            C.Equality.of_row(bad)


def test_text_that_is_run():
    assert C.quote('a`"b') == '`a``"b`' and C.relation("`a`.`b``c`") == "`a`.`b``c`" and C.literal("it's") == "'it''s'"
    for make, bad in ((C.quote, ""), (C.quote, "a\0"), (C.relation, "a.b"), (C.relation, "`a`; drop"), (C.relation, "`a`.`b`.`c`.`d`"), (C.literal, "a\\"), (C.literal, "\0")):
        with pytest.raises(ValueError):
            make(bad)


def test_one_exchange_and_one_scan_a_side(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_custkey", "o_orderstatus")
    plan = C.grouped_verdict(orders, orders.filter("o_custkey > 5"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert reduce(DataFrame.union, [orders, orders]).count() == 2 * orders.count()
