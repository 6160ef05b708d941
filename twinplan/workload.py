
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinplan import service
from twinplan.examples import MODELS, POSTGRES, corpus_of, gated_corpus, grouped_corpus, predicate_corpus
from twinplan.functions import postgres as P
from twinplan.operators import compare as C
from twinplan.sources import corpus, manifest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return orders, orders.filter("o_orderstatus <> 'F'")


def bag_verdict_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grouped_verdict(*_pair(spark, sf_dir))


def bag_verdict_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.except_all_verdict(*_pair(spark, sf_dir))


def numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("o_totalprice"), F.col("o_totalprice") - 100000
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.abs(y).alias("f_abs"), P.ceil(y).alias("f_ceil"), P.floor(y).alias("f_floor"), P.trunc(y).alias("f_trunc"),
        F.round(F.sqrt(x), 6).alias("f_sqrt"), F.round(P.log(x), 6).alias("f_log"), F.round(F.ln(x), 6).alias("f_ln"),
        F.greatest(x, y).alias("f_greatest"), F.least(x, y).alias("f_least"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("f_nullif"),
    )


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower(name).alias("f_lower"), F.upper(name).alias("f_upper"), F.length(name).cast("long").alias("f_length"),
        F.substring(name, 2, 4).alias("f_substring"), F.replace(name, F.lit("0"), F.lit("o")).alias("f_replace"), P.concat(name, segment).alias("f_concat"),
        F.concat_ws("-", name, segment).alias("f_concat_ws"), F.instr(name, "0").cast("long").alias("f_strpos"), F.split_part(name, F.lit("#"), F.lit(1)).alias("f_split_part"),
        F.coalesce(segment, F.lit("none")).alias("f_coalesce"), F.trim(name).alias("f_trim"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", P.date_trunc("month", d).alias("f_trunc"), P.extract("year", d).alias("f_year"), P.extract("dow", d).alias("f_dow_from_sunday"), d.cast("date").alias("f_date")
    ).withColumn("f_dow_from_sunday", F.col("f_dow_from_sunday") - 1)


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.sum("l_linenumber").alias("total"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    )


def window_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("so_far"))


QUERIES = {
    f.__name__: f
    for f in (bag_verdict_grouped, bag_verdict_except_all, numeric_functions, string_functions, date_functions, aggregates, window_aggregate)
}

_VERDICT = """
WITH b AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders), c AS (SELECT * FROM b WHERE o_orderstatus <> 'F')
SELECT (SELECT count(*) FROM b) AS baseline_rows, (SELECT count(*) FROM c) AS candidate_rows,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c)) AS baseline_only_occurrences,
       (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b)) AS candidate_only_occurrences
"""

ORACLES = {
    "bag_verdict_grouped": _VERDICT,
    "bag_verdict_except_all": _VERDICT,
    "numeric_functions": """
SELECT o_orderkey, abs(y) AS f_abs, ceil(y) AS f_ceil, floor(y) AS f_floor, trunc(y) AS f_trunc, round(sqrt(x), 6) AS f_sqrt, round(log(x), 6) AS f_log,
       round(ln(x), 6) AS f_ln, greatest(x, y) AS f_greatest, least(x, y) AS f_least, nullif(o_orderstatus, 'F') AS f_nullif
FROM (SELECT *, o_totalprice AS x, o_totalprice - 100000 AS y FROM orders)
""",
    "string_functions": """
SELECT c_custkey, lower(c_name) AS f_lower, upper(c_name) AS f_upper, length(c_name) AS f_length, substring(c_name, 2, 4) AS f_substring,
       replace(c_name, '0', 'o') AS f_replace, concat(c_name, s) AS f_concat, concat_ws('-', c_name, s) AS f_concat_ws, strpos(c_name, '0') AS f_strpos,
       split_part(c_name, '#', 1) AS f_split_part, coalesce(s, 'none') AS f_coalesce, trim(c_name) AS f_trim
FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS s FROM customer)
""",
    "date_functions": """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS f_trunc, extract(year FROM o_orderdate) AS f_year,
       extract(dow FROM o_orderdate) AS f_dow_from_sunday, CAST(o_orderdate AS DATE) AS f_date FROM orders
""",
    "aggregates": """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, CAST(sum(l_linenumber) AS BIGINT) AS total,
       min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2
""",
    "window_aggregate": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS so_far FROM orders",
}


# --- the engine's rewrites: Spark runs the candidate, the SQL is the file as it was ---

#: Relations that models name and that are made of a table: for Spark, and for DuckDB where it spells them otherwise.
MADE = {
    "wide": ("SELECT l_orderkey AS id, l_quantity AS qty, " + ", ".join(f"concat(repeat('{c}', 120), l_shipdate) AS w{i}" for i, c in enumerate("abcdefgh")) + " FROM {lineitem}", None),
    "named": ("SELECT o_orderkey AS id, o_custkey AS first, o_orderstatus AS last, o_totalprice AS row, o_orderpriority AS range, o_custkey % 5 AS groups FROM {orders}", None),
    "nested": (
        "SELECT o_orderkey AS id, named_struct('city', o_custkey, 'street', named_struct('number', o_custkey % 7)) AS place, o_orderstatus AS s FROM {orders}",
        "SELECT o_orderkey AS id, {{'city': o_custkey, 'street': {{'number': o_custkey % 7}}}} AS place, o_orderstatus AS s FROM {orders}",
    ),
    "listed": ("SELECT o_orderkey AS id, array(o_custkey, o_custkey + 1, NULL) AS items, o_orderstatus AS kind, o_totalprice AS p FROM {orders}",
               "SELECT o_orderkey AS id, [o_custkey, o_custkey + 1, NULL] AS items, o_orderstatus AS kind, o_totalprice AS p FROM {orders}"),
}
_TABLES = ("lineitem", "orders")


def _spark_relation(sf_dir: str):
    table = lambda name: f"parquet.`{sf_dir}/{name}.parquet`"
    return lambda call: f"({MADE[call.name][0].format(**{t: table(t) for t in _TABLES})})" if call.name in MADE else table(call.name)


def _duck_relation(call) -> str:
    if call.name not in MADE:
        return call.name
    ours, theirs = MADE[call.name]
    return f"({(theirs or ours).format(**{t: t for t in _TABLES})})"


def _candidate(name: str):
    """The candidate that the engine makes of a model; for a narrowed one, its imports must have changed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        candidate, codes = service.candidate_of(MODELS[name].encode())
        if codes != ("OK",) or candidate == MODELS[name].encode():
            raise ValueError(f"{name}: {codes}")
        return spark.sql(service.render(candidate, _spark_relation(sf_dir)))

    run.__name__ = f"rewritten_{name}"
    return run


def _baseline(name: str) -> str:
    return service.render(MODELS[name].encode(), _duck_relation)


REWRITTEN = ("merge_two", "merge_filtered", "narrow_star", "narrow_and_merge", "narrow_chain", "narrow_names", "narrow_left_out", "narrow_paths", "narrow_rows", "reused_wide")


def reused_wide_as_it_was(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide model without narrowing, for comparison with rewritten_reused_wide."""
    return spark.sql(service.render(MODELS["reused_wide"].encode(), _spark_relation(sf_dir)))


def _postgres(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(service.render(POSTGRES[name].encode(), _spark_relation(sf_dir), "postgres"))

    run.__name__ = f"postgres_{name}"
    return run


def _postgres_oracle(name: str) -> str:
    sql = service.render(POSTGRES[name].encode(), lambda call: call.name, "duckdb")
    for ours, theirs in _DUCKDB.get(name, {}).items():
        if ours not in sql:
            raise ValueError(ours)
        sql = sql.replace(ours, theirs)
    return sql


#: What DuckDB spells otherwise than PostgreSQL in these models.
_DUCKDB = {
    "arithmetic": {"trunc(y)": "CAST(trunc(y) AS BIGINT)"},
    "casts": {"-2.5::int": "CAST(-2.5 AS int)"},
    "texts": {"to_number((c_custkey % 90 + 10)::text || '.5', '99D9')::float8": "(c_custkey % 90 + 10.5)::float8", "substring(c_name, 0, 4)": "substring(c_name, 1, 3)", "substr(c_name, -2, 5)": "substr(c_name, 1, 2)", "substring(c_name from 3 for 5)": "substring(c_name, 3, 5)", "btrim(": "trim(",
              "trim(both '#' from '#' || c_mktsegment || '#')": "trim('#' || c_mktsegment || '#', '#')", "position('omer' in c_name)": "strpos(c_name, 'omer')"},
    "times": {"to_char(ts, 'YYYY-MM-DD\"T\"HH24:MI:SS')": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "to_date(to_char(ts, 'DD/MM/YYYY'), 'DD/MM/YYYY')": "CAST(ts AS DATE)",
              "to_timestamp(to_char(ts, 'YYYYMMDD HH24MI'), 'YYYYMMDD HH24MI')::timestamp": "date_trunc('minute', ts)", "to_timestamp(user_id * 1000)::timestamp": "make_timestamp(user_id * 1000 * 1000000)",},
    "clock": {"localtime is": "current_time is", "localtimestamp > ts": "CAST(now() AS TIMESTAMP) > ts"},
}


# --- what a scan finds in generated files, one for each customer ---------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_of(_table(spark, sf_dir, "customer"))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.findings(_corpus(spark, sf_dir)).withColumns({"entries": F.array_join("entries", ","), "reason_codes": F.array_join("reason_codes", ",")})


def relation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = corpus.relation_calls(_corpus(spark, sf_dir))
    return calls.groupBy("kind", "package", "name", "source_name", "version").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("source_path").alias("n_files"))


def corpus_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_imports(corpus.imports(_corpus(spark, sf_dir))).withColumn("entries", F.array_join("entries", ","))


def determinism_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.determinism(gated_corpus(_table(spark, sf_dir, "customer"))).withColumn("reasons", F.array_join("reasons", ","))


def compiled_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the generated files, compiled, import twice: a template may have made it."""
    plain = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), r"(?s)\{#.*?#\}", ""), r"\{\{-?\s*(?:ref|source)\([^)]*?['\"](\w+)['\"](?:,\s*\w+=(\d+))?\)\s*-?\}\}", "wh.$1$2")
    files = _corpus(spark, sf_dir).select("source_path", plain.cast("binary").alias("content"))
    return corpus.compiled_imports(files).withColumn("entries", F.array_join("entries", ","))


def call_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the literal calls of the generated files stand, in bytes and lines."""
    return corpus.relation_calls(_corpus(spark, sf_dir)).select("source_path", "name", "start", "stop", "line")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated files after narrowing and merging, as texts."""
    return corpus.candidates(_corpus(spark, sf_dir)).withColumn("narrowed", F.array_join("narrowed", ","))


def group_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.group_reasons(grouped_corpus(_table(spark, sf_dir, "customer")))
    return found.select("source_path", "upstream", F.array_join("entries", ",").alias("entries"), F.array_join("reason_codes", ",").alias("reason_codes"))


def predicate_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the predicates of a file's two imports have one fingerprint."""
    found = corpus.predicate_prints(predicate_corpus(_table(spark, sf_dir, "customer")))
    return found.groupBy("source_path").agg((F.count_distinct("print") == 1).alias("same"))


def manifest_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls resolved within their owner's dependencies: customers are the models, named by nation in one of two packages, and an order's line is a dependency."""
    customers = _table(spark, sf_dir, "customer")
    uid = lambda c: F.concat(F.lit("model."), c.cast("string"))
    none = F.lit(None).cast("string")
    nodes = customers.select(
        uid(F.col("c_custkey")).alias("uid"), F.lit("ref").alias("kind"), F.concat(F.lit("p"), (F.col("c_custkey") % 2).cast("string")).alias("package"),
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("name"), none.alias("source_name"), none.alias("path"), none.alias("relation"),
    )
    orders = _table(spark, sf_dir, "orders")
    edges = orders.select(uid(F.col("o_orderkey") % 50).alias("owner"), uid(F.col("o_custkey") % 200).alias("uid")).distinct()
    calls = orders.select((F.col("o_orderkey") % 50).alias("k"), (F.col("o_custkey") % 25).alias("n")).distinct().select(
        uid(F.col("k")).alias("owner"), F.lit("ref").alias("kind"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("p"), (F.col("k") % 3 - 1).cast("string"))).alias("package"),
        F.concat(F.lit("m"), F.col("n").cast("string")).alias("name"), none.alias("source_name"),
    )
    return manifest.resolve(calls, nodes, edges).select("owner", "package", "name", "uid", "code")


def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered names and types of each pair of tables, the second with its columns, or the same ones in reverse, or a name changed."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    schemas = {n: _table(spark, sf_dir, n) for n in names}
    forms = {"same": lambda d: d, "reversed": lambda d: d.select(*reversed(d.columns)), "renamed": lambda d: d.withColumnRenamed(d.columns[-1], "other"),
             "fewer": lambda d: d.select(*d.columns[:-1]), "texts": lambda d: d.select(*[F.col(c).cast("string") for c in d.columns])}
    rows = [(a, b, f, C.schemas_equal(schemas[a].schema, make(schemas[b]).schema)) for a in names for b in names for f, make in forms.items()]
    return spark.createDataFrame(rows, "a string, b string, form string, equal boolean")


QUERIES |= {f"rewritten_{k}": _candidate(k) for k in REWRITTEN} | {f"postgres_{k}": _postgres(k) for k in POSTGRES} | {
    f.__name__: f for f in (reused_wide_as_it_was, scan_findings, relation_calls, call_places, corpus_duplicates, compiled_duplicates, candidates, group_reasons, predicate_prints, manifest_resolution, determinism_gate, schema_gate)
}

_FILES = "SELECT 'models/c' || c_custkey || '.sql' AS source_path, c_custkey % 6 AS kind, c_custkey % 4 AS k4, c_nationkey % 2 AS n2, c_nationkey % 3 AS n3, c_nationkey % 4 AS n4 FROM customer"

#: The same files with their texts.
_TEXTS = """SELECT *, CASE kind
  WHEN 0 THEN concat($$with a as (select x, y from {{ ref('t$$, n3, $$') }}), b as (select x, z from {{ ref('t$$, k4, $$') }}) select a.x, b.z, a.y from a join b on a.x = b.x$$)
  WHEN 1 THEN concat($$with a as (select x from {{ source('s$$, n2, $$', 't$$, n3, $$') }}),$$, chr(10), $$b as (select x from {{- source("s0", 't1') -}}) select a.x, b.x as w from a cross join b$$)
  WHEN 2 THEN concat(repeat(chr(10), n4), $$with a as (select * from {{ ref('t$$, n3, $$') }}) select first, row from a$$)
  WHEN 3 THEN concat($${# not read: {{ ref('t9') }} #}$$, chr(10), $$with a as (select x from {{ ref('t$$, n3, $$') }} where x > 1), -- {% raw %}{{ no }}{% endraw %}$$, chr(10),
                     $$b as (select x from {{ ref('t$$, n3, $$') }} where x > 2) select a.x from a join b on a.x = b.x$$)
  WHEN 4 THEN concat($$with a as (select x from {{ ref('p', 't0', v=1) }}), b as (select x from {{ ref('p', 't0', version=$$, n2 + 1, $$) }}) select a.x, b.x as w from a cross join b$$)
  ELSE concat($$with a as (select x + 1 as y from {{ ref('t0') }}), b as (select x from {{ ref('t$$, n2, $$') }}) select a.y, b.x from a cross join b$$) END AS content FROM f"""

ORACLES |= {f"rewritten_{k}": _baseline(k) for k in REWRITTEN if k not in ("narrow_left_out", "narrow_rows")} | {f"postgres_{k}": _postgres_oracle(k) for k in POSTGRES} | {
    "reused_wide_as_it_was": _baseline("reused_wide"),
    "rewritten_narrow_left_out": _baseline("narrow_left_out").replace("* except (", "* EXCLUDE ("),
    "rewritten_narrow_rows": _baseline("narrow_rows").replace("lateral explode(a.items) as e", "unnest(a.items) as e(col)"),
    "scan_findings": f"""
WITH f AS ({_FILES})
SELECT source_path, CASE kind WHEN 1 THEN 's0.t1' WHEN 4 THEN 'p.t0.1' WHEN 5 THEN 't0' ELSE 't' || n3 END AS upstream, CASE kind WHEN 2 THEN 'a' ELSE 'a,b' END AS entries,
       'needs_compiled_analysis' AS status, CASE kind WHEN 2 THEN 'UNUSED_IMPORT_COLUMNS' WHEN 5 THEN 'UNSUPPORTED_IMPORT_SHAPE' ELSE 'NEEDS_COMPILED_ANALYSIS' END AS reason_codes,
       CAST(CASE kind WHEN 2 THEN 1 + n4 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS line
FROM f WHERE (kind = 0 AND n3 = k4) OR (kind = 1 AND n2 = 0 AND n3 = 1) OR kind IN (2, 3) OR (kind IN (4, 5) AND n2 = 0)
""",
    "relation_calls": f"""
WITH f AS ({_FILES}), c AS (
  SELECT source_path, 'ref' AS kind, NULL AS package, 't' || n3 AS name, NULL AS source_name, NULL AS version FROM f WHERE kind IN (0, 2, 3)
  UNION ALL SELECT source_path, 'ref', NULL, 't' || k4, NULL, NULL FROM f WHERE kind = 0
  UNION ALL SELECT source_path, 'ref', NULL, 't' || n3, NULL, NULL FROM f WHERE kind = 3
  UNION ALL SELECT source_path, 'source', NULL, 't' || n3, 's' || n2, NULL FROM f WHERE kind = 1
  UNION ALL SELECT source_path, 'source', NULL, 't1', 's0', NULL FROM f WHERE kind = 1
  UNION ALL SELECT source_path, 'ref', 'p', 't0', NULL, '1' FROM f WHERE kind = 4
  UNION ALL SELECT source_path, 'ref', 'p', 't0', NULL, CAST(n2 + 1 AS VARCHAR) FROM f WHERE kind = 4
  UNION ALL SELECT source_path, 'ref', NULL, 't0', NULL, NULL FROM f WHERE kind = 5
  UNION ALL SELECT source_path, 'ref', NULL, 't' || n2, NULL, NULL FROM f WHERE kind = 5
)
SELECT kind, package, name, source_name, version, count(*) AS n_calls, count(DISTINCT source_path) AS n_files FROM c GROUP BY ALL
""",
    "corpus_duplicates": f"""
WITH f AS ({_FILES})
SELECT source_path, CASE kind WHEN 1 THEN 's0.t1' WHEN 4 THEN 'p.t0.1' ELSE 't' || n3 END AS upstream, 'a,b' AS entries
FROM f WHERE (kind = 0 AND n3 = k4) OR (kind = 1 AND n2 = 0 AND n3 = 1) OR kind = 3 OR (kind = 4 AND n2 = 0)
""",
    "compiled_duplicates": f"""
WITH f AS ({_FILES})
SELECT source_path, CASE kind WHEN 1 THEN 'wh.t1' WHEN 4 THEN 'wh.t01' WHEN 5 THEN 'wh.t0' ELSE 'wh.t' || n3 END AS relation, 'a,b' AS entries, kind <> 5 AS plain
FROM f WHERE (kind = 0 AND n3 = k4) OR (kind = 1 AND n3 = 1) OR kind = 3 OR (kind IN (4, 5) AND n2 = 0)
""",
    "call_places": f"""
WITH f AS ({_FILES}), g AS ({_TEXTS}), n AS (
  SELECT *, unnest(CASE kind WHEN 2 THEN [1] WHEN 3 THEN [2, 4] ELSE [1, 2] END) AS nth FROM g
), p AS (
  SELECT *, array_to_string(string_split(content, '{{{{')[1:nth], '{{{{') AS ahead, array_to_string(string_split(content, '}}}}')[1:nth], '}}}}') AS through FROM n
)
SELECT source_path, regexp_extract(substr(through, length(ahead) + 1), '.(t[0-9]+).[^0-9]', 1) AS name, CAST(strlen(ahead) AS INTEGER) AS start, CAST(strlen(through) + 2 AS INTEGER) AS stop,
       CAST(1 + length(ahead) - length(replace(ahead, chr(10), '')) AS INTEGER) AS line
FROM p
""",
    "candidates": f"""
WITH f AS ({_FILES}), g AS ({_TEXTS})
SELECT source_path,
       CASE WHEN kind = 0 AND n3 = k4 OR kind = 1 AND n2 = 0 AND n3 = 1 OR kind = 4 AND n2 = 0 THEN 'OK' WHEN kind = 3 THEN 'DIFFERENT_PREDICATE' ELSE 'NO_DUPLICATE_IMPORT' END AS code,
       CASE kind WHEN 2 THEN 'a' ELSE '' END AS narrowed,
       CASE WHEN kind = 0 AND n3 = k4 THEN concat('with a as (select x, y, z from {{{{ ref(', chr(39), 't', n3, chr(39), ') }}}}) select a.x, b.z, a.y from a join a as b on a.x = b.x')
            WHEN kind = 1 AND n2 = 0 AND n3 = 1 THEN concat(split_part(content, ',' || chr(10), 1), ' select a.x, b.x as w from a cross join a as b')
            WHEN kind = 4 AND n2 = 0 THEN concat(split_part(content, ', b as', 1), ' select a.x, b.x as w from a cross join a as b')
            WHEN kind = 2 THEN replace(content, '*', 'first, row') ELSE content END AS candidate
FROM g
""",
    "group_reasons": """
WITH b AS (SELECT c_custkey AS k, c_custkey % 2 AS predicate, (c_custkey // 2) % 2 AS collision, (c_custkey // 4) % 2 AS hidden, (c_custkey // 8) % 2 AS star, (c_custkey // 16) % 2 AS volatile FROM customer)
SELECT 'models/c' || k || '.sql' AS source_path, 't' AS upstream, 'a,b' AS entries,
       array_to_string(list_filter([CASE predicate WHEN 1 THEN 'DIFFERENT_PREDICATE' END, CASE collision WHEN 1 THEN 'PROJECTION_COLLISION' END, CASE hidden WHEN 1 THEN 'REFERENCE_BINDING_AMBIGUOUS' END,
         CASE star WHEN 1 THEN 'UNSUPPORTED_IMPORT_SHAPE' END, CASE volatile WHEN 1 THEN 'NONDETERMINISTIC' END], lambda v: v IS NOT NULL), ',') AS reason_codes FROM b
""",
    "predicate_prints": """
WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 4) THEN 0 ELSE c_custkey % 5 END AS a, CASE WHEN c_nationkey % 5 IN (0, 1, 4) THEN 0 ELSE c_nationkey % 5 END AS b FROM customer)
SELECT 'models/c' || c_custkey || '.sql' AS source_path, a = b AS same FROM w
""",
    "manifest_resolution": """
WITH nodes AS (SELECT 'model.' || c_custkey AS uid, 'p' || (c_custkey % 2) AS package, 'm' || c_nationkey AS name FROM customer),
edges AS (SELECT DISTINCT 'model.' || (o_orderkey % 50) AS owner, 'model.' || (o_custkey % 200) AS uid FROM orders),
calls AS (
  SELECT 'model.' || k AS owner, CASE WHEN k % 3 > 0 THEN 'p' || (k % 3 - 1) END AS package, 'm' || n AS name FROM (SELECT DISTINCT o_orderkey % 50 AS k, o_custkey % 25 AS n FROM orders)
), found AS (
  SELECT c.owner, c.package, c.name, count(n.uid) AS n, min(n.uid) AS uid
  FROM calls c LEFT JOIN edges e ON e.owner = c.owner LEFT JOIN nodes n ON n.uid = e.uid AND n.name = c.name AND (c.package IS NULL OR n.package = c.package)
  GROUP BY c.owner, c.package, c.name
)
SELECT owner, package, name, CASE n WHEN 1 THEN uid END AS uid, CASE n WHEN 1 THEN 'OK' ELSE 'SOURCE_MAPPING_AMBIGUOUS' END AS code FROM found
""",
    "determinism_gate": """
SELECT 'models/c' || c_custkey || '.sql' AS source_path, r = '' AS deterministic, r AS reasons FROM (SELECT c_custkey, CASE c_custkey % 10
  WHEN 1 THEN 'volatile: random' WHEN 2 THEN 'order-sensitive: row_number' WHEN 3 THEN 'unknown function: f_of_ours' WHEN 4 THEN 'rows are cut without an order' WHEN 6 THEN 'a frame of rows'
  WHEN 7 THEN 'a sample,unknown function: tablesample' WHEN 9 THEN 'function in a schema: abs' ELSE '' END AS r FROM customer)
""",
    "schema_gate": """
WITH c AS (
  SELECT table_name AS t, list(column_name || ' ' || data_type ORDER BY ordinal_position) AS s, list(column_name || ' VARCHAR' ORDER BY ordinal_position) AS x
  FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') GROUP BY table_name
), f AS (
  SELECT t, 'same' AS form, s FROM c UNION ALL SELECT t, 'reversed', list_reverse(s) FROM c UNION ALL SELECT t, 'fewer', s[1:len(s) - 1] FROM c UNION ALL SELECT t, 'texts', x FROM c
  UNION ALL SELECT t, 'renamed', list_append(s[1:len(s) - 1], 'other') FROM c
)
SELECT a.t AS a, f.t AS b, f.form, a.s = f.s AS equal FROM c a CROSS JOIN f
""",
}
