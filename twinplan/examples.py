"""Model files over the test tables, for queries and tests: some can be narrowed or merged, some must not be touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS: dict[str, str] = {
    "merge_two": """with a as (select o_orderkey, o_custkey from {{ ref('orders') }}),
b as (select o_orderkey, o_orderstatus from {{ ref('orders') }})
select a.o_orderkey, a.o_custkey, b.o_orderstatus from a join b on a.o_orderkey = b.o_orderkey
""",
    "merge_filtered": """with first as (
  select
    c_custkey,
    c_name as label
  from {{ ref('customer') }}
  where c_mktsegment = 'BUILDING'
),
second as (
  select
    c_custkey,
    c_nationkey
  from {{ ref('customer') }}
  WHERE c_mktsegment = 'BUILDING'
),
counted as (select s.c_nationkey, count(*) as n from second as s group by s.c_nationkey)
select first.c_custkey, first.label, counted.n
from first
join second as own on first.c_custkey = own.c_custkey
join counted on counted.c_nationkey = own.c_nationkey
""",
    "narrow_star": """with lines as (select * from {{ ref('lineitem') }} where l_linenumber > 2)
select l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers from lines group by l_returnflag
""",
    "narrow_and_merge": """with a as (select * from {{ ref('orders') }}), b as (select * from {{ ref('orders') }})
select a.o_orderkey, b.o_orderstatus from a join b on a.o_orderkey = b.o_orderkey
""",
    "narrow_chain": """with a as (select * from {{ ref('orders') }}), b as (select a.* from a where o_custkey > 10), c as (select * from b where o_orderstatus <> 'F')
select o_orderkey from c
""",
    "other_filter": """with a as (select o_orderkey from {{ ref('orders') }} where o_orderstatus = 'F'), b as (select o_orderkey from {{ ref('orders') }} where o_orderstatus = 'O')
select a.o_orderkey from a left join b on a.o_orderkey = b.o_orderkey
""",
    "shown_all": """with a as (select * from {{ ref('orders') }})
select * from a
""",
    "cut_without_order": """with a as (select o_orderkey from {{ ref('orders') }}), b as (select o_orderkey from {{ ref('orders') }})
select a.o_orderkey from a join b using (o_orderkey) limit 5
""",
    "volatile": """with a as (select o_orderkey from {{ ref('orders') }})
select o_orderkey, random() as r from a
""",
    "sources": """with a as (select n_name from {{ source('raw', 'nation') }}), b as (select n_name from {{ source('raw', 'nation') }}) select a.n_name from a cross join b
""",
    "reused_wide": """with lines as (select * from {{ ref('wide') }}), first as (select id, sum(qty) as total from lines group by id), second as (select id, count(*) as n from lines where qty > 10 group by id)
select first.id, first.total, second.n from first join second on first.id = second.id where first.id < 10
""",
    "narrow_names": """with a as (select * from {{ ref('named') }}), b as (select id, first, last, row, range from {{ ref('named') }} where groups > 0)
select a.id, a.first, b.range as filter, max(b.row) over (partition by a.last order by a.id range between unbounded preceding and current row) as current
from a join b on a.id = b.id where a.last is not null and a.row > 100000 order by a.first nulls last, a.id
""",
    "narrow_left_out": """with a as (select * from {{ ref('orders') }}), b as (select * except (o_orderpriority) from a where o_custkey > 10)
select o_orderkey, o_orderstatus from b
""",
    "narrow_paths": """with a as (select * from {{ ref('nested') }})
select a.id, a.place.city as city, a.place.street.number as number from a where a.place.city > 20
""",
    "narrow_rows": """with a as (select * from {{ ref('listed') }})
select a.id, e.col as item from a, lateral explode(a.items) as e where a.kind <> 'F'
""",
}

#: Models in PostgreSQL's SQL; Spark runs them in translation.
POSTGRES: dict[str, str] = {
    "arithmetic": """with a as (select o_orderkey, o_totalprice, o_custkey, o_orderstatus from {{ ref('orders') }}), x as (select o_orderkey as id, o_totalprice - 100000 as y, o_custkey as k, o_orderstatus as s from a)
select id, 2 ^ 3 as f_power, -2 ^ 2 as f_sign, power(k % 5, 2) as f_pow, round((exp(k % 7) + ln(k + 1))::numeric(20, 6), 4)::double precision as f_exp, round(log(1000.0)::numeric(10, 4), 2)::float8 as f_log, trunc(y) as f_trunc, abs(y) as f_abs, round(y::numeric(20, 6), 1)::float8 as f_round, sqrt(16 + k % 2 * 0) as f_sqrt from x
""",
    "casts": """select o_orderkey as id, cast(o_totalprice as bigint) as f_big, (o_totalprice / 7)::int as f_int, '2.5'::numeric(4, 1)::int as f_text, -2.5::int as f_half, o_custkey::text || '/' || o_orderstatus as f_joined, (o_custkey % 2)::bool as f_bool,
  o_orderdate::date as f_date from {{ ref('orders') }}
""",
    "conditions": """select o_orderkey as id, case when o_orderstatus = 'F' and o_custkey > 100 then 'late' when o_orderstatus = 'O' or o_custkey < 10 then 'open' else null end as f_case,
  case o_orderpriority when '5-LOW' then 0 else 1 end as f_switch, (o_custkey > 50 and nullif(o_orderstatus, 'F') = 'O') as f_and, (o_custkey > 50 or nullif(o_orderstatus, 'F') = 'O') as f_or, coalesce(nullif(o_orderstatus, 'F'), 'none') as f_coalesce,
  greatest(o_custkey, 500, null) as f_greatest, least(o_custkey, 500) as f_least from {{ ref('orders') }}
""",
    "texts": """select c_custkey as id, concat(c_name, null, '-', nullif(c_mktsegment, 'BUILDING')) as f_concat, substring(c_name, 0, 4) as f_before, substring(c_name from 3 for 5) as f_from, substr(c_name, -2, 5) as f_negative, substr(c_name, 7) as f_rest,
  ltrim(c_name, 'Cu') as f_ltrim, rtrim(c_name, '0123456789') as f_rtrim, btrim('  ' || c_mktsegment || ' ') as f_btrim, trim(both '#' from '#' || c_mktsegment || '#') as f_trim, strpos(c_name, '#')::int8 as f_strpos, to_number((c_custkey % 90 + 10)::text || '.5', '99D9')::float8 as f_number, position('omer' in c_name)::int8 as f_position,
  split_part(c_name, '#', 2) as f_split, replace(c_name, 'Customer', 'it''s \\') as f_replace, char_length(c_name)::int8 as f_length, concat_ws('|', c_mktsegment, null, c_name) as f_ws, upper(lower(c_name)) as f_upper from {{ ref('customer') }}
""",
    "times": """select event_id as id, extract(dow from ts)::int8 as f_dow, extract(isodow from ts)::int8 as f_isodow, date_part('year', ts)::int8 as f_year, extract(doy from ts)::int8 as f_doy, floor(extract(epoch from ts))::int8 as f_epoch, date_trunc('hour', ts) as f_hour,
  to_char(ts, 'YYYY-MM-DD"T"HH24:MI:SS') as f_char, to_date(to_char(ts, 'DD/MM/YYYY'), 'DD/MM/YYYY') as f_date, to_timestamp(to_char(ts, 'YYYYMMDD HH24MI'), 'YYYYMMDD HH24MI')::timestamp as f_stamp, to_timestamp(user_id * 1000)::timestamp as f_from_epoch from {{ ref('events') }}
""",
    "clock": """select event_type as kind, count(*) as n, count(distinct user_id) as users, min(ts) as first, max(ts) as last, round(avg(value)::numeric(20, 8), 4)::float8 as f_avg from {{ ref('events') }}
where now() > ts and current_timestamp > ts and current_date > ts::date and localtimestamp > ts and current_time is not null and localtime is not null group by event_type
""",
}


def corpus_of(customers: DataFrame) -> DataFrame:
    """source_path and content: a model file for each customer, of a kind that its key tells, over relations that its key and nation tell."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    t = lambda x: F.concat(F.lit("t"), x.cast("string"))
    ref = lambda name, more="": F.concat(F.lit("{{ ref('"), name, F.lit(f"'{more}) }}}}"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one, other = t(n % 3), t(k % 4)
    kinds = [
        say("with a as (select x, y from ", ref(one), "), b as (select x, z from ", ref(other), ") select a.x, b.z, a.y from a join b on a.x = b.x"),
        say("with a as (select x from {{ source('s", (n % 2).cast("string"), "', '", one, "') }}),\nb as (select x from {{- source(\"s0\", 't1') -}}) select a.x, b.x as w from a cross join b"),
        say(F.repeat(F.lit("\n"), n % 4), "with a as (select * from ", ref(one), ") select first, row from a"),
        say("{# not read: ", ref(F.lit("t9")), " #}\nwith a as (select x from ", ref(one), " where x > 1), -- {% raw %}{{ no }}{% endraw %}\nb as (select x from ", ref(one), " where x > 2) select a.x from a join b on a.x = b.x"),
        say("with a as (select x from {{ ref('p', 't0', v=1) }}), b as (select x from {{ ref('p', 't0', version=", (n % 2 + 1).cast("string"), ") }}) select a.x, b.x as w from a cross join b"),
        say("with a as (select x + 1 as y from ", ref(F.lit("t0")), "), b as (select x from ", ref(t(n % 2)), ") select a.y, b.x from a cross join b"),
    ]
    content = F.coalesce(*[F.when(k % 6 == i, text) for i, text in enumerate(kinds)])
    return customers.select(say("models/c", k.cast("string"), ".sql").alias("source_path"), content.cast("binary").alias("content"))


def gated_corpus(customers: DataFrame) -> DataFrame:
    """The same for the determinism gate: what is called, framed, sampled or cut is told by the key."""
    k = F.col("c_custkey")
    tails = ["abs(x) as y from a", "random() as y from a", "row_number() over (order by x) as y from a", "f_of_ours(x) as y from a", "x from a limit 3", "x from a order by x limit 3",
             "sum(x) over (order by x rows between 1 preceding and current row) as y from a", "x from a tablesample (10)", "now() as y from a", "s.abs(x) as y from a"]
    text = F.concat(F.lit("with a as (select x from {{ ref('t0') }}) select "), F.coalesce(*[F.when(k % len(tails) == i, F.lit(x)) for i, x in enumerate(tails)]))
    return customers.select(F.concat(F.lit("models/c"), k.cast("string"), F.lit(".sql")).alias("source_path"), text.cast("binary").alias("content"))


def predicate_corpus(customers: DataFrame) -> DataFrame:
    """A model of two imports for each customer, whose predicates are spelled in one of five ways that the key tells, and one that the nation tells."""
    ways = ["id > 100 AND kind = 'a'", "ID>100 -- note\n and  kind = 'a'", "id > 100.0 and kind = 'a'", "kind = 'a' and id > 100", "id > 100 and \"kind\" = 'a'"]
    way = lambda n: F.element_at(F.array(*[F.lit(w) for w in ways]), (n % len(ways) + 1).cast("int"))
    text = F.concat(F.lit("with a as (select x from {{ ref('t') }} where "), way(F.col("c_custkey")), F.lit("), b as (select x from {{ ref('t') }} where "), way(F.col("c_nationkey")), F.lit(") select a.x from a join b on a.x = b.x"))
    return customers.select(F.concat(F.lit("models/c"), F.col("c_custkey").cast("string"), F.lit(".sql")).alias("source_path"), text.cast("binary").alias("content"))


def grouped_corpus(customers: DataFrame) -> DataFrame:
    """A model of two imports of one relation for each customer: predicate, column, name further in, reader and purity are each told by a digit of the key in base two."""
    k = F.col("c_custkey")
    bit = lambda n, no, yes: F.when(F.shiftright(k, n).bitwiseAND(F.lit(1)) == 1, F.lit(yes)).otherwise(F.lit(no))
    text = F.concat(
        F.lit("with a as (select x, y as z from {{ ref('t') }}"), bit(0, "", " where x > 1"), F.lit("), b as (select x, "), bit(1, "y", "w"), F.lit(" as z, v from {{ ref('t') }}), c as ("),
        bit(2, "select 1 as x", "with a as (select 1 as x) select x from a"), F.lit(") select "), bit(3, "a.x", "a.*"), bit(4, "", ", random() as r"), F.lit(" from a join b on a.x = b.x join c on c.x = a.x"),
    )
    return customers.select(F.concat(F.lit("models/c"), k.cast("string"), F.lit(".sql")).alias("source_path"), text.cast("binary").alias("content"))
