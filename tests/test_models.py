"""The lexer, the model parser, merging, narrowing and the gates, on texts that are made here and on generated ones."""

import random

import pytest

from twinplan.functions.identifiers import Refused, identifier, resolve_dialect
from twinplan.functions.lexer import decode, mask, tokenize
from twinplan.plans.compiled import as_model, compiled_duplicates
from twinplan.plans.demand import prune
from twinplan.plans.determinism import refusals
from twinplan.plans.models import duplicate_groups, group_codes, parse_model
from twinplan.plans.rewrite import Edit, apply_edits, plan_merge
from twinplan.service import source_edits

BIRDS = "{{ ref('birds') }}"


def tag(rnd):
    """An expression tag, and the call that it spells or None: calls of literals, and calls with one thing wrong."""
    mark = rnd.choice("'\"")
    text = lambda: f"{mark}{rnd.choice(['owl', 'kite', 'a b', 'é', '}}'])}{mark}"
    kind = rnd.choice(["ref", "source"])
    if kind == "source":
        places, named = [text(), text()], []
    else:
        places, named = [text() for _ in range(rnd.randint(1, 2))], rnd.choice([[], [f"v={rnd.randint(1, 9)}"], [f"version={text()}"]])
    wrong = rnd.choice([None] * 4 + ["name", "more", "keyword", "star", "filter", "other", "number", "empty"])
    if wrong == "more":
        places += [text(), text()]
    elif wrong == "keyword":
        named = [*named, "k=1"]
    elif wrong == "star":
        places = [*places, "*more"]
    elif wrong in ("name", "number", "empty"):
        places[rnd.randrange(len(places))] = {"name": "owl", "number": "7", "empty": "''"}[wrong]
    call = f"{'env.' if wrong == 'other' else ''}{kind}({rnd.choice(['', ' '])}{', '.join([*places, *named])}){' | lower' if wrong == 'filter' else ''}"
    found = None
    if wrong is None:
        value = [p[1:-1] for p in places]
        found = (kind, value[-1], value[0] if kind == "ref" and len(value) == 2 else None, value[0] if kind == "source" else None)
    return "{{" + rnd.choice(["", "-"]) + f" {call} " + rnd.choice(["", "-"]) + "}}", found


def test_generated_tags_and_masking():
    rnd = random.Random(1)
    for _ in range(300):
        pieces, want = [], []
        for _ in range(rnd.randint(1, 5)):
            kind = rnd.choice(["sql", "tag", "comment", "raw", "statement"])
            if kind == "tag":
                piece, call = tag(rnd)
                want += [call] if call else []
            else:
                piece = {"sql": "nest ", "comment": "{# ' {{ ref('x') }} #}", "raw": "{% raw %}{{ ref('y') }}{% endraw %}", "statement": "{% if '%}' %}"}[kind]
            pieces.append(piece + rnd.choice([" ", "\n", "\r\n"]))
        text = "".join(pieces)
        masked = mask(text)
        assert [(c.kind, c.name, c.package, c.source_name) for c in masked.calls.values()] == want
        assert len(masked.text) == len(text) and [len(x) for x in masked.text.split("\n")] == [len(x) for x in text.split("\n")]
        assert "".join(t.text for t in tokenize(masked.text)) == masked.text
        assert {w for w in masked.text.split() if w != "nest"} == set(masked.calls)


@pytest.mark.parametrize("raw", [b"nest \xc3", b"{% raw %} nest", b"{{ nest '}}'", b"{% set nest", b"nest {#"])
def test_what_has_no_end_or_is_no_text(raw):
    with pytest.raises(Refused, match="INTERNAL_ERROR"):
        parse_model(raw)


def test_strings_of_all_kinds_hide_what_they_hold():
    text = "x $q$ with ' -- $$ $q$ y $$;$$ 'it''s --' E'a\\' b' z"
    kinds = [(t.kind, t.text) for t in tokenize(text) if t.kind not in ("space",)]
    assert [k for k, _ in kinds] == ["word", "string", "word", "string", "string", "string", "word"]


def test_identifiers():
    assert identifier('"nest""egg"').value == 'nest"egg' and identifier("`a``b`").value == "a`b"
    assert identifier('"Owl"').identity != identifier("owl").identity == identifier("OWL").identity == identifier('"owl"').identity
    assert identifier("owl", "upper").identity == "OWL" and identifier('"OWL"', "insensitive").identity == "owl"
    assert [decode(x).newline for x in (b"a", b"a\nb", b"\xef\xbb\xbfa\r\nb", b"a\rb", b"a\r\nb\n")] == ["none", "lf", "crlf", "cr", "mixed"]
    assert decode("ßx".encode()).byte_at(1) == 2 and decode(b"\xef\xbb\xbfx").byte_at(1) == 4
    for named, code in ((("spark", "postgres"), "ADAPTER_MISMATCH"), ((), "UNSUPPORTED_ADAPTER"), (("abacus",), "UNSUPPORTED_ADAPTER")):
        with pytest.raises(Refused, match=code):
            resolve_dialect(*named)


@pytest.mark.parametrize("head", ["recursive owls as (", "owls (wing) as (", "owls as materialized (", "owls (", "owls as (select 1), owls as (", "owls as ((", "7 as ("])
def test_lists_that_are_refused(head):
    with pytest.raises(Refused, match="UNSUPPORTED_IMPORT_SHAPE"):
        parse_model(f"with {head}select 1) select 1".encode())


def column(rnd, k):
    """An item of an import's list and the name it gives, or None where the list is then no import's."""
    bad = {f"c{k} + 1": None, f"t.c{k}": None, f"c{k}::int": None, f"upper(c{k})": None, f"'c{k}'": None, f"distinct c{k}": None, f"c{k} a b": None}
    good = {f"c{k}": f"c{k}", f"c{k} as d{k}": f"d{k}", f"c{k} d{k}": f"d{k}", f'"c{k}"': f"c{k}", f"c{k} /* note */ as d{k}": f"d{k}"}
    return rnd.choice([*good.items()] * 12 + [*bad.items()])


def test_generated_import_lists():
    rnd, seen = random.Random(2), set()
    for _ in range(300):
        items = [column(rnd, k) for k in range(rnd.randint(1, 4))]
        tail = rnd.choice([("", True), (" where wing > 0 and start = 1", True), (" where wing is null group by wing", False), (" order by 1", False), (" as b", False), (" where sort > 'limit 1'", True)])
        comma = rnd.choice(["", ","])
        entry = parse_model(f"with a as (select {', '.join(i for i, _ in items)}{comma} from {BIRDS}{tail[0]}) select 1 from a".encode()).entries[0]
        fine = tail[1] and all(n is not None for _, n in items)
        assert entry.supported == fine
        if fine:
            assert [p.output.value for p in entry.projections] == [n for _, n in items]
            seen.add(len(items))
    assert seen == {1, 2, 3, 4}


def test_comments_and_aliases_keep_an_import_from_being_merged():
    for body in (f"select wing -- long\n, tail from {BIRDS}", f"select wing from {BIRDS} b", f"select wing from {BIRDS} as b where wing > 0"):
        entry = parse_model(f"with a as ({body}) select 1 from a".encode()).entries[0]
        assert entry.call is not None and not entry.supported


def test_names_further_in():
    inner = {
        "with nest as (select 1 as k) select k from nest": {"nest"}, "with recursive nest (k) as (select 1) select k from nest": {"nest"},
        'select cast(k as numeric(3)) from (with "Nest" as not materialized (values (1)) select 1 as k) q': {"Nest"}, "select cast(k as timestamp with time zone) as at from a": set(),
    }
    for body, names in inner.items():
        assert parse_model(f"with a as (select k from {BIRDS}), w as ({body}) select * from w".encode()).nested == names


# --- merging -------------------------------------------------------------------------


def generated(rnd):
    """A model of two to four imports of one relation or of two, read by a join, with each entry's columns."""
    names = ["owls", "kites", "larks", "rooks"][: rnd.randint(2, 4)]
    layout = rnd.choice([", ", ",\n  ", ",\r\n    "])
    relation = {n: rnd.choice(["birds", "birds", "trees"]) for n in names}
    columns = {n: ["id", *rnd.sample(["wing", "tail", "beak", "song"], rnd.randint(0, 3))] for n in names}
    entries = [f"{n} as (select {layout.join(columns[n])} from {{{{ ref('{relation[n]}') }}}})" for n in names]
    read = f"{names[0]}.id" + "".join(f", {n}.{c} as {n}_{c}" for n in names for c in columns[n])
    joins = "".join(f" join {n} on {n}.id = {names[0]}.id" for n in names[1:])
    return f"with {layout.join(entries)} select {read} from {names[0]}{joins}", names, relation, columns


def test_generated_merges():
    rnd, merged = random.Random(3), 0
    for _ in range(200):
        sql, names, relation, columns = generated(rnd)
        repeated = [r for r in ("birds", "trees") if sum(relation[n] == r for n in names) > 1]
        if not repeated:
            with pytest.raises(Refused, match="NO_DUPLICATE_IMPORT"):
                plan_merge(sql.encode())
            continue
        merged += 1
        plan = plan_merge(sql.encode())
        after = parse_model(plan.candidate)
        for r in ("birds", "trees"):
            members = [n for n in names if relation[n] == r]
            if members:
                (entry,) = [e for e in after.entries if e.call.name == r]
                assert entry.name.value == members[0]
                assert [p.output.value for p in entry.projections] == list(dict.fromkeys(c for n in members for c in columns[n]))
                assert {x.alias.value if x.alias else x.entry for x in after.readers if x.entry == entry.name.identity} == set(members)
        assert not duplicate_groups(after)
        assert decode(plan.candidate).text == apply_edits(sql, source_edits(sql.encode(), plan.candidate))
    assert merged > 100


def code_of(sql):
    try:
        plan_merge(sql.replace("BIRDS", BIRDS).encode())
        return "OK"
    except Refused as e:
        return e.code


def test_what_is_not_merged():
    two = "with owls as (select {}), kites as (select {}) "
    joined = two.format("id from BIRDS", "id, wing from BIRDS")
    assert code_of(joined + "select kites.* from owls join kites on true") == "OK"
    assert code_of(joined + "select owls.* from owls join kites on true") == "UNSUPPORTED_IMPORT_SHAPE"
    assert code_of(joined + "select owls.id from owls, kites") == "REFERENCE_BINDING_AMBIGUOUS"
    assert code_of(joined + "select id from owls natural join kites") == "REFERENCE_BINDING_AMBIGUOUS"
    assert code_of(joined + "select wing from owls join nests on nests.id = owls.id") == "REFERENCE_BINDING_AMBIGUOUS"
    assert code_of(two.format("id from BIRDS where id > 1", "id from BIRDS where id > 1.0") + "select 1 from owls") == "DIFFERENT_PREDICATE"
    assert code_of(two.format("id from BIRDS where ID  > 1", "id from BIRDS where id > 1") + "select 1 from owls") == "OK"
    assert code_of(two.format("wing as x from BIRDS", "tail as x from BIRDS") + "select 1 from owls") == "PROJECTION_COLLISION"
    assert code_of("with owls as (select id from BIRDS), /* here */ kites as (select id from BIRDS) select 1 from owls") == "COMMENT_RELOCATION_UNSUPPORTED"
    assert code_of("with owls as (select id from BIRDS), w as (with owls as (select 2 as id) select id from owls), kites as (select id from BIRDS) select 1 from w") == "REFERENCE_BINDING_AMBIGUOUS"
    model = parse_model(two.format("wing as x from BIRDS where id > 1", "tail as x from BIRDS").replace("BIRDS", BIRDS).encode() + b"select 1 from owls, kites")
    assert group_codes(model, duplicate_groups(model)[0], False) == ("DIFFERENT_PREDICATE", "PROJECTION_COLLISION", "REFERENCE_BINDING_AMBIGUOUS", "NONDETERMINISTIC")


def test_edits():
    assert apply_edits("nest", [Edit(4, 4, "s"), Edit(0, 1, "b")]) == "bests"
    for bad in ([Edit(0, 3, ""), Edit(2, 4, "")], [Edit(0, 5, "")], [Edit(-1, 0, "")]):
        with pytest.raises(Refused):
            apply_edits("nest", bad)
    rnd = random.Random(4)
    for _ in range(100):
        some = [rnd.choice(["é\n", "a\r\n", "b\n", "\n"]) for _ in range(rnd.randint(0, 12))]
        other = [x for x in some if rnd.random() < 0.7] + [rnd.choice(["z", ""])]
        a, b = "".join(some), "".join(other)
        assert apply_edits(a, source_edits(a.encode(), b.encode())) == b


# --- narrowing -----------------------------------------------------------------------


def narrowed(sql):
    """The columns that each narrowed import is left with, None where nothing is narrowed."""
    out, found = prune(sql.replace("BIRDS", BIRDS).encode())
    return {n.entry.name.value: list(n.columns) for n in found} or None


STAR = "with owls as (select * from BIRDS) "


def test_names_that_are_words_of_sql_elsewhere():
    assert narrowed(STAR + "select id, first from owls") == {"owls": ["id", "first"]}
    assert narrowed(STAR + "select last, row from owls order by range nulls last, groups desc nulls first") == {"owls": ["last", "row", "range", "groups"]}
    assert narrowed(STAR + "select sum(rows) filter (where range > 1 and current is not null) as filter from owls") == {"owls": ["rows", "range", "current"]}
    assert narrowed(STAR + "select max(over) over (partition by partition, row order by rows desc range between unbounded preceding and current row) as x from owls") == {"owls": ["over", "partition", "row", "rows"]}
    assert narrowed(STAR + "select case first when last then following else -preceding end as x from owls where filter between nulls and unbounded") == {
        "owls": ["first", "last", "following", "preceding", "filter", "nulls", "unbounded"]
    }
    assert narrowed(STAR + "select id first, wing row from owls") == {"owls": ["id", "wing"]}
    assert narrowed(STAR + "select owls.current, x.exclude from owls join owls as x on owls.ties is distinct from x.others") == {"owls": ["current", "exclude", "ties", "others"]}


def expression(rnd, depth=0):
    """An expression over known columns, and those it reads in order."""
    if depth > 2 or rnd.random() < 0.3:
        name = rnd.choice(["id", "first", "last", "row", "wing", "groups", "filter"])
        return rnd.choice([(name, [name]), (f"o.{name}", [name]), ("7", []), ("'from'", []), ("null", []), ("date '2020-01-01'", [])])
    parts = [expression(rnd, depth + 1) for _ in range(3)]
    a, b, c = (p for p, _ in parts)
    used = [x for _, u in parts for x in u]
    text, n = rnd.choice([
        (f"({a} + {b} * {c})", 3), (f"coalesce({a}, {b}, {c})", 3), (f"case when {a} > {b} then {c} end", 3), (f"({a} between {b} and {c})", 3), (f"cast({a} as numeric(3, 1))", 1),
        (f"({a} in ({b}, {c}))", 3), (f"({a} is not null and not {b} = {c})", 3), (f"{a}::text", 1), (f"count(distinct {a})", 1), (f"(extract(year from {a}) || {b})", 2),
        (f"sum({a}) over (partition by {b} order by {c} desc nulls last)", 3), (f"max({a}) filter (where {b} like {c})", 3),
    ])
    return text, used if n == 3 else [x for _, u in parts[:n] for x in u]


def test_generated_demands():
    rnd, some = random.Random(5), 0
    for _ in range(300):
        items, where = [expression(rnd) for _ in range(rnd.randint(1, 3))], expression(rnd)
        sql = STAR + f"select {', '.join(f'{e} as x{k}' for k, (e, _) in enumerate(items))} from owls as o where {where[0]}"
        used = list(dict.fromkeys([x for _, u in items for x in u] + where[1]))
        assert narrowed(sql) == ({"owls": used} if used else None), sql
        some += bool(used)
    assert some > 250


def test_demand_through_entries():
    assert narrowed(STAR + ", up as (select owls.* from owls where wing > 0), top as (select * from up where tail > 0) select id from top order by beak") == {"owls": ["id", "beak", "tail", "wing"]}
    assert narrowed("with owls as (select * from BIRDS), kites as (select id, wing as w, tail from BIRDS) select id, kites.w from owls join kites using (id)") == {"owls": ["id"], "kites": ["id", "w"]}
    assert narrowed("with owls as (select t.* from BIRDS as t where t.tail > 0) select wing from owls") == {"owls": ["wing"]}


def test_stars_with_columns_left_out():
    assert narrowed(STAR + ", up as (select * except (song) from owls) select id from up") == {"owls": ["id", "song"]}
    assert narrowed(STAR + ", up as (select owls.* exclude song from owls) select id from up") == {"owls": ["id", "song"]}
    assert narrowed(STAR + ", up as (select * exclude (song, beak) from owls) select song from up") is None
    assert narrowed("with owls as (select * except (song) from BIRDS) select id, wing from owls") == {"owls": ["id", "wing"]}
    assert narrowed("with owls as (select * except (song) from BIRDS) select id, song from owls") is None
    assert narrowed(STAR + ", up as (select * except (song), 1 as one from owls) select id from up") is None


def test_paths_and_row_sources():
    assert narrowed(STAR + "select owls.nest.tree.height, owls.id from owls") == {"owls": ["nest", "id"]}
    assert narrowed(STAR + "select nest.tree.height from owls") is None
    assert narrowed(STAR + "select owls.id, egg from owls, unnest(owls.eggs) as egg") == {"owls": ["id", "eggs"]}
    assert narrowed(STAR + "select owls.id, f.value from owls join lateral flatten(input => owls.eggs) f on owls.wing > 0") == {"owls": ["id", "eggs", "wing"]}
    assert narrowed(STAR + "select owls.id, e.col from owls, lateral explode(owls.eggs) as e where e.col > owls.tail") == {"owls": ["id", "eggs", "tail"]}
    for unclear in ("select id, egg from owls, unnest(owls.eggs) as egg", "select owls.id from owls, unnest(owls.eggs, owls.wing) as e", "select owls.id from owls, unnest(owls.eggs)",
                    "select owls.id from owls, unnest(owls.eggs) as e with offset", "select owls.id from owls, nests"):
        assert narrowed(STAR + unclear) is None


@pytest.mark.parametrize("rest", [
    "select * from owls", "select owls from owls", "select count(*) from owls", "select wing as k, sum(k) from owls", "select id from owls union select 1", "select id from owls natural join nests",
    "select wing as k from owls group by k", "select wing as k from owls having k > 1", "select id from owls tablesample (3)", "select (select max(wing) from owls) as m from owls", "select distinct on (id) id from owls",
    "select wing[1] from owls", "select id from owls join nests on wing = 1", "select owls.id, other.wing from owls",
])
def test_what_is_not_narrowed(rest):
    assert narrowed(STAR + rest) is None


def test_tags_and_comments_that_block_narrowing():
    assert narrowed("{{ config(materialized='view') }} " + STAR + "select id from owls {# all #}") == {"owls": ["id"]}
    for sql in (STAR + "{% if wet %} select id from owls {% endif %}", STAR + "select id, {{ more }} from owls", "with owls as (select /* all */ * from BIRDS) select id from owls"):
        assert narrowed(sql) is None


# --- the gate ------------------------------------------------------------------------


@pytest.mark.parametrize(("sql", "why"), [
    ("select upper(song), now() from owls", ""), ("select uuid() from owls", "volatile: uuid"), ("select lag(wing) over (order by id) from owls", "order-sensitive: lag"), ("select sing(id) from owls", "unknown function: sing"),
    ("select forest.upper(song) from owls", "function in a schema: upper"), ("select max(wing) over (order by id rows 3 preceding) from owls", "a frame of rows"),
    ("select max(wing) over (order by id range between unbounded preceding and current row) from owls", ""), ("select rows, first from owls", ""),
    ("select id, wing from owls order by id, 2 limit 9", ""), ("select id, wing from owls order by wing offset 2", "rows are cut and the order does not cover every output"),
    ("select * from owls order by id fetch first row only", "rows are cut and the order does not cover a star"), ("select id + 1 as k from owls order by id + 1 limit 2", ""),
    ("with a as (select id from owls limit 1) select id from a order by id", "rows are cut without an order"), ("select distinct on (wing) wing, id from owls order by wing", "rows are cut and the order does not cover every output"),
    ("select string_agg(song, ',') from owls", "order-sensitive: string_agg"), ("select id from owls where id in (1, 2) and cast(wing as decimal(4, 1)) > 0", ""),
])
def test_determinism(sql, why):
    assert ",".join(refusals(sql)) == why


# --- compiled text -------------------------------------------------------------------


def test_compiled_queries_are_read_as_models():
    sql = 'with owls as (select id from "wh"."Forest".birds), kites as (select id, wing from "wh"."Forest".birds where id > 0), far as (select id from nests), sums as (select sum(id) as s from owls) select 1 from sums'
    model = as_model(sql)
    assert [e.call.name if e.call else None for e in model.entries] == ["wh.Forest.birds", "wh.Forest.birds", "nests", None]
    assert compiled_duplicates(sql) == [("wh.Forest.birds", ("owls", "kites"), True)]
    assert compiled_duplicates("with owls as (select id + 1 as k from birds), kites as (select id from birds) select 1 from owls") == [("birds", ("owls", "kites"), False)]
    assert compiled_duplicates("with owls as (select id from birds), kites as (select id from owls) select 1 from kites") == []
