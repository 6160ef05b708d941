"""Which columns of an import are read at all, and the narrowed text of those that are not.

Demand is followed from the final query back through the WITH list. What cannot
be bound to one relation without its schema ends the analysis: no narrowing.
"""

from __future__ import annotations

from dataclasses import dataclass

from twinplan.functions.identifiers import Refused, identifier
from twinplan.functions.lexer import Token, closing
from twinplan.plans.models import NOT_ALIAS, Entry, Model, is_name, parse_model
from twinplan.plans.rewrite import Edit, _unmoved, apply_edits

#: Words that no column and no alias without AS is called; all others are names wherever an operand can stand.
RESERVED = frozenset(
    "SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AND OR NOT IN IS NULL TRUE FALSE BETWEEN LIKE ILIKE CASE WHEN THEN ELSE END AS ASC DESC "
    "ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS QUALIFY".split()
)
#: Words behind which another operand stands, where one has just ended.
BETWEEN_OPERANDS = frozenset("AND OR IN BETWEEN LIKE ILIKE ESCAPE WHEN THEN ELSE".split())
FRAME = frozenset("BETWEEN AND UNBOUNDED PRECEDING FOLLOWING CURRENT ROW EXCLUDE NO OTHERS TIES GROUP".split())
REFUSED_WORDS = frozenset("UNION INTERSECT MINUS NATURAL PIVOT UNPIVOT TABLESAMPLE WINDOW INTO FETCH RECURSIVE MATCH_RECOGNIZE".split())
TYPE_WORDS = frozenset("DOUBLE PRECISION TIMESTAMP TIME WITH WITHOUT ZONE CHARACTER VARYING".split())
TYPED = frozenset("DATE TIME TIMESTAMP INTERVAL".split())
CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET")


class Unclear(Exception):
    """The demand cannot be told; nothing is narrowed."""


@dataclass(frozen=True)
class Column:
    qualifier: str | None
    name: str
    text: str
    path: bool = False


@dataclass(frozen=True)
class Narrowed:
    entry: Entry
    columns: tuple[str, ...]
    edit: Edit


def clauses(ts: tuple[Token, ...]) -> dict[str, list[Token]]:
    """The tokens of each clause of a flat query."""
    if not ts or ts[0].upper != "SELECT":
        raise Unclear
    out: dict[str, list[Token]] = {"SELECT": []}
    depth, now, before, compares = 0, "SELECT", ts[0], False
    for t in ts[1:]:
        depth += (t.text == "(") - (t.text == ")")
        if t.upper in REFUSED_WORDS and before.text != "." or t.upper == "SELECT" or t.upper == "EXCEPT" and before.text != "*":
            raise Unclear
        if depth == 0 and t.upper in CLAUSES and before.text != "." and not (compares and before.upper == "DISTINCT"):
            if t.upper in out or t.upper == now:
                raise Unclear
            now = t.upper
            out[now] = []
        else:
            out[now].append(t)
        if t.upper != "DISTINCT":
            compares = t.upper in ("IS", "NOT")
        before = t
    return out


def columns(ts: list[Token], rule: str) -> list[Column]:
    """The columns that an expression, or a list of them, reads, in order. Raises where a token is neither understood nor harmless.

    Whether a word is a name is told by its place: where an operand is due it is
    one unless it is reserved, and behind an operand it is an operator.
    """
    out, i, operand = [], 0, False
    words = lambda at, n: [t.upper for t in ts[at : at + n]]
    while i < len(ts):
        t = ts[i]
        after = ts[i + 1] if i + 1 < len(ts) else None
        if t.text == "(":
            end = closing(ts, i)
            out += columns(ts[i + 1 : end], rule)
            i, operand = end + 1, True
        elif t.text in ("+", "-", "/", "%", "=", "<", ">", "<=", ">=", "<>", "!=", "||", ",", "^"):
            i, operand = i + 1, False
        elif operand:
            if t.text == "*":
                i, operand = i + 1, False
            elif t.text == "::":
                if after is None or after.kind != "word":
                    raise Unclear
                i += 2
                while i < len(ts) and ts[i].upper in TYPE_WORDS:
                    i += 1
                if i < len(ts) and ts[i].text == "(":
                    i = closing(ts, i) + 1
            elif t.upper in ("OVER", "FILTER", "WITHIN"):
                at = i + 2 if t.upper == "WITHIN" and words(i + 1, 1) == ["GROUP"] else i + 1
                if at >= len(ts) or ts[at].text != "(":
                    raise Unclear
                end = closing(ts, at)
                inside = ts[at + 1 : end]
                out += columns(inside[1:], rule) if t.upper == "FILTER" and words(at + 1, 1) == ["WHERE"] else _window(inside, rule) if t.upper != "FILTER" else _unclear()
                i = end + 1
            elif t.upper == "IS":
                i += 1 + (words(i + 1, 1) == ["NOT"])
                if words(i, 2) == ["DISTINCT", "FROM"]:
                    i, operand = i + 2, False
                elif words(i, 1) and words(i, 1)[0] in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                    i += 1
                else:
                    raise Unclear
            elif t.upper == "NOT" and after is not None and after.upper in ("IN", "BETWEEN", "LIKE", "ILIKE"):
                i += 1
            elif t.upper in BETWEEN_OPERANDS:
                i, operand = i + 1, False
            elif t.upper in ("ASC", "DESC", "END"):
                i += 1
            elif t.upper == "NULLS" and after is not None and after.upper in ("FIRST", "LAST"):
                i += 2
            else:
                raise Unclear
        elif t.kind in ("string", "number") or t.upper in ("NULL", "TRUE", "FALSE"):
            i, operand = i + 1, True
        elif t.upper in ("NOT", "CASE", "WHEN", "DISTINCT"):
            i += 1
        elif not is_name(t) or t.upper in RESERVED:
            raise Unclear
        elif t.kind == "word" and t.upper in TYPED and after is not None and after.kind == "string":
            i += 1
        elif t.kind == "word" and after is not None and after.text == "(":
            end, name = closing(ts, i + 1), t.upper
            inside = ts[i + 2 : end]
            if name == "COUNT" and [x.text for x in inside] == ["*"]:
                inside = []
            elif name in ("CAST", "TRY_CAST"):
                ass = [k for k, x in enumerate(inside) if x.upper == "AS"]
                if not ass:
                    raise Unclear
                inside = inside[: ass[-1]]
            elif name == "EXTRACT":
                if len(inside) < 3 or inside[1].upper != "FROM":
                    raise Unclear
                inside = inside[2:]
            elif any(x.upper in ("FROM", "FOR") for x in _shallow(inside)):
                raise Unclear
            else:
                inside, order = _before_order(inside)
                out += columns(order, rule)
            out += columns(inside, rule)
            i, operand = end + 1, True
        else:
            chain, j = [t], i + 1
            while j + 1 < len(ts) and ts[j].text == "." and is_name(ts[j + 1]):
                chain.append(ts[j + 1])
                j += 2
            if j < len(ts) and ts[j].text in (".", "[", ":"):
                raise Unclear
            parts = [identifier(x.text, rule).identity for x in chain]
            # a path into a struct reads the column at its head, which only a qualified path names for sure
            out.append(Column(parts[0], parts[1], chain[1].text, len(parts) > 2) if len(parts) > 1 else Column(None, parts[0], t.text))
            i, operand = j, True
    return out


def _shallow(ts: list[Token]) -> list[Token]:
    """The tokens outside of parentheses."""
    out, depth = [], 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            out.append(t)
    return out


def _unclear() -> list[Column]:
    raise Unclear


def _before_order(ts: list[Token]) -> tuple[list[Token], list[Token]]:
    """The arguments of an aggregate and what it is ordered by."""
    depth = 0
    for i, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper == "ORDER" and i + 1 < len(ts) and ts[i + 1].upper == "BY":
            return ts[:i], ts[i + 2 :]
    return ts, []


def _window(ts: list[Token], rule: str) -> list[Column]:
    """The columns of PARTITION BY and ORDER BY; a frame of words and numbers has none."""
    out, part, depth, i = [], [], 0, 0
    while i <= len(ts):
        t = ts[i] if i < len(ts) else None
        pair = [x.upper for x in ts[i : i + 2]] if depth == 0 else []
        frame = len(pair) == 2 and pair[0] in ("RANGE", "ROWS", "GROUPS") and (pair[1] in ("BETWEEN", "UNBOUNDED", "CURRENT") or ts[i + 1].kind in ("number", "string"))
        if t is None or frame or pair in (["PARTITION", "BY"], ["ORDER", "BY"]):
            out += columns(part, rule)
            part = []
            if frame and any(not (x.upper in FRAME or x.kind in ("number", "string") or x.upper == "INTERVAL") for x in ts[i + 1 :]):
                raise Unclear
            if t is None or frame:
                return out
            i += 2
            continue
        depth += (t.text == "(") - (t.text == ")")
        part.append(t)
        i += 1
    return out


def split_items(ts: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.text == ",":
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x] if len(out) > 1 else out


@dataclass
class Scope:
    """A flat query: its relations by the name they are called, their entry, its USING columns, its ON expressions and what row sources unfold.

    rows: names of row sources, which stand for an element and have no entry.
    """

    parts: dict[str, list[Token]]
    bound: dict[str, str | None]
    using: list[Token]
    on: list[list[Token]]
    distinct: bool
    rows: frozenset[str]


def scope_of(ts: tuple[Token, ...], model: Model) -> Scope:
    while ts and ts[-1].text == ";":
        ts = ts[:-1]
    parts, rule = clauses(ts), model.rule
    known = {e.name.identity for e in model.entries}
    bound, using, on, rows, i = {}, [], [], set(), 0
    source = parts.get("FROM", [])
    expect = True
    while i < len(source):
        t = source[i]
        if t.text == "," and not expect and bound and _is_row_source(source, i + 1):
            expect, i = True, i + 1
        elif expect and _is_row_source(source, i):
            unfolded, name, i = _row_source(source, i, rule)
            if name in bound:
                raise Unclear
            on.append(unfolded)
            rows.add(name)
            bound[name], expect = None, False
        elif expect:
            if not is_name(t) or t.upper in RESERVED or t.upper == "LATERAL":
                raise Unclear
            chain = identifier(t.text, rule).identity
            entry, i = (chain if chain in known else None), i + 1
            while i + 1 < len(source) and source[i].text == "." and is_name(source[i + 1]):
                chain, entry, i = identifier(source[i + 1].text, rule).identity, None, i + 2
            if i < len(source) and source[i].text == "(":
                raise Unclear
            if i < len(source) and source[i].upper == "AS":
                i += 1
            if i < len(source) and is_name(source[i]) and source[i].upper not in NOT_ALIAS:
                chain, i = identifier(source[i].text, rule).identity, i + 1
            elif source[i - 1].upper == "AS":
                raise Unclear
            if chain in bound or (i < len(source) and source[i].text == "("):
                raise Unclear
            bound[chain], expect = entry, False
        elif t.upper in ("INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS"):
            i += 1
        elif t.upper == "JOIN":
            expect, i = True, i + 1
        elif t.upper == "USING" and i + 1 < len(source) and source[i + 1].text == "(":
            end = closing(source, i + 1)
            using += [x for x in source[i + 2 : end] if x.text != ","]
            i = end + 1
        elif t.upper == "ON":
            j, depth = i + 1, 0
            while j < len(source):
                depth += (source[j].text == "(") - (source[j].text == ")")
                follows = source[j + 1].text if j + 1 < len(source) else ""
                if depth == 0 and (source[j].upper in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS") and follows != "(" or source[j].text == ","):
                    break
                j += 1
            on.append(source[i + 1 : j])
            i = j
        else:
            raise Unclear
    if expect and source or not source:
        raise Unclear
    wanted = parts["SELECT"]
    distinct = bool(wanted) and wanted[0].upper == "DISTINCT"
    if wanted and wanted[0].upper in ("DISTINCT", "ALL"):
        parts["SELECT"] = wanted[1:]
        if parts["SELECT"] and parts["SELECT"][0].upper == "ON":
            raise Unclear
    return Scope(parts, bound, using, on, distinct, frozenset(rows))


def _is_row_source(ts: list[Token], at: int) -> bool:
    """UNNEST(x), or LATERAL and a call."""
    words = [t.upper for t in ts[at : at + 3]]
    return words[:2] == ["UNNEST", "("] or len(words) == 3 and words[0] == "LATERAL" and words[2] == "(" and is_name(ts[at + 1])


def _row_source(ts: list[Token], at: int, rule: str) -> tuple[list[Token], str, int]:
    """What a row source unfolds, the name of its rows, and the place behind it. One argument, and an alias that is spelled out."""
    open_ = at + 1 + (ts[at].upper == "LATERAL")
    end = closing(ts, open_)
    inside = ts[open_ + 1 : end]
    if len(inside) > 3 and inside[0].upper == "INPUT" and [t.text for t in inside[1:3]] == ["=", ">"]:
        inside = inside[3:]
    named = end + 1 + (end + 1 < len(ts) and ts[end + 1].upper == "AS")
    if not inside or _top_comma(inside) or named >= len(ts) or not is_name(ts[named]) or ts[named].upper in NOT_ALIAS | {"WITH"}:
        raise Unclear
    if named + 1 < len(ts) and ts[named + 1].upper in ("WITH", "("):
        raise Unclear
    return inside, identifier(ts[named].text, rule).identity, named + 1


def _top_comma(ts: list[Token]) -> bool:
    depth = 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.text == ",":
            return True
    return False


def _output(item: list[Token], rule: str) -> tuple[list[Token], str | None, bool]:
    """An item's expression, its output name, and whether it is just a column of that name."""
    if len(item) >= 3 and item[-2].upper == "AS" and is_name(item[-1]):
        return item[:-2], identifier(item[-1].text, rule).identity, False
    if len(item) >= 2 and is_name(item[-1]) and item[-1].upper not in RESERVED and item[-2].text != ".":
        before = item[-2]
        ended = is_name(before) and before.upper not in RESERVED or before.text == ")" or before.kind in ("string", "number") or before.upper in ("END", "NULL", "TRUE", "FALSE")
        if ended:
            return item[:-1], identifier(item[-1].text, rule).identity, False
    return item, identifier(item[-1].text, rule).identity if item and is_name(item[-1]) else None, True


def _star(item: list[Token], rule: str) -> tuple[str | None, dict[str, str]] | None:
    """For `*` or `name.*`, with EXCEPT or EXCLUDE or without: the name and the columns left out. None for other items."""
    at = 2 if len(item) >= 3 and item[1].text == "." and is_name(item[0]) else 0
    if at >= len(item) or item[at].text != "*":
        return None
    rest, left_out = item[at + 1 :], []
    if rest:
        if rest[0].upper not in ("EXCEPT", "EXCLUDE") or len(rest) < 2:
            raise Unclear
        listed = rest[2:-1] if rest[1].text == "(" and closing(rest, 1) == len(rest) - 1 else rest[1:] if len(rest) == 2 else []
        left_out = [t for t in listed if t.text != ","]
        if not left_out or not all(map(is_name, left_out)) or [t.text for t in listed[1::2]] != [","] * (len(left_out) - 1):
            raise Unclear
    return identifier(item[0].text, rule).identity if at else None, {identifier(t.text, rule).identity: t.text for t in left_out}


def demands(model: Model) -> dict[str, dict[str, str]]:
    """For each entry: the columns that others read of it, in order of first use, each as it is first spelled."""
    rule = model.rule
    found: dict[str, dict[str, str]] = {e.name.identity: {} for e in model.entries}
    if model.nested:
        raise Unclear

    def visit(ts: tuple[Token, ...], wanted: dict[str, str] | None, top: bool) -> None:
        s = scope_of(ts, model)
        every = list(s.bound)
        using = {identifier(t.text, rule).identity: t.text for t in s.using}

        def want(c: Column) -> None:
            if c.qualifier in s.rows or c.qualifier is None and c.name in s.rows:
                return  # an element of what is unfolded
            if c.qualifier is None and c.name in s.bound:
                raise Unclear  # may be the whole row
            if c.qualifier is None and c.name in using:
                targets = every
            elif c.qualifier is None:
                if len(every) != 1:
                    raise Unclear
                targets = every
            elif c.qualifier in s.bound:
                targets = [c.qualifier]
            else:
                raise Unclear
            for t in targets:
                if s.bound[t] is not None:
                    found[s.bound[t]].setdefault(c.name, c.text)

        items = split_items(s.parts["SELECT"])
        stars = [_star(x, rule) for x in items]
        if any(x is not None for x in stars):
            grouped = s.distinct or "GROUP" in s.parts or "HAVING" in s.parts
            numbered = any(x and x[0].kind == "number" for x in split_items(s.parts.get("ORDER", [])[1:]))
            if wanted is None or len(items) != 1 or len(every) != 1 or stars[0][0] not in (None, *every) or grouped or numbered:
                raise Unclear
            left_out = stars[0][1]
            if set(left_out) & set(wanted):
                raise Unclear
            for name, text in {**wanted, **left_out}.items():
                want(Column(None, name, text))
            aliases = {}
        else:
            aliases, before = {}, set()
            for item in items:
                expression, name, same = _output(item, rule)
                used = columns(expression, rule)
                if any(c.qualifier is None and c.name in before for c in used):
                    raise Unclear  # may be an alias further left
                for c in used:
                    want(c)
                if name is not None and not same:
                    plain_column = len(used) == 1 and used[0].name == name and len(expression) in (1, 3)
                    if not plain_column:
                        aliases[name] = True
                        before.add(name)
        for name, text in using.items():
            for t in every:
                if s.bound[t] is not None:
                    found[s.bound[t]].setdefault(name, text)
        for part in [*s.on, s.parts.get("WHERE", [])]:
            for c in columns(part, rule):
                want(c)
        for clause in ("GROUP", "HAVING", "QUALIFY"):
            ts2 = s.parts.get(clause, [])
            for c in columns(ts2[1:] if clause == "GROUP" else ts2, rule):
                if c.qualifier is None and c.name in aliases:
                    raise Unclear
                want(c)
        for item in split_items(s.parts.get("ORDER", [])[1:]):
            used = columns(item, rule)
            if any(c.qualifier is None and c.name in aliases for c in used):
                if top and len(used) == 1 and is_name(item[0]) and all(t.upper in ("ASC", "DESC", "NULLS", "FIRST", "LAST") for t in item[1:]):
                    continue
                raise Unclear
            for c in used:
                want(c)
        for clause in ("LIMIT", "OFFSET"):
            if columns(s.parts.get(clause, []), rule):
                raise Unclear

    visit(model.final, None, True)
    for e in reversed(model.entries):
        if e.call is None:
            visit(e.body, found[e.name.identity], False)
    return found


def narrowings(model: Model) -> list[Narrowed]:
    """Imports whose list can be cut to what is read of them; none where anything is unclear."""
    text = model.decoded.text
    calls = {c.start for c in model.masked.calls.values()}
    for t in model.masked.tags:
        harmless = t.kind == "comment" or t.start in calls or text[t.start + 2 : t.end].lstrip("-+ \t\r\n").startswith("config(") and not model.tokens_before(t.start)
        if not harmless:
            return []
    try:
        found = demands(model)
    except (Unclear, Refused):
        return []
    out = []
    for e in model.entries:
        wanted = found[e.name.identity]
        if e.call is None or not wanted:
            continue
        if e.star:
            if e.left_out & set(wanted):
                continue
            names = tuple(wanted.values())
            new = ", ".join(names)
        else:
            have = {p.output.identity for p in e.projections}
            if not set(wanted) <= have or set(wanted) == have:
                continue
            kept = [p for p in e.projections if p.output.identity in wanted]
            names = tuple(p.output.source_text for p in kept)
            joint = text[e.projections[0].end : e.projections[1].start]
            new = joint.join(text[p.start : p.end] for p in kept)
        try:
            _unmoved(model, e.list_start, e.list_end)
            if any(t.kind == "comment" and e.start < t.start < e.list_end for t in model.tokens):
                continue
        except Refused:
            continue
        end = e.list_end if e.star else e.projections[-1].end
        out.append(Narrowed(e, names, Edit(e.list_start, end, new)))
    return out


def prune(raw: bytes, rule: str = "lower") -> tuple[bytes, list[Narrowed]]:
    """The file with its imports narrowed; read anew, nothing in it is left to narrow."""
    model = parse_model(raw, rule)
    found = narrowings(model)
    if not found:
        return raw, []
    out = model.decoded.encode(apply_edits(model.decoded.text, [n.edit for n in found]))
    after = parse_model(out, rule)
    got = {e.name.identity: [p.output.source_text for p in e.projections] for e in after.entries}
    if any(got[n.entry.name.identity] != list(n.columns) and not n.entry.alias for n in found):
        raise Refused("COMPILE_DRIFT", "a narrowed list reads otherwise")
    return out, found
