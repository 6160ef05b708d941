"""What a model file's WITH list says: which entries import one relation, and who reads them.

An import is `SELECT column [[AS] alias], ... FROM <literal call> [[AS] alias] [WHERE ...]`,
or the same with a lone star. Everything is told from tokens; what is not
understood is refused or is no import.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from twinplan.functions.identifiers import Identifier, Refused, identifier
from twinplan.functions.lexer import Decoded, Masked, RelationCall, Token, closing, decode, mask, plain, tokenize

# Words that end a predicate; two words count only as a pair.
AFTER_WHERE = (
    ("GROUP",),
    ("HAVING",),
    ("WINDOW",),
    ("QUALIFY",),
    ("ORDER",),
    ("LIMIT",),
    ("OFFSET",),
    ("FETCH",),
    ("UNION",),
    ("INTERSECT",),
    ("EXCEPT",),
    ("MINUS",),
    ("FOR",),
    ("INTO",),
    ("CONNECT", "BY"),
    ("START", "WITH"),
    ("CLUSTER", "BY"),
    ("DISTRIBUTE", "BY"),
    ("SORT", "BY"),
    ("USING", "SAMPLE"),
)
#: Words that cannot be an alias that stands without AS.
NOT_ALIAS = frozenset(
    "WHERE GROUP HAVING WINDOW QUALIFY ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS FOR INTO ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL "
    "SEMI ANTI LATERAL TABLESAMPLE PIVOT UNPIVOT AND OR NOT AS FROM SELECT WITH SET".split()
)


@dataclass(frozen=True)
class Projection:
    upstream: Identifier
    output: Identifier
    start: int
    end: int


@dataclass(frozen=True)
class Entry:
    """One entry of the WITH list. call is None where it is no import; star marks an import of all columns."""

    name: Identifier
    ordinal: int
    start: int
    end: int
    body: tuple[Token, ...]
    call: RelationCall | None = None
    star: bool = False
    left_out: frozenset[str] = frozenset()
    commented: bool = False
    alias: Identifier | None = None
    projections: tuple[Projection, ...] = ()
    list_start: int = 0
    list_end: int = 0
    predicate: tuple[Token, ...] = ()

    @property
    def supported(self) -> bool:
        """Whether it can be merged: a list of columns of a relation without an alias, and no comment between a column and its comma."""
        return self.call is not None and not self.star and self.alias is None and not self.commented


@dataclass(frozen=True)
class Reader:
    """A place that reads an entry: FROM, JOIN or a comma in some scope."""

    entry: str
    start: int
    end: int
    alias: Identifier | None
    scope: str | None
    ambiguous: bool
    star: bool
    several: bool
    unqualified: frozenset[str]


@dataclass(frozen=True)
class Model:
    decoded: Decoded
    masked: Masked
    tokens: tuple[Token, ...]
    entries: tuple[Entry, ...]
    readers: tuple[Reader, ...]
    nested: frozenset[str]
    final: tuple[Token, ...]
    rule: str

    def tokens_before(self, offset: int) -> bool:
        """Whether SQL stands before an offset."""
        return any(t.start < offset and t.kind not in ("space", "comment") for t in self.tokens)


def is_name(t: Token) -> bool:
    return t.kind in ("word", "quoted")


def parse_model(raw: bytes, rule: str = "lower") -> Model:
    decoded = decode(raw)
    masked = mask(decoded.text)
    every = tokenize(masked.text)
    ts = plain(every)
    first = next((i for i, t in enumerate(ts) if t.upper in ("WITH", "SELECT")), None)
    empty = Model(decoded, masked, every, (), (), frozenset(), tuple(ts), rule)
    if first is None or ts[first].upper != "WITH":
        return empty
    entries, at, seen = [], first + 1, set()
    while True:
        head = ts[at : at + 3]
        shaped = len(head) == 3 and is_name(head[0]) and head[0].upper != "RECURSIVE" and head[1].upper == "AS" and head[2].text == "("
        if not shaped:
            raise Refused("UNSUPPORTED_IMPORT_SHAPE", "an entry of the WITH list is not `name AS (`")
        name, stop = identifier(head[0].text, rule), closing(ts, at + 2)
        if name.identity in seen:
            raise Refused("UNSUPPORTED_IMPORT_SHAPE", "a name is there twice")
        seen.add(name.identity)
        entry = Entry(name, len(entries), head[0].start, ts[stop].end, tuple(ts[at + 3 : stop]))
        entries.append(_import(entry, masked, rule, every))
        at = stop + 1
        if at < len(ts) and ts[at].text == ",":
            at += 1
            continue
        break
    final = tuple(ts[at:])
    readers: list[Reader] = []
    for e in entries:
        if e.call is None:
            readers += _readers(e.body, e.name.identity, seen, rule)
    readers += _readers(final, None, seen, rule)
    nested = _nested(ts, {e.start for e in entries}, rule)
    return replace(empty, entries=tuple(entries), readers=tuple(readers), nested=nested, final=final)


def _import(entry: Entry, masked: Masked, rule: str, every: tuple[Token, ...]) -> Entry:
    ts = entry.body
    if len(ts) < 4 or ts[0].upper != "SELECT":
        return entry
    depth, source = 0, None
    for i, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.upper == "FROM":
            source = i
            break
    if source is None or source + 1 >= len(ts) or ts[source + 1].text not in masked.calls:
        return entry
    at, alias = source + 2, None
    if at < len(ts) and ts[at].upper == "AS":
        at += 1
        if at >= len(ts) or not is_name(ts[at]):
            return entry
    if at < len(ts) and is_name(ts[at]) and ts[at].upper not in NOT_ALIAS:
        alias, at = identifier(ts[at].text, rule), at + 1
    predicate = ts[at + 1 :] if at < len(ts) and ts[at].upper == "WHERE" else ()
    if at < len(ts) and not predicate or ends_predicate(predicate) or any(t.upper == "SELECT" for t in predicate):
        return entry
    found = replace(entry, call=masked.calls[ts[source + 1].text], alias=alias, predicate=tuple(predicate))
    wanted = ts[1:source]
    if not wanted:
        return entry
    found = replace(found, list_start=wanted[0].start, list_end=wanted[-1].end)
    own = len(wanted) == 3 and is_name(wanted[0]) and wanted[1].text == "." and alias is not None and identifier(wanted[0].text, rule).identity == alias.identity
    if wanted[-1].text == "*" and (len(wanted) == 1 or own):
        return replace(found, star=True)
    if wanted[0].text == "*" and wanted[1].upper in ("EXCEPT", "EXCLUDE"):
        names = [t for t in wanted[2:] if t.text not in ("(", ")", ",")]
        if names and all(map(is_name, names)):
            return replace(found, star=True, left_out=frozenset(identifier(t.text, rule).identity for t in names))
    items, item = [], []
    for t in (*wanted, None):
        if t is None or t.text == ",":
            if t is None and not item and items:
                break  # a comma before FROM
            if not item:
                return entry
            names = [x for x in item if x.upper != "AS"]
            if len(item) - len(names) != (len(item) == 3) or len(item) > 3 or not all(map(is_name, names)) or (len(item) == 3 and item[1].upper != "AS"):
                return entry
            if len(item) == 2 and item[1].upper == "AS" or names[0].upper in ("DISTINCT", "ALL") or names[0].text in masked.calls:
                return entry
            items.append(Projection(identifier(names[0].text, rule), identifier(names[-1].text, rule), item[0].start, item[-1].end))
            item = []
        else:
            item.append(t)
    outputs = [p.output.identity for p in items]
    if len(set(outputs)) != len(outputs):
        return entry
    ends = {p.end for p in items[:-1]}
    commented = any(
        t.kind == "comment" and found.list_start < t.start < found.list_end and every[i - 1 - (every[i - 1].kind == "space")].end in ends for i, t in enumerate(every)
    )
    return replace(found, projections=tuple(items), commented=commented)


def ends_predicate(tokens) -> bool:
    words = [t.upper if t.kind == "word" else "" for t in tokens]
    return any(tuple(words[i : i + len(c)]) == c for i in range(len(words)) for c in AFTER_WHERE)


def _nested(ts: list[Token], own: set[int], rule: str) -> frozenset[str]:
    """Names that WITH lists further in declare; they may hide an entry's name."""
    names = set()
    for i, t in enumerate(ts):
        if t.upper != "AS" or i == 0:
            continue
        j = i + 1
        while j < len(ts) and ts[j].upper in ("NOT", "MATERIALIZED"):
            j += 1
        if j + 1 >= len(ts) or ts[j].text != "(" or ts[j + 1].upper not in ("SELECT", "WITH", "VALUES", "TABLE", "("):
            continue
        k = i - 1
        if ts[k].text == ")":
            depth = 0
            while k >= 0:
                depth += (ts[k].text == ")") - (ts[k].text == "(")
                if depth == 0:
                    break
                k -= 1
            k -= 1
        if k >= 0 and is_name(ts[k]) and ts[k].upper not in ("WITH", "RECURSIVE"):
            if ts[k].start not in own:
                names.add(identifier(ts[k].text, rule).identity)
        else:
            raise Refused("UNSUPPORTED_IMPORT_SHAPE", "a nested name cannot be read")
    return frozenset(names)


def scopes(tokens: tuple[Token, ...]) -> list[list[Token]]:
    """The tokens of each query on its own: what stands in parentheses that hold a query belongs to that one."""
    out: list[list[Token]] = [[]]
    stack, kinds = [out[0]], []
    for i, t in enumerate(tokens):
        if t.text == "(" and t.kind == "punct":
            query = i + 1 < len(tokens) and tokens[i + 1].upper in ("SELECT", "WITH")
            kinds.append(query)
            stack[-1].append(t)
            if query:
                out.append([])
                stack.append(out[-1])
            continue
        if t.text == ")" and t.kind == "punct" and kinds and kinds.pop():
            stack.pop()
        stack[-1].append(t)
    return out


def relations(scope: list[Token]) -> list[tuple[int, bool]]:
    """Places of the relations that a scope names, and whether a comma binds them (another JOIN's ON may not see those)."""
    found, depth, at = [], 0, None
    for i, t in enumerate(scope):
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            depth -= 1
            if at is not None and depth < at:
                at = None
        before = scope[i - 1].upper if i else ""
        if t.upper == "FROM" and not (i > 1 and depth and at is None and "SELECT" not in [x.upper for x in scope[max(0, i - 60) : i]]):
            at = depth
        elif at == depth and t.upper in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT"):
            at = None
        elif before in ("FROM", "JOIN") and t.kind != "punct":
            found.append((i, False))
        elif at == depth and scope[i - 1].text == "," and is_name(t):
            found.append((i, True))
        elif before in ("FROM", "JOIN") or (at == depth and i and scope[i - 1].text == ","):
            found.append((-1, False))
    return found


def table_alias(scope: list[Token], at: int, rule: str) -> Identifier | None:
    i = at + 1
    if i < len(scope) and scope[i].upper == "AS":
        i += 1
    return identifier(scope[i].text, rule) if i < len(scope) and is_name(scope[i]) and scope[i].upper not in NOT_ALIAS else None


def _readers(tokens: tuple[Token, ...], name: str | None, known: set[str], rule: str) -> list[Reader]:
    out = []
    for scope in scopes(tokens):
        bound = relations(scope)
        natural = any(t.upper == "NATURAL" for t in scope)
        commas = sum(1 for i, t in enumerate(scope) if t.text == "," and any(c for _, c in bound))
        bare = frozenset(
            identifier(t.text, rule).identity
            for i, t in enumerate(scope)
            if is_name(t) and (i == 0 or scope[i - 1].text != ".") and (i + 1 == len(scope) or scope[i + 1].text not in (".", "("))
        )
        for at, comma in bound:
            if at < 0 or not is_name(scope[at]):
                continue
            ident = identifier(scope[at].text, rule)
            if ident.identity not in known or (at + 1 < len(scope) and scope[at + 1].text in (".", "(")):
                continue
            alias = table_alias(scope, at, rule)
            called = (alias or ident).identity
            star = False
            for i, t in enumerate(scope):
                if t.text != "*":
                    continue
                if i >= 2 and scope[i - 1].text == "." and is_name(scope[i - 2]):
                    star |= identifier(scope[i - 2].text, rule).identity == called
                elif i and (scope[i - 1].upper in ("SELECT", "DISTINCT", "ALL") or scope[i - 1].text == ","):
                    star = True
            out.append(Reader(ident.identity, scope[at].start, scope[at].end, alias, name, comma or natural, star, len(bound) > 1 or commas > 0, bare))
    return out


def spelled(tokens, rule: str) -> tuple[str, ...]:
    """Tokens without position: words folded, all else as it is."""
    return tuple(identifier(t.text, rule).identity if t.kind == "quoted" else t.text.lower() if t.kind == "word" else t.text for t in tokens)


def fingerprint(tokens, rule: str) -> str:
    """Equal for texts that differ in space, comments and case of words alone; 100 and 100.0, or swapped operands, differ."""
    marks = [f"{'q' if t.kind == 'quoted' and identifier(t.text, rule).identity != identifier(t.text, rule).value.lower() else t.kind[0] if t.kind != 'quoted' else 'w'}:{s}" for t, s in zip(tokens, spelled(tokens, rule))]
    return hashlib.sha256("\0".join(marks).encode()).hexdigest()


@dataclass(frozen=True)
class Group:
    call: RelationCall
    members: tuple[Entry, ...]
    codes: tuple[str, ...] = field(default=())


def duplicate_groups(model: Model) -> list[Group]:
    """Imports of one relation, two or more, by the place of the first."""
    by: dict[tuple, list[Entry]] = {}
    for e in model.entries:
        if e.call is not None:
            by.setdefault(e.call.key, []).append(e)
    return [Group(m[0].call, tuple(m)) for m in by.values() if len(m) > 1]


def called_twice(model: Model) -> list[tuple[RelationCall, bool]]:
    """Relations that several WITH entries name anywhere, and whether each of those entries is a plain import."""
    by: dict[tuple, list[Entry]] = {}
    calls = model.masked.calls
    for e in model.entries:
        for key in dict.fromkeys(calls[t.text].key for t in e.body if t.text in calls):
            by.setdefault(key, []).append(e)
    first = {c.key: c for c in reversed(list(calls.values()))}
    return [(first[k], all(e.supported for e in es)) for k, es in by.items() if len(es) > 1]


def group_codes(model: Model, group: Group, whole_model_ok: bool = True) -> tuple[str, ...]:
    """Why a group cannot be merged, in a fixed order; none means it can."""
    rule, codes = model.rule, []
    if any(not m.supported for m in group.members):
        return ("UNSUPPORTED_IMPORT_SHAPE",)
    names = {m.name.identity for m in group.members}
    if len({fingerprint(m.predicate, rule) for m in group.members}) > 1:
        codes.append("DIFFERENT_PREDICATE")
    upstream: dict[str, str] = {}
    for m in group.members:
        for p in m.projections:
            if upstream.setdefault(p.output.identity, p.upstream.identity) != p.upstream.identity and "PROJECTION_COLLISION" not in codes:
                codes.append("PROJECTION_COLLISION")
    readers = [r for r in model.readers if r.entry in names]
    gains = {m.name.identity: set(upstream) - {p.output.identity for p in m.projections} for m in group.members}
    hidden = bool(model.nested & names)
    unsure = any(r.ambiguous or (r.several and r.unqualified & gains[r.entry]) for r in readers)
    if hidden or unsure:
        codes.append("REFERENCE_BINDING_AMBIGUOUS")
    if any(r.star and gains[r.entry] for r in readers):
        codes.append("UNSUPPORTED_IMPORT_SHAPE")
    if not whole_model_ok:
        codes.append("NONDETERMINISTIC")
    return tuple(codes)
