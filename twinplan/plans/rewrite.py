"""Merging duplicate imports: edits of the file's text that leave all else as it was."""

from __future__ import annotations

import difflib
import hashlib
from dataclasses import dataclass

from twinplan.functions.identifiers import Refused
from twinplan.plans.models import Entry, Group, Model, duplicate_groups, group_codes, parse_model, spelled


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    text: str


@dataclass(frozen=True)
class Plan:
    edits: tuple[Edit, ...]
    before_sha256: str
    after_sha256: str
    candidate: bytes


def apply_edits(text: str, edits) -> str:
    """Edits in bounds and apart from one another, from the last to the first."""
    ordered = sorted(edits, key=lambda e: (e.start, e.end))
    if any(not 0 <= e.start <= e.end <= len(text) for e in ordered) or any(a.end > b.start for a, b in zip(ordered, ordered[1:])):
        raise Refused("INTERNAL_ERROR", "edits overlap or are out of bounds")
    for e in reversed(ordered):
        text = text[: e.start] + e.text + text[e.end :]
    return text


def _unmoved(model: Model, start: int, end: int, also: tuple[int, int] | None = None) -> None:
    """No comment, and no tag but a literal call, may be in a range that is edited."""
    calls = {c.start for c in model.masked.calls.values()}
    for t in model.tokens:
        if t.kind == "comment" and t.start < end and t.end > start:
            raise Refused("COMMENT_RELOCATION_UNSUPPORTED")
    for t in model.masked.tags:
        if t.start < end and t.end > start and t.start not in calls:
            raise Refused("COMMENT_RELOCATION_UNSUPPORTED")


def _joint(text: str, keep: Entry) -> str:
    """What stands between two items of an entry's list: as between its last two, else as its own layout asks."""
    items = keep.projections
    if len(items) > 1:
        return text[items[-2].end : items[-1].start]
    line = text.rfind("\n", 0, items[0].start) + 1
    lead = text[line : items[0].start]
    if lead.strip() or line == 0:
        return ", "
    return "," + ("\r\n" if text[line - 2 : line] == "\r\n" else "\n") + lead


def merge_edits(model: Model, group: Group) -> list[Edit]:
    """The first import takes all columns, the others go, and their readers read the first under the old name."""
    text, keep, gone = model.decoded.text, group.members[0], group.members[1:]
    if model.decoded.newline == "cr":
        raise Refused("UNSUPPORTED_IMPORT_SHAPE", "lines end in CR alone")
    _unmoved(model, keep.list_start, keep.list_end)
    have, added = {p.output.identity for p in keep.projections}, []
    for m in gone:
        for p in m.projections:
            if p.output.identity not in have:
                have.add(p.output.identity)
                added.append(text[p.start : p.end])
    edits = []
    if added:
        joint, end = _joint(text, keep), keep.projections[-1].end
        edits.append(Edit(end, end, "".join(joint + a for a in added)))
    names = {m.name.identity for m in gone}
    for r in model.readers:
        if r.entry in names:
            edits.append(Edit(r.start, r.end, keep.name.source_text if r.alias else f"{keep.name.source_text} as {text[r.start : r.end]}"))
    return edits


def _deletions(model: Model, names: set[str]) -> list[Edit]:
    """Entries with their comma: up to the next entry, or for a run at the end of the list, from the entry before it."""
    edits, es, i = [], model.entries, 0
    while i < len(es):
        if es[i].name.identity not in names:
            i += 1
            continue
        j = i
        while j < len(es) and es[j].name.identity in names:
            j += 1
        start, end = (es[i].start, es[j].start) if j < len(es) else (es[i - 1].end, es[j - 1].end)
        _unmoved(model, start, end)
        edits.append(Edit(start, end, ""))
        i = j
    return edits


def plan_merge(raw: bytes, rule: str = "lower", whole_model_ok: bool = True) -> Plan:
    """One plan for all groups of a model; raises with the first reason that a group has against it."""
    model = parse_model(raw, rule)
    groups = duplicate_groups(model)
    if not groups:
        raise Refused("NO_DUPLICATE_IMPORT")
    edits, gone = [], set()
    for g in groups:
        if codes := group_codes(model, g, whole_model_ok):
            raise Refused(codes[0], ", ".join(codes))
        edits += merge_edits(model, g)
        gone |= {m.name.identity for m in g.members[1:]}
    edits += _deletions(model, gone)
    candidate = model.decoded.encode(apply_edits(model.decoded.text, edits))
    check_merge(model, candidate, groups)
    return Plan(tuple(edits), hashlib.sha256(raw).hexdigest(), hashlib.sha256(candidate).hexdigest(), candidate)


def check_merge(model: Model, candidate: bytes, groups: list[Group]) -> None:
    """The candidate, read anew, is the baseline's tokens with the merge done on them, and no duplicate is left."""
    after = parse_model(candidate, model.rule)
    if duplicate_groups(after):
        raise Refused("INTERNAL_ERROR", "a duplicate is left")
    old = {m.name.identity: g.members[0] for g in groups for m in g.members[1:]}
    kept = [e for e in model.entries if e.name.identity not in old]
    if [e.name.identity for e in kept] != [e.name.identity for e in after.entries]:
        raise Refused("COMPILE_DRIFT", "entries differ")
    readers = {r.start: r for r in model.readers if r.entry in old}

    def expected(tokens):
        out = []
        for t in tokens:
            if t.start in readers:
                first = [t2 for t2 in model.tokens if t2.start == old[readers[t.start].entry].start]
                out += first if readers[t.start].alias else [*first, "as", t]
            else:
                out.append(t)
        return [x if isinstance(x, str) else spelled([x], model.rule)[0] for x in out]

    calls = lambda m, words: [m.masked.calls[w].key if w in m.masked.calls else w for w in words]
    for a, b in zip(kept, after.entries):
        members = next((g.members for g in groups if g.members[0] is a), None)
        if members is None:
            same = calls(model, expected(a.body)) == calls(after, list(spelled(b.body, model.rule)))
        else:
            want = {p.output.identity: p.upstream.identity for m in reversed(members) for p in m.projections}
            same = {p.output.identity: p.upstream.identity for p in b.projections} == want and spelled(a.predicate, model.rule) == spelled(b.predicate, model.rule)
        if not same:
            raise Refused("COMPILE_DRIFT", a.name.value)
    if calls(model, expected(model.final)) != calls(after, list(spelled(after.final, model.rule))):
        raise Refused("COMPILE_DRIFT", "the final query differs")


def unified_diff(path: str, before: bytes, after: bytes) -> str:
    a, b = (x.decode(errors="replace").splitlines(keepends=True) for x in (before, after))
    return "".join(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}"))
