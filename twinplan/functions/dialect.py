"""PostgreSQL's SQL as Spark's: what both spell alike and mean differently, or what only one has, is spelled anew.

Works on tokens, so all else stays as it is written. A call whose meaning Spark
cannot give is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from twinplan.functions.identifiers import Refused
from twinplan.functions.lexer import Token, closing, plain, tokenize

# Names of types, and of Spark's with the same values.
TYPES = {
    "TEXT": "STRING",
    "BPCHAR": "STRING",
    "INT2": "SMALLINT",
    "INT4": "INT",
    "INT8": "BIGINT",
    "FLOAT4": "FLOAT",
    "FLOAT8": "DOUBLE",
    "REAL": "FLOAT",
    "BOOL": "BOOLEAN",
    "BYTEA": "BINARY",
    "NUMERIC": "DECIMAL(38, 18)",
    "DECIMAL": "DECIMAL(38, 18)",
    "TIMESTAMP": "TIMESTAMP_NTZ",
    "TIMESTAMPTZ": "TIMESTAMP",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP_NTZ",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMP",
    "DOUBLE PRECISION": "DOUBLE",
    "CHARACTER VARYING": "STRING",
    "VARCHAR": "STRING",
}
WHOLE = ("SMALLINT", "INT", "INTEGER", "BIGINT")
# Parts of formats of dates and times, and Spark's letters for them.
FORMAT_PARTS = {
    "HH24": "HH",
    "HH12": "hh",
    "YYYY": "yyyy",
    "MONTH": "MMMM",
    "DDD": "DDD",
    "DAY": "EEEE",
    "MON": "MMM",
    "HH": "hh",
    "YY": "yy",
    "MM": "MM",
    "DD": "dd",
    "DY": "EEE",
    "MI": "mm",
    "SS": "ss",
    "MS": "SSS",
    "US": "SSSSSS",
    "AM": "a",
    "PM": "a",
    "Q": "q",
}
_PART = re.compile("|".join(FORMAT_PARTS), re.I)
_CLOCK = {"CURRENT_TIME": "current_time()", "LOCALTIMESTAMP": "localtimestamp()", "LOCALTIME": "current_time()"}


def time_format(fmt: str) -> str:
    """A format of dates and times in Spark's letters; letters that are no part of one are refused, quoted ones stand for themselves."""
    out, at = [], 0
    while at < len(fmt):
        found = _PART.match(fmt, at)
        if found:
            out.append(FORMAT_PARTS[found[0].upper()])
            at = found.end()
        elif fmt[at] == '"':
            end = fmt.find('"', at + 1)
            if end < 0:
                raise Refused("UNSUPPORTED_FUNCTION", fmt)
            out.append("'" + fmt[at + 1 : end].replace("'", "''") + "'")
            at = end + 1
        elif fmt[at].isalnum():
            raise Refused("UNSUPPORTED_FUNCTION", f"the format {fmt}")
        else:
            out.append(fmt[at] if fmt[at] not in "'[]{}#" else f"'{fmt[at]}'")
            at += 1
    return "".join(out)


def _literal(text: str) -> str | None:
    """The value of a plain string literal, None for any other text."""
    ts = plain(tokenize(text))
    return ts[0].text[1:-1].replace("''", "'") if len(ts) == 1 and ts[0].kind == "string" and ts[0].text[0] == "'" else None


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _format(text: str) -> str:
    value = _literal(text)
    if value is None:
        raise Refused("UNSUPPORTED_FUNCTION", "a format that is no literal")
    return _quoted(time_format(value.removeprefix("FM")))


def whole_number(x: str, kind: str) -> str:
    """A cast to whole numbers rounds; Spark's cuts off. Floating point rounds half to even, all else half away from zero."""
    exact = f"CAST({x} AS DECIMAL(38, 18))"
    return f"CAST(CASE WHEN typeof({x}) IN ('double', 'float') THEN CAST(rint(CAST({x} AS DOUBLE)) AS DECIMAL(38, 18)) ELSE round({exact}) END AS {kind})"


def cast(x: str, kind: str) -> str:
    name = " ".join(kind.upper().split())
    bare = re.sub(r"\s*\(.*\)", "", name)
    if "(" in name:
        size = name[name.index("(") : name.index(")") + 1]
        target = f"DECIMAL{size}" if bare in ("NUMERIC", "DECIMAL") else f"VARCHAR{size}" if bare == "CHARACTER VARYING" else TYPES.get(bare, name) if bare.startswith("TIME") else name
    else:
        target = TYPES.get(name, name)
    return whole_number(x, target) if target in WHOLE else f"CAST({x} AS {target})"


def _substring(x: str, start: str, size: str | None = None) -> str:
    """Places before the first count as places without a character."""
    if size is None:
        return f"substring({x}, greatest({start}, 1))"
    return f"substring({x}, greatest({start}, 1), greatest({size} + least({start}, 1) - 1, 0))"


def _extract(part: str, x: str) -> str:
    part = part.strip("'").lower()
    if part == "dow":
        return f"(dayofweek({x}) - 1)"
    if part == "isodow":
        return f"(weekday({x}) + 1)"
    if part == "epoch":
        return f"(unix_micros(CAST({x} AS TIMESTAMP)) / 1000000D)"
    return f"extract({part} FROM {x})"


def _trim(side: str) -> Callable[..., str]:
    return lambda x, chars=None: f"trim({side} {chars} FROM {x})" if chars else f"trim({side} FROM {x})"


def _to_char(x: str, fmt: str) -> str:
    value = _literal(fmt) or ""
    if re.search(r"[90]", value) and not _PART.search(value):
        raise Refused("UNSUPPORTED_FUNCTION", "a number's format")
    return f"date_format({x}, {_format(fmt)})"


def _truncate(x: str, *digits: str) -> str:
    if digits:
        raise Refused("UNSUPPORTED_FUNCTION", "trunc with digits")
    return f"(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END)"


#: Calls that are spelled anew, by their arguments' new text.
CALLS: dict[str, Callable[..., str]] = {
    "LOG": lambda *a: f"log10({a[0]})" if len(a) == 1 else f"log({', '.join(a)})",
    "TRUNC": _truncate,
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(a)})",
    "SUBSTR": _substring,
    "SUBSTRING": _substring,
    "STRPOS": lambda x, y: f"instr({x}, {y})",
    "LTRIM": _trim("LEADING"),
    "RTRIM": _trim("TRAILING"),
    "BTRIM": _trim("BOTH"),
    "TO_CHAR": _to_char,
    "TO_NUMBER": lambda x, fmt: f"to_number({x}, {fmt})",
    "TO_DATE": lambda x, fmt: f"to_date({x}, {_format(fmt)})",
    "TO_TIMESTAMP": lambda x, fmt=None: f"timestamp_seconds({x})" if fmt is None else f"to_timestamp({x}, {_format(fmt)})",
    "DATE_PART": _extract,
    "DATE_TRUNC": lambda unit, x: f"CAST(date_trunc({unit}, {x}) AS TIMESTAMP_NTZ)",
}


def _split(ts: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.text == ",":
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def _type_end(ts: list[Token], at: int) -> int:
    """Past the type that begins at a place."""
    end = at + 1
    words = lambda n: [t.upper for t in ts[end : end + n]]
    if ts[at].upper == "DOUBLE" and words(1) == ["PRECISION"] or ts[at].upper == "CHARACTER" and words(1) == ["VARYING"]:
        end += 1
    if end < len(ts) and ts[end].text == "(":
        end = closing(ts, end) + 1
    if ts[at].upper in ("TIMESTAMP", "TIME") and words(3) in (["WITH", "TIME", "ZONE"], ["WITHOUT", "TIME", "ZONE"]):
        end += 3
    return end


def _spelled(ts: list[Token]) -> str:
    return " ".join(t.text for t in ts)


class _Writer:
    """Pieces of text, and which of them is the last operand, for what is written behind its operand."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.operand: int | None = None

    def add(self, text: str, operand: bool = False) -> None:
        self.operand = len(self.pieces) if operand else None
        self.pieces.append(text)

    def take(self) -> str:
        """The last operand, taken back with a sign that stands before it as one."""
        if self.operand is None:
            raise Refused("UNSUPPORTED_FUNCTION", "an operator without an operand")
        x = "".join(self.pieces[self.operand :])
        del self.pieces[self.operand :]
        solid = [i for i, p in enumerate(self.pieces) if p.strip()]
        if solid and self.pieces[solid[-1]] in ("-", "+"):
            before = self.pieces[solid[-2]] if len(solid) > 1 else "("
            if not re.fullmatch(r"[\w`\"').\]]+", before) or before.upper() in _OPERATORS:
                x = self.pieces[solid[-1]] + x
                del self.pieces[solid[-1] :]
        return x


_OPERATORS = frozenset({"SELECT", "AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "WHERE", "ON", "HAVING", "BY", "IN", "BETWEEN", "DISTINCT", "ALL", "LIKE"})


def _write(ts: list[Token]) -> str:
    """Tokens without space and comments, as Spark's text."""
    w, i = _Writer(), 0
    power_of: str | None = None

    def operand(text: str) -> None:
        nonlocal power_of
        if power_of is not None:
            text, power_of = f"power({power_of}, {text})", None
        w.add(text, True)

    while i < len(ts):
        t, after = ts[i], ts[i + 1] if i + 1 < len(ts) else None
        if w.pieces and not w.pieces[-1].endswith(" ") and t.text not in (".", ",", ")") and not (i and ts[i - 1].text in (".", "(")):
            keep = w.operand
            w.pieces.append(" ")
            w.operand = keep if t.text in ("::", "^") else None
        if t.kind == "string":
            operand(_string(t.text))
            i += 1
        elif t.text == "::":
            end = _type_end(ts, i + 1)
            operand(cast(w.take(), _spelled(ts[i + 1 : end])))
            i = end
        elif t.text == "^":
            if power_of is not None:
                raise Refused("UNSUPPORTED_FUNCTION", "^")
            power_of = w.take()
            i += 1
            if i < len(ts) and ts[i].text in ("-", "+"):
                # the sign belongs to the exponent
                end = _operand_end(ts, i + 1)
                operand(ts[i].text + _write(ts[i + 1 : end]))
                i = end
        elif t.text == "(":
            end = closing(ts, i)
            operand(f"({_write(ts[i + 1 : end])})")
            i = end + 1
        elif t.kind == "word" and after is not None and after.text == "(" and t.upper not in _OPERATORS and t.upper not in ("AS", "OVER", "FILTER", "USING", "VALUES", "EXISTS", "FROM", "JOIN"):
            end = closing(ts, i + 1)
            operand(_call(t, ts[i + 2 : end]) if i == 0 or ts[i - 1].text != "." else f"{t.text}({_write(ts[i + 2 : end])})")
            i = end + 1
        elif t.kind == "word" and t.upper in _CLOCK and not (i and ts[i - 1].text == "."):
            operand(_CLOCK[t.upper])
            i += 1
        elif t.kind in ("word", "quoted", "number") and t.upper not in _OPERATORS:
            text, i = _name(t), i + 1
            while i + 1 < len(ts) and ts[i].text == "." and ts[i + 1].kind in ("word", "quoted") or i + 1 < len(ts) and ts[i].text == "." and ts[i + 1].text == "*":
                text, i = f"{text}.{_name(ts[i + 1])}", i + 2
            operand(text)
        else:
            w.add(t.text)
            i += 1
    return "".join(w.pieces)


def _operand_end(ts: list[Token], at: int) -> int:
    if at >= len(ts):
        raise Refused("UNSUPPORTED_FUNCTION", "^")
    end = closing(ts, at) + 1 if ts[at].text == "(" else at + 1
    if ts[at].kind == "word" and end < len(ts) and ts[end].text == "(":
        end = closing(ts, end) + 1
    while end + 1 < len(ts) and ts[end].text == ".":
        end += 2
    return end


def _name(t: Token) -> str:
    return "`" + t.text[1:-1].replace(t.text[0] * 2, t.text[0]).replace("`", "``") + "`" if t.kind == "quoted" else t.text


def _string(text: str) -> str:
    """A string literal in Spark's spelling, where a backslash escapes: plain, with escapes, or between dollar marks."""
    if text[0] == "$":
        mark = text[: text.index("$", 1) + 1]
        return _quoted(text[len(mark) : -len(mark)])
    if text[0] in "eE":
        return "'" + text[2:-1].replace("''", "\\'") + "'"
    return _quoted(text[1:-1].replace("''", "'"))


def _call(name: Token, inside: list[Token]) -> str:
    upper = name.upper
    words = [t.upper if t.kind == "word" else "" for t in inside]
    if upper in ("CAST", "TRY_CAST"):
        at = max(i for i, w in enumerate(words) if w == "AS")
        return cast(_write(inside[:at]), _spelled(inside[at + 1 :]))
    if upper == "EXTRACT":
        return _extract(inside[0].text, _write(inside[2:]))
    if upper == "SUBSTRING" and "FROM" in words:
        a, b = words.index("FROM"), words.index("FOR") if "FOR" in words else len(words)
        parts = [_write(inside[:a]), _write(inside[a + 1 : b]), *([_write(inside[b + 1 :])] if b < len(words) else [])]
        return _substring(*parts)
    if upper in ("TRIM", "POSITION") and ({"FROM", "IN"} & set(words)):
        return f"{name.text}({_write(inside)})"
    if upper in CALLS:
        try:
            return CALLS[upper](*[_write(a) for a in _split(inside)])
        except TypeError:
            raise Refused("UNSUPPORTED_FUNCTION", f"{name.text} with these arguments") from None
    return f"{name.text}({_write(inside)})"


def to_spark(sql: str) -> str:
    """A query in PostgreSQL's SQL as Spark's text, on one line and without comments."""
    return _write(plain(tokenize(sql)))
