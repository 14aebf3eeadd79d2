"""Typed predicates on metadata: a list of conditions, all of which must hold.

Metadata is a VARIANT column.  A condition never fails: without the key, or
with a value of another kind than the operand, it is false.  Numbers compare as
doubles, strings byte by byte, times in canonical form; booleans only equal;
arrays and objects are present, and neither equal nor ordered.  A JSON null is
present.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "exists", "not_exists")
_KEY = re.compile(r"[A-Za-z0-9_-]{1,128}")
_TIME = re.compile(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(\.\d{1,9})?([Zz]|[+-]\d\d:\d\d)")


class InvalidFilterKey(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    key: str
    op: str
    value: object = None


def canonical(value: object) -> object:
    """Numbers as doubles, times and RFC 3339 strings as UTC with nine digits; all else as it is."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, datetime):
        value = (value if value.tzinfo else value.replace(tzinfo=UTC)).isoformat()
    if isinstance(value, str) and (m := _TIME.fullmatch(value)):
        try:
            whole = datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in 'Zz' else m[4]}").astimezone(UTC)
        except ValueError:
            return value
        return f"{whole:%Y-%m-%dT%H:%M:%S}.{(m[3] or '.')[1:]:0<9}Z"
    return value


def canonical_metadata(meta: dict) -> dict:
    return {k: canonical(v) for k, v in meta.items()}


def check_keys(conditions: Iterable[Condition]) -> None:
    for c in conditions:
        if not _KEY.fullmatch(c.key):
            raise InvalidFilterKey(c.key)
        if c.op not in OPERATORS:
            raise ValueError(f"no operator {c.op!r}")


def canonical_json(column: Column) -> Column:
    """Metadata as JSON with every value of its top level canonical; what isn't a JSON object stays as it is."""

    def written(text: str | None) -> str | None:
        try:
            meta = json.loads(text) if text else None
        except ValueError:
            return text
        return json.dumps(canonical_metadata(meta), ensure_ascii=False) if isinstance(meta, dict) else text

    return F.udf(written, StringType(), useArrow=True)(column)


def canonical_string(s: Column) -> Column:
    """RFC 3339 times as UTC with nine digits, other strings as they are; the same as `canonical`, in the JVM."""
    whole = F.try_to_timestamp(F.regexp_replace(s, r"^(.{10})[Tt](.{8})(?:\.[0-9]+)?(.*)$", "$1T$2$3"))
    utc = F.date_format(F.to_utc_timestamp(whole, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    out = F.concat(utc, F.lit("."), F.rpad(F.regexp_extract(s, r"\.([0-9]+)", 1), 9, "0"), F.lit("Z"))
    return F.when(s.rlike("^" + _TIME.pattern + "$"), F.coalesce(out, s)).otherwise(s)


def _value(meta: str, key: str) -> str:
    return f"variant_get({meta}, '$[\"{key}\"]', 'variant')"


def _typed(meta: str, key: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({meta}, '$[\"{key}\"]', '{kind}')")


def _kind(meta: str, key: str) -> Column:
    return F.expr(f"schema_of_variant({_value(meta, key)})")


def _compare(meta: str, key: str, op: str, value: object) -> Column:
    value = canonical(value)
    kind = _kind(meta, key)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (_typed(meta, key, "boolean") == F.lit(value)) if op == "eq" else F.lit(False)
    if isinstance(value, float):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        left, guard = _typed(meta, key, "double"), numeric
    elif isinstance(value, str):
        left, guard = canonical_string(_typed(meta, key, "string")), kind == "STRING"
    elif value is None:
        return (kind == "VOID") if op == "eq" else F.lit(False)
    else:
        return F.lit(False)
    right = F.lit(value)
    test = {"eq": left == right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    return guard & test


def compile_condition(c: Condition, meta: str = "metadata") -> Column:
    present = F.expr(f"{_value(meta, c.key)} IS NOT NULL")
    if c.op == "exists":
        out = present
    elif c.op == "not_exists":
        return F.coalesce(~present, F.lit(True))
    elif c.op == "in":
        values = c.value if isinstance(c.value, (list, tuple, set, frozenset)) else [c.value]
        out = reduce(lambda a, b: a | b, (F.coalesce(_compare(meta, c.key, "eq", v), F.lit(False)) for v in values), F.lit(False)) & present
    elif c.op == "ne":
        out = present & ~F.coalesce(_compare(meta, c.key, "eq", c.value), F.lit(False))
    else:
        out = present & _compare(meta, c.key, c.op, c.value)
    return F.coalesce(out, F.lit(False))


def compile_filter(conditions: Iterable[Condition], meta: str = "metadata") -> Column:
    """All conditions as one column, to be applied below any ranking; true without conditions."""
    conditions = list(conditions)
    check_keys(conditions)
    return reduce(lambda a, b: a & b, (compile_condition(c, meta) for c in conditions), F.lit(True))


def matches(conditions: Iterable[Condition], metadata: dict | None) -> bool:
    """The same on a Python dict, whose values are canonical."""
    meta = metadata or {}

    def kind(x: object) -> str:
        return "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "null" if x is None else "other"

    def equal(a: object, b: object) -> bool:
        return kind(a) == kind(b) != "other" and a == b

    def holds(c: Condition) -> bool:
        there = c.key in meta
        if c.op == "not_exists":
            return not there
        if not there:
            return False
        have, want = canonical(meta[c.key]), c.value
        if c.op == "exists":
            return True
        if c.op == "in":
            return any(equal(have, canonical(v)) for v in (want if isinstance(want, (list, tuple, set, frozenset)) else [want]))
        want = canonical(want)
        if c.op == "ne":
            return not equal(have, want)
        if c.op == "eq":
            return equal(have, want)
        if kind(have) != kind(want) or kind(have) not in ("number", "string"):
            return False
        if kind(have) == "string":
            have, want = have.encode(), want.encode()
        return {"gt": have > want, "gte": have >= want, "lt": have < want, "lte": have <= want}[c.op]

    return all(holds(c) for c in conditions)


_SYMBOLS = (("!=", "ne"), (">=", "gte"), ("<=", "lte"), ("=", "eq"), (">", "gt"), ("<", "lt"))


def scalar(text: str) -> object:
    """true and false as booleans, then numbers, else strings."""
    if text in ("true", "false"):
        return text == "true"
    try:
        return float(text)
    except ValueError:
        return text


def parse(expression: str) -> Condition:
    """`k=v k!=v k>v k>=v k<v k<=v k? !k`, one condition."""
    s = expression.strip()
    found = [(s.index(sym), -len(sym), sym, op) for sym, op in _SYMBOLS if sym in s]
    if found:
        _, _, sym, op = min(found)
        key, value = s.split(sym, 1)
        out = Condition(key.strip(), op, scalar(value.strip()))
    elif s.endswith("?"):
        out = Condition(s[:-1].strip(), "exists")
    elif s.startswith("!"):
        out = Condition(s[1:].strip(), "not_exists")
    else:
        raise ValueError(f"no condition: {expression!r}")
    check_keys([out])
    return out


def fingerprint(conditions: Iterable[Condition]) -> str:
    """16 hex digits that don't depend on the order of conditions, nor of the values of `in`."""

    def form(c: Condition) -> list:
        tag = lambda v: [type(canonical(v)).__name__, canonical(v)]
        if c.op == "in":
            values = c.value if isinstance(c.value, (list, tuple, set, frozenset)) else [c.value]
            return [c.key, c.op, sorted({json.dumps(tag(v)) for v in values})]
        return [c.key, c.op, tag(c.value)]

    forms = sorted({json.dumps(form(c)) for c in conditions})
    return hashlib.sha256("\n".join(forms).encode()).hexdigest()[:16] if forms else ""
