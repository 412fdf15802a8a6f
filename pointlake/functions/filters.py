"""Payload filters: an immutable tree of predicates, compiled to one boolean Column.

Equality is by kind (int 1 is not double 1.0). A missing key makes a comparison false, hence `Neq` and `Not` true; a
comparison across kinds is false; an empty `And` is true and an empty `Or` false. The result is never NULL.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointlake.types import payload_value

_MEMBER = {"bool": "b", "int": "i", "double": "d", "string": "s", "strings": "ss"}


@dataclass(frozen=True)
class Eq:
    key: str
    value: Any


@dataclass(frozen=True)
class Neq:
    key: str
    value: Any


@dataclass(frozen=True)
class Gte:
    key: str
    value: Any


@dataclass(frozen=True)
class Lte:
    key: str
    value: Any


@dataclass(frozen=True)
class In:
    key: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class And:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    part: Any


def _equal(payload: Column, key: str, value: Any) -> Column:
    tagged = payload_value(value)
    at = payload[key]
    if tagged["kind"] == "null":
        return F.coalesce(at["kind"] == "null", F.lit(False))
    member = _MEMBER[tagged["kind"]]
    want = F.array(*map(F.lit, tagged["ss"])).cast("array<string>") if member == "ss" else F.lit(tagged[member])
    return F.coalesce((at["kind"] == tagged["kind"]) & (at[member] == want), F.lit(False))


def _ordered(payload: Column, key: str, value: Any, lower: bool) -> Column:
    tagged = payload_value(value)
    if tagged["kind"] not in ("int", "double", "string"):
        return F.lit(False)
    at, member = payload[key], _MEMBER[tagged["kind"]]
    cmp = at[member] >= F.lit(tagged[member]) if lower else at[member] <= F.lit(tagged[member])
    return F.coalesce((at["kind"] == tagged["kind"]) & cmp, F.lit(False))


def compile_filter(node: Any, payload: Column | None = None) -> Column:
    payload = F.col("payload") if payload is None else payload
    match node:
        case Eq(key, value):
            return _equal(payload, key, value)
        case Neq(key, value):
            return ~_equal(payload, key, value)
        case Gte(key, value):
            return _ordered(payload, key, value, True)
        case Lte(key, value):
            return _ordered(payload, key, value, False)
        case In(key, values):
            return reduce(lambda a, b: a | b, [_equal(payload, key, v) for v in values], F.lit(False))
        case And(parts):
            return reduce(lambda a, b: a & b, [compile_filter(p, payload) for p in parts], F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, [compile_filter(p, payload) for p in parts], F.lit(False))
        case Not(part):
            return ~compile_filter(part, payload)
    raise TypeError(f"not a filter: {node!r}")


def tagged(kind: str, value: Column) -> Column:
    """A payload value built from a column: kind is int, double, string, bool or strings."""
    types = {"b": "boolean", "i": "bigint", "d": "double", "s": "string", "ss": "array<string>"}
    member = _MEMBER[kind]
    return F.struct(F.lit(kind).alias("kind"), *[(value if m == member else F.lit(None)).cast(t).alias(m) for m, t in types.items()])
