"""Source literals: dynamic values to text and back."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True, order=True)
class Symbol:
    name: str


@dataclass(frozen=True, order=True)
class Identity:
    name: str


@dataclass(frozen=True, order=True)
class ErrorCode:
    name: str


NOTHING = None
INT_MIN, INT_MAX = -(2**55), 2**55 - 1
_TOKEN = re.compile(r"\s*(?:(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<float>-?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))|(?P<int>-?\d+)|(?P<symbol>:[A-Za-z_][\w/]*)|(?P<identity>#[\w/]+)|(?P<word>[A-Za-z_]\w*)|(?P<mark>->|[\[\]{},]))")

#: The kinds in the order in which canonical comparison ranks them.
RANK = ("nothing", "bool", "int", "float", "identity", "symbol", "error_code", "string", "list", "map")


def kind_of(v: Any) -> str:
    if v is None:
        return "nothing"
    for t, k in ((bool, "bool"), (int, "int"), (float, "float"), (Identity, "identity"), (Symbol, "symbol"), (ErrorCode, "error_code"), (str, "string"), ((list, tuple), "list"), (dict, "map")):
        if isinstance(v, t):
            return k
    raise TypeError(f"no kind for {type(v)}")


def canonical_key(v: Any) -> tuple:
    """A key whose order and equality are canonical: by kind first, so 1 and 1.0 differ."""
    k = kind_of(v)
    if k == "list":
        inner: Any = tuple(canonical_key(x) for x in v)
    elif k == "map":
        inner = tuple(sorted((canonical_key(a), canonical_key(b)) for a, b in v.items()))
    elif k in ("symbol", "identity", "error_code"):
        inner = v.name
    else:
        inner = 0 if v is None else v + 0.0 if k == "float" else v
    return (RANK.index(k), inner)


def check(v: Any) -> Any:
    if kind_of(v) == "int" and not INT_MIN <= v <= INT_MAX:
        raise ValueError("E_ARITH: int out of range")
    if kind_of(v) == "float" and not math.isfinite(v):
        raise ValueError("E_ARITH: float not finite")
    return v


def to_literal(v: Any) -> str:
    k = kind_of(v)
    if k == "nothing":
        return "nothing"
    if k == "bool":
        return "true" if v else "false"
    if k == "string":
        return json.dumps(v, ensure_ascii=False)
    if k == "symbol":
        return f":{v.name}"
    if k == "identity":
        return f"#{v.name}"
    if k == "error_code":
        return v.name
    if k == "list":
        return "[" + ", ".join(map(to_literal, v)) + "]"
    if k == "map":
        return "{" + ", ".join(f"{to_literal(a)} -> {to_literal(v[a])}" for a in sorted(v, key=canonical_key)) + "}"
    return repr(check(v))


def from_literal(text: str) -> Any:
    """The value; ValueError for a text that is no literal."""
    tokens, p = [], 0
    while text[p:].strip():
        m = _TOKEN.match(text, p)
        if not m:
            raise ValueError(f"no literal at {p}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        p = m.end()
    value, rest = _parse(tokens)
    if rest:
        raise ValueError("more than one literal")
    return value


def _parse(t: list) -> tuple[Any, list]:
    if not t:
        raise ValueError("no literal")
    (kind, s), t = t[0], t[1:]
    if kind == "int":
        return check(int(s)), t
    if kind == "float":
        return check(float(s)), t
    if kind == "string":
        return json.loads(s), t
    if kind == "symbol":
        return Symbol(s[1:]), t
    if kind == "identity":
        return Identity(s[1:]), t
    if kind == "word":
        if s in ("true", "false", "nothing"):
            return {"true": True, "false": False, "nothing": None}[s], t
        if s.startswith("E_"):
            return ErrorCode(s), t
        raise ValueError(s)
    if s == "[":
        out: list = []
        while t and t[0][1] != "]":
            v, t = _parse(t)
            out.append(v)
            if t and t[0][1] == ",":
                t = t[1:]
        if not t:
            raise ValueError("open list")
        return out, t[1:]
    if s == "{":
        table: dict = {}
        while t and t[0][1] != "}":
            k, t = _parse(t)
            if not t or t[0][1] != "->":
                raise ValueError("a map needs ->")
            table[k], t = _parse(t[1:])
            if t and t[0][1] == ",":
                t = t[1:]
        if not t:
            raise ValueError("open map")
        return table, t[1:]
    raise ValueError(s)


@F.pandas_udf(StringType())
def literal_kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The kind of each literal text; null where it is none."""

    def one(s):
        try:
            return kind_of(from_literal(s)) if s is not None else None
        except ValueError:
            return None

    for b in batches:
        yield b.map(one)


@F.pandas_udf(StringType())
def normal_literal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each literal text in its canonical spelling; null where it is none."""

    def one(s):
        try:
            return to_literal(from_literal(s)) if s is not None else None
        except ValueError:
            return None

    for b in batches:
        yield b.map(one)


def json_encode_value(v: Any) -> str:
    """nothing as null, symbols as strings; map keys must be strings or symbols."""

    def plain(x):
        k = kind_of(x)
        if k == "symbol":
            return x.name
        if k == "list":
            return [plain(y) for y in x]
        if k == "map":
            if any(kind_of(a) not in ("string", "symbol") for a in x):
                raise ValueError("a JSON key must be a string or a symbol")
            return {a if isinstance(a, str) else a.name: plain(b) for a, b in x.items()}
        if k in ("identity", "error_code"):
            raise ValueError(f"{k} has no JSON form")
        return check(x)

    return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))


def json_decode_value(text: str) -> Any:
    """null as nothing, object keys as symbols, whole numbers as ints."""
    return json.loads(text, object_pairs_hook=lambda ps: {Symbol(a): b for a, b in ps}, parse_int=lambda s: check(int(s)), parse_constant=lambda s: (_ for _ in ()).throw(ValueError(s)))
