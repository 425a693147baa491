"""Scalar functions as Column expressions; only `words` and literals need Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

INT_MAX = 2**55 - 1
INT_MIN = -(2**55)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _raise(code: str, kind: str) -> Column:
    return F.raise_error(F.lit(code)).cast(kind)


# -- strings ---------------------------------------------------------------------------
def string_len(s) -> Column:
    return F.length(_c(s))


def string_chars(s) -> Column:
    """One string per code point; the empty list for the empty string."""
    return F.regexp_extract_all(_c(s), F.lit("(?s)."), F.lit(0))


def string_slice(s, start, end) -> Column:
    """Code points start <= i < end; E_INDEX outside the string."""
    s, a, b = _c(s), _c(start) if not isinstance(start, int) else F.lit(start), _c(end) if not isinstance(end, int) else F.lit(end)
    ok = (a >= 0) & (a <= b) & (b <= F.length(s))
    return F.when(ok, F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))).otherwise(_raise("E_INDEX", "string"))


def string_from_chars(chars) -> Column:
    return F.array_join(_c(chars), "")


def string_concat(*parts) -> Column:
    return F.concat(*[_c(p) for p in parts])


def string_join(parts, separator: str) -> Column:
    return F.array_join(_c(parts), separator)


def url_encode_component(s) -> Column:
    """RFC 3986: all but A-Za-z0-9-_.~ as %XX."""
    e = F.replace(F.replace(F.url_encode(_c(s)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def url_decode_component(s) -> Column:
    return F.url_decode(_c(s))


def sort_list(xs) -> Column:
    return F.array_sort(_c(xs))


def string_starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), prefix if isinstance(prefix, Column) else F.lit(prefix))


def string_contains(s, part) -> Column:
    return F.contains(_c(s), part if isinstance(part, Column) else F.lit(part))


def string_equal_fold(a, b) -> Column:
    return F.lower(_c(a)) == F.lower(b if isinstance(b, Column) else F.lit(b))


def edit_distance(a, b) -> Column:
    return F.levenshtein(_c(a), b if isinstance(b, Column) else F.lit(b))


def lower(s) -> Column:
    return F.lower(_c(s))


#: The ordinal words and what they stand for.
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19,
    "twenty": 20, "twentieth": 20, "thirty": 30, "thirtieth": 30, "forty": 40, "fortieth": 40, "fifty": 50, "fiftieth": 50, "sixty": 60, "sixtieth": 60,
    "seventy": 70, "seventieth": 70, "eighty": 80, "eightieth": 80, "ninety": 90, "ninetieth": 90,
}


def parse_ordinal(s) -> Column:
    """'3rd', '3.', '3', 'twenty-first' as a number; null ('nothing') for anything else."""
    t = F.lower(F.trim(_c(s)))
    digits = F.regexp_extract(t, r"^\+?(\d{1,18})(?:st|nd|rd|th|\.)?$", 1)
    number = F.when(digits != "", digits.cast("long"))
    table = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    parts = F.transform(F.split(t, "-"), lambda p: F.try_element_at(table, p))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + p)  # a null part makes null
    return F.when(number > 0, number).when(total > 0, total)


def split_words(text: str) -> list[str]:
    """Shell-like split: white space separates, double quotes join, a backslash escapes."""
    out: list[str] = []
    token, quoted = "", False
    chars = iter(text)
    for ch in chars:
        if ch == "\\":
            token += next(chars, "\\")
        elif ch == '"':
            quoted = not quoted
        elif ch.isspace() and not quoted:
            out += [token] if token else []
            token = ""
        else:
            token += ch
    return out + ([token] if token else [])


@F.pandas_udf(ArrayType(StringType()))
def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """split_words of a column; null for null."""
    for s in batches:
        yield pd.Series([None if t is None else split_words(t) for t in s], dtype=object)


# -- numbers ---------------------------------------------------------------------------
def int56(x) -> Column:
    """A 56-bit int, or E_ARITH."""
    x = _c(x)
    return F.when(x.isNull() | x.between(INT_MIN, INT_MAX), x).otherwise(_raise("E_ARITH", "long"))


def float32(x) -> Column:
    """A finite binary32 with -0.0 as 0.0, or E_ARITH."""
    f = _c(x).cast("float")
    bad = F.isnan(f) | (F.abs(f) == F.lit(float("inf")))
    return F.when(bad, _raise("E_ARITH", "float")).otherwise(f + F.lit(0.0).cast("float"))


def add(a, b) -> Column:
    return int56(_c(a) + _c(b))


def sub(a, b) -> Column:
    return int56(_c(a) - _c(b))


def mul(a, b) -> Column:
    """Through decimal, so that a product beyond 63 bits is E_ARITH too."""
    wide = _c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)")
    return F.when(wide.between(INT_MIN, INT_MAX), wide.cast("long")).when(wide.isNotNull(), _raise("E_ARITH", "long"))


def neg(a) -> Column:
    return int56(-_c(a))


def div_int(a, b) -> Column:
    """The int quotient where it is exact, else null; E_DIV for a zero divisor."""
    a, b = _c(a), _c(b)
    quotient = F.try_divide(a.cast("decimal(19,0)"), b.cast("decimal(19,0)")).cast("long")
    return F.when(b == 0, _raise("E_DIV", "long")).when(F.try_mod(a, b) == 0, quotient)


def div_float(a, b) -> Column:
    """The quotient as a float; E_DIV for a zero divisor."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, _raise("E_DIV", "double")).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def divide(a, b) -> Column:
    """struct<kind, int, float>: an int if exact, else a float; the kind is data-dependent."""
    exact = div_int(a, b)
    return F.struct(F.when(exact.isNotNull(), "int").otherwise("float").alias("kind"), exact.alias("int"), F.when(exact.isNull(), div_float(a, b)).alias("float"))


def rem(a, b) -> Column:
    """The truncated remainder, with the dividend's sign; E_DIV for a zero divisor."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, _raise("E_DIV", "long")).otherwise(F.try_mod(a, b))


# -- truth, collections ----------------------------------------------------------------
def truthy(x, kind: str) -> Column:
    """Booleans by value, lists by being non-empty; all else is true. Null ('nothing') is false."""
    x = _c(x)
    if kind == "boolean":
        return F.coalesce(x, F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def index_list(xs, i) -> Column:
    """xs[i], from 0; E_INDEX outside."""
    xs, i = _c(xs), i if isinstance(i, Column) else F.lit(i)
    return F.when((i >= 0) & (i < F.size(xs)), F.get(xs, i)).otherwise(F.raise_error(F.lit("E_INDEX")))


def slice_list(xs, a: int, b: int) -> Column:
    """xs[a..b], both ends included; E_INDEX outside."""
    xs = _c(xs)
    return F.when(F.lit(0 <= a <= b + 1) & (F.lit(b) < F.size(xs)), F.slice(xs, a + 1, max(0, b - a + 1))).otherwise(F.raise_error(F.lit("E_INDEX")))


def index_or(coll, key, default) -> Column:
    """Safe lookup in a list (from 0) or a map."""
    coll = _c(coll)
    k = key if isinstance(key, Column) else F.lit(key)
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.get(coll, k) if isinstance(key, int) else F.try_element_at(coll, k), d)


def set_index(xs, i: int, v) -> Column:
    """A copy of the list with place i replaced; E_INDEX outside."""
    xs = _c(xs)
    new = v if isinstance(v, Column) else F.lit(v)
    return F.when(F.lit(i >= 0) & (F.lit(i) < F.size(xs)), F.transform(xs, lambda x, k: F.when(k == i, new).otherwise(x))).otherwise(F.raise_error(F.lit("E_INDEX")))


def set_key(m, k, v) -> Column:
    """A copy of the map with k set."""
    key, new = F.lit(k), v if isinstance(v, Column) else F.lit(v)
    return F.map_concat(F.map_filter(_c(m), lambda a, _: a != key), F.create_map(key, new))


def map_pairs(m) -> Column:
    """[key, value] structs in key order: also the map's form as a relation cell."""
    return F.array_sort(F.map_entries(_c(m)))


def collection_length(x) -> Column:
    return F.size(_c(x))


def frob(delegate, payload) -> Column:
    return F.struct(_c(delegate).cast("long").alias("delegate"), _c(payload).alias("payload"))


def frob_delegate(f) -> Column:
    return _c(f)["delegate"]


def frob_value(f) -> Column:
    return _c(f)["payload"]


# -- JSON, embeddings ------------------------------------------------------------------
def json_encode(x) -> Column:
    return F.to_json(_c(x))


def json_decode(x, schema: str) -> Column:
    return F.from_json(_c(x), schema)


def json_get(x, key: str, kind: str = "string") -> Column:
    """A top-level member by key as ``kind``; null where absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(_c(x)), f"$.{key}", kind)


def embed_text(text, dimensions: int = 8) -> Column:
    """The deterministic embedding: code point plus place, modulo 8, counted and scaled to
    length 1 (all zero for the empty text), as floats. Null for null. A batch's
    code points are counted together; higher-order functions would walk the text per slot."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            raw = [b"" if t is None else t.encode("utf-32-le", "surrogatepass") for t in b]
            sizes = np.array([len(r) // 4 for r in raw], dtype="int64")
            points = np.frombuffer(b"".join(raw), dtype="<u4").astype("int64")
            row, first = np.repeat(np.arange(len(raw)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            slot = (points + np.arange(len(points)) - first) % dimensions
            counts = np.bincount(row * dimensions + slot, minlength=len(raw) * dimensions).reshape(-1, dimensions).astype("float64")
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = (counts / np.where(norm == 0, 1, norm)).astype("float32")
            yield pd.Series([None if t is None else u for t, u in zip(b, unit)], dtype=object)

    return embed(_c(text))


# -- logic, literals, tags, errors -------------------------------------------------------
def and_(*xs, kinds: tuple[str, ...] | None = None) -> Column:
    """The first of the operands that isn't true, else the last: operands of one type; what
    stands behind the first false one isn't evaluated."""
    return _chain(xs, kinds, stop_at=False)


def or_(*xs, kinds: tuple[str, ...] | None = None) -> Column:
    """The first true operand, else the last."""
    return _chain(xs, kinds, stop_at=True)


def _chain(xs, kinds, stop_at: bool) -> Column:
    kinds = kinds or ("boolean",) * len(xs)
    *first, last = [_c(x) for x in xs]
    out = last
    for x, kind in reversed(list(zip(first, kinds))):
        met = truthy(x, kind)
        out = F.when(met if stop_at else ~met, x).otherwise(out)
    return out


def list_literal(*parts) -> Column:
    """[a, @b, c]: single values and, wrapped in ``splice``, the elements of lists."""
    return F.concat(*[p.column if isinstance(p, splice) else F.array(_c(p)) for p in parts])


class splice:
    """@xs in a list literal or an argument list: the elements in place of the list."""

    def __init__(self, xs):
        self.column = _c(xs)


def map_literal(*pairs) -> Column:
    """{k -> v, ...} in key order; of equal keys the last value wins. Keys of one type."""
    keys, values = F.array(*[_c(k) for k, _ in pairs]), F.array(*[_c(v) for _, v in pairs])
    kept = F.array_sort(F.array_distinct(keys))
    last = F.transform(kept, lambda k: F.element_at(values, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int")))
    return F.map_from_arrays(kept, last)


def to_symbol(name) -> Column:
    """A symbol as struct<symbol>: it equals symbols of its name and no string; null for null."""
    return F.when(_c(name).isNotNull(), F.struct(_c(name).cast("string").alias("symbol")))


def is_frob(df_type: str) -> bool:
    """Whether a column of the type holds frobs: a delegate with a payload."""
    return df_type.startswith("struct<delegate:bigint,payload:")


def raise_(code: str, kind: str, message: str = "") -> Column:
    """raise: fails the query where the row is evaluated, unless recover meets it first."""
    return F.raise_error(F.lit(f"{code}: {message}" if message else code)).cast(kind)


def recover(attempts: list[tuple[Column, Column]], fallback) -> Column:
    """Per row the value of the first attempt whose condition holds, else ``fallback``.

    An expression of Spark fails for the whole query and can't be caught in a row, so an
    attempt names the condition under which it can't fail, as in
    ``recover([(b != 0, a / b)], 0)``; the value is evaluated only there."""
    out = _c(fallback) if isinstance(fallback, (str, Column)) else F.lit(fallback)
    for condition, value in reversed(attempts):
        out = F.when(condition, value).otherwise(out)
    return out


def error_parts(text) -> Column:
    """struct<code, message> of a caught error's text `CODE: message`."""
    t = _c(text)
    return F.struct(F.regexp_extract(t, r"^(E_\w+)", 1).alias("code"), F.trim(F.regexp_replace(t, r"^E_\w+:?", "")).alias("message"))


class Registry:
    """Scalar functions by name with the number of arguments and the type of the result,
    which is held to: a function whose column has another type is refused when called."""

    def __init__(self):
        self.functions: dict[str, tuple] = {}

    def register(self, name: str, function, arity: int, kind: str) -> None:
        if name in self.functions:
            raise ValueError(f"{name} exists")
        self.functions[name] = (function, arity, kind)

    def call(self, df, name: str, *args, out: str):
        """``df`` with the column ``out``."""
        if name not in self.functions:
            raise KeyError(name)
        function, arity, kind = self.functions[name]
        if len(args) != arity:
            raise ValueError(f"{name} takes {arity} arguments, not {len(args)}")
        done = df.withColumn(out, function(*args))
        found = dict(done.dtypes)[out]
        if found != kind:
            raise TypeError(f"{name} gives {found}, not {kind}")
        return done
