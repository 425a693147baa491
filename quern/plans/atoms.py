"""Query atoms: patterns of bound values, variables and holes over named relations."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..relation import Relation, RelationError


@dataclass(frozen=True)
class Var:
    name: str


class _Hole:
    def __repr__(self) -> str:
        return "_"


HOLE = _Hole()


def V(names: str) -> list[Var]:
    return [Var(n) for n in names.split()]


def match(df: DataFrame, args: list[Any]) -> DataFrame:
    """Columns named by variable, filtered by the bound values and repeated variables;
    filters stay on the scan's own columns so that they reach Parquet."""
    if len(args) != len(df.columns):
        raise RelationError(f"the pattern has {len(args)} places, the relation {len(df.columns)}")
    first: dict[str, str] = {}
    for column, arg in zip(df.columns, args):
        c = F.col(f"`{column}`")
        if isinstance(arg, Var):
            if arg.name in first:
                kinds = dict(df.dtypes)
                same = kinds[column] == kinds[first[arg.name]]
                df = df.where(c == F.col(f"`{first[arg.name]}`") if same else F.lit(False))
            else:
                first[arg.name] = column
        elif arg is not HOLE:
            df = df.where(c == F.lit(arg))
    return df.select(*[F.col(f"`{column}`").alias(name) for name, column in first.items()])


def query(reader, name: str, *args: Any) -> Relation:
    """R(?x, #c, _): the set of bindings of the variables."""
    return Relation(match(reader.read(name), list(args)))


def exists(reader, name: str, *args: Any) -> bool:
    """R(a, b) or R(a, _): whether any row matches; reads until the first."""
    return not match(reader.read(name), [HOLE if isinstance(a, Var) else a for a in args]).isEmpty()


def value(reader, name: str, key: Any, position: int = 1):
    """x.name on a functional relation: its value for the key, or None."""
    df = reader.read(name)
    row = df.where(F.col(df.columns[0]) == F.lit(key)).orderBy(*df.columns).select(df.columns[position]).first()
    return row[0] if row else None


def values(reader, name: str, keys: DataFrame, key: str, out: str) -> DataFrame:
    """The same for a whole column: one left join; null where there is none."""
    df = reader.read(name)
    lookup = df.select(F.col(df.columns[0]).alias("__k"), F.col(df.columns[1]).alias("__v")).groupBy("__k").agg(F.min("__v").alias(out))
    return keys.join(lookup, F.col(key) == F.col("__k"), "left").drop("__k")
