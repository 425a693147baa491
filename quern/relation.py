"""First-class relations: sets of rows under named headings, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import MapType, StructType, VariantType


class RelationError(ValueError):
    """A heading, arity or kind that an operator cannot take."""


class AmbiguousError(RelationError):
    """`one` found more than one row."""


def _same_kinds(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> bool:
    """Canonical equality distinguishes kinds: 1 and 1.0 never join. So Spark must not
    widen one side; pairs of different types simply have no equal values."""
    lt, rt = dict(left.dtypes), dict(right.dtypes)
    return all(lt[a] == rt[b] for a, b in pairs)


class Relation:
    """A set of rows. ``df`` must hold the heading's columns; duplicates are removed once,
    where an operator can make them, and not after operators that keep sets sets."""

    def __init__(self, df: DataFrame, *, is_set: bool = False):
        if len({c for c in df.columns}) != len(df.columns):
            raise RelationError(f"duplicate column in {df.columns}")
        bad = [f.name for f in df.schema.fields if isinstance(f.dataType, (MapType, VariantType))]
        if bad:
            raise RelationError(f"map and variant cells have no canonical order; store them as sorted arrays of structs: {bad}")
        self.df = df if is_set else df.distinct()

    # -- construction ------------------------------------------------------------------
    @classmethod
    def literal(cls, spark: SparkSession, heading: Sequence[str], rows: Iterable[Sequence], schema: str | StructType | None = None) -> Relation:
        rows = [tuple(r) for r in rows]
        if len(set(heading)) != len(heading):
            raise RelationError(f"duplicate column in {list(heading)}")
        if any(len(r) != len(heading) for r in rows):
            raise RelationError("a row's arity differs from the heading's")
        if not heading:
            return cls.unit(spark) if rows else cls.nothing(spark)
        return cls(spark.createDataFrame(rows, schema or list(heading)))

    @classmethod
    def unit(cls, spark: SparkSession) -> Relation:
        """The relation of no columns with its one row: truthy, the identity of joins."""
        return cls(spark.range(1).select(), is_set=True)

    @classmethod
    def nothing(cls, spark: SparkSession) -> Relation:
        """The empty relation of no columns: falsey, and not SQL's NULL."""
        return cls(spark.range(0).select(), is_set=True)

    # -- inspection --------------------------------------------------------------------
    @property
    def heading(self) -> list[str]:
        return list(self.df.columns)

    def truthy(self) -> bool:
        return not self.df.isEmpty()

    def ordered(self) -> DataFrame:
        """Rows in canonical order (by all columns in heading-name order)."""
        return self.df.orderBy(*sorted(self.df.columns)) if self.df.columns else self.df

    def at(self, index: int) -> dict:
        """The row at a place in canonical order, as a map; a driver-side lookup."""
        rows = self.ordered().offset(index).limit(1).collect() if index >= 0 else []
        if not rows:
            raise IndexError(index)
        return rows[0].asDict()

    def one(self):
        """None for no row, the cell of a single column, a map of several; an error beyond one row."""
        rows = self.df.limit(2).collect()
        if len(rows) > 1:
            raise AmbiguousError("more than one row")
        if not rows:
            return None
        return rows[0][0] if len(rows[0]) == 1 else rows[0].asDict()

    def one_per(self, keys: Sequence[str]) -> Relation:
        """The distributed form of `one`: fails at run time if a key has two rows."""
        rest = [c for c in self.df.columns if c not in keys]
        ok = F.assert_true(F.count("*") == 1, F.lit("E_AMBIGUOUS"))
        out = self.df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], ok.alias("__ok"))
        return Relation(out.where(F.col("__ok").isNull()).drop("__ok"), is_set=True)

    # -- algebra by name ---------------------------------------------------------------
    def project(self, *columns: str) -> Relation:
        unknown = [c for c in columns if c not in self.df.columns]
        if unknown:
            raise RelationError(f"unknown column {unknown}")
        if len(set(columns)) != len(columns):
            raise RelationError(f"duplicate column in {list(columns)}")
        out = self.df.select(*columns)
        return Relation(out, is_set=set(columns) == set(self.df.columns))

    def rename(self, **names: str) -> Relation:
        return Relation(self.df.withColumnsRenamed(names), is_set=True)

    def _aligned(self, other: Relation) -> DataFrame:
        if set(self.df.columns) != set(other.df.columns):
            raise RelationError(f"headings differ: {self.df.columns} and {other.df.columns}")
        return other.df.select(*self.df.columns)

    def _kinds_agree(self, other: Relation) -> bool:
        return _same_kinds(self.df, other.df, [(c, c) for c in self.df.columns])

    def union(self, other: Relation) -> Relation:
        right = self._aligned(other)
        if not self._kinds_agree(other):
            raise RelationError("columns of one name hold different kinds; cast one side")
        return Relation(self.df.union(right))

    def difference(self, other: Relation) -> Relation:
        right = self._aligned(other)
        return Relation(self.df.subtract(right), is_set=True) if self._kinds_agree(other) else self

    def intersection(self, other: Relation) -> Relation:
        right = self._aligned(other)
        return Relation(self.df.intersect(right), is_set=True) if self._kinds_agree(other) else Relation(self.df.limit(0), is_set=True)

    def natural_join(self, other: Relation) -> Relation:
        shared = [c for c in self.df.columns if c in other.df.columns]
        if not shared:
            return Relation(self.df.crossJoin(other.df), is_set=True)
        joined = self.df.join(other.df if _same_kinds(self.df, other.df, [(c, c) for c in shared]) else _empty_like(self.df, other.df, shared), shared, "inner")
        return Relation(joined.select(*self.df.columns, *[c for c in other.df.columns if c not in shared]), is_set=True)

    def restrict(self, condition) -> Relation:
        return Relation(self.df.where(condition), is_set=True)

    # -- algebra by position (ordinal relations) ----------------------------------------
    def _keys(self, other: Relation, left: Sequence[int], right: Sequence[int]):
        if len(left) != len(right):
            raise RelationError("key lists differ in length")
        a = self.df.toDF(*[f"l{i}" for i in range(len(self.df.columns))])
        b = other.df.toDF(*[f"r{i}" for i in range(len(other.df.columns))])
        pairs = [(f"l{i}", f"r{j}") for i, j in zip(left, right)]
        if not _same_kinds(a, b, pairs):
            b = b.limit(0)
        return a, b, [a[x].eqNullSafe(b[y]) for x, y in pairs]

    def join_eq(self, other: Relation, left: Sequence[int] = (), right: Sequence[int] = ()) -> Relation:
        """Left columns then right columns, named c0...; no keys: the product."""
        a, b, on = self._keys(other, left, right)
        out = a.join(b, reduce(lambda x, y: x & y, on), "inner") if on else a.crossJoin(b)
        return Relation(out.toDF(*[f"c{i}" for i in range(len(out.columns))]), is_set=True)

    def semi_join(self, other: Relation, left: Sequence[int] = (), right: Sequence[int] = ()) -> Relation:
        return self._member(other, left, right, "left_semi")

    def anti_join(self, other: Relation, left: Sequence[int] = (), right: Sequence[int] = ()) -> Relation:
        return self._member(other, left, right, "left_anti")

    def _member(self, other: Relation, left: Sequence[int], right: Sequence[int], how: str) -> Relation:
        a, b, on = self._keys(other, left, right)
        out = a.join(b, reduce(lambda x, y: x & y, on) if on else F.lit(True), how)
        return Relation(out.toDF(*self.df.columns), is_set=True)


def _empty_like(left: DataFrame, right: DataFrame, shared: Sequence[str]) -> DataFrame:
    """``right`` without rows, its shared columns typed as ``left``'s."""
    kinds = {f.name: f.dataType for f in left.schema.fields}
    return right.limit(0).select(*[F.lit(None).cast(kinds[c]).alias(c) if c in shared else F.col(c) for c in right.columns])


def top_by_key(rel: Relation, keys: Sequence[str], order) -> Relation:
    """Functional point lookup for all keys at once: the first row per key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return Relation(rel.df.withColumn("__n", n).where("__n = 1").drop("__n"), is_set=True)

