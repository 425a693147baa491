"""The logical algebra of ordinal relations: eight operators over one reader."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, functions as F

from ..relation import Relation, RelationError


class Reader(Protocol):
    """Whatever can be asked for a relation's rows: a snapshot, a transaction's overlay, a
    replica, or the delta and full sides of a fixpoint."""

    def read(self, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class Plan:
    """An immutable logical plan; ``execute`` hands Catalyst one lazy DataFrame."""

    op: str
    inputs: tuple[Plan, ...] = ()
    args: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def scan(name: str, bindings: list[Any] | None = None) -> Plan:
        """Rows of a relation; a binding per position, None leaves it free."""
        return Plan("scan", (), {"name": name, "bindings": tuple(bindings or ())})

    @staticmethod
    def input(relation: Relation) -> Plan:
        """A relation value as leaf; columns by heading-name order."""
        return Plan("input", (), {"relation": relation})

    def project(self, *positions: int) -> Plan:
        return Plan("project", (self,), {"positions": positions})

    def join_eq(self, right: Plan, left_keys=(), right_keys=()) -> Plan:
        return Plan("join", (self, right), {"on": (tuple(left_keys), tuple(right_keys))})

    def semi_join(self, right: Plan, left_keys=(), right_keys=()) -> Plan:
        return Plan("semi", (self, right), {"on": (tuple(left_keys), tuple(right_keys))})

    def anti_join(self, right: Plan, left_keys=(), right_keys=()) -> Plan:
        return Plan("anti", (self, right), {"on": (tuple(left_keys), tuple(right_keys))})

    def union(self, right: Plan) -> Plan:
        return Plan("union", (self, right))

    def difference(self, right: Plan) -> Plan:
        return Plan("difference", (self, right))

    def intersect(self, right: Plan) -> Plan:
        """Not an operator of its own: the join on all columns, projected to the left;
        Spark's set operator does it as one semi-join."""
        return Plan("intersect", (self, right))

    def execute(self, reader: Reader) -> Relation:
        return Relation(self._frame(reader), is_set=False) if self.op in ("scan", "input") else self._relation(reader)

    def _frame(self, reader: Reader) -> DataFrame:
        if self.op == "input":
            df = self.args["relation"].df
            df = df.select(*sorted(df.columns))
        else:
            df = reader.read(self.args["name"])
            bindings = self.args["bindings"]
            if bindings and len(bindings) != len(df.columns):
                raise RelationError(f"{self.args['name']} has arity {len(df.columns)}, not {len(bindings)}")
            for column, value in zip(df.columns, bindings):
                if value is not None:
                    df = df.where(F.col(column) == F.lit(value))
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def _relation(self, reader: Reader) -> Relation:
        kids = [p.execute(reader) for p in self.inputs]
        if self.op == "project":
            df = kids[0].df
            if any(not 0 <= i < len(df.columns) for i in self.args["positions"]):
                raise RelationError(f"no such position in {self.args['positions']}")
            return Relation(df.select(*[F.col(df.columns[i]).alias(f"c{k}") for k, i in enumerate(self.args["positions"])]))
        left, right = kids
        if self.op in ("join", "semi", "anti"):
            method = {"join": left.join_eq, "semi": left.semi_join, "anti": left.anti_join}[self.op]
            return method(right, *self.args["on"])
        if len(left.df.columns) != len(right.df.columns):
            raise RelationError("arities differ")
        return {"union": left.union, "difference": left.difference, "intersect": left.intersection}[self.op](right)
