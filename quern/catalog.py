"""Relation metadata and its reflection as relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .plans.rules import RuleSet


@dataclass(frozen=True)
class RelationMeta:
    name: str
    schema: str  # DDL of the columns, by position
    arguments: tuple[str, ...] = ()
    policy: str = "set"  # set | functional | event_append
    keys: tuple[int, ...] = ()
    durability: str = "durable"  # durable | volatile
    indexes: tuple[tuple[int, ...], ...] = ()

    def __post_init__(self) -> None:
        if self.policy not in ("set", "functional", "event_append"):
            raise ValueError(f"unknown conflict policy {self.policy}")
        if self.policy == "functional" and not self.keys:
            raise ValueError("a functional relation needs key positions")
        if any(not 0 <= k < self.arity for k in self.keys):
            raise ValueError("a key position outside the relation")
        if self.durability not in ("durable", "volatile"):
            raise ValueError(f"unknown durability {self.durability}")

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in _split_ddl(self.schema)]

    @property
    def arity(self) -> int:
        return len(_split_ddl(self.schema))


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and not depth:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()] if cur.strip() else parts


@dataclass
class Catalog:
    relations: dict[str, RelationMeta] = field(default_factory=dict)

    def create(self, meta: RelationMeta) -> RelationMeta:
        if meta.name in self.relations:
            raise ValueError(f"{meta.name} exists")
        self.relations[meta.name] = meta
        return meta

    def reflect(self, spark: SparkSession, rules: RuleSet | None = None) -> dict[str, DataFrame]:
        """The catalog's own relations, from the registry; as small as it is."""
        ms = sorted(self.relations.values(), key=lambda m: m.name)
        frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        indexes = [(m.name, f"{m.name}_index_{i}", ix) for m in ms for i, ix in enumerate(m.indexes or (tuple(range(m.arity)),))]
        out = {
            "Relation": frame([(m.name,) for m in ms], "relation string"),
            "RelationName": frame([(m.name, m.name) for m in ms], "relation string, name string"),
            "Arity": frame([(m.name, m.arity) for m in ms], "relation string, arity int"),
            "RelationDurability": frame([(m.name, m.durability) for m in ms], "relation string, durability string"),
            "ArgumentName": frame([(m.name, i, a) for m in ms for i, a in enumerate(m.arguments or m.columns)], "relation string, position int, name string"),
            "ConflictPolicy": frame([(m.name, m.policy) for m in ms], "relation string, policy string"),
            "FunctionalKey": frame([(m.name, i, k) for m in ms for i, k in enumerate(m.keys)], "relation string, ordinal int, position int"),
            "Index": frame([(n, i) for n, i, _ in indexes], "relation string, index string"),
            "IndexPosition": frame([(i, k, p) for _, i, ix in indexes for k, p in enumerate(ix)], "index string, ordinal int, position int"),
            "IndexStorageKind": frame([(i, "parquet") for _, i, _ in indexes], "index string, kind string"),
        }
        if rules is not None:
            every = {**rules.disabled, **rules.rules}
            out["Rule"] = frame([(k,) for k in sorted(every)], "rule string")
            out["RuleHead"] = frame([(k, every[k].head.relation) for k in sorted(every)], "rule string, relation string")
            out["RuleSource"] = frame([(k, every[k].describe()) for k in sorted(every)], "rule string, source string")
            out["ActiveRule"] = frame([(k, rules.rules[k].head.relation) for k in sorted(rules.rules)], "rule string, relation string")
        return out
