"""A versioned store of relations: snapshots, transactions, commits and recovery.

Facts live as Parquet under the store's folder: one folder of ± rows per commit and
relation, compacted into a snapshot now and then, and a manifest per version that is
written last, so that a commit is there whole or not at all.
"""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import Catalog, RelationMeta
from .operators.delta import Arrangement, MaintainedView, absent, apply_changes, effective, meet, plus, zset
from .plans.rules import Atom, Rule, RuleSet, atom, guard, rule
from .runtime import Scratch, maybe_broadcast, rows_of

COMPACT_AFTER = 8  # delta batches
LOG_KEPT = 1_000  # commits that a subscription can resume from


class Conflict(RuntimeError):
    """Another commit touched what this transaction relied on."""


class ReadOnlyRelation(RuntimeError):
    """A computed relation cannot be written."""


@dataclass(frozen=True)
class Snapshot:
    """One version: relations as DataFrames, immutable."""

    version: int
    tables: dict[str, DataFrame]
    rules: RuleSet

    def base(self, name: str) -> DataFrame:
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        """Stored and derived rows together."""
        if name in self.rules.heads:
            derived = self.rules.fixpoint(_Base(self.tables), [name])[name]
            names = self.tables[name].columns if name in self.tables else derived.columns
            return derived.toDF(*names)
        return self.tables[name]


class _Base:
    def __init__(self, tables):
        self.read = tables.__getitem__


def _frozen(rules: RuleSet) -> RuleSet:
    out = RuleSet()
    out.rules, out.disabled = dict(rules.rules), dict(rules.disabled)
    return out


@dataclass
class Commit:
    version: int
    changes: dict[str, DataFrame]
    catalog_changes: list[dict] = field(default_factory=list)
    visible: dict[str, DataFrame] = field(default_factory=dict)  # of warm derived relations


class Store:
    """Relations, rules and their versions. A relation is held as an arrangement: a base and
    the ± rows of the commits since, so a commit costs what it changes and one look at the
    touched rows, and the base is written again every COMPACT_AFTER commits alone."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.catalog, self.rules = Catalog(), RuleSet()
        self.scratch = Scratch(spark)
        self.version = 0
        self.held: dict[str, Arrangement] = {}
        self.log: deque[Commit] = deque(maxlen=LOG_KEPT)
        self.warm: dict[str, MaintainedView] = {}
        self._lock = threading.RLock()
        self._files: dict[str, dict] = {}
        self.listeners: list = []
        self.hosted: dict[str, dict[str, DataFrame]] = {}

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: a.rows() for n, a in self.held.items()}

    # -- catalog -----------------------------------------------------------------------
    def make_relation(self, name: str, schema: str, **options) -> RelationMeta:
        meta = self.catalog.create(RelationMeta(name, schema, **options))
        self.held[name] = Arrangement(self.scratch, self.spark.createDataFrame([], schema), every=1 << 30)
        self._files[name] = {"snapshot": None, "deltas": []}
        self._publish({}, [{"change": "RelationCreated", "relation": name, "functional": meta.policy == "functional"}])
        return meta

    def make_functional_relation(self, name: str, schema: str, keys: Iterable[int], **options) -> RelationMeta:
        return self.make_relation(name, schema, policy="functional", keys=tuple(keys), **options)

    def install_rule(self, r: Rule) -> str:
        key = self.rules.install(r, {n: m.arity for n, m in self.catalog.relations.items()})
        self._publish({}, [{"change": "RuleInstalled", "rule_id": key, "relation": r.head.relation}])
        return key

    def disable_rule(self, key: str) -> None:
        head = self.rules.rules[key].head.relation
        self.rules.disable(key)
        self._publish({}, [{"change": "RuleDisabled", "rule_id": key, "relation": head}])

    # -- reading -----------------------------------------------------------------------
    def snapshot(self) -> Snapshot:
        return Snapshot(self.version, self.tables, _frozen(self.rules))

    def read(self, name: str) -> DataFrame:
        return self.warm[name].read(name) if name in self.warm else self.snapshot().read(name)

    def keep_warm(self, name: str) -> None:
        """Maintains a derived relation from now on: commits bring its visible changes."""
        if name in self.rules.heads and name not in self.warm:
            needed = self.rules.needed([name])
            used = {name} | {b.relation for r in needed for b in r.body if isinstance(b, Atom)} | {r.head.relation for r in needed}
            self.warm[name] = MaintainedView(_frozen(self.rules), {n: df for n, df in self.tables.items() if n in used}, self.scratch, targets=[name], copy=False)

    def begin(self) -> Transaction:
        return Transaction(self, self.snapshot())

    # -- rows of endpoints -------------------------------------------------------------
    def host_rows(self, endpoint: str, name: str, rows) -> None:
        """Asserts rows into a volatile relation for as long as the endpoint is open."""
        if self.catalog.relations[name].durability != "volatile":
            raise ValueError(f"{name} is durable")
        t = self.begin()
        t.assert_(name, rows)
        mine = self.hosted.setdefault(endpoint, {})
        new = t.asserted[name]
        mine[name] = mine[name].union(new) if name in mine else new
        t.commit()

    def close_endpoint(self, endpoint: str) -> None:
        t = self.begin()
        for name, rows in self.hosted.pop(endpoint, {}).items():
            t.retract(name, rows)
        t.commit()

    # -- committing --------------------------------------------------------------------
    def _publish(self, changes: dict[str, DataFrame], catalog_changes: list[dict]) -> Commit:
        """Writes the change rows, then the manifest, and only then changes anything here: a
        write that fails leaves the store as it was, and the version can be tried again."""
        version = self.version + 1
        files = {n: {"snapshot": f["snapshot"], "deltas": list(f["deltas"])} for n, f in self._files.items()}
        held = {}
        for name, df in changes.items():
            a = self.held[name]
            durable = self.path and self.catalog.relations[name].durability == "durable"
            if durable:
                folder = f"{self.path}/commits/v={version:012d}/{name}"
                df.write.mode("overwrite").parquet(folder)
                files[name]["deltas"].append(folder)
                df = self.spark.read.schema(df.schema).parquet(folder)
            held[name] = Arrangement(self.scratch, a.base, every=1 << 30, deltas=[*a.deltas, df])
            if len(held[name].deltas) >= COMPACT_AFTER:
                rows = held[name].rows()
                if durable:
                    files[name] = {"snapshot": f"{self.path}/snapshots/v={version:012d}/{name}", "deltas": []}
                    rows.write.mode("overwrite").parquet(files[name]["snapshot"])
                    rows = self.spark.read.schema(rows.schema).parquet(files[name]["snapshot"])
                else:
                    rows = self.scratch.keep(rows, name)
                held[name] = Arrangement(self.scratch, rows, every=1 << 30)
        if self.path:
            self._write_manifest(version, files)
        self._files = files
        self.held |= held
        self.version = version
        commit = Commit(version, changes, catalog_changes)
        if catalog_changes:  # rules or relations moved: views are compared with what they were
            for name in list(self.warm):
                was = self.warm.pop(name).read(name)
                self.keep_warm(name)
                now = (self.warm[name].read(name) if name in self.warm else self.tables.get(name, was.limit(0))).toDF(*was.columns)
                commit.visible[name] = self.scratch.keep(zset(absent(now, was), 1).union(zset(absent(was, now), -1)), name)
        else:
            for name, view in self.warm.items():
                out = view.advance({n: c for n, c in changes.items() if n in view.stored})
                if name in out:
                    commit.visible[name] = out[name]
        self.log.append(commit)
        for listen in list(self.listeners):
            listen(commit)
        return commit

    def _manifest(self, version: int, files: dict) -> dict:
        durable = {n: m for n, m in self.catalog.relations.items()}
        return {
            "format": 1, "version": version, "files": files,
            "relations": [{"name": m.name, "schema": m.schema, "policy": m.policy, "keys": list(m.keys), "durability": m.durability, "arguments": list(m.arguments)} for m in durable.values()],
            "rules": {k: rule_to_json(r) for k, r in self.rules.rules.items()}, "disabled": {k: rule_to_json(r) for k, r in self.rules.disabled.items()},
        }

    def _write_manifest(self, version: int, files: dict) -> None:
        jvm = self.spark._jvm
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{version:012d}.json")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{version:012d}.tmp")
        fs = final.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self._manifest(version, files)).encode()))
        out.close()
        if not fs.rename(part, final):
            raise Conflict(f"version {version} exists already")

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        """The store as of its last whole commit, or as of an earlier ``version`` of it;
        volatile relations come back empty."""
        store = cls(spark, path)
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return store
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if version is not None:
            names = [n for n in names if int(n[:-5]) <= version]
        if not names:
            return store
        m = json.loads(spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()[0])
        if m["format"] != 1:
            raise ValueError(f"unknown store format {m['format']}")
        store.version, store._files = m["version"], m["files"]
        for r in m["relations"]:
            meta = store.catalog.create(RelationMeta(r["name"], r["schema"], tuple(r["arguments"]), r["policy"], tuple(r["keys"]), r["durability"]))
            empty = spark.createDataFrame([], meta.schema)
            f = m["files"][meta.name]
            df = spark.read.schema(empty.schema).parquet(f["snapshot"]) if f["snapshot"] else empty
            store.held[meta.name] = Arrangement(store.scratch, df, every=1 << 30, deltas=[spark.read.parquet(d) for d in f["deltas"]])
        for k, r in m["rules"].items():
            store.rules.install(rule_from_json(r, k))
        store.rules.disabled = {k: rule_from_json(r, k) for k, r in m["disabled"].items()}
        return store


def rule_to_json(r: Rule) -> dict:
    from .plans.atoms import Var

    arg = lambda a: {"v": a.name} if isinstance(a, Var) else {"c": a}
    item = lambda b: {"r": b.relation, "a": [arg(x) for x in b.args], "n": b.negated} if isinstance(b, Atom) else {"op": b.op, "a": [arg(b.left), arg(b.right)]}
    return {"head": item(r.head), "body": [item(b) for b in r.body]}


def rule_from_json(j: dict, key: str = "") -> Rule:
    arg = lambda a: f"?{a['v']}" if "v" in a else a["c"]

    def item(b):
        if "op" in b:
            return guard(arg(b["a"][0]), b["op"], arg(b["a"][1]))
        a = atom(b["r"], *[arg(x) for x in b["a"]])
        return ~a if b["n"] else a

    return rule(item(j["head"]), *[item(b) for b in j["body"]], id=key)


class Transaction:
    """A private overlay with read-your-own-writes over a snapshot: per relation the ± rows
    that this transaction makes of it, never a copy of the relation."""

    def __init__(self, store: Store, snapshot: Snapshot):
        self.store, self.snapshot = store, snapshot
        self.pending: dict[str, DataFrame] = {}
        self.asserted: dict[str, DataFrame] = {}
        self.sends: list[tuple[Any, Any]] = []
        self.closed = False

    def _frame(self, name: str, rows) -> DataFrame:
        meta = self.store.catalog.relations.get(name)
        if meta is None:
            raise ReadOnlyRelation(name)
        if isinstance(rows, DataFrame):
            if len(rows.columns) != meta.arity:
                raise ValueError(f"{name} has arity {meta.arity}")
            return rows.toDF(*meta.columns)
        rows = [tuple(r) for r in rows]
        if any(len(r) != meta.arity for r in rows):
            raise ValueError(f"{name} has arity {meta.arity}")
        return self.store.spark.createDataFrame(rows, meta.schema)

    def base(self, name: str) -> DataFrame:
        rows = self.snapshot.tables[name]
        return apply_changes(rows, self.pending[name]) if name in self.pending else rows

    def read(self, name: str) -> DataFrame:
        """Stored and derived rows as this transaction would leave them. A derived relation
        that the store keeps warm is read off its state with the pending changes applied."""
        warm = self.store.warm.get(name)
        if warm is not None and self.store.version == self.snapshot.version and not self.pending:
            return warm.read(name)
        tables = {**self.snapshot.tables, **{n: self.base(n) for n in self.pending}}
        return Snapshot(self.snapshot.version, tables, self.snapshot.rules).read(name)

    def _change(self, name: str, changes: DataFrame) -> None:
        e = effective(self.base(name), changes)
        self.pending[name] = self.store.scratch.keep(plus(self.pending[name], e) if name in self.pending else e, name)

    def assert_(self, name: str, rows) -> None:
        new = self._frame(name, rows)
        self.asserted[name] = self.asserted[name].union(new) if name in self.asserted else new
        self._change(name, zset(new, 1))

    def retract(self, name: str, rows) -> None:
        self._change(name, zset(self._frame(name, rows), -1))

    def retract_where(self, name: str, bindings: list) -> None:
        """Every visible row that matches the bound values; None leaves a place open."""
        hit = self.base(name)
        for c, v in zip(hit.columns, bindings):
            if v is not None:
                hit = hit.where(F.col(c) == F.lit(v))
        self._change(name, zset(hit, -1))

    def replace(self, name: str, rows) -> None:
        """x.name = v: the rows of the same key leave, the new ones enter."""
        meta = self.store.catalog.relations[name]
        if meta.policy != "functional":
            raise ValueError(f"{name} is not functional")
        new = self._frame(name, rows)
        keys = [meta.columns[k] for k in meta.keys]
        held = self.base(name)
        old = held.join(maybe_broadcast(new.select(*keys).distinct()), keys, "left_semi").select(*meta.columns)
        self._change(name, zset(meet(old, new, "left_anti"), -1).union(zset(new, 1)))

    def reconcile(self, name: str, rows) -> None:
        """Makes the relation hold exactly these rows by the fewest changes."""
        want = self._frame(name, rows).distinct()
        have = self.base(name)
        self._change(name, zset(want.subtract(have), 1).union(zset(have.subtract(want), -1)))

    def materialize_rules(self) -> None:
        """Writes every derived relation into a stored one of its name, made where there is none."""
        for head in sorted(self.snapshot.rules.heads):
            rows = self.read(head)
            if head not in self.snapshot.tables:
                self.store.make_relation(head, ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes)))
                self.snapshot = self.store.snapshot()
            self.reconcile(head, rows)

    def destroy_identity(self, identity) -> int:
        """Retracts every base fact with the identity in position 0, of whatever type that
        holds it; how many there were. One job counts over all relations."""
        kinds = ("bigint", "int", "smallint") if isinstance(identity, int) else ("string",)
        hits = {}
        for name in self.snapshot.tables:
            df = self.base(name)
            if df.columns and dict(df.dtypes)[df.columns[0]] in kinds:
                hits[name] = df.where(F.col(df.columns[0]) == F.lit(identity))
        if not hits:
            return 0
        found = reduce(DataFrame.union, [df.select(F.lit(n).alias("relation")) for n, df in hits.items()]).groupBy("relation").count().collect()
        for r in found:
            self._change(r.relation, zset(hits[r.relation], -1))
        return sum(r["count"] for r in found)

    def send(self, mailbox: Any, item: Any) -> None:
        """A message that appears in the mailbox when this transaction commits, and not before."""
        self.sends.append((mailbox, item))

    def require(self, condition: bool) -> None:
        if not condition:
            self.abort()
            raise RuntimeError("requirement not met; the transaction is aborted")

    def abort(self) -> None:
        self.pending, self.sends, self.closed = {}, [], True

    def commit(self) -> Commit | None:
        """Persists, then publishes. Conflicts matter only if the version has moved: a set
        row asserted again that was retracted meanwhile, or a functional key that changed.
        Only touched rows are looked up; no relation is written again."""
        if self.closed:
            raise RuntimeError("the transaction has ended")
        store = self.store
        with store._lock:
            changes = {}
            for name, diff in self.pending.items():
                if store.version != self.snapshot.version:
                    self._check(name, diff)
                    diff = store.scratch.keep(effective(store.tables[name], diff), name)
                if rows_of(diff):
                    changes[name] = diff
            commit = store._publish(changes, []) if changes else None
            self.closed = True
        for mailbox, item in self.sends:
            mailbox.send(item)
        return commit

    def _check(self, name: str, diff: DataFrame) -> None:
        store, meta = self.store, self.store.catalog.relations[name]
        mine, now, cols = self.snapshot.tables[name], store.tables[name], meta.columns
        if meta.policy == "event_append":
            return
        if meta.policy == "functional":
            keys = [cols[k] for k in meta.keys]
            touched = maybe_broadcast(diff.select(*keys).distinct())
            was, is_ = mine.join(touched, keys, "left_semi").select(*cols), now.join(touched, keys, "left_semi").select(*cols)
            if not was.subtract(is_).isEmpty() or not is_.subtract(was).isEmpty():
                raise Conflict(f"a key of {name} changed")
            return
        again = self.asserted.get(name)
        if again is not None and not absent(meet(mine, again, "left_semi"), now).isEmpty():
            raise Conflict(f"a row of {name} was retracted meanwhile")
