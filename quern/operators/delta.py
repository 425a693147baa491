"""Incremental maintenance: weighted rows, delta joins, support counts, delete-and-rederive."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..plans.rules import Atom, Rule, RuleSet, clause, components
from ..runtime import Scratch, maybe_broadcast, plan_bytes, rows_of

W = "__w"


class NegativeSupport(RuntimeError):
    """A derived row lost more support than it had."""


def zset(rows: DataFrame, weight: int = 1) -> DataFrame:
    return rows.withColumn(W, F.lit(weight).cast("long"))


def consolidate(z: DataFrame) -> DataFrame:
    """Weights added per row, zeros dropped; ANSI sums fail on overflow."""
    cols = [c for c in z.columns if c != W]
    return z.groupBy(*cols).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def plus(*zs: DataFrame) -> DataFrame:
    return consolidate(reduce(lambda a, b: a.unionByName(b), zs))


def visible(z: DataFrame) -> DataFrame:
    return z.where(F.col(W) > 0).drop(W)


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The set after ± changes (column __w of +1 or -1): retractions leave, assertions enter."""
    cols = rows.columns
    gone = changes.where(F.col(W) < 0).select(*cols)
    new = changes.where(F.col(W) > 0).select(*cols)
    return meet(rows, gone, "left_anti").union(new).distinct()


def effective(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Only the changes that alter the set: asserts of absent rows, retracts of present ones."""
    new = changes.where(F.col(W) > 0).select(*rows.columns).distinct()
    gone = changes.where(F.col(W) < 0).select(*rows.columns).distinct()
    return zset(absent(new, rows), 1).union(zset(meet(rows, gone, "left_semi").distinct(), -1))


def delta_join(olds: list[DataFrame], deltas: list[DataFrame], on: list[str], whole: bool = False) -> DataFrame:
    """The weighted change of a natural join of several inputs, or with ``whole`` the join
    after it: the old join plus its change. Olds and deltas carry __w.

    A joined row holds every column of its inputs, so where each input has one row per tuple,
    with its old weight and its change, a joined row comes out once and with its final weight:
    the inputs are added up and what they join to, which may be far more, never is. A row's
    pivot is the first input that changed: the inputs before it are unchanged, those after it
    whatever they are, and the term without a pivot is what no change touches."""
    if not whole:  # rows of other keys join no change
        keys = maybe_broadcast(reduce(DataFrame.union, [d.select(*on) for d in deltas]).distinct())
        olds = [o.join(keys, on, "left_semi") for o in olds]
    inputs = [_old_and_change(o, d, i) for i, (o, d) in enumerate(zip(olds, deltas))]
    still = [x.where(f"{W}d{i} = 0") for i, x in enumerate(inputs)]
    moved = [x.where(f"{W}d{i} <> 0") for i, x in enumerate(inputs)]
    terms = [[*still[:i], moved[i], *inputs[i + 1 :]] for i in range(len(inputs))] + ([still] if whole else [])
    was = reduce(lambda a, b: a * b, [F.col(f"{W}o{i}") for i in range(len(inputs))])
    now = reduce(lambda a, b: a * b, [F.col(f"{W}o{i}") + F.col(f"{W}d{i}") for i in range(len(inputs))])
    cols = [*on, *[c for o in olds for c in o.columns if c not in (*on, W)]]
    out = [_join(t, on).select(*cols, (now if whole else now - was).alias(W)) for t in terms]
    return reduce(DataFrame.unionByName, out).where(F.col(W) != 0)


def _old_and_change(old: DataFrame, delta: DataFrame, i: int) -> DataFrame:
    """One row per tuple, with its old weight and its change. A row may join to thousands:
    rows are dealt by hash over a fixed number of tasks, which aren't merged for being small."""
    cols = [c for c in old.columns if c != W]
    both = old.withColumn("__d", F.lit(0).cast("long")).unionByName(delta.withColumn("__d", F.col(W)).withColumn(W, F.lit(0).cast("long")))
    spark = old.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(tasks, *cols).groupBy(*cols).agg(F.sum(W).alias(f"{W}o{i}"), F.sum("__d").alias(f"{W}d{i}")).where(f"{W}o{i} <> 0 or {W}d{i} <> 0")


def _join(inputs: list[DataFrame], on: list[str]) -> DataFrame:
    """The largest input is only scanned, the others broadcast where their size allows: files
    are packed, and rows in memory take some ten times the bytes that the optimizer counts."""
    sizes = [plan_bytes(x) for x in inputs]
    first = sizes.index(max(sizes))
    return reduce(lambda a, b: a.join(maybe_broadcast(b, 16 << 20), on), [x for j, x in enumerate(inputs) if j != first], inputs[first])


def support_change(support: DataFrame, base: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new support, visible ± changes). A row shows while its support is positive or it is
    a base fact, and a change is emitted only where that flips. Negative support fails."""
    cols = [c for c in support.columns if c != W]
    d = consolidate(delta).withColumnRenamed(W, "__d")
    s = support.withColumnRenamed(W, "__s")
    both = s.join(d, cols, "full_outer").select(*cols, F.coalesce("__s", F.lit(0)).alias("old"), (F.coalesce("__s", F.lit(0)) + F.coalesce("__d", F.lit(0))).alias("new"))
    both = both.withColumn("new", F.when(F.col("new") < 0, F.raise_error(F.lit("negative differential support")).cast("long")).otherwise(F.col("new")))
    flips = both.where((F.col("old") > 0) != (F.col("new") > 0)).join(base.select(*cols), cols, "left_anti")
    return both.where("new > 0").select(*cols, F.col("new").alias(W)), flips.select(*cols, F.when(F.col("new") > 0, 1).otherwise(-1).cast("long").alias(W))


def anti_delta(left: DataFrame, left_delta: DataFrame, right: DataFrame, right_delta: DataFrame, on: list[str]) -> DataFrame:
    """The ± change of left minus the keys of right: only touched keys are recomputed,
    before and after, and subtracted."""
    touched = left_delta.select(*on).union(right_delta.select(*on)).distinct()
    cols = left.columns
    l0 = left.join(touched, on, "left_semi")
    r0 = right.join(touched, on, "left_semi")
    l1 = apply_changes(l0, left_delta.select(*cols, W))
    r1 = apply_changes(r0, right_delta.select(*right.columns, W))
    before = l0.join(r0, on, "left_anti")
    after = l1.join(r1, on, "left_anti")
    return zset(after.subtract(before), 1).union(zset(before.subtract(after), -1))


class _Reader:
    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def read(self, name: str) -> DataFrame:
        return self.tables[name]


def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on all of ``right``'s columns, nulls equal; ``right`` is
    broadcast where its size allows, so that a large ``left`` is only scanned."""
    other = maybe_broadcast(right.toDF(*[f"__r{i}" for i in range(len(right.columns))]))
    on = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(right.columns)]
    return left.join(other, reduce(lambda a, b: a & b, on) if on else F.lit(True), how)


def absent(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the small ``found`` that the large ``rows`` lacks: one scan of ``rows``."""
    return meet(found, meet(rows, found, "left_semi"), "left_anti")


@dataclass
class Arrangement:
    """One relation's rows, or a z-set's if ``weighted``, as a kept base and the ± changes
    since: a change is written once and the base again only every ``every`` changes."""

    scratch: Scratch
    base: DataFrame
    weighted: bool = False
    every: int = 8
    deltas: list[DataFrame] = field(default_factory=list)

    def rows(self) -> DataFrame:
        if not self.deltas:
            return self.base
        if self.weighted:
            return plus(self.base, *self.deltas)
        net = plus(*self.deltas)  # effective changes alternate, so a row's add up to -1, 0 or 1
        return meet(self.base, net.where(F.col(W) < 0).drop(W), "left_anti").unionByName(net.where(F.col(W) > 0).drop(W))

    def touched(self, keys: DataFrame) -> DataFrame:
        """The part that holds the rows of ``keys`` alone."""
        part = Arrangement(self.scratch, meet(self.base, keys, "left_semi"), self.weighted, self.every, [meet(d, keys, "left_semi") for d in self.deltas])
        return part.rows()

    def add(self, change: DataFrame) -> None:
        self.deltas = [*self.deltas, change]
        if len(self.deltas) >= self.every:
            self.base, self.deltas = self.scratch.keep(self.rows(), "arranged"), []


def _as_delta(r: Rule, i: int) -> Rule:
    """The rule whose i-th atom is read off a change, also where it was negated."""
    b = r.body[i]
    return Rule(r.head, (*r.body[:i], Atom(b.relation, b.args), *r.body[i + 1 :]), r.id)


@dataclass
class MaintainedView:
    """Derived relations of a rule set kept up to date from base changes.

    ``advance`` takes {relation: ± rows} and returns the visible ± changes of every
    relation, stored or derived. Components whose inputs did not change are skipped.

    A component that doesn't recurse counts each row's derivations: every changed atom in
    turn is read off its change, with the atoms before it new and those after it old, a
    negated atom counting the other way round, and a row shows while its count is positive
    or it is a base fact. A recursive one follows presence: what used a lost row (or a row
    that a negation now meets) is overdeleted and, from the lost rows on, rederived; new
    rows spread semi-naively. State is arranged: only changes are written.

    ``computed`` reads relations that are made at scan time and have no changes; what
    depends on them is evaluated afresh and compared. ``targets`` keeps only what those
    heads depend on. ``copy=False`` takes base frames as they are, for ones already kept.
    """

    rules: RuleSet
    base: dict[str, DataFrame]
    scratch: Scratch
    computed: Any = None
    targets: Iterable[str] | None = None
    copy: bool = True
    version: int = 0

    def __post_init__(self) -> None:
        self.own = self.rules.needed(self.targets if self.targets is not None else self.rules.heads)
        keep = self.scratch.keep
        self.stored = {n: Arrangement(self.scratch, keep(_named(df), n) if self.copy else _named(df)) for n, df in self.base.items()}
        self.state: dict[str, Arrangement] = {}
        self.support: dict[str, Arrangement] = {}
        for component in components(self.own):
            rules = [r for r in self.own if r.head.relation in component]
            if self._recursive(rules, component) or self._opaque(rules):
                held = {h: self.stored[h].rows() for h in component if h in self.stored}
                outside = {b.relation: self.read(b.relation) for r in rules for b in r.body if isinstance(b, Atom) and b.relation not in component}
                for h, df in RuleSet(rules).fixpoint(_Reader({**outside, **held}), scratch=self.scratch).items():
                    self.state[h] = Arrangement(self.scratch, keep(df, h))
                continue
            (head,) = component
            counted = plus(*[zset(clause(r, self.read, bag=True)) for r in rules])
            self.support[head] = Arrangement(self.scratch, keep(counted, head), weighted=True)
            rows = visible(self.support[head].base)
            self.state[head] = Arrangement(self.scratch, keep(rows.union(self.stored[head].rows()).distinct() if head in self.stored else rows, head))

    def _recursive(self, rules, component) -> bool:
        return any(isinstance(b, Atom) and b.relation in component for r in rules for b in r.body)

    def _opaque(self, rules) -> bool:
        """Whether the rules read, through others or not, a relation without changes."""
        names, grown = {b.relation for r in rules for b in r.body if isinstance(b, Atom)}, True
        while grown:
            more = {b.relation for r in self.own if r.head.relation in names for b in r.body if isinstance(b, Atom)} - names
            names, grown = names | more, bool(more)
        return any(n not in self.stored and n not in {r.head.relation for r in self.own} for n in names)

    def read(self, name: str) -> DataFrame:
        held = self.state.get(name) or self.stored.get(name)
        if held is None and self.computed is not None:
            return _named(self.computed.read(name))
        if held is None:
            raise KeyError(name)
        return held.rows()

    def advance(self, changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
        keep = self.scratch.keep
        old = {n: a.rows() for n, a in (self.stored | self.state).items()}
        facts: dict[str, DataFrame] = {}  # effective changes of base facts
        for n, c in changes.items():
            names = [x for x in c.columns if x != W]
            c = c.select(*[F.col(a).alias(f"c{i}") for i, a in enumerate(names)], F.col(W).cast("long").alias(W))
            e = keep(effective(self.stored[n].rows(), c), n)
            if rows_of(e):
                facts[n] = e
                self.stored[n].add(e)
        out = {n: e for n, e in facts.items() if n not in self.state}
        for component in components(self.own):
            rules = [r for r in self.own if r.head.relation in component]
            inputs = {b.relation for r in rules for b in r.body if isinstance(b, Atom)}
            moved = {n: out[n] for n in inputs if n in out}
            mine = {n: facts[n] for n in component if n in facts}
            if self._opaque(rules):
                found = self._afresh(rules, component)
            elif not moved and not mine:
                continue
            elif self._recursive(rules, component):
                found = self._dred(rules, component, old, moved, mine)
            else:
                found = self._counted(rules, next(iter(component)), old, moved, mine)
            for h, diff in found.items():
                diff = keep(diff, h)
                if rows_of(diff):
                    self.state[h].add(diff)
                    out[h] = diff
        self.version += 1
        return out

    def _terms(self, rules, moved, old, now) -> dict[str, list[DataFrame]]:
        """head -> ± derivations, one clause per changed atom and direction of change."""
        out: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, b in enumerate(r.body):
                if isinstance(b, Atom) and b.relation in moved:
                    look = lambda j, n, i=i: now(n) if j < i else old(n)
                    for sign in (1, -1):
                        rows = moved[b.relation].where(F.col(W) == sign).drop(W)
                        out.setdefault(r.head.relation, []).append(zset(clause(_as_delta(r, i), None, i, rows, place=look, bag=True), -sign if b.negated else sign))
        return out

    def _counted(self, rules, head, old, moved, mine) -> dict[str, DataFrame]:
        terms = self._terms(rules, moved, lambda n: old[n], self.read).get(head, [])
        cols = self.state[head].base.columns
        empty = self.state[head].base.limit(0)
        delta = self.scratch.keep(plus(*terms) if terms else zset(empty), head)
        keys = self.scratch.keep(reduce(DataFrame.union, [m.drop(W) for m in mine.values()], delta.select(*cols)).distinct(), head)
        support, _ = support_change(self.support[head].touched(keys), empty, delta)
        self.support[head].add(delta)
        shown = support.select(*cols)
        if head in self.stored:
            shown = shown.union(self.stored[head].touched(keys)).distinct()
        shown = self.scratch.keep(shown, head)
        was = self.scratch.keep(self.state[head].touched(keys), head)
        return {head: zset(meet(shown, was, "left_anti"), 1).union(zset(meet(was, shown, "left_anti"), -1))}

    def _afresh(self, rules, component) -> dict[str, DataFrame]:
        held = {h: self.stored[h].rows() for h in component if h in self.stored}
        outside = {b.relation: self.read(b.relation) for r in rules for b in r.body if isinstance(b, Atom) and b.relation not in component}
        new = RuleSet(rules).fixpoint(_Reader({**outside, **held}), scratch=self.scratch)
        return {h: zset(df.subtract(self.state[h].rows()), 1).union(zset(self.state[h].rows().subtract(df), -1)) for h, df in new.items()}

    def _dred(self, rules, component, old, moved, mine) -> dict[str, DataFrame]:
        keep = self.scratch.keep
        part = lambda z, sign: z.where(F.col(W) == sign).drop(W)

        # 1. Overdelete what used a lost row, transitively, over the old state.
        hit: dict[str, list[DataFrame]] = {h: [part(c, -1)] for h, c in mine.items()}
        for r in rules:
            for i, b in enumerate(r.body):
                if isinstance(b, Atom) and b.relation in moved:
                    hit.setdefault(r.head.relation, []).append(clause(_as_delta(r, i), lambda n: old[n], i, part(moved[b.relation], 1 if b.negated else -1)))
        dead: dict[str, DataFrame] = {}
        while hit:
            front = {}
            for h, parts in hit.items():
                d = meet(old[h], keep(reduce(DataFrame.union, parts).distinct(), h), "left_semi")
                if h in self.stored:
                    d = absent(d, self.stored[h].rows())
                if h in dead:
                    d = meet(d, dead[h], "left_anti")
                d = keep(d, h)
                if rows_of(d):
                    dead[h] = keep(dead[h].union(d), h) if h in dead else d
                    front[h] = d
            hit = {}
            for r in rules:
                for i, b in enumerate(r.body):
                    if isinstance(b, Atom) and not b.negated and b.relation in front:
                        hit.setdefault(r.head.relation, []).append(clause(r, lambda n: old[n], i, front[b.relation]))
        alive = {h: meet(old[h], dead[h], "left_anti") if h in dead else old[h] for h in component}

        # 2. Rederive the dead from what is left, starting at them, and spread what is new.
        grown: dict[str, DataFrame] = {}
        look = lambda n: (alive[n].union(grown[n]) if n in grown else alive[n]) if n in alive else self.read(n)
        found: dict[str, list[DataFrame]] = {h: [part(c, 1)] for h, c in mine.items()}
        for r in rules:
            h = r.head.relation
            if h in dead:
                found.setdefault(h, []).append(clause(Rule(r.head, (Atom("", r.head.args), *r.body)), look, 0, dead[h]))
            for i, b in enumerate(r.body):
                if isinstance(b, Atom) and b.relation in moved:
                    found.setdefault(h, []).append(clause(_as_delta(r, i), look, i, part(moved[b.relation], -1 if b.negated else 1)))
        while found:
            fresh = {}
            for h, parts in found.items():
                d = keep(absent(keep(reduce(DataFrame.union, parts).distinct(), h), look(h)), h)
                if rows_of(d):
                    fresh[h] = d
            for h, d in fresh.items():
                grown[h] = keep(grown[h].union(d), h) if h in grown else d
            found = {}
            for r in rules:
                for i, b in enumerate(r.body):
                    if isinstance(b, Atom) and not b.negated and b.relation in fresh:
                        found.setdefault(r.head.relation, []).append(clause(r, look, i, fresh[b.relation]))
        out = {}
        for h in set(dead) | set(grown):
            none = old[h].limit(0)
            lost, won = dead.get(h, none), grown.get(h, none)
            out[h] = zset(meet(won, lost, "left_anti"), 1).union(zset(meet(lost, won, "left_anti"), -1))
        return out

    def check(self) -> None:
        """Fails if a maintained head differs from its rules evaluated afresh."""
        facts = {n: a.rows() for n, a in self.stored.items()}
        for h, df in RuleSet(self.own).fixpoint(_Layered(facts, self.computed, {r.head.relation for r in self.own}), scratch=self.scratch).items():
            now = self.read(h)
            if not df.subtract(now).isEmpty() or not now.subtract(df).isEmpty():
                raise NegativeSupport(f"{h} has drifted from its rules")


class _Layered:
    def __init__(self, tables, computed, heads):
        self.tables, self.computed, self.heads = tables, computed, heads

    def read(self, name: str) -> DataFrame:
        if name in self.tables or name in self.heads or self.computed is None:
            return self.tables[name]
        return _named(self.computed.read(name))


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
