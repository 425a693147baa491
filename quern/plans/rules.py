"""Datalog rules: safety, strata, and fixpoints as driver loops over DataFrame plans."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..relation import RelationError
from ..runtime import Scratch, plan_bytes, rows_of
from .atoms import Var, match


class RuleError(RelationError):
    """A rule that is unsafe, unstratified or of the wrong arity."""


class UnsafeNegation(RuleError): ...


class UnsafeGuard(RuleError): ...


class UnboundHeadVariable(RuleError): ...


class UnstratifiedNegation(RuleError): ...


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple
    negated: bool = False

    def __invert__(self) -> Atom:
        return Atom(self.relation, self.args, not self.negated)

    @property
    def vars(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var)))


@dataclass(frozen=True)
class Guard:
    op: str
    left: Any
    right: Any

    @property
    def vars(self) -> list[str]:
        return [a.name for a in (self.left, self.right) if isinstance(a, Var)]


_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def atom(relation: str, *args) -> Atom:
    """Strings that start with ? are variables."""
    return Atom(relation, tuple(Var(a[1:]) if isinstance(a, str) and a.startswith("?") else a for a in args))


def guard(left, op: str, right) -> Guard:
    v = lambda a: Var(a[1:]) if isinstance(a, str) and a.startswith("?") else a
    if op not in _OPS:
        raise RuleError(f"unknown comparison {op}")
    return Guard(op, v(left), v(right))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple
    id: str = ""

    def __post_init__(self) -> None:
        if not self.body:
            raise RuleError("a rule needs a body")
        if self.head.negated:
            raise RuleError("a head cannot be negated")
        bound = {v for b in self.body if isinstance(b, Atom) and not b.negated for v in b.vars}
        for b in self.body:
            loose = set(b.vars) - bound
            if isinstance(b, Atom) and b.negated and loose:
                raise UnsafeNegation(f"{sorted(loose)} in not {b.relation}")
            if isinstance(b, Guard) and loose:
                raise UnsafeGuard(f"{sorted(loose)} in a comparison")
        if set(self.head.vars) - bound:
            raise UnboundHeadVariable(f"{sorted(set(self.head.vars) - bound)} in {self.head.relation}")

    def describe(self) -> str:
        t = lambda a: f"?{a.name}" if isinstance(a, Var) else repr(a)
        item = lambda b: f"{'not ' if b.negated else ''}{b.relation}({', '.join(map(t, b.args))})" if isinstance(b, Atom) else f"{t(b.left)} {b.op} {t(b.right)}"
        return f"{item(self.head)} :- {', '.join(map(item, self.body))}"


def rule(head: Atom, *body, id: str = "") -> Rule:
    return Rule(head, tuple(body), id)


def compare(op: str, left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    """Language comparison: numbers across int and float exactly, which needs more than
    double's 53 bits; other kinds only with their own, and unequal beyond."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    a, b = kinds
    if a in numeric and b in numeric:
        if ("float" in kinds or "double" in kinds) and "bigint" in kinds:
            # A double beyond 2^62 compares as itself; within, both fit decimal(38, 18) or their whole parts decide.
            i, f, flip = (left, right, False) if a == "bigint" else (right, left, True)
            whole = F.floor(f)
            sign = F.when(F.abs(f) >= 2.0**62, F.when(f > 0, -1).otherwise(1)).when(i < whole, -1).when(i > whole, 1).when(f > whole.cast("double"), -1).otherwise(0)
            return _OPS[op](-sign if flip else sign, F.lit(0))
        return _OPS[op](left, right)
    if a != b:
        return F.lit(op == "!=")
    return _OPS[op](left, right)


@dataclass
class Stats:
    rounds: int = 0
    novel: list[int] = field(default_factory=list)


def _columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def clause(r: Rule, read, delta_at: int | None = None, delta: DataFrame | None = None, *, place=None, bag: bool = False) -> DataFrame:
    """One rule as a plan: joins in connected order from the delta on, then guards and
    anti-joins as soon as their variables are bound. Of the atoms that connect, the one the
    optimizer puts smallest goes first; Catalyst pushes the rest. ``place`` reads an atom by
    its place in the body as well as its name; ``bag`` keeps one row per derivation."""
    look = place or (lambda i, name: read(name))
    later = [(i, b) for i, b in enumerate(r.body) if not (isinstance(b, Atom) and not b.negated)]
    order = [(i, match(delta if i == delta_at and delta is not None else look(i, b.relation), list(b.args))) for i, b in enumerate(r.body) if isinstance(b, Atom) and not b.negated]
    sized = {i: plan_bytes(rows) if len(order) > 2 else i for i, rows in order}
    order.sort(key=lambda x: (x[0] != delta_at, sized[x[0]]))
    out: DataFrame | None = None

    def ready(df: DataFrame) -> DataFrame:
        nonlocal later
        rest = []
        for i, b in later:
            if set(b.vars) <= set(df.columns):
                df = _negate(df, match(look(i, b.relation), list(b.args))) if isinstance(b, Atom) else _guard(df, b)
            else:
                rest.append((i, b))
        later = rest
        return df

    while order:
        k = 0 if out is None else next((j for j, (_, rows) in enumerate(order) if set(rows.columns) & set(out.columns)), 0)
        _, rows = order.pop(k)
        if out is None:
            out = rows if rows.columns else rows.withColumn("__unit", F.lit(1))
            out = out if rows.columns or bag else out.distinct()
        else:
            out = _join(out, rows, bag)
        out = ready(out)
    return out.select(*[F.col(f"`{a.name}`").alias(f"c{k}") if isinstance(a, Var) else F.lit(a).alias(f"c{k}") for k, a in enumerate(r.head.args)])


def _join(left: DataFrame, right: DataFrame, bag: bool) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    lk, rk = dict(left.dtypes), dict(right.dtypes)
    if any(lk[c] != rk[c] for c in shared):
        return left.limit(0).join(right.drop(*shared).limit(0)) if len(shared) < len(right.columns) else left.limit(0)
    if not right.columns and not bag:
        return left if not right.isEmpty() else left.limit(0)
    return left.join(right, shared, "inner") if shared else left.crossJoin(right)


def _negate(df: DataFrame, rows: DataFrame) -> DataFrame:
    if not rows.columns:
        return df if rows.isEmpty() else df.limit(0)
    lk, rk = dict(df.dtypes), dict(rows.dtypes)
    return df if any(lk[c] != rk[c] for c in rows.columns) else df.join(rows, rows.columns, "left_anti")


def _guard(df: DataFrame, g: Guard) -> DataFrame:
    side = lambda a: F.col(f"`{a.name}`") if isinstance(a, Var) else F.lit(a)
    left, right = side(g.left), side(g.right)
    kinds = tuple(t for _, t in df.select(left.alias("a"), right.alias("b")).dtypes)
    return df.where(compare(g.op, left, right, kinds))


class RuleSet:
    """Rules by id. Installing and disabling check arity, safety and stratification."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.rules: dict[str, Rule] = {}
        self.disabled: dict[str, Rule] = {}
        for r in rules:
            self.install(r)

    def install(self, r: Rule, arity: dict[str, int] | None = None) -> str:
        for a in [r.head, *[b for b in r.body if isinstance(b, Atom)]]:
            known = (arity or {}).get(a.relation) or next((len(x.args) for q in self.rules.values() for x in [q.head, *[b for b in q.body if isinstance(b, Atom)]] if x.relation == a.relation), None)
            if known is not None and known != len(a.args):
                raise RuleError(f"{a.relation} has arity {known}, not {len(a.args)}")
        key = r.id or f"rule_{len(self.rules) + len(self.disabled)}"
        trial = {**self.rules, key: r}
        strata(trial.values())
        self.rules = trial
        return key

    def disable(self, key: str) -> None:
        trial = {k: r for k, r in self.rules.items() if k != key}
        strata(trial.values())
        self.disabled[key] = self.rules[key]
        self.rules = trial

    @property
    def heads(self) -> set[str]:
        return {r.head.relation for r in self.rules.values()}

    def needed(self, targets: Iterable[str]) -> list[Rule]:
        """The rules that the targets depend on; only those are evaluated."""
        want, grown = set(targets), True
        while grown:
            grown = False
            for r in self.rules.values():
                if r.head.relation in want:
                    new = {b.relation for b in r.body if isinstance(b, Atom)} - want
                    want |= new
                    grown = grown or bool(new)
        return [r for r in self.rules.values() if r.head.relation in want]

    def evaluate(self, reader, targets: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """One pass per stratum, without recursion to a fixpoint."""
        return self._run(reader, targets, None, recursive=False)

    def fixpoint(self, reader, targets: Iterable[str] | None = None, scratch: Scratch | None = None, stats: Stats | None = None, max_rounds: int = 10_000) -> dict[str, DataFrame]:
        """head -> base rows and derived rows, by semi-naive evaluation per component.

        A component that doesn't recurse stays a lazy plan. One that does runs rounds: each
        recursive atom in turn reads the last round's new rows, candidates already known
        fall to an anti-join, and the rest is written to the shared folder, which cuts the
        lineage. The known rows are a union of those tables, so each is written once.
        """
        return self._run(reader, targets, scratch, recursive=True, stats=stats or Stats(), max_rounds=max_rounds)

    def _run(self, reader, targets, scratch, recursive: bool, stats: Stats | None = None, max_rounds: int = 10_000) -> dict[str, DataFrame]:
        rules = self.needed(targets if targets is not None else self.heads)
        done: dict[str, DataFrame] = {}

        def read(name: str) -> DataFrame:
            return done[name] if name in done else reader.read(name)

        def base(name: str, like: DataFrame) -> DataFrame | None:
            try:
                b = reader.read(name)
            except KeyError:
                return None
            return b.toDF(*_columns(len(b.columns)))

        for component in components(rules):
            own = [r for r in rules if r.head.relation in component]
            loops = any(isinstance(b, Atom) and b.relation in component for r in own for b in r.body)
            if not loops or not recursive:
                for head in component:
                    parts = [clause(r, read) for r in own if r.head.relation == head]
                    b = base(head, parts[0])
                    done[head] = _unite(parts + ([b] if b is not None else []))
                continue
            done.update(self._semi_naive(own, component, read, base, scratch, stats, max_rounds))
        return done

    def _semi_naive(self, own, component, read, base, scratch, stats, max_rounds) -> dict[str, DataFrame]:
        seeds: dict[str, list[DataFrame]] = {h: [] for h in component}
        for r in own:
            if not any(isinstance(b, Atom) and b.relation in component for b in r.body):
                seeds[r.head.relation].append(clause(r, read))
        for h in component:
            b = base(h, None)
            if b is not None:
                seeds[h].append(b)
        if not any(seeds.values()):
            raise RuleError(f"{sorted(component)} has neither base rows nor a rule to start from")
        spark = next(p for ps in seeds.values() for p in ps).sparkSession
        s = scratch or Scratch(spark)
        arity = {r.head.relation: len(r.head.args) for r in own}
        schema: dict[str, DataFrame] = {}
        while len(schema) < len(component):  # heads that start empty take their types from the others
            grown = False
            for h in component:
                if h not in schema and seeds[h]:
                    schema[h] = seeds[h][0].limit(0)
                    grown = True
            for r in own:
                known = lambda n: schema[n] if n in schema else read(n)
                if r.head.relation not in schema and all(b.relation in schema or b.relation not in component for b in r.body if isinstance(b, Atom)):
                    schema[r.head.relation] = clause(r, known).limit(0)
                    grown = True
            if not grown:
                raise RuleError(f"no types for {sorted(set(component) - set(schema))}")
        parts = {h: [s.keep(_unite(seeds[h]), h)] if seeds[h] else [] for h in component}
        delta = {h: parts[h][0] for h in component if parts[h]}
        while delta and stats.rounds < max_rounds:
            stats.rounds += 1
            full = {h: _cat(parts[h]) if parts[h] else schema[h] for h in component}
            look = lambda n: full[n] if n in full else read(n)
            fresh: dict[str, list[DataFrame]] = {h: [] for h in component}
            for r in own:
                for i, b in enumerate(r.body):
                    if isinstance(b, Atom) and not b.negated and b.relation in delta:
                        fresh[r.head.relation].append(clause(r, look, i, delta[b.relation]))
            delta = {}
            for h, found in fresh.items():
                if found:
                    cols = _columns(arity[h])
                    new = s.keep(_unite(found).join(full[h], cols, "left_anti"), h)
                    n = rows_of(new)
                    stats.novel.append(n)
                    if n:
                        delta[h] = new
                    else:
                        s.drop(new)
            for h, d in delta.items():
                parts[h].append(d)
                if len(parts[h]) >= 16:  # keep the union's width bounded
                    parts[h] = [s.keep(_cat(parts[h]), h)]
        if delta:
            raise RuleError(f"no fixpoint after {max_rounds} rounds")
        return {h: _cat(parts[h]) if parts[h] else schema[h] for h in component}


def _cat(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _unite(parts: list[DataFrame]) -> DataFrame:
    kinds = {tuple(t for _, t in p.dtypes) for p in parts}
    if len(kinds) > 1:
        raise RuleError(f"clauses of one head give different kinds: {sorted(kinds)}")
    return _cat(parts).distinct()


def components(rules: Iterable[Rule]) -> list[set[str]]:
    """Strongly connected heads, dependencies first (Tarjan; the depth is that of the rule
    graph, which is the driver's). A negation inside a component has no strata."""
    rules = list(rules)
    deps: dict[str, set[str]] = {r.head.relation: set() for r in rules}
    for r in rules:
        deps[r.head.relation] |= {b.relation for b in r.body if isinstance(b, Atom)} & set(deps)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[set[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(deps[v]):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            at = stack.index(v)
            out.append(set(stack[at:]))
            del stack[at:]

    for v in sorted(deps):
        if v not in index:
            visit(v)
    home = {h: i for i, group in enumerate(out) for h in group}
    for r in rules:
        for b in r.body:
            if isinstance(b, Atom) and b.negated and home.get(b.relation) == home[r.head.relation]:
                raise UnstratifiedNegation(f"{r.head.relation} depends on the negation of {b.relation}, which depends on it")
    return out


def strata(rules: Iterable[Rule]) -> dict[str, int]:
    """head -> stratum, read off the condensation: a component lies on the highest stratum
    it reads from, one above where it reads a negation."""
    rules = list(rules)
    level: dict[str, int] = {}
    for group in components(rules):
        reads = [b for r in rules if r.head.relation in group for b in r.body if isinstance(b, Atom) and b.relation not in group]
        height = max((level.get(b.relation, 0) + (b.negated and b.relation in level) for b in reads), default=0)
        level.update(dict.fromkeys(group, height))
    return level
