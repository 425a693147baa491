"""Change feeds: subscriptions over commits, and Structured Streaming over a change log."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import W, MaintainedView, apply_changes
from ..runtime import Scratch, rows_of


@dataclass(frozen=True)
class Message:
    kind: str  # snapshot | changes | catalogue | resynchronize | revoked
    version: int
    rows: DataFrame | None = None  # with __w for changes
    detail: tuple = ()


@dataclass
class Mailbox:
    """A FIFO queue in the driver. Transaction.send holds its messages until the commit."""

    items: deque = field(default_factory=deque)
    closed: bool = False

    def send(self, item: Any) -> None:
        if self.closed:
            raise RuntimeError("the mailbox is closed")
        self.items.append(item)

    def receive(self) -> Any | None:
        return self.items.popleft() if self.items else None

    def drain(self) -> list:
        out = list(self.items)
        self.items.clear()
        return out

    def close(self) -> None:
        self.closed = True


@dataclass
class Subscription:
    """Per-version ± batches of one subject from a store.

    ``subject``: 'facts' (stored changes), 'relation' (visible changes, stored or derived)
    or 'catalogue'. ``bindings``: a value per position, None open. ``start``: 'snapshot'
    (the rows first, then changes without a gap) or 'changes'. ``cursor``: resume after a
    version; where commits since then are no longer kept, or the catalogue changed, a
    resynchronize marker comes instead. Beyond ``budget`` undelivered messages the backlog
    is replaced by one such marker. ``allowed`` is asked before every delivery; once it
    says no, a revoked marker ends the subscription.
    """

    store: Any
    subject: str
    relation: str | None = None
    bindings: tuple = ()
    start: str = "changes"
    cursor: int | None = None
    budget: int = 64
    allowed: Any = None
    mailbox: Mailbox = field(default_factory=Mailbox)
    active: bool = True

    def __post_init__(self) -> None:
        if self.subject not in ("facts", "relation", "catalogue"):
            raise ValueError(f"unknown subject {self.subject}")
        if self.subject == "relation":
            self.store.keep_warm(self.relation)
        if self.cursor is not None:
            self._resume()
        elif self.start == "snapshot" and self.subject != "catalogue":
            rows = self._keep(self.store.read(self.relation) if self.subject == "relation" else self.store.tables[self.relation])
            self._put(Message("snapshot", self.store.version, self._filter(rows)))
        self.store.listeners.append(self._on_commit)

    def _keep(self, df: DataFrame) -> DataFrame:
        return self.store.scratch.keep(df, "feed")

    def _filter(self, df: DataFrame) -> DataFrame:
        for c, v in zip([c for c in df.columns if c != W], self.bindings):
            if v is not None:
                df = df.where(F.col(c) == F.lit(v))
        return df

    def _put(self, m: Message) -> None:
        if len(self.mailbox.items) >= self.budget:
            self.mailbox.items.clear()
            m = Message("resynchronize", m.version)
        self.mailbox.send(m)

    def _resume(self) -> None:
        since = [c for c in self.store.log if c.version > self.cursor]
        whole = self.cursor == self.store.version or (bool(since) and since[0].version == self.cursor + 1)
        derived = self.subject == "relation" and self.relation in self.store.rules.heads
        if not whole or any(c.catalog_changes or (derived and c.changes and self.relation not in c.visible) for c in since):
            self._put(Message("resynchronize", self.store.version))
            return
        for c in since:
            self._deliver(c)

    def _on_commit(self, commit) -> None:
        if self.active:
            if self.allowed is not None and not self.allowed():
                self._put(Message("revoked", commit.version))
                self.cancel()
                return
            self._deliver(commit)

    def _deliver(self, commit) -> None:
        if self.subject == "catalogue":
            if commit.catalog_changes:
                self._put(Message("catalogue", commit.version, None, tuple(map(str, commit.catalog_changes))))
        else:
            derived = self.subject == "relation" and (self.relation in self.store.warm or self.relation in commit.visible)
            found = (commit.visible if derived else commit.changes).get(self.relation)
            if found is not None:
                rows = self._keep(self._filter(found))
                if rows_of(rows):
                    self._put(Message("changes", commit.version, rows))

    def cancel(self) -> None:
        self.active = False
        if self._on_commit in self.store.listeners:
            self.store.listeners.remove(self._on_commit)


@dataclass
class Replica:
    """A projected copy of some relations, with rules over it, fed by ± batches."""

    view: MaintainedView
    version: int = 0

    def apply(self, version: int, changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Batches apply once and in order; one that was seen already does nothing."""
        if version <= self.version:
            return {}
        out = self.view.advance(changes)
        self.version = version
        return out

    def read(self, name: str) -> DataFrame:
        return self.view.read(name)


def change_log(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A stream over an append-only folder of change rows: version, __w and the columns."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def replicate(log: DataFrame, target: str, columns: list[str], checkpoint: str, version: str = "version") -> StreamingQuery:
    """Keeps the set that a change log describes as Parquet under ``target``, a folder per
    batch and a pointer written last. Within a batch the last change of each row counts; a
    batch that comes again after a failure finds its folder's pointer and changes nothing.
    """
    spark = log.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*columns).agg(F.max_by(W, F.struct(version, W)).alias(W))
        now = current(spark, target, before=batch_id)
        base = now if now is not None else batch.select(*columns).limit(0)
        out = apply_changes(base.select(*columns), last.select(*columns, W))
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id:09d}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The replica as of its last whole batch (earlier than ``before``, if given)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done.append(int(name[6:]))
    done = [b for b in done if before is None or b < before]
    return spark.read.parquet(f"{target}/batch={max(done):09d}") if done else None


__all__ = ["Mailbox", "Message", "Replica", "Scratch", "Subscription", "change_log", "current", "replicate"]
