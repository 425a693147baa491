"""Computed relations: read-only rows made at scan time from bound positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import split_words
from ..operators import search
from ..operators.search import MissingRequiredBindings
from . import files


@dataclass(frozen=True)
class ComputedRelation:
    """``make`` gets the bindings (a value per position, None where free) and returns the
    rows; positions in ``required`` must be bound. Bound output positions filter the rows,
    unless ``post_filter`` is off."""

    name: str
    columns: tuple[str, ...]
    required: tuple[int, ...]
    make: Callable[[Sequence[Any]], DataFrame]
    post_filter: bool = True

    def scan(self, bindings: Sequence[Any] | None = None) -> DataFrame:
        b = list(bindings or [None] * len(self.columns))
        if len(b) != len(self.columns):
            raise ValueError(f"{self.name} has arity {len(self.columns)}, not {len(b)}")
        missing = [self.columns[i] for i in self.required if b[i] is None]
        if missing:
            raise MissingRequiredBindings(f"{self.name} needs {missing}")
        df = self.make(b)
        if self.post_filter:
            for i, c in enumerate(self.columns):
                if b[i] is not None and i not in self.required and c in df.columns:
                    df = df.where(F.col(c) == F.lit(b[i]))
        fixed = [F.lit(b[i]).alias(c) if i in self.required and c not in df.columns else F.col(c) for i, c in enumerate(self.columns)]
        return df.select(*fixed).distinct()


class ComputedRegistry:
    """Computed relations by name; a reader of them for atoms and rules."""

    def __init__(self, *relations: ComputedRelation):
        self.relations = {r.name: r for r in relations}

    def read(self, name: str) -> DataFrame:
        return self.relations[name].scan()

    def scan(self, name: str, bindings: Sequence[Any]) -> DataFrame:
        return self.relations[name].scan(bindings)


def _of_revision(symbols: DataFrame, files_: DataFrame, repository: str, revision: str) -> DataFrame:
    """The symbols in files of the repository at that revision."""
    at = files_.where((F.col("repository") == F.lit(repository)) & (F.col("revision") == F.lit(revision))).select(F.col("path").alias("__p")).distinct()
    return symbols.join(at, F.col("path") == F.col("__p"), "left_semi")


def source_relations(units: DataFrame, symbols: DataFrame, files_: DataFrame) -> ComputedRegistry:
    """Search and file views over the index tables under their usual signatures."""
    def keyed(df: DataFrame, b: Sequence[Any], *names: str) -> DataFrame:
        for n, v in zip(names, b):
            df = df.where(F.col(n) == F.lit(v))
        return df

    three = ("repository", "revision", "path")
    return ComputedRegistry(
        ComputedRelation("TextSearch", ("query", "limit", "scope", "unit", "score", "path", "start_line", "end_line", "kind", "title", "snippet"), (0, 1, 2),
                         lambda b: search.text_search(units, b[0], b[1], b[2], symbols)),
        ComputedRelation("SymbolSearch", ("repository", "revision", "query", "limit", "symbol", "name", "kind", "path", "start_line", "end_line"), (0, 1, 2, 3),
                         lambda b: search.symbol_search(_of_revision(symbols, files_, b[0], b[1]), b[2], b[3], b[0])),
        ComputedRelation("FileText", (*three, "text", "hash"), (0, 1, 2), lambda b: files.file_text(keyed(files_, b, *three))),
        ComputedRelation("FileLines", (*three, "start_line", "line_count", "number", "line"), (0, 1, 2, 3, 4), lambda b: files.file_lines(keyed(files_, b, *three), b[3], b[4])),
        ComputedRelation("FileLineCount", (*three, "count"), (0, 1, 2), lambda b: files.file_line_count(keyed(files_, b, *three))),
        ComputedRelation("FileContentHash", (*three, "hash"), (0, 1, 2), lambda b: files.file_content_hash(keyed(files_, b, *three))),
        ComputedRelation("RepositoryEntry", ("repository", "revision", "parent", "path", "kind", "name"), (0, 1, 2), lambda b: files.repository_entries(keyed(files_, b, "repository", "revision"), b[2])),
        ComputedRelation("IndexedFile", ("repository", "path", "language", "model"), (), lambda b: files.indexed_file(units)),
        ComputedRelation("SourceIndex", ("index", "repository", "provider", "status", "version", "build_error"), (), lambda b: files.source_index(units, symbols)),
    )


def nearest_relation(vectors: DataFrame, subject: str, embedding: str, version: int = 0, members: DataFrame | None = None, key: str | None = None) -> ComputedRelation:
    """NearestEmbedding: bound outputs are not filtered afterwards. ``members`` says by
    (index, ``key``) which vectors belong to an index; an index that isn't named has none.
    Without it every vector belongs to every index. Scores are 32-bit floats."""

    def make(b: Sequence[Any]) -> DataFrame:
        held = vectors
        if members is not None:
            mine = members.where(F.col("index") == F.lit(b[0])).select(F.col(key).alias("__m")).distinct()
            held = vectors.join(mine, F.col(key) == F.col("__m"), "left_semi")
        near = search.nearest_embedding(held, b[1], b[2], subject=subject, embedding=embedding)
        return near.withColumn("score", F.col("score").cast("float")).withColumn("snapshot_version", F.lit(version).cast("long"))

    return ComputedRelation("NearestEmbedding", ("index", "query_vector", "limit", "subject", "score", "snapshot_version"), (0, 1, 2), make, post_filter=False)


def register_words(spark: SparkSession, name: str = "words_of") -> None:
    """A table function for SQL: SELECT * FROM words_of('a "b c"')."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position int, word string")
    class Words:
        def eval(self, text: str):
            if text is None:
                return
            yield from enumerate(split_words(text))

    spark.udtf.register(name, Words)
