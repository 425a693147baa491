"""Syntax and navigation views from the index tables: outlines, nodes, definitions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .files import file_lines

_TOKEN = r"(//[^\n]*|#[^\n\[]*$|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\d[\w.]*|[A-Za-z_]\w*|\s+|[^\sA-Za-z_0-9])"


def syntax_line(files: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """SyntaxLine: each line as segments of (kind, text): comment, string, number, name, space, mark."""
    kind = lambda t: (
        F.when(t.startswith("//") | (t.startswith("#") & (F.length(t) > 1)), "comment").when(t.startswith('"') | (t.startswith("'") & (F.length(t) > 1)), "string")
        .when(t.rlike(r"^\d"), "number").when(t.rlike(r"^[A-Za-z_]"), "name").when(t.rlike(r"^\s"), "space").otherwise("mark"))
    lines = file_lines(files, start, count)
    tokens = F.regexp_extract_all("line", F.lit(_TOKEN), F.lit(1))
    return lines.select("repository", "revision", "path", "number", F.transform(tokens, lambda t: F.struct(kind(t).alias("kind"), t.alias("text"))).alias("segments"))


def syntax_outline(symbols: DataFrame) -> DataFrame:
    """SyntaxOutline: every living item with a span, once: (repository, path, node, kind, name, lines, bytes)."""
    s = symbols.where("deleted_at is null and start_byte is not null and end_byte is not null")
    node = F.concat_ws(":", "path", F.col("start_byte").cast("string"), F.col("end_byte").cast("string"))
    return s.select("repository", "path", node.alias("node"), F.lower(F.trim("kind")).alias("kind"), "name", "start_line", "end_line", "start_byte", "end_byte").distinct()


def syntax_node_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """SyntaxNodeAt: the innermost item over each place (repository, path, byte_offset).

    A range join inside one file; the smallest span wins by an aggregate that combines
    before the shuffle."""
    o = syntax_outline(symbols).select(F.col("repository").alias("__r"), F.col("path").alias("__p"), "node", "kind", "name", "start_byte", "end_byte")
    p = places.select("repository", "path", "byte_offset").distinct()
    hit = p.join(o, (F.col("repository") == F.col("__r")) & (F.col("path") == F.col("__p")) & (F.col("start_byte") <= F.col("byte_offset")) & (F.col("byte_offset") < F.col("end_byte")))
    best = hit.groupBy("repository", "path", "byte_offset").agg(F.min(F.struct((F.col("end_byte") - F.col("start_byte")).alias("size"), "node", "kind", "name")).alias("n"))
    return best.select("repository", "path", "byte_offset", "n.node", "n.kind", "n.name")


def definition_at(references: DataFrame, symbols: DataFrame, places: DataFrame) -> DataFrame:
    """DefinitionAt: what the reference at each place refers to, and where that lives now."""
    p = places.select("repository", "path", "byte_offset").distinct()
    r = references.where("symbol is not null and symbol <> ''").select(F.col("repository").alias("__r"), F.col("path").alias("__p"), "symbol", F.col("start_byte").alias("__a"), F.col("end_byte").alias("__b")).distinct()
    at = p.join(r, (F.col("repository") == F.col("__r")) & (F.col("path") == F.col("__p")) & (F.col("__a") <= F.col("byte_offset")) & (F.col("byte_offset") < F.col("__b"))).select("repository", "path", "byte_offset", "symbol")
    d = symbols.where("deleted_at is null").select("repository", "symbol", "name", F.lower(F.trim("kind")).alias("kind"), F.col("path").alias("target_path"), "start_line", "end_line", "start_byte", "end_byte")
    return at.join(d, ["repository", "symbol"]).select("repository", "path", "byte_offset", "symbol", "name", "kind", "target_path", "start_line", "end_line", "start_byte", "end_byte", F.lit("index").alias("provider")).distinct()


def references_of(references: DataFrame, wanted: DataFrame) -> DataFrame:
    """ReferencesOf: every reference to the symbols wanted (repository, symbol)."""
    w = wanted.select("repository", "symbol").distinct()
    return references.join(w, ["repository", "symbol"], "left_semi").select("repository", "symbol", "path", "start_line", "end_line", "start_byte", "end_byte", F.lit("index").alias("provider"), "name").distinct()
