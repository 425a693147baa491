"""Search as relations: nearest embeddings, keyword search over text units, symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


class MissingRequiredBindings(ValueError):
    """A computed relation was read without a position that must be bound."""


def cosine(a: Column, b: Column) -> Column:
    """In doubles; an error for lengths that differ and for empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding dimensions differ")).cast("double"))
        .when((F.size(a) == 0) | (norm == 0), F.raise_error(F.lit("empty or zero vector")).cast("double"))
        .otherwise(dot / norm)
    )


def nearest_embedding(vectors: DataFrame, query_vector: list[float], limit: int, *, subject: str, embedding: str) -> DataFrame:
    """(subject, score): the ``limit`` subjects nearest by cosine, the best embedding of
    each counting; ties by subject. Exact: one scan with a partial maximum per subject and
    a distributed top-k. Null subjects and embeddings are left out."""
    if query_vector is None or limit is None:
        raise MissingRequiredBindings("query vector and limit must be bound")
    if limit < 0:
        raise ValueError("limit must not be negative")
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    scored = vectors.where(F.col(embedding).isNotNull() & F.col(subject).isNotNull()).select(F.col(subject).alias("subject"), cosine(F.col(embedding), q).alias("score"))
    return scored.groupBy("subject").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "subject").limit(limit)


def search_terms(query: str) -> list[str]:
    return sorted({t.lower() for t in re.split(r"[^A-Za-z0-9_-]+", query) if t})


#: The scopes of a text search, the first that fits counting: (name, pattern of the path).
#: A parameter of text_search; what fits none is of the scope ``other``.
SCOPES = (("tests", r"(^|/)(tests?|spec)/|[._-](test|spec)\.\w+$"), ("docs", r"(^|/)docs?/|\.(md|markdown|rst|txt)$"), ("code", r"\.\w+$"))


def text_scope(path: Column, scopes: tuple[tuple[str, str], ...] = SCOPES) -> Column:
    """The scope that a path belongs to."""
    out = F.lit("other")
    for name, pattern in reversed(scopes):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


#: What a hit in each field scores, for the whole query and for each term.
WHOLE = {"path": 260, "title": 210, "text": 120}
TERM = {"path": 110, "title": 95, "text": 55, "kind": 20}
FILE_EXACT, FILE_PART, SYMBOL_EXACT, SYMBOL_PART = 240, 180, 320, 190


def text_search(units: DataFrame, query: str, limit: int, scope: str = "all", symbols: DataFrame | None = None, scopes: tuple[tuple[str, str], ...] = SCOPES) -> DataFrame:
    """(unit, score, path, start_line, end_line, kind, title, snippet) of the best units;
    start_line and end_line are both the line that matched.

    Scores add up over the whole query, its terms and overlapping symbols; units scoring 0
    drop out; order is by score, path, start line and unit. Symbols that match are few and
    found first, so they join as the small side; overlaps are summed per unit before
    scoring. Null fields score nothing. A ``scope`` that ``scopes`` doesn't name is all units.
    """
    terms, whole = search_terms(query), query.lower()
    if not terms:
        return units.limit(0).select("unit", F.lit(0).cast("long").alias("score"), "path", "start_line", F.col("start_line").alias("end_line"), "kind", "title", F.lit("").alias("snippet"))
    u = units.where(text_scope(F.col("path"), scopes) == scope) if scope in dict(scopes) else units
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("path", "title", "text", "kind")}
    file_ = F.element_at(F.split(low["path"], "/"), -1)
    has = lambda col, part, points: F.when(col.contains(part), points).otherwise(0)
    score = sum((has(low[c], whole, p) for c, p in WHOLE.items()), F.lit(0))
    for t in terms:
        score = score + F.when(file_ == t, FILE_EXACT).when(file_.contains(t), FILE_PART).otherwise(0)
        score = score + sum((has(low[c], t, p) for c, p in TERM.items()), F.lit(0))
    u = u.select("repository", "unit", "path", "title", "kind", "text", "start_line", "end_line", score.cast("long").alias("__score"))
    line = F.lit(None).cast("long")
    if symbols is not None:
        name = F.lower("name")
        hit = name.contains(whole)
        for t in terms:
            hit = hit | name.contains(t)
        sym = symbols.where(hit).select(F.col("repository").alias("__r"), F.col("path").alias("__p"), F.col("start_line").alias("__a"), F.col("end_line").alias("__b"),
                                        F.when(name == whole, SYMBOL_EXACT).otherwise(SYMBOL_PART).alias("__pts")).distinct()
        near = u.select("repository", "unit", "path", "start_line", "end_line").join(
            sym, (F.col("repository") == F.col("__r")) & (F.col("path") == F.col("__p")) & (F.col("__a") <= F.col("end_line")) & (F.col("start_line") <= F.col("__b")))
        extra = near.groupBy("repository", "unit").agg(F.sum("__pts").alias("__extra"), F.min("__a").alias("__line"))
        u = u.join(extra, ["repository", "unit"], "left")
        score, line = F.col("__score") + F.coalesce("__extra", F.lit(0)), F.col("__line")
    else:
        score = F.col("__score")
    body = F.lower("text")
    first = lambda text: F.coalesce(F.nullif(F.locate(whole, text), F.lit(0)), F.array_min(F.filter(F.array(*[F.locate(t, text) for t in terms]), lambda x: x > 0)))
    at = first(body)
    before = F.substring(F.col("text"), F.lit(1), (at - 1).cast("int"))
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    matched = F.col("start_line") + F.when(newlines > 0, newlines - 1).otherwise(newlines)
    top = u.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "path", "start_line", "unit").limit(limit)
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    pos = first(F.lower(flat))
    begin = F.greatest(F.lit(1), pos - 70)
    snippet = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(flat, begin.cast("int"), (pos + 190 - begin).cast("int")), F.when(F.length(flat) > pos + 189, "...").otherwise(""))
    everything = F.trim(F.regexp_replace(F.concat_ws(" ", "path", "title", "text"), r"\s+", " "))
    hit_line = F.coalesce(matched, line, F.col("start_line"))
    return top.select("unit", "score", "path", hit_line.alias("start_line"), hit_line.alias("end_line"), "kind", "title", F.coalesce(snippet, F.substring(everything, 1, 260)).alias("snippet"))


def symbol_search(symbols: DataFrame, query: str, limit: int, repository: str | None = None) -> DataFrame:
    """(symbol, name, kind, path, start_line, end_line): names that contain the query in any
    case; exact ones first, then those that start with it, then by name, path, start byte."""
    if query is None or limit is None:
        raise MissingRequiredBindings("query and limit must be bound")
    s = symbols if repository is None else symbols.where(F.col("repository") == repository)
    name, q = F.lower("name"), query.lower()
    cols = ["symbol", "name", "kind", "path", "start_line", "end_line", "start_byte"]
    hits = s.where(name.contains(q)).select(*cols).distinct()
    return hits.orderBy(F.lower("name") != q, ~F.lower("name").startswith(q), "name", "path", "start_byte", "symbol", F.col("kind").asc_nulls_first(), "start_line").limit(limit).select(*cols[:-1])
