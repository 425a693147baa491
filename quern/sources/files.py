"""Computed relations over a file tree and over the index tables; text in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.literals import from_literal, to_literal
from ..plans.atoms import Var
from ..plans.rules import Atom, Rule, RuleSet, atom, guard, rule

LANGUAGES = {"rs": "rust", "mica": "mica", "md": "markdown", "markdown": "markdown", "js": "javascript"}


def file_text(files: DataFrame) -> DataFrame:
    """FileText: (repository, revision, path, text, hash)."""
    return files.select("repository", "revision", "path", "text", "hash").distinct()


def file_lines(files: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """FileLines: one row per line, numbered from 1, from ``start`` on; CR LF, LF and CR end
    lines, and an end at the end of the text opens no further one."""
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n\z", "")
    lines = files.where("text is not null and length(text) > 0").select("repository", "revision", "path", F.posexplode(F.split(body, "\n", -1)).alias("n", "line"))
    lines = lines.select("repository", "revision", "path", (F.col("n") + 1).cast("long").alias("number"), "line").where(F.col("number") >= start)
    return lines.distinct() if count is None else lines.where(F.col("number") < start + count).distinct()


def file_line_count(files: DataFrame) -> DataFrame:
    """FileLineCount, without making the lines."""
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n\z", "")
    n = F.when(F.length("text") == 0, 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)
    return files.where("text is not null").select("repository", "revision", "path", n.cast("long").alias("count")).distinct()


def file_content_hash(files: DataFrame) -> DataFrame:
    """FileContentHash: SHA-256 of the text's UTF-8 bytes."""
    return files.where("text is not null").select("repository", "revision", "path", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash")).distinct()


def repository_entries(files: DataFrame, parent: str | None = None) -> DataFrame:
    """RepositoryEntry: (repository, revision, parent, path, kind, name) of every file and
    of every folder above one; ``parent`` '' is the root."""
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n == F.size(parts)).alias("leaf")))
    e = files.where("path is not null and path <> ''").select("repository", "revision", F.explode(chain).alias("e")).select("repository", "revision", "e.path", "e.leaf")
    out = e.select(
        "repository", "revision", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("").alias("parent"), "path",
        F.when(F.col("leaf"), "file").otherwise("directory").alias("kind"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    return (out if parent is None else out.where(F.col("parent") == parent)).distinct()


def indexed_file(units: DataFrame) -> DataFrame:
    """IndexedFile: (repository, path, language, model) of the units' files."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("file"))
    return units.where("path is not null").select("repository", "path", language.alias("language"), "model").distinct()


def source_index(units: DataFrame, symbols: DataFrame) -> DataFrame:
    """SourceIndex and its properties: (index, repository, provider, status, version, build_error)."""
    repos = units.select("repository").union(symbols.select("repository")).where("repository is not null").distinct()
    stamp = units.select("repository", "indexed_at").union(symbols.select("repository", "indexed_at")).groupBy("repository").agg(F.max("indexed_at").alias("at"))
    return repos.join(stamp, "repository", "left").select(
        F.concat(F.lit("index:"), F.col("repository")).alias("index"), "repository", F.lit("tables").alias("provider"), F.lit("complete").alias("status"),
        F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("")).alias("version"), F.lit("").alias("build_error"))


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text, hash) of a real folder, one row per file, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.decode("content", "UTF-8")
    return raw.select("path", text.alias("text"), F.sha2("content", 256).alias("hash"))


# -- text in, text out -----------------------------------------------------------------
_CALL = re.compile(r"^(not\s+)?([A-Za-z_]\w*)\((.*)\)$", re.S)
_COMPARE = re.compile(r"^(\S+)\s*(==|!=|<=|>=|<|>)\s*(\S+)$")


def _split(text: str) -> list[str]:
    out, depth, cur, quoted = [], 0, "", False
    for i, ch in enumerate(text):
        quoted ^= ch == '"' and text[i - 1 : i] != "\\"
        depth += (ch in "([{") - (ch in ")]}") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()] if cur.strip() else out


def _term(text: str, facts: bool = False):
    if not facts and re.fullmatch(r"\??[a-z_]\w*", text) and text not in ("true", "false", "nothing"):
        return Var(text.lstrip("?"))
    v = from_literal(text)
    return getattr(v, "name", v) if not isinstance(v, (str, int, float, bool, list, dict, type(None))) else v


def parse_program(text: str) -> tuple[dict[str, list[tuple]], list[Rule]]:
    """Facts `assert R(1, "a")` and rules `H(?x) :- A(?x), not B(?x), x > 3`, one a line;
    `//` comments and blank lines are skipped."""
    facts: dict[str, list[tuple]] = {}
    rules: list[Rule] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip().rstrip(".")
        if not line or line.startswith("//"):
            continue
        if ":-" in line:
            head, body = line.split(":-", 1)
            rules.append(rule(_atom(head.strip()), *[_item(b) for b in _split(body)]))
        elif line.startswith("assert "):
            m = _CALL.match(line[7:].strip())
            if not m:
                raise ValueError(f"line {number}: no fact")
            facts.setdefault(m[2], []).append(tuple(_term(t, facts=True) for t in _split(m[3])))
        else:
            raise ValueError(f"line {number}: neither a fact nor a rule")
    return facts, rules


def _atom(text: str) -> Atom:
    m = _CALL.match(text)
    if not m:
        raise ValueError(f"no atom: {text}")
    return Atom(m[2], tuple(_term(t) for t in _split(m[3])), bool(m[1]))


def _item(text: str):
    if _CALL.match(text):
        return _atom(text)
    m = _COMPARE.match(text)
    if not m:
        raise ValueError(f"no atom or comparison: {text}")
    g = guard(0, m[2], 0)
    return type(g)(m[2], _term(m[1]), _term(m[3]))


def render_facts(name: str, df: DataFrame) -> DataFrame:
    """(line): a relation's rows as source, made by the executors."""
    q = lambda c, t: F.when(F.col(c).isNull(), "nothing").otherwise(F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6) if t == "string" else F.col(c).cast("string"))
    cells = [q(f"`{c}`", t) for c, t in df.dtypes]
    return df.select(F.concat(F.lit(f"assert {name}("), F.concat_ws(", ", *cells), F.lit(")")).alias("line"))


def render_rules(rules: RuleSet) -> list[str]:
    t = lambda a: f"?{a.name}" if isinstance(a, Var) else to_literal(a)
    item = lambda b: f"{'not ' if b.negated else ''}{b.relation}({', '.join(map(t, b.args))})" if isinstance(b, Atom) else f"{t(b.left)} {b.op} {t(b.right)}"
    return [f"{item(r.head)} :- {', '.join(map(item, r.body))}" for r in rules.rules.values()]


__all__ = ["atom", "file_content_hash", "file_line_count", "file_lines", "file_text", "indexed_file", "parse_program", "read_tree", "render_facts", "render_rules", "repository_entries", "source_index"]
