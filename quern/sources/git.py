"""Version-control views: `git` run by the executors, one task per repository."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_SEP, _END = "\x1f", "\x1e"
_LOG = _SEP.join(("%H", "%P", "%T", "%an", "%ae", "%at", "%s", "%B")) + _END
_COMMIT = "commit string, parents array<string>, tree string, name string, email string, timestamp long, summary string, message string"


def git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")


def _per_repository(repositories: DataFrame, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    names = ["repository", *[re.sub(r"[`:]", "", c.split()[0]) for c in re.split(r",\s*(?![^<]*>)", schema)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo in pdf.repository:
                yield pd.DataFrame([(repo, *r) for r in rows(repo)], columns=names)

    repos = repositories.select("repository").where("repository is not null").distinct()
    return repos.mapInPandas(run, f"repository string, {schema}")


def _log(repo: str, *extra: str) -> list[tuple]:
    out = []
    for entry in git(repo, "log", f"--format={_LOG}", *extra).split(_END):
        f = entry.lstrip("\n").split(_SEP)
        if len(f) == 8:
            out.append((f[0], f[1].split(), f[2], f[3], f[4], int(f[5]), f[6], f[7].rstrip("\n")))
    return out


def commits(repositories: DataFrame, ref: str = "HEAD", limit: int | None = None) -> DataFrame:
    """CommitLog with tree; CommitExists, CommitTree, CommitAuthor and CommitMessage are its columns."""
    return _per_repository(repositories, _COMMIT, lambda r: _log(r, ref, *([f"-n{limit}"] if limit is not None else [])))


def commit_parents(log: DataFrame) -> DataFrame:
    return log.select("repository", "commit", F.posexplode("parents").alias("index", "parent"))


def commit_search(log: DataFrame, query: str, limit: int) -> DataFrame:
    """CommitSearch: messages that contain the query in any case, newest first."""
    return log.where(F.lower("message").contains(query.lower())).orderBy(F.col("timestamp").desc(), "commit").limit(limit)


def repository_vcs(repositories: DataFrame) -> DataFrame:
    def kind(repo: str) -> list[tuple]:
        done = subprocess.run(["git", "-C", repo, "rev-parse", "--git-dir"], capture_output=True)
        return [("git",)] if done.returncode == 0 else []

    return _per_repository(repositories, "vcs string", kind)


def ref_targets(repositories: DataFrame) -> DataFrame:
    """RefTarget: (repository, ref, commit)."""
    return _per_repository(repositories, "ref string, commit string", lambda r: [tuple(x.split()) for x in git(r, "for-each-ref", "--format=%(refname) %(objectname)").splitlines()])


def changed_files(repositories: DataFrame, old: str, new: str) -> DataFrame:
    """ChangedFiles: (repository, from, to, path, kind) with kind added, deleted, modified or renamed."""
    names = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "T": "modified", "C": "added"}

    def rows(r: str) -> list[tuple]:
        out = []
        for line in git(r, "diff", "--name-status", old, new).splitlines():
            f = line.split("\t")
            out.append((old, new, f[-1], names.get(f[0][0], "modified")))
        return out

    return _per_repository(repositories, "from_commit string, to_commit string, path string, kind string", rows)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def file_diff(repositories: DataFrame, old: str, new: str, path: str) -> DataFrame:
    """FileDiff: the unified text."""
    return _per_repository(repositories, "from_commit string, to_commit string, path string, unified string", lambda r: [(old, new, path, t)] if (t := git(r, "diff", old, new, "--", path)) else [])


def _diff_lines(text: str) -> list[tuple]:
    out, hunk, a, b, n = [], -1, 0, 0, 0
    for line in text.splitlines():
        m = _HUNK.match(line)
        if m:
            hunk, a, b, n = hunk + 1, int(m[1]), int(m[3]), 0
        elif hunk >= 0 and line[:1] in ("+", "-", " "):
            kind = {"+": "added", "-": "removed", " ": "context"}[line[0]]
            out.append((hunk, n, a if kind != "added" else None, b if kind != "removed" else None, kind, line[1:]))
            a += kind != "added"
            b += kind != "removed"
            n += 1
    return out


def file_diff_lines(repositories: DataFrame, old: str, new: str, path: str) -> DataFrame:
    """FileDiffLine: (hunk, line_index, old_line or null, new_line or null, kind, text)."""
    return _per_repository(repositories, "hunk int, line_index int, old_line int, new_line int, kind string, text string", lambda r: _diff_lines(git(r, "diff", old, new, "--", path)))


def line_projection(repositories: DataFrame, old: str, new: str, path: str, start: int, end: int) -> DataFrame:
    """FileLineProjection: where lines start..end of the old file are in the new one; quality
    is exact, shifted, or changed where some of the lines themselves did."""

    def rows(r: str) -> list[tuple]:
        hunks = [m for line in git(r, "diff", "-U0", old, new, "--", path).splitlines() if (m := _HUNK.match(line))]
        spans = [(int(m[1]), int(m[2] or 1), int(m[4] or 1)) for m in hunks]  # old start, old and new count
        touched = any(n and a <= end and start < a + n for a, n, _ in spans)
        shift = lambda line: sum(k - n for a, n, k in spans if line > (a + n - 1 if n else a))
        s, e = start + shift(start), end + shift(end)
        return [(start, end, s, max(s, e), "changed" if touched else "exact" if (s, e) == (start, end) else "shifted")]

    return _per_repository(repositories, "start int, end int, projected_start int, projected_end int, quality string", rows)


def file_history(repositories: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """FileHistory: the commits that touched a path, newest first, through renames."""
    return _per_repository(repositories, _COMMIT, lambda r: _log(r, "--follow", *([f"-n{limit}"] if limit is not None else []), "--", path))


def file_blame(repositories: DataFrame, commit: str, path: str) -> DataFrame:
    """FileBlame: (line, origin commit, name, email, timestamp, summary)."""

    def rows(r: str) -> list[tuple]:
        out, cur = [], {}
        for line in git(r, "blame", "--line-porcelain", commit, "--", path).splitlines():
            m = re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line)
            if m:
                cur = {"commit": m[1], "line": int(m[2])}
            elif line.startswith("\t"):
                out.append((cur["line"], cur["commit"], cur["author"], cur["author-mail"].strip("<>"), int(cur["author-time"]), cur["summary"]))
            elif " " in line:
                key, value = line.split(" ", 1)
                cur[key] = value
        return out

    return _per_repository(repositories, "line int, origin string, name string, email string, timestamp long, summary string", rows)


def blame_hunks(blame: DataFrame) -> DataFrame:
    """FileBlameHunk: runs of lines of one origin: line minus its rank among them is constant."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("repository", "origin").orderBy("line"))
    runs = blame.withColumn("__run", F.col("line") - rank)
    return runs.groupBy("repository", "origin", "__run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.first("name").alias("name"), F.first("summary").alias("summary")).drop("__run")


def received_ref_updates(pushes: DataFrame, lines: str = "lines") -> DataFrame:
    """GitReceivedRefUpdate: (repository, old, new, ref, kind) of the lines `old new ref` that a
    receiving hook is given; kind is create (old is all noughts), delete (new is) or update."""
    line = pushes.where(F.col(lines).isNotNull()).select("repository", F.explode(F.split(lines, "\n")).alias("__line")).where(F.trim("__line") != "")
    part = F.split(F.trim("__line"), r"\s+", 3)
    none = lambda c: c.rlike("^0+$")
    return line.select("repository", part[0].alias("old"), part[1].alias("new"), part[2].alias("ref"), F.when(none(part[0]), "create").when(none(part[1]), "delete").otherwise("update").alias("kind"))
