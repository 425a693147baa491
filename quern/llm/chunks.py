"""Splitting oversized items at natural boundaries (problem 3).

Agglomerative: a text starts as atomic segments; adjacent pairs lie in a heap by the
strength of the boundary between them, and the weakest boundaries are merged away first
while the merged piece plus the overlap still fits.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LINE = re.compile(r"\r\n|\n|\r")
#: Boundary strengths, strongest first: a blank line, a line end, a sentence end, a clause, a space, none.
BLANK, LINE_END, SENTENCE, CLAUSE, SPACE, HARD = 6, 5, 4, 3, 2, 1
_COARSE = re.compile(r"(?P<blank>(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+)|(?P<line>\r\n|\n|\r)|(?P<sentence>[.!?…][\"'”’»)\]]*[^\S\r\n]+|[。！？])")
_FINE = re.compile(r"(?P<clause>[,;:–—、，；：][^\S\r\n]*|[|>][^\S\r\n]+)|(?P<space>\s+)")


def _hard_cut(text: str, at: int, low: int) -> int:
    """The last place up to ``at`` that splits neither a CR LF nor a letter from its marks."""
    p = at
    while p > low + 1 and (text[p - 1 : p + 1] == "\r\n" or unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p if p > low + 1 else at


def atoms(text: str, own: int) -> tuple[list[int], list[int]]:
    """(ends, strengths) of segments of at most ``own`` characters that tile the text."""
    ends, strengths = [], []
    last = 0

    def close(end: int, strength: int) -> None:
        nonlocal last
        while end - last > own:  # too long: by clauses, else spaces, else anywhere
            best = {}
            for m in _FINE.finditer(text, last, last + own):
                best[m.lastgroup] = m.end()
            cut = next(((best[k], s) for k, s in (("clause", CLAUSE), ("space", SPACE)) if k in best and best[k] - last > own // 2), None)
            cut = cut or ((best["space"], SPACE) if "space" in best else None) or (_hard_cut(text, last + own, last), HARD)
            ends.append(cut[0])
            strengths.append(cut[1])
            last = cut[0]
        if end > last:
            ends.append(end)
            strengths.append(strength)
            last = end

    for m in _COARSE.finditer(text):
        close(m.end(), {"blank": BLANK, "line": LINE_END, "sentence": SENTENCE}[m.lastgroup])
    close(len(text), BLANK)
    return ends, strengths


def merge(ends: list[int], strengths: list[int], own: int) -> list[int]:
    """The ends that remain after merging; pairs of equal strength go smallest first."""
    n = len(ends)
    start = [0, *ends[:-1]]
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(ends)
    heap = [(strengths[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not alive[i] or j >= n or nxt[i] != j or end[j] - start[i] != size or size > own:
            continue  # out of date, or it doesn't fit and never will
        alive[j] = False
        strengths_j, end[i], nxt[i] = strengths[j], end[j], nxt[j]
        strengths[i] = strengths_j
        if nxt[i] < n:
            prv[nxt[i]] = i
            heapq.heappush(heap, (strengths[i], end[nxt[i]] - start[i], i, nxt[i]))
        if prv[i] >= 0:
            p = prv[i]
            heapq.heappush(heap, (strengths[p], end[i] - start[p], p, i))
    return [end[i] for i in range(n) if alive[i]]


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, own_start, end) per piece, in order: text[own_start:end] tile the text and
    text[start:own_start] is shared with the piece before."""
    own = limit - overlap
    ends, strengths = atoms(text, own)
    cuts = merge(ends, list(strengths), own)
    out, begin = [], 0
    for end in cuts:
        share = begin
        if begin:
            low = begin - overlap
            k = bisect_left(ends, low)
            while k < len(ends) and ends[k] < begin and strengths[k] == HARD:
                k += 1
            if k < len(ends) and ends[k] < begin:
                share = ends[k]
            else:  # no sentence starts there: a clause or a word
                m = next((m for m in _FINE.finditer(text, low, begin) if m.end() < begin), None)
                share = m.end() if m else begin
        out.append((share, begin, end))
        begin = end
    return out


def split_oversized(
    units: DataFrame, *, keys: list[str], text: str = "text", start_line: str = "start_line", limit: int = 2000, overlap: int = 200
) -> DataFrame:
    """``keys``, piece, pieces, text, n_chars, shared, start_line, end_line, hard of each
    unit whose text has more than ``limit`` characters (code points).

    A piece has at most ``limit`` characters, of which the first ``shared`` (at most
    ``overlap``) repeat the end of the piece before from a boundary on; where there is no
    boundary nothing is shared. Lines end with CR LF, LF or CR. ``hard`` is 1 if one line
    of the unit alone is longer than ``limit``. Nulls: a null text is no case, a null
    ``start_line`` gives null lines. Repeated rows count once. Only the named columns are
    read. Sizes are filtered before Python; each text is one row's work.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    over = units.where(F.length(F.col(text)) > limit).select(*keys, F.col(start_line).cast("long").alias("__line"), F.col(text).alias("__text")).distinct()
    types = {f.name: f.dataType.simpleString() for f in over.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", piece long, pieces long, text string, n_chars long, shared long, start_line long, end_line long, hard int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                body, line = row[-1], row[-2]
                marks = [m.end() for m in LINE.finditer(body)]
                edges = [0, *marks, len(body)]
                bare = [m.start() for m in LINE.finditer(body)] + [len(body)]
                hard = int(any(b - a > limit for a, b in zip(edges, bare)))
                cut = split_text(body, limit, overlap)
                known = not pd.isna(line)
                first = [int(line) + bisect_right(marks, s) if known else None for s, _, _ in cut]
                final = [int(line) + bisect_left(marks, e) if known else None for _, _, e in cut]
                out = {k: [v] * len(cut) for k, v in zip(keys, row)}
                out |= {"piece": range(len(cut)), "pieces": len(cut), "text": [body[s:e] for s, _, e in cut], "n_chars": [e - s for s, _, e in cut],
                        "shared": [b - s for s, b, _ in cut], "start_line": pd.array(first, "Int64"), "end_line": pd.array(final, "Int64"), "hard": hard}
                yield pd.DataFrame(out)

    return over.mapInPandas(run, schema)
