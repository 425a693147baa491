"""Functions paired with their documentation (problem 5)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch

#: Spellings of the kinds that are functions, in lower case and letters only.
FUNCTION_KINDS = ("def", "fct", "fn", "fun", "func", "function", "functions", "meth", "method", "methods", "mth")

_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]")
_TAG = re.compile(r"@|:param|:return|TODO|FIXME")
_LINES = re.compile(r"\r\n|\n|\r")
_DOC_ATTR = re.compile(r'#\[\s*doc\s*=\s*(?:r(#*)"(.*?)"\1|"((?:[^"\\]|\\.)*)")\s*\]', re.S)
_PY_STRING = re.compile(r"(?i)(?:r|u)?(\"\"\"|'''|\"|')")


def significant_words(doc: str, name: str | None) -> int:
    """Words of the comment, without the function's own name, tag lines and TODO lines."""
    own = {w.lower() for w in _WORD.findall(name or "")} | {w.lower() for w in _CAMEL.findall(name or "")}
    return sum(1 for line in _LINES.split(doc) if not _TAG.match(line.strip()) for w in _WORD.findall(line) if w.lower() not in own)


def _block(body: str) -> str:
    """The text of a block comment without its stars."""
    return "\n".join(re.sub(r"^\s*\*+(?!/)", "", line).strip() for line in _LINES.split(body))


def rust_doc(before: str, end: int | None = None) -> str:
    """Outer documentation that the compiler would attach to an item that starts at ``end``
    (else behind ``before``): `///` lines, `/** */` blocks and doc attributes, with other
    attributes, plain comments and white space between them."""
    found: list[str] = []
    end = len(before) if end is None else end
    nl = before.rfind("\n", 0, end)
    if before[nl + 1 : end].strip() and not re.fullmatch(r"(?:\s*(?:#\[.*?\]|/\*.*?\*/))*\s*", before[nl + 1 : end], re.S):
        return ""
    while True:
        while end and before[end - 1].isspace():
            end -= 1
        if not end:
            break
        if before.endswith("*/", 0, end):
            start = _open_block(before, end)
            if start < 0:
                break
            body = before[start:end]
            if body.startswith("/*!"):
                break
            if body.startswith("/**") and not body.startswith("/***") and len(body) > 4:
                found.append(_block(body[3:-2]))
            end = start
            continue
        begin = max(before.rfind("\n", 0, end), before.rfind("\r", 0, end)) + 1
        line = before[begin:end].strip()
        if line.startswith("//!"):
            break
        if line.startswith("//"):
            if line.startswith("///") and not line.startswith("////"):
                found.append(line[3:].strip())
            end = begin
            continue
        if line.endswith("]"):
            start = _open_attribute(before, end)
            if start < 0:
                break
            m = _DOC_ATTR.fullmatch(before[start:end])
            if m:
                found.append(m[2] if m[2] is not None else m[3].replace("\\n", "\n").replace('\\"', '"'))
            end = start
            continue
        break
    return "\n".join(reversed(found))


def _open_block(text: str, end: int) -> int:
    """Where the (nested) block comment that ends at ``end`` starts; -1 if nowhere."""
    depth, p = 0, end
    while True:
        opened, closed = text.rfind("/*", 0, p), text.rfind("*/", 0, p)
        p = max(opened, closed)
        if p < 0:
            return -1
        depth += 1 if closed > opened else -1
        if depth == 0:
            return p


def _open_attribute(text: str, end: int) -> int:
    """Where the outer attribute `#[...]` that ends at ``end`` starts; -1 if it is none."""
    start = text.rfind("#[", 0, end)
    while start >= 0:
        inner = re.sub(r'"(?:[^"\\]|\\.)*"', '""', text[start:end])
        if inner.count("[") == inner.count("]"):
            line = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1
            lead = text[line:start].strip()
            return start if not lead or lead.endswith(("]", "*/")) else -1
        start = text.rfind("#[", 0, start)
    return -1


def python_doc(code: str) -> str:
    """The docstring of a def whose text starts with its header (decorators may lead)."""
    m = re.search(r"(?m)^[^\S\r\n]*(?:async\s+)?def\b", code)
    if not m:
        return ""
    p, depth, n = m.end(), 0, len(code)
    while p < n:
        c = code[p]
        if c == "#":
            e = _LINES.search(code, p)
            p = e.start() if e else n
        elif c in "\"'":
            q = code[p : p + 3] if code[p : p + 3] in ('"""', "'''") else c
            p = _string_end(code, p + len(q), q)
            continue
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            p += 1
            break
        p += 1
    parts: list[str] = []
    while p < n:
        while True:
            e = re.compile(r"(?:[^\S\r\n]|\\(?:\r\n|\n|\r))*" if parts else r"\s*").match(code, p)
            p = e.end()
            if not parts and p < n and code[p] == "#":
                e = _LINES.search(code, p)
                p = e.end() if e else n
                continue
            break
        m = _PY_STRING.match(code, p)
        if not m:
            break
        end = _string_end(code, m.end(), m[1])
        parts.append(code[m.end() : end - len(m[1])])
        p = end
    if not parts or (p < n and code[p] not in "\r\n#;"):
        return ""
    return "\n".join(line.strip() for line in _LINES.split("".join(parts)))


def _string_end(code: str, p: int, quote: str) -> int:
    while p < len(code):
        if code[p] == "\\":
            p += 2
        elif code.startswith(quote, p):
            return p + len(quote)
        else:
            p += 1
    return len(code)


def _lines_above(text: str, end: int) -> Iterator[str]:
    """The lines above the one that ``end`` lies on, from the last upward."""
    stop = max(text.rfind("\n", 0, end), text.rfind("\r", 0, end))
    while stop >= 0:
        to = stop - 1 if text[stop] == "\n" and stop and text[stop - 1] == "\r" else stop
        stop = max(text.rfind("\n", 0, to), text.rfind("\r", 0, to))
        yield text[stop + 1 : to]


def js_doc(text: str, end: int | None = None) -> str:
    """The `/**` block that ends on the line above."""
    above = _lines_above(text, len(text) if end is None else end)
    body = next(above, "").rstrip()
    if not body.endswith("*/"):
        return ""
    while "/*" not in body and (more := next(above, None)) is not None:
        body = more + "\n" + body
    start = body.find("/*")
    if start < 0 or body[:start].strip() or "*/" in body[start + 2 : -2]:
        start = body.rfind("/*")
    body = body[start:]
    if not body.startswith("/**") or body.startswith("/***") or len(body) <= 4:
        return ""
    return _block(body[3:-2])


def slash_doc(text: str, end: int | None = None) -> str:
    """The run of `//` lines that ends on the line above."""
    found = []
    for line in _lines_above(text, len(text) if end is None else end):
        line = line.strip()
        if not line.startswith("//"):
            break
        found.append(line[2:].strip())
    return "\n".join(reversed(found))


def _split_top(text: str, at: str) -> list[str]:
    """Cut where ``at`` stands outside brackets."""
    out, depth, last = [], 0, 0
    for p, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[p - 1 : p] not in ("-", "=")))
        if c == at and depth == 0:
            out.append(text[last:p])
            last = p + 1
    return [*out, text[last:]]


def signature(code: str) -> str:
    """The header's parameters in normal form: their types in order, without names, white
    space, defaults and lifetimes; `_` where no type is stated, the receiver as it is."""
    start = code.find("(")
    if start < 0:
        return ""
    depth, p = 0, start
    while p < len(code):
        depth += code[p] in "([{"
        depth -= code[p] in ")]}"
        if not depth:
            break
        p += 1
    out = []
    for x in _split_top(re.sub(r"'[a-z_]\w*\b(?!')\s*", "", code[start + 1 : p]), ","):
        x = _split_top(x, "=")[0].strip()
        if not x:
            continue
        typed = re.match(r"[^:]*(?<!:):(?!:)\s*(.+)", x, re.S)
        receiver = re.fullmatch(r"&?\s*(?:mut\s+)?self", x)
        out.append(re.sub(r"\s+", "", typed[1]) if typed else re.sub(r"\s|\bmut\b", "", x) if receiver else "_")
    return ",".join(out)


#: What opens a body whose items belong to a type, with the trait or base that it answers to,
#: and what hides braces: comments and strings.
_HEADS = {
    "rs": r"^[^\S\r\n]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl(?:<[^{>]*>)?\s+(?:!?(?:\w+::)*(?P<base>\w+)(?:<[^{]*?>)?\s+for\s+)?&?(?:\w+::)*(?P<type>\w+)|trait\s+(?P<trait>\w+))",
    "js": r"^[^\S\r\n]*(?:export\s+)?(?:default\s+)?class\s+(?P<type>\w+)(?:\s+extends\s+(?P<base>\w+))?",
}
_HIDES = {
    "rs": r'//[^\n]*|/\*|\br(?P<h>#*)"|"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\\n]|\\.[^'\n]*)'",
    "js": r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`",
}
_BRACED = {ext: re.compile(f"{_HIDES[ext]}|(?P<open>{{)|(?P<close>}})|(?P<head>{_HEADS[ext]})", re.M | re.S) for ext in _HEADS}
_PY_LINE = re.compile(
    r'(?P<hide>"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?'''|" + r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|#[^\n]*)"
    r"|^(?P<pad>[^\S\r\n]*)(?:(?P<class>class\s+(?P<type>\w+)\s*(?:\(\s*(?:\w+\.)*(?P<base>\w+))?)|(?=[^\s#]))", re.M | re.S)


def scopes(ext: str, text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, base) of the bodies of types, in order of start; a body ends where
    its brace closes, or in Python where the indentation falls back."""
    out: list[list] = []
    if ext == "py":
        open_: list[tuple[int, list]] = []
        for m in _PY_LINE.finditer(text):
            if m["hide"] is not None:
                continue
            pad = len(m["pad"].expandtabs())
            while open_ and open_[-1][0] >= pad:
                open_.pop()[1][1] = m.start()
            if m["class"]:
                out.append([m.start(), len(text), m["type"], m["base"] or ""])
                open_.append((pad, out[-1]))
        return [tuple(x) for x in out]
    if ext not in _BRACED:
        return []
    stack: list[list | None] = []
    pending, p = None, 0
    while m := _BRACED[ext].search(text, p):
        p = m.end()
        if m["head"] is not None:
            g = m.groupdict()
            pending = [m.start(), len(text), g["type"] or g.get("trait"), g.get("base") or ""]
        elif m["open"]:
            if pending:
                out.append(pending)
            stack.append(pending)
            pending = None
        elif m["close"]:
            if stack and (top := stack.pop()):
                top[1] = m.start()
        elif m[0] == "/*" and ext == "rs":
            p = _close_block(text, p)
        elif ext == "rs" and m["h"] is not None:
            end = text.find('"' + m["h"], p)
            p = len(text) if end < 0 else end + 1 + len(m["h"])
    return [tuple(x) for x in out]


_FENCE = re.compile(r"/\*|\*/")


def _close_block(text: str, p: int) -> int:
    """Behind the end of the (nested) block comment whose inside starts at ``p``."""
    depth = 1
    while depth:
        m = _FENCE.search(text, p)
        if not m:
            return len(text)
        depth += 1 if m[0] == "/*" else -1
        p = m.end()
    return p


class Source:
    """One file's text: its bytes, where they lie in the text, and the scopes of its types."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.raw = path, text, text.encode("utf-8", "surrogatepass")
        self.ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
        starts = (np.frombuffer(self.raw, dtype=np.uint8) & 0xC0) != 0x80
        self.chars = None if len(self.raw) == len(text) else np.concatenate([[0], np.cumsum(starts)])
        self.scopes = scopes(self.ext, text)
        self.heads = [s[0] for s in self.scopes]

    def at(self, byte: int) -> int:
        return byte if self.chars is None else int(self.chars[byte])

    def owner(self, pos: int) -> tuple[str, str]:
        """(type, base) of the innermost body around ``pos``."""
        for k in range(bisect_right(self.heads, pos) - 1, -1, -1):
            start, end, kind, base = self.scopes[k]
            if start < pos < end:
                return kind, base
        return "", ""

    def item(self, start: int, end: int) -> tuple[str, str, str, str, str, bool]:
        """(code, doc, type, base, signature, declared) of one item by its byte span."""
        code, pos = self.raw[start:end].decode("utf-8", "replace"), self.at(start)
        if self.ext == "rs":
            doc = rust_doc(self.text, pos)
        elif self.ext == "py":
            doc = python_doc(code)
        else:
            doc = {"js": js_doc, "mica": slash_doc}.get(self.ext, lambda *_: "")(self.text, pos)
        stub = code.rstrip().endswith(";") or (self.ext == "py" and code.rstrip().endswith("..."))
        return code, doc, *self.owner(pos), signature(code), stub


def symbol_table(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, path, start_byte, name, qualified, origin, signature, language, code, doc,
    words, declared) of every function or method, documented or not.

    ``qualified`` is the name under its type, ``origin`` under the trait or base class that
    its type answers to, if any; ``declared`` marks items without a body. See doc_pairs."""
    kind = F.lower(F.regexp_replace("kind", r"[^\p{L}]", ""))
    spans = (
        symbols.where(kind.isin(*FUNCTION_KINDS) & F.col("start_byte").isNotNull() & F.col("end_byte").isNotNull() & (F.col("end_byte") > F.col("start_byte")) & (F.col("start_byte") >= 0))
        .groupBy("repository", "path").agg(F.collect_set(F.struct("start_byte", "end_byte", "name")).alias("spans"))
    )
    body = files.where("path is not null and text is not null").groupBy("repository", "path").agg(F.max_by("text", F.struct("indexed_at", "hash", F.xxhash64("text"))).alias("text"))
    joined = body.join(spans, ["repository", "path"])
    schema = "repository string, path string, start_byte long, name string, qualified string, origin string, signature string, language string, code string, doc string, words int, declared boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repository, path, text, held in zip(pdf.repository, pdf.path, pdf.text, pdf.spans):
                src = Source(path, text)
                seen = set()
                for s in sorted(held, key=lambda s: (s["start_byte"], s["end_byte"], s["name"] or "")):
                    a, b, name = int(s["start_byte"]), int(s["end_byte"]), s["name"]
                    if b > len(src.raw) or (a, b) in seen:
                        continue
                    seen.add((a, b))
                    code, doc, owner, base, sig, declared = src.item(a, b)
                    under, answers = (f"{t}.{name}" if t else name for t in (owner, base or owner))
                    out.append((repository, path, a, name, under, answers, sig, src.ext, code, doc, significant_words(doc, name), declared))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return joined.mapInPandas(run, schema)


def doc_pairs(symbols: DataFrame, files: DataFrame, least_words: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """(repository, path, start_byte, name, qualified, signature, language, code, doc, doc_from).

    Each function or method (kind in FUNCTION_KINDS in any spelling, with a span inside
    its file) with a documentation comment of at least ``least_words`` significant words.
    Every item is first joined, over the symbol table of all files, with the declaration of
    its repository and language of the same qualified name (its trait's or base's where its
    type answers to one) and the same normalised signature, which tells overloads apart;
    only then what has no comment worth keeping is dropped. ``doc_from`` is 'own' for a
    comment of the item's own, else 'declaration' for a definition documented there.

    Nulls: symbols without kind, path or span, files without path or text give no pair; a
    null repository matches nothing. Empty and reversed spans give none. Rows of several
    lives and repeated rows count once; of several files of one (repository, path) the
    one indexed last is read. Other columns aren't read.

    A file's spans meet its text in one row: they lie inside that text, so their number is
    bounded by it, and the text crosses to Python once and not once per function. The
    table is written once, as both sides of the join read it.
    """
    table = (scratch or Scratch(symbols.sparkSession)).keep(symbol_table(symbols, files), "symbols", local=False)
    # Declarations worth lending, one per key: combined before the shuffle.
    declared = table.where(F.col("declared") & (F.col("words") >= least_words)).groupBy(
        F.col("repository").alias("__r"), F.col("language").alias("__l"), F.col("qualified").alias("__q"), F.col("signature").alias("__s")).agg(F.min(F.struct("path", "start_byte", "doc", "words")).alias("__d"))
    met = table.join(declared, (F.col("repository") == F.col("__r")) & (F.col("language") == F.col("__l")) & (F.col("origin") == F.col("__q")) & (F.col("signature") == F.col("__s")), "left")
    lent = (F.col("words") < least_words) & ~F.col("declared") & F.col("__d").isNotNull()
    best = F.when(lent, F.struct(F.col("__d.doc").alias("doc"), F.col("__d.words").alias("words"), F.lit("declaration").alias("doc_from"))).otherwise(F.struct("doc", "words", F.lit("own").alias("doc_from")))
    resolved = met.withColumn("__best", best).where(F.col("__best.words") >= least_words)
    cols = ["repository", "path", "start_byte", "name", "qualified", "signature", "language", "code"]
    return resolved.select(*cols, F.col("__best.doc").alias("doc"), F.col("__best.doc_from").alias("doc_from"))
