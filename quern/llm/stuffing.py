"""Keyword-stuffed and link-list pages (problem 9).

Each page's words and marks by rank give a curve. SQL windows fit its slope and residual
and take its divergence from the prose of its language; a page far from what prose of its
length shows is flagged, and only flagged pages are read line by line, to measure which
share of their words is lists and stuffing and which is sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Scratch, spread

#: Common function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it for with on at by that this which when be as or not no your our you we they if from but are was has have had before after how does do can than then there their its my what who nobody each only",
    "de": "der die das ein eine einer eines einen einem und ist zu im in mit auf von für den dem des nicht wer es er sie wie kein keine zwischen am wenn aus war nur ohne als über",
    "fr": "le la les l un une des du de d et est à dans que qui pour avec sur pas il elle en au ne se quand on sans mais entre plus",
    "es": "el los las una un y es en de con por para del al la lo no sin su si que cuando hay entre nadie",
}
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: A page's elements: runs of letters, single digits, single marks, line ends.
ELEMENT = r"\p{L}+|[^\s\p{L}]|\n"
STOPS = (".", "!", "?")
#: Marks of lists, markup and code.
ODD = tuple("{}[]<>=|#*_/\\@$%^&+~·•»`")
LANGUAGES = (*sorted(FUNCTION_WORDS), "und")

_URL = re.compile(r"(?:\b[a-z][a-z+.-]*://|\bwww\.)[^\s<>\"')\]]+|\b(?:[^\W_][\w-]*\.)+[a-z]{2,}/[^\s<>\"')\]]*", re.I)
_MARKUP = re.compile(r"<[^<>]*>|[\[\]()]")
_CODE_HINT = re.compile(r"[{};(<>=]")
_NUMBER = re.compile(r"(?<!\w)\d+(?:[.,]\d+)?(?!\w)")
_CODE = re.compile(r"[{};]\s*$|\w\(.*\)|[=<>]=|:=|\s[=<]\s|=>|->|^\s*\S+ .*[^\s>] > \d")
_LABEL = re.compile(r"^[^\W\d_][\w ]{0,30}: ")
_ITEM = re.compile(r"\s*[,;|·•#]\s*|\s+[-–—/>»]\s+")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*$")
_INNER_STOP = re.compile(r"[^\W\d_]{2}[.!?](?:\s|$)")
_HEADING = re.compile(r"#+ ")


class _Letters(dict):
    """Maps every character that is no letter or digit to a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalnum() else 32
        return self[code]


_LETTERS = _Letters()


def _words(text: str) -> list[str]:
    """Runs of letters and digits with a letter in them: digits may stand for letters."""
    return [w for w in text.translate(_LETTERS).split() if not w.isdigit()]


def line_kind(s: str) -> tuple[str, int, list[str]]:
    """(kind, words, the words outside URLs in lower case) of a line without outer space; a
    URL is one word. Kinds: link (URLs with little said about them), list (short items, or
    words without the function words of a sentence), short (up to three such words), prose,
    code and other (table rows, headings, labelled lines)."""
    if s[0] == "|" and s[-1] == "|":
        return "other", len(_words(s)), []
    if s[-1] in ".!?" and "/" not in s and "www." not in s and not _CODE_HINT.search(s):
        words = _words(s.lower())
        if len(words) > 3 and s[0] != "#":
            return "prose", len(words), words  # the usual case
    urls, rest = [], s
    if "/" in s or "www." in s:
        urls = _URL.findall(s)
        if urls:
            rest = _MARKUP.sub(" ", _URL.sub(" ", s))
    words = _words(rest.lower())
    function, n = sum(map(FUNCTION.__contains__, words)), len(words) + len(urls)
    if urls:
        if len(words) <= 6 * len(urls) and not _INNER_STOP.search(rest):
            return "link", n, words
        return ("prose" if function >= 0.1 * len(words) else "link"), n, words
    if not words:
        return "other", 0, words
    if _CODE_HINT.search(s) and _CODE.search(s):
        return "code", n, words
    if _HEADING.match(s):
        return "other", n, words
    if _STOP.search(s):
        return ("prose" if len(words) > 2 else "other"), n, words
    if sum(1 for x in _ITEM.split(s) if x) >= max(4, len(words) / 4) and not _INNER_STOP.search(s):
        return "list", n, words
    if _LABEL.match(s):
        return ("other" if function <= 0.08 * len(words) else "prose"), n, words
    # Short lines without a stop, and those with numbers and prices, may hold a function word or so.
    loose = (len(words) <= 6 and s[-1] not in ",;:") or len(_NUMBER.findall(s)) > 1
    if function > (0.34 if loose else 0.08) * len(words):
        return "prose", n, words
    return ("short" if len(words) <= 3 else "list"), n, words


def concentration(words: list[str]) -> float:
    """The share of the two commonest content words."""
    first = second = 0
    for w, k in Counter(words).items():
        if k > second and len(w) > 1 and w not in FUNCTION:
            first, second = (k, first) if k > first else (first, k)
    return (first + second) / len(words) if words else 0.0


def stuffed_share(text: str, dense: float = 0.3) -> float:
    """The share of a page's words in links, lists and in prose of at least 20 words of
    which two words make up ``dense``. Fenced code counts as neither; short lines are items
    of a list, or, where a tenth of the lines is code, parts of that."""
    total = bad = short = coded = lines = 0
    fenced = False
    held: list[str] = []

    def flush() -> None:
        nonlocal bad
        if len(held) >= 20 and concentration(held) >= dense:
            bad += len(held)
        held.clear()

    for line in text.splitlines():
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
            flush()
        elif fenced:
            total += len(_words(line))
        elif not s:
            flush()
        else:
            kind, n, words = line_kind(s)
            lines += 1
            if kind == "prose":
                total += len(words)
                if len(words) >= 25:
                    flush()
                held.extend(words)
                if len(words) >= 25:
                    flush()
            else:
                flush()
                total += n
                bad += n if kind in ("link", "list") else 0
                short += n if kind == "short" else 0
                coded += kind == "code"
    flush()
    if coded < 0.1 * lines:
        bad += short
    return bad / total if total else 0.0


def _share(text: str) -> Column:
    """The column of stuffed_share of a column of texts, none of them null."""

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([stuffed_share(x) for x in t], dtype="float64")

    return share(text)


def _elements(pages: DataFrame) -> DataFrame:
    """Adds ``e`` (the elements in order), ``language`` (its place in LANGUAGES) and ``prose``.

    The language is that of which most function words occur, else the label's, else 'und'.
    A page is ``prose`` by its own make-up, whatever others are like: a seventh of its
    elements are function words of its language, every fortieth to every fourth is a stop,
    and marks that prose doesn't need are rarer than one in twenty-five."""
    telling = sorted(FUNCTION) + [*STOPS, *ODD]
    among = lambda ws: lambda w: w.isin(*ws)
    x = pages.withColumn("e", F.regexp_extract_all(F.lower("text"), F.lit(ELEMENT), F.lit(0))).withColumn("__k", F.filter("e", among(telling)))
    votes = []
    for i, code in enumerate(LANGUAGES[:-1]):
        ws = sorted(set(FUNCTION_WORDS[code].split()))
        votes.append(F.struct(F.size(F.filter("__k", among(ws))).alias("v"), F.lit(i).alias("code")))
    x = x.withColumn("__best", F.greatest(*votes))
    label = F.lit(len(LANGUAGES) - 1)
    for i, code in enumerate(LANGUAGES[:-1]):
        label = F.when(F.lower("lang") == code, i).otherwise(label)
    n, stops, odd = F.size("e"), F.size(F.filter("__k", among(STOPS))), F.size(F.filter("__k", among(ODD)))
    prose = (F.col("__best.v") > 1) & (F.col("__best.v") * 7 >= n) & (stops * 40 >= n) & (stops * 4 <= n) & (odd * 25 <= n)
    return x.withColumn("language", F.when(F.col("__best.v") > 1, F.col("__best.code")).otherwise(label)).withColumn("prose", prose)


def page_curves(docs: DataFrame, top: int = 500, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, page, language, prose, n, types, slope, residual, divergence) per page with letters.

    n and types count the page's elements. slope and residual are of ln(frequency) over
    ln(rank), a point per frequency, the rank being how many types are as frequent or more,
    so ties don't matter. divergence is the relative entropy of the page's elements against
    the prose of its language, over its ``top`` commonest elements and one class for the
    rest; a language without prose is held against the prose of all. What is broadcast is
    ``top`` rows a language. ``page`` is the text's hash: an id with several texts has a
    curve for each, repeated rows have one.

    The texts are read twice: once for the prose's counts, which combine before their
    shuffle, and once dealt out by doc_id, after which a page is counted, ranked and fitted
    in one task. Only the prose's counts, a row per language and element, are written."""
    s = scratch or Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text", "lang").where("text is not null")
    # Not a filter on prose: that would be pushed below and work the elements out once more.
    found = _elements(spread(texts, scan=True)).select("language", F.explode(F.when(F.col("prose"), F.col("e"))).alias("w"))
    counts = s.keep(found.groupBy("language", "w").agg(F.count("*").alias("t")), "counts", local=False)
    every = counts.groupBy("w").agg(F.sum("t").alias("t")).select(F.lit(len(LANGUAGES) - 1).alias("language"), "w", "t")
    corpus = counts.unionByName(every)
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.col("t").desc(), "w"))
    sums = corpus.groupBy("language").agg(F.sum("t").alias("all"))
    known = corpus.withColumn("k", rank).where(F.col("k") <= top).join(F.broadcast(sums), "language").select(F.col("language").alias("yard"), "w", (F.col("t") / F.col("all")).alias("q"))
    known = s.keep(known, "known")
    rest = s.keep(known.groupBy("yard").agg(F.greatest(1 - F.sum("q"), F.lit(1e-6)).alias("q_rest")), "rest")

    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.where(F.regexp_like("text", F.lit(r"\p{L}"))).repartition(tasks, "doc_id").withColumn("__row", F.monotonically_increasing_id()).withColumn("page", F.xxhash64("text"))
    own = [r.yard for r in rest.collect()]  # at most one row a language
    pages = _elements(rows).withColumn("yard", F.when(F.col("language").isin(own), F.col("language")).otherwise(len(LANGUAGES) - 1))
    key = ["doc_id", "__row", "page", "language", "prose", "yard"]  # numbers only, as they go through every group
    held = pages.select(*key, F.explode("e").alias("w")).groupBy(*key, "w").agg(F.count("*").alias("c"))
    held = held.join(F.broadcast(known), ["yard", "w"], "left")
    by_count = held.groupBy(*key, "c").agg(
        F.count("*").alias("m"), F.sum(F.when(F.col("q").isNotNull(), F.col("c") * F.log(F.col("c") / F.col("q")))).alias("__in"), F.count("q").alias("__known"))
    at_least = F.sum("m").over(Window.partitionBy("doc_id", "__row").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0))
    points = by_count.withColumn("__x", F.log(at_least)).withColumn("__y", F.log("c"))
    fit = points.groupBy(*key).agg(
        F.sum(F.col("c") * F.col("m")).alias("n"), F.sum("m").alias("types"), F.count("*").alias("__points"), F.regr_slope("__y", "__x").alias("slope"),
        F.regr_syy("__y", "__x").alias("__syy"), F.regr_sxy("__y", "__x").alias("__sxy"), F.regr_sxx("__y", "__x").alias("__sxx"),
        F.sum("__in").alias("__in"), F.sum(F.col("c") * (F.col("m") - F.col("__known"))).alias("__out"))
    fit = fit.join(F.broadcast(rest), "yard", "left")
    outside = F.when(F.col("__out") > 0, F.col("__out") * F.log(F.col("__out") / F.coalesce("q_rest", F.lit(1.0)))).otherwise(0.0)
    kl = (F.coalesce("__in", F.lit(0.0)) + outside) / F.col("n") - F.log("n")
    off = F.greatest(F.lit(0.0), F.col("__syy") - F.when(F.col("__sxx") > 0, F.col("__sxy") * F.col("__sxy") / F.col("__sxx")).otherwise(0.0))
    name = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.col("language") + 1)
    out = fit.select("doc_id", "page", name.alias("language"), "prose", "n", "types", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce(F.sqrt(off / F.col("__points")), F.lit(0.0)).alias("residual"), kl.alias("divergence"))
    return out.groupBy("doc_id", "page").agg(*[F.first(c).alias(c) for c in out.columns[2:]])


MEASURES = ("slope", "residual", "divergence")


def flag_pages(curves: DataFrame, far: float = 2.0, steep: float = 3.0, least: int = 10) -> DataFrame:
    """Curves with z_slope, z_residual, z_divergence and ``flag``: 'divergence' for pages more
    than ``far`` deviations off prose of their language and length (above: words and marks
    that prose has not; below: little but its commonest), 'slope' or 'residual' for those
    more than ``steep`` off, null for the rest.

    What prose of a length shows is a straight line over ln(n), fitted per language to its
    pages of prose alone, with the deviation from it, so no other page and no number of
    pages moves a threshold. A language with fewer than ``least`` pages of prose has no
    line of its own and is held against that of all languages. Pages of no known language,
    and all pages where there is no prose at all, have nothing of their kind to be held
    against and are flagged 'unmeasured'."""
    x = F.log("n")
    prose = curves.where("prose").select("language", x.alias("__x"), *MEASURES)
    fits = [F.count("*").alias("__pages")] + [a for m in MEASURES for a in (
        F.regr_slope(m, "__x").alias(f"b_{m}"), F.avg(m).alias(f"m_{m}"), F.regr_syy(m, "__x").alias(f"s_{m}"), F.regr_sxy(m, "__x").alias(f"c_{m}"), F.regr_sxx(m, "__x").alias(f"x_{m}"))]
    lines = prose.groupBy("language").agg(*fits, F.avg("__x").alias("__mx")).where(F.col("__pages") >= least)
    pool = prose.agg(*fits, F.avg("__x").alias("__mx")).where("__pages > 0")  # one row
    own = curves.join(F.broadcast(lines), "language", "left")
    names = [c for c in lines.columns if c != "language"]
    own = own.join(F.broadcast(pool.select(*[F.col(c).alias(f"p{c}") for c in names], F.lit(True).alias("__any"))), F.lit(True), "left")
    got = lambda c: F.when(F.col("__pages").isNotNull(), F.col(c)).otherwise(F.col(f"p{c}"))
    out = own
    for m in MEASURES:
        sd = F.sqrt(F.greatest(F.lit(0.0), got(f"s_{m}") - F.coalesce(got(f"c_{m}") * got(f"c_{m}") / F.nullif(got(f"x_{m}"), F.lit(0.0)), F.lit(0.0))) / got("__pages")) + 1e-6
        out = out.withColumn(f"z_{m}", (F.col(m) - got(f"m_{m}") - F.coalesce(got(f"b_{m}"), F.lit(0.0)) * (x - got("__mx"))) / sd)
    flag = (F.when(F.col("__any").isNull() | (F.col("language") == "und"), "unmeasured").when(F.abs("z_divergence") > far, "divergence")
            .when(F.abs("z_slope") > steep, "slope").when(F.abs("z_residual") > steep, "residual"))
    return out.select(*curves.columns, *[F.round(f"z_{m}", 3).alias(f"z_{m}") for m in MEASURES], flag.alias("flag"))


def stuffed_pages(docs: DataFrame, least_share: float = 0.5, scratch: Scratch | None = None, **flags) -> DataFrame:
    """(doc_id, share, flag) of flagged pages more than ``least_share`` of whose words lie in
    repeated keywords, lists of links or of tags.

    The curves decide which pages are read (flag_pages takes ``flags``); those are read
    whole. Null and empty texts and texts without letters are no cases. Repeated rows of
    one id count once, an id with several texts by each; an empty table gives no rows;
    columns other than doc_id, text and lang aren't read.
    """
    s = scratch or Scratch(docs.sparkSession)
    curves = s.keep(page_curves(docs, scratch=s), "curves", local=False)
    flagged = flag_pages(curves, **flags).where("flag is not null").select("doc_id", "page", "flag")
    texts = docs.select("doc_id", "text").where("text is not null").withColumn("page", F.xxhash64("text"))
    read = texts.join(flagged, ["doc_id", "page"]).select("doc_id", "flag", _share("text").alias("share"))
    return read.where(F.col("share") > least_share).select("doc_id", "share", "flag").distinct()
