"""Queries of the problems on texts and of those tagged llm (3, 5, 6, 7, 8, 9), and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import Scratch, read, spread
from .chunks import split_oversized
from .docpairs import doc_pairs
from .mixing import mix, mixture_report
from .packing import pack, pack_report
from .percentiles import clean_samples, day_sketch, merge_sketches, percentiles
from .stuffing import ELEMENT, FUNCTION_WORDS, MEASURES, ODD, STOPS, flag_pages, page_curves, stuffed_pages
from .tokens import with_tokens


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "indexed_text_unit"), keys=["unit", "ordinal"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece = 0").select("unit", "ordinal", "hard")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(read(spark, d, "indexed_symbol"), read(spark, d, "source_file"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The resolved pairs whose comment is the item's own, which is what the statement asks for."""
    return _pairs(spark, d).where("doc_from = 'own'").select("repository", "path", "start_byte")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (
        clean_samples(read(spark, d, "web_host_metrics"), "request", "kind", "request_duration_us"),
        clean_samples(read(spark, d, "runtime_metrics"), "task_run", "operation", "task_run_duration_us"),
        clean_samples(read(spark, d, "relation_kernel_metrics"), "commit", "outcome", "transaction_commit_duration_us"),
    ))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_samples(spark, d))


def p6_day_sketch(spark: SparkSession, d: str) -> DataFrame:
    return day_sketch(_samples(spark, d))


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    """Weeks from the days' sketches."""
    week = day_sketch(_samples(spark, d)).where("day is not null").withColumn("week", F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd"))
    return merge_sketches(week, ["metric", "label", "week"])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(spread(read(spark, d, "documents").select("doc_id", "source", "text"), scan=True)).select("doc_id", "source", "n_tokens")
    return Scratch(spark).keep(sized, "sized")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sized(spark, d), item="doc_id", tokens="n_tokens").withColumnRenamed("item", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(pack(_sized(spark, d), item="doc_id", tokens="n_tokens"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), read(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), read(spark, d, "mix_target")
    return mixture_report(sized, targets, mix(sized, targets))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized unit: do its pieces tile the text, fit, share with the one before what
    that ends with, and, unless a line is too long, end at a line, sentence, clause or word?"""
    units = read(spark, d, "indexed_text_unit").where(F.length("text") > 2000).select("unit", "ordinal", F.col("text").alias("whole"), F.xxhash64("text").alias("__h")).dropDuplicates(["unit", "ordinal", "__h"])
    p = Scratch(spark).keep(_pieces(spark, d), "pieces", local=False)
    by = p.groupBy("unit", "ordinal", "hard").agg(
        F.array_sort(F.collect_list(F.struct("piece", "text", "shared"))).alias("ps"), F.max("n_chars").alias("most"), F.max("shared").alias("overlap"), F.max("pieces").alias("pieces"))
    own = lambda x: F.substring(x["text"], x["shared"].cast("int") + 1, F.length(x["text"]))
    pairs = F.zip_with(F.slice("ps", 1, F.size("ps") - 1), F.slice("ps", 2, F.size("ps") - 1), lambda a, b: F.endswith(a["text"], F.left(b["text"], b["shared"].cast("int"))))
    natural = F.transform(F.slice("ps", 1, F.size("ps") - 1), lambda x: x["text"].rlike(r"[\s.,;:!?…–—、，；：。！？|>]$"))
    x = by.join(units, ["unit", "ordinal"])
    return x.select(
        "unit", "ordinal", (F.array_join(F.transform("ps", own), "") == F.col("whole")).alias("tiled"), ((F.col("most") <= 2000) & (F.col("overlap") <= 200) & (F.size("ps") == F.col("pieces"))).alias("fit"),
        F.forall(pairs, lambda b: b).alias("shared"), ((F.col("hard") == 1) | F.forall(natural, lambda b: b)).alias("natural"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether no container is overfull, every text is there whole and once, none is split that
    fits, and the containers are at least 97 % full or the fewest possible."""
    sized = _sized(spark, d)
    packed = Scratch(spark).keep(pack(sized, item="doc_id", tokens="n_tokens"), "packed", local=False)
    got = packed.groupBy("item").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("parts"), F.countDistinct("first_token").alias("places"))
    docs = sized.where("n_tokens > 0").join(got, F.col("doc_id") == F.col("item"), "full_outer")
    each = docs.agg(F.min((F.col("packed") == F.col("n_tokens")) & (F.col("parts") == F.col("places"))).alias("whole"), F.min((F.col("parts") == 1) | (F.col("n_tokens") > 2048)).alias("unsplit"))
    r = pack_report(packed)
    return r.crossJoin(each).select((F.col("fullest") <= 2048).alias("capacity"), "whole", "unsplit", ((F.col("fill") >= 0.97) | (F.col("containers") <= F.col("least_containers") + 1)).alias("filled"))  # two single rows


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: is its share of the mixture reached to within its largest document, and
    no document used more often than allowed?"""
    sized, targets = _sized(spark, d), read(spark, d, "mix_target")
    shares = mixture_report(sized, targets, Scratch(spark).keep(mix(sized, targets), "mixed", local=False))
    largest = sized.groupBy(F.col("source").alias("__s")).agg(F.max("n_tokens").alias("largest"))
    x = shares.join(largest, F.col("source") == F.col("__s"), "left").withColumn("all", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))  # a row per target
    near = F.abs(F.col("mixed_tokens") - F.col("share") * F.col("all")) <= F.coalesce("largest", F.lit(0)) + F.col("share") * F.sum(F.coalesce("largest", F.lit(0))).over(Window.partitionBy(F.lit(0))) + 1
    return x.select("source", near.alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(read(spark, d, "documents")).select("doc_id").distinct()


def p9_curves(spark: SparkSession, d: str) -> DataFrame:
    """Every page's curve, its distance from pages of its kind, and its flag."""
    curves = Scratch(spark).keep(page_curves(read(spark, d, "documents")), "curves", local=False)
    flags = flag_pages(curves)
    return flags.select("doc_id", "language", F.col("prose").cast("int").alias("prose"), "n", "types", *[F.round(m, 3).alias(m) for m in MEASURES], *[f"z_{m}" for m in MEASURES], "flag")


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p3_checks, p5_found, p5_pairs, p6_percentiles, p6_day_sketch, p6_combined, p7_containers, p7_report, p7_checks, p8_mixture, p8_shares, p8_checks, p9_found, p9_curves)}

_SAMPLES = " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, {label} AS label, sample_id, min(recorded_at::DATE) AS day, min({duration}) AS value FROM {table} "
    f"WHERE {duration} >= 0 AND {duration} < 9223372036854775807 AND sample_id IS NOT NULL GROUP BY sample_id, {label}"
    for metric, label, duration, table in (
        ("request", "kind", "request_duration_us", "web_host_metrics"), ("task_run", "operation", "task_run_duration_us", "runtime_metrics"),
        ("commit", "outcome", "transaction_commit_duration_us", "relation_kernel_metrics")))
_RANKS = ", ".join(f"min(CASE WHEN r >= greatest(1, (n * {q} + 999) // 1000) THEN v END) AS {name}" for q, name in ((500, "p50"), (900, "p90"), (990, "p99"), (999, "p999")))
_LOW = "((value >> greatest(0, length(bin(value)) - 8)) << greatest(0, length(bin(value)) - 8))"

_FW = ", ".join(f"('{code}', '{w}')" for code, ws in FUNCTION_WORDS.items() for w in sorted(set(ws.split())))
_FIT = ", ".join(f"regr_slope({m}, x) AS b_{m}, avg({m}) AS m_{m}, regr_syy({m}, x) AS s_{m}, regr_sxy({m}, x) AS c_{m}, regr_sxx({m}, x) AS x_{m}" for m in MEASURES)
_IN = lambda marks: ", ".join("'" + m + "'" for m in marks)


def _z(m: str) -> str:
    g = lambda c: f"CASE WHEN l.pages >= 10 THEN l.{c}_{m} ELSE p.{c}_{m} END"
    mx, n = "CASE WHEN l.pages >= 10 THEN l.mx ELSE p.mx END", "CASE WHEN l.pages >= 10 THEN l.pages ELSE p.pages END"
    dev = f"sqrt(greatest(0, ({g('s')}) - coalesce(({g('c')}) * ({g('c')}) / nullif(({g('x')}), 0), 0)) / ({n})) + 1e-6"
    return f"(v.{m} - ({g('m')}) - coalesce(({g('b')}), 0) * (v.x - ({mx}))) / ({dev}) AS z_{m}"


_CURVES = f"""
WITH fw(language, w) AS (VALUES {_FW}),
d AS (SELECT doc_id, text, lower(lang) AS lang, regexp_extract_all(lower(text), '{ELEMENT}') AS e FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(e) AS w FROM d) GROUP BY ALL),
b AS (SELECT doc_id, max(struct_pack(v := v, code := language)) AS b FROM (SELECT doc_id, language, sum(c) AS v FROM c JOIN fw USING (w) GROUP BY ALL) GROUP BY doc_id),
k AS (SELECT doc_id, sum(c) AS n, coalesce(sum(c) FILTER (WHERE w IN ({_IN(STOPS)})), 0) AS stops, coalesce(sum(c) FILTER (WHERE w IN ({_IN(ODD)})), 0) AS odd FROM c GROUP BY doc_id),
pg AS (SELECT doc_id, CASE WHEN b.v > 1 THEN b.code WHEN lang IN ({_IN(FUNCTION_WORDS)}) THEN lang ELSE 'und' END AS language, regexp_matches(text, '\\p{{L}}') AS lettered,
         coalesce(b.v > 1 AND b.v * 7 >= n AND stops * 40 >= n AND stops * 4 <= n AND odd * 25 <= n, FALSE) AS prose FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)),
t AS (SELECT language, w, sum(c) AS t FROM c JOIN pg USING (doc_id) WHERE prose GROUP BY ALL),
corpus AS (SELECT * FROM t UNION ALL SELECT 'und', w, sum(t) FROM t GROUP BY w),
known AS (SELECT language AS yard, w, t / sum_t AS q FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY t DESC, w) AS k, sum(t) OVER (PARTITION BY language) AS sum_t FROM corpus) WHERE k <= 500),
rest AS (SELECT yard, greatest(1 - sum(q), 1e-6) AS q_rest FROM known GROUP BY yard),
pg2 AS (SELECT *, CASE WHEN language IN (SELECT yard FROM rest) THEN language ELSE 'und' END AS yard FROM pg WHERE lettered),
held AS (SELECT doc_id, yard, c, q FROM c JOIN pg2 USING (doc_id) LEFT JOIN known USING (yard, w)),
pt AS (SELECT doc_id, yard, c, count(*) AS m, sum(c * ln(c / q)) AS inn, count(q) AS kn FROM held GROUP BY ALL),
px AS (SELECT *, ln(sum(m) OVER (PARTITION BY doc_id ORDER BY c DESC)) AS x, ln(c) AS y FROM pt),
f AS (SELECT doc_id, yard, sum(c * m) AS n, sum(m) AS types, count(*) AS points, regr_slope(y, x) AS slope, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx,
        coalesce(sum(inn), 0) AS inn, sum(c * (m - kn)) AS outt FROM px GROUP BY ALL),
v AS (SELECT pg2.doc_id, language, prose, n, types, ln(n) AS x, CASE WHEN points > 1 THEN coalesce(slope, 0) ELSE 0 END AS slope,
        coalesce(sqrt(greatest(0, syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END) / points), 0) AS residual,
        (inn + CASE WHEN outt > 0 THEN outt * ln(outt / coalesce(q_rest, 1.0)) ELSE 0 END) / n - ln(n) AS divergence
      FROM f JOIN pg2 USING (doc_id) LEFT JOIN rest ON rest.yard = f.yard),
l AS (SELECT language, count(*) AS pages, avg(x) AS mx, {_FIT} FROM v WHERE prose GROUP BY language),
p AS (SELECT count(*) AS pages, avg(x) AS mx, {_FIT} FROM v WHERE prose),
z AS (SELECT v.*, {", ".join(map(_z, MEASURES))} FROM v LEFT JOIN l ON l.language = v.language, p)
SELECT doc_id, language, prose::INTEGER AS prose, n::BIGINT AS n, types::BIGINT AS types, {", ".join(f"round({m}, 3) AS {m}" for m in MEASURES)}, {", ".join(f"round(z_{m}, 3) AS z_{m}" for m in MEASURES)},
  CASE WHEN language = 'und' THEN 'unmeasured' WHEN abs(z_divergence) > 2 THEN 'divergence' WHEN abs(z_slope) > 3 THEN 'slope' WHEN abs(z_residual) > 3 THEN 'residual' END AS flag FROM z"""

ORACLES = {
    "p3_checks": "SELECT DISTINCT unit, ordinal, TRUE AS tiled, TRUE AS fit, TRUE AS shared, TRUE AS \"natural\" FROM indexed_text_unit WHERE length(text) > 2000",
    "p7_checks": "SELECT TRUE AS capacity, TRUE AS whole, TRUE AS unsplit, TRUE AS filled",
    "p8_checks": "SELECT DISTINCT source, TRUE AS share_kept, TRUE AS repeats_kept FROM mix_target WHERE source IS NOT NULL",
    "p9_curves": _CURVES,
    "p3_found": """
SELECT DISTINCT unit, ordinal, (CASE WHEN list_max(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: length(x))) > 2000 THEN 1 ELSE 0 END)::INTEGER AS hard
FROM indexed_text_unit WHERE length(text) > 2000""",
    "p6_percentiles": f"""
WITH s AS ({_SAMPLES}), g AS (
  SELECT metric, label, strftime(day, '%Y-%m-%d') AS day, value AS v FROM s WHERE day IS NOT NULL UNION ALL SELECT metric, label, 'all', value FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, label, day ORDER BY v) AS r, count(*) OVER (PARTITION BY metric, label, day) AS n FROM g)
SELECT metric, label, day, n, {_RANKS} FROM r GROUP BY metric, label, day, n""",
    "p6_day_sketch": f"WITH s AS ({_SAMPLES}) SELECT metric, label, strftime(day, '%Y-%m-%d') AS day, {_LOW} AS low, count(*) AS n FROM s GROUP BY ALL",
    "p6_combined": f"""
WITH s AS ({_SAMPLES}), g AS (SELECT metric, label, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, {_LOW} AS v FROM s WHERE day IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, label, week ORDER BY v) AS r, count(*) OVER (PARTITION BY metric, label, week) AS n FROM g)
SELECT metric, label, week, n, {_RANKS} FROM r GROUP BY metric, label, week, n""",
}
