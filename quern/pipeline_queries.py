"""Queries of the record problems that live in the core (1, 2 and 4), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.hierarchy import all_descendants, build_hierarchy
from .operators.orphans import orphan_report, reference_orphans
from .operators.replay import replay, watermark
from .runtime import Scratch, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reference_orphans(read(spark, d, "indexed_reference"), read(spark, d, "indexed_symbol"), read(spark, d, "source_file"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(read(spark, d, "commit_log"))


def p2_watermark(spark: SparkSession, d: str) -> DataFrame:
    return watermark(read(spark, d, "commit_log"))


def p2_committed(spark: SparkSession, d: str) -> DataFrame:
    return replay(read(spark, d, "commit_log"), gaps="hold")


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return build_hierarchy(read(spark, d, "delegates"), order="order_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).where("is_child").select("node", "root", "depth", "path")


def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The nested-set ranges: b descends from a iff their roots are equal and a.lft < b.lft <= a.rgt;
    null for nodes on or under a ring."""
    return build_hierarchy(read(spark, d, "delegates"), order="order_no", paths=False).select("node", "root", "lft", "rgt", (F.col("size") - 1).alias("descendants"), F.col("ring").cast("int").alias("ring"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node, read off the ranges."""
    h = Scratch(spark).keep(build_hierarchy(read(spark, d, "delegates"), order="order_no", paths=False).select("node", "root", "lft", "rgt", "size", "ring"), "ranges")
    return all_descendants(h)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_watermark, p2_committed, p4_found, p4_ranges, p4_descendants)}

_P1 = """
WITH r AS (
  SELECT ref_id, 'symbol' AS target, repository, symbol AS name, indexed_at AS t FROM indexed_reference
  UNION ALL SELECT ref_id, 'path', repository, path, indexed_at FROM indexed_reference),
r2 AS (SELECT DISTINCT * FROM r WHERE t IS NOT NULL AND name IS NOT NULL AND name <> ''),
l AS (
  SELECT 'symbol' AS target, repository, symbol AS name, indexed_at AS b, deleted_at AS d FROM indexed_symbol
  UNION ALL SELECT 'path', repository, path, indexed_at, deleted_at FROM source_file),
j AS (
  SELECT r2.ref_id, r2.target, r2.t, max(CASE WHEN l.name IS NOT NULL THEN 1 ELSE 0 END) AS known,
    max(CASE WHEN l.b <= r2.t THEN 1 ELSE 0 END) AS born,
    max(CASE WHEN l.b <= r2.t AND (l.d IS NULL OR l.d > r2.t) THEN 1 ELSE 0 END) AS alive
  FROM r2 LEFT JOIN l ON r2.target = l.target AND r2.repository = l.repository AND r2.name = l.name
  GROUP BY r2.ref_id, r2.target, r2.repository, r2.name, r2.t),
found AS (
  SELECT DISTINCT ref_id, target, CASE WHEN known = 0 THEN 'missing' WHEN born = 1 THEN 'deleted' ELSE 'late' END AS reason,
    strftime(t, '%Y-%m') AS period FROM j WHERE alive = 0)
"""

_TX = """
WITH tx AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world, version ORDER BY received_at DESC NULLS LAST, delivery_id DESC) AS n
                 FROM commit_log WHERE version IS NOT NULL AND world IS NOT NULL) WHERE n = 1 {held}),
cat AS (SELECT world, version, i, catalog_changes[i] AS c FROM (SELECT world, version, catalog_changes, unnest(range(1, len(catalog_changes) + 1)) AS i FROM tx)),
fact AS (SELECT world, version, i, changes[i] AS c FROM (SELECT world, version, changes, unnest(range(1, len(changes) + 1)) AS i FROM tx)),
made AS (SELECT world, c.relation AS relation, min(version) AS v, arg_min(c.functional, version * 1000 + i) AS functional FROM cat WHERE c.change = 'RelationCreated' GROUP BY ALL),
good AS (SELECT f.world, f.version, f.i, f.c.relation AS relation, f.c.kind AS kind, array_to_string(f.c.tuple, '|') AS item,
           CASE WHEN m.functional THEN f.c.tuple[1] ELSE array_to_string(f.c.tuple, '|') END AS slot
         FROM fact f JOIN made m ON f.world = m.world AND f.c.relation = m.relation AND f.version >= m.v),
lastset AS (SELECT world, relation, slot, arg_max(item, version * 1000 + i) AS item, max(version) AS v FROM good WHERE kind = 'Assert' GROUP BY ALL),
facts AS (SELECT s.world, 'fact' AS entry, s.relation AS name, s.item FROM lastset s WHERE NOT EXISTS (
    SELECT 1 FROM good g WHERE g.kind = 'Retract' AND g.world = s.world AND g.relation = s.relation AND g.item = s.item AND g.version > s.v)),
rules AS (SELECT world, c.rule_id AS rule_id, arg_max(c, version * 1000 + i) AS c FROM cat WHERE c.change IN ('RuleInstalled', 'RuleDisabled') AND c.rule_id IS NOT NULL GROUP BY ALL)
SELECT * FROM facts UNION ALL SELECT world, 'rule', c.relation, rule_id FROM rules WHERE c.change = 'RuleInstalled'
"""

_MARK = """
SELECT world, coalesce(max(CASE WHEN version = rk THEN version END), 0) AS watermark, max(version) AS last_version, count(CASE WHEN version <> rk THEN 1 END) AS held
FROM (SELECT world, version, row_number() OVER (PARTITION BY world ORDER BY version) AS rk
      FROM (SELECT DISTINCT world, version FROM commit_log WHERE version >= 1 AND world IS NOT NULL)) GROUP BY world
"""

_P4 = """
WITH RECURSIVE own AS (
  SELECT child AS node, arg_min(parent, struct_pack(o := coalesce(order_no, 2147483647), p := parent)) FILTER (WHERE parent IS NOT NULL) AS parent
  FROM delegates WHERE child IS NOT NULL GROUP BY child),
allnodes AS (SELECT node, parent, TRUE AS is_child FROM own
  UNION ALL SELECT DISTINCT parent, NULL::BIGINT, FALSE FROM own WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM own)),
walk AS (
  SELECT node, node AS cur, [node] AS seen, FALSE AS ring FROM allnodes
  UNION ALL
  SELECT w.node, p.parent, list_prepend(p.parent, w.seen), list_contains(w.seen, p.parent)
  FROM walk w JOIN allnodes p ON p.node = w.cur WHERE p.parent IS NOT NULL AND NOT w.ring),
done AS (
  SELECT w.node, a.is_child, w.ring, w.cur, w.seen FROM walk w JOIN allnodes a ON a.node = w.node JOIN allnodes c ON c.node = w.cur
  WHERE w.ring OR c.parent IS NULL)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_report": _P1 + "SELECT target, period, reason, count(*) AS orphans, count(DISTINCT ref_id) AS refs FROM found GROUP BY ALL",
    "p2_found": _TX.format(held=""),
    "p2_watermark": _MARK,
    "p2_committed": _TX.format(held=f"AND version <= (SELECT w.watermark FROM ({_MARK}) w WHERE w.world = commit_log.world)").replace(
        "FROM commit_log WHERE version IS NOT NULL AND world IS NOT NULL) WHERE n = 1", "FROM commit_log WHERE version IS NOT NULL AND world IS NOT NULL) commit_log WHERE n = 1"),
    "p4_found": _P4 + """
SELECT node, CASE WHEN ring THEN list_min(seen[2:list_position(seen[2:], cur) + 1]) ELSE cur END AS root,
  CASE WHEN ring THEN -1 ELSE len(seen) - 1 END AS depth, CASE WHEN ring THEN '' ELSE array_to_string(seen, '/') END AS path
FROM done WHERE is_child""",
    "p4_ranges": _P4 + """
, tree AS (SELECT node, cur AS root, seen FROM done WHERE NOT ring),
sizes AS (SELECT a AS node, count(*) - 1 AS n FROM (SELECT unnest(seen) AS a FROM tree) GROUP BY a)
SELECT t.node, t.root, l AS lft, l + s.n AS rgt, s.n AS descendants, 0::INTEGER AS ring
FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seen) - 1 AS l FROM tree) t JOIN sizes s ON s.node = t.node
UNION ALL
SELECT node, list_min(seen[2:list_position(seen[2:], cur) + 1]), NULL, NULL, NULL, 1::INTEGER FROM done WHERE ring""",
    "p4_descendants": _P4 + """
SELECT a AS node, root, node AS descendant FROM (SELECT node, cur AS root, unnest(seen) AS a FROM done WHERE NOT ring) WHERE a <> node""",
}
