"""Name matching over names of parts: upper-case or longer variants on the left, names of part kinds on the right."""

from __future__ import annotations

from pyspark.sql import functions as F

from dizin.operators import match as M
from dizin.plans.registry import query

#: Left: names with type, some in capitals, some cut; right: distinct names by brand.
LEFT = "(SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN string_split(p_name, ' ')[2] ELSE p_type || ' ' || p_brand END AS name, p_size % 2 = 0 AS protocol FROM part)"
RIGHT = "(SELECT p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END AS name, CAST(min(p_partkey) AS BIGINT) AS id, min(p_partkey) % 2 = 0 AS protocol FROM part GROUP BY 1)"


def left(t):
    size = F.col("p_size") % 4
    name = (
        F.when(size == 0, F.upper("p_name")).when(size == 1, F.concat("p_name", F.lit(" "), F.lower("p_type")))
        .when(size == 2, F.get(F.split("p_name", " "), F.lit(1))).otherwise(F.concat("p_type", F.lit(" "), "p_brand"))
    )
    return t.part.select(name.alias("name"), (F.col("p_size") % 2 == 0).alias("protocol")).distinct()


def right(t):
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(""))
    return t.part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("protocol", F.col("id") % 2 == 0)


def names(t):
    return left(t).select("name").distinct()


L = f"l AS (SELECT DISTINCT name FROM {LEFT}), r AS (SELECT * FROM {RIGHT})"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
TOKENS = f"""lw AS (SELECT name AS l, {WORDS.format('name')} AS lw FROM l), rw AS (SELECT name AS r, {WORDS.format('name')} AS rw FROM r),
met AS (SELECT l, r, len(list_intersect(lw, rw)) AS common, len(lw) AS n_l, len(rw) AS n_r FROM lw, rw WHERE len(list_intersect(lw, rw)) > 0)"""
HELD = "(contains(lower(l.name), lower(r.name)) OR contains(lower(r.name), lower(l.name)))"


@query(f"""WITH {L}, k AS (SELECT lower(translate(name, 'İI', 'iı')) AS k, max(id) AS id FROM r GROUP BY 1) SELECT name, k.id FROM l LEFT JOIN k ON lower(translate(l.name, 'İI', 'iı')) = k""")
def j05_exact(t):
    return M.exact(names(t), right(t)).select("name", "id")


@query(f"""WITH {L} SELECT l.name, r.id, CAST(CASE WHEN lower(l.name) = lower(r.name) THEN 0 ELSE 1 END AS INT) AS tier FROM l JOIN r ON {HELD}
QUALIFY row_number() OVER (PARTITION BY l.name ORDER BY tier, r.name, r.id) = 1""")
def j06_containment(t):
    return M.containment(names(t), right(t))


@query(f"""WITH l AS (SELECT * FROM {LEFT}), r AS (SELECT * FROM {RIGHT}) SELECT l.name, l.protocol, r.id, CAST(CASE WHEN lower(l.name) = lower(r.name) THEN 0 WHEN l.protocol = r.protocol THEN 1 ELSE 2 END AS INT) AS tier FROM l JOIN r ON {HELD}
QUALIFY row_number() OVER (PARTITION BY l.name, l.protocol ORDER BY tier, r.name, r.id) = 1""")
def j07_class_containment(t):
    return M.class_containment(left(t), right(t)).select("name", "protocol", "id", "tier")


@query(f"""WITH {L}, {TOKENS}, g AS (SELECT l, r, CAST(CASE WHEN lower(l) = lower(r) THEN 0 ELSE 1 END AS INT) AS tier FROM met WHERE lower(l) = lower(r) OR common >= 2 OR common >= 0.7 * n_l)
SELECT l AS name, r AS match, tier FROM g QUALIFY row_number() OVER (PARTITION BY l ORDER BY tier, r) = 1""")
def j08_keyword_overlap(t):
    return M.keyword_overlap(names(t), right(t))


@query(f"""WITH l AS (SELECT DISTINCT lower(name) AS name FROM {LEFT}), r AS (SELECT DISTINCT lower(name) AS name FROM {RIGHT}), {TOKENS},
s AS (SELECT l.name AS l, r.name AS r, CASE WHEN l.name = r.name THEN 100.0 ELSE 90.0 END AS score FROM l, r WHERE contains(l.name, r.name) OR contains(r.name, l.name)
  UNION ALL SELECT l, r, 200.0 * common / (n_l + n_r) FROM met WHERE 200.0 * common / (n_l + n_r) > 70 AND NOT contains(l, r) AND NOT contains(r, l)), b AS (SELECT l, r, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY ALL)
SELECT l AS name, r AS match, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY l ORDER BY b.score DESC, r) = 1""")
def j09_similarity(t):
    return M.similarity(names(t), right(t)).withColumn("score", F.round("score", 6))


@query(f"""WITH {L}, {TOKENS}, same AS (SELECT l.name AS name, r.name AS match FROM l JOIN r ON upper(trim(l.name)) = upper(trim(r.name)))
SELECT * FROM same UNION ALL SELECT l, r FROM met WHERE n_l >= 2 AND common >= least(2.0, 0.6 * n_l) AND l NOT IN (SELECT name FROM same)""")
def j10_partial_matches(t):
    return M.partial_matches(names(t), right(t))


REFERENCE = "(SELECT p_name AS name, CAST(min(p_size) AS VARCHAR) AS code FROM part GROUP BY 1)"
ASKED = "(SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' - Protokol' WHEN 3 THEN p_type ELSE p_brand END AS name, CASE WHEN p_size % 7 = 0 THEN 'g' ELSE '' END AS given FROM part)"


def reference(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").cast("string").alias("code"))


def asked(t):
    size = F.col("p_size") % 5
    name = F.when(size == 0, F.col("p_name")).when(size == 1, F.upper("p_name")).when(size == 2, F.concat("p_name", F.lit(" - Protokol"))).when(size == 3, F.col("p_type")).otherwise(F.col("p_brand"))
    return t.part.select(name.alias("name"), F.when(F.col("p_size") % 7 == 0, "g").otherwise("").alias("given")).distinct()


@query(f"""WITH a AS (SELECT *, regexp_replace(name, '\\s*-\\s*[Pp]rotokol\\s*$', '') AS base FROM {ASKED}), ref AS (SELECT * FROM {REFERENCE}), st AS (SELECT DISTINCT p_type AS name, 'T' AS code FROM part),
k AS (SELECT upper(name) AS k, min(code) AS code FROM ref GROUP BY 1)
SELECT a.name, coalesce(nullif(given, ''), st.code, ref.code, k.code, b.code) AS code, CASE WHEN given <> '' THEN 'given' WHEN st.code IS NOT NULL THEN 'table' WHEN ref.code IS NOT NULL THEN 'list' WHEN k.code IS NOT NULL THEN 'key' WHEN b.code IS NOT NULL THEN 'base' ELSE 'none' END AS source
FROM a LEFT JOIN st ON a.name = st.name LEFT JOIN ref ON a.name = ref.name LEFT JOIN k ON upper(a.name) = k.k LEFT JOIN ref b ON a.base = b.name""")
def j11_code_with_source(t):
    stored = t.part.select(F.col("p_type").alias("name"), F.lit("T").alias("code")).distinct()
    return M.code_with_source(asked(t), stored, reference(t))


@query(f"""WITH a AS (SELECT *, regexp_replace(name, '\\s*-\\s*[Pp]rotokol\\s*$', '') AS base FROM {ASKED}), ref AS (SELECT * FROM {REFERENCE})
SELECT a.name, coalesce(ref.code, b.code) AS code FROM a LEFT JOIN ref ON a.name = ref.name LEFT JOIN ref b ON a.base = b.name""")
def j12_enriched(t):
    return M.enriched(asked(t), reference(t))


@query("SELECT n_nationkey, CAST(g AS INT) AS grade FROM nation, unnest([9, 10, 11, 12]) AS u(g)")
def j13_work_list(t):
    return M.work_list(t.nation.select("n_nationkey"))


@query("""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS folder, regexp_replace(string_split(url, '/')[-1], '\\?.*$', '') AS name FROM pages)
SELECT page_id FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.name = f.name AND g.folder <> f.folder)""")
def j14_elsewhere(t):
    files = t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("folder"), F.regexp_replace(F.substring_index("url", "/", -1), r"\?.*$", "").alias("name"))
    return M.elsewhere(files).select("page_id")


@query("""WITH i AS (SELECT p_size % 50 AS course_id, string_split(p_name, ' ')[1] AS part, CAST(max(p_size) AS INT) AS h FROM part GROUP BY ALL),
u AS (SELECT p_partkey AS unit_id, p_size % 50 AS course_id, upper(p_name) AS unit, CAST(CASE WHEN p_size % 3 = 0 THEN 5 ELSE 0 END AS INT) AS hours FROM part),
f AS (SELECT unit_id, arg_min(h, {'p': part, 'h': h}) AS h FROM u JOIN i USING (course_id) WHERE hours = 0 AND contains(lower(unit), lower(part)) GROUP BY 1)
SELECT u.unit_id, coalesce(f.h, u.hours) AS hours FROM u LEFT JOIN f USING (unit_id)""")
def j15_fill_by_pattern(t):
    incoming = t.part.groupBy((F.col("p_size") % 50).alias("course_id"), F.get(F.split("p_name", " "), F.lit(0)).alias("part")).agg(F.max("p_size").cast("int").alias("new_hours"))
    units = t.part.select(F.col("p_partkey").alias("unit_id"), (F.col("p_size") % 50).alias("course_id"), F.upper("p_name").alias("unit"), F.when(F.col("p_size") % 3 == 0, 5).otherwise(0).alias("hours"))
    return M.fill_by_pattern(units, incoming).select("unit_id", "hours")


@query("""WITH b AS (SELECT string_split(p_name, ' ')[2] AS bucket, CAST(min(p_partkey) AS INT) AS pos FROM part GROUP BY 1), n AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN string_split(p_name, ' ')[2] WHEN p_size % 3 = 1 THEN upper(p_name) ELSE p_type END AS name FROM part),
m AS (SELECT name, bucket FROM n JOIN b ON contains(upper(name), upper(bucket)) OR contains(upper(bucket), upper(name)) QUALIFY row_number() OVER (PARTITION BY name ORDER BY name <> bucket, pos) = 1)
SELECT n.name, bucket FROM n LEFT JOIN m USING (name)""")
def j16_bucket_fallback(t):
    second = F.get(F.split("p_name", " "), F.lit(1))
    buckets = t.part.groupBy(second.alias("bucket")).agg(F.min("p_partkey").cast("int").alias("pos"))
    name = F.when(F.col("p_size") % 3 == 0, second).when(F.col("p_size") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_type"))
    return M.bucket_fallback(t.part.select(name.alias("name")), buckets)
