"""Table maintenance over the driver's tables; ``events`` is the ordered change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from dizin.operators import upsert as U
from dizin.plans.registry import query
from dizin.scratch import scratch_path
from dizin.tables import KeyedTable


@query("SELECT DISTINCT p_brand AS name, p_type AS kind, p_partkey_min IS NOT NULL AS old FROM (SELECT p_brand, p_type, min(CASE WHEN p_size < 10 THEN p_partkey END) AS p_partkey_min FROM part GROUP BY ALL)")
def m01_get_or_create(t):
    dim = t.part.filter("p_size < 10").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("kind")).agg(F.min("p_partkey").alias("id"))
    new = t.part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    out = U.get_or_create(dim.select("id", "name", "kind"), new, ["name", "kind"])
    return out.join(dim.select(F.col("id").alias("old_id")), F.col("id") == F.col("old_id"), "left").select("name", "kind", F.col("old_id").isNotNull().alias("old"))


@query("""WITH a AS (SELECT n_nationkey AS k, 'Alan' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS code, '{"9":"u' || n_nationkey || '"}' AS cop, CAST(NULL AS VARCHAR) AS dbf FROM nation),
c AS (SELECT c_nationkey % 40 AS k, max(c_custkey) AS m FROM customer WHERE c_nationkey % 3 <> 1 GROUP BY 1)
SELECT a.name, coalesce(CASE WHEN m IS NOT NULL AND k % 5 = 0 THEN 'C' || k END, a.code, CASE WHEN m IS NOT NULL AND k % 3 = 2 THEN '77' END) AS code,
  CASE WHEN m IS NULL THEN a.cop WHEN k % 3 = 0 THEN '{"10":"/cop10/' || k || '","9":"u' || k || '"}' ELSE '{"new":"/x/77_a.rar"}' END AS cop, CASE WHEN m IS NOT NULL THEN '{"9":"d"}' END AS dbf FROM a LEFT JOIN c USING (k)""")
def m02_upsert_areas(t):
    k = F.col("n_nationkey")
    areas = t.nation.select(
        F.concat(F.lit("Alan"), k.cast("string")).alias("name"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 2, "0")).alias("code"), F.concat(F.lit('{"9":"u'), k.cast("string"), F.lit('"}')).alias("cop"), F.lit(None).cast("string").alias("dbf")
    )
    c = F.col("c_nationkey")
    cop = F.when(c % 3 == 0, F.concat(F.lit("/cop10/"), c.cast("string"))).otherwise('{"new":"/x/77_a.rar"}')
    changes = t.customer.filter("c_nationkey % 3 <> 1").select(F.concat(F.lit("ALAN"), c.cast("string")).alias("name"), F.when(c % 5 == 0, F.concat(F.lit("C"), c.cast("string"))).alias("code"), cop.alias("cop"), F.lit('{"9":"d"}').alias("dbf"))
    return U.upsert_areas(areas, changes)


@query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT k, CASE WHEN n.k IS NULL THEN 'keep' WHEN s.k IS NULL THEN 'insert' WHEN s.v = n.v THEN 'skip' ELSE 'update' END AS action, CASE WHEN n.k IS NOT NULL THEN n.v ELSE s.v END AS v FROM s FULL JOIN n USING (k)""")
def m03_sync_actions(t):
    stored = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    listed = t.customer.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("v"))
    return U.sync_actions(stored, listed, "k", "v")


@query("SELECT DISTINCT l_partkey AS course_id, CASE WHEN l_suppkey % 7 <> 0 OR l_linenumber = 1 THEN l_suppkey END AS tool_id FROM lineitem WHERE l_linenumber = 1 OR l_suppkey % 7 <> 0")
def m04_insert_or_ignore(t):
    bridge = t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("tool_id")).distinct()
    new = t.lineitem.select(F.col("l_partkey").alias("course_id"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("tool_id"))
    return U.insert_or_ignore(bridge, new, ["course_id", "tool_id"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END AS p_name, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS INT) AS p_size, p_brand FROM part")
def m05_partial_update(t):
    key = F.col("p_partkey")
    change = lambda f, test, value: t.part.filter(test).select("p_partkey", F.lit(f).alias("field"), value.cast("string").alias("value"))
    changes = (
        change("p_name", key % 3 == 0, F.upper("p_name")).unionByName(change("p_name", key % 3 == 1, F.lit(None)))
        .unionByName(change("p_size", key % 3 == 0, F.col("p_size") + 1)).unionByName(change("p_brand", key % 3 == 0, F.lit("x")))
    )
    return U.partial_update(t.part, changes, "p_partkey", ["p_name", "p_size"]).select("p_partkey", "p_name", "p_size", "p_brand")


#: The values of a key come several times; the last by order and line counts.
NEW = "(SELECT l_partkey AS p_partkey, arg_max(CAST(l_quantity AS INT), {'o': l_orderkey, 'l': l_linenumber, 'q': CAST(l_quantity AS INT)}) AS v FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)"
FIRST = "(SELECT l_partkey AS p_partkey, arg_min(CAST(l_quantity AS INT), {'o': l_orderkey, 'l': l_linenumber, 'q': CAST(l_quantity AS INT)}) AS first, max(CAST(l_quantity AS INT)) AS most FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)"


def new_values(t):
    return t.lineitem.filter("l_suppkey % 2 = 0").select(F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_quantity").cast("int").alias("new"))


@query(f"SELECT p_partkey, coalesce(v, p_size) AS p_size FROM part LEFT JOIN {NEW} USING (p_partkey)")
def m06_bulk_update(t):
    return U.bulk_update(t.part.select("p_partkey", "p_size"), new_values(t), "p_partkey", "p_size", "at")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN coalesce(v, p_size) ELSE p_size END AS p_size, true AS others_stay FROM part LEFT JOIN {NEW} USING (p_partkey)")
def m06_table_update(t):
    """The same update of some parts in a keyed table, twice: only the buckets of their keys are rewritten, all others lie where they were."""
    held = KeyedTable(t.spark, scratch_path(t.spark, "parts"), "p_partkey", 64)
    held.append(t.part.select("p_partkey", "p_size"))
    first, live = next(iter(held.manifest()["parts"].items()))
    changes = new_values(t).filter("p_partkey % 50 = 0")
    for _ in range(2):
        touched = held.update(changes, lambda rows, new: U.bulk_update(rows, new, "p_partkey", "p_size", "at"))
    stayed = held.manifest()["parts"].get(first, [])
    return held.read().withColumn("others_stay", F.lit(stayed == [b for b in live if b not in touched]))


@query(f"SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN coalesce(first, 0) ELSE p_size % 4 END AS INT) AS filled, greatest(p_size, most) AS raised FROM part LEFT JOIN {FIRST} USING (p_partkey)")
def m07_fill_and_raise(t):
    rows = t.part.select("p_partkey", (F.col("p_size") % 4).cast("int").alias("filled"), F.col("p_size").alias("raised"))
    return U.raise_only(U.fill_if_empty(rows, new_values(t), "p_partkey", "filled", "at"), new_values(t), "p_partkey", "raised")


@query("""WITH p AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT l_orderkey, l_returnflag AS name, CAST(l_linenumber AS INT) AS seq FROM lineitem WHERE l_orderkey NOT IN (FROM p) UNION ALL
SELECT l_orderkey, l_linestatus, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus) AS INT) FROM lineitem WHERE l_orderkey IN (FROM p) AND l_linenumber <> 2""")
def m08_replace_children(t):
    held = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("int").alias("seq"))
    new = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_linestatus")).alias("name"), F.struct("l_linenumber", "l_linestatus").alias("pos"))
    return U.replace_children(held, t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey")), new, "l_orderkey", "name", "pos")


@query("""WITH u AS (SELECT DISTINCT p_size AS course_id, p_name AS unit, CAST(1 AS INT) AS hours FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_size AS course_id, upper(p_name) AS k, max(CAST(p_partkey AS INT)) AS hours FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(u.course_id, i.course_id) AS course_id, coalesce(u.unit, i.k) AS unit, coalesce(i.hours, u.hours) AS hours FROM u FULL JOIN i ON u.course_id = i.course_id AND upper(u.unit) = i.k""")
def m08_upsert_units(t):
    units = t.part.filter("p_partkey % 2 = 0").select(F.col("p_size").alias("course_id"), F.col("p_name").alias("unit"), F.lit(1).alias("hours")).distinct()
    incoming = t.part.filter("p_partkey % 3 = 0").select(F.col("p_size").alias("course_id"), F.upper("p_name").alias("unit"), F.col("p_partkey").cast("int").alias("hours"), F.col("p_partkey").alias("pos"))
    return U.upsert_units(units, incoming)


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders), u AS (SELECT o_custkey, o_orderkey FROM r WHERE o_orderstatus <> 'F')
SELECT 'status' AS target, count(*) AS n FROM r UNION ALL SELECT 'success', count(*) FILTER (o_orderstatus <> 'F') FROM r UNION ALL SELECT 'course', count(DISTINCT (o_custkey, 9 + o_custkey % 4)) FROM u
UNION ALL SELECT 'unit', count(DISTINCT o_orderkey) FROM u JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'topic', count(DISTINCT (o_orderkey, l_linenumber)) FROM u JOIN lineitem ON l_orderkey = o_orderkey""")
def m09_batch_save(t):
    topics = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("k"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")))).alias("topics"))
    unit = F.struct(F.col("o_orderkey").cast("string").alias("unit"), "topics")
    none = F.array().cast("array<struct<unit:string,topics:array<string>>>")
    records = t.orders.join(topics, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.lit("a").alias("area"), F.when(F.col("o_orderstatus") == "F", " ").otherwise("b").alias("branch"), F.col("o_custkey").cast("string").alias("course"), (9 + F.col("o_custkey") % 4).cast("int").alias("grade"),
        F.array(F.lit("x")).alias("objectives"), F.array(F.lit("y")).alias("tools"), F.when(F.col("topics").isNull(), none).otherwise(F.array(unit)).alias("units"),
    )
    out = U.batch_save(records)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
    rows = count("status", out["status"]).unionByName(count("success", out["status"].filter("status = 'success'")))
    for name in ("course", "unit", "topic"):
        rows = rows.unionByName(count(name, out[name]))
    return rows


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_size % 2 = 0 THEN 'kopya' ELSE p_name END, p_size FROM part WHERE p_size % 3 = 0")
def m10_copied(t):
    rows = t.part.select("p_partkey", "p_name", "p_size")
    copies = rows.filter("p_size % 3 = 0").select("p_partkey", (F.col("p_partkey") + 1000000).alias("new_id"), F.when(F.col("p_size") % 2 == 0, "kopya").alias("p_name"))
    return U.copied(rows, "p_partkey", copies, ["p_name"])


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3) SELECT 'customer' AS target, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM g) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (FROM g)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM g))""")
def m12_cascade_delete(t):
    gone = t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    left = U.cascade_delete([(t.customer, "c_custkey", None), (t.orders, "o_orderkey", "o_custkey"), (t.lineitem, "l_linenumber", "l_orderkey")], gone)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n") for name, df in zip(("customer", "orders", "lineitem"), left, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH n AS (SELECT o_custkey AS id, CAST(9 + o_orderkey % 3 AS VARCHAR) AS g, arg_max('n' || o_orderkey, o_orderkey) AS u FROM orders GROUP BY ALL),
b AS (SELECT c_custkey AS id, '9' AS g, 'a' AS u FROM customer UNION ALL SELECT c_custkey, '12', 'b' FROM customer), every AS (SELECT * FROM n UNION ALL SELECT b.* FROM b ANTI JOIN n ON b.id = n.id AND b.g = n.g)
SELECT c_custkey AS id, string_agg(g || '=' || u, ',' ORDER BY g) AS urls FROM customer JOIN every ON id = c_custkey GROUP BY 1""")
def m13_merge_grade(t):
    stored = t.customer.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("9"), F.lit("a"), F.lit("12"), F.lit("b")).alias("urls"))
    new = t.orders.select(F.col("o_custkey").alias("id"), (9 + F.col("o_orderkey") % 3).cast("string").alias("grade"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderkey").alias("at"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("urls")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return U.merge_grade(stored, new, "id", "at").select("id", text.alias("urls"))


@query(f"SELECT p_partkey, coalesce(v, p_size) AS p_size, v IS NOT NULL AS hit FROM part LEFT JOIN {NEW} USING (p_partkey)")
def m14_overwrite_matches(t):
    return U.overwrite_matches(t.part.select("p_partkey", "p_size"), new_values(t), "p_partkey", "p_size", "at")


@query("""SELECT 'unique' AS kind, CAST(p_size AS VARCHAR) || p_name AS value, count(*) AS n FROM part GROUP BY p_size, p_name HAVING count(*) > 1
UNION ALL SELECT 'parent', CAST(doc_id AS VARCHAR), count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""")
def m15_integrity(t):
    unique = U.unique_violations(t.part, ["p_size", "p_name"]).select(F.lit("unique").alias("kind"), F.concat(F.col("p_size").cast("string"), "p_name").alias("value"), "n")
    orphans = U.missing_parents(t.documents, t.labels, "doc_id", "doc_id").select(F.lit("parent").alias("kind"), F.col("doc_id").cast("string").alias("value"), "n")
    return unique.unionByName(orphans)


FEED = "(SELECT event_id AS seq, CASE WHEN user_id % 10 = 9 THEN ' ' ELSE 'ders ' || user_id END AS name, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 = 4 THEN NULL ELSE 9 + CAST(json_extract_string(props, '$.k') AS INT) % 5 END AS grade, CAST(floor(value) AS INT) AS hours, event_type AS link FROM events)"


def feed(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id").alias("seq"), F.when(F.col("user_id") % 10 == 9, " ").otherwise(F.concat(F.lit("ders "), F.col("user_id").cast("string"))).alias("name"),
        F.when(k % 5 != 4, 9 + k % 5).alias("grade"), F.floor("value").cast("int").alias("hours"), F.col("event_type").alias("link"),
    )


@query(f"""WITH f AS (SELECT * FROM {FEED} WHERE trim(name) <> '' AND grade > 0), a AS (SELECT name, min(grade) AS g FROM f GROUP BY 1), b AS (SELECT f.name, g, min(seq) AS t FROM f JOIN a ON f.name = a.name AND f.grade = g GROUP BY ALL)
SELECT b.name, CAST(g AS INT) AS grade, max(hours) AS hours, t AS seq, string_agg(DISTINCT link, ',' ORDER BY link) AS links FROM b JOIN f ON f.name = b.name AND f.seq >= t GROUP BY ALL""")
def w03_lowest_grade(t):
    courses, links = U.lowest_grade(feed(t))
    each = links.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("link")), ",").alias("links"))
    return courses.join(each, "name").select("name", "grade", "hours", "seq", "links")


@query("""WITH f AS (SELECT {'a': o_custkey, 'g': o_orderkey % 4, 'k': o_orderkey} AS seq, 'Ders ' || (o_orderkey % 1000) AS name, 9 + o_orderkey % 4 AS grade, o_custkey AS link FROM orders),
a AS (SELECT name, min(grade) AS g FROM f GROUP BY 1), b AS (SELECT f.name, g, min(seq) AS t FROM f JOIN a ON f.name = a.name AND f.grade = g GROUP BY ALL)
SELECT b.name, CAST(g AS INT) AS grade, t.a AS area, CAST(0 AS INT) AS hours, string_agg(DISTINCT link, ',' ORDER BY link) AS links FROM b JOIN f ON f.name = b.name AND f.seq >= t GROUP BY ALL""")
def m16_catalogue_courses(t):
    """Each customer's orders as lists by grade, in the order of their keys; the first row of a course's lowest grade, and links from there on."""
    grade = F.concat((9 + F.col("o_orderkey") % 4).cast("string"), F.lit(". Sınıf"))
    record = F.struct("o_orderkey", F.concat(F.lit("DERS "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(",")).alias("title"), F.lit("u").alias("url"))
    lists = t.orders.groupBy("o_custkey", (F.col("o_orderkey") % 4).alias("no"), grade.alias("g")).agg(F.array_sort(F.collect_list(record)).alias("rs"))
    nested = lists.groupBy("o_custkey", F.col("o_custkey").cast("string").alias("area")).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("no", "g", "rs"))), lambda x: F.struct(x["g"], x["rs"]))).alias("grades"))
    courses, links = U.lowest_grade(U.catalogue_courses(nested, "o_custkey"))
    each = links.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.transform(F.collect_set("link"), lambda x: x.cast("long"))), lambda x: x.cast("string")), ",").alias("links"))
    return courses.join(each, "name").select("name", "grade", F.col("seq.row_no").alias("area"), "hours", "links")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 = 0 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS VARCHAR) AS updated_at FROM part")
def m17_touched(t):
    old = t.part.filter("p_partkey % 5 <> 0").select("p_partkey", "p_name", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    new = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    out = U.touched(old, new, "p_partkey", ["p_name"], F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("p_partkey", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
