"""Browsing and hierarchy over the driver's tables: region is area, nation branch, part course, customer unit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dizin.functions import text as T
from dizin.operators import browse as B
from dizin.operators import hierarchy as H
from dizin.plans.registry import query


def area(t):
    return t.region.select(F.col("r_regionkey").alias("area_id"), F.col("r_name").alias("area"))


def branch(t):
    return t.nation.select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch"), F.col("n_regionkey").alias("area_id"))


def course(t):
    return t.part.select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("course"), (9 + F.col("p_size") % 4).cast("int").alias("grade"), (F.col("p_size") % 9).cast("int").alias("hours"))


def bridge(t):
    supplied = t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return supplied.select(F.col("l_partkey").alias("course_id"), F.col("s_nationkey").alias("branch_id")).distinct()


#: The same four tables in SQL.
WITH = """WITH area AS (SELECT r_regionkey AS area_id, r_name AS area FROM region), branch AS (SELECT n_nationkey AS branch_id, n_name AS branch, n_regionkey AS area_id FROM nation),
course AS (SELECT p_partkey AS course_id, p_name AS course, CAST(9 + p_size % 4 AS INT) AS grade, CAST(p_size % 9 AS INT) AS hours FROM part),
bridge AS (SELECT DISTINCT l_partkey AS course_id, s_nationkey AS branch_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
FLAT = f"""{WITH}, flat AS (SELECT c.course_id, coalesce(area, '-') AS area, coalesce(branch, '-') AS branch, coalesce(course, '-') AS course, coalesce(grade, 0) AS grade, coalesce(hours, 0) AS hours
  FROM course c LEFT JOIN bridge b ON c.course_id = b.course_id LEFT JOIN branch n ON b.branch_id = n.branch_id LEFT JOIN area a ON n.area_id = a.area_id)"""


def flat(t):
    return B.flat_courses(course(t), bridge(t), branch(t), area(t))


@query(f"{FLAT} SELECT * FROM flat")
def j02_flat_courses(t):
    order = [F.col(c).asc_nulls_first() for c in ("area", "branch", "course", "grade")]
    return flat(t).orderBy(*order, "course_id")


@query(f"{FLAT} SELECT * FROM flat WHERE contains(lower(area), 'red') OR contains(lower(branch), 'red') OR contains(lower(course), 'red')")
def p01_search(t):
    return B.search(flat(t), " RED ", ["area", "branch", "course"])


@query(f"{FLAT} SELECT * FROM flat WHERE grade IN (9, 11) AND hours IN (2, 4, 6)")
def p02_facet_filter(t):
    return B.facet_filter(flat(t), {"grade": [9, 11], "hours": ["2", "4", "6"], "area": []})


COUNTS = f"""{FLAT}, pairs AS (SELECT 'area' AS facet, area AS value FROM flat UNION ALL SELECT 'branch', branch FROM flat UNION ALL SELECT 'grade', CAST(grade AS VARCHAR) FROM flat),
counts AS (SELECT facet, value, count(*) AS rows FROM pairs WHERE value <> '' GROUP BY ALL), facets AS (SELECT *, count(*) OVER (PARTITION BY facet) AS n_values FROM counts)"""


@query(f"{COUNTS} SELECT * FROM facets")
def a04_facet_counts(t):
    return B.facet_counts(flat(t), ["area", "branch", "grade"]).orderBy(F.desc("rows"), "value")


@query(f"{COUNTS} SELECT * FROM facets WHERE facet = 'branch' AND contains(lower(value), '1')")
def p03_facet_options(t):
    return B.facet_options(B.facet_counts(flat(t), ["area", "branch", "grade"]), "branch", "1")


@query(f"{WITH} SELECT course_id, course, grade, hours FROM course WHERE course_id = 17")
def p04_by_id(t):
    return B.by_id(course(t), "course_id", 17, ["course_id", "course", "grade", "hours"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def p05_children(t):
    return B.children(t.orders, "o_custkey", 7, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 1 AND p_size % 5 <> 0")
def p06_required_fields(t):
    name = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return t.part.filter(B.present(name, F.when(F.col("p_size") % 5 != 0, F.col("p_type")))).select("p_partkey")


@query("SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') AS code FROM part WHERE p_size % 2 = 0")
def p07_with_code(t):
    coded = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lpad(F.col("p_size").cast("string"), 2, "0")).otherwise("").alias("code"))
    return coded.filter(B.present(F.col("code")))


@query("SELECT p_partkey, p_size % 2 = 0 AS editable FROM part")
def p08_editable(t):
    return t.part.select("p_partkey", B.editable(F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  ")).alias("editable"))


@query(f"{FLAT} SELECT course_id, area, branch, course, grade, hours, '-' AS branch_link FROM flat WHERE branch = '-' UNION ALL SELECT course_id, area, branch, course, grade, hours, 'http://files/' || replace(branch, ' ', '%20') FROM flat WHERE branch <> '-'")
def p09_browsing_rows(t):
    link = F.when(F.col("branch") == "-", "-").otherwise(T.encoded_path(F.col("branch"), "http://files/"))
    return flat(t).withColumn("branch_link", link)


@query("SELECT page_id, string_split(url, '/')[-1] AS file FROM pages WHERE contains(lower(string_split(url, '/')[-1]), 'html')")
def p10_by_file_name(t):
    return B.by_file_name(t.pages, "url", " HTML").select("page_id", B.file_of(F.col("url")).alias("file"))


@query(f"{WITH} SELECT DISTINCT area_id, c.course_id, course, grade FROM course c JOIN bridge b ON c.course_id = b.course_id JOIN branch n ON b.branch_id = n.branch_id")
def j01_courses_of_areas(t):
    return H.courses_of_areas(course(t), bridge(t), branch(t)).orderBy("area_id", "course_id")


@query(f"{WITH}, one AS (SELECT course_id, min(branch_id) AS branch_id FROM bridge GROUP BY 1) SELECT o.branch_id, c.*, branch FROM course c LEFT JOIN one o ON c.course_id = o.course_id LEFT JOIN branch n ON o.branch_id = n.branch_id")
def j03_one_branch(t):
    return H.courses_with_one_branch(course(t), bridge(t), branch(t))


def units(t):
    return t.customer.select(F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("unit"), F.col("c_nationkey").alias("unit_seq"))


def topics(t):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_orderkey").alias("topic_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("topic"), F.row_number().over(order).alias("topic_seq"))


def outcomes(t):
    return t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("outcome_id"), F.col("l_orderkey").alias("topic_id"), F.col("l_returnflag").alias("outcome"), F.col("l_linenumber").alias("outcome_seq"))


J4_SQL = "SELECT c_custkey AS unit_id, count(DISTINCT o_orderkey) AS n_topics, count(DISTINCT l_orderkey * 1000 + l_linenumber) AS n_outcomes FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey"


@query(J4_SQL)
def j04_unit_counts(t):
    return H.unit_counts(units(t), topics(t), outcomes(t)).orderBy("unit_id")


@query("SELECT r_regionkey AS area_id, r_name AS area, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS branches FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def j18_options_tree(t):
    return H.options_tree(area(t), branch(t)).withColumn("branches", F.array_join(F.col("branches.branch"), ","))


@query("""WITH o AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS o FROM lineitem GROUP BY 1),
t AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderpriority, coalesce(o, '') AS o FROM orders LEFT JOIN o ON o_orderkey = l_orderkey)
SELECT c_custkey AS unit_id, coalesce(string_agg(seq || ' ' || o_orderpriority || ' [' || o || ']', '; ' ORDER BY seq), '') AS tree FROM customer LEFT JOIN t ON c_custkey = o_custkey GROUP BY 1""")
def a13_nested_tree(t):
    leaf = lambda o: F.concat(o["outcome_seq"].cast("string"), F.lit(":"), o["outcome"])
    node = lambda x: F.concat(x["topic_seq"].cast("string"), F.lit(" "), x["topic"], F.lit(" ["), F.array_join(F.transform(x["outcomes"], leaf), " "), F.lit("]"))
    return H.nested(units(t), topics(t), outcomes(t)).select("unit_id", F.array_join(F.transform("topics", node), "; ").alias("tree"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c_custkey AS unit_id, CAST(count(o_orderkey) AS INT) AS n_topics, CAST(coalesce(sum(n), 0) AS INT) AS n_outcomes FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def a14_tree_counts(t):
    return H.nested_counts(H.nested(units(t), topics(t), outcomes(t)))


@query("SELECT l_suppkey AS area_id, l_partkey AS url, min(l_shipdate) AS name, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS grades FROM lineitem GROUP BY ALL")
def a12_catalogue(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("area_id"), F.col("l_partkey").alias("url"), F.col("l_shipdate").alias("name"), F.col("l_linenumber").alias("grade"))
    return H.catalogue(rows).withColumn("grades", F.array_join(F.col("grades").cast("array<string>"), ","))


@query("""WITH p AS (SELECT o_orderkey AS parent_id, o_custkey AS seq FROM orders), first AS (SELECT l_partkey AS item_id, arg_min(parent_id, {'s': seq, 'p': parent_id}) AS parent_id FROM lineitem JOIN p ON l_orderkey = parent_id GROUP BY 1)
SELECT 1 AS section, parent_id, item_id FROM first UNION ALL SELECT 2, parent_id, NULL FROM p WHERE parent_id NOT IN (SELECT parent_id FROM first)
UNION ALL SELECT 2, NULL, p_partkey FROM part WHERE p_partkey NOT IN (SELECT item_id FROM first)""")
def j17_linked_groups(t):
    parents = t.orders.select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("parent_seq"))
    links = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), F.col("l_partkey").alias("item_id"))
    return H.linked_groups(parents, links, t.part.select(F.col("p_partkey").alias("item_id")))


@query("SELECT p_partkey AS unit_id, CAST(i AS INT) AS topic_seq, 'Konu ' || i AS topic, 'Kazanım ' || i AS outcome FROM (SELECT p_partkey, unnest(range(1, p_size % 9 + 1)) AS i FROM part)")
def m11_default_tree(t):
    return H.default_tree(t.part.select(F.col("p_partkey").alias("unit_id"), (F.col("p_size") % 9).alias("n")))


@query("""WITH held AS (SELECT l_orderkey AS parent_id, CAST(l_linenumber AS INT) AS seq, l_returnflag AS name FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT * FROM held UNION ALL SELECT o_orderkey, CAST(coalesce(n, 0) + 1 AS INT), o_orderpriority FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def x17_append_children(t):
    held = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("name"))
    return H.appended(held, t.orders.select(F.col("o_orderkey").alias("parent_id"), F.lit(1).alias("pos"), F.col("o_orderpriority").alias("name")))


@query(f"{FLAT} SELECT row_number() OVER (ORDER BY area NULLS FIRST, branch NULLS FIRST, course NULLS FIRST, grade NULLS FIRST, course_id) AS place, * FROM flat")
def o01_four_key_sort(t):
    return B.with_places(flat(t))


@query("SELECT p_partkey, p_retailprice, p_name FROM part")
def o02_sorted(t):
    return B.sorted_rows(t.part, "p_retailprice", True, "p_partkey").select("p_partkey", "p_retailprice", "p_name")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) - 10 AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o03_preview(t):
    return B.preview(t.orders, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_totalprice", "more")


@query()
def o04_sample(t):
    return B.sample(t.customer, 50, "c_custkey").select("c_custkey", "c_name")


@query("SELECT DISTINCT p_type, p_brand FROM part")
def o05_distinct(t):
    return B.distinct_of(t.part, ["p_type", "p_brand"])


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS x, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS y FROM part)
SELECT p_partkey, len(list_intersect(x, y)) AS common, len(list_distinct(x || y)) AS any_of, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM w""")
def o06_token_sets(t):
    common, either, dice = B.token_sets(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"))
    return t.part.select("p_partkey", common.cast("long").alias("common"), either.cast("long").alias("any_of"), F.round(dice, 6).alias("dice"))


@query("SELECT 'part' AS feed, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'page', page_id, url FROM pages")
def o07_union_sources(t):
    pick = lambda df, i, n: df.select(F.col(i).alias("id"), F.col(n).alias("name"))
    return B.union_sources(part=pick(t.part, "p_partkey", "p_name"), customer=pick(t.customer, "c_custkey", "c_name"), supplier=pick(t.supplier, "s_suppkey", "s_name"), page=pick(t.pages, "page_id", "url"))
