"""Timetables rendered from parts and suppliers, read back; streams' batch twins over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dizin.operators import timetable as X
from dizin.plans.registry import query
from dizin.scratch import scratch_path
from dizin.streaming import streams as S
from dizin.tables import KeyedTable


def lines(t):
    """Five lines per supplier: area, branch, filler, heading, body."""
    key = F.col("s_suppkey")
    name = F.translate(key.cast("string"), "0123456789", "BCFGHJKLMN")
    rows = F.array(
        F.concat(F.lit("METAL "), name, F.lit(" ALANI")), F.when(key % 3 == 0, F.concat(F.lit("(KAYNAK "), name, F.lit(" DALI)"))).when(key % 3 == 1, F.concat(F.lit("KAYNAK "), name, F.lit(" DALI.. 12"))).otherwise("boş"),
        F.lit("ara satır"), F.lit("Haftalık Ders ÇİZELGESİ".upper()), F.lit("KAPSAM DIŞI ALANI"),
    )
    return t.supplier.select(key.alias("doc"), F.lit(1).alias("page"), F.posexplode(rows).alias("line_no", "line"))


LETTERS = "translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'BCFGHJKLMN')"
CASED = f"upper({LETTERS}[1]) || replace(lower({LETTERS}[2:]), 'i', 'ı')"


@query(f"""SELECT s_suppkey AS doc, 'Metal ' || replace({CASED}, 'zzz', '') AS area, CASE WHEN s_suppkey % 3 = 0 THEN 'Kaynak ' || {CASED} ELSE '' END AS branches FROM supplier""")
def x20_labels(t):
    return X.labels(lines(t)).select("doc", "area", F.array_join("branches", ",").alias("branches"))


@query(f"SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 3 < 2 THEN 'Kaynak ' || {CASED} END AS branch FROM supplier")
def x21_branch_above(t):
    return X.branch_above(lines(t)).select("doc", "branch")


def cells(t):
    """One table per supplier: three header rows, a section row, a row per line (up to its parts), a total."""
    rows = t.lineitem.select("l_suppkey", "l_partkey", (1 + F.col("l_linenumber") % 9).cast("int").alias("h")).groupBy("l_suppkey", "l_partkey").agg(F.max("h").alias("h"))
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    rows = rows.withColumn("row_no", F.row_number().over(order) + 3).withColumn("end", F.when(F.lead("l_partkey").over(order).isNull(), F.col("row_no") + 1))
    name = F.concat(F.lit("DERS "), F.translate(F.col("l_partkey").cast("string"), "0123456789", "BCFGHJKLMN"), F.when(F.col("l_partkey") % 2 == 0, " (*)").otherwise(""))
    cell = lambda row, col, text: F.struct(F.lit(row).cast("int").alias("row_no") if isinstance(row, int) else row.cast("int").alias("row_no"), F.lit(col).alias("col_no"), text.alias("text"))
    # Hours of grade 9 stand in their own column or the next; of grade 10 in their own, for each third part.
    own = F.when(F.col("l_partkey") % 4 != 0, F.col("h").cast("string"))
    shifted = F.when(F.col("l_partkey") % 4 == 0, F.col("h").cast("string"))
    fixed = [(0, 0, "KATEGORİ"), (0, 1, "ORTAK DERSLER"), (1, 1, "DERSLER"), (0, 4, "9. SINIF"), (0, 9, "10."), (1, 9, "SINIF"), (2, 1, ""), (3, 0, "MESLEK DERSLERİ")]
    body = F.array(cell(F.col("row_no"), 1, name), cell(F.col("row_no"), 4, own), cell(F.col("row_no"), 5, shifted), cell(F.col("row_no"), 9, F.when(F.col("l_partkey") % 3 == 0, "7")))
    # With the first line come the headers, with the last the total and a line below it.
    heads = F.when(F.col("row_no") == 4, F.array(*[cell(r, c, F.lit(x)) for r, c, x in fixed])).otherwise(F.array())
    end = F.when(F.col("end").isNotNull(), F.array(cell(F.col("end"), 0, F.lit("TOPLAM")), cell(F.col("end") + 1, 1, F.lit("DIŞARIDA")), cell(F.col("end") + 1, 4, F.lit("3")))).otherwise(F.array())
    return rows.select(F.col("l_suppkey").alias("doc"), F.explode(F.concat(body, heads, end)).alias("c")).select("doc", F.lit(0).alias("table_no"), "c.*")


COURSES = """p AS (SELECT l_suppkey AS doc, l_partkey, CAST(max(1 + l_linenumber % 9) AS INT) AS h FROM lineitem GROUP BY ALL), r AS (SELECT doc, l_partkey, h, CAST(3 + row_number() OVER (PARTITION BY doc ORDER BY l_partkey) AS INT) AS row_no,
  'Ders ' || translate(CAST(l_partkey AS VARCHAR), '0123456789', 'BCFGHJKLMN')[1] || lower(translate(CAST(l_partkey AS VARCHAR), '0123456789', 'BCFGHJKLMN')[2:]) AS course FROM p),
c AS (SELECT doc, row_no, course, CAST(9 AS INT) AS grade, h AS hours FROM r UNION ALL SELECT doc, row_no, course, 10, 7 FROM r WHERE l_partkey % 3 = 0)"""


@query(f"WITH {COURSES} SELECT * FROM c")
def x22_courses(t):
    return X.courses(cells(t)).select("doc", "row_no", "course", "grade", "hours")


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber % 3 AS table_no, l_returnflag AS course, l_suppkey % 4 AS grade FROM lineitem), b AS (SELECT o_orderkey AS doc, u.i AS table_no, CASE WHEN u.i = o_custkey % 3 AND o_custkey % 2 = 0 THEN 'dal' || o_custkey END AS branch FROM orders, unnest([0, 1, 2]) AS u(i)),
f AS (SELECT doc, max(branch) AS fb FROM b GROUP BY 1) SELECT DISTINCT doc, coalesce(branch, fb, 'Genel') AS branch, course, grade, CAST(1 AS INT) AS hours FROM r LEFT JOIN b USING (doc, table_no) LEFT JOIN f USING (doc)""")
def x23_with_branches(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("table_no"), F.col("l_returnflag").alias("course"), (F.col("l_suppkey") % 4).alias("grade"), F.lit(1).alias("hours"))
    each = t.orders.select(F.col("o_orderkey").alias("doc"), "o_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("table_no"))
    branches = each.select("doc", "table_no", F.when((F.col("table_no") == F.col("o_custkey") % 3) & (F.col("o_custkey") % 2 == 0), F.concat(F.lit("dal"), F.col("o_custkey").cast("string"))).alias("branch"))
    return X.with_branches(rows, branches)


@query("SELECT DISTINCT l_suppkey AS doc, l_returnflag AS branch, l_linestatus AS course, l_linenumber AS grade, l_quantity AS hours FROM lineitem")
def x24_distinct_courses(t):
    return X.distinct_courses(t.lineitem.select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("branch"), F.col("l_linestatus").alias("course"), F.col("l_linenumber").alias("grade"), F.col("l_quantity").alias("hours")))


DEALT = """g AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS course FROM lineitem), b AS (SELECT doc, n, 1 + doc % 3 AS m FROM (SELECT doc, count(*) AS n FROM g GROUP BY 1)),
w AS (SELECT doc, i, n // m AS q, n % m AS r FROM b, unnest([0, 1, 2]) AS u(i) WHERE i < m)"""


def _deal(t, balanced):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    general = t.lineitem.select(F.col("l_orderkey").alias("doc"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("course"))
    branches = t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))).alias("branch_no")).withColumn("branch", F.concat(F.lit("b"), F.col("branch_no").cast("string")))
    return X.distributed(general, branches, balanced)


@query(f"WITH {DEALT} SELECT doc, 'b' || i AS branch, pos, course FROM w JOIN g USING (doc) WHERE pos >= i * q AND pos < i * q + q + CAST(i < r AS INT)")
def x25_distributed(t):
    return _deal(t, False).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {DEALT} SELECT doc, 'b' || i AS branch, pos, course FROM w JOIN g USING (doc) WHERE pos >= i * q + least(i, r) AND pos < i * q + least(i, r) + q + CAST(i < r AS INT)")
def x25_distributed_balanced(t):
    return _deal(t, True).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH r AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS b, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc, coalesce(b, 0) AS n_branches, coalesce(n, 0) AS n_courses, CASE WHEN o_orderstatus = 'F' THEN 'error' WHEN n > 0 THEN 'success' ELSE 'partial' END AS status FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def x26_summary(t):
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("area"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("course"), F.col("l_linenumber").alias("grade"))
    return X.summary(docs, rows).select("doc", "n_branches", "n_courses", "status")


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, arg_max(value, event_id) AS progress, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS state FROM events GROUP BY 1""")
def t01_progress_rollup(t):
    return S.progress_rollup(t.events, "user_id", "event_type", "event_id", "value", done="purchase").drop("last_kind")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id AS seq, event_type AS kind, value, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), max(ts) OVER ()) AS following FROM events),
m AS (SELECT *, CASE kind WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE CASE WHEN epoch_us(following) - epoch_us(ts) > 21600 * CAST(1000000 AS BIGINT) THEN 'timeout' END END AS ends FROM e),
f AS (SELECT run, min({'ts': ts, 'seq': seq, 'ends': ends}) AS e FROM m WHERE ends IS NOT NULL GROUP BY 1)
SELECT m.run, any_value(f.e.ends) AS state, count(*) AS events, arg_max(value, {'ts': m.ts, 'seq': m.seq}) AS progress, strftime(any_value(f.e.ts), '%Y-%m-%d %H:%M:%S') AS ended FROM m JOIN f ON m.run = f.run WHERE {'a': m.ts, 'b': m.seq} <= {'a': f.e.ts, 'b': f.e.seq} GROUP BY 1""")
def t01_ended_runs(t):
    return S.ended_runs(t.events, "user_id", "ts", "event_id", "event_type", "value", done="purchase", silent=6 * 3600).withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss"))


#: The watermark of the whole stream, in milliseconds: ten minutes before its last event.
WATERMARK = "(SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id AS seq, event_type AS kind, value, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), {WATERMARK} * 1000) AS following FROM events WHERE epoch_us(ts) <= {WATERMARK} * 1000),
m AS (SELECT *, CASE kind WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE CASE WHEN following - epoch_us(ts) > 21600 * CAST(1000000 AS BIGINT) THEN 'timeout' END END AS ends FROM e),
f AS (SELECT run, min({{'ts': ts, 'seq': seq, 'ends': ends}}) AS e FROM m WHERE ends IS NOT NULL GROUP BY 1)
SELECT m.run, any_value(f.e.ends) AS state, count(*) AS events, arg_max(value, {{'ts': m.ts, 'seq': m.seq}}) AS progress, strftime(any_value(f.e.ts), '%Y-%m-%d %H:%M:%S') AS ended FROM m JOIN f ON m.run = f.run WHERE {{'a': m.ts, 'b': m.seq}} <= {{'a': f.e.ts, 'b': f.e.seq}} GROUP BY 1""")
def t01_run_stream(t):
    """The events as a stream, each run told when it ends; events behind the watermark of the whole count."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = scratch_path(t.spark, "runs")
    stream = session.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")
    runs = S.run_stream(stream, "user_id", "ts", "event_id", "event_type", "value", done="purchase", silent=6 * 3600)
    runs.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(S.ENDED).parquet(f"{path}/out").withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def t01_windowed_counts(t):
    return S.windowed_counts(t.events, "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def t02_latest(t):
    return S.latest(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def t02_ingest(t):
    """The events as a stream of changes into a keyed table, read as the last of each key after compaction."""
    path, columns = scratch_path(t.spark, "ingested"), ["user_id", "event_id", "event_type", "value"]
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]").select(*columns)
    S.ingest(stream, "user_id", f"{path}/table", f"{path}/checkpoint", 16).awaitTermination()
    held = KeyedTable(t.spark, f"{path}/table", "user_id", 16)
    held.compact("event_id", 1)
    return held.read(seq="event_id")
