"""Order rules, idempotence, streams, and that the library stands without the optional package."""

import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from dizin.operators import browse as B
from dizin.operators import match as M
from dizin.operators import stats as A
from dizin.operators import upsert as U
from dizin.streaming import streams as S
from dizin.sources.files import json_groups, write_json_groups
from dizin.tables import KeyedTable


def fold(feed):
    """The row-by-row rule, plainly."""
    held = {}
    for seq, name, grade, hours, link in feed:
        if not name.strip() or not grade:
            continue
        if name not in held or grade < held[name][0]:
            held[name] = [grade, hours, seq, {link}]
        else:
            held[name][1] = max(held[name][1], hours)
            held[name][3].add(link)
    return {k: (g, h, s, frozenset(x)) for k, (g, h, s, x) in held.items()}


def test_lowest_grade_in_any_order(spark):
    rng = random.Random(1)
    feed = [(i, rng.choice(["a", "b", "c", " "]), rng.choice([9, 10, 11, 12, None]), rng.randint(0, 9), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rng.sample(feed, len(feed)), "seq int, name string, grade int, hours int, link string")
    courses, links = U.lowest_grade(df)
    each = {r["name"]: frozenset(r["l"]) for r in links.groupBy("name").agg(F.collect_set("link").alias("l")).collect()}
    assert {r["name"]: (r["grade"], r["hours"], r["seq"], each[r["name"]]) for r in courses.collect()} == fold(feed)


def test_upserts_twice(spark):
    dim = spark.createDataFrame([(1, "a")], "id long, name string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), (" ",)], "name string")
    once = U.get_or_create(dim, new, ["name"])
    twice = U.get_or_create(once, new, ["name"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 2
    areas = spark.createDataFrame([("Adalet", "01", '{"9":"u"}', None)], "name string, code string, cop string, dbf string")
    change = spark.createDataFrame([("ADALET", None, "/cop10/y", '{"9":"d"}'), (None, None, None, None)], "name string, code string, cop string, dbf string")
    one = U.upsert_areas(areas, change)
    assert sorted(map(str, U.upsert_areas(one, change).collect())) == sorted(map(str, one.collect()))
    assert {r["name"] for r in one.collect()} == {"Adalet", "Belirtilmemiş"}


def test_containment_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    left, right = words[:30], words[30:]
    got = M.holding_pairs(spark.createDataFrame([(w,) for w in left], "name string"), spark.createDataFrame([(w,) for w in right], "name string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in left for b in right if b in a}


def test_shared_words_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    names = [rng.choice(["", " "]) + " ".join(rng.choice(["Temel", "temel", "Dal", "ağ", "iş", "Ses", "x"]) for _ in range(rng.randint(0, 5))) for _ in range(70)]
    left, right = names[:35], names[30:]
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right)]
    words = lambda n: set(n.lower().split())
    want = {}
    for a in left:
        good = [(0 if a.lower() == b.lower() else 1, b) for b in right if words(a) & words(b) and (a.lower() == b.lower() or len(words(a) & words(b)) >= min(2, 0.7 * len(words(a))))]
        if good:
            want[a] = min(good)
    assert {r["name"]: (r["tier"], r["match"]) for r in M.keyword_overlap(*frames).collect()} == want
    key = lambda n: " ".join(n.split()).translate(str.maketrans("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")).upper()
    pairs = set()
    for a in left:
        same = {(a, b) for b in right if key(a) == key(b)}
        pairs |= same or {(a, b) for b in right if len(words(a)) >= 2 and len(words(a) & words(b)) >= min(2, 0.6 * len(words(a)))}
    assert {tuple(r) for r in M.partial_matches(*frames).collect()} == pairs
    best = {}
    for a in {n.lower().strip() for n in left}:
        for b in {n.lower().strip() for n in right}:
            dice = 200 * len(words(a) & words(b)) / ((len(words(a)) + len(words(b))) or 1)
            score = 100 if a == b and a else 90 if a and b and (a in b or b in a) else dice if dice > 70 else 0
            if score and (a not in best or (-score, b) < best[a]):
                best[a] = (-score, b)
    assert {r["name"]: (-r["score"], r["match"]) for r in M.similarity(*frames).collect()} == best


def test_fill_by_pattern_is_that_of_all_pairs(spark):
    units = [(1, 7, "Temel Ağlar", 0), (2, 7, "temel", None), (3, 7, "Ses", 5), (4, 8, "Temel", 0), (5, None, "Temel", 0), (6, 9, "x", 0), (7, 9, None, 0)]
    incoming = [(7, "TEMEL", 3), (7, "ağ", 4), (7, "Ağ", 9), (8, "temel ağlar", 2), (9, "", 6), (9, "y", 1), (None, "Temel", 8), (8, None, 9)]
    got = M.fill_by_pattern(spark.createDataFrame(units, "unit_id int, course_id int, unit string, hours int"), spark.createDataFrame(incoming, "course_id int, part string, new_hours int"))
    assert {r["unit_id"]: r["hours"] for r in got.collect()} == {1: 9, 2: 3, 3: 5, 4: 0, 5: 0, 6: 6, 7: 0}


def test_streamed_ingest_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, f"v{i}") for i in range(100)]
    source = str(tmp_path / "in")
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, "seq int, k int, v string").coalesce(1).write.mode("append").parquet(source)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("seq int, k int, v string").option("maxFilesPerTrigger", 1).parquet(source)
    S.ingest(stream, "k", out, str(tmp_path / "cp"), 4).awaitTermination()
    first = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    spark.createDataFrame([(200, 3, "new"), (-1, 4, "late")], "seq int, k int, v string").coalesce(1).write.mode("append").parquet(source)
    S.ingest(stream, "k", out, str(tmp_path / "cp"), 4).awaitTermination()
    assert all(p.stat().st_mtime_ns == t for p, t in first.items()) and first
    want = S.latest(spark.createDataFrame([*rows, (200, 3, "new")], "seq int, k int, v string"), "k", "seq")
    assert sorted(map(tuple, S.ingested(spark, out, "k", "seq", buckets=4).collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in S.ingested(spark, out, "k", "seq", 3, 4).collect()] == [(200, 3, "new")]
    # The checkpoint is lost, and the source has forgotten its beginning and comes in other batches: nothing that was taken is lost.
    kept = sorted(Path(source).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    kept[0].unlink()
    spark.createDataFrame([(300, 5, "newest")], "seq int, k int, v string").coalesce(1).write.mode("append").parquet(source)
    again = spark.readStream.schema("seq int, k int, v string").option("maxFilesPerTrigger", 2).parquet(source)
    S.ingest(again, "k", out, str(tmp_path / "cp2"), 4).awaitTermination()
    want = S.latest(spark.createDataFrame([*rows, (200, 3, "new"), (300, 5, "newest")], "seq int, k int, v string"), "k", "seq")
    assert sorted(map(tuple, S.ingested(spark, out, "k", "seq", buckets=4).collect())) == sorted(map(tuple, want.collect()))
    # A batch that is replayed after its commit is not taken twice, and compaction leaves one part for each bucket and the same rows.
    held = KeyedTable(spark, out, "k", 4)
    source_id, last = next(iter(held.manifest()["sources"].items()))
    version = held.manifest()["version"]
    assert held.append(spark.createDataFrame([(999, 1, "replayed")], "seq int, k int, v string"), source_id, last) == version
    before = held.read().count()
    buckets = held.compact("seq")
    assert buckets and all(sum(b in bs for bs in held.manifest()["parts"].values()) == 1 for b in buckets)
    assert held.read().count() == 7 < before and sorted(map(tuple, held.read(seq="seq").collect())) == sorted(map(tuple, want.collect()))
    assert held.vacuum() and held.versions() == [held.manifest()["version"]] and held.compact("seq") == []
    S.ingest(again, "k", out, str(tmp_path / "cp2"), 4).awaitTermination()
    assert sorted(map(tuple, held.read(seq="seq").collect())) == sorted(map(tuple, want.collect()))


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    held = KeyedTable(spark, str(tmp_path / "t"), "id", 16)
    held.append(spark.range(1000).select(F.col("id").cast("int").alias("id"), F.lit(0).alias("hours")))
    change = spark.createDataFrame([(7, 3)], "id int, new int")
    apply = lambda rows, new: U.bulk_update(rows, new, "id", "hours")
    before = held.manifest()
    assert len(held.update(change, apply)) == 1
    after = held.manifest()
    old = next(iter(before["parts"]))
    assert len(after["parts"]) == 2 and len(after["parts"][old]) == 15
    rows = sorted(map(tuple, held.read().collect()))
    assert [r for r in rows if r[1]] == [(7, 3)] and len(rows) == 1000
    held.update(change, apply)
    assert sorted(map(tuple, held.read().collect())) == rows and [tuple(r) for r in held.read(7).collect()] == [(7, 3)]
    # Another writer changes the same bucket meanwhile: the update is begun anew from what that left.
    once = []

    def raced(rows, new):
        if not once:
            once.append(held.update(spark.createDataFrame([(7, 50)], "id int, new int"), apply))
        return U.raise_only(rows, new, "id", "hours")

    held.update(spark.createDataFrame([(7, 40)], "id int, new int"), raced)
    assert [tuple(r) for r in held.read(7).collect()] == [(7, 50)]
    assert held.update(change.filter("id < 0"), apply) == [] and held.update(spark.createDataFrame([(None, 1)], "id int, new int"), apply) == []


RUNS = "run string, ts timestamp, seq long, kind string, progress double"


def test_runs_of_a_stream_end_as_those_of_a_batch(spark, tmp_path):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for run in range(40):
        at = start + timedelta(minutes=rng.randint(0, 60))
        for seq in range(rng.randint(1, 14)):
            rows.append((f"r{run}", at, run * 100 + seq, rng.choice(["info"] * 6 + ["done", "error"]), rng.choice([None, seq / 10])))
            at += timedelta(seconds=rng.choice([0, 1, 60, 300, 1500, 1800, 1801, 2500]))
    # A last event far on moves the watermark past all others.
    last = max(r[1] for r in rows) + timedelta(days=1)
    source = tmp_path / "in"
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 500)))  # out of order within the ten minutes that are waited for
    for part in (late[:100], late[100:200], late[200:], [("z", last, 0, "info", None)], [("z", last + timedelta(seconds=1), 1, "info", None)]):
        spark.createDataFrame(part, RUNS).coalesce(1).write.mode("append").parquet(str(source))
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = session.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = S.run_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["run", "state", "events", "progress", "ended"]
    got = sorted(map(tuple, session.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    want = sorted(map(tuple, S.ended_runs(spark.createDataFrame(rows, RUNS), now=F.lit(last)).select(columns).collect()))
    assert got == want and {r[1] for r in want} == {"done", "error", "timeout"} and len(want) == 40
    # The same by hand.
    plain = {}
    for run, ts, _, kind, progress in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = plain.setdefault(run, [None, 0, None, None])
        if held[0] is None and held[3] is not None and ts - held[3] > timedelta(seconds=1800):
            held[0] = "timeout"
        if held[0] is None:
            held[1:] = [held[1] + 1, progress, ts]
            held[0] = kind if kind in ("done", "error") else None
    assert want == sorted((run, state or "timeout", n, p, ts) for run, (state, n, p, ts) in plain.items())


def test_sample(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(500)] + [(None, "x")], "id int, name string")
    one, two = ([r["id"] for r in B.sample(x, 60, "id").collect()] for x in (df, df.repartition(7)))
    by_hash = df.withColumn("h", F.xxhash64(F.lit(42), "id")).collect()
    assert one == two == [r["id"] for r in sorted(by_hash, key=lambda r: (r["h"], r["id"] or -1))[:60]] and len(set(one)) == 60
    assert B.sample(df, 1000, "id").count() == 501 and B.sample(df, 0, "id").count() == 0 and one != [r["id"] for r in B.sample(df, 60, "id", 7).collect()]


def test_places_follow_the_sort(spark):
    rows = [(i, *[None if i % 11 == j else "abc"[(i * 7 + j) % 3] for j in range(3)], i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "course_id int, area string, branch string, course string, grade int").repartition(5)
    placed = [r["course_id"] for r in B.with_places(df).orderBy("place").collect()]
    assert placed == [r["course_id"] for r in B.four_key_sort(df).collect()] and B.distinct_of(df, ["grade"]).count() == 4
    assert B.with_defaults(df, {"area": "-"}).filter("area = '-'").count() == df.filter("area is null").count()


def test_streamed_rollup(spark, tmp_path):
    rows = [("r1", i, "error" if i == 3 else "info", i / 10) for i in range(10)]
    spark.createDataFrame(rows, "run string, seq int, kind string, progress double").write.parquet(str(tmp_path / "in"))
    schema = "run string, seq int, kind string, progress double"
    q = S.progress_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("rollup").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT run, events, errors, progress, state FROM rollup").collect()] == [("r1", 10, 1, 0.9, "running")]


def test_library_stands_alone():
    code = "import sys; sys.modules['dizin.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_places_have_no_gaps_over_a_million_wide_rows(spark):
    df = spark.range(1_000_000).select(
        F.col("id").alias("course_id"), *[F.concat(F.lit(c), (F.hash("id", F.lit(i)) % 50).cast("string"), F.lit("x" * 30)).alias(c) for i, c in enumerate(("area", "branch", "course"))],
        (F.col("id") % 4).cast("int").alias("grade"), *[F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias(f"wide{i}") for i in range(2)],
    )
    got = B.with_places(df)
    told = got.agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(told) == (1_000_000, 1, 1_000_000, 1_000_000)
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in (*B.FOUR_KEYS, "course_id")])
    want = df.select("course_id", *B.FOUR_KEYS).select("course_id", F.row_number().over(order).alias("want"))
    assert got.select("course_id", "place").join(want, "course_id").filter("place <> want").count() == 0


def test_repeated_keys_in_updates(spark):
    stored = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 0)], "id int, hours int")
    values = spark.createDataFrame([(1, 7, 1), (1, 6, 2), (1, None, 3), (2, 0, 1), (2, 4, 2), (2, 3, 3), (3, 0, 1), (9, 9, 9), (None, 1, 1)], "id int, new int, at int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(U.bulk_update(stored, values, "id", "hours", "at")) == [(1, 6), (2, 3), (3, 0), (4, 0)]
    assert rows(U.fill_if_empty(stored, values, "id", "hours", "at")) == [(1, 5), (2, 4), (3, 0), (4, 0)]
    assert rows(U.raise_only(stored, values, "id", "hours")) == [(1, 7), (2, 4), (3, 0), (4, 0)]
    assert rows(U.overwrite_matches(stored, values, "id", "hours", "at").fillna(-1)) == [(1, -1, True), (2, 3, True), (3, 0, True), (4, 0, False)]
    maps = spark.createDataFrame([(1, {"9": "a"}), (2, None), (3, {"9": "x"})], "id int, urls map<string,string>")
    new = spark.createDataFrame([(1, "9", "b", 1), (1, "9", "c", 2), (1, "10", "d", 1), (2, "9", "e", 1), (1, None, "z", 1), (1, "9", None, 3)], "id int, grade string, url string, at int")
    assert {r["id"]: r["urls"] for r in U.merge_grade(maps, new, "id", "at").collect()} == {1: {"9": "c", "10": "d"}, 2: {"9": "e"}, 3: {"9": "x"}}


def test_catalogue_keeps_the_order_of_the_feed(spark):
    rows = [(2, "B", [("9. Sınıf", [("y", "u"), ("x", "u")])]), (1, "A", [("10. Sınıf", [("x,", "u"), ("y", "u")]), ("9. Sınıf", [("X", "u")])])]
    df = spark.createDataFrame(rows, "no int, area string, grades array<struct<g:string,rs:array<struct<title:string,url:string>>>>").withColumn("grades", F.map_from_entries("grades"))
    got = U.catalogue_courses(df, "no").orderBy("seq").collect()
    assert [(tuple(r["seq"]), r["name"], r["grade"], r["link"]) for r in got] == [((1, 0, 0), "X", 10, "A"), ((1, 0, 1), "Y", 10, "A"), ((1, 1, 0), "X", 9, "A"), ((2, 0, 0), "Y", 9, "B"), ((2, 0, 1), "X", 9, "B")]
    courses, links = U.lowest_grade(U.catalogue_courses(df, "no"))
    assert {r["name"]: (r["grade"], tuple(r["seq"])) for r in courses.collect()} == {"X": (9, (1, 1, 0)), "Y": (9, (2, 0, 0))}
    assert sorted(map(tuple, links.collect())) == [("X", "A"), ("X", "B"), ("Y", "B")]


def test_counts_of_missing_tables(spark):
    assert A.table_counts({"a": None, "b": None}).first().asDict() == {"a_count": 0, "b_count": 0}


def test_first_of_those_that_contain_or_are_contained(spark):
    rng = random.Random(9)
    name = lambda n: "".join(rng.choice("abçİ ") for _ in range(rng.randint(0, n)))
    left = [(name(7), rng.random() < 0.5) for _ in range(80)] + [("a", True), ("", False)]
    right = [(name(7), i, rng.random() < 0.5) for i in range(90)] + [("A", 900, False), ("b", 901, True)]
    l, r = spark.createDataFrame(left, "name string, protocol boolean"), spark.createDataFrame(right, "name string, id int, protocol boolean")  # noqa: E741
    low = {x: y for x, y in spark.createDataFrame([(x,) for x in {n for n, *_ in left + right}], "n string").select("n", F.lower("n")).collect()}

    def best(n, protocol):
        met = []
        for m, i, p in right:
            a, b = low[n], low[m]
            if a == b:
                met.append((0, m, i))
            elif a and b and (a in b or b in a):
                met.append((1 if p == protocol else 2, m, i))
        return [(n, protocol, min(met)[2], min(met)[0])] if met else []

    # Names compare by their bytes, as Spark's do; these letters keep that order.
    want = sorted({x for n, p in left for x in best(n, p)})
    assert sorted(map(tuple, M.class_containment(l, r).select("name", "protocol", "id", "tier").collect())) == want
    buckets = spark.createDataFrame([(n, i) for n, i, _ in right], "bucket string, pos int")
    up = {x: y for x, y in spark.createDataFrame([(x,) for x in low], "n string").select("n", F.upper("n")).collect()}

    def bucket(n):
        met = [(0 if n == m else 1, i, m) for m, i, _ in right if n == m or (n and m and (up[n] in up[m] or up[m] in up[n]))]
        return min(met)[2] if met else None

    assert sorted(map(tuple, M.bucket_fallback(l.select("name"), buckets).select("name", "bucket").collect())) == sorted({(n, bucket(n)) for n, _ in left})


def test_short_names_among_many(spark):
    rng = random.Random(10)
    letters = [chr(0x4E00 + i) for i in range(100)]
    long = sorted({"".join(rng.choice(letters) for _ in range(8)) for _ in range(100_000)})
    right = spark.createDataFrame([(n, i) for i, n in enumerate(long)], "name string, id int")
    got = {r["name"]: r["id"] for r in M.containment(spark.createDataFrame([(x,) for x in letters], "name string"), right).collect()}
    assert got == {x: next(i for i, n in enumerate(long) if x in n) for x in letters}


def test_groups_are_written_without_a_row_of_their_size(spark, tmp_path):
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 9, "ğ").otherwise("x y").alias("area"), (F.col("id") % 2).alias("grade"), F.col("id").alias("n"), F.lit("ş").alias("t"))
    out = str(tmp_path / "json")
    write_json_groups(df.repartition(5), out, ["area", "grade"], ["n", "t"], ["n"])
    got = json_groups(spark, out, ["area", "grade"])
    assert got.agg(F.max(F.length("json"))).first()[0] < 40 and got.count() == 300_000
    lines = [x for p in sorted((tmp_path / "json" / "area=ğ" / "grade=1").glob("*.txt")) for x in p.read_text("utf-8").split("\n") if x]
    assert lines == [f'{{"n":{i},"t":"ş"}}' for i in range(1, 300_000, 2) if i % 10 < 9]
