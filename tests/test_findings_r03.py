"""What the third review found: each would have failed, or been too slow to end, before."""

from __future__ import annotations

import os
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dizin import scratch
from dizin.operators import extract as X
from dizin.plans import QUERIES, SQL
from dizin.sources import html as H
from dizin.streaming import streams as S


def test_first_link_with_keys_beyond_a_hundred_thousand(spark, tmp_path):
    """F2. Line 1 comes before line 2, whatever the keys of their parts."""
    rows = [(1, 1, 250_000), (1, 2, 7), (2, 1, 150_000), (2, 2, 50_000), (3, 1, 9), (3, 1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["a10_first_link"](spark, str(tmp_path)).collect()}
    assert got == {(1, 250_000), (2, 150_000), (3, 4)}
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert set(db.sql(SQL["a10_first_link"]).fetchall()) == got


def test_long_tables_without_numbers_take_time_in_proportion(spark):
    """F1, F3-F8. A text of words, headings without an end and numbers in no row is read as fast as any; a count beyond an int is no error."""
    words = "Vergi ve Belediye " * 20_000
    texts = ["DERSİN ADI: x TABLOSU " + words, "TABLOSU " + "ÖĞRENME (% " * 30_000, "TABLOSU " + "KAZANIM ORAN " * 30_000, "TABLOSU " + "7" * 100_000 + "x"]
    began = time.process_time()
    assert [X._job(t)["n_units"] for t in texts] == [0, 0, 0, 0]
    assert time.process_time() - began < 3
    df = spark.createDataFrame([("TABLOSU " + " " * 50 + " Fatura 99999999999 5 Vergi 3 4",), (None,)], "text string")
    assert [tuple(r) for r in X.units(df, []).collect()] == [(1, "Fatura", None, "5", "-"), (2, "Vergi", 3, "4", "-")]


def test_topics_of_areas_in_one_pass(spark):
    """F7. What the two steps give: the area of each title, then its topics."""
    text, titles = "BİR 1. a 2. b İKİ 1. c BİR 3. d 1. e ", [(7, "Bir", 2), (8, "İki", 1), (9, "Üç", 1), (None, "İki", 3)]
    df = spark.createDataFrame([(1, text, titles), (2, None, titles), (3, text, None)], "k int, t string, u array<struct<seq:int,title:string,n:int>>")
    steps = X.work_areas(df, ["k"], "t", "u").select("k", "seq", F.explode(X.topics(F.col("work_area"), F.col("n"))).alias("x")).select("k", "seq", "x.*")
    got = [tuple(r) for r in X.area_topics(df, ["k"], "t", "u").collect()]
    assert sorted(got, key=str) == sorted(map(tuple, steps.collect()), key=str) and (1, 7, 1, "a") in got


def test_cards_and_grids_come_from_one_reading(spark):
    """F4, F18. The plan reads a page in one function, and no page twice."""
    page = "<div class='card'><a href=''>x</a><a href='/u'><b> </b><b>T&amp;t</b></a><ul><li>Alan<li>9. Sınıf<li>01.02.2020</ul></div><table><tr><th>a<tr><td>n<td><a>k</a><a href=/l>l</a><tr><td>one</table>"
    df = spark.createDataFrame([(1, page), (2, None)], "k int, html string")
    grid, cards = H.grid(df, "html", ["k"]), H.cards(df, "html", ["k"])
    assert [tuple(r) for r in grid.collect()] == [(1, 1, "n", "/l", None)]
    assert [tuple(r) for r in cards.collect()] == [(1, 0, "/u", "T&t", 9, "01.02.2020", "Alan", "2020")]
    for out in (grid, cards):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


class _Messages:
    """State, timers and clock of one run, which count the messages to them."""

    def __init__(self):
        self.sent, self.kept, self.timers, self.now = 0, {}, set(), 0

    def _variable(self, name, empty):
        def put(value):
            self.sent, self.kept[name] = self.sent + 1, value

        def get():
            self.sent += 1
            return self.kept.get(name, empty)

        made = type("Variable", (), {})()
        made.get, made.update, made.put = get, put, put
        made.exists, made.clear, made.appendValue = lambda: get() != empty, lambda: put(empty), lambda x: put([*self.kept.get(name, []), x])
        return made

    def getListState(self, name, schema):
        return self._variable(name, [])

    def getValueState(self, name, schema):
        return self._variable(name, None)

    def registerTimer(self, ms):
        self.sent += 1
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.now

    def fire(self, runs, now):
        self.now, out = now, []
        for ms in sorted(x for x in self.timers if x <= now):
            out += [tuple(r) for df in runs.handleExpiredTimer(("a",), self, None) for r in df.itertuples(index=False)]
            self.timers.discard(ms)
        return out


def test_a_run_takes_few_messages_whatever_its_events():
    """F9. A thousand events that come together took a message and a timer each, and a whole judgement at each timer."""
    rows = lambda *ms: [pd.DataFrame({"ts": pd.to_datetime(list(ms), unit="ms"), "seq": range(len(ms)), "kind": "step", "progress": 0.5})]
    held, runs = _Messages(), S._Runs("done", "error", 10)
    runs.init(held)
    list(runs.handleInputRows(("a",), rows(*range(1000, 2000)), held))
    assert held.fire(runs, 1500) == [] and held.fire(runs, 1999) == []
    # One that comes late, though not too late, is judged before those that wait; silence counts from the last of all.
    list(runs.handleInputRows(("a",), rows(6000), held))
    list(runs.handleInputRows(("a",), rows(3000), held))
    assert held.fire(runs, 3500) == [] and held.fire(runs, 16_000) == []
    assert held.fire(runs, 16_001) == [("a", "timeout", 1002, 0.5, pd.Timestamp(6, unit="s"))]
    list(runs.handleInputRows(("a",), rows(17_000), held))
    assert held.fire(runs, 99_000) == [] and held.sent < 60


@pytest.mark.parametrize("name", ["m08_replace_children", "x06_joined_lines", "x23_with_branches", "j17_linked_groups"])
def test_tasks_grow_with_the_files(spark, monkeypatch, name):
    """F10, F14, F17, F19. Twice the files are twice the tasks, not twice the rows of a task, and the rows are those of the SQL."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(scratch, "TASK_BYTES", 4096)
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert scratch.tasks_of(lineitem.select(F.explode(F.array("l_orderkey")))) == -(-os.path.getsize(f"{folder}/lineitem.parquet") // 4096)
    assert scratch.tasks_of(spark.range(9)) == spark.sparkContext.defaultParallelism
    out = QUERIES[name](spark, folder)
    assert out.rdd.getNumPartitions() >= scratch.tasks_of(lineitem) > 8
    with duckdb.connect() as db:
        for table in ("lineitem", "orders", "part"):
            db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
        assert sorted(map(str, db.execute(SQL[name]).fetchall())) == sorted(str(tuple(r)) for r in out.collect())


def test_timetables_are_made_and_read_in_one_pass(spark):
    """F20. Lines were read and numbered four times; rules on texts were asked in nested lambdas, with two more groupings."""
    plan = QUERIES["x22_courses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Window [") == 1
