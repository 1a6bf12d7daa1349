"""What the fourth review found: each would have failed before."""

from __future__ import annotations

import math
import random

import duckdb
from pyspark.sql import functions as F

from dizin.functions import text as T
from dizin.plans import QUERIES, SQL


def bits(x):
    """Tells -0.0 from 0.0, and NaN as equal to itself."""
    return None if x is None else "nan" if math.isnan(x) else x.hex()


def test_progress_of_large_keys(spark, tmp_path):
    """F1. Halves at the ninth place of quotients, large quotients, sizes of 0 or below or unknown, as the SQL gives them."""
    rows = [(664_999, 5120), (4_007_887, 61), (10_006_509, 33), (1_000_000_000_026, 1311), (1, 1024), (3, 2_000_000_000), (5, 0), (0, 0), (-5, 0), (0, -7), (-664_999, 5120), (3, None), (None, 3)]
    rows += [(k * 1_000_000 + i, 1 + i % 97) for k in range(5) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    told = lambda found: sorted(((i, mb, bits(part)) for i, mb, part in found), key=str)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = told(db.sql(SQL["f22_megabytes_progress"]).fetchall())
    assert told(QUERIES["f22_megabytes_progress"](spark, str(tmp_path)).collect()) == expected


def test_rounded_is_the_rounding_of_sql(spark, tmp_path):
    """F1. Doubles of all sizes, halves, their neighbours and what is no number."""
    rng = random.Random(4)
    halves = [(k + 0.5) / 1e9 for k in range(200)] + [0.49999999999999994e-9, 2.0**52 / 1e9, 2.0**53 / 1e9, 1e300, math.inf, math.nan, 0.0, 1e-300]
    some = halves + [math.nextafter(x, d) for x in halves for d in (0.0, math.inf)] + [rng.random() * 10.0 ** rng.randrange(-12, 18) for _ in range(5000)]
    spark.createDataFrame([(k, x) for k, x in enumerate(some + [-x for x in some])], "k int, x double").coalesce(1).write.parquet(f"{tmp_path}/x")
    got = spark.read.parquet(f"{tmp_path}/x").orderBy("k").select(T.rounded(F.col("x"), 9)).collect()
    with duckdb.connect() as db:
        expected = db.sql(f"SELECT round(x, 9) FROM '{tmp_path}/x/*.parquet' ORDER BY k").fetchall()
    assert [bits(x) for (x,) in got] == [bits(x) for (x,) in expected]
