"""Counts and statistics of tables, files and batches; order-dependent numbering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame | None], not_null: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A1. One row: the rows of each table (0 for a missing one) and the values of the columns named."""
    out = None
    if all(df is None for df in tables.values()):
        out = SparkSession.active().range(1).select()
    for name, df in tables.items():
        if df is None:
            continue
        one = df.agg(F.count("*").alias(f"{name}_count"), *[F.count(c).alias(f"{name}_{c}") for c in (not_null or {}).get(name, ())])
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    for name, df in tables.items():
        if df is None:
            out = out.withColumn(f"{name}_count", F.lit(0).cast("long"))
    return out


def summary_line(stats: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """A16. The statistics record with one line of text, ``label: value`` joined by bars."""
    return stats.withColumn("message", F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in parts.items()]))


def last_per_key(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """A2. The value written last for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def grade_maps(df: DataFrame, area: str, grade: str, url: str, order: str) -> DataFrame:
    """A2. ``(area, urls)``: a map of grade to the URL written last."""
    last = last_per_key(df, [area, grade], url, order)
    return last.groupBy(area).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(grade, url)))).alias("urls"))


def nested_lists(df: DataFrame, area: str, grade: str, record: Sequence[str]) -> DataFrame:
    """A3. ``(area, grades, total)``: per grade its records in order; areas without records do not stand."""
    by_grade = df.groupBy(area, grade).agg(F.array_sort(F.collect_list(F.struct(*record))).alias("records"))
    return by_grade.groupBy(area).agg(F.array_sort(F.collect_list(F.struct(grade, "records"))).alias("grades"), F.sum(F.size("records")).alias("total"))


def counts_by_kind(df: DataFrame, place: str, kinds: Mapping[str, Column]) -> DataFrame:
    """A5. Per place, and in all (null place), how many rows are of each kind."""
    return df.rollup(place).agg(*[F.count_if(test).alias(name) for name, test in kinds.items()], F.count("*").alias("total"))


def duplicate_names(files: DataFrame, hidden: str = "00_") -> DataFrame:
    """A6. Names that stand in several folders, with these, from ``(folder, name)``; hidden folders do not count."""
    folders = files.filter(~F.col("folder").startswith(hidden)).groupBy("name").agg(F.sort_array(F.collect_set("folder")).alias("folders"))
    return folders.filter(F.size("folders") > 1)


def folder_counts(files: DataFrame) -> DataFrame:
    """A7. Per folder its files, and those whose name an earlier folder (by name) has."""
    first = files.groupBy("name").agg(F.min("folder").alias("first"))
    return files.join(first, "name").groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("first") < F.col("folder")).alias("again"))


def batch_outcome(df: DataFrame, batch: str, ok: Column) -> DataFrame:
    """A8. Per batch its rows, successes and errors; a batch succeeds if any row does."""
    return df.groupBy(batch).agg(F.count("*").alias("processed"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("error"), F.max(ok).alias("any_success"))


def success_rate(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """A9. Percentage of successes per group and in all (null group), one decimal."""
    return df.rollup(group).agg(F.round(100 * F.avg(ok.cast("int")), 1).alias("rate"))


def first_link(df: DataFrame, key: str, link: str, pos: str) -> DataFrame:
    """A10."""
    return df.groupBy(key).agg(F.min_by(link, pos).alias(link))


def joined_links(df: DataFrame, key: str, link: str, pos: str) -> DataFrame:
    """A11. All links of a key in order, by comma; empty ones skipped."""
    kept = df.filter(F.col(link).isNotNull() & (F.col(link) != ""))
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(pos, link)))[link], ", ").alias("links"))


def latest_version(migrations: DataFrame) -> DataFrame:
    """A15."""
    return migrations.agg(F.max("version").alias("version"))


def coverage(df: DataFrame, area: str, sources: Mapping[str, Column]) -> DataFrame:
    """A17. Per area and in all, how many rows each source covers."""
    return df.rollup(area).agg(*[F.count_if(c).alias(name) for name, c in sources.items()])


def best_link(df: DataFrame, area: str, score: str, pos: str) -> DataFrame:
    """W1. The link of highest score of each area, the first of equals."""
    order = Window.partitionBy(area).orderBy(F.desc(score), pos)
    return df.filter(F.col(score).isNotNull()).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """W2. The first row of each key, kept whole, without sorting groups."""
    whole = F.min_by(F.struct(*df.columns), order)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(whole.alias("x")).select("x.*")


def province_progress(df: DataFrame) -> DataFrame:
    """W5. Of ``(province_no, area, branch)``, in the order of provinces: areas first seen there, branches new to them, and the running total.

    Branches count with the province where their (area, branch) is first seen. One row per province
    is ordered in the end.
    """
    areas = df.groupBy("area").agg(F.min("province_no").alias("province_no")).groupBy("province_no").agg(F.count("*").alias("new_areas"))
    branches = df.groupBy("area", "branch").agg(F.min("province_no").alias("province_no")).groupBy("province_no").agg(F.count("*").alias("new_branches"))
    every = df.select("province_no").distinct().join(areas, "province_no", "left").join(branches, "province_no", "left").na.fill(0)
    return every.withColumn("total", F.sum("new_branches").over(Window.orderBy("province_no").rowsBetween(Window.unboundedPreceding, 0)))


def progress(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """W7. Rows of each group numbered in order (``i`` of ``n``), with the share done."""
    n = df.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    return n.withColumn("done", F.round(F.col("i") / F.col("n"), 6))


def milestones(df: DataFrame, group: str, order: Sequence[str], every: int) -> DataFrame:
    """W6. ``progress`` of the rows, and whether they are a quarter's end or each k-th."""
    n = progress(df, group, order)
    quarter = F.lit(False)
    for q in (1, 2, 3, 4):
        quarter = quarter | (F.col("i") == F.ceil(F.col("n") * q / 4))
    return n.withColumn("milestone", quarter).withColumn("kth", F.col("i") % every == 0)


def renumbered(df: DataFrame, parent: str, seq: str) -> DataFrame:
    """W4. Sequence numbers from 1 without gaps, in the order of the old ones."""
    return df.withColumn("new_seq", F.row_number().over(Window.partitionBy(parent).orderBy(seq)))
