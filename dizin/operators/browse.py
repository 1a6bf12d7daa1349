"""Browsing: the flat course list, search, facets, sorting, sampling and sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dizin.scratch import placed


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """P1. Rows that hold the trimmed term, in any case, in one of the columns; a blank term keeps all."""
    wanted = term.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    return df.filter(hit)


def facet_filter(df: DataFrame, chosen: Mapping[str, Sequence]) -> DataFrame:
    """P2. Rows whose value, as text, is among those chosen of each column; nothing chosen, no filter."""
    for column, values in chosen.items():
        if values:
            df = df.filter(F.col(column).cast("string").isin([str(v) for v in values]))
    return df


def facet_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A4. ``(facet, value, rows, n_values)``: how often each non-empty value of each column stands, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    counts = df.select(pairs).select("x.*").filter("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("rows"))
    distinct = counts.groupBy("facet").agg(F.count("*").alias("n_values"))
    return counts.join(F.broadcast(distinct), "facet")  # one row per column named


def facet_options(counts: DataFrame, facet: str, term: str) -> DataFrame:
    """P3. Values of a facet that hold the term."""
    return counts.filter((F.col("facet") == facet) & F.lower("value").contains(term.strip().lower()))


def by_id(df: DataFrame, id_column: str, id_, columns: Sequence[str]) -> DataFrame:
    """P4."""
    return df.filter(F.col(id_column) == id_).select(*columns)


def children(df: DataFrame, parent_column: str, parent, order: Sequence[str]) -> DataFrame:
    """P5."""
    return df.filter(F.col(parent_column) == parent).orderBy(*order)


def present(*columns: Column) -> Column:
    """P6, P7. Whether all are there and not blank."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return ok


def editable(row_id: Column, form: Column) -> Column:
    """P8. Whether a row can be edited: it has an id and a form path that is not blank."""
    return present(row_id, form)


def file_of(path: Column) -> Column:
    """The file name of a path or URL."""
    return F.substring_index(path, "/", -1)


def by_file_name(df: DataFrame, path: str, term: str) -> DataFrame:
    """P10. Rows whose file name holds the term, in any case; a blank term keeps all."""
    return df.filter(F.lower(file_of(F.col(path))).contains(term.strip().lower()))


def flat_courses(course: DataFrame, bridge: DataFrame, branch: DataFrame, area: DataFrame) -> DataFrame:
    """J2, P9. Each course with its branches and areas, ``-`` and 0 where there is none.

    ``course(course_id, course, grade, hours)``, ``bridge(course_id, branch_id)``,
    ``branch(branch_id, branch, area_id)``, ``area(area_id, area)``.
    """
    joined = course.join(bridge, "course_id", "left").join(branch, "branch_id", "left").join(area, "area_id", "left")
    shown = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    return joined.select("course_id", shown("area"), shown("branch"), shown("course"), F.coalesce("grade", F.lit(0)).alias("grade"), F.coalesce("hours", F.lit(0)).alias("hours"))


#: The order of the flat course list.
FOUR_KEYS = ("area", "branch", "course", "grade")


def four_key_sort(df: DataFrame, tie: str = "course_id", keys: Sequence[str] = FOUR_KEYS) -> DataFrame:
    """O1. Rows by area, branch, course and grade, nulls first, then by ``tie``."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in (*keys, tie)])


def with_places(df: DataFrame, tie: str = "course_id", keys: Sequence[str] = FOUR_KEYS) -> DataFrame:
    """O1. Rows with ``place``, from 1, in the order of ``four_key_sort``.

    Rows are dealt to ranges and sorted within them, written once, and each range adds the rows of those before: no task sees all rows.
    """
    order = [F.col(c).asc_nulls_first() for c in (*keys, tie)]
    return placed(df.repartitionByRange(*order).sortWithinPartitions(*order), "place")


def distinct_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O5. The distinct values of the columns together."""
    return df.select(*columns).distinct()


def with_defaults(df: DataFrame, defaults: Mapping[str, str | int | float | bool]) -> DataFrame:
    """F19. Nulls of each column named replaced by its default."""
    return df.na.fill(dict(defaults))


def sorted_rows(df: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    """O2. By one column, equal rows in the order of ``tie``."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first(), tie)


def preview(df: DataFrame, order: Sequence[str | Column], k: int = 10) -> DataFrame:
    """O3. The first k rows in order, with ``more``, the number of rows that are not shown."""
    rows = df.agg(F.count("*").alias("n"))
    top = df.orderBy(*order).limit(k)
    return top.crossJoin(F.broadcast(rows)).withColumn("more", F.greatest(F.col("n") - k, F.lit(0))).drop("n")  # one row


def sample(df: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """O4. n rows at random, the same for the same seed; all if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_column), id_column).limit(n)


def token_sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """O6. Sizes of the intersection, the union, and the Dice coefficient of two texts' words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    common = F.size(F.array_intersect(x, y))
    dice = F.when(F.size(x) + F.size(y) > 0, 2 * common / (F.size(x) + F.size(y))).otherwise(0.0)
    return common, F.size(F.array_union(x, y)), dice


def union_sources(**sources: DataFrame) -> DataFrame:
    """O7. All rows of the sources, with the name of each."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("feed", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def numbered(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """W4. Rows of each group numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
