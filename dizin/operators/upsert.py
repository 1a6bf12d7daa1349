"""Idempotent table maintenance: each function returns the table after the change, or what it reports.

Surrogate keys are hashes of natural keys, so reruns give the same ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dizin.functions import text as T
from dizin.scratch import tasks_of


def surrogate(*key: str) -> Column:
    """A stable id of a natural key, not negative."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 63) - 1))


def get_or_create(dim: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """M1. ``dim(id, key...)`` and a row for each key of ``new`` that it lacks; blank keys are left out."""
    wanted = new.select(*key)
    for k in key:
        wanted = wanted.filter(F.trim(F.col(k).cast("string")) != "")
    missing = wanted.distinct().join(dim.select(*key), list(key), "left_anti")
    return dim.unionByName(missing.select(surrogate(*key).alias("id"), *key))


def upsert_areas(areas: DataFrame, changes: DataFrame) -> DataFrame:
    """M2. ``areas(name, code, cop, dbf)`` after ``changes`` of the same columns, one per name; null fields keep what is stored.

    Names are brought to title case (blank: ``Belirtilmemiş``). A curriculum map replaces the stored
    one if it is a JSON object, and is merged into it if it is one URL. A form map replaces. A code
    is the given one, else the stored one, else told by the URLs.
    """
    named = changes.withColumn("name", T.title_case_tr(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Belirtilmemiş"))))
    named = named.groupBy("name").agg(*[F.max(c).alias(f"new_{c}") for c in ("code", "cop", "dbf")])
    both = areas.join(named, "name", "full")
    merged = T.merge_url(T.url_map(F.col("cop")), F.col("new_cop"))
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))
    cop = F.when(F.col("new_cop").startswith("{"), F.col("new_cop")).when(F.col("new_cop").isNotNull(), ordered).otherwise(F.col("cop"))
    both = both.withColumn("cop", cop).withColumn("dbf", F.coalesce("new_dbf", "dbf"))
    urls = F.concat(F.map_values(T.url_map(F.col("cop"))), F.map_values(T.url_map(F.col("dbf"))))
    code = F.coalesce("new_code", "code", T.area_code(urls))
    return both.select("name", code.alias("code"), "cop", "dbf")


def sync_actions(stored: DataFrame, listed: DataFrame, key: str, value: str) -> DataFrame:
    """M3. What bringing ``stored`` to ``listed`` does with each key: insert, update, skip (equal), keep (not listed)."""
    s, n = stored.select(key, F.col(value).alias("old"), F.lit(True).alias("is_stored")), listed.select(key, F.col(value).alias("new"), F.lit(True).alias("is_listed"))
    both = s.join(n, key, "full")
    action = F.when(F.col("is_listed").isNull(), "keep").when(F.col("is_stored").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("update")
    return both.select(key, action.alias("action"), F.when(F.col("is_listed"), F.col("new")).otherwise(F.col("old")).alias(value))


def insert_or_ignore(bridge: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """M4. New rows whose key is not there yet, once each; rows with a null id are rejected."""
    rows = new.dropna(subset=list(key)).dropDuplicates(list(key))
    return bridge.unionByName(rows.join(bridge.select(*key), list(key), "left_anti").select(*bridge.columns))


def partial_update(df: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """M5. ``changes(key, field, value)`` applied to the allowed columns; a field that is named may become null."""
    wide = changes.filter(F.col("field").isin(*allowed)).groupBy(key).agg(
        *[F.max(F.when(F.col("field") == c, F.struct(F.col("value")))).alias(f"new_{c}") for c in allowed]
    )
    out = df.join(wide, key, "left")
    for c in allowed:
        kind = df.schema[c].dataType
        out = out.withColumn(c, F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")["value"].try_cast(kind)).otherwise(F.col(c)))
    return out.select(*df.columns)


def one_per_key(values: DataFrame, key: str | Sequence[str], value: str = "new", order: str | None = None, first: bool = False) -> DataFrame:
    """``values`` with one row per key: its last value in ``order``, or its first; nulls do not count. Without an order the greatest, so reruns agree."""
    keys = [key] if isinstance(key, str) else list(key)
    at = F.struct(F.col(order), F.col(value)) if order else F.col(value)
    pick = F.min_by if first else F.max_by
    return values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(pick(value, at).alias(value))


def bulk_update(df: DataFrame, values: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """M6. The column set from ``values(key, new)`` where it has the key; of a repeated key the last value in ``order`` counts."""
    new = one_per_key(values, key, order=order)
    return df.join(new, key, "left").withColumn(column, F.coalesce("new", column)).select(*df.columns)


def fill_if_empty(df: DataFrame, values: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """M7. Only null or zero values are set; of a repeated key the first value in ``order`` that is not zero counts, since it leaves nothing to fill."""
    empty = F.coalesce(F.col(column), F.lit(0)) == 0
    new = one_per_key(values.filter("new <> 0"), key, order=order, first=order is not None)
    some = values.filter("new = 0").select(key, F.lit(0).alias("zero")).distinct()
    filled = F.coalesce("new", "zero", column).cast(df.schema[column].dataType)
    return df.join(new, key, "left").join(some, key, "left").withColumn(column, F.when(empty, filled).otherwise(F.col(column))).select(*df.columns)


def raise_only(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """M7. Values only grow; of a repeated key the greatest counts."""
    return df.join(one_per_key(values, key), key, "left").withColumn(column, F.greatest(column, "new")).select(*df.columns)


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, parent: str, name: str, order: str) -> DataFrame:
    """M8. All children of the ``parents`` written anew from ``new``, numbered from 1; blank names are skipped.

    All are dealt by parent over tasks in proportion to their files, and joined by sorting.
    """
    tasks = tasks_of(children, parents, new)
    # Marks, not a semi or anti join, which would be moved before the dealing and take one more.
    gone = parents.select(parent).repartition(tasks, parent).distinct().withColumn("replaced", F.lit(True)).hint("merge")
    kept = children.repartition(tasks, parent).join(gone, parent, "left").filter("replaced is null")
    rows = new.filter(F.trim(name) != "").repartition(tasks, parent).join(gone, parent)
    seq = F.row_number().over(Window.partitionBy(parent).orderBy(order)).alias("seq")
    return kept.select(parent, name, "seq").unionByName(rows.select(parent, name, seq))


def upsert_units(units: DataFrame, incoming: DataFrame) -> DataFrame:
    """M8. ``units(course_id, unit, hours)`` by upper-case name within a course: hours replaced, new units added."""
    key = ["course_id", "k"]
    old = units.withColumn("k", F.upper(F.trim("unit")))
    new = incoming.filter(F.trim("unit") != "").withColumn("k", F.upper(F.trim("unit"))).groupBy(*key).agg(F.max_by("unit", "pos").alias("new_unit"), F.max_by("hours", "pos").alias("new_hours"))
    both = old.join(new, key, "full")
    return both.select("course_id", F.coalesce("unit", "new_unit").alias("unit"), F.coalesce("new_hours", "hours").alias("hours"))


def batch_save(records: DataFrame) -> dict[str, DataFrame]:
    """M9. Rows for each table from nested ``records(area, branch, course, grade, objectives, tools, units)``.

    ``objectives`` and ``tools`` are arrays of text, ``units`` of ``struct<unit, topics: array<string>>``.
    A record without area, branch, course or grade is not saved; ``status`` tells so.
    """
    ok = F.lit(True)
    for c in ("area", "branch", "course"):
        ok = ok & F.coalesce(F.trim(c) != "", F.lit(False))
    told = records.withColumn("ok", ok & F.col("grade").isNotNull()).withColumn("course_id", surrogate("course", "grade"))
    good = told.filter("ok")
    units = good.select("course_id", F.posexplode("units").alias("pos", "u")).filter(F.trim("u.unit") != "")
    units = units.withColumn("unit_id", surrogate("course_id", "u.unit"))
    each = lambda c, name: good.select("course_id", F.explode(c).alias(name)).filter(F.trim(name) != "").distinct()
    return {
        "status": told.select("course_id", F.when(F.col("ok"), "success").otherwise("error").alias("status")),
        "area": good.select("area").distinct(),
        "branch": good.select("area", "branch").distinct(),
        "course": good.select("course_id", "course", "grade").distinct(),
        "bridge": good.select("course_id", "area", "branch").distinct(),
        "objective": each("objectives", "objective"),
        "tool": each("tools", "tool"),
        "unit": units.select("unit_id", "course_id", F.col("u.unit").alias("unit"), (F.col("pos") + 1).alias("seq")).dropDuplicates(["unit_id"]),
        "topic": units.select("unit_id", F.posexplode("u.topics").alias("p", "topic")).filter(F.trim("topic") != "").select("unit_id", "topic", (F.col("p") + 1).alias("seq")).distinct(),
    }


def copied(df: DataFrame, id_: str, copies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M10. Rows and their copies ``copies(id, new_id, columns...)``; null overrides keep the source's value."""
    over = copies.select(id_, "new_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    new = df.join(over, id_)
    values = [F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col("new_id").alias(id_) if c == id_ else F.col(c) for c in df.columns]
    return df.unionByName(new.select(*values))


def cascade_delete(tables: Sequence[tuple[DataFrame, str, str | None]], gone: DataFrame) -> list[DataFrame]:
    """M12. Tables ``(df, id, parent id)`` from the top down without the ids of ``gone(id)`` and all below them."""
    out, above = [], gone.select(F.col("id").alias("__gone")).distinct()
    for depth, (df, id_, parent) in enumerate(tables):
        on = F.col(id_ if depth == 0 else parent) == F.col("__gone")
        lost = df.join(above, on, "left_semi").select(F.col(id_).alias("__gone")).distinct()
        out.append(df.join(above, on, "left_anti"))
        above = lost
    return out


def merge_grade(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """M13. ``stored(key, urls: map)`` with ``new(key, grade, url)`` put in, replacing the grade's URL; of a repeated grade the last URL in ``order`` counts.

    Rows without a grade or URL change nothing; a key without a map gets one.
    """
    each = one_per_key(new.filter("grade is not null"), [key, "grade"], "url", order)
    maps = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("grade", "url"))).alias("more"))
    out = stored.join(maps, key, "left")
    kept = F.map_filter("urls", lambda k, _: ~F.array_contains(F.map_keys("more"), k))
    merged = F.when(F.col("urls").isNull(), F.col("more")).otherwise(F.map_concat(kept, "more"))
    return out.withColumn("urls", F.when(F.col("more").isNull(), F.col("urls")).otherwise(merged)).drop("more")


def overwrite_matches(df: DataFrame, values: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """M14. The column overwritten from ``values(key, new)`` with ``hit``, whether there was one; of a repeated key the last value in ``order`` counts, null too."""
    at = F.struct(F.col(order), F.col("new")) if order else F.struct("new")
    new = values.groupBy(key).agg(F.max_by(F.struct("new"), at).alias("x")).select(key, "x.new", F.lit(True).alias("hit"))
    out = df.join(new, key, "left")
    return out.withColumn(column, F.when(F.col("hit"), F.col("new")).otherwise(F.col(column))).withColumn("hit", F.coalesce("hit", F.lit(False))).drop("new")


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """M15. Keys that stand more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """M15. Values of a child's key that no parent has, with how many rows have them."""
    orphans = child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return orphans.groupBy(child_key).agg(F.count("*").alias("n"))


def lowest_grade(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W3. Courses and their links after an ordered feed ``(seq, name, grade, hours, link)``; ``seq`` is of any type that has an order.

    Blank names and missing grades are rejected. The row of the lowest grade that comes first
    survives; its hours are the most from then on, and links from before are lost with the rows that
    it replaced. Closed form of the row-by-row rule: with g the least grade and t its first place,
    the row is that at t, and rows count from t on.
    """
    ok = feed.filter((F.trim("name") != "") & F.coalesce(F.col("grade") > 0, F.lit(False)))
    at = ok.groupBy("name").agg(F.min(F.struct("grade", "seq")).alias("m")).select("name", F.col("m.grade").alias("least"), F.col("m.seq").alias("t"))
    since = ok.join(at, "name").filter("seq >= t")
    courses = since.groupBy("name").agg(F.first("least").alias("grade"), F.max(F.coalesce("hours", F.lit(0))).alias("hours"), F.first("t").alias("seq"))
    return courses, since.select("name", "link").filter("link is not null").distinct()


def catalogue_courses(nested: DataFrame, order: str = "area") -> DataFrame:
    """M16. ``(seq, name, grade, hours, link)`` from ``(area, grades: map<string, array<struct<title, url>>>)``, ready for ``lowest_grade``.

    ``seq`` is the place in the feed, a struct: the row's ``order``, the grade's place in the map and the record's in its list. A record's own ``grade``,
    where it has one, counts before that of its list.
    """
    lists = nested.select("area", F.col(order).alias("row_no"), F.posexplode(F.map_entries("grades")).alias("grade_no", "g"))
    each = lists.select("area", "row_no", "grade_no", F.col("g.key").alias("list_grade"), F.posexplode("g.value").alias("record_no", "r"))
    own = F.coalesce(T.grade(F.col("r.grade")), T.grade(F.col("list_grade"))) if "grade" in each.schema["r"].dataType.names else T.grade(F.col("list_grade"))
    return each.select(F.struct("row_no", "grade_no", "record_no").alias("seq"), T.title_case_tr(T.without_commas(F.col("r.title"))).alias("name"), own.alias("grade"), F.lit(0).alias("hours"), F.col("area").alias("link"))


def touched(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], now: Column) -> DataFrame:
    """M17. ``new`` with ``updated_at``: ``now`` where a value changed or the row is new, else the old time."""
    before = old.select(key, "updated_at", F.struct(*columns).alias("__old"))
    out = new.join(before, key, "left")
    same = F.struct(*columns).eqNullSafe(F.col("__old"))
    return out.withColumn("updated_at", F.when(same, F.col("updated_at")).otherwise(now)).drop("__old")
