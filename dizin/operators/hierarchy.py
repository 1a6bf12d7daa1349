"""Joins along area, branch, course, unit, topic and outcome, and the nested views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dizin.scratch import tasks_of


def courses_of_areas(course: DataFrame, bridge: DataFrame, branch: DataFrame) -> DataFrame:
    """J1. Distinct ``(area_id, course_id, course, grade)`` over the bridge."""
    return course.join(bridge, "course_id").join(branch, "branch_id").select("area_id", "course_id", "course", "grade").distinct()


def courses_with_one_branch(course: DataFrame, bridge: DataFrame, branch: DataFrame) -> DataFrame:
    """J3. Each course with the branch of smallest id, null without one."""
    one = bridge.groupBy("course_id").agg(F.min("branch_id").alias("branch_id"))
    return course.join(one, "course_id", "left").join(branch.select("branch_id", "branch"), "branch_id", "left")


def unit_counts(unit: DataFrame, topic: DataFrame, outcome: DataFrame) -> DataFrame:
    """J4. Distinct topics and outcomes of each unit, zeros kept.

    Outcomes are counted by topic first, so no unit's rows multiply.
    """
    per_topic = outcome.groupBy("topic_id").agg(F.count_distinct("outcome_id").alias("n"))
    per_unit = topic.dropDuplicates(["unit_id", "topic_id"]).join(per_topic, "topic_id", "left").groupBy("unit_id").agg(F.count("topic_id").alias("n_topics"), F.sum("n").alias("n_outcomes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return unit.join(per_unit, "unit_id", "left").select("unit_id", zero("n_topics"), zero("n_outcomes"))


def options_tree(area: DataFrame, branch: DataFrame) -> DataFrame:
    """J18. Each area with the list of its branches, by name, empty if it has none."""
    lists = branch.groupBy("area_id").agg(F.sort_array(F.collect_list(F.struct("branch", "branch_id"))).alias("branches"))
    empty = F.array().cast(lists.schema["branches"].dataType)
    return area.join(lists, "area_id", "left").withColumn("branches", F.coalesce("branches", empty))


def catalogue(rows: DataFrame) -> DataFrame:
    """A12. One course per area and url: its first name (smallest) and its distinct grades, from ``(area_id, url, name, grade)``."""
    return rows.groupBy("area_id", "url").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("grade")).alias("grades"))


def nested(unit: DataFrame, topic: DataFrame, outcome: DataFrame) -> DataFrame:
    """A13. Units with their topics with their outcomes, each by sequence, then name; empty lists kept.

    ``unit(unit_id, unit, unit_seq)``, ``topic(topic_id, unit_id, topic, topic_seq)``,
    ``outcome(outcome_id, topic_id, outcome, outcome_seq)``.
    """
    outcomes = outcome.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("outcome_seq", "outcome", "outcome_id"))).alias("outcomes"))
    t = topic.join(outcomes, "topic_id", "left")
    t = t.withColumn("outcomes", F.coalesce("outcomes", F.array().cast(outcomes.schema["outcomes"].dataType)))
    topics = t.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("topic_seq", "topic", "topic_id", "outcomes"))).alias("topics"))
    u = unit.join(topics, "unit_id", "left")
    return u.withColumn("topics", F.coalesce("topics", F.array().cast(topics.schema["topics"].dataType)))


def nested_counts(tree: DataFrame) -> DataFrame:
    """A14. Topics and outcomes in each unit of ``nested``."""
    outcomes = F.aggregate("topics", F.lit(0), lambda n, t: n + F.size(t["outcomes"]))
    return tree.select("unit_id", F.size("topics").alias("n_topics"), outcomes.alias("n_outcomes"))


def linked_groups(parents: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """J17. Parents with the items linked to them, each item with its first parent only; then all items without a link.

    ``parents(parent_id, parent_seq)``, ``links(parent_id, item_id)``, ``items(item_id)``; gives
    ``(section, parent_id, item_id)`` with section 1 for linked and 2 for unlinked items and parents.
    Joins are by sorting, over tasks in proportion to the files; links are reduced to one an item and task before they are dealt by item.
    """
    tasks = tasks_of(parents, links, items)
    linked = links.repartition(tasks, "parent_id").hint("merge").join(parents.select("parent_id", "parent_seq").repartition(tasks, "parent_id").distinct(), "parent_id")
    first = linked.groupBy("item_id").agg(F.min_by("parent_id", F.struct("parent_seq", "parent_id")).alias("parent_id"))
    # An item without a link has no parent here.
    each = items.repartition(tasks, "item_id").hint("merge").join(first.repartition(tasks, "item_id"), "item_id", "left").select(F.when(F.col("parent_id").isNull(), 2).otherwise(1).alias("section"), "parent_id", "item_id")
    # A mark, not an anti join, which would be moved before the dealing and take one more.
    used = each.filter("parent_id is not null").select("parent_id").repartition(tasks, "parent_id").distinct().withColumn("used", F.lit(True)).hint("merge")
    alone = parents.repartition(tasks, "parent_id").join(used, "parent_id", "left").filter("used is null").select(F.lit(2).alias("section"), "parent_id", F.lit(None).cast("long").alias("item_id"))
    return each.unionByName(alone)


def default_tree(units: DataFrame) -> DataFrame:
    """M11. Topics ``Konu 1`` to ``Konu n`` of each unit, one outcome each, from ``(unit_id, n)``."""
    each = units.filter("n > 0").select("unit_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("topic_seq"))
    return each.withColumn("topic", F.concat(F.lit("Konu "), F.col("topic_seq").cast("string"))).withColumn("outcome", F.concat(F.lit("Kazanım "), F.col("topic_seq").cast("string")))


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """X17. New children behind those that a parent has: ``existing(parent_id, seq, name)``, ``new(parent_id, pos, name)``."""
    held = existing.groupBy("parent_id").agg(F.count("*").alias("held"))
    order = Window.partitionBy("parent_id").orderBy("pos")
    more = new.withColumn("n", F.row_number().over(order)).join(held, "parent_id", "left")
    more = more.select("parent_id", (F.coalesce("held", F.lit(0)) + F.col("n")).cast("int").alias("seq"), "name")
    return existing.select("parent_id", F.col("seq").cast("int").alias("seq"), "name").unionByName(more)
