"""Files and JSON: listings, archive checks, whole texts, nested maps, seeds, download plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dizin.functions import text as T


def nested_map(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """S5. ``(keep, area, grade, url)`` from a JSON text of area to grade to URL."""
    areas = df.select(*keep, F.explode(F.from_json(json, "map<string,map<string,string>>")).alias("area", "urls"))
    return areas.select(*keep, "area", F.explode("urls").alias("grade", "url"))


def object_list(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """S6. ``(keep, key, label)`` of JSON objects that have both; of equal keys the last label."""
    each = df.select(*keep, F.posexplode(F.from_json(json, "array<struct<key:string,label:string>>")).alias("pos", "x"))
    both = each.filter("x.key is not null and x.label is not null")
    return both.groupBy(*keep, F.col("x.key").alias("key")).agg(F.max_by("x.label", "pos").alias("label"))


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """S7. ``(path, name, relative_path, length)`` of files below a folder, without reading them; ``~$`` files are left out."""
    plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", folder)  # a folder is a name, not a pattern
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(plain).select("path", "length")
    return listed(found, folder, extensions)


def listed(paths: DataFrame, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """S7 over a table that has a ``path``; the relative path is what follows the first occurrence of the folder, whatever characters that has."""
    name = F.substring_index("path", "/", -1)
    ending = F.lower(name).rlike(r"\.(" + "|".join(rf"\Q{e.lower()}\E" for e in extensions) + ")$")
    below = F.lit(folder.rstrip("/") + "/")
    at = F.call_function("locate", below, F.col("path"))
    inside = F.when(at > 0, F.substr("path", at + F.length(below))).otherwise(F.col("path"))
    return paths.filter(ending & ~name.startswith("~$")).withColumn("name", name).withColumn("relative_path", inside)


def archive_kind(content: Column) -> Column:
    """S8. Kind by the first bytes: RAR, ZIP, 7Z, else UNKNOWN with the bytes in hex."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "52617221", "RAR").when(head.startswith("504B"), "ZIP").when(head.startswith("377A"), "7Z").otherwise(F.concat(F.lit("UNKNOWN "), head))


def kind_mismatch(name: Column, kind: Column) -> Column:
    """S8. Whether an archive's extension says another kind than its bytes."""
    told = F.upper(F.substring_index(name, ".", -1))
    return told.isin("RAR", "ZIP", "7Z") & ~kind.startswith("UNKNOWN") & (told != kind)


def archive_check(name: Column, length: Column, kind: Column) -> Column:
    """S9. Why an archive cannot be used; ``ok`` if it can."""
    low = F.lower(name)
    return (
        F.when(length < 1024, "too small").when(kind.startswith("UNKNOWN"), "unknown kind").when(low.rlike("temp|tmp|test|broken|corrupt"), "temporary name").otherwise("ok")
    )


def valid_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """S10. Documents with any text."""
    return df.filter(F.length(T.clean_cell(F.col(text))) > 0)


def reject_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """S10. How many documents there are, and how many have no text."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.length(T.clean_cell(F.col(text))) == 0).alias("rejected"))


def whole_text(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """S11. One text per document: its pages in order, spaces collapsed."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return pages.groupBy(doc).agg(T.spaces(F.array_join(ordered[text], "\n")).alias("text"))


def json_rows(df: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """S12. One JSON text per group, its rows in order; ready for ``write.text`` or ``write.json``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return df.groupBy(group).agg(F.to_json(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))).alias("json"))


def write_json_groups(df: DataFrame, path: str, groups: str | list[str], columns: list[str], order: list[str]) -> None:
    """S12, A3. JSON files in UTF-8, a folder ``group=value`` for each group (in one another for several ``groups``) with a line for each of its rows, in order.

    Rows are dealt to ranges of group and order, sorted, and written as they come: no group is ever one row or in memory, and a group that holds most rows is shared by
    many tasks. Its lines are in order within a file, and files are in order by name.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    keys = [F.col(c) for c in dict.fromkeys([*groups, *order])]
    lines = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*groups, F.to_json(F.struct(*columns)).alias("value"))
    lines.write.partitionBy(*groups).mode("overwrite").text(path)


def json_groups(spark: SparkSession, path: str, groups: str | list[str]) -> DataFrame:
    """S12, A3. ``(groups, file, json)`` of what ``write_json_groups`` wrote; a group's rows in order are its lines by file."""
    groups = [groups] if isinstance(groups, str) else list(groups)
    return spark.read.text(path).select(*groups, F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("json"))


def with_seeds(df: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """S13. Rows, and the seeds whose key they lack."""
    return df.unionByName(seeds.dropDuplicates([key]).join(df.select(key), key, "left_anti").select(*df.columns))


def download_plan(links: DataFrame, present: DataFrame) -> DataFrame:
    """S14. ``links(code, id, name, url)`` with folder, file and whether ``present(folder, file)`` has it."""
    planned = links.withColumn("folder", T.folder_key(F.col("code"), F.col("id"), F.col("name"), F.col("url"))).withColumn("file", T.file_name(F.col("url")))
    there = present.select("folder", "file").distinct().withColumn("there", F.lit(True))
    return planned.join(there, ["folder", "file"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
