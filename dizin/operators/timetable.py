"""Weekly timetables: labels from the lines above a table, courses and hours from its cells in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dizin.functions import text as T
from dizin.scratch import tasks_of

#: Heading of a timetable, and how many lines above it hold its labels.
HEADING, AREA_LINES, BRANCH_LINES = "HAFTALIK DERS ÇİZELGESİ", 10, 15
#: Columns that are tried around the one found, in this order.
OFFSETS = (0, -1, 1, -2, 2)
GENERAL = "Genel"


def _upper(c: Column) -> Column:
    return F.upper(T.clean_cell(F.regexp_replace(c, "i", "İ")))


def labels(lines: DataFrame) -> DataFrame:
    """X20. ``(doc, area, branches)`` from ``lines(doc, page, line_no, line)``.

    Lines within ten above a heading count: the last area label (over five letters), all branch
    labels (over three), in title case. Each line looks ahead for a heading, so no line is copied.
    """
    ahead = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(1, AREA_LINES)
    up = lines.withColumn("up", _upper(F.col("line")))
    near = up.withColumn("near", F.max(F.col("up").contains(HEADING)).over(ahead)).filter("near")
    area = F.regexp_extract("up", r"^(.+?)\s+ALANI\s*$", 1)
    inner, outer = F.regexp_extract("up", r"\((.+?)\s+DALI\)", 1), F.regexp_extract("up", r"^(.+?)\s+DALI\s*$", 1)
    branch = F.when(inner != "", inner).otherwise(outer)
    title = lambda c, least: F.when(F.length(c) > least, T.title_case_tr(c))
    told = near.select("doc", F.struct("page", "line_no").alias("at"), title(area, 5).alias("area"), title(branch, 3).alias("branch"))
    return told.groupBy("doc").agg(F.max_by("area", F.when(F.col("area").isNotNull(), F.col("at"))).alias("area"), F.sort_array(F.collect_set("branch")).alias("branches"))


def branch_above(lines: DataFrame) -> DataFrame:
    """X21. ``(doc, page, line_no, branch)`` per heading: the first branch label in the fifteen lines above; dots and digits at its end do not matter."""
    above = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(-BRANCH_LINES, -1)
    label = F.regexp_extract(_upper(F.col("line")), r"^\(?(.+?)\s+DALI\)?[.\d\s]*$", 1)
    seen = lines.withColumn("label", F.when(F.length(label) > 3, T.title_case_tr(label)))
    out = seen.withColumn("branch", F.first("label", ignorenulls=True).over(above))
    return out.filter(_upper(F.col("line")).contains(HEADING)).select("doc", "page", "line_no", "branch")


def courses(cells: DataFrame) -> DataFrame:
    """X22. ``(doc, table_no, row_no, course, grade, hours)`` from ``cells(doc, table_no, row_no, col_no, text)``.

    The first three rows are headers: an exact ``DERSLER`` (the last), else ``DERS`` (the first), is
    the course column; ``9. SINIF``, or ``9.`` with ``SINIF`` to the right or in the same column, a
    grade column. Courses stand between a first cell of vocational courses and one of a total or
    electives. Names and hours (1 to 10) are sought beside their column too, so hours beside two grade columns count for both.
    Tables of fewer than five rows have none. The cells that matter meet once, on their table's row: a table is as small as a page.
    """
    key = ["doc", "table_no"]
    text = T.clean_cell(F.col("text"))
    # What the rules ask of a cell is told before cells meet; of the body only cells that they ask for are kept.
    held = cells.select(*key, F.col("row_no").cast("int").alias("row"), F.col("col_no").cast("int").alias("col"), text.alias("text")).withColumn("up", F.upper(F.replace("text", F.lit("i"), F.lit("İ"))))
    up = F.col("up")
    is_start, is_stop = up.contains("MESLEK") & up.contains("DERS"), up.contains("TOPLAM") | up.contains("SEÇMELİ")
    no_course = up.contains("TOPLAM") | (up.contains("REHBERLİK") & up.contains("YÖNLENDİRME"))
    mark = F.when(F.col("col") == 0, F.when(is_start, "start").when(is_stop, "stop"))
    name = F.when((F.length("text") >= 4) & ~no_course, F.col("text"))
    hours = F.when(F.col("text").rlike(r"^0*([1-9]|10)$"), F.col("text").cast("int"))
    held = held.select(*key, "row", "col", "text", "up", mark.alias("mark"), name.alias("name"), hours.alias("hours"))
    in_head, in_body = (F.col("row") < 3) & (F.col("text") != ""), (F.col("row") >= 3) & F.coalesce("mark", "name", F.col("hours").cast("string")).isNotNull()
    tables = held.groupBy(*key).agg(
        (F.max("row") + 1).alias("n_rows"), F.sort_array(F.collect_list(F.when(in_head, F.struct("row", "col", "text", "up")))).alias("head"),
        F.collect_list(F.when(in_body, F.struct("row", "col", "mark", "name", "hours"))).alias("body"),
    ).filter("n_rows >= 5").select(*key, "head", "body")

    with_title = lambda title: F.filter("head", lambda c: c["up"] == title)
    course_col = F.coalesce(F.try_element_at(with_title("DERSLER"), F.lit(-1))["col"], F.get(with_title("DERS"), F.lit(0))["col"])
    number = lambda c: F.regexp_extract(c["up"], r"(\d+)\.", 1)
    classes = F.filter("head", lambda c: c["up"].contains("SINIF"))
    beside = lambda c: F.exists("classes", lambda s: (s["col"] == c["col"]) | (s["row"] == c["row"]) & (s["col"] == c["col"] + 1))
    numbered = F.filter("head", lambda c: (number(c) != "") & (c["up"].rlike(r"\d+\.\s*SINIF") | beside(c)))
    graded = F.transform(numbered, lambda c: F.struct(c["col"].alias("col"), c["row"].alias("row"), number(c).cast("int").alias("grade")))
    # Of a column the lowest row counts.
    grades = F.filter("graded", lambda g: ~F.exists("graded", lambda o: (o["col"] == g["col"]) & (o["row"] > g["row"])))
    marked = lambda kind: F.transform(F.filter("body", lambda c: c["mark"] == kind), lambda c: c["row"])
    stop = F.array_min(F.filter(marked("stop"), lambda r: r > F.col("begin")))
    tables = tables.withColumns({"course_col": course_col, "classes": classes, "starts": marked("start")}).filter("course_col is not null and size(starts) > 0")
    tables = tables.withColumn("graded", graded).withColumns({"grades": grades, "begin": F.array_min("starts")}).withColumn("stop", stop)
    # The rows of a table stay where it is.
    each = tables.select(*key, "course_col", "grades", "begin", "stop", "starts", F.explode("body").alias("c"))
    each = each.filter((F.col("c.row") > F.col("begin")) & (F.col("stop").isNull() | (F.col("c.row") < F.col("stop"))) & ~F.array_contains("starts", F.col("c.row")))

    place = lambda col, wanted: F.array_position(F.array(*[F.lit(o) for o in OFFSETS]), col - wanted)
    at = place(F.col("c.col"), F.col("course_col"))
    named = F.min(F.when(F.col("c.name").isNotNull() & (at > 0), F.struct(at.alias("place"), F.col("c.name").alias("name"))))["name"]
    timed = F.collect_list(F.when(F.col("c.hours").isNotNull(), F.struct("c.col", "c.hours")))
    rows = each.groupBy(*key, F.col("c.row").alias("row_no")).agg(named.alias("name"), timed.alias("timed"), F.first("grades").alias("grades")).filter("name is not null")
    course = T.title_case_tr(T.spaces(T.without_footnotes(F.col("name")))).alias("course")
    rows = rows.select(*key, "row_no", course, "timed", "grades", F.explode(F.array_distinct(F.transform("grades", lambda g: g["grade"]))).alias("grade"))
    # Two columns of one grade: the nearest hours of both.
    near = lambda g: F.transform(F.filter("timed", lambda c: place(c["col"], g["col"]) > 0), lambda c: F.struct(place(c["col"], g["col"]).alias("place"), c["hours"].alias("hours")))
    best = F.array_min(F.flatten(F.transform(F.filter("grades", lambda g: g["grade"] == F.col("grade")), near)))
    return rows.withColumn("best", best).filter("best is not null").select(*key, "row_no", "course", "grade", F.col("best.hours").alias("hours"))


def with_branches(rows: DataFrame, branches: DataFrame) -> DataFrame:
    """X23, X24. ``rows(doc, table_no, course, grade, hours)`` under their table's branch, each once per branch, by name.

    Tables without a branch go to the first branch that the document has, or to ``Genel`` if it has none.
    ``branches(doc, table_no, branch)``; its rows meet on their document once, dealt over tasks in proportion to their files, and are joined by sorting.
    """
    tasks = tasks_of(rows, branches)
    named = branches.filter("branch is not null").repartition(tasks, "doc").groupBy("doc").agg(F.min_by("branch", "table_no").alias("first_branch"), F.collect_set(F.struct("table_no", "branch")).alias("named"))
    joined = rows.repartition(tasks, "doc").hint("merge").join(named, "doc", "left")
    own = F.transform(F.filter("named", lambda x: x["table_no"] == F.col("table_no")), lambda x: x["branch"])
    targets = F.when(F.size(own) > 0, own).otherwise(F.array(F.coalesce("first_branch", F.lit(GENERAL))))
    return distinct_courses(joined.select("doc", F.explode(targets).alias("branch"), "course", "grade", "hours"))


def distinct_courses(rows: DataFrame) -> DataFrame:
    """X24. Each course of a branch once, by its whole row."""
    return rows.dropDuplicates()


def distributed(general: DataFrame, branches: DataFrame, balanced: bool = False) -> DataFrame:
    """X25. Courses of ``Genel`` dealt to the branches in order: ``general(doc, pos, course)``, ``branches(doc, branch_no, branch)`` from 0.

    Branch i takes the courses from i*q on, q or q+1 of them (i < r), as the rule stands, so a course can go to two
    branches and another to none; ``balanced`` deals each once.
    """
    listed = branches.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("branch_no", "branch"))).alias("branches"))
    n = general.groupBy("doc").agg(F.count("*").alias("n"))
    each = general.hint("merge").join(n, "doc").hint("merge").join(listed, "doc")
    each = each.withColumns({"q": F.floor(F.col("n") / F.size("branches")), "r": F.col("n") % F.size("branches")})

    def takes(b: Column) -> Column:
        start = b["branch_no"] * F.col("q") + (F.least(b["branch_no"].cast("long"), F.col("r")) if balanced else F.lit(0))
        return (F.col("pos") >= start) & (F.col("pos") < start + F.col("q") + (b["branch_no"] < F.col("r")).cast("int"))

    return each.select("doc", F.explode(F.filter("branches", takes)["branch"]).alias("branch"), "pos", "course")


def summary(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """X26. Per document of ``docs(doc, area, n_labels)``: branches and courses of ``rows(doc, branch, course, grade)``, and its status.

    ``success`` with area, branches and courses; ``error`` without an area; else ``partial``.
    """
    counts = rows.groupBy("doc").agg(F.count_distinct("branch").alias("n_branches"), F.count("*").alias("n_courses"))
    out = docs.join(counts, "doc", "left").na.fill(0, ["n_branches", "n_courses"])
    status = F.when(F.col("area").isNull(), "error").when((F.col("n_branches") > 0) & (F.col("n_courses") > 0), "success").otherwise("partial")
    return out.withColumn("status", status)
