"""Matching names across sources: exact, containment, shared words, similarity, fallbacks.

No join here compares all names with all names. Containment is found over character grams: a name
that holds another holds the other's rarest gram, so an equi-join on it brings together all pairs
that can match. Names that must share several words are joined on their rarest ones only: of two
that share c words, each has a shared one when its c - 1 most frequent are left out. Sizes of exploded tables
are unknown to Spark, so all these joins are by sorting, in which hot keys can be split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dizin.functions import text as T

GRAM = 3


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def holding_pairs(holders: DataFrame, held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs ``(by, holder, held)`` of distinct names where one contains the other, from ``holders(by, name)``, ``held(by, name)``."""
    by = list(by)
    inside = F.array_distinct(F.flatten(F.array(*[_grams(F.col("holder"), n) for n in range(1, GRAM + 1)])))
    by_gram = holders.select(*by, F.col("name").alias("holder")).filter("holder <> ''").distinct().select(*by, "holder", F.explode(inside).alias("gram"))
    often = by_gram.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("held") >= GRAM, _grams(F.col("held"), GRAM)).otherwise(F.array("held"))
    grams = held.select(*by, F.col("name").alias("held")).filter("held <> ''").distinct().select(*by, "held", F.explode(F.array_distinct(own)).alias("gram"))
    rarest = grams.hint("merge").join(often, [*by, "gram"], "left").groupBy(*by, "held").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return by_gram.hint("merge").join(rarest, [*by, "gram"]).filter(F.col("holder").contains(F.col("held"))).select(*by, "holder", "held")


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    picked = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("m")
    return rows.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"m.{c}").alias(c) for c in columns])


def _by_gram(names: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Rows once for each distinct gram of their ``name``."""
    return names.filter("name <> ''").withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("name"), n) for n in sizes])))))


def _by_rarest(names: DataFrame, often: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, best, gram)``: names with the gram of theirs that the fewest of the others hold; a name of fewer letters than a gram has is its own."""
    short = names.filter((F.length("name") < GRAM) & (F.col("name") != "")).select(*keys, "best", F.col("name").alias("gram"))
    grams = _by_gram(names, [GRAM]).hint("merge").join(often, "gram", "left")
    rarest = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    return short.unionByName(grams.groupBy(*keys).agg(F.min("best").alias("best"), rarest).select(*keys, "best", "gram"))


def first_contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(name, kind, best)``: for each name of ``left(name)`` and each kind, the least ``best`` of ``right(name, kind, best)`` whose name holds it or is held by it.

    A short name may be held by all others: of the names that hold a gram only the least is kept, gram by gram, and a name of up to ``GRAM`` letters is looked up
    there. So there are no pairs of a short name with all that hold it. Empty names hold nothing.
    """
    names = left.select("name").distinct()
    right = right.groupBy("name", "kind").agg(F.min("best").alias("best"))
    least = F.min("best").alias("best")
    left_grams = _by_gram(names, range(1, GRAM + 1))
    count = lambda grams: grams.filter(F.length("gram") == GRAM).groupBy("gram").agg(F.count("*").alias("n"))
    filed = _by_rarest(right, count(left_grams), ["name", "kind"]).withColumnRenamed("name", "held")
    inside = left_grams.hint("merge").join(filed, "gram").filter(F.col("name").contains(F.col("held"))).groupBy("name", "kind").agg(least)
    by_gram = _by_gram(right, range(1, GRAM + 1)).groupBy("gram", "kind").agg(least)
    short = names.filter(F.length("name").between(1, GRAM)).select("name", F.col("name").alias("gram")).hint("merge").join(by_gram, "gram").select("name", "kind", "best")
    right_grams = _by_gram(right, [GRAM])
    own = _by_rarest(names.filter(F.length("name") > GRAM).withColumn("best", F.lit(0)), count(right_grams), ["name"]).select("name", "gram")
    around = right_grams.withColumnRenamed("name", "holder").hint("merge").join(own, "gram").filter(F.col("holder").contains(F.col("name"))).groupBy("name", "kind").agg(least)
    return inside.unionByName(short).unionByName(around).groupBy("name", "kind").agg(least)


def exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """J5. ``left(name)`` with the id of the equal name (in title case) of ``right(name, id)``; the last id of equals."""
    keyed = right.groupBy(T.title_case_tr(F.col("name")).alias("key")).agg(F.max("id").alias("id"))
    return left.withColumn("key", T.title_case_tr(F.col("name"))).join(keyed, "key", "left").drop("key")


def containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """J6. ``(name, id, tier)``: an equal name (0), else the first by name that holds it or is held (1), cases aside."""
    return class_containment(left.withColumn("protocol", F.lit(False)), right.withColumn("protocol", F.lit(False))).select("name", "id", "tier")


def class_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """J7. ``(name, protocol, id, tier)``: equal (0), else containment in the same protocol class (1), else in any (2); first by name."""
    best = F.struct(F.col("name").alias("right_name"), "id")
    r = right.select(F.lower("name").alias("name"), F.col("protocol").alias("kind"), best.alias("best"))
    l = left.select("name", "protocol", F.lower("name").alias("l")).distinct()  # noqa: E741
    equal = r.groupBy(F.col("name").alias("l")).agg(F.min("best").alias("best"))
    same = l.hint("merge").join(equal, "l").select("name", "protocol", F.lit(0).alias("tier"), "best")
    found = first_contained(l.select(F.col("l").alias("name")), r).withColumnRenamed("name", "l")
    held = l.hint("merge").join(found, "l").select("name", "protocol", F.when(F.col("protocol") == F.col("kind"), 1).otherwise(2).alias("tier"), "best")
    met = same.unionByName(held).select("name", "protocol", "tier", "best.*")
    return _first(met, ["name", "protocol"], ["tier", "right_name", "id"], ["tier", "id"])


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def shared_words(left: DataFrame, right: DataFrame, least_left: Callable[[Column], Column], least_right: Callable[[Column], Column]) -> DataFrame:
    """Distinct ``(l, r, common, n_l, n_r)`` of names that share enough words to matter.

    ``least_left(n)``, ``least_right(n)``: how many words a name of n words must share with a name of the other side, 1 at least. Each name is filed
    under its rarest words, n - least + 1 of them, so pairs meet that share so many; others may be missing.
    """
    side = lambda d: d.select("name").distinct().select("name", F.explode(_words(F.col("name"))).alias("word"))
    often = side(left).unionByName(side(right)).groupBy("word").agg(F.count("*").alias("n"))

    def filed(d: DataFrame, c: str, least: Callable[[Column], Column]) -> DataFrame:
        ranked = side(d).hint("merge").join(often, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "word")))["word"].alias(f"w_{c}"))
        rare = F.slice(f"w_{c}", F.lit(1), F.size(f"w_{c}") - least(F.size(f"w_{c}")) + 1)
        return ranked.select(F.col("name").alias(c), f"w_{c}", F.explode(rare).alias("word"))

    met = filed(left, "l", least_left).hint("merge").join(filed(right, "r", least_right), "word")
    # Of the words under which two names meet the first brings them together.
    met = met.filter(F.col("word") == F.get(F.array_intersect("w_l", "w_r"), F.lit(0)))
    return met.select("l", "r", F.size(F.array_intersect("w_l", "w_r")).alias("common"), F.size("w_l").alias("n_l"), F.size("w_r").alias("n_r"))


def _two(n: Column) -> Column:
    return F.least(n, F.lit(2))


def keyword_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """J8. ``(name, match, tier)``: equal (0), else the first by name with two common words or 70 % of the left ones (1).

    70 % of one word is that word, of more words two at least; so a name of one word takes the first name of that word.
    """
    l, r = left.select("name").distinct(), right.select(F.col("name").alias("r")).distinct()
    words = _words(F.col("name"))
    equal = l.filter(F.size(words) > 0).withColumn("k", F.lower("name")).hint("merge").join(r.groupBy(F.lower("r").alias("k")).agg(F.min("r").alias("match")), "k").select("name", "match", F.lit(0).alias("tier"))
    first = r.select("r", F.explode(_words(F.col("r"))).alias("word")).groupBy("word").agg(F.min("r").alias("match"))
    one = l.filter(F.size(words) == 1).withColumn("word", words[0]).hint("merge").join(first, "word").select("name", "match", F.lit(1).alias("tier"))
    met = shared_words(l.filter(F.size(words) > 1), right.filter(F.size(words) > 1), _two, _two).filter("common >= 2").select(F.col("l").alias("name"), F.col("r").alias("match"), F.lit(1).alias("tier"))
    return _first(equal.unionByName(one).unionByName(met), ["name"], ["tier", "match"], ["match", "tier"])


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """J9. ``(name, match, score)``: equal 100, containment 90, else Dice of the words if over 70; the best, first by name.

    Names are in small letters and trimmed. A pair has the score of the first of these that holds.
    """
    names = lambda d: d.select(F.trim(F.lower("name")).alias("name")).filter("name <> ''").distinct()
    l, r = names(left), names(right)  # noqa: E741
    same = l.hint("merge").join(r, "name").select(F.col("name").alias("l"), F.col("name").alias("r"), F.lit(100.0).alias("score"))
    # Where a name is equal to one, what holds it counts less.
    held = first_contained(l, r.select("name", F.lit(0).alias("kind"), F.struct("name").alias("best"))).select(F.col("name").alias("l"), F.col("best.name").alias("r"), F.lit(90.0).alias("score")).filter("l <> r")
    # 200 c / (n + m) > 70 with m >= c needs c > 7 n / 13.
    least = lambda n: F.least(n, F.floor(n * 7 / 13).cast("int") + 1)
    dice = shared_words(l, r, least, least).withColumn("score", 200.0 * F.col("common") / (F.col("n_l") + F.col("n_r"))).filter("score > 70 and not contains(l, r) and not contains(r, l)").select("l", "r", "score")
    best = same.unionByName(held).unionByName(dice).withColumn("worse", -F.col("score"))
    return _first(best, ["l"], ["worse", "r"], ["score", "r"]).select(F.col("l").alias("name"), F.col("r").alias("match"), "score")


def partial_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """J10. ``(name, match)``: all names equal but for letters' form; without any, all with enough common words.

    Enough are two, or 60 % of the words of a name that has two at least: two in either case.
    """
    key = lambda c: T.match_key(F.col(c))
    l = left.select("name").distinct().withColumn("key", key("name"))  # noqa: E741
    same = l.hint("merge").join(right.select(F.col("name").alias("match")).distinct().withColumn("key", key("match")), "key").select("name", "match")
    rest = l.hint("merge").join(same.select("name").distinct(), "name", "left_anti").select("name")
    more = shared_words(rest.filter(F.size(_words(F.col("name"))) >= 2), right.filter(F.size(_words(F.col("name"))) >= 2), _two, _two).filter("common >= 2")
    return same.unionByName(more.select(F.col("l").alias("name"), F.col("r").alias("match")))


def code_with_source(left: DataFrame, stored: DataFrame, reference: DataFrame) -> DataFrame:
    """J11. ``left(name, given)`` with ``code`` and where it is from: given, table, list, list by key, list by base name, none.

    ``stored(name, code)`` and ``reference(name, code)`` have distinct names; of equal keys the first code counts.
    """
    keyed = reference.groupBy(T.match_key(F.col("name")).alias("k")).agg(F.min("code").alias("by_key"))
    out = (
        left.join(stored.select("name", F.nullif("code", F.lit("")).alias("by_table")), "name", "left")
        .join(reference.select("name", F.col("code").alias("by_list")), "name", "left")
        .withColumn("k", T.match_key(F.col("name"))).join(keyed, "k", "left").drop("k")
        .withColumn("name2", T.base_name(F.col("name"))).join(reference.select(F.col("name").alias("name2"), F.col("code").alias("by_base")), "name2", "left").drop("name2")
    )
    sources = {"given": F.nullif("given", F.lit("")), "table": F.col("by_table"), "list": F.col("by_list"), "key": F.col("by_key"), "base": F.col("by_base")}
    source = F.lit("none")
    for name, c in reversed(sources.items()):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return out.select("name", F.coalesce(*sources.values()).alias("code"), source.alias("source"))


def enriched(left: DataFrame, reference: DataFrame) -> DataFrame:
    """J12. ``left(name)`` with the code of its name, else of its base name."""
    out = left.join(reference.select("name", F.col("code").alias("own")), "name", "left").withColumn("base", T.base_name(F.col("name")))
    out = out.join(reference.select(F.col("name").alias("base"), F.col("code").alias("of_base")), "base", "left")
    return out.select("name", F.coalesce("own", "of_base").alias("code"))


def work_list(areas: DataFrame, grades: Sequence[int] = (9, 10, 11, 12)) -> DataFrame:
    """J13. Each area with each grade."""
    return areas.withColumn("grade", F.explode(F.array(*[F.lit(g) for g in grades])))


def elsewhere(files: DataFrame) -> DataFrame:
    """J14. Rows of ``files(folder, name)`` whose name another folder has too."""
    several = files.groupBy("name").agg(F.min("folder").alias("a"), F.max("folder").alias("b")).filter("a <> b").select("name")
    return files.join(several, "name", "left_semi")


def fill_by_pattern(units: DataFrame, incoming: DataFrame) -> DataFrame:
    """J15. ``units(unit_id, course_id, unit, hours)`` with the hours of ``incoming(course_id, part, new_hours)`` where none are set.

    A unit takes the hours of the first (by name) incoming part that its name holds, cases aside.
    """
    open_ = units.filter("unit is not null and (hours is null or hours = 0)").select("unit_id", "course_id", F.lower("unit").alias("holder"))
    parts = incoming.filter("part is not null").select("course_id", "part", "new_hours", F.lower("part").alias("held"))
    pairs = holding_pairs(open_.select("course_id", F.col("holder").alias("name")), parts.select("course_id", F.col("held").alias("name")), ["course_id"])
    met = open_.hint("merge").join(pairs, ["course_id", "holder"]).hint("merge").join(parts, ["course_id", "held"])
    # An empty part is in every name.
    blank = open_.hint("merge").join(parts.filter("held = ''").groupBy("course_id").agg(F.min(F.struct("part", "new_hours")).alias("m")), "course_id").select("unit_id", "m.*")
    found = _first(met.select("unit_id", "part", "new_hours").unionByName(blank), ["unit_id"], ["part", "new_hours"], ["new_hours"])
    return units.hint("merge").join(found, "unit_id", "left").withColumn("hours", F.coalesce("new_hours", "hours")).drop("new_hours")


def bucket_fallback(names: DataFrame, buckets: DataFrame) -> DataFrame:
    """J16. ``names(name)`` with a bucket of ``buckets(bucket, pos)``: the equal one, else the first by position that holds it or is held."""
    best = F.struct("pos", "bucket").alias("best")
    own = names.select("name").distinct()
    same = own.hint("merge").join(buckets.groupBy("bucket").agg(F.min(best).alias("best")), own["name"] == F.col("bucket")).select("name", F.lit(0).alias("tier"), "best")
    found = first_contained(own.select(F.upper("name").alias("name")), buckets.select(F.upper("bucket").alias("name"), F.lit(0).alias("kind"), best)).select(F.col("name").alias("n"), "best")
    held = own.withColumn("n", F.upper("name")).hint("merge").join(found, "n").select("name", F.lit(1).alias("tier"), "best")
    met = same.unionByName(held).select("name", "tier", "best.*")
    return names.distinct().hint("merge").join(_first(met, ["name"], ["tier", "pos", "bucket"], ["bucket"]), "name", "left")
