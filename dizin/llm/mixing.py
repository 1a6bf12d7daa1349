"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is shared among its documents by weight: longer documents are expected more often, in proportion to the
number of binary digits of their size, up to twice. The whole part of that expectation is certain copies. The rest is the
document's inclusion probability. Documents of a source are ranked by their random odds divided by their inclusion odds and
taken in this order up to the words that the target still wants; one further document, of the size nearest to what is missing,
closes the gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dizin.llm.common import written

#: Weights of the sources in order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: A table of a few rows per source is broadcast up to this many rows, and joined by sorting beyond.
BROADCAST_ROWS = 100_000
TOP = 1 << 48


def measured(docs: DataFrame, doc_id: str, text: str, source: str, *keep: Column, seed: int = 42) -> DataFrame:
    """``keep``, ``source``, ``size`` (words ``[^\\x20\\x09-\\x0D]+``; 0 for null), ``bits`` (binary digits of the size) and ``u``, 48 random bits.

    The bits are a hash of seed, id and text, so reruns agree; rows with equal id and text have equal bits.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(body))
    held = docs.select(
        *keep, F.col(f"`{source}`").alias("source"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long").alias("u"),
    )
    return held.withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def _few(df: DataFrame) -> DataFrame:
    """A written table with the join hint that its counted rows allow."""
    df = written(df, "few")
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_no, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all
    words; no target exceeds ``MOST`` times its source's size, and the excess is shared by weight
    until none does. Sources fill up in the order of size by weight, so one pass in that order finds
    which are full. Words are counted in integers; a target is one division.
    """
    up, down = SHARE
    of = F.create_map(*[x for i, w in enumerate(WEIGHTS) for x in (F.lit(i), F.lit(w))])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("source_no", F.row_number().over(order)).withColumn("w", of[(F.col("source_no") - 1) % len(WEIGHTS)].cast("long"))
    fill = Window.orderBy(F.col("source_size") * (F.lit(math.lcm(*WEIGHTS)) / F.col("w")).cast("long"), "source_no")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * up)
        .withColumn("before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST)
        .withColumn("w_rest", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", (F.col("total") - down * F.col("before")) * F.col("w") >= F.col("source_size") * F.col("w_rest") * (down * MOST))
    )
    held = F.sum(F.when(F.col("full"), F.col("source_size") * MOST).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    share = ((F.col("total") - held * down) * F.col("w")).cast("double") / (free * down).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * MOST).cast("double")).otherwise(share)
    return weighed.select("source", "source_no", "source_size", target.alias("target"))


def expectations(classes: DataFrame) -> DataFrame:
    """``classes(source, bits, words)`` with the source's number, size and target, and each class's ``certain`` copies and ``part``.

    The documents of a class, those of one source and one number of digits, are expected ``certain + part`` times: the
    digits times a factor of the source, ``MOST`` times at most, so that all expected words together are the target. Classes of
    many digits are full first, so one pass downward finds them. A document without words is taken once.
    """
    goal = _few(targets(written(classes.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")))
    held = classes.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    down = Window.partitionBy("source_no").orderBy(F.desc("bits"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * MOST
    rest = F.sum(F.col("bits") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    held = held.withColumn("full", (F.col("target") - before) * F.col("bits") >= (rest * MOST).cast("double"))
    whole = Window.partitionBy("source_no")
    full = F.sum(F.when(F.col("full"), F.col("words") * MOST).otherwise(0)).over(whole)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("bits") * F.col("words"))).over(whole)
    expected = (F.col("target") - full) * F.col("bits") / open_.cast("double")
    held = held.withColumn("expected", F.when(F.col("bits") == 0, 1.0).when(F.col("full"), float(MOST)).otherwise(F.greatest(F.lit(0.0), expected)))
    held = held.withColumn("certain", F.floor("expected").cast("int")).withColumn("part", F.col("expected") - F.col("certain"))
    rest_words = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole)
    return held.withColumn("rest", rest_words).select("source", "bits", "source_no", "source_size", "target", "certain", "part", "rest")


def ranked(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``rows`` with their class's columns of ``expected`` and ``rank``: random odds by inclusion odds (null without a part)."""
    odds = F.col("part") / (1 - F.col("part"))
    rank = (F.col("u").cast("double") / (TOP - F.col("u")).cast("double")) / odds
    of = expected.withColumnsRenamed({"source": "of", "bits": "of_bits"})
    joined = rows.join(of, F.col("source").eqNullSafe(F.col("of")) & (F.col("bits") == F.col("of_bits"))).drop("of", "of_bits")
    return joined.withColumn("rank", F.when(F.col("part") > 0, rank))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``with_copies`` needs: expectations by class, and by source where its ranks are cut and which rank closes the gap.

    ``rows`` has ``source``, ``size``, ``bits`` and ``u`` and should be a written table; it is read a few times. Rows of a
    source are first summed in bins of the rank, about the square root of all rows many, so that no task orders more than
    that of one source, however large it is: at the cut, where a rank is near 1, no bin holds more than its share of ranks.
    Rows that are equal in all these columns are taken together.
    """
    expected = _few(expectations(written(rows.groupBy("source", "bits").agg(F.sum("size").alias("words")), "classes")))
    bins = max(1, math.isqrt(rows.count()))
    order = ranked(rows.select("source", "size", "bits", "u"), expected).filter("rank is not null")
    order = order.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int"))
    sums = order.groupBy("source_no", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source_no").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(run)).filter("upto > rest")
    edge = sums.groupBy("source_no").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("e"))
    edge = _few(edge.select("source_no", F.col("e.bin").alias("edge"), F.col("e.before").alias("before")))
    inside = order.join(edge, "source_no").filter("bin = edge")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source_no", "bin").orderBy("rank", "u"))
    cut = inside.withColumn("upto", upto).filter("upto <= rest").groupBy("source_no").agg(F.max(F.struct("rank", "u")).alias("cut"), F.max("upto").alias("words"))
    cut = edge.join(cut, "source_no", "left").select("source_no", "edge", "cut", F.coalesce("words", "before").alias("words"))
    cut = _few(cut)
    at = F.struct("rank", "u")
    left = order.join(cut, "source_no").filter((F.col("bin") > F.col("edge")) | (F.col("bin") == F.col("edge")) & (F.col("cut").isNull() | (at > F.col("cut"))))
    gap = F.col("rest") - F.col("words")
    close = left.withColumn("off", F.abs(F.col("size") - gap)).filter(F.col("off") < gap).groupBy("source_no").agg(F.min(F.struct("off", "rank", "u")).alias("close"))
    ends = cut.drop("words").join(_few(close), "source_no", "left").select("source_no", "edge", "cut", F.struct("close.rank", "close.u").alias("close"))
    return expected, _few(ends.withColumnRenamed("source_no", "cut_no").withColumn("bins", F.lit(bins)))


def with_copies(rows: DataFrame, chosen: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (``source``, ``size``, ``bits``, ``u`` and more) with ``copies``, ``source_size`` and ``target`` from ``plan``."""
    expected, ends = chosen
    held = ranked(rows, expected).join(ends, F.col("source_no") == F.col("cut_no"), "left")
    at = F.struct("rank", "u")
    bin_ = F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins"))
    inside = F.col("edge").isNull() | (bin_ < F.col("edge")) | (bin_ == F.col("edge")) & F.coalesce(at <= F.col("cut"), F.lit(False))
    more = F.col("rank").isNotNull() & (inside | F.coalesce((F.col("rank") == F.col("close.rank")) & (F.col("u") == F.col("close.u")), F.lit(False)))
    return held.withColumn("copies", F.col("certain") + more.cast("int"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (0 to 2 times), columns as they were.

    Sizes are measured twice, from the same row, so that texts never move.
    """
    chosen = plan(written(measured(docs, doc_id, text, source, seed=seed), "sized"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    out = with_copies(measured(docs, doc_id, text, source, whole, seed=seed), chosen)
    return out.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def digest(documents: DataFrame) -> DataFrame:
    """Per row of documents: its size, its source's size and target, and the words that the mix takes of it.

    Null texts have no words and null sources are one source. An empty table gives an empty mix. A document without words is
    taken once. Repeated rows (equal id and text) are taken alike.
    """
    rows = written(measured(documents, "doc_id", "text", "source", F.col("doc_id")), "sized")
    out = with_copies(rows, plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
