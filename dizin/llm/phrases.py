"""Collocations by set-oriented mining: relations of occurrences are written sorted, joined with themselves at adjacent positions, counted by group, and
kept where their group is frequent before they grow by a word.

An occurrence is a place in a batch of texts, and the group (word or phrase) that stands there. Places go up by one from word to word of a piece, and
skip one where a piece ends, so adjacent places are adjacent words of one piece. A relation has a row for each batch, with its places in order and the
group of each; the join at adjacent places is a merge of these. A group is one row for each batch that has it, so no key has more rows than there
are batches, and what is shuffled for the counts are sums of batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dizin.llm.common import arrow_batches, batches_of, forget, hinted, most_frequent, written
from dizin.scratch import placed

#: Occurrences that make a phrase a candidate, and words of the longest.
LEAST, LONGEST = 30, 4
#: A candidate goes if a longer one has ``COVER`` of 100 of its occurrences; phrases that are listed of each language.
COVER, TOP = 80, 2000
#: Words whose groups every task is given at most, and the bytes for each: 8 MB in all.
HEAD, SHORT = 1 << 18, 32
#: Bytes of relations that a task has at once.
AT_ONCE = 8 << 20
#: Distinct words of a task's own counts before they are handed on.
HELD = 1 << 17
#: Rows and bytes of text of a batch.
ROWS, BYTES = 1 << 20, 4 << 20
#: A-Z in lower case; what ends a piece becomes a line end, a tab a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
END = b"\n"


def _by_group(groups: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct groups, and the places of each in order, four bytes a place."""
    order = np.argsort(groups, kind="stable")
    sorted_groups = groups[order]
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]) if len(order) else order
    offsets = (np.r_[starts, len(order)] * 4).astype(np.int32)
    data = pa.py_buffer(places[order].astype(np.int32).tobytes())
    return sorted_groups[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), data])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))


def _words(text: str | None) -> list[bytes]:
    """The words of a text in order, with ``END`` where pieces end, at the end of the text too."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).replace(END, b" \n ").split(b" ") if w] + [END]


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, word, f)``: how often each word of each language stands."""

    def told(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, times in counts.items():
            times.pop(END, None)
            words = pa.array((w.decode("utf-8", "surrogatepass") for w in times), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), words, pa.array(list(times.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts.setdefault(lang, Counter()).update(_words(text.as_py()))
                if len(counts[lang]) >= HELD or len(counts) > HELD:
                    yield from told(counts)
        yield from told(counts)

    return _texts(docs, text, lang).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_occurrences(docs: DataFrame, known: dict[str, dict[bytes, int]], others: bool, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(batch, places, groups, lang, word)``: for each batch of texts a row with the places of all ``known`` words in order, as steps, and their groups.

    If there are ``others``, each of the batch's other words has a row of its own, with its places, too.
    """
    schema = "batch long, places binary, groups binary, lang string, word string"
    arrow = pa.schema([("batch", pa.int64()), ("places", pa.binary()), ("groups", pa.binary()), ("lang", pa.string()), ("word", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, group_of = TaskContext.get().partitionId() << 32, shared.value
        for number, part in enumerate(batches_of(batches, "text", ROWS, BYTES)):
            batch, found, rest, size = first + number, [], {}, 0
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                words = _words(text.as_py())
                groups = np.fromiter(map(group_of.get(lang, {}).get, words, repeat(0)), np.int32, len(words))
                if others:
                    for at in np.flatnonzero(groups == 0).tolist():
                        if words[at] != END:
                            rest.setdefault((lang, words[at]), []).append(size + at)
                found.append(groups)
                size += len(words)
            every = np.concatenate(found)
            places = np.flatnonzero(every)
            held = [[batch], [_steps(places)], [every[places].tobytes()], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)
            told = [[batch] * len(rest), [np.array(x, np.int32).tobytes() for x in rest.values()], [None] * len(rest), [k[0] for k in rest], [k[1].decode("utf-8", "surrogatepass") for k in rest]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(told, arrow)], schema=arrow)

    return _texts(docs, text, lang).mapInArrow(run, schema)


def first_relation(docs: DataFrame, words: DataFrame, text: str, lang: str, head: int) -> DataFrame:
    """The relation of frequent words. The groups of the most frequent, ``head`` at most, go to each task, which files their places where the texts lie; those of the others are joined."""
    number, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    every = number <= head and size <= head * SHORT
    rows = words.select("lang", "word", "id").collect() if every else most_frequent(words.filter(F.octet_length("word") <= SHORT), "f", ["lang", "word", "id"], head)
    known: dict[str, dict[bytes, int]] = {}
    for of, word, group in rows:
        known.setdefault(of, {})[word.encode("utf-8", "surrogatepass")] = group
    if every:
        return written(word_occurrences(docs, known, False, text, lang).select("batch", "places", "groups"), "relation1")
    rows = written(word_occurrences(docs, known, True, text, lang), "occurrences")
    others = rows.filter("word is not null").select("batch", "lang", "word", "places").hint("merge").join(words.select("lang", "word", "id"), ["lang", "word"])
    held = rows.filter("word is null").select("batch", F.lit(None).cast("long").alias("id"), "places", "groups")
    relation = written(sorted_relation(others.select("batch", "id", "places", F.lit(None).cast("binary").alias("groups")).unionByName(held)), "relation1")
    forget(rows)
    return relation


def _steps(places: np.ndarray) -> bytes:
    """Places in order as the steps between them: most are 1, so a written relation is little more than its groups."""
    return np.diff(places, prepend=0).astype(np.int32).tobytes()


def _pairs(steps: pa.Scalar, groups: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A row of a relation merged with itself at adjacent places: the left places, and keys that hold both groups, the left one in their upper half."""
    step, which = (np.frombuffer(x.as_buffer(), np.int32) for x in (steps, groups))  # where they lie, without a copy
    left = np.flatnonzero(step[1:] == 1)
    return np.cumsum(step, dtype=np.int32)[left], which[left].astype(np.int64) << 32 | which[left + 1]


def adjacent(relation: DataFrame) -> DataFrame:
    """``(batch, key, places)``: the relation joined with itself at adjacent places, a row for each key of each batch."""
    arrow = pa.schema([("batch", pa.int64()), ("key", pa.int64()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, steps, groups in zip(*[batch.column(c) for c in ("batch", "places", "groups")]):
                places, keys = _pairs(steps, groups)
                keys, runs = _by_group(keys, places)
                yield pa.RecordBatch.from_arrays([pa.repeat(number, len(keys)), pa.array(keys, pa.int64()), runs], schema=arrow)

    return relation.select("batch", "places", "groups").mapInArrow(run, "batch long, key long, places binary")


def grown(relation: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """The relation of the phrases ``frequent(key, id)``: those of ``adjacent`` whose key is there.

    Up to ``most`` keys (12 MB) go to each task, which keeps the pairs that have one; more are joined.
    """
    if frequent.count() > most:
        held = adjacent(relation).join(hinted(frequent).select("key", "id"), "key")
        return sorted_relation(held.select("batch", "id", "places", F.lit(None).cast("binary").alias("groups")))
    table = frequent.select("key", F.col("id").cast("int").alias("id")).toArrow().sort_by("key")
    shared = relation.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "id")))
    arrow = pa.schema([("batch", pa.int64()), ("places", pa.binary()), ("groups", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        for batch in batches:
            for number, steps, groups in zip(*[batch.column(c) for c in ("batch", "places", "groups")]):
                places, keys = _pairs(steps, groups)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                kept = np.flatnonzero(known[at] == keys) if len(known) else at[:0]
                row = [[number.as_py()], [_steps(places[kept])], [ids[at[kept]].astype(np.int32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

    return relation.select("batch", "places", "groups").mapInArrow(run, "batch long, places binary, groups binary")


def sorted_relation(frequent: DataFrame) -> DataFrame:
    """``(batch, places, groups)``: all places of a batch in order, as steps, and the group of each; from rows ``(batch, id, places, groups)`` of the places of one frequent group ``id``, or of steps and several ``groups``."""
    arrow = pa.schema([("batch", pa.int64()), ("places", pa.binary()), ("groups", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        at, which = [], []
        for id_, places, groups in zip(group.column("id").to_pylist(), group.column("places").to_pylist(), group.column("groups").to_pylist()):
            at.append(np.frombuffer(places, np.int32) if groups is None else np.cumsum(np.frombuffer(places, np.int32), dtype=np.int32))
            which.append(np.full(len(places) // 4, id_, np.int32) if groups is None else np.frombuffer(groups, np.int32))
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.argsort(at)
        return pa.Table.from_arrays([group.column("batch").slice(0, 1), pa.array([_steps(at[order])], pa.binary()), pa.array([which[order].tobytes()], pa.binary())], schema=arrow)

    return frequent.select("batch", "id", "places", "groups").groupBy("batch").applyInArrow(run, "batch long, places binary, groups binary")


def _times(places: str = "places") -> Column:
    return F.sum(F.octet_length(places) / 4).cast("long")


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, head: int = HEAD) -> tuple[DataFrame, list[DataFrame]]:
    """How many words each language has, ``(lang, n)``, and for each length the groups that stand ``least`` times: ``(id, lang, words, f, heads, tails, left, right)``.

    ``heads`` and ``tails`` are how often the first and the last 1, 2, ... words of the group stand, itself included; ``left`` and ``right`` are the ids of the group without
    its last and its first word. A group can be frequent only if both of these are, so only frequent groups are joined.
    """
    words = written(word_counts(docs, text, lang), "words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    one = F.array("f")
    frequent = written(placed(words.filter(F.col("f") >= least), "id"), "frequent")
    level = frequent.select("id", "lang", F.array("word").alias("words"), "f", one.alias("heads"), one.alias("tails"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"))
    forget(words)
    found = [level]
    relation = first_relation(docs, frequent, text, lang, head)
    for k in range(2, longest + 1):
        often = adjacent(relation).groupBy("key").agg(_times().alias("f")).filter(F.col("f") >= least)
        numbered = written(placed(often, "id").select("id", "key", "f", F.shiftright("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("right")), f"keys{k}")
        if k < longest:
            longer = written(grown(relation, numbered, 4 * head), f"relation{k}")
            forget(relation)
            relation = longer
        part = lambda side, *columns: found[-1].select(F.col("id").alias(side), *columns)
        left = part("left", "lang", F.col("words").alias("l_words"), F.col("heads").alias("l_heads"))
        right = part("right", F.col("words").alias("r_words"), F.col("tails").alias("r_tails"))
        level = numbered.hint("merge").join(left, "left").hint("merge").join(right, "right").select(
            "id", "lang", F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"), "f", F.concat("l_heads", one).alias("heads"), F.concat("r_tails", one).alias("tails"), "left", "right",
        )
        found.append(written(level, f"group{k}"))
    forget(relation)
    return totals, found


def candidates(found: list[DataFrame], cover: int = COVER) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all phrases of two words or more that no longer one covers.

    Of the phrases that hold another the most frequent ones are a word longer, so only those are asked.
    """
    out = None
    for k, level in enumerate(found[1:], 2):
        if k < len(found):
            longer = found[k].select(F.col("left").alias("id"), F.col("f").alias("m")).unionByName(found[k].select(F.col("right").alias("id"), F.col("f").alias("m")))
            longer = longer.groupBy("id").agg(F.max("m").alias("m"))
            wide = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(3,0)")
            level = level.hint("merge").join(longer, "id", "left").filter(F.col("m").isNull() | (wide("m", 100) < wide("f", cover)))
        cuts = [F.struct(F.col("heads")[i - 1].alias("l"), F.col("tails")[k - i - 1].alias("r"), F.lit(i).alias("k")) for i in range(1, k)]
        scored = F.transform(F.array(*cuts), lambda x: F.struct(_score(F.col("f"), x["l"], x["r"]).alias("score"), x["k"].alias("k"), x["l"].alias("l"), x["r"].alias("r")))
        told = level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(scored).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
        out = told if out is None else out.unionByName(told)
    return out


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) in decimals of 38 digits."""
    return F.call_function("div", F.lit(2000000).cast("decimal(10,0)") * a.cast("decimal(20,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))


def digest(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, head: int = HEAD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A null text is empty, a null language ``und``; repeated rows count each time. Equal scores go by frequency, then by phrase in the order of its bytes. Rows must be the
    same and in the same order if ``docs`` is read again, as files are: batches are told apart by partition and number. A text with more words than a batch is a batch of its own.
    """
    with arrow_batches(docs.sparkSession, AT_ONCE):
        totals, found = mined(docs, least=least, longest=longest, head=head)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = candidates(found, cover).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(hinted(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
