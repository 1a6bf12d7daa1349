"""Benchmark decontamination over a distributed positional inverted index.

Training documents are indexed where they lie, in segments of a few thousand: one row per segment and
term with the positions of the term in the segment, and one row with the segment's documents. Phrases
of the test items are looked up from their rarest term: segments that hold it are found by a join on
terms, and the lists of the phrase's terms, adjusted by their offsets, are intersected there, rarest
first. What is left is exact: all terms stand at consecutive positions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import forget, words_of, written

WINDOW = 10
#: Words around the rarest of a window within which the query seeks all others in any order.
NEAR = 15
#: Words after which a segment is closed. Bounds a task's memory; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 21
#: Test terms that are sent to every task at once (about 64 MB); a larger test set is indexed in several passes.
TERMS_AT_ONCE = 500_000
#: Phrases that are looked up together in a segment; more are divided, each part with the lists that it needs.
ASKED = 100_000
#: Free positions between documents, so that no phrase of up to this many words reaches from one into the next.
GAP = 64
SEGMENTS = "segment string, term binary, n long, docs binary, places binary"
#: The term of the row that lists a segment's documents (no word is empty).
DOCS = b""


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct ``(window_id, words, item_id)``: all runs of ``width`` words, or a shorter item whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item_id"], batch["text"], strict=True):
                words = words_of(body)
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[at : at + width]
                    rows.append((hashlib.md5(b" ".join(part)).hexdigest(), part, item))
            yield pd.DataFrame(rows, columns=["window_id", "words", "item_id"])

    held = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return held.mapInPandas(run, "window_id string, words array<binary>, item_id string").distinct()


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs`` for ``terms(term)``: rows ``(segment, term, n, docs, places)``, written.

    A term's ``places`` are its positions in the segment, ascending (int32); a document's words follow
    one another and documents stand ``GAP`` apart. The row of the empty term has the documents' ids
    (0 and a mark for null), first positions and numbers of words. No row moves between tasks. Texts are read whole; null has
    no words. Terms are sent to the tasks ``TERMS_AT_ONCE`` at a time, so their number is not limited.
    All passes share their segments: these are named by the partition of the input, and several passes
    read one written copy of it, so that each sees the same documents in the same order.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # A column of numbers with nulls would come to Python as floats.
    held = held.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    count = terms.count()
    passes = max(1, -(-count // TERMS_AT_ONCE))
    held = copy = written(held, "texts") if passes > 1 else held
    # Not the task's own number: in a union the tasks of later passes count on from those of earlier ones.
    held = held.withColumn("task", F.spark_partition_id())
    out = None
    for part in range(passes):
        mine = terms if passes == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == part)
        listed = spark.sparkContext.broadcast(sorted(bytes(r["term"]) for r in mine.toLocalIterator()))
        rows = held.mapInPandas(_indexer(listed), SEGMENTS)
        rows = written(rows.filter(F.length("term") > 0) if part else rows, "index")
        listed.destroy()
        out = rows if out is None else out.unionByName(rows)
    if passes > 1:
        forget(copy)
    return out


def _indexer(listed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = listed.value
        number = {t: i for i, t in enumerate(terms)}
        ids, nulls, firsts, sizes, found, places, at, closed, task = [], [], [], [], [], [], 0, 0, None

        def close() -> pd.DataFrame:
            docs = np.array([ids, nulls, firsts, sizes], np.int64).tobytes()
            rows = [(f"{task}-{closed}", DOCS, len(ids), docs, None)]
            if found:
                term, place = np.concatenate(found), np.concatenate(places)
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
                ends = np.r_[starts[1:], len(term)]
                rows += [(f"{task}-{closed}", terms[term[a]], int(b - a), None, place[a:b].astype(np.int32).tobytes()) for a, b in zip(starts, ends, strict=True)]
            return pd.DataFrame(rows, columns=["segment", "term", "n", "docs", "places"])

        for batch in batches:
            if task is None and len(batch):
                task = int(batch["task"].iloc[0])
            for doc, no_id, body in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                words = words_of(body)
                if at and at + len(words) > SEGMENT_WORDS:
                    yield close()
                    closed += 1
                    ids, nulls, firsts, sizes, found, places, at = [], [], [], [], [], [], 0
                got = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                here = np.flatnonzero(got >= 0)
                if len(here):
                    found.append(got[here])
                    places.append(here + at)
                ids.append(doc), nulls.append(no_id)
                firsts.append(at)
                sizes.append(len(words))
                at += len(words) + GAP
        if ids:
            yield close()

    return run


def lookup(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Matches ``(segment, window_id, places)`` of ``phrases(window_id, words)`` in the index.

    With ``slop`` 0, ``places`` are the first positions of exact occurrences. With more, they are the
    places of the phrase's rarest term within ``slop`` words of which all its terms stand in one document, in any order,
    each as often as in the phrase: no word of the text serves for two (proximity). ``slop`` is ``GAP`` at most, since farther off
    the next document begins. Terms must be indexed.
    """
    return _lookup(index, phrases, (slop,))[0].drop("slop")


def _lookup(index: DataFrame, phrases: DataFrame, slops: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """``lookup`` with several slops at once: ``(segment, window_id, places, slop)``, and the written tables that it reads."""
    for slop in slops:
        if not 0 <= slop <= GAP:
            raise ValueError(f"words within {slop} of another may be in the next document; {GAP} is the most")
    stats = index.filter(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("total"))
    used = phrases.select("window_id", "words", F.posexplode("words").alias("at", "term"))
    stats = written(stats, "stats")
    used = used.hint("merge").join(stats, "term", "left")
    ranked = used.groupBy("window_id").agg(
        F.first("words").alias("words"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "at"))).alias("rarest"),
    )
    # A phrase with a term that no document has is nowhere.
    ranked = ranked.filter(F.col("rarest")[0]["total"] > 0).withColumn("order", F.col("rarest")["at"]).withColumn("term", F.expr("words[order[0]]"))
    ranked = written(ranked.select("window_id", "words", "order", "term"), "phrases")
    here = index.filter(F.length("term") > 0).select("segment", "term")
    scratch = [stats, ranked]
    asked = written(here.hint("merge").join(ranked, "term").select("segment", "window_id", "words", "order"), "asked")
    scratch.append(asked)
    most = asked.groupBy("segment").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // ASKED) if most else 1
    lists = index.filter(F.length("term") > 0).select("segment", "term", "places")
    group = ["segment"]
    if parts == 1:
        lists = lists.hint("merge").join(asked.select("segment").distinct(), "segment", "left_semi")
    else:
        group.append("part")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("window_id"), F.lit(parts)).cast("int"))
        needed = written(asked.select("segment", "part", F.explode("words").alias("term")).distinct(), "needed")
        scratch.append(needed)
        lists = lists.hint("merge").join(needed, ["segment", "term"])

    def intersect(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        lists = {bytes(t): np.frombuffer(p, np.int32) for t, p in zip(rows["term"], rows["places"], strict=True)}
        out = []
        for window, words, order in zip(asks["window_id"], asks["words"], asks["order"], strict=True):
            words = [bytes(w) for w in words]
            if any(w not in lists for w in words):
                continue
            for slop in slops:
                starts = lists[words[order[0]]]
                if slop:
                    for word, times in Counter(words).items():
                        first, last = (np.searchsorted(lists[word], starts + by, side) for by, side in ((-slop, "left"), (slop, "right")))
                        starts = starts[last - first >= times]
                else:
                    starts = starts - order[0]
                    for at in order[1:]:
                        if not len(starts):
                            break
                        places = lists[words[at]]
                        found = np.searchsorted(places, starts + at)
                        starts = starts[places[np.minimum(found, len(places) - 1)] == starts + at]
                if len(starts):
                    out.append((key[0], window, starts.astype(np.int64).tobytes(), slop))
        return pd.DataFrame(out, columns=["segment", "window_id", "places", "slop"])

    return lists.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(intersect, "segment string, window_id string, places binary, slop int"), scratch


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, near: int = 0) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, n_near)`` per row of ``docs``: words inside any occurrence of a test window.

    ``items`` are the distinct ids (as strings, sorted) of items with an occurring window. With ``near``, ``n_near`` is the number of items of which some window's
    words all stand within so many words of its rarest one, in any order (``lookup``); else zero. Null texts and texts without words have zeros; null ids stay null, and repeated rows are judged each. No items, no hits.
    """
    if width > GAP:
        raise ValueError(f"a window has {GAP} words at most")
    found = written(windows(items, item_id, item_text, width), "windows")
    terms = written(found.select(F.explode("words").alias("term")).distinct(), "terms")
    index = build_index(docs, terms, doc_id, text)
    phrases = found.select("window_id", "words").distinct()
    matched, scratch = _lookup(index, phrases, (0, near) if near else (0,))
    of = found.groupBy("window_id").agg(F.first(F.size("words")).alias("width"), F.collect_set("item_id").alias("items"))
    matched = written(matched, "matched").hint("merge").join(written(of, "of"), "window_id")
    for done in (*scratch, terms, found):
        forget(done)
    listed = index.filter(F.length("term") == 0).select("segment", "docs")

    def cover(key, docs: pd.DataFrame, matches: pd.DataFrame) -> pd.DataFrame:
        ids, nulls, firsts, sizes = np.frombuffer(b"".join(docs["docs"][:1]), np.int64).reshape(4, -1)
        n_hit, items, around = np.zeros(len(ids), np.int64), [set() for _ in ids], [set() for _ in ids]
        starts, ends = [], []
        for width, names, places, slop in zip(matches["width"], matches["items"], matches["places"], matches["slop"], strict=True):
            at = np.frombuffer(places, np.int64)
            if not slop:
                starts.append(at), ends.append(at + int(width))
            for doc in np.unique(np.searchsorted(firsts, at, "right") - 1):
                (around if slop else items)[doc].update(names)
        if starts:
            start, end = np.concatenate(starts), np.concatenate(ends)
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            covered = end - np.maximum(start, np.r_[start[0], end[:-1]])  # words that no earlier match has
            np.add.at(n_hit, np.searchsorted(firsts, start, "right") - 1, np.maximum(covered, 0))
        ids = pd.array(ids, dtype="Int64")
        ids[nulls == 1] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": sizes, "n_hit": n_hit, "items": [sorted(x) for x in items], "n_near": [len(x) for x in around]})

    return listed.groupBy("segment").cogroup(matched.groupBy("segment")).applyInPandas(cover, "doc_id long, n_words long, n_hit long, items array<string>, n_near long")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of documents, repeated ones each: the words that windows of ``benchmark`` cover, the hash of the items' ids, and the number of items with a window nearby.

    Null and wordless texts have zeros; null ids stay null. An item with a null id counts as one whose windows cover words, but is not
    listed. An empty benchmark covers nothing.
    """
    found = hits(documents, benchmark, near=NEAR)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in whose text any test window occurs; columns as they were.

    Each row is judged by its own text, whatever its id: rows are told apart by a 64-bit hash of the text.
    """
    key = F.xxhash64(F.col(f"`{text}`")).alias("key")
    found = hits(docs.select(key, F.col(f"`{text}`").alias("text")), items, "key")
    dirty = written(found.filter("n_hit > 0").select(F.col("doc_id").alias("dirty")).distinct(), "dirty")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key)
    return marked.join(dirty.hint("merge"), F.col("key") == F.col("dirty"), "left_anti").select("doc.*")
