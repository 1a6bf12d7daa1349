"""Repeated substrings across a corpus: prefix doubling from sampled positions.

A string of ``least`` bytes is repeated if it starts at two places. Ranking the suffixes at all bytes of a corpus by doubling
takes a sort of all bytes a round, so ranks start at positions sampled by content (winnowing): in each window of ``least``
bytes the position whose ``gram`` bytes have the smallest hash is the window's anchor. Equal windows have equal anchors, at
the same offset, so no repeat is missed, and windows of one anchor are decided together:

1. anchors are ranked by their own ``gram`` bytes; an anchor whose rank is unique ends, and with it all windows that chose it;
2. anchors whose windows are the same byte for byte count as one, and are repeated at once;
3. the others are doubled. A row is a rank and an interval of offsets: the rank names the bytes that all windows of the
   interval share, ``gram`` at first, when the interval is all offsets. A round halves the interval; the windows of a half share
   128, 64, ... 1 bytes more, to the right of what is ranked or to its left. Spark sorts the pairs of rank and added bytes and
   ranks them anew. Rows whose new rank is unique end, and so do those past the threshold: in the last round what is
   ranked has ``least`` bytes, and whatever is not unique is repeated. Rows of a rank that are equal in all their windows
   are repeated at once and go on as one.

Ranks are made from bytes, so strings of one rank are equal. Hashes only propose: anchors by 64 bits, and 128 bits of
BLAKE2b name the windows of an anchor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import forget, written

#: Bytes of a repeated string.
LEAST = 400


def gram_of(least: int) -> int:
    """Bytes of an anchor's own string: ``least`` less the offsets of an anchor and one. Doubling halves these, so they are a power of two, about two thirds of ``least``."""
    if least < 4:
        raise ValueError("strings of fewer than 4 bytes have no offsets to double")
    return least - (1 << int(math.log2(0.65 * least))) + 1


GRAM = gram_of(LEAST)
#: Bytes that are hashed in one step: a task's working arrays are some ten times as large.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes (modulo 2**64) of all substrings of one length; equal strings have equal hashes anywhere."""

    def __init__(self, span: int = STEP + 2 * LEAST):
        self.up, self.down = _powers(_BASE, span), _powers(pow(_BASE, -1, 1 << 64), span)

    def windows(self, body: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_VALUES[body] * self.up[: len(body)], out=sums[1:])
        h = sums[size:] - sums[:-size]
        h *= self.down[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def _least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(hashes: Hashes, body: np.ndarray, ends: np.ndarray, least: int, gram: int) -> Iterator[np.ndarray]:
    """Rows of: anchor positions, ascending; the hashes of their bytes; the first and the last window of each.

    A window is named by its start and belongs to the anchor that it chose; of positions with the same hash it chooses the
    first. ``body`` holds documents that end at ``ends``; windows lie within a document.
    """
    width, mask = least - gram + 1, np.uint64((1 << 21) - 1)
    held = None
    for at in range(0, len(body) - least + 1, STEP):
        h = hashes.windows(body[at : at + STEP + least - 1], gram)
        keys = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        best = (_least_in(keys, width) & mask).astype(np.int64)
        start = np.arange(at, at + len(best))
        inside = start + least <= ends[np.searchsorted(ends, start, "right")]
        best, start = best[inside], start[inside]
        if not len(best):
            continue
        new = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        rows = np.array([best[new] + at, h[best[new]].view(np.int64), start[new], start[np.r_[new[1:], len(best)] - 1]])
        if held is not None:
            if held[0, -1] == rows[0, 0]:
                held[3, -1] = rows[3, 0]
                rows = rows[:, 1:]
            yield held
        held = rows if rows.shape[1] else None
    if held is not None:
        yield held


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, one after another, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, cuts, values = column.buffers()
    cuts = np.frombuffer(cuts, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return body[cuts[0] : cuts[-1]], cuts - cuts[0]


SAMPLED = "k1 long, k2 long, pos int, gram long, c1 long, c2 long, low short, high short"
_SAMPLED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("low", pa.int16()), ("high", pa.int16())])


def sample(keyed: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per anchor of the texts of ``keyed(k1, k2, text)`` that have at least ``least`` bytes.

    ``pos`` is the anchor's byte position, ``gram`` the hash of its bytes. The windows that chose it start ``low`` to ``high``
    bytes before it; ``(c1, c2)`` names all their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(STEP + 2 * least)
        for batch in batches:
            if not batch.num_rows:
                continue
            body, cuts = _bytes_of(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            raw = memoryview(body)
            for pos, grams, first, last in anchors(hashes, body, cuts[1:], least, gram):
                names = b"".join([hashlib.blake2b(raw[a : b + least], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                c1, c2 = np.frombuffer(names, "<i8").reshape(-1, 2).T
                doc = np.searchsorted(cuts, pos, "right") - 1
                columns = [*(k[doc] for k in keys), pos - cuts[doc], grams, c1, c2, pos - last, pos - first]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.type.to_pandas_dtype())) for c, t in zip(columns, _SAMPLED, strict=True)], schema=_SAMPLED)

    return keyed.select("k1", "k2", "text").mapInArrow(run, SAMPLED)


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """``(k1, k2, text)``: each text once. Copies meet in the tasks that read them first, so a text that a third of all rows have moves no more than others."""
    return keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))


PIECES = "gram long, c1 long, c2 long, n int, low int, high int, own binary, left binary, right binary"


def cut_pieces(keyed: DataFrame, wanted: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``wanted(k1, k2, pos, gram, c1, c2, n, low, high)`` with the bytes of each anchor, and of its windows to the left and to the right of it."""
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "gram", "c1", "c2", "n", "low", "high")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            body, cuts = _bytes_of(batch.column("text"))
            raw = body.tobytes()
            rows = []
            for at, asks in zip(cuts.tolist(), batch.column("asked").to_pylist(), strict=False):
                for x in asks:
                    a = at + x["pos"]
                    rows.append((x["gram"], x["c1"], x["c2"], x["n"], x["low"], x["high"], raw[a : a + gram], raw[a - x["high"] : a], raw[a + gram : a + least - x["low"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    joined = distinct_texts(keyed).hint("merge").join(asked, ["k1", "k2"]).select("text", "asked")
    return joined.mapInArrow(run, PIECES)


def ranked(pairs: DataFrame) -> DataFrame:
    """``(rank, piece, new_rank)`` of the pairs whose rows must go on: not unique, and not all of them known to be repeated. In sort order.

    Only distinct pairs are sorted, so a pair that a third of all rows share weighs no more than others.
    """
    several = pairs.groupBy("rank", "piece").agg(F.count("*").alias("rows"), F.min("n").alias("least")).filter("rows > 1 and least = 1").select("rank", "piece")
    return written(several.repartitionByRange("rank", "piece").sortWithinPartitions("rank", "piece").withColumn("new_rank", F.monotonically_increasing_id()), "ranks")


def _part(column: str, start: Column | int, size: Column | int) -> Column:
    """``size`` bytes of a binary column from ``start``, counted from 0."""
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(F.col(column), wrap(start) + 1, wrap(size))


def halved(rows: DataFrame, half: int, first: bool) -> DataFrame:
    """The two halves of each row's interval of offsets, where the row has windows in them.

    A row has windows at offsets ``low`` to ``high`` of its interval, which begins at ``at`` and has ``2 * half`` offsets.
    ``left`` and ``right`` are the bytes of these windows that are not ranked yet. Windows at the lower offsets start
    nearer to the anchor and share ``half`` more bytes to the right of what is ranked, those at the upper ones to its left:
    these are the ``piece``. Its first byte tells the sides apart; in the first round the anchor's own bytes follow it.
    """
    own = F.col("own") if first else F.lit(b"")
    at, middle, length = F.col("at"), F.col("at") + half, F.length("left")
    high, low = F.least(F.col("high"), middle - 1), F.greatest(F.col("low"), middle)
    lower = F.struct(
        F.concat(F.lit(b"R"), own, _part("right", 0, half)).alias("piece"), at.alias("at"), F.col("low").alias("low"), high.alias("high"),
        _part("left", length - (high - at), high - at).alias("left"), _part("right", half, F.length("right")).alias("right"),
    )
    upper = F.struct(
        F.concat(F.lit(b"L"), own, _part("left", length - half, half)).alias("piece"), middle.alias("at"), low.alias("low"), F.col("high").alias("high"),
        _part("left", 0, length - half).alias("left"), _part("right", 0, at + 2 * half - 1 - low).alias("right"),
    )
    both = F.array_compact(F.array(F.when(F.col("low") < middle, lower), F.when(F.col("high") >= middle, upper)))
    return rows.select("rank", "gram", "c1", "c2", "n", F.explode(both).alias("x")).select("rank", "gram", "c1", "c2", "n", "x.*")


FOUND = ("c1", "c2", "low", "high")


def double(pieces: DataFrame, least: int = LEAST, gram: int = GRAM) -> list[DataFrame]:
    """Tables ``(c1, c2, low, high)`` of repeated windows of ``pieces``, by offset: what each round of doubling finds.

    ``n`` over 1 says that a row's windows are known to be repeated; such rows only serve to find others'.
    """
    half, found = (least - gram + 1) // 2, []
    children = written(halved(pieces.withColumn("rank", F.col("gram")).withColumn("at", F.lit(0)), half, True), "halves")
    same = ["rank", "piece", "at", "low", "high", "left", "right"]
    while True:
        classes = children.groupBy(*same).agg(F.sum("n").alias("n"), F.count("*").alias("members"), F.min(F.struct("gram", "c1", "c2")).alias("one"))
        classes = written(classes.withColumn("n", F.least("n", F.lit(2)).cast("int")), "classes")
        again = classes.filter("members > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
        equal = children.filter("n = 1").hint("merge").join(again, [F.col(c) == F.col(f"_{c}") for c in same], "left_semi")
        found.append(written(equal.select(*FOUND), "found"))
        forget(children)
        half //= 2
        if not half:
            forget(classes)
            return found
        ranks = ranked(classes)
        rows = classes.hint("merge").join(ranks, ["rank", "piece"]).select(F.col("new_rank").alias("rank"), "one.*", "n", "at", "low", "high", "left", "right")
        children = written(halved(rows, half, False), "halves")
        forget(classes), forget(ranks)
        if children.isEmpty():
            return found


def repeated_ranges(keyed: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``(k1, k2, ranges)`` of ``keyed(k1, k2, text)``: byte ranges ``[start, end)`` that repeated strings cover, in any order.

    The keys name texts; a text in several rows is repeated. Ranges may overlap.
    """
    offsets = least - gram + 1
    if gram < 1 or offsets < 2 or offsets & (offsets - 1):
        raise ValueError(f"{offsets} offsets of an anchor are no power of two")
    sampled = written(sample(keyed, least, gram), "anchors")
    contexts = sampled.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "low", "high")).alias("one"))
    grams = contexts.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("contexts")).filter(F.col("all") > 1)
    contexts = contexts.hint("merge").join(grams, "gram").select("gram", "c1", "c2", F.least("n", F.lit(2)).cast("int").alias("n"), "contexts", "one.*")
    contexts = written(contexts, "contexts")
    pieces = written(cut_pieces(keyed, contexts.filter("contexts > 1"), least, gram), "pieces")
    each_found = double(pieces, least, gram)
    forget(pieces)
    found = contexts.filter("n > 1").select(*FOUND)
    for more in each_found:
        found = found.unionByName(more)
    # All windows of an anchor hold it, so they cover one run of bytes, from the farthest on.
    found = written(found.groupBy("c1", "c2").agg(F.min("low").alias("least"), F.max("high").alias("most")), "found")
    covered = sampled.hint("merge").join(found, ["c1", "c2"]).select("k1", "k2", F.struct((F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + least).alias("end")).alias("r"))
    # A set: copies of a text bring the same ranges.
    ranges = written(covered.groupBy("k1", "k2").agg(F.collect_set("r").alias("ranges")), "ranges")
    for done in (sampled, contexts, found, *each_found):
        forget(done)
    return ranges


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def with_key(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, two numbers (120 bits of SHA-256) that name the text, and the text (null: empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    part = lambda at: F.conv(F.substring(F.sha2(body, 256), at, 15), 16, 10).cast("long")
    return docs.select(*keep, part(1).alias("k1"), part(16).alias("k2"), body.alias("text"))


KEPT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: its bytes, how many of them repeated strings cover, in how many runs, and the hash of the rest.

    Null texts are empty; texts of fewer than ``least`` bytes keep all. Rows with equal texts are copies of one another,
    whatever their ids, and have the same result; null and repeated ids are returned as they are. An empty table gives none.
    """
    keyed = with_key(documents, "text", F.col("doc_id").cast("long").alias("doc_id"))
    ranges = repeated_ranges(keyed, least, gram_of(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            body, cuts = _bytes_of(batch.column("text"))
            raw = memoryview(body)
            out = []
            for n, given in enumerate(batch.column("ranges").to_pylist()):
                own, at, kept = raw[cuts[n] : cuts[n + 1]], 0, hashlib.sha256()
                runs = united([(r["start"], r["end"]) for r in given or ()])
                for start, end in runs:
                    kept.update(own[at:start])
                    at = end
                kept.update(own[at:])
                out.append((len(own), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *made], names=[c.split()[0] for c in KEPT.split(", ")])

    joined = distinct_texts(keyed).hint("merge").join(ranges, ["k1", "k2"], "left")
    told = written(joined.mapInArrow(run, KEPT), "told")
    return keyed.select("doc_id", "k1", "k2").hint("merge").join(told, ["k1", "k2"]).drop("k1", "k2")


def brute(texts: list[str | None], least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """What ``digest`` gives for these texts, the plain way."""
    bodies, seen = [(t or "").encode() for t in texts], {}
    for b in bodies:
        for i in range(len(b) - least + 1):
            seen[b[i : i + least]] = seen.get(b[i : i + least], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out
