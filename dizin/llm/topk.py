"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. A block of vectors is stored by attribute and bit: one bitmap per
bit of each attribute, one bit per vector. For a query, the bitmaps are added with carry-save adders
into the bitmaps of all scores of the block at once; the best rows are then read off from the most
significant score bitmap downward, and rows that tie at the boundary are told apart by their ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dizin.llm.common import written

SCALE, K = 64, 20
#: Vectors of a block, and the most queries that are sent to a block together: a block moves once for so many.
BLOCK, PACK = 1 << 16, 1 << 13
BLOCKS = "block_part int, block_dims int, ids binary, rows binary, least string, widths binary, slices binary"
#: What stands for the id of a row without one.
NO_ID = (1 << 63) - 1
PACKS = "pack_part int, dims int, ids binary, rows binary, vectors binary"


def sound(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, x, row)``, written: the vectors that take part, and a number that tells rows apart.

    Vectors that are null or have a null or non-finite component take no part. A row without an id does, as a candidate: it comes after all ids (``NO_ID``), and its number is negative.
    """
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    held = vectors.filter(F.col(embedding).isNotNull()).filter(finite)
    held = held.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("n"))
    return written(held.select(F.coalesce("id", F.lit(NO_ID)).alias("vec_id"), "x", F.when(F.col("id").isNull(), -1 - F.col("n")).otherwise(F.col("n")).alias("row")), "vectors")


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The floors of ``scale`` times each component: long integers, or Python's where a component has more than 60 bits."""
    if not vectors.size or np.abs(vectors).max() < 2.0**60 / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def sortable(score: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    size = (score.bit_length() + 7) // 8
    digits = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\2" + digits if score >= 0 else b"\1" + bytes(255 - x for x in digits)


def _matrices(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to ``most`` vectors of one length at a time: ids, row numbers, matrix; ordered by id."""
    held: dict[int, list] = {}

    def take(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, rows, xs = zip(*sorted(held.pop(dims), key=lambda v: (v[0], v[1] < 0, v[1])), strict=True)
        return np.array(ids, np.int64), np.array(rows, np.int64), np.array(xs, np.float64).reshape(len(ids), dims)

    for batch in batches:
        for vec, x, row in zip(batch["vec_id"], batch["x"], batch["row"], strict=True):
            own = held.setdefault(len(x), [])
            own.append((vec, row, x))
            if len(own) == most:
                yield take(len(x))
    for dims in sorted(held):
        yield take(dims)


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The bit-sliced index of ``sound`` vectors, written: one row per block and vector length."""
    parts = max(1, -(-vectors.count() // block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for ids, rows, xs in _matrices(batches, block):
            matrix = quantised(xs)
            dims = matrix.shape[1]
            least = matrix.min(axis=0) if dims else np.zeros(0, np.int64)
            above = matrix - least
            widths = np.array([int(x).bit_length() for x in above.max(axis=0)] if dims else [], np.int64)
            slices = []
            for j in range(dims):
                for b in range(widths[j]):
                    packed = np.packbits(((above[:, j] >> b) & 1).astype(np.uint8), bitorder="little")
                    slices.append(np.pad(packed, (0, -len(packed) % 8)).tobytes())
            row = (task, dims, ids.tobytes(), rows.tobytes(), json.dumps([int(x) for x in least]), widths.tobytes(), b"".join(slices))
            yield pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return written(vectors.repartition(parts).mapInPandas(run, BLOCKS), "blocks")


def pack_queries(queries: DataFrame, size: int) -> DataFrame:
    """``sound`` queries, about ``size`` to a row, written."""
    parts = max(1, -(-queries.count() // size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for ids, rows, xs in _matrices(batches, 2 * size):
            yield pd.DataFrame([(task, xs.shape[1], ids.tobytes(), rows.tobytes(), xs.tobytes())], columns=[c.split()[0] for c in PACKS.split(", ")])

    return written(queries.repartition(parts).mapInPandas(run, PACKS), "packs")


class Block:
    """The bitmaps of a block."""

    def __init__(self, ids: bytes, rows: bytes, least: str, widths: bytes, slices: bytes):
        self.ids, self.numbers, self.widths = (np.frombuffer(x, np.int64) for x in (ids, rows, widths))
        self.least = json.loads(least)
        self.n, self.words = len(self.ids), -(-len(self.ids) // 64)
        self.bits = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        self.nots = ~self.bits
        self.first = np.r_[0, np.cumsum(self.widths)]
        rows = np.zeros(self.words * 64, np.uint8)
        rows[: self.n] = 1
        self.all = np.packbits(rows, bitorder="little").view(np.uint64)

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores by weight, and the constant that they leave out.

        A negative factor times x is the positive factor times the inverted bits of x, less a constant.
        """
        base = sum(q * x for q, x in zip(query, self.least, strict=True))
        piles: list[list[np.ndarray]] = [[]]
        for j, factor in enumerate(query):
            bits = self.bits
            if factor < 0:
                factor = -factor
                bits = self.nots
                base -= factor * ((1 << int(self.widths[j])) - 1)
            at = 0
            while factor >> at:
                if factor >> at & 1:
                    for b in range(int(self.widths[j])):
                        while len(piles) <= at + b:
                            piles.append([])
                        piles[at + b].append(bits[self.first[j] + b])
                at += 1
        out, weight = [], 0
        while weight < len(piles):
            pile = piles[weight]
            if len(pile) > 1 and weight + 1 == len(piles):
                piles.append([])
            at = 0
            while len(pile) - at > 2:  # three bitmaps of one weight make one, and a carry
                a, b, c = pile[at : at + 3]
                at += 3
                t = a ^ b
                carry = t & c
                carry |= a & b
                t ^= c
                pile.append(t)
                piles[weight + 1].append(carry)
            if len(pile) - at == 2:
                a, b = pile[at:]
                piles[weight + 1].append(a & b)
                out.append(a ^ b)
            else:
                out.append(pile[at] if pile else np.zeros(self.words, np.uint64))
            weight += 1
        return out, base

    def best(self, query: list[int], own: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids, numbers and scores of the k best rows but the one with the id and number ``own``, ties to smaller ids."""
        sums, base = self.scores(query)
        good, even = np.zeros(self.words, np.uint64), self.all.copy()
        for at in range(np.searchsorted(self.ids, own[0]), np.searchsorted(self.ids, own[0], "right")):
            if self.numbers[at] == own[1]:
                even[at >> 6] &= ~np.uint64(1 << (at & 63))
        for bitmap in reversed(sums):
            more = even & bitmap
            count = int(np.bitwise_count(good).sum() + np.bitwise_count(more).sum())
            if count > k:
                even = more
            else:
                good |= more
                even &= ~bitmap
                if count == k:
                    even[:] = 0
                    break
        rows = self.rows(good)
        rows = np.r_[rows, self.rows(even)[: k - len(rows)]]
        score = np.full(len(rows), base, object)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for weight, bitmap in enumerate(sums):
            score += ((bitmap[word] >> bit) & np.uint64(1)).astype(object) << weight
        return self.ids[rows], self.numbers[rows], score.tolist()

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return words[at] * 64 + bit


#: Scores beyond a long are returned as the nearest long.
_LONG = 1 << 63


def search(index: DataFrame, packs: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest scores of each query, ties to the smaller id, rows without an id last of them.

    The query's own row is no candidate; another row with its id is. Only vectors of the query's length are candidates.
    With fewer than k, all are returned. Each query row has its own list, so a repeated query has its list as often. Ranks
    are by exact scores of any size; a score beyond a long is returned as the nearest long. Each block meets each pack of
    queries in a task of its own.
    """
    parts = [df.agg(F.max(c)).first()[0] or 0 for df, c in ((index, "block_part"), (packs, "pack_part"))]
    spread = index.withColumn("pack_part", F.explode(F.sequence(F.lit(0), F.lit(parts[1]))))
    pairs = packs.withColumn("block_part", F.explode(F.sequence(F.lit(0), F.lit(parts[0]))))
    names = ["query_row", "query_id", "no_id", "vec_id", "score", "exact"]

    def run(key, blocks: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples(index=False):
            held = Block(b.ids, b.rows, b.least, b.widths, b.slices)
            for p in packs[packs["dims"] == b.block_dims].itertuples(index=False):
                ids, rows = (np.frombuffer(x, np.int64).tolist() for x in (p.ids, p.rows))
                queries = quantised(np.frombuffer(p.vectors, np.float64).reshape(len(ids), p.dims)).tolist()
                for own, row, query in zip(ids, rows, queries, strict=True):
                    vec, number, score = held.best(query, (own, row), k)
                    out += [(row, own, n < 0, v, max(-_LONG, min(_LONG - 1, x)), sortable(x)) for v, n, x in zip(vec.tolist(), number.tolist(), score, strict=True)]
        return pd.DataFrame(out, columns=names)

    met = spread.groupBy("block_part", "pack_part").cogroup(pairs.groupBy("block_part", "pack_part"))
    met = met.applyInPandas(run, "query_row long, query_id long, no_id boolean, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("exact"), "no_id", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")


def digest(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by ``every``, among all vectors. No vectors, no rows.

    Packs hold 256 to ``PACK`` queries: as many as leave each core some pairs of block and pack.
    """
    vectors = sound(embeddings)
    index = build_index(vectors)
    queries = vectors.filter((F.col("row") >= 0) & (F.col("vec_id") % every == 0))
    tasks = 4 * embeddings.sparkSession.sparkContext.defaultParallelism
    return search(index, pack_queries(queries, min(PACK, max(256, queries.count() * index.count() // tasks))))
