"""SimHash near-duplicates: pigeonhole blocks, block joins, Hamming verification.

A 64-bit fingerprint is cut into four blocks of 16 bits. If two fingerprints differ in at most two
bits, at most two blocks differ, so at least two of the four agree: each fingerprint is filed under
its six pairs of blocks (32 bits each) and only rows of one file can link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import spaced_words_of, with_judgement, written
from dizin.llm.components import components

BITS, BLOCK, SEED = 64, 16, 42
#: The two blocks that make each file's key, by number from the lowest.
FILES = tuple(combinations(range(BITS // BLOCK), 2))
#: Files with more fingerprints than this are linked by shared neighbours instead of by pairs; both are exact.
PAIRED = 32
#: Shingles that one step of counting bits holds (a longer text takes several).
CHUNK = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is 1 if set in over half of the XXH64 (seed 42) of all word shingles, repeats included.

    A text of fewer words than ``width`` has one shingle, all its words; null and wordless texts give 0.
    """
    words = spaced_words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + width - 1]
        joined = map(b" ".join, zip(*[part[i:] for i in range(width)], strict=False))
        hashes = np.fromiter((digest(x, SEED) for x in joined), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the signed 64-bit fingerprint of ``text``."""

    def signed(body: str | None) -> tuple[int]:
        fp = fingerprint(body, width)
        return (fp - (1 << BITS) if fp >> (BITS - 1) else fp,)

    return with_judgement(docs, text, keep, f"`{out}` long", lambda: signed)


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints of ``fps(fp, node)`` within ``most`` = 2 bits of each other.

    ``fp`` must be distinct. Not each close pair has its own row: within a file of many fingerprints,
    those that share a neighbour (a value one bit away, or themselves) are joined to the smallest of
    them, so the rows stay in proportion to the fingerprints; two values are within two bits exactly
    if they share such a neighbour, so the components are those of all close pairs.
    """
    if most != 2:
        raise ValueError("the blocks are cut for a distance of 2")
    block = lambda i: F.shiftrightunsigned("fp", BLOCK * i).bitwiseAND(F.lit((1 << BLOCK) - 1))
    keys = F.array(*[F.struct(F.lit(n).alias("file"), F.shiftleft(block(i), BLOCK).bitwiseOR(block(j)).alias("key")) for n, (i, j) in enumerate(FILES)])
    filed = written(fps.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.file", "k.key"), "filed")
    sizes = written(filed.groupBy("file", "key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = filed.hint("merge").join(sizes, ["file", "key"])
    shared = written(shared, "shared")
    few = shared.filter(F.col("n") <= PAIRED).select("file", "key", "fp", "node")
    other = few.select("file", "key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    pairs = (
        few.hint("merge").join(other, ["file", "key"])
        .filter("fp < fp2")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most)
        .select(F.col("node").alias("a"), F.col("node2").alias("b"))
    )
    # In a large file the other two blocks may differ: one flipped bit of those gives the shared neighbours.
    flips = F.create_map(*[x for n, pair in enumerate(FILES) for x in (F.lit(n), F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for i in range(4) if i not in pair for b in range(BLOCK * i, BLOCK * i + BLOCK)]))])
    near = shared.filter(F.col("n") > PAIRED).select("fp", "node", F.explode(flips[F.col("file")]).alias("bit"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("bit")).alias("near"), "node").distinct()
    # No value has more than 65 neighbours, so these lists are short.
    balls = near.groupBy("near").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    stars = balls.select(F.array_min("nodes").alias("b"), F.explode("nodes").alias("a")).filter("a <> b").select("a", "b")
    return pairs.unionByName(stars)


def classes(hashed: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``(fp, component_id)`` for each fingerprint in ``hashed``: the smallest id of all that it reaches."""
    fps = written(hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("node")), "fps")
    named = fps.filter("node is not null")
    found = written(components(links(named)), "components")
    joined = fps.hint("merge").join(found, "node", "left")
    return written(joined.select("fp", F.coalesce("component", "node").alias("component_id")), "classes")


def digest(documents: DataFrame) -> DataFrame:
    """Per row of documents: its fingerprint in hex and the smallest doc_id reachable over links.

    Null or wordless texts have fingerprint zero and link like others. Rows with a null doc_id take
    the component of their fingerprint. Repeated rows are returned as often as they occur.
    """
    hashed = written(with_fingerprint(documents, keep=["doc_id"]), "hashed")
    out = hashed.hint("merge").join(classes(hashed), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id (null before all). All columns are kept as they are.

    Each row is judged by its own text, whatever its id. Of rows with the same id in a group, the one with the smallest
    hash of its columns (but maps, which have none) stays, so the result is the same at each run. Texts that are null or
    have no word take no part and are all kept: two empty texts say nothing about each other.
    """
    worded = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    marked = docs.filter(worded).select(doc, F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("id"), row.alias("row"))
    hashed = written(with_fingerprint(marked, keep=["id", "row"]), "hashed")
    fps = hashed.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("first"))
    fps = written(fps.withColumn("at", F.monotonically_increasing_id()), "fps")
    # Ids may be null or repeat, so fingerprints are numbered, without gaps between partitions: components adds numbers up.
    part = F.shiftright("at", 33)
    parts = (fps.agg(F.max(part)).first()[0] or 0) + 1
    fps = fps.select("fp", "first", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) * parts + part).alias("number"))
    found = written(components(links(fps.select("fp", F.col("number").alias("node")))), "components")
    grouped = fps.hint("merge").join(found, F.col("number") == F.col("node"), "left")
    firsts = grouped.groupBy(F.coalesce("component", "number").alias("group")).agg(F.min("first").alias("first"))
    own = lambda c: F.xxhash64(c).alias("own")
    firsts = written(firsts.select(own(F.col("first.id")), F.col("first.row").alias("row")), "firsts")
    # Equal rows become one where they are read; then the documents move once, and are held against the firsts where they then lie.
    one = marked.groupBy(own(F.col("id")), "row").agg(F.first("doc").alias("doc"))
    return one.hint("merge").join(firsts, ["own", "row"]).select("doc.*").unionByName(docs.filter(~worded))
