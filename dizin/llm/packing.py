"""Token ids packed into fixed-length rows: best-fit decreasing with a segment tree over capacities.

Documents are tokenised and packed where they lie, a bounded number of tokens at a time, so no row
moves between tasks. A document longer than a row is split without loss. Pieces are placed in
decreasing length, each in the fullest row that still holds it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tokens of a row; tokens that are packed together at once (bounds a task's memory: 64 MB of ids).
LENGTH, GROUP = 2048, 1 << 24
#: Fixed values of the public byte-level vocabulary: its pattern, and the id that is free for the end of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts are handed to the tokeniser in parts of about this many characters, cut where its pattern cuts anyway.
PART = 1 << 20
PACKED = (
    "pack_id string, n_tokens int, n_pad int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>, ends array<boolean>"
)


def load(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokeniser of a vocabulary file of ``token rank`` lines (tokens in base 64)."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(tokeniser: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of the whole text. Long texts are cut before a space that follows a letter, where tokens end anyway."""
    parts, at = [], 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        parts.append(np.array(tokeniser.encode_ordinary(text[at:end]), np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Capacities:
    """Segment tree over free capacities 0..length: the smallest that is at least what is asked, and its rows."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """``(capacity, row)`` of the tightest row with ``least`` free, which leaves the tree; None if none has."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.rows[capacity].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: pieces by decreasing size (ties by number), each in the tightest row that holds it."""
    free, rows = Capacities(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = free.take(sizes[piece])
        if got is None:
            got = (length, len(rows))
            rows.append([])
        capacity, row = got
        rows[row].append(piece)
        if capacity > sizes[piece]:
            free.add(capacity - sizes[piece], row)
    return rows


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, group: int = GROUP, end: int = END) -> DataFrame:
    """Rows of at most ``length`` ids, padded to it, holding all of ``docs``.

    Each text's ids are followed by ``end``. ``input_ids`` is one row of the id matrix, little-endian
    int32, padded with ``end``; ``cu_seqlens`` are the cumulative lengths of its segments, from 0;
    ``position_ids`` (little-endian int32) count from 0 in each segment and in the padding. Segment i
    is the ids of ``doc_ids[i]`` from token ``starts[i]``, and ``ends[i]`` tells if the document ends
    there, so the pieces of a split document can be joined again. A null or empty text is its end
    token alone; a null id is kept as null. Equal rows are packed as often as they occur. ``pack_id``
    is unique in a result. The vocabulary file must lie at the same place on all executors.
    """
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    arrow = to_arrow_schema(StructType.fromDDL(PACKED))

    def flush(name: str, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        pieces = [(doc, at, min(at + length, len(t)), t) for doc, t in zip(ids, tokens, strict=True) for at in range(0, len(t), length)]
        out = []
        for n, row in enumerate(best_fit([b - a for _, a, b, _ in pieces], length)):
            cuts = np.cumsum([0] + [pieces[i][2] - pieces[i][1] for i in row])
            used = int(cuts[-1])
            matrix = np.full(length, end, "<i4")
            matrix[:used] = np.concatenate([pieces[i][3][pieces[i][1] : pieces[i][2]] for i in row])
            steps = np.zeros(length + 1, np.int64)
            steps[cuts] = cuts
            position = (np.arange(length) - np.maximum.accumulate(steps[:length])).astype("<i4")
            out.append((
                f"{name}-{n}", used, length - used, matrix.tobytes(), cuts.tolist(), position.tobytes(),
                [pieces[i][0] for i in row], [pieces[i][1] for i in row], [pieces[i][2] == len(pieces[i][3]) for i in row],
            ))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser, task = load(vocabulary), TaskContext.get().partitionId()
        ids, tokens, held, groups = [], [], 0, 0
        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = np.append(encode(tokeniser, body.as_py() or ""), np.int32(end))
                ids.append(doc)
                tokens.append(got)
                held += len(got)
                if held >= group:
                    yield flush(f"{task}-{groups}", ids, tokens)
                    ids, tokens, held, groups = [], [], 0, groups + 1
        if ids:
            yield flush(f"{task}-{groups}", ids, tokens)

    return held.mapInArrow(run, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """``(doc_id, start, is_end, ids)``, one row per segment, ids as little-endian int32: what ``pack`` was given."""
    seg = packed.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts", "ends")).alias("i", "s"))
    first, last = F.element_at("cu_seqlens", F.col("i") + 1), F.element_at("cu_seqlens", F.col("i") + 2)
    ids = F.col("input_ids").substr(first * 4 + 1, (last - first) * 4)
    return seg.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.col("s.ends").alias("is_end"), ids.alias("ids"))
