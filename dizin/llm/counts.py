"""Token counts of whole texts without token ids: each distinct pre-token is tokenised once.

A text is cut wherever no piece of the vocabulary holds the two characters that meet there: no merge can join what lies
on both sides, so the pieces of the parts (pre-tokens) are those of the text. The most frequent pre-tokens, a fixed number, are summed where the texts
lie. The others are joined, by batches of texts: one that several documents hold is one row for each batch, and no key has more rows than there are batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from dizin.llm.common import batches_of, most_frequent, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Tokens beyond which a document is over the limit.
LIMIT = 4096
#: Rows and bytes of text of a batch; a longer text is a batch of its own.
ROWS, BYTES = 4096, 8 << 20
#: Pre-tokens that are tokenised at once; distinct ones that a task counts before it hands them on.
AT_ONCE, HELD = 4096, 1 << 17
#: Pre-tokens whose sizes every task is given, and characters of the longest: 16 MB at most.
HEAD, SHORT = 1 << 18, 16
SPACE = "▁"
#: A text that a model must keep as it is.
PROBE = "ﬁ  ½ é "


class Cuts:
    """Where texts may be cut, by the pieces of a model (a sentencepiece file with byte fallback that does not rewrite texts)."""

    def __init__(self, model: str = MODEL):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        every = range(sp.vocab_size())
        if not any(sp.is_byte(i) for i in every):
            raise ValueError("unknown characters must fall back to bytes")
        if sp.normalize(PROBE).replace(SPACE, " ").lstrip(" ") != PROBE:
            raise ValueError("the model rewrites texts before it cuts them")
        pieces = [sp.id_to_piece(i) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        known = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.joined = np.zeros((len(known) + 1, len(known) + 1), bool)
        for p in pieces:
            at = self.code[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        # A character of no piece stands before what is counted, so that nothing is put before it.
        held = set(known) | set(pieces)
        self.guard = next(c for c in map(chr, range(10, 0x110000)) if c not in held)
        told = sp.encode(self.guard, out_type=str)
        self.first = SPACE if told[0] == SPACE else ""
        self.guarded = len(told)

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text, with spaces as the model writes them."""
        if not text:
            return []
        text = self.first + text.replace(" ", SPACE)
        at = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = (np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    def sizes(self, parts: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        return [len(ids) - self.guarded for ids in self.library.encode([self.guard + p for p in parts], num_threads=1)]


@lru_cache(maxsize=1)
def cuts_of(model: str) -> Cuts:
    """The cuts of a model, made once for each Python worker and not for each task."""
    return Cuts(model)


def dictionary(docs: DataFrame, text: str, model: str = MODEL) -> DataFrame:
    """``(piece, times, n)``: how often each distinct pre-token stands in the texts, and how many tokens it has; it is tokenised once."""
    pieces, sized = "piece string, times long", "piece string, times long, n long"
    arrow = to_arrow_schema(StructType.fromDDL(sized))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, times = cuts_of(model), Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())], names=["piece", "times"])
        for batch in batches:
            for one in batch.column(0):
                times.update(cuts.parts(one.as_py() or ""))
                if len(times) >= HELD:
                    yield told()
                    times.clear()
        yield told()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cuts_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cuts.sizes(part.column(0).to_pylist()), pa.int64())], schema=arrow)

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(seen, pieces).groupBy("piece").agg(F.sum("times").alias("times")).mapInArrow(count, sized)


def common(sizes: DataFrame, head: int = HEAD) -> dict[str, int]:
    """The tokens of the most frequent pre-tokens of a dictionary: ``head`` of them at most, of up to ``SHORT`` characters each, so their size is bounded."""
    return dict(most_frequent(sizes.filter(F.length("piece") <= SHORT), "times", ["piece", "n"], head))


def frequencies(docs: DataFrame, text: str, keep: list[str], known: dict[str, int], model: str = MODEL) -> DataFrame:
    """``(batch, rows, piece, members)``: for each batch of texts one row with its rows, their bytes and their tokens in the ``known`` pre-tokens, and
    one for each of its other pre-tokens, with the place in the batch of the row that holds it (two bytes) once for each time."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    row = StructType([held.schema["row"], StructField("n_bytes", LongType()), StructField("n_known", LongType())])
    schema = StructType().add("batch", LongType()).add("rows", ArrayType(row)).add("piece", StringType()).add("members", BinaryType())
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first, size_of = cuts_of(model), TaskContext.get().partitionId() << 32, shared.value.get
        for number, part in enumerate(batches_of(batches, "text", ROWS, BYTES)):
            texts, found, sums = part.column("text"), {}, []
            for place, one in enumerate(texts):
                parts = cuts.parts(one.as_py() or "")
                sizes = list(map(size_of, parts, repeat(0)))
                sums.append(sum(sizes))
                if 0 in sizes:
                    for piece, n in zip(parts, sizes):
                        if not n:
                            found.setdefault(piece, []).append(place)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            rows = pa.StructArray.from_arrays([part.column("row"), n_bytes, pa.array(sums, pa.int64())], fields=list(arrow.field("rows").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(arrow.field("rows").type)
            batch = first + number
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), lists, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())], schema=arrow)
            members = pa.array([np.array(x, np.uint16).tobytes() for x in found.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(found), pa.int64()), pa.nulls(len(found), arrow.field("rows").type), pa.array(found, pa.string()), members], schema=arrow)

    return held.mapInArrow(run, schema)


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL, head: int = HEAD) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_bytes`` and ``n_tokens`` of each whole text; columns of these names are replaced.

    Each row is counted for itself, repeated rows too; a null text is empty and has no tokens. Very long texts are batches of their own. Texts have the tokens
    that the library gives them whole, without begin, end or other special tokens. The sizes of the ``head`` most frequent pre-tokens go to each
    task, which adds them up where the texts lie; the others are joined, however many there are.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens")]
    sizes = written(dictionary(docs, text, model), "dictionary")
    table = written(frequencies(docs, text, kept, common(sizes, head), model), "frequencies")
    others = table.filter("piece is not null").select("batch", "piece", "members").hint("merge").join(sizes.select("piece", "n"), "piece")
    heads = table.filter("piece is null").select("batch", "rows", "members", F.lit(None).cast("long").alias("n"))
    kind = table.schema["rows"].dataType
    schema = StructType([kind.elementType.fields[0], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    arrow = to_arrow_schema(schema)

    def summed(group: pa.Table) -> pa.Table:
        is_head = pc.is_valid(group.column("rows"))
        rows = group.filter(is_head).column("rows").combine_chunks().flatten()
        parts = group.filter(pc.invert(is_head))
        members = parts.column("members").to_pylist()
        n = np.repeat(parts.column("n").to_numpy(), [len(x) // 2 for x in members])
        total = rows.field(2).to_numpy().copy()
        np.add.at(total, np.frombuffer(b"".join(members), np.uint16), n)
        return pa.Table.from_arrays([rows.field(0), rows.field(1), pa.array(total)], schema=arrow)

    both = others.select("batch", F.lit(None).cast(kind).alias("rows"), "members", "n").unionByName(heads)
    return both.groupBy("batch").applyInArrow(summed, schema).select("row.*", "n_bytes", "n_tokens")


def digest(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row; the rules are those of ``token_counts``."""
    return token_counts(docs, "text", ["doc_id"], model).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
