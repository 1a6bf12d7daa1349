"""Small helpers that several operators share: row keys, shared scratch tables, byte words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dizin.scratch import delete_path, forget, hinted, path_exists, scratch_path, written  # noqa: F401

#: ASCII letters to lower case; everything but 0-9, a-z and bytes over 0x7F to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def spaced_words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_key(text: Column) -> Column:
    """A name for a text's content: SHA-256 of its bytes; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Rows whose texts are Python strings at once.
_SLICE = 512


def with_judgement(docs: DataFrame, text: str, keep: list[str] | None, added: str, prepare: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns ``added`` that a function makes from each whole text.

    ``prepare`` runs once a task and returns that function. The other columns go through Python as they are, in one Arrow
    struct: no value changes (ids beside nulls neither), and no name of theirs can clash. Columns named as those added are replaced.
    """
    new = StructType.fromDDL(added)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([held.schema["row"], *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                told = zip(*[judge(x) for x in part.column("text").to_pylist()], strict=True)
                made = [pa.array(values, f.type) for values, f in zip(told, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=["row", *new.names])

    return held.mapInArrow(run, schema).select("row.*", *[F.col(f"`{c}`") for c in new.names])


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null id: of the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(df: DataFrame, times: str, columns: list[str], head: int) -> list:
    """Rows (their ``columns``) of the highest ``times``, ``head`` of them at most: all from some frequency on, so what is collected is bounded by ``head``.

    How frequent they must be is told by the numbers of rows at each level of frequency, sixteen to each doubling.
    """
    levelled = df.withColumn("__level", F.floor(F.log2(times) * 16))
    least, total = None, 0
    for level, n in levelled.groupBy("__level").agg(F.count("*")).orderBy(F.desc("__level")).collect():  # a thousand rows at most
        total += n
        if total > head:
            break
        least = level
    return [] if least is None else levelled.filter(F.col("__level") >= least).select(*columns).collect()


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run within hand at most about ``size`` bytes at once to a Python function: for rows that are large, so few of them are in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(batches: Iterator[pa.RecordBatch], text: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of up to ``rows`` rows and about ``size`` bytes of text; a longer text is in a piece of its own."""
    for batch in batches:
        lengths = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
        start, total = 0, 0
        for at, n in enumerate(lengths):
            if at > start and (at - start >= rows or total + n > size):
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
