"""Spelling variants: words one edit apart, found over a reduced alphabet and verified on the words themselves.

Letters are hashed to a few symbols. Words one edit apart have reduced words that are equal or one edit apart, so the whole neighbourhood of each
reduced word is generated and joined with the reduced vocabulary; what meets is verified on the words. Symbols are dealt to letters by how often these
stand, and there are as many as make a reduced word of the shortest length rarer than the vocabulary is large, so a reduced word stands for few words however
many there are; the result does not depend on them. Texts are read once, for the vocabulary; all the rest grows with that.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import forget, hinted, written

#: Letters of words; A-Z alone are brought to lower case.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A run whose checksum with its document's id this divides loses a letter; code points and occurrences of a word; times that a form is as frequent.
DROPS, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
#: Symbols of the reduced alphabet at least.
SYMBOLS = 4
#: Words of a task's own counts before they are handed on; rows of neighbours that are made at once.
HELD, MADE = 1 << 19, 1 << 20
#: An odd factor and a start, by which reduced words are named.
FACTOR, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def words_in(text: str | None, doc: str) -> Iterator[tuple[str, int]]:
    """The words of a text of ``SHORTEST`` letters at least, after the dropping of letters, with how often each stands."""
    known = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(x for x in RUN.findall(text.translate(LOWER)) if len(x) >= SHORTEST).items() if text else ():
        h = zlib.crc32(run.encode(), known)
        if h % DROPS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            yield run, n


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(word, n)`` of all words that stand ``LEAST`` times."""
    held = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, one in zip(batch.column("doc").to_pylist(), batch.column("text")):
                for word, n in words_in(one.as_py(), doc):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield told()
                    counts.clear()
        yield told()

    return held.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def alphabet(words: DataFrame) -> dict[str, int]:
    """A symbol for each letter: the next most frequent letter goes to the symbol that has been dealt the fewest occurrences. One row per letter is collected."""
    size = words.count()
    symbols = max(SYMBOLS, math.ceil(max(size, 1) ** (1 / SHORTEST)))
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "letter").collect()
    dealt, out = [0] * symbols, {}
    for letter, n in letters:
        lightest = dealt.index(min(dealt))
        out[letter] = lightest + 1
        dealt[lightest] += n
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, FACTOR, np.uint64)], dtype=np.uint64)


class Reduced:
    """Words over the reduced alphabet, named by 64 bits; equal names of unequal words cost a comparison, no more."""

    def __init__(self, symbol_of: dict[str, int]):
        self.n = max(symbol_of.values(), default=1)
        self.table = np.zeros(256, np.uint64)
        for letter, symbol in symbol_of.items():
            self.table[ord(letter)] = symbol

    def symbols(self, word: str) -> np.ndarray:
        return self.table[np.frombuffer(word.encode("latin-1"), np.uint8)]

    def name(self, symbols: np.ndarray) -> np.ndarray:
        """The name of each row of symbols."""
        power = _powers(symbols.shape[-1])
        return (symbols * power[:-1]).sum(-1, dtype=np.uint64) + power[-1:] * np.uint64(START)

    def neighbours(self, s: np.ndarray) -> np.ndarray:
        """For rows of symbols of one length: the names of each row itself and of all that one insertion, deletion or replacement makes of it."""
        rows, size = s.shape
        power, every = _powers(size + 1), np.arange(1, self.n + 1, dtype=np.uint64)
        part = s * power[:size]
        head = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(part, axis=1, dtype=np.uint64)], axis=1)  # of the first i symbols
        tail = head[:, -1:] - head  # of those from i on
        end = np.uint64(START)
        whole = head[:, -1:] + power[size : size + 1] * end
        replaced = (whole - part)[:, :, None] + (every[None, None, :] * power[None, :size, None])
        inserted = (head + tail * np.uint64(FACTOR) + power[size + 1 :] * end)[:, :, None] + every[None, None, :] * power[None, : size + 1, None]
        inverse = np.uint64(pow(FACTOR, -1, 1 << 64))
        deleted = head[:, :-1] + tail[:, 1:] * inverse + power[size - 1 : size] * end
        return np.concatenate([whole, replaced.reshape(rows, -1), inserted.reshape(rows, -1), deleted], axis=1)


def reduced(words: DataFrame, symbol_of: dict[str, int]) -> DataFrame:
    """``(word, n, key)``: words with the names of their reduced words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Reduced(symbol_of)
        for batch in batches:
            keys = np.array([made.name(made.symbols(w))[0] for w in batch.column("word").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys, pa.int64())], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def neighbourhoods(words: DataFrame, symbol_of: dict[str, int]) -> DataFrame:
    """``(key, near)``: for each reduced word of ``words(key, word)``, given by any word that has it, the names of its whole one-edit neighbourhood, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Reduced(symbol_of)
        for batch in batches:
            lengths: dict[int, list[tuple[int, str]]] = {}
            for key, word in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist()):
                lengths.setdefault(len(word), []).append((key, word))
            for size, of_size in lengths.items():
                step = max(1, MADE // (2 * (size + 1) * (made.n + 1)))
                for at in range(0, len(of_size), step):
                    part = of_size[at : at + step]
                    near = made.neighbours(np.stack([made.symbols(w) for _, w in part]))
                    # A neighbour that several edits give is listed once.
                    near.sort(axis=1)
                    new = np.concatenate([np.ones((len(part), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                    keys = np.repeat(np.array([k for k, _ in part], np.int64), new.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(near[new].view(np.int64), pa.int64())], names=["key", "near"])

    return words.select("key", "word").mapInArrow(run, "key long, near long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: all pairs of words of ``vocabulary(word, n)`` one edit apart, in both orders."""
    symbol_of = alphabet(vocabulary)
    words = written(reduced(vocabulary, symbol_of), "reduced")
    kinds = written(words.groupBy("key").agg(F.min("word").alias("word")), "kinds")
    met = written(neighbourhoods(kinds, symbol_of).join(hinted(kinds).select(F.col("key").alias("near")), "near"), "met")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("near"))
    pairs = words.hint("merge").join(met, "key").hint("merge").join(other, "near")
    return pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def rooted(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each word of ``forms(word, form)``: the last word that its forms lead to. Ways are doubled, so a way of k forms takes log k rounds."""
    way = written(forms.select("word", F.col("form").alias("root")), "way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(way.hint("merge").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("grew")), "way")
        forget(way)
        grew = longer.filter("grew").limit(1).count()
        way = longer
        if not grew:
            return way.select("word", "root")


def grouped(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of ``vocabulary(word, n)``.

    ``form`` is the most frequent near word, the first in code-point order of equal ones, if it stands ``times`` times as often as the word; ``root`` is where forms end.
    """
    vocabulary = written(vocabulary, "vocabulary")
    best = F.min_by(F.struct(F.col("other").alias("form"), F.col("other_n").alias("form_n")), F.struct(-F.col("other_n"), F.col("other")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = vocabulary.hint("merge").join(near, "word", "left")
    kept = F.col("best.form_n").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * times
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(kept, F.col(f"best.{c}")).alias(c) for c in ("form", "form_n")]), "told")
    roots = rooted(told.filter("form is not null"))
    out = told.hint("merge").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words of the texts.

    A null text has no words, a null id is the empty text in the checksum; repeated rows count each time. Of equally frequent near words the first in code-point order is the form.
    """
    return grouped(vocabulary(docs))
