"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree counts which bytes follow each context of up to three bytes. A byte
is coded in its longest known context; a byte new to that context costs an escape and is coded in the
next shorter one, down to a uniform code (escape method C, no exclusions). The statistics are frozen
after training, so a text's code length under a language is an exact sum of costs of its 4-grams, and
the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import crc_fold, forget, with_judgement, written

ORDER = 3
#: Documents per language that training reads, whole, chosen by hash; statistics of more are of little use.
TRAIN_DOCS = 1500
UNKNOWN = "und"
#: Bits a byte of the uniform code: a language whose code of a text, of at least so many bytes, is no shorter is not the text's.
UNIFORM, TOLD = 8.0, 32
#: Languages whose costs share a table, and whose counts the driver holds at once.
TOGETHER = 8
#: Bytes that are coded in one step.
STEP = 1 << 20


def grams(body: np.ndarray, order: int) -> np.ndarray:
    """For each byte, it and its ``order`` predecessors as one number; bytes before the text count as 0."""
    padded = np.r_[np.zeros(order, np.uint8), body]
    out = np.zeros(len(body), np.uint32)
    for k in range(order + 1):
        out = (out << np.uint32(8)) | padded[k : k + len(body)]
    return out


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, n, gram, seen)``: how often each byte followed each context of n bytes, per language.

    Texts are counted per task first. ``docs`` has ``lang`` and ``text``; null texts count as empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                bodies = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts if t]
                for n in range(order + 1 if bodies else 0):
                    gram, seen = np.unique(np.concatenate([grams(b, n) for b in bodies]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.astype(np.int64), "seen": seen})

    counted = docs.select("lang", "text").mapInPandas(run, "lang string, n int, gram long, seen long")
    return counted.groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen"))


class Table:
    """Open addressing from (order, number) to a row, for arrays of keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            put, at = left[free], slot[free]
            self.rows[at] = put
            self.keys[at] = keys[self.rows[at]]
            lost = self.rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for none."""
        slot = self.slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.rows[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def key(n: int, gram: np.ndarray) -> np.ndarray:
    return (np.int64(n + 1) << 40) | gram.astype(np.int64)


class Tables:
    """Costs in bits of every known 4-gram, and escapes of every known context, for a few languages."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.langs, self.order = sorted(counts["lang"].unique()), order
        number = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy().astype(np.int64)
        n, gram, seen = (counts[c].to_numpy() for c in ("n", "gram", "seen"))
        wide = len(self.langs)
        # What each context saw: N bytes of D kinds. Seen s times: s / (N + D); escape: D / (N + D).
        context = key(n, gram >> 8)
        contexts, which = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
        np.add.at(total, (which, number), seen)
        np.add.at(kinds, (which, number), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        self.contexts = Table(contexts)
        known = key(n, gram)
        keys, row = np.unique(known, return_inverse=True)
        own = np.full((len(keys), wide), np.nan)
        own[row, number] = np.log2((total[which, number] + kinds[which, number]) / seen)
        self.grams, self.cost = Table(keys), np.zeros((len(keys), wide))
        for m in range(order + 1):
            at = np.flatnonzero(keys >> 40 == m + 1)
            gram_m = keys[at] & 0xFFFFFFFF
            self.cost[at] = np.where(np.isnan(own[at]), self._shorter(m, gram_m), own[at])
        self.cost = self.cost.astype(np.float32)

    def _shorter(self, n: int, gram: np.ndarray) -> np.ndarray:
        """Cost of bytes that are new to their context of n bytes: its escape, then the next shorter context."""
        row = self.contexts.find(key(n, gram >> 8))
        escape = np.where(row[:, None] >= 0, self.escape[row], 0.0)
        if n == 0:
            return escape + 8.0
        return escape + self._coded(n - 1, gram & ((1 << 8 * n) - 1))

    def _coded(self, n: int, gram: np.ndarray) -> np.ndarray:
        row = self.grams.find(key(n, gram))
        out = self.cost[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            out[new] = self._shorter(n, gram[new])
        return out

    def lengths(self, body: np.ndarray) -> np.ndarray:
        """Code length in bits of the bytes under each language."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(body), STEP):
            before = min(at, self.order)
            part = grams(body[at - before : at + STEP], self.order)[before:]
            total += self._coded(self.order, part).sum(axis=0, dtype=np.float64)
        return total


class Model:
    """The languages of a table of counts. Their costs are kept for ``TOGETHER`` languages at a time: a 4-gram has a cost in each of these, and none in the languages of other tables."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        langs = sorted(counts["lang"].unique())
        groups = [langs[i : i + TOGETHER] for i in range(0, len(langs), TOGETHER)]
        self.tables = [Tables(counts[counts["lang"].isin(group)], order) for group in groups]
        self.langs = langs

    def add(self, other: Model) -> None:
        """Takes in the languages of another model, which all come after its own by name."""
        self.tables += other.tables
        self.langs += other.langs

    def lengths(self, body: np.ndarray) -> np.ndarray:
        """Code length in bits of the bytes under each language."""
        return np.concatenate([t.lengths(body) for t in self.tables])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.lengths(_bytes(text))
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())

    def knows(self, text: str | None) -> bool:
        """Whether some language codes the text in fewer bits than the uniform code does. Texts without a letter have no language.

        A text of fewer than ``TOLD`` bytes, and any text under a model without languages, needs a letter only.
        """
        if not text or not any(map(str.isalpha, text)):
            return False
        body = _bytes(text)
        return not self.langs or len(body) < TOLD or bool(self.lengths(body).min() < UNIFORM * len(body))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def train(rows: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> Model:
    """A model of the labelled ``rows(doc_id, lang, text)``; null languages are left out.

    About ``docs_per_lang`` documents of each language, all if fewer, are read, chosen by a hash of
    their id. All their contexts are counted. That number of documents bounds the model, which is sent to every task.
    Without rows it knows no language. Repeated rows count as often as they occur.
    """
    rows = rows.filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    share = written(sizes.select("lang", (F.lit(float(docs_per_lang)) / F.col("docs")).alias("share")), "share")
    chance = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One row per language: as few as there are languages, and each text is tested where it lies.
    fewer = {r["lang"]: r["share"] for r in share.collect()}
    if not fewer:
        return Model(pd.DataFrame({"lang": [], "n": np.array([], int), "gram": np.array([], int), "seen": np.array([], int)}))
    limit = F.create_map(*[x for k, v in fewer.items() for x in (F.lit(k), F.lit(v))])
    counts = written(count_grams(rows.filter(chance < limit[F.col("lang")])), "counts")
    langs, model = sorted(fewer), None
    for at in range(0, len(langs), TOGETHER):
        part = Model(counts.filter(F.col("lang").isin(langs[at : at + TOGETHER])).toPandas())
        if model is None:
            model = part
        else:
            model.add(part)
    forget(counts)
    return model


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the language of each whole text and a score from 0 to 1.

    ``und`` and 0 for null texts, texts without a letter, and a model without languages. The score is
    the language's share if all were equally likely before; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_judgement(docs, text, keep, f"`{lang_out}` string, `{score_out}` double", lambda: shared.value.predict)


def digest(documents: DataFrame) -> DataFrame:
    """Per document the language predicted from its text alone; documents of fold 2 of 4 are never learnt from.

    Each row is judged for itself, repeated ones and those without an id too (these are in the fold of the empty text), and a repeated row counts as often as it occurs where it is learnt from. ``und`` and 0
    for null texts, texts without a letter, and where no row has a language; of equally short codes the first language by name. Texts are coded whole. No documents, no rows.
    """
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    model = train(documents.filter(~held_out))
    return predicted(documents.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without those that are in none of the model's languages (``Model.knows``); columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = with_judgement(whole.withColumn("text", F.col(f"doc.`{text}`")), "text", ["doc"], "known boolean", lambda: lambda body: (shared.value.knows(body),))
    return out.filter("known").select("doc.*")
