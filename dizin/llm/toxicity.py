"""Toxicity by a learned lexicon, found through misspellings, and judged in context.

Terms and stems that toxic documents have and others lack make a lexicon, kept as a trie. Words of a
text are looked up in it by a Levenshtein automaton: its states are sets of trie nodes with the edits
spent to get there, made as words need them, so that near misses count too and a word costs one step
a letter until no node is left. Each hit is weighed by its context window: terms in quotation marks, or beside words of
reporting, weigh less than those thrown at somebody. A text's score is the logistic of its weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import crc_fold, with_judgement, written

#: Words as letters and digits; a term has at least this many letters to stand misspelt, a stem to stand alone.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MISSPELT, STEM = 5, 4
#: Training rows of each label, chosen by hash.
TRAIN_DOCS = 5_000
#: A term must stand in so many toxic training documents, and in this part of them, and be so much likelier there (log odds).
SUPPORT, PART, ODDS = 3, 0.004, 3.0
#: A stem is more than one word: none of its words may make up this part of its documents.
PRODUCTIVE = 0.9
#: Words on each side that make the context of a hit.
CONTEXT = 6
#: Marks and words of quotation, words of address.
QUOTES = "\"'`“”„«»‘’"
REPORTING = frozenset("said says say quote quoted quotes wrote called word term means definition dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre u ur du dich dein sie tu te toi vous tú ti usted".split())
QUOTED, REPORTED, ADDRESSED = 0.4, 0.7, 1.3


def words(text: str | None) -> list[str]:
    lower = (text or "").translate(LOWER)
    return WORD.findall(lower)


LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Trie:
    """Terms by letter; ``weight`` where a term ends (``near``: misspelt), ``stem`` where it may go on."""

    next: dict[str, Trie] = field(default_factory=dict)
    term: str = ""
    weight: float | None = None
    near: float = 0.0
    stem: float | None = None

    def add(self, term: str, weight: float, stem: bool, near: float) -> None:
        node = self
        for letter in term:
            node = node.next.setdefault(letter, Trie())
        if stem:
            node.stem = max(weight, node.stem or weight)
        else:
            node.term, node.weight, node.near = term, weight, near


class Automaton:
    """Words within ``limit`` edits of the trie's terms of ``MISSPELT`` letters, made deterministic as it runs."""

    def __init__(self, trie: Trie, limit: int = 1):
        self.limit = limit
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, list[str]]] = []
        self.nodes = [trie]
        self.of = {id(trie): 0}
        self.depths = [0]
        self.dead = self.state(frozenset())
        self.start = self.state(self.skipped({(0, 0)}))

    def node(self, trie: Trie, depth: int) -> int:
        if id(trie) not in self.of:
            self.of[id(trie)] = len(self.nodes)
            self.nodes.append(trie)
            self.depths.append(depth)
        return self.of[id(trie)]

    def children(self, node: int):
        return ((c, self.node(t, self.depths[node] + 1)) for c, t in self.nodes[node].next.items())

    def skipped(self, states: set) -> frozenset:
        """With the nodes that leaving out a term's letters reaches; of a node, the fewest edits."""
        todo = list(states)
        while todo:
            node, edits = todo.pop()
            if edits < self.limit:
                for _, child in self.children(node):
                    if (child, edits + 1) not in states:
                        states.add((child, edits + 1))
                        todo.append((child, edits + 1))
        return frozenset((n, e) for n, e in states if not any((n, k) in states for k in range(e)))

    def state(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            met = [self.nodes[n] for n, _ in states if self.nodes[n].weight is not None and self.depths[n] >= MISSPELT]
            self.ends.append((max([x.near for x in met], default=0.0), [x.term for x in met]))
        return self.numbers[states]

    def step(self, state: int, letter: str) -> int:
        new = set()
        for node, edits in self.sets[state]:
            for c, child in self.children(node):
                if c == letter:
                    new.add((child, edits))
                elif edits < self.limit:
                    new.add((child, edits + 1))
            if edits < self.limit:
                new.add((node, edits + 1))
        to = self.steps[state][letter] = self.state(self.skipped(new))
        return to

    def end(self, word: str) -> tuple[float, list[str]]:
        """The largest weight of a term that ``word`` misspells, and all such terms."""
        at = self.start
        for letter in word:
            to = self.steps[at].get(letter)
            at = self.step(at, letter) if to is None else to
            if at == self.dead:
                break
        return self.ends[at]


def lookup(trie: Trie, near: Automaton, word: str) -> float:
    """The largest weight of a term equal to ``word``, a stem it begins with, or else one within the automaton's edits.

    A misspelt term has a weight of its own, and only terms of ``MISSPELT`` letters can be.
    """
    node, best = trie, 0.0
    for letter in word:
        node = node.next.get(letter)
        if node is None:
            break
        if node.stem is not None:
            best = max(best, node.stem)
    else:
        best = max(best, node.weight or 0.0)
    return best or near.end(word)[0]


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float, bool, float], ...]
    slope: float = 1.0
    bias: float = -2.0

    def trie(self) -> Trie:
        root = Trie()
        for row in self.terms:
            root.add(*row)
        return root


class Scorer:
    """Weighs texts; remembers what words weigh, up to a bound."""

    def __init__(self, model: Model, memory: int = 1 << 18):
        self.model, self.root, self.memory = model, model.trie(), memory
        self.near = Automaton(self.root)
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            if len(self.near.sets) >= self.memory:
                self.near = Automaton(self.root)
            got = self.known[word] = lookup(self.root, self.near, word)
        return got

    def weigh(self, text: str | None) -> float:
        """The sum of the hits' weights in their contexts."""
        if not text:
            return 0.0
        lower = text.translate(LOWER)
        total, spans = 0.0, None
        for at, word in enumerate(found := WORD.findall(lower)):
            weight = self.weight(word)
            if not weight:
                continue
            if spans is None:
                spans = [m.span() for m in WORD.finditer(lower)]
            start, end = spans[at]
            around = found[max(0, at - CONTEXT) : at] + found[at + 1 : at + 1 + CONTEXT]
            if start and lower[start - 1] in QUOTES and end < len(lower) and lower[end] in QUOTES:
                weight *= QUOTED
            elif not REPORTING.isdisjoint(around):
                weight *= REPORTED
            elif not ADDRESS.isdisjoint(around):
                weight *= ADDRESSED
            total += weight
        return total

    def score(self, text: str | None) -> float:
        z = self.model.slope * math.log1p(self.weigh(text)) + self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(docs: DataFrame, only=None) -> DataFrame:
    """``(term, stem, docs)``: in how many documents each word, and each beginning of a word, stands; or ``only`` those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, bool], int] = {}
            for text in batch["text"]:
                own = set(words(text))
                seen = {(w, False) for w in own} | {(w[:n], True) for w in own for n in range(STEM, len(w))}
                for at in seen if only is None else seen & only.value:
                    counts[at] = counts.get(at, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["term", "stem", "docs"])

    counted = docs.select("text").mapInPandas(run, "term string, stem boolean, docs long")
    return counted.groupBy("term", "stem").agg(F.sum("docs").alias("docs"))


def train(rows: DataFrame) -> Model:
    """A model of ``rows(doc_id, text, toxic)``; null texts and labels are left out.

    About ``TRAIN_DOCS`` rows of each label are read, all if fewer, chosen by a hash of the id. Words
    and beginnings of words are counted by document; those much likelier in toxic ones make the
    lexicon. The words that reach ``PART`` of the toxic documents
    are few enough to send to every task. Slope and bias are fitted on the same rows. Without rows of
    both labels nothing is toxic.
    """
    rows = rows.filter("text is not null and toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model((), 0.0, -5.0)
    share = {k: min(1.0, TRAIN_DOCS / n) for k, n in sizes.items()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    used = rows.filter(chance < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    used = written(used.select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in used.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    enough = max(SUPPORT, math.ceil(PART * n.get(1, 0)))
    bad = {(r["term"], r["stem"]): r["docs"] for r in _features(used.filter("toxic = 1")).filter(F.col("docs") >= enough).collect()}
    only = rows.sparkSession.sparkContext.broadcast(frozenset(bad))
    good = {(r["term"], r["stem"]): r["docs"] for r in _features(used.filter("toxic = 0"), only).collect()}
    odds = {k: math.log((v + 0.5) / (n.get(1, 0) + 1)) - math.log((good.get(k, 0) + 0.5) / (n.get(0, 0) + 1)) for k, v in bad.items()}
    best = sorted((k for k in bad if odds[k] >= ODDS), key=lambda k: (-odds[k], -bad[k], k))
    single = {}
    for term, stem in best:
        if not stem:
            for i in range(STEM, len(term)):
                single[term[:i]] = max(single.get(term[:i], 0), bad[term, False])
    stems = {t for t, stem in best if stem and single.get(t, 0) < PRODUCTIVE * bad[t, True]}
    terms = [k for k in best if not k[1] or k[0] in stems]
    model = Model(tuple((t, round(odds[t, stem], 4), stem, 0.0) for t, stem in terms))
    return _fitted(used, _misspelt(used, model, n))


def _misspelt(rows: DataFrame, model: Model, n: dict[int, int]) -> Model:
    """The model with the weight of each term's misspellings: their own log odds, half the term's where none was seen.

    Misspellings that clean documents have nearly as often weigh nothing: they are words of their own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = shared.value.trie()
        near = Automaton(root)
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for term in {t for w in set(words(text)) if len(w) >= MISSPELT - 1 for t in near.end(w)[1] if t != w}:
                    counts[term, int(toxic)] = counts.get((term, int(toxic)), 0) + 1
            yield pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["term", "toxic", "docs"])

    counted = rows.mapInPandas(run, "term string, toxic int, docs long").groupBy("term", "toxic").agg(F.sum("docs").alias("docs"))
    docs = {(r["term"], r["toxic"]): r["docs"] for r in counted.collect()}
    out = []
    for term, weight, stem, near in model.terms:
        bad, good = docs.get((term, 1), 0), docs.get((term, 0), 0)
        if not stem and len(term) >= MISSPELT:
            odds = math.log((bad + 0.5) / (n.get(1, 0) + 1)) - math.log((good + 0.5) / (n.get(0, 0) + 1))
            near = weight / 2 if not bad + good else round(min(odds, weight), 4) if odds >= ODDS else 0.0
        out.append((term, weight, stem, near))
    return Model(tuple(out))


def _fitted(rows: DataFrame, model: Model) -> Model:
    """Slope and bias of a logistic regression on the log weight, by Newton's steps over binned weights."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"x": [round(math.log1p(scorer.weigh(t)), 1) for t in batch["text"]], "y": batch["toxic"].to_numpy()})

    bins = rows.mapInPandas(run, "x double, y int").groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).toPandas()
    x, n, bad = (bins[c].to_numpy(float) for c in ("x", "n", "bad"))
    w = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (bad - n * p) - 0.01 * w
        hess = (design.T * (n * p * (1 - p))) @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.terms, float(w[0]), float(w[1]))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` of each whole text.

    Null and empty texts are scored as texts without a hit. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        scorer = Scorer(shared.value)

        def judge(body: str | None) -> tuple[float, int]:
            score = scorer.score(body)
            return score, int(score >= 0.5)

        return judge

    return with_judgement(docs, text, keep, "score double, predicted int", prepare)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document a score from its text alone. Rows of fold 0 of 5 are never learnt from.

    Each row is scored for itself, repeated ones and those without an id too (these are in the fold of the empty text); null and empty texts as texts without a hit. Of several labels of an
    id the larger counts; null labels, and labels of no document, do not. A score of exactly 0.5 is predicted as toxic. No documents, no rows; no labels, nothing is toxic.
    """
    fold = crc_fold(F.col("doc_id"), 5) == 0
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.filter(~fold).select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id")
    return scored(documents.select("doc_id", fold.alias("held_out"), "text"), train(rows), keep=["doc_id", "held_out"])
