"""The numbered operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dizin.llm import decontaminate, licenses, mixing, packing, ppm, secrets, simhash, substrings, topk, toxicity
from dizin.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(80)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(120)
TEXTS = [None, "", "   ", "one", "Two words", prose(300), PASSAGE + " " + prose(50), prose(60) + " " + PASSAGE, prose(20000), "é" * 500, "ñ ß İ " * 3, "x" * 900, prose(300)]


def docs(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], None) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[6], rows[6], (40, texts[5], "en", "s1", 1), (None, texts[5], None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("run", [
    secrets.digest, simhash.digest, simhash.deduplicate, mixing.digest, mixing.mix, ppm.digest, licenses.digest, substrings.digest, packing.pack,
    lambda d: decontaminate.digest(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: toxicity.digest(d, d.select("doc_id", F.lit(1).alias("toxic"))),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).collect() == []


LONG = (1 << 53) + 1
CLASHES = ("__text", "__lang", "__score", "row", "text_", "score", "predicted", "labels", "fp", "k1", "ranges", "found", "u", "size", "doc", "key", "id", "lang_pred", "known")


@pytest.mark.parametrize("run", [
    packing.pack, secrets.digest, simhash.digest, lambda d: toxicity.digest(d, d.select("doc_id", F.lit(1).alias("toxic"))), lambda d: decontaminate.digest(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    substrings.digest, mixing.digest, licenses.digest, ppm.digest,
])
def test_ids_and_clashing_columns(spark, run):
    rows = [(LONG, prose(30), "en", "s", 1), (None, prose(30), "de", None, None), (LONG + 2, prose(30), "en", "s", 1), (LONG + 2, None, None, "s", 1)]
    d = spark.createDataFrame(rows, DOCS).coalesce(1).withColumns({c: F.lit(7) for c in CLASHES})
    got = run(d).collect()
    ids = [i for r in got for i in (r["doc_ids"] if "doc_ids" in r else [r["doc_id"]])]
    assert sorted(ids, key=str) == sorted([LONG, LONG + 2, LONG + 2, None], key=str)


@pytest.mark.parametrize("run", [
    simhash.deduplicate, mixing.mix, lambda d: ppm.identified(d, ppm.train(d)), lambda d: decontaminate.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), F.lit("no such words").alias("text"))),
    licenses.scan, lambda d: toxicity.scored(d, toxicity.Model(())), lambda d: ppm.predicted(d, ppm.train(d)), lambda d: secrets.findings_by_path(d, d.sparkSession.createDataFrame([], secrets.ENTRIES)),
])
def test_columns_of_others_stay(spark, run):
    rows = [(LONG, prose(30), "en", "s", 1), (None, prose(30), "en", "s", 1), (3, prose(30), "en", "s", 1)]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in CLASHES if c not in ("score", "predicted", "labels", "lang_pred")})
    got = run(d)
    assert set(d.columns) <= set(got.columns) and all(r["__text"] == r["row"] == r["key"] == 7 for r in got.collect()) and got.count() >= 3


@pytest.mark.parametrize("run", [
    secrets.digest, simhash.digest, lambda d: toxicity.digest(d, d.select("doc_id", F.lit(1).alias("toxic")).unionByName(d.select("doc_id", F.lit(0).alias("toxic")))), licenses.digest, ppm.digest, substrings.digest, mixing.digest,
    lambda d: decontaminate.digest(d, d.limit(1).select(F.col("doc_id").alias("item_id"), "text")),
])
def test_repeated_rows_have_equal_results(spark, run):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([prose(400), "mit license password: abcdef", None, "", prose(20)])]
    got = rows_of(run(spark.createDataFrame(rows * 3 + [(None, rows[0][1], "de", None, None)] * 2, DOCS).repartition(3)))
    assert len(got) == 17 and sorted(got.count(x) for x in set(got)) == [2, 3, 3, 3, 3, 3]


def test_empty_vectors(spark):
    assert topk.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_secrets(spark):
    texts = ['password = "abcdef" token:xy', "AKIA" + "A" * 16 + " " + "0a" * 12, "PASSWD: ſecret12 K " + "f" * 23, None, "", "secret=" + "a" * 100_000 + " é api-key: zzzzzz", "eyJ" * 40_000, "(eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMe) xeyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMe eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMe", 'password = "abcdef" token:xy']
    d = docs(spark, texts, False)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in secrets.digest(d).collect()}
    assert got == {i: secrets.brute(t) for i, t in enumerate(texts)}
    assert got[0][0] == 1 and got[1][1:3] == (1, 1)


def test_secret_ledger_scans_only_the_unseen(spark, tmp_path):
    first = spark.createDataFrame([("a", "password=abcdef"), ("b", "clean"), ("b", "password=abcdef")], "path string, text string")
    more = first.unionByName(spark.createDataFrame([("c", "token: qwerty1"), ("c", "clean")], "path string, text string"))
    ledger = secrets.advance(first, str(tmp_path / "ledger"))
    kinds = len(secrets.RULES)
    assert secrets.scan(more, ledger).count() == kinds and secrets.scan(first, ledger).count() == 0
    newer = [secrets.Rule(r.kind, r.pattern, r.group, r.least, r.any_case, 2 if r.kind == "hex" else 1) for r in secrets.RULES]
    assert secrets.scan(first, ledger, newer).count() == 2
    assert ledger.count() == 2 * kinds
    after = secrets.advance(more, str(tmp_path / "ledger"))
    assert after.count() == 3 * kinds == after.select("blob_id", "kind").distinct().count()
    found = secrets.findings_by_path(more.withColumns({"found": F.lit(1), "blob_text": F.lit(2)}), after).filter(F.size("findings") > 0)
    assert sorted(r["path"] for r in found.collect()) == ["a", "b", "c"]


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    got = simhash.digest(docs(spark)).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert len(got) == len(TEXTS) + 4 and all(prints[i] == slow_fingerprint(t) for i, t in enumerate(TEXTS))


def test_simhash_links_are_those_of_all_pairs(spark, monkeypatch):
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(40)} | {0, 1 << 63}
    fps = [x & ((1 << 64) - 1) for x in fps]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(fps)) if sum(root(j) == root(i) for j in range(len(fps))) > 1}
    for most in (32, 2):
        monkeypatch.setattr(simhash, "PAIRED", most)
        assert {r["node"]: r["component"] for r in components(simhash.links(df)).collect()} == want


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}


def test_deduplicate_keeps_the_first(spark):
    d = docs(spark).withColumn("fp", F.lit("x"))
    kept = simhash.deduplicate(d)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == d.columns and ids.count(6) == 1 and 40 not in ids and {0, 1, 2, None} <= set(ids)


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, PASSAGE[:200], "k"), (2, "Two, WORDS!", "k"), (3, None, "k"), (4, "...", "k"), (10, PASSAGE[100:400], "k")], "item_id long, text string, doc_id string")
    d = docs(spark)
    got = decontaminate.hits(d, items).collect()
    want = {}
    wins = {}
    for i, t in ((1, PASSAGE[:200]), (2, "Two, WORDS!"), (10, PASSAGE[100:400])):
        w = decontaminate.words_of(t)
        for at in range(max(1, len(w) - 9)):
            wins.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    for i, t in enumerate(TEXTS):
        w, hit, items_hit = decontaminate.words_of(t), set(), set()
        for win, names in wins.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    items_hit |= names
        want[i] = (len(w), len(hit), sorted(items_hit))
    assert len(got) == d.count()
    assert all((r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    left = {r["doc_id"] for r in decontaminate.decontaminate(d, items).collect()}
    assert left & set(want) == {i for i, x in want.items() if not x[1]}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y z gamma"), (2, "gamma q q q q q q q q alpha beta")], "doc_id long, text string")
    phrases = spark.createDataFrame([("p", [b"alpha", b"beta", b"gamma"])], "window_id string, words array<binary>")
    index = decontaminate.build_index(d, phrases.select(F.explode("words").alias("term")))
    assert decontaminate.lookup(index, phrases).count() == 0
    near = decontaminate.lookup(index, phrases, slop=5).collect()
    assert sum(len(r["places"]) // 8 for r in near) == 1


def test_substrings(spark, monkeypatch):
    base = [*prose(900)]
    texts = [*TEXTS[:8], *TEXTS[9:], PASSAGE[:450] + "!" + prose(90), PASSAGE[30:431], PASSAGE[30:430], PASSAGE[31:430], "ab" * 700, "foo " * 300 + PASSAGE]
    texts += [prose(rng.randint(0, 40)) + PASSAGE[a : a + 420 + 5 * a] + prose(30) for a in range(12)]
    for n in range(6):
        edited = base.copy()
        for at in rng.sample(range(len(base)), n):
            edited[at] = "#"
        texts.append("".join(edited))
    d = docs(spark, texts)
    rows = d.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *b) for r, b in zip(rows, substrings.brute([r["text"] for r in rows]), strict=True)), key=repr)
    assert rows_of(substrings.digest(d.withColumn("k1", F.lit("x")).withColumn("ranges", F.lit(0)))) == want
    monkeypatch.setattr(substrings, "double", lambda *_: [])
    assert rows_of(substrings.digest(d)) != want


def test_topk(spark):
    gen = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in gen.normal(0, 0.2, 8)]) for i in range(300)]
    vecs += [(20, vecs[7][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (320, [0.5, -0.5]), (321, [1.0, 2.0]), (340, []), (None, vecs[3][1])]
    vecs += [(350 + i, vecs[3][1]) for i in range(30)] + [(400, [3.0e5] * 8), (401, [-4.0e9] * 8), (40, [1.0e9, -3.0e5] * 4), (402, [1.0e30] * 8), (420, [-1.0e300] * 8), (403, [2.0**52 + 0.5] * 8), (60, vecs[60][1]), (60, vecs[60][1])]
    got = rows_of(topk.digest(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")))
    exact = lambda x: int(Fraction(x) * 64 // 1)
    whole = [(n, i, [exact(x) for x in v]) for n, (i, v) in enumerate(vecs) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, i, q in whole:
        if i is not None and i % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, j, v in whole if m != n and len(v) == len(q)), key=lambda x: (x[0], x[1] is None, x[1]))[:20]
            want += [(i, at + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for at, (s, j) in enumerate(scored)]
    assert got == sorted(want, key=repr)


def test_mixing(spark):
    texts = [prose(rng.randint(0, 40)) for _ in range(400)]
    d = spark.createDataFrame([(i, t, "en", ["a", "b", "c", None, "d"][(i % 17) % 5], 1) for i, t in enumerate(texts)], DOCS)
    got = mixing.digest(d).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all() and rows_of(mixing.digest(d)) == rows_of(mixing.digest(d.repartition(7)))
    by = got.merge(d.select("doc_id", F.coalesce("source", F.lit("~")).alias("source")).toPandas(), on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 3).all() and (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6
    clash = d.withColumns({c: F.lit(1) for c in ("copies", "size", "u", "bits", "doc", "rank")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(got["taken"] // got["size"].clip(lower=1)) + sum(got["size"] == 0)


def test_pareto_inclusion(spark):
    sizes = [1, 3, 9, 30, 100, 300]
    rows = [(i, " ".join(["x"] * sizes[i % 6]), "en", "abc"[i % 3 if i % 7 else 2], 1) for i in range(12_001)]
    d = spark.createDataFrame(rows, DOCS)
    sized = mixing.written(mixing.measured(d, "doc_id", "text", "source", F.col("doc_id")), "sized")
    expected, ends = mixing.plan(sized)
    told = mixing.with_copies(sized, (expected, ends)).groupBy("source", "bits").agg(F.count("*").alias("n"), F.avg("copies").alias("mean"), F.first("certain").alias("certain"), F.first("part").alias("part")).toPandas()
    assert told.groupby("source")["part"].nunique().max() >= 4
    assert ((told["mean"] - told["certain"] - told["part"]).abs() <= 5 * (told["part"] * (1 - told["part"]) / told["n"]) ** 0.5 + 2 / told["n"]).all()
    # By random numbers alone the same number of words would be other documents.
    by_rank = mixing.with_copies(sized, (expected, ends)).filter("copies > certain").select("doc_id", "rank", "u", "part").toPandas()
    assert by_rank.groupby("part")["u"].max().nunique() > 1 and (by_rank.nsmallest(len(by_rank) // 2, "rank")["doc_id"].tolist() != by_rank.nsmallest(len(by_rank) // 2, "u")["doc_id"].tolist())


def test_packing_round_trip(spark):
    d = docs(spark)
    packed = packing.pack(d, length=128, group=20_000)
    tokeniser = packing.load()
    got = {}
    for r in sorted(packing.unpack(packed.filter("array_contains(doc_ids, 8) or true")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<i4"), r["is_end"]))
    for i, t in enumerate(TEXTS):
        if i != 6:  # its row stands three times
            ids = np.concatenate([x for _, x, _ in got[i]])
            assert ids[-1] == packing.END and tokeniser.decode(ids[:-1].tolist()) == (t or "") and got[i][-1][2]
    assert len([1 for _, _, e in got[6] if e]) == 3
    for r in packed.collect():
        pos, cuts = np.frombuffer(r["position_ids"], "<i4"), r["cu_seqlens"]
        assert len(r["input_ids"]) == 512 and all(pos[a] == 0 and pos[b - 1] == b - a - 1 for a, b in zip(cuts, cuts[1:], strict=False)) and cuts[-1] == r["n_tokens"]
    long = prose(400)
    assert (packing.encode(tokeniser, long) == tokeniser.encode_ordinary(long)).all()


def test_long_texts_are_cut_where_tokens_end(monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    tokeniser, text = packing.load(), "It's a b  c,d 1 2 " * 30 + prose(200) + "\n\n é è"
    assert packing.encode(tokeniser, text).tolist() == tokeniser.encode_ordinary(text)


def test_best_fit():
    sizes = [rng.randint(1, 64) for _ in range(300)]
    rows = packing.best_fit(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(300)) and all(sum(sizes[i] for i in r) <= 64 for r in rows)
    free, plain = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free[free.index(min(fits))] -= s
        else:
            free.append(64 - s)
            plain += 1
    assert len(rows) == plain


def test_licenses():
    ordered = licenses.rules()
    assert len(ordered) >= 200
    got = licenses.scan_text("Released under the MIT License. Also the apache, LICENSE; gnu general public license version 3.", ordered)
    assert got[1:6] == (3, 3, 10, "apache,gpl,mit", "apache,gpl,gpl-3.0,mit")
    assert licenses.scan_text(None, ordered) == (0, 0, None, None, "", "", 0.0)
    kept = licenses.detect(" licensed under the apache license version 2 0 ", ordered)
    assert [(r.label, r.priority) for *_, r in kept] == [("apache-2.0", 4)]


def slow_scan(text, ordered):
    """Base places word by word; all rules everywhere, and each detection held against all before it."""
    w = [x.decode() for x in licenses.words_of(text)]
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.decode().split()]
    norm, kept = " " + " ".join(w) + " ", []
    for r in ordered:
        for m in r.pattern.finditer(norm):
            if not any(a <= m.start() and m.end() <= b for a, b, _ in kept):
                kept.append((*m.span(), r))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    miss = 0.5 if base else 1.0
    for label in {r.label for *_, r in kept}:
        miss *= 1 - max(r.confidence for *_, r in kept if r.label == label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for *_, r in kept})), round(1 - miss, 6)


def test_licenses_are_those_of_the_plain_way(spark):
    parts = ["MIT License", "the apache license, version 2.0", "GNU General Public License v3", "licensed under", "released under the terms of the", "all rights reserved", "SPDX-License-Identifier:", "mpl 2.0", "(c) copyright", "cc by-sa 4.0",
             "mit license mit license", "license", "BSD 3-clause license", "public domain", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.6 else prose(2) for _ in range(rng.randint(0, 25))) for _ in range(150)] + TEXTS
    d = docs(spark, texts)
    ordered = licenses.rules()
    want = sorted(((r["doc_id"], *slow_scan(r["text"], ordered)) for r in d.collect()), key=repr)
    assert rows_of(licenses.digest(d)) == want


def test_licenses_in_linear_time():
    ordered, began = licenses.rules(), time.process_time()
    got = licenses.scan_text("mit license " * 90_000, ordered)
    assert got[:4] == (180_000, 90_000, 0, 179_998) and time.process_time() - began < 5


def test_license_columns(spark):
    out = licenses.scan(docs(spark).withColumn("labels", F.lit("x")))
    assert out.count() == len(TEXTS) + 4 and "labels" in out.columns and out.columns.count("labels") == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_automaton_is_levenshtein():
    terms = ["idiot", "stupid", "worthless", "scum", "abcab", "abcba"]
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t, 4.0, False, 2.0)
    near = toxicity.Automaton(trie)
    words = terms + ["".join(rng.choice("abcidot") for _ in range(rng.randint(3, 7))) for _ in range(3000)] + ["idiott", "diot", "stuupid", "worthles"]
    for w in words:
        assert set(near.end(w)[1]) == {t for t in terms if len(t) >= toxicity.MISSPELT and edits(w, t) <= 1}, w


def test_toxicity_context():
    model = toxicity.Model((("idiot", 6.0, False, 3.0), ("clown", 6.0, False, 3.0)), 1.0, -2.0)
    scorer = toxicity.Scorer(model)
    plain, quoted, told, at_you = (scorer.weigh(x) for x in ("a big idiot here", 'the "idiot" here', "he wrote idiot here", "you idiot"))
    assert quoted < told < plain < at_you and scorer.weigh("idoit idiott") == 3.0 and scorer.weigh(None) == 0.0


def test_toxicity_learns_and_holds_out(spark):
    rows = [(i, prose(30) + (" nasty creep" if i % 4 == 0 else ""), "en", "s", 1) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.digest(d, labels).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["doc_id"] % 4 == 0)).mean() > 0.99 and got["score"].between(0, 1).all()
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.digest(d, flipped)) == rows_of(toxicity.digest(d, labels))


def slow_length(counts, order, body):
    """Code length by the definition, context by context."""
    bits = 0.0
    padded = b"\0" * order + body
    for i in range(len(body)):
        for n in range(order, -1, -1):
            ctx = padded[i + order - n : i + order]
            seen = counts.get((n, ctx), {})
            total, kinds = sum(seen.values()), len(seen)
            if body[i] in seen:
                bits -= np.log2(seen[body[i]] / (total + kinds))
                break
            if total:
                bits -= np.log2(kinds / (total + kinds))
            if n == 0:
                bits += 8
    return bits


def test_ppm_code_lengths(spark):
    train = {"aa": ["abracadabra abra", "cadabra"], "bb": ["hocus pocus", "é hokus"]}
    df = spark.createDataFrame([(lang, t) for lang, ts in train.items() for t in ts], "lang string, text string")
    model = ppm.Model(ppm.count_grams(df).toPandas())
    for lang, ts in train.items():
        counts = {}
        for t in ts:
            b = t.encode()
            padded = b"\0" * 3 + b
            for i in range(len(b)):
                for n in range(4):
                    c = counts.setdefault((n, padded[i + 3 - n : i + 3]), {})
                    c[b[i]] = c.get(b[i], 0) + 1
        for probe in (b"abra", "é pocus xyz".encode(), b"\0\xff", b"cad"):
            got = model.lengths(np.frombuffer(probe, np.uint8))[model.langs.index(lang)]
            assert abs(got - slow_length(counts, 3, probe)) < 1e-3


def test_ppm_predicts(spark):
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "thing"] if i % 2 else ["der", "und", "von", "ding"]) for _ in range(20)), "en" if i % 2 else "de", "s", 1) for i in range(200)]
    d = spark.createDataFrame([*rows, (900, None, "en", None, 1), (901, "123 ...", "de", None, 1), (902, "the thing", None, None, 1)], DOCS)
    got = {r["doc_id"]: r for r in ppm.digest(d).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(200)) and got[902]["lang_pred"] == "en"
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE[:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs(spark)
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", "), name
    ids = {r["doc_id"] for r in left.collect()}
    assert not ids & {0, 1, 2, 6, 7, 40} and pipeline.run(spark, str(tmp_path)).count() > 0
