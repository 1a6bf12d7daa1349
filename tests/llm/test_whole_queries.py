"""Whole queries against brute force: other thresholds, proximity, components over all pairs, language by plain context counts."""

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from dizin.llm import decontaminate, ppm, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, None, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("least", [4, 100, 200, 300, 512, 1000])
def test_repeats_of_any_length(spark, least):
    rng = random.Random(least)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    shared = [text(n) for n in (least // 2, least - 1, least, least + 1, 3 * least)]
    texts = [None, "", "x" * (2 * least)] + ["".join(rng.choice(shared) if rng.random() < 0.6 else text(rng.randint(0, least)) for _ in range(4)) for _ in range(12)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.digest(docs(spark, texts), least).collect())
    assert got == [(i, *b) for i, b in enumerate(substrings.brute(texts, least))]


def test_offsets_are_a_power_of_two():
    assert substrings.gram_of(400) == 145
    for least in range(4, 3000):
        gram = substrings.gram_of(least)
        assert 1 <= gram < least and (least - gram + 1) & (least - gram) == 0
    with pytest.raises(ValueError):
        substrings.gram_of(3)


def test_offsets_that_do_not_halve_are_refused(spark):
    with pytest.raises(ValueError):
        substrings.repeated_ranges(substrings.with_key(docs(spark, ["a"]), "text"), 300, 145)


def test_proximity_is_that_of_all_places(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e ha".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["ha y", "alpha", "beta", "alpha x beta", "beta " + "x " * 5 + "alpha"]
    phrases = {"p": ["ha", "ha"], "q": ["a", "b", "a"], "r": ["alpha", "beta"], "s": ["e"], "t": ["c", "gone"]}
    asked = spark.createDataFrame([(k, [bytes(w, "ascii") for w in v]) for k, v in phrases.items()], "window_id string, words array<binary>")
    index = decontaminate.build_index(docs(spark, texts), asked.select(F.explode("words").alias("term")).distinct())
    total = Counter(w for t in texts for w in t.split())
    for slop in (1, 4, decontaminate.GAP):
        want = Counter()
        for name, words in phrases.items():
            rarest = min(range(len(words)), key=lambda i: (total[words[i]], i))
            for t in texts:
                body = t.split()
                for at, w in enumerate(body):
                    near = Counter(body[max(0, at - slop) : at + slop + 1])
                    want[name] += w == words[rarest] and all(near[x] >= n for x, n in Counter(words).items())
        got = Counter()
        for r in decontaminate.lookup(index, asked, slop).collect():
            got[r["window_id"]] += len(r["places"]) // 8
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}, slop
    for slop in (-1, decontaminate.GAP + 1):
        with pytest.raises(ValueError):
            decontaminate.lookup(index, asked, slop)


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(120, 400))] for _ in range(8)]
    texts = [None, "", " ", "One", "one", "two words"]
    for b in base:
        for _ in range(10):
            one = list(b)
            for _ in range(rng.randint(0, 2)):
                one[rng.randrange(len(one))] = rng.choice(words)
            texts.append(" ".join(one))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(60)]
    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = [(i, f"{prints[i]:016x}", root(i)) for i in range(len(texts))]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(docs(spark, texts)).collect())
    assert got == want and any(c < i for i, _, c in want[10:])


def plain_bits(counts, body, order=3):
    """Code length of a text by plain dictionaries: escape C, contexts from the longest down, bytes before the text as 0."""
    padded, bits = bytes(order) + body, 0.0
    for at in range(order, len(padded)):
        for n in range(order, -1, -1):
            seen = counts.get(padded[at - n : at], {})
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if padded[at] in seen:
                bits += math.log2((total + kinds) / seen[padded[at]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("together", [8, 1])
def test_languages_are_those_of_plain_counts(spark, monkeypatch, together):
    monkeypatch.setattr(ppm, "TOGETHER", together)
    rng = random.Random(4)
    sets = {"aa": "abc é", "bb": "abd ñ", "cc": "xyz "}
    texts, langs = [], []
    for i in range(90):
        lang = rng.choice(list(sets))
        texts.append(rng.choice([None, "", "12 34", *["".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 60))) for _ in range(12)]]))
        langs.append(lang if i % 7 else None)
    rows = docs(spark, texts, langs)
    held = {r["doc_id"]: r["held_out"] for r in ppm.digest(rows).collect()}
    counts = {lang: {} for lang in sets}
    for i, (text, lang) in enumerate(zip(texts, langs)):
        if lang and text and not held[i]:
            padded = bytes(3) + text.encode()
            for at in range(3, len(padded)):
                for n in range(4):
                    seen = counts[lang].setdefault(padded[at - n : at], Counter())
                    seen[padded[at]] += 1
    for r in ppm.digest(rows).collect():
        text = texts[r["doc_id"]]
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bits = {lang: plain_bits(counts[lang], text.encode()) for lang in sets}
        best = min(bits.values())
        share = 1 / sum(2 ** (best - b) for b in bits.values())
        assert bits[r["lang_pred"]] == pytest.approx(best, rel=1e-4) and r["score"] == pytest.approx(share, rel=1e-2)


def test_long_texts_are_coded_whole(spark, monkeypatch):
    monkeypatch.setattr(ppm, "STEP", 64)
    model = ppm.Model(ppm.count_grams(spark.createDataFrame([("a", "hello there " * 50), ("b", "bonjour la vie " * 50)], "lang string, text string")).toPandas())
    long = "hello there bonjour " * 400
    steps = model.lengths(ppm._bytes(long))
    monkeypatch.setattr(ppm, "STEP", 1 << 20)
    assert model.lengths(ppm._bytes(long)) == pytest.approx(steps)
