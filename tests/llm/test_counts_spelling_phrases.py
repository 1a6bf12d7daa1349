"""Token counts against the library, spelling variants and phrases against brute force: nulls, empty and long texts, repeats, ties, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from dizin.llm import counts, phrases, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = (1 << 53) + 1
CLASHES = ("batch", "rows", "piece", "members", "times", "n", "row", "word", "form", "root", "places", "groups", "key", "id", "f", "n_bytes", "n_tokens", "doc", "__level")


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], DOCS).withColumns({c: F.lit(7) for c in CLASHES})


def hostile(rng, n):
    alphabet = ["a", "b", "the", " ", " ", ",", ".", "\n", "▁", "é", "漢", "\x00", "<s>", "</s>", "’", "À", "Ħ", "😀", "\t", "\r", "0", "1", "xX", "<0x0A>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("run", [counts.digest, spelling.digest, phrases.digest])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).collect() == []
    none = run(docs(spark, [(1, None, None), (None, "", "en")])).collect()
    assert len(none) == (2 if run is counts.digest else 0)


@pytest.mark.parametrize("head", [counts.HEAD, 5, 0])
def test_token_counts_are_the_librarys(spark, monkeypatch, head):
    monkeypatch.setattr(counts, "ROWS", 50)
    rng = random.Random(11)
    texts = [None, "", " ", "▁", "x" * 200_000, "word " * 50_000, *hostile(rng, 300)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(6, texts[6], "en")] * 2 + [(None, texts[7], None), (LONG, texts[8], "x")]
    got = sorted(map(tuple, counts.token_counts(docs(spark, rows), keep=["doc_id"], head=head).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=counts.MODEL)
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows), key=repr)


def test_token_counts_keep_columns_and_limit(spark):
    rows = [(i, "a b " * n, "en") for i, n in enumerate((0, 2048, 2049))]
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in counts.digest(docs(spark, rows)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=counts.MODEL)
    assert got == {i: (len(library.encode(t)), len(library.encode(t)) > 4096) for i, t, _ in rows} and {x for _, x in got.values()} == {True, False}
    kept = counts.token_counts(docs(spark, rows))
    assert [c for c in kept.columns if c not in ("n_bytes", "n_tokens")] == [c for c in docs(spark, rows).columns if c not in ("n_bytes", "n_tokens")]


def test_cuts_join_what_a_piece_joins():
    cuts = counts.Cuts()
    for text in ("Hello, world!\n  two", "a▁b  c", "naïve café 123"):
        assert "".join(cuts.parts(text)) == "▁" + text.replace(" ", "▁") and sum(cuts.sizes(cuts.parts(text))) == len(cuts.library.encode(text))


def variants(rows):
    """The vocabulary, near words by trying all edits, forms and roots."""
    n = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    letters = {c for w in n for c in w}
    near, form = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for c in letters for j in (0, 1)}
        near[w] = sorted((edits & n.keys()) - {w}, key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("symbols", [4, 2, 9])
def test_variants_are_those_of_all_edits(spark, monkeypatch, symbols):
    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    rng = random.Random(12)
    stems = ["".join(rng.choice("abcdeéñÿ") for _ in range(rng.randint(7, 11))) for _ in range(12)] + ["Ünterschied", "x" * 900, "x" * 901]
    words = []
    for k, stem in enumerate(stems):
        words += [stem] * rng.choice([2, 40, 400])
        for _ in range(6):
            at, c = rng.randrange(len(stem)), rng.choice("abÉÿ")
            one = rng.choice([stem[:at] + stem[at + 1 :], stem[:at] + c + stem[at + 1 :], stem[:at] + c + stem[at:]])
            words += [one] * rng.choice([1, 2, 3, 30]) + [one[:at] + c + one[at:]] * 2
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)]
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)] + [(None, "Ünterschied unterschied ×÷×÷×÷×", None), (3, None, None), (3, "", None), (5, texts[0], "en"), (5, texts[0], "en")]
    want = variants(rows)
    assert sorted(map(tuple, spelling.digest(docs(spark, rows)).collect()), key=repr) == want
    assert any(f and r != f for _, f, r, *_ in want) and any(f for _, f, *_ in want)


def collocations(rows, least, cover, top):
    """All runs of one to four words counted plainly."""
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    key = lang, words[i : i + k]
                    f[key] = f.get(key, 0) + 1
    often = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        longer = [b for (o, v), b in often.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    told, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            told.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return told


@pytest.mark.parametrize("head", [phrases.HEAD, 7, 0])
def test_phrases_are_those_of_all_runs(spark, monkeypatch, head):
    monkeypatch.setattr(phrases, "BYTES", 3000)
    rng = random.Random(13)
    words = ["a", "B", "cé", "d", "e f", "😀", "the", "Of", "x\x1cy"]
    phrase = ["the Of a B", "d cé", "😀 a"]
    text = lambda n: "".join(rng.choice(phrase if rng.random() < 0.2 else words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", ";", "\x0b"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), ["en", "de", None, "und"][i % 4]) for i in range(120)] + [(1, None, None), (None, "", "fr"), (2, "a B " * 3000, "en"), (3, "lone", "fr")]
    rows += [rows[5], rows[5]]
    for least, cover, top in ((5, 80, 2000), (20, 50, 6)):
        got = phrases.digest(docs(spark, rows), least, 4, cover, top, head).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == collocations(rows, least, cover, top)


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_100_000_000_000_000_001)], "a long, l long, r long")
    assert row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 2_000_000 * 9_000_000_000_000_000_000 // 18_100_000_000_000_000_001
