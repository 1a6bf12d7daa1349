"""Course forms, cards and timetables on the documented fixtures."""

import random
import time

from pyspark.sql import functions as F

from dizin.operators import extract as X
from dizin.operators import timetable as TT
from dizin.sources import files as S
from dizin.sources import html as H

FORM = """DERSİN ADI: Bilgisayar Donanımı
DERSİN SINIFI: 10
DERSİN SÜRESİ: 2 saat
DERSİN AMACI: Donanım bilgisini artırmak
KAZANIM SAYISI VE SÜRE TABLOSU
ÖĞRENME BİRİMİ KAZANIM SAYISI DERS SAATİ ORAN (%)
Donanım Temelleri 4 16 40
Çevre Birimleri 6 24 60
TOPLAM 10 40 100"""


def test_form(spark):
    df = spark.createDataFrame([(1, FORM), (2, ""), (3, None)], "k long, text string")
    got = {r["k"]: r for r in X.sections(df).collect()}
    assert (got[1]["name"], got[1]["grade"], got[1]["duration"]) == ("Bilgisayar Donanımı", "10", "2 saat")
    assert got[2]["name"] is None and got[3]["name"] is None
    assert [tuple(r) for r in X.units(df, ["k"]).orderBy("seq").collect()] == [(1, 1, "Donanım Temelleri", 4, "16", "40"), (1, 2, "Çevre Birimleri", 6, "24", "60")]


def test_single_line_table(spark):
    rows = "Defter ve Belgeler 3 20 11 Vergi Dairesi ve Belediye İşlemleri 2 15 8 Fatura 3 18/36 22"
    plain = spark.createDataFrame([(1, rows.replace("18/36", "40"))], "k long, text string")
    got = plain.select(F.explode(X.table_rows(F.col("text"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("Defter ve Belgeler", 3, "20", "11"), ("Vergi Dairesi ve Belediye İşlemleri", 2, "15", "8"), ("Fatura", 3, "40", "22")]
    # One row with two-part hours: its shape comes first, and no other row has it.
    mixed = spark.createDataFrame([(rows,)], "text string").select(F.explode(X.table_rows(F.col("text"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in mixed] == [("Fatura", 3, "18/36", "22")]
    only = spark.createDataFrame([("Gastronomi ve Medya 3 Gastronomi 6 TOPLAM 9",)], "text string")
    assert [tuple(r) for r in only.select(F.explode(X.table_rows(F.col("text"))).alias("x")).select("x.*").collect()] == [("Gastronomi ve Medya", 3, "-", "-"), ("Gastronomi", 6, "-", "-")]


def test_joined_lines(spark):
    lines = ["Vergi Dairesi ve", "Belediye İşlemleri 2 15 8", "Çalışma ve Sosyal", "Güvenlik 3 15 8", "Defter ve Belgeler 3 20 11"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, n int, line string")
    assert [r["line"] for r in X.joined_lines(df, ["k"], "n", "line").orderBy("row").collect()] == ["Vergi Dairesi ve Belediye İşlemleri 2 15 8", "Çalışma ve Sosyal Güvenlik 3 15 8", "Defter ve Belgeler 3 20 11"]


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([("aaaa xaa", "aa"), ("b", "aa"), ("", "aa")], "t string, k string")
    assert [r["p"] for r in df.select(X.occurrences(F.col("t"), F.col("k")).alias("p")).collect()] == [[1, 2, 3, 7], [], []]


def test_topics_placeholder(spark):
    df = spark.createDataFrame([(" 1. Bir 3. Uc", 3)], "t string, n int")
    got = df.select(F.explode(X.topics(F.col("t"), F.col("n"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(1, "Bir 3. Uc"), (2, X.NOT_FOUND), (3, "Uc")]


def test_checked_topics(spark):
    df = spark.createDataFrame([("1. Anayasa 20. yuzyilda 2 kez degisti 2. Devlet", 2)], "t string, n int")
    plain, checked = ([r["topic"] for r in df.select(F.explode(X.topics(F.col("t"), F.col("n"), c)).alias("x")).select("x.*").collect()] for c in (False, True))
    assert checked == ["Anayasa 20. yuzyilda 2 kez degisti", "Devlet"] and plain[0] != checked[0]


def test_titles_of_a_form(spark):
    text = "İLK KONU 1. Bir 2. Iki ORTA 1. Uc İlk konu sonra 1. Dort 2. Bes SON 9 yok"
    titles = [(1, "İlk Konu", 2), (2, "Orta", 1), (3, "Yok", 1), (4, "Son", 3), (5, "", 1)]
    df = spark.createDataFrame([(1, text, titles), (2, None, titles), (3, text, []), (4, text, None)], "k int, t string, u array<struct<seq:int,title:string,n:int>>")
    got = {(r["k"], r["seq"]): (r["matches"], r["valid"], r["first_valid"]) for r in X.header_matches(df, ["k"], "t", "u").collect()}
    assert got[1, 1] == (2, 2, 1) and got[1, 2] == (1, 1, 24) and got[1, 4] == (2, 0, None)
    areas = {r["seq"]: r["work_area"] for r in X.work_areas(df, ["k"], "t", "u").collect()}
    assert areas[1] == " 1. Bir 2. Iki " and set(areas) >= {1, 2}
    told = {r["k"]: r["report"] for r in X.report(df, ["k"], "t", "u").collect()}
    assert told[1].startswith("İlk Konu (2) -> 2 eşleşme\n1. Bir\n2. Iki") and "Son (3) -> eşleşme yok" in told[1] and told[3] == ""


def test_links_in_any_writing(spark):
    html = """<a href="/x.rar">T &amp; M</a> <a href='/y.rar'>&#305;&#x131; &Uuml; &unknown; &amp</a> <A HREF=/z.rar class=k>Z</A><a title='a > b' href = "/q&amp;r.rar" >Q<b>R</b></a>
      <!-- <a href="/no.rar">no</a> --><script>"<a href='/no.rar'>no</a>"</script><a name="n">N</a><abbr href="/no.rar">no</abbr><a data-href="/no.rar">no</a>"""
    got = H.links(spark.createDataFrame([(1, "https://h.tr/p", html), (2, "https://h.tr", None)], "page_id int, url string, html string"), ".rar", "/").orderBy("pos").collect()
    assert [(r["href"], r["text"], r["absolute"]) for r in got] == [("/x.rar", "T & M", "https://h.tr/x.rar"), ("/y.rar", "ıı Ü &unknown; &", "https://h.tr/y.rar"), ("/z.rar", "Z", "https://h.tr/z.rar"), ("/q&r.rar", "Q R", "https://h.tr/q&r.rar")]
    chosen = spark.createDataFrame([(1, "<select><OPTION VALUE='00'>Seçiniz</OPTION><option selected value=5>Adalet &amp; Hukuk</option><option>x</option></select>")], "k int, html string")
    assert [tuple(r) for r in H.options(chosen, "html", ["k"]).collect()] == [(1, 1, "5", "Adalet & Hukuk")]


def test_card(spark):
    html = '<div class="card"><a href="/upload/BY2024KT0902.pdf"><b>Klavye Teknikleri</b></a><ul><li>Adalet</li><li>9.Sınıf</li><li>12.12.2024 00:00:00</li></ul></div>'
    row = H.cards(spark.createDataFrame([(1, html)], "k int, html string"), "html", ["k"]).first()
    assert (row["title"], row["area"], row["grade"], row["date"], row["year"], row["url"]) == ("Klavye Teknikleri", "Adalet", 9, "12.12.2024 00:00:00", "2024", "/upload/BY2024KT0902.pdf")


def test_timetable(spark):
    table = [["KATEGORİ", "DERSLER", "9. SINIF", "10.", ""], ["", "", "", "SINIF", ""], ["", "", "", "", ""], ["MESLEK DERSLERİ", "", "", "", ""], ["", "TEMEL BİLİŞİM (*)", "4", "", ""], ["", "AĞLAR", "", "", "3"], ["TOPLAM", "", "9", "9", ""]]
    cells = [(1, 0, r, c, x) for r, row in enumerate(table) for c, x in enumerate(row)]
    df = spark.createDataFrame(cells, "doc long, table_no int, row_no int, col_no int, text string")
    got = sorted(tuple(r) for r in TT.courses(df).select("course", "grade", "hours").collect())
    assert got == [("Ağlar", 9, 3), ("Ağlar", 10, 3), ("Temel Bilişim", 9, 4), ("Temel Bilişim", 10, 4)]


def test_archives_and_listing(spark, tmp_path):
    for name, head in {"a.rar": b"Rar!", "b.zip": b"PK34", "c.rar": b"7z45", "~$d.rar": b"Rar!", "e.txt": b"x"}.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_bytes(head + b"0" * 2000)
    found = S.listing(spark, str(tmp_path), ("rar", "zip"))
    assert sorted(r["relative_path"] for r in found.collect()) == ["sub/a.rar", "sub/b.zip", "sub/c.rar"]
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["m"]) for r in content.withColumn("kind", S.archive_kind(F.col("content"))).withColumn("m", S.kind_mismatch(F.col("path"), F.col("kind"))).collect()}
    assert kinds["a.rar"] == ("RAR", False) and kinds["c.rar"] == ("7Z", True) and kinds["e.txt"][0].startswith("UNKNOWN")


def test_header_in_any_case(spark):
    body = "Fatura 3 18 22 Vergi 2 9 11"
    heads = ["ÖĞRENME BİRİMİ KAZANIM SAYISI DERS SAATİ ORAN (%)", "Öğrenme Birimi Kazanım Sayısı Ders Saati Oran (%)", "öğrenme birimi kazanım sayısı oran ( % )", "Kazanım Sayısı Oran(%)", "OGRENME BIRIMI SURE ( % )"]
    df = spark.createDataFrame([(i, f"{h} {body}") for i, h in enumerate(heads)] + [(9, body), (10, None)], "k int, t string")
    assert {r["k"]: r["x"] for r in df.select("k", X.headless(F.col("t")).alias("x")).collect()} == {**{i: body for i in range(5)}, 9: body, 10: None}


def plain_judged(low, titles):
    out = []
    for t, n in titles:
        places = [i for i in range(len(low) - len(t) + 1) if low.startswith(t, i)] if t else []
        good = [p for p in places if all(f"{i}." in low[p : p + X.VALID_WITHIN] or f"{i} " in low[p : p + X.VALID_WITHIN] for i in range(1, n + 1))]
        out.append((len(places), len(good), good[0] + 1 if good else None))
    return out


def test_titles_are_judged_as_by_plain_search(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(X, "VALID_WITHIN", 40)
    for _ in range(300):
        low = "".join(rng.choice(["A", "AB", "BA", " ", "1", "2. ", "3 ", "11.", "10 ", "\n"]) for _ in range(rng.randint(0, 80)))
        titles = [("".join(rng.choice("AB ") for _ in range(rng.randint(0, 4))), rng.randint(0, 4)) for _ in range(5)]
        assert X.judged(low, titles) == plain_judged(low, titles), (low, titles)


def test_many_titles_in_a_long_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcçdeğı") for _ in range(5)) for _ in range(200)]
    titles = [" ".join(rng.choice(words) for _ in range(2)) for _ in range(50)]
    text = " ".join(rng.choice(words) if rng.random() < 0.9 else rng.choice([*titles, "1. ", "2. "]) for _ in range(160_000))
    began = time.process_time()
    told = X.judged(text, [(t, 2) for t in titles])
    assert len(text) > 900_000 and time.process_time() - began < 4 and sum(n for n, _, _ in told) > 10_000
    at = 0
    for _ in range(told[0][0]):
        at = text.index(titles[0], at) + 1
    assert text.find(titles[0], at) < 0
    got = spark.createDataFrame([("aXaXa\\E", "axa"), ("abc", ""), (None, "a"), ("q\\E.", "\\E.")], "t string, k string").select(X.occurrences(F.col("t"), F.col("k"))).collect()
    assert [r[0] for r in got] == [[1, 3], None, None, [2]]


def test_checked_topics_pass_over_other_numbers(spark):
    text = "1. Giriş 19. Yüzyıl ve 2. yüzyıl 2. Ağlar (3. x) x3. Y 3. Son 2. Tekrar"
    one = spark.createDataFrame([(1, text, 4), (2, "", 1), (3, None, 2)], "k int, t string, n int")
    got = {r["k"]: r["x"] and [x["topic"] for x in r["x"]] for r in one.select("k", X.topics(F.col("t"), F.col("n"), True).alias("x")).collect()}
    assert got[1] == ["Giriş 19. Yüzyıl ve 2. yüzyıl", "Ağlar (3. x) x3. Y", "Son 2. Tekrar", X.NOT_FOUND] and got[2] == [X.NOT_FOUND]


def test_listing_of_a_folder_named_like_a_pattern(spark, tmp_path):
    folder = tmp_path / "a+(b) [c].d"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "x.RAR").write_bytes(b"Rar!")
    assert [r["relative_path"] for r in S.listing(spark, str(folder), ("rar",)).collect()] == ["sub/x.RAR"]
