"""Scalar text functions (F1-F29) over names, links and texts of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dizin.functions import text as T
from dizin.operators import browse as B
from dizin.plans.registry import Tables, query

#: Names with capitals, hyphens, small words and Turkish letters, one per part.
NAMES_SQL = """(SELECT p_partkey AS id, replace(upper(p_name), 'I', 'İ') || ' - ' || p_type || ' ve ILIK ' || p_brand || CASE WHEN p_size % 3 = 0 THEN ' - Protokol' ELSE '' END AS name,
  p_name, p_type, p_brand, p_size, CAST(9 + p_size % 4 AS INT) AS grade FROM part)"""
LINKS_SQL = """(SELECT p_partkey AS id, CAST(9 + p_size % 4 AS INT) AS grade, p_size, p_name,
  CASE p_size % 5 WHEN 0 THEN '/upload/dbf' || (9 + p_size % 4) || '/' WHEN 1 THEN 'https://files.example.com/upload/dbf/' WHEN 2 THEN '/cop9/upload/' WHEN 3 THEN 'cop' || (9 + p_size % 4) || '/upload/' ELSE 'docs/' END
    || replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN 'pro_' ELSE '_' END) || '_' || (9 + p_size % 4) || CASE p_size % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.rar' WHEN 2 THEN '.ZIP' ELSE '' END AS href FROM part)"""


def names(t: Tables):
    end = F.when(F.col("p_size") % 3 == 0, " - Protokol").otherwise("")
    name = F.concat(F.replace(F.upper("p_name"), F.lit("I"), F.lit("İ")), F.lit(" - "), "p_type", F.lit(" ve ILIK "), "p_brand", end)
    return t.part.select(F.col("p_partkey").alias("id"), name.alias("name"), "p_name", "p_type", "p_brand", "p_size", (9 + F.col("p_size") % 4).cast("int").alias("grade"))


def links(t: Tables):
    size, grade = F.col("p_size"), (9 + F.col("p_size") % 4).cast("int")
    text = grade.cast("string")
    head = (
        F.when(size % 5 == 0, F.concat(F.lit("/upload/dbf"), text, F.lit("/"))).when(size % 5 == 1, "https://files.example.com/upload/dbf/")
        .when(size % 5 == 2, "/cop9/upload/").when(size % 5 == 3, F.concat(F.lit("cop"), text, F.lit("/upload/"))).otherwise("docs/")
    )
    stem = F.replace("p_name", F.lit(" "), F.when(size % 2 == 0, "pro_").otherwise("_"))
    end = F.when(size % 4 == 0, ".pdf").when(size % 4 == 1, ".rar").when(size % 4 == 2, ".ZIP").otherwise("")
    return t.part.select(F.col("p_partkey").alias("id"), grade.alias("grade"), "p_size", "p_name", F.concat(head, stem, F.lit("_"), text, end).alias("href"))


@query(f"""
WITH n AS (SELECT id, regexp_replace(name, ' ?- ?', '-', 'g') AS name FROM {NAMES_SQL}),
w AS (SELECT id, string_split(trim(regexp_replace(replace(lower(translate(name, 'İI', 'iı')), '-', ' - '), '\\s+', ' ', 'g')), ' ') AS w FROM n),
c AS (SELECT id, list_transform(w, lambda x, i: CASE WHEN x = '-' OR (x IN ('ve', 'ile', 'için', 'de', 'da', 'ki') AND i > 1) THEN x
  WHEN x LIKE 'i%' THEN 'İ' || x[2:] ELSE upper(x[1]) || x[2:] END) AS w FROM w)
SELECT id, replace(array_to_string(w, ' '), ' - ', '-') AS title FROM c""")
def f01_title_case(t):
    return names(t).select("id", T.title_case_tr(F.col("name")).alias("title"))


@query(f"""SELECT id, CASE WHEN contains(name, ' - Protokol') THEN translate(replace(name, ' - Protokol', ''), ' /çğıöşüÇĞİÖŞÜĠġĢģĜĝ', '__cgiosuCGIOSUIiSsGg') || '-Protokol'
  ELSE translate(name, ' /çğıöşüÇĞİÖŞÜĠġĢģĜĝ', '__cgiosuCGIOSUIiSsGg') END AS folder FROM {NAMES_SQL}""")
def f02_safe_name(t):
    return names(t).select("id", T.safe_name(F.col("name")).alias("folder"))


@query("SELECT doc_id, trim(regexp_replace(upper(translate(text, 'çğıöşüÇĞİÖŞÜß', 'cgiosuCGIOSUS')), '\\s+', ' ', 'g')) AS match_key FROM documents")
def f03_match_key(t):
    return t.documents.select("doc_id", T.match_key(F.col("text")).alias("match_key"))


@query("SELECT conv_id, turn, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS cell FROM conversations")
def f04_clean_cell(t):
    return t.conversations.select("conv_id", "turn", T.clean_cell(F.col("text")).alias("cell"))


DATES = "CASE o_orderkey % 4 WHEN 0 THEN 'no ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d.%m.%Y') || ' 00:00' WHEN 1 THEN strftime(o_orderdate + INTERVAL 20 YEAR, 'at %Y-%m-%d') WHEN 2 THEN 'year ' || (1995 + o_orderkey % 20) ELSE o_orderpriority END"


@query(f"""WITH o AS (SELECT o_orderkey, {DATES} AS d FROM orders),
f AS (SELECT o_orderkey, list_filter(regexp_extract_all(d, '\\d{{2}}\\.\\d{{2}}\\.(\\d{{4}})', 1), lambda y: y BETWEEN '2000' AND '2030') AS a,
  list_filter(regexp_extract_all(d, '(\\d{{4}})-\\d{{2}}-\\d{{2}}', 1), lambda y: y BETWEEN '2000' AND '2030') AS b, list_filter(regexp_extract_all(d, '(\\d{{4}})', 1), lambda y: y BETWEEN '2000' AND '2030') AS c,
  regexp_extract(d, '(\\d{{4}})', 1) AS x, regexp_extract(d, '\\d{{2}}\\.\\d{{2}}\\.(\\d{{4}})', 1) AS y, regexp_extract(d, '(\\d{{4}})-\\d{{2}}-\\d{{2}}', 1) AS z FROM o)
SELECT o_orderkey, coalesce(a[1], b[1], c[1]) AS year_all, CASE WHEN x BETWEEN '2000' AND '2030' THEN x WHEN y BETWEEN '2000' AND '2030' THEN y WHEN z BETWEEN '2000' AND '2030' THEN z END AS year_single,
  CASE WHEN x BETWEEN '2000' AND '2030' THEN x END AS year_bare FROM f""")
def f05_year(t):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("no "), key.cast("string"), F.lit(" of "), F.date_format(date, "dd.MM.yyyy"), F.lit(" 00:00")))
        .when(key % 4 == 1, F.concat(F.lit("at "), F.date_format(F.add_months(date, 240), "yyyy-MM-dd")))
        .when(key % 4 == 2, F.concat(F.lit("year "), (1995 + key % 20).cast("string"))).otherwise(F.col("o_orderpriority"))
    )
    d = t.orders.select("o_orderkey", text.alias("d"))
    return d.select("o_orderkey", T.year_all(F.col("d")).alias("year_all"), T.year_single(F.col("d")).alias("year_single"), T.year_bare(F.col("d")).alias("year_bare"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 2 THEN NULL ELSE CAST(9 + p_size % 4 AS INT) END AS grade FROM part")
def f06_grade(t):
    g = (9 + F.col("p_size") % 4).cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(g, F.lit(". Sınıf"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), g, F.lit("Sınıf"))).otherwise("Sınıf")
    return t.part.select(F.col("p_partkey").alias("id"), T.grade(text).alias("grade"))


@query("SELECT p_partkey AS id, p_name || p_type AS name FROM part")
def f07_footnotes(t):
    marked = F.concat("p_name", F.lit(" ("), F.expr("repeat('*', 1 + p_size % 3)"), F.lit(") "), "p_type")
    return t.part.select(F.col("p_partkey").alias("id"), T.without_footnotes(marked).alias("name"))


@query(f"SELECT id, lower(string_split(href, '/')[-1]) LIKE '%pro%' AS by_file FROM {LINKS_SQL}")
def f08_protocol_file(t):
    return links(t).select("id", T.is_protocol_file(F.col("href")).alias("by_file"))


@query(f"""SELECT id, regexp_matches(name, '-\\s*[Pp]rotokol') AS is_protocol, CASE WHEN regexp_matches(name, '-\\s*[Pp]rotokol') THEN name ELSE name || ' - Protokol' END AS with_suffix,
  regexp_replace(name, '\\s*-\\s*[Pp]rotokol\\s*$', '') AS base FROM {NAMES_SQL}""")
def f09_protocol_name(t):
    n = F.col("name")
    return names(t).select("id", T.is_protocol_name(n).alias("is_protocol"), T.protocol_name(n).alias("with_suffix"), T.base_name(n).alias("base"))


@query(f"""SELECT id, CAST(CASE WHEN contains(href, '/cop9/upload/') THEN NULL WHEN contains(href, '/upload/dbf' || grade || '/') THEN 10 WHEN contains(href, '/upload/') AND contains(href, 'dbf') THEN 5
  WHEN NOT (contains(href, 'cop') AND contains(href, 'upload')) THEN 1 END AS INT) AS score FROM {LINKS_SQL}""")
def f10_link_score(t):
    return links(t).select("id", T.link_score(F.col("href"), F.col("grade")).alias("score"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages)
SELECT page_id, href, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN host || href ELSE host || '/' || href END AS url FROM h""")
def f11_absolute_url(t):
    h = t.pages.select("page_id", F.col("url").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))).alias("href"))
    return h.select("page_id", "href", T.absolute_url(F.col("href"), F.col("page")).alias("url"))


@query(f"""WITH x AS (SELECT id, grade, string_split(href, '/')[-1] AS f FROM {LINKS_SQL}), y AS (SELECT id, grade, CASE WHEN regexp_matches(lower(f), '\\.(pdf|rar|zip)$') THEN f ELSE f || '.pdf' END AS f FROM x)
SELECT id, f AS file, regexp_replace(f, '\\.[^.]*$', '') || '_' || grade || regexp_extract(f, '(\\.[^.]*)$', 1) AS with_infix FROM y""")
def f12_file_name(t):
    h = F.col("href")
    return links(t).select("id", T.file_name(h).alias("file"), T.file_name(h, F.col("grade").cast("string")).alias("with_infix"))


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') END AS code, CASE WHEN p_size % 3 = 1 THEN p_size % 90 END AS area_id,
  CASE WHEN p_size % 7 = 0 THEN 'upload' ELSE replace(p_name, ' ', '_') END AS safe FROM part)
SELECT id, coalesce(code || '_' || safe, lpad(CAST(area_id AS VARCHAR), 2, '0') || '_' || safe, safe) AS folder FROM x""")
def f13_folder_key(t):
    size = F.col("p_size")
    code = F.when(size % 3 == 0, F.lpad(size.cast("string"), 2, "0"))
    id_ = F.when(size % 3 == 1, size % 90)
    return t.part.select(F.col("p_partkey").alias("id"), T.folder_key(code, id_, F.when(size % 7 == 0, "").otherwise(F.col("p_name")), F.lit("http://x.example/upload/a.rar")).alias("folder"))


CODE_URLS = "['/upload/cop9/' || p_name || '.pdf', CASE p_size % 4 WHEN 0 THEN '/list?alan_id=' || p_size WHEN 1 THEN '/upload/' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_x.rar' WHEN 2 THEN '/upload/dbf9/07_x.rar' ELSE NULL END, '/files/77_y.zip']"


@query(f"""WITH x AS (SELECT p_partkey AS id, unnest({CODE_URLS}) AS u, unnest([1, 2, 3]) AS i FROM part),
y AS (SELECT id, i, coalesce(CASE WHEN regexp_matches(u, 'alan_id=\\d+') THEN lpad(CAST(CAST(regexp_extract(u, 'alan_id=(\\d+)', 1) AS INT) AS VARCHAR), 2, '0') END, nullif(regexp_extract(u, '/(\\d{{2}})_[^/]+\\.(rar|zip|pdf)$', 1), '')) AS code
  FROM x WHERE u IS NOT NULL AND NOT regexp_matches(u, '(cop|dbf)\\d+'))
SELECT id, arg_min(code, i) AS code FROM y WHERE code IS NOT NULL GROUP BY id""")
def f14_area_code(t):
    size = F.col("p_size")
    second = F.when(size % 4 == 0, F.concat(F.lit("/list?alan_id="), size.cast("string"))).when(size % 4 == 1, F.concat(F.lit("/upload/"), F.lpad(size.cast("string"), 2, "0"), F.lit("_x.rar"))).when(size % 4 == 2, "/upload/dbf9/07_x.rar")
    urls = F.array(F.concat(F.lit("/upload/cop9/"), "p_name", F.lit(".pdf")), second, F.lit("/files/77_y.zip"))
    return t.part.select(F.col("p_partkey").alias("id"), T.area_code(urls).alias("code"))


def _stored(size):
    return F.when(size % 3 == 0, F.concat(F.lit('{"9": "u/'), size.cast("string"), F.lit('", "10": {"url": "v", "update_year": "2024"}}'))).when(size % 3 == 1, F.concat(F.lit("w/"), size.cast("string"))).otherwise("")


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN '10=v,9=new/cop9/' || p_size ELSE '10=v,9=u/' || p_size || ',url_3=new' END
  WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '9=new/cop9/' || p_size || ',default=w/' || p_size ELSE 'default=w/' || p_size || ',url_2=new' END
  ELSE CASE WHEN p_size % 2 = 0 THEN '9=new/cop9/' || p_size ELSE 'url_1=new' END END AS urls FROM part""")
def f15_merge_url(t):
    size = F.col("p_size")
    new = F.when(size % 2 == 0, F.concat(F.lit("new/cop9/"), size.cast("string"))).otherwise("new")
    merged = T.merge_url(T.url_map(_stored(size)), new)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return t.part.select(F.col("p_partkey").alias("id"), text.alias("urls"))


@query("""WITH x AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN [{'g': '9', 'u': 'u/' || p_size}, {'g': '10', 'u': 'v'}] WHEN 1 THEN [{'g': 'default', 'u': 'w/' || p_size}] ELSE [] END AS m FROM part),
y AS (SELECT id, unnest(m) AS e FROM x) SELECT id, e.g AS grade, e.u AS url FROM y""")
def f16_url_map(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(T.url_map(_stored(F.col("p_size")))).alias("grade", "url"))


@query("SELECT p_partkey AS id, CAST(CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 2 ELSE 0 END AS INT) AS hours FROM part")
def f17_duration(t):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit("/36"))).when(size % 3 == 1, (size * 2).cast("string")).otherwise("-")
    return t.part.select(F.col("p_partkey").alias("id"), T.duration(text).alias("hours"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'http://x/' || p_name ELSE 'http://files/api/' || replace(replace(p_type || '/' || p_name || ' ş+*~.pdf', 'ş+*~', '%C5%9F%2B%2A~'), ' ', '%20') END AS path FROM part""")
def f18_encoded_path(t):
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("http://x/"), "p_name")).otherwise(F.concat("p_type", F.lit("/"), "p_name", F.lit(" ş+*~.pdf")))
    return t.part.select(F.col("p_partkey").alias("id"), T.encoded_path(path, "http://files/api/").alias("path"))


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, '') AS name, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 0) AS hours FROM part")
def f19_null_defaults(t):
    held = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("hours"))
    return B.with_defaults(held, {"name": "", "hours": 0})


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN (9 + p_size % 4) || '. Sınıf (2024)' WHEN 1 THEN (9 + p_size % 4) || '. Sınıf' ELSE p_type END AS label FROM part""")
def f20_grade_label(t):
    size, g = F.col("p_size"), (9 + F.col("p_size") % 4).cast("string")
    key = F.when(size % 3 == 0, F.concat(F.lit("sinif_"), g)).when(size % 3 == 1, g).otherwise(F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), T.grade_label(key, F.when(size % 3 == 0, "2024")).alias("label"))


@query(f"SELECT id, CASE WHEN lower(href) LIKE '%.pdf' THEN 'PDF' WHEN lower(href) LIKE '%.docx' THEN 'DOCX' ELSE 'DBF' END AS kind FROM {LINKS_SQL}")
def f21_file_type(t):
    return links(t).select("id", T.file_type(F.col("href")).alias("kind"))


@query("SELECT doc_id, CAST(floor(n_chars * 1000 / 1048576) AS BIGINT) AS mb, round(doc_id / n_chars, 9) AS part FROM documents")
def f22_megabytes_progress(t):
    return t.documents.select("doc_id", T.megabytes(F.col("n_chars") * 1000).alias("mb"), T.rounded(T.progress(F.col("doc_id"), F.col("n_chars")), 9).alias("part"))


@query(f"""WITH x AS (SELECT *, CASE p_size % 3 WHEN 0 THEN p_name || 'MTAL9.SınıfÇerçeve' WHEN 1 THEN p_name || 'Çerçeve Öğretim Programı2024-41' ELSE 'Çerçeve Öğretim Programı2024-41' END AS text FROM {LINKS_SQL}),
y AS (SELECT *, string_split(replace(replace(regexp_replace(string_split(href, '/')[-1], '\\.pdf$', ''), '_' || grade, ''), '_', ' '), ' ') AS w FROM x)
SELECT id, CASE WHEN p_size % 3 < 2 THEN p_name ELSE array_to_string(list_transform(w, lambda v: upper(v[1]) || lower(v[2:])), ' ') END AS area FROM y""")
def f23_link_area(t):
    phrase = F.lit("Çerçeve Öğretim Programı2024-41")
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("MTAL9.SınıfÇerçeve"))).when(F.col("p_size") % 3 == 1, F.concat("p_name", phrase)).otherwise(phrase)
    return links(t).select("id", T.link_area(text, F.col("href"), F.col("grade")).alias("area"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 3 THEN 'U ' || p_name ELSE upper(p_name[1]) || p_name[2:] END AS title FROM part""")
def f24_gentle_title(t):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    size = F.col("p_size") % 4
    title = F.when(size == 0, F.concat(F.lit("U "), name)).when(size == 1, F.concat(F.lit("TABLOSU "), name)).when(size == 2, F.concat(F.lit(" "), name)).otherwise(F.concat(F.lit("U "), "p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), T.gentle_title(title).alias("title"))


@query("SELECT p_partkey AS id, p_size % 4 = 0 AS is_item FROM part")
def f25_item_number(t):
    size = F.col("p_size") % 4
    before = F.when(size == 1, "15-").otherwise("x ")
    after = F.when(size == 2, " yüzyılda Avrupa").when(size == 3, " küçük").otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    return t.part.select(F.col("p_partkey").alias("id"), T.is_item_number(before, after).alias("is_item"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), y AS (SELECT doc_id, line, upper(line) AS u FROM x)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(line) >= 5 AND NOT regexp_matches(u, 'DERS |HAFTA|SAAT|TOPLAM|UYGULAMA|FAALİYET|TEMRİN|DEĞERLEND|SINAMA|ÖLÇME|TEST|ÖRNEK') AND (len(line) >= 10 OR regexp_matches(line, '\\pL'))) AS n_ok,
  CAST(sum(least(len(line), 200)) AS BIGINT) AS n_kept FROM y GROUP BY doc_id""")
def f26_outcome_text(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_outcome(F.col("line"))).alias("n_ok"), F.sum(F.length(T.outcome_text(F.col("line")))).alias("n_kept"))


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def f27_trailing_commas(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.without_commas(F.concat("p_name", F.expr("repeat(',', p_size % 3)"))).alias("name"))


@query(f"SELECT id, upper(translate(name, 'çğıöşüÇĞİÖŞÜß', 'cgiosuCGIOSUS')) = upper(p_name || ' - ' || p_type || ' ve ILIK ' || p_brand) AS same FROM {NAMES_SQL}")
def f28_fold_compare(t):
    plain = F.concat("p_name", F.lit(" - "), "p_type", F.lit(" ve ilık "), "p_brand")
    return names(t).select("id", (T.fold(F.col("name")) == T.fold(plain)).alias("same"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS INT) AS hours FROM part")
def f29_hours(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" saat")))
    return t.part.select(F.col("p_partkey").alias("id"), T.hours(text).alias("hours"))
