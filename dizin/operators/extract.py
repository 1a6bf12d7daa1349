"""Course forms: sections, unit tables, topics and outcomes out of whole texts.

Positions are found in a folded copy of the text that has the same length, and cut from the text
itself. All is made of the text of one row, so texts never leave their task: functions on Arrow batches fold
each text once and take time in proportion to it; what is made of their results are column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from dizin.functions import text as T

#: Fields of a form, the headings that begin them (longest first) and those that end them.
FIELDS = (
    ("name", ("DERSİN ADI", "ADI"), ("DERSİN", "DERSĠN")),
    ("grade", ("DERSİN SINIFI", "SINIFI"), ("DERSİN", "DERSĠN")),
    ("duration", ("DERSİN SÜRESİ", "SÜRESİ"), ("DERSİN", "DERSĠN")),
    ("purpose", ("DERSİN AMACI", "AMACI"), ("DERSİN", "DERSĠN")),
    ("outcomes", ("DERSİN KAZANIMLARI", "KAZANIMLARI"), ("EĞİTİM", "EĞĠTĠM", "EĞ", "DONAT")),
    ("equipment", ("DONANIMI",), ("ÖLÇ", "DEĞERLENDİRME")),
    ("assessment", ("DEĞERLENDİRME",), ("DERSİN", "DERSĠN", "KAZANIM", "ÖĞRENME")),
)
#: Headings of the unit table, and what ends it.
TABLE_HEADS = ("KAZANIM SAYISI VE SÜRE TABLOSU", "DERSİN KAZANIM TABLOSU", "TABLOSU", "TABLOS U", "TABLO SU", "TABL OSU", "TAB LOSU", "TA BLOSU")
TABLE_ENDS, TABLE_LEAST = ("TOPLAM", "ÖĞRENME BİRİMİ"), 50
#: How header rows of the unit table begin and end, folded.
TABLE_HEADERS = (("OGRENME", re.compile(r"\(\s*%\s*\)", re.A)), ("KAZANIM", re.compile(r"ORAN\s*\(\s*%\s*\)", re.A)))
NUMBER = r"\d+(?:[,.]\d+)?"
#: Shapes of a table row by priority, and the groups of each that hold count, hours, second part of hours, percentage. A title has no digits.
TITLE = r"([^0-9]{2,}+)(?<=\s)"
SHAPES = tuple((re.compile(TITLE + pattern, re.A), *groups) for pattern, *groups in (
    (rf"(\d+)\s+(\d+)\s*/\s*(\d+)\s+({NUMBER})", 2, 3, 4, 5),
    (rf"(\d+)\s+(\d+)\s+({NUMBER})", 2, 3, 0, 4),
    (r"(\d+)\s+(\d+)(?=\s|$)", 2, 3, 0, 0),
    (r"(\d+)\s+(\d+[,.]\d+)\s*%?", 2, 0, 0, 3),
    (r"(\d+)(?=\s|$)", 2, 0, 0, 0),
))
#: Headings of the unit area, and words that stop it.
AREA_HEADS = ("ÖĞRENME BİRİMİ", "KONULAR", "ÖĞRENME BİRİMİ KAZANIMLARI", "KAZANIM AÇIKLAMLARI", "AÇIKLAMALARI")
AREA_STOPS = ("UYGULAMA", "FAALİYET", "TEMRİN", "DERSİN", "DERSĠN")
#: Characters in which a title's numbers must stand, and how the fallback looks around a 1.
VALID_WITHIN, BACK, TITLE_LEAST, AHEAD = 4000, 100, 10, 500
#: What ends a topic area: a long line of capitals, a numbered heading, or a stop word.
AREA_BREAKS = re.compile(r"\n[A-ZÜĞIŞÖÇ][A-ZÜĞIŞÖÇ\s]{10,}|\n\d+\.\s*[A-ZÜĞIŞÖÇ]|DERSİN|DERSĠN|UYGULAMA|FAALİYET|TEMRİN", re.A)
NOT_FOUND = "[Konu bulunamadı]"


def _fold_literal(s: str) -> str:
    return s.translate(str.maketrans(T.ASCII_FROM + "ß" + "Ġ", T.ASCII_TO + "S" + "I")).upper()


def folded(text: Column) -> Column:
    return F.translate(T.fold(text), "Ġ", "I")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut(text: Column, start: Column, end: Column | None) -> Column:
    """Characters from start up to before end; to the end of the text if end is null."""
    return F.substr(text, start, F.coalesce(end, F.length(text) + 1) - start)


_FOLDS = tuple(zip(T.ASCII_FROM + "ß", T.ASCII_TO + "S", strict=True))


def low_of(text: str) -> str:
    """What ``folded`` gives for one text."""
    for a, b in _FOLDS:
        text = text.replace(a, b)
    return text.upper().replace("Ġ", "I")


def each(use, kind: str = "string", held: pa.DataType = pa.string()):  # noqa: B008
    """A function of a text and another column, or of a text alone, on Arrow batches: ``use`` of the values of each row, null where the text is null."""

    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else use(x) for x in texts.to_pylist()], held)

    def of_both(texts: pa.Array, others: pa.Array) -> pa.Array:
        return pa.array([None if x is None else use(x, y) for x, y in zip(texts.to_pylist(), others.to_pylist(), strict=True)], held)

    return lambda text, *other: F.arrow_udf(of_both if other else of_text, kind)(text, *other)


def _first_of(keys, low: str, start: int = 0) -> int:
    """The earliest position (from 0) of any of the keys, folded; -1 if there is none."""
    return min((p for p in [low.find(k, start) for k in keys] if p >= 0), default=-1)


def _section(text: str, low: str, starts, ends) -> str | None:
    for k in starts:
        if (at := low.find(k)) >= 0:
            at += len(k)
            end = _first_of(ends, low, at)
            return T.spaces_of(text[at : end if end >= 0 else None].lstrip(": \t\n\v\f\r"))
    return None


def _folded_all(keys) -> tuple[str, ...]:
    return tuple(map(_fold_literal, keys))


def section(text: Column, starts, ends) -> Column:
    """X1. What stands between the longest starting heading that occurs and the next ending one; null without a start."""
    starts, ends = _folded_all(starts), _folded_all(ends)
    return each(lambda x: _section(x, low_of(x), starts, ends))(text)


FIELD_KEYS = tuple((name, _folded_all(starts), _folded_all(ends)) for name, starts, ends in FIELDS)
FIELD_TYPE = [(name, pa.string()) for name, *_ in FIELDS]


def _sections(text: str, low: str) -> dict[str, str | None]:
    return {name: _section(text, low, starts, ends) for name, starts, ends in FIELD_KEYS}


_sections_of = each(lambda x: _sections(x, low_of(x)), f"struct<{','.join(f'{name}:string' for name, _ in FIELD_TYPE)}>", pa.struct(FIELD_TYPE))


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """X1. ``df`` with a column per field of ``FIELDS``; the text is folded once for all."""
    kept = [c for c in df.columns if c not in {name for name, *_ in FIELDS}]
    return df.select(*kept, _sections_of(F.col(text)).alias("fields of the form")).select(*kept, "`fields of the form`.*")


_TABLE_HEADS, _TABLE_ENDS = _folded_all(TABLE_HEADS), _folded_all(TABLE_ENDS)


def _bounds(text: str, low: str) -> str | None:
    at = _first_of(_TABLE_HEADS, low)
    if at < 0:
        return None
    at += next(len(h) for h in _TABLE_HEADS if low.startswith(h, at))
    end = _first_of(_TABLE_ENDS, low, at + TABLE_LEAST)
    return text[at : end if end >= 0 else None].strip(" ")


_bounds_of = each(lambda x: _bounds(x, low_of(x)))


def table_bounds(text: Column) -> Column:
    """X2. The unit table of a form with its header; null without a table."""
    return _bounds_of(text)


def _headless(body: str, low: str) -> str:
    for begin, close in TABLE_HEADERS:
        kept, at = [], 0
        while (start := low.find(begin, at)) >= 0 and (end := close.search(low, start + len(begin))):
            kept.append(body[at:start])
            at = end.end()
        out = ("".join(kept) + body[at:]).strip(" ")
        if len(out) < len(body):
            return out
    return body


_headless_of = each(lambda x: _headless(x, low_of(x)))


def headless(table: Column) -> Column:
    """X3. A table without its header, written in any case: the first kind of header whose loss shortens it counts."""
    return _headless_of(table)


def _table(text: str, low: str) -> str | None:
    body = _bounds(text, low)
    return None if body is None else _headless(body, low_of(body))


_table_of = each(lambda x: _table(x, low_of(x)))


def table_section(text: Column) -> Column:
    """X2, X3. The unit table of a form without its header; null without a table."""
    return _table_of(text)


ROW_TYPE = pa.struct([("title", pa.string()), ("count", pa.int32()), ("duration", pa.string()), ("percentage", pa.string())])
_NO_DIGITS, _DIGITS = re.compile(r"[^0-9]*+"), re.compile(r"[0-9]*+")


def _matches(pattern: re.Pattern, table: str) -> Iterator[re.Match]:
    """All matches of a shape, left to right. A title begins where the match before or a number ends: no later place between two numbers can match if that one does not, so none is tried twice."""
    at = _DIGITS.match(table).end()
    while at < len(table):
        if m := pattern.match(table, at):
            yield m
            at = _DIGITS.match(table, m.end()).end()
        else:
            at = _DIGITS.match(table, _NO_DIGITS.match(table, at).end()).end()


def _row(m: re.Match, count: int, hours: int, second: int, part: int) -> dict:
    duration = "-" if not hours else f"{m[hours]}/{m[second]}" if second else m[hours]
    n = m[count].lstrip("0") or "0"
    return {"title": T.spaces_of(m[1]), "count": int(n) if len(n) < 11 and int(n) < 1 << 31 else None, "duration": duration, "percentage": m[part] if part else "-"}


def _rows(table: str) -> list[dict] | None:
    for pattern, *groups in SHAPES:
        if rows := [_row(m, *groups) for m in _matches(pattern, table)]:
            return [r for r in rows if low_of(r["title"]) != "TOPLAM"]
    return None


_rows_of = each(_rows, "array<struct<title:string,count:int,duration:string,percentage:string>>", pa.list_(ROW_TYPE))


def table_rows(table: Column) -> Column:
    """X4, X5. Rows ``struct<title, count, duration, percentage>`` of the first shape that matches anywhere; null if none does. A count beyond an int is null."""
    return _rows_of(table)


def units(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """X2-X5. ``(keep, seq, title, count, duration, percentage)``, one row per unit of each form's table."""
    out = df.select(*keep, F.posexplode(table_rows(table_section(F.col(text)))).alias("pos", "u"))
    return out.select(*keep, (F.col("pos") + 1).alias("seq"), "u.*")


def joined_lines(lines: DataFrame, keep: list[str], number: str, line: str) -> DataFrame:
    """X6. Lines that end without a number put before the next that ends with one. Lines that are dealt by ``keep`` already stay in their tasks."""
    ends = F.trim(line).rlike(r"\d+\s*%?$")
    run = Window.partitionBy(*keep).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    grouped = lines.withColumn("row", F.coalesce(F.sum(ends.cast("int")).over(run), F.lit(0)))
    text = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.trim(line).alias("l"))))["l"], " ")
    return grouped.groupBy(*keep, "row").agg(text.alias("line"))


def typed_row(line: Column) -> Column:
    """X7. ``struct<title, values>`` of a row of columns two spaces apart; null for totals and rows without a title."""
    parts = F.filter(F.split(F.trim(line), r"\s{2,}"), lambda x: x != "")
    title = F.get(parts, F.lit(0))
    bad = (F.length(title) < 2) | (folded(title) == "TOPLAM")
    return F.when(title.isNotNull() & ~bad, F.struct(title.alias("title"), F.slice(parts, F.lit(2), F.size(parts)).alias("values")))


_AREA_HEADS, _AREA_STOPS = _folded_all(AREA_HEADS), _folded_all(AREA_STOPS)


def _area(text: str, low: str) -> str:
    total = low.find("TOPLAM")
    if total < 0:
        return text
    total += len("TOPLAM")
    at = _first_of(_AREA_HEADS, low, total)
    at = at if at >= 0 else total
    end = _first_of(_AREA_STOPS, low, at)
    return text[at : end if end >= 0 else None]


_area_of = each(lambda x: _area(x, low_of(x)))


def unit_area(text: Column) -> Column:
    """X8. Where the units are described: after the first total, from a heading to a stop word; all without a total."""
    return _area_of(text)


#: So many keys are sought one by one; more by an automaton, which takes longer to make than a short text to read.
FEW = 12


def _found(text: str, keys: set[str]) -> dict[str, list[int]]:
    """Where each key begins in the text (from 0), overlapping ones too; the text is read once for many keys."""
    places: dict[str, list[int]] = {k: [] for k in keys}
    if len(keys) <= FEW:
        for k in filter(None, keys):
            at = -1
            while (at := text.find(k, at + 1)) >= 0:
                places[k].append(at)
    elif any(keys):
        machine = ahocorasick.Automaton()
        for k in filter(None, keys):
            machine.add_word(k, k)
        machine.make_automaton()
        for end, k in machine.iter(text):
            places[k].append(end - len(k) + 1)
    return places


@F.arrow_udf(ArrayType(IntegerType()))
def _places(low: pa.Array, key: pa.Array) -> pa.Array:
    both = zip(low.to_pylist(), key.to_pylist(), strict=True)
    return pa.array([[p + 1 for p in _found(x, {k})[k]] if x is not None and k else None for x, k in both], pa.list_(pa.int32()))


def occurrences(text: Column, title: Column) -> Column:
    """X9. Positions (from 1) of all occurrences of the title, overlapping ones too; both folded. Null for a null text and an empty title."""
    return _places(folded(text), folded(title))


def numbers_present(text: Column, n: Column) -> Column:
    """X10. Whether each number from 1 to n stands in the text before a dot or a space."""
    one = lambda i: text.contains(F.concat(i.cast("string"), F.lit("."))) | text.contains(F.concat(i.cast("string"), F.lit(" ")))
    return (n < 1) | F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)


#: What is known of a title of a form.
MATCH = ("seq", "title", "n", "matches", "valid", "first_valid")
FOUND = MATCH[3:]
FOUND_TYPE = [(c, pa.int32()) for c in FOUND]
AREA = (*FOUND, "work_area")
AREA_TYPE = [*FOUND_TYPE, ("work_area", pa.string())]
TOPIC_TYPE = pa.struct([("no", pa.int32()), ("topic", pa.string())])
NO_TITLE = dict.fromkeys(MATCH[:3])


def _numbers(text: str, digits: int) -> dict[str, list[int]]:
    """Where each number of up to so many digits stands before a dot or a space, also as the end of a longer one."""
    out: dict[str, list[int]] = {}
    for m in re.finditer(r"(?<![0-9])[0-9]++(?=[. ])", text):
        for size in range(min(digits, m.end() - m.start()), 0, -1):
            out.setdefault(text[m.end() - size : m.end()], []).append(m.end() - size)
    return out


def judged(low: str, titles: list[tuple[str | None, int | None]]) -> list[tuple[int, int, int | None]]:
    """Per title (folded, with its count of numbers): how often it occurs, how often with all its numbers within ``VALID_WITHIN`` characters, and the first such place, from 1."""
    places = _found(low, {t for t, _ in titles if t})
    numbers = _numbers(low, max([len(str(n)) for _, n in titles if n and n > 0], default=0))

    def valid(at: int, n: int) -> bool:
        for i in map(str, range(1, n + 1)):
            here = numbers.get(i, ())
            next_ = bisect_left(here, at)
            if next_ == len(here) or here[next_] + len(i) >= at + VALID_WITHIN:
                return False
        return True

    out = []
    for title, n in titles:
        all_ = places.get(title, []) if title else []
        good = [p for p in all_ if n is not None and valid(p, n)]
        out.append((len(all_), len(good), good[0] + 1 if good else None))
    return out


_key_of = lru_cache(4096)(low_of)


def _told(text: str, titles: list[dict] | None) -> list[dict] | None:
    if titles is None:
        return None
    keys = [(None if t is None or t["title"] is None else _key_of(t["title"]), t and t["n"]) for t in titles]
    return [dict(zip(FOUND, j, strict=True)) for j in judged(low_of(text), keys)]


_told_of = each(_told, "array<struct<matches:int,valid:int,first_valid:int>>", pa.list_(pa.struct(FOUND_TYPE)))


def matched(text: Column, titles: Column) -> Column:
    """X11. ``titles``, an array of ``struct<seq, title, n>``, with how often each occurs in the text, how often with its numbers after it, and the first such place.

    The text is folded once and read once for all titles of its row and all numbers.
    """
    return F.zip_with(titles, _told_of(text, titles), lambda x, y: F.struct(*[x[c].alias(c) for c in MATCH[:3]], *[y[c].alias(c) for c in MATCH[3:]]))


def _with_areas(text: str, found: list[dict]) -> list[dict]:
    """``found`` with the ``work_area`` of each accepted title."""
    order = lambda x: (x["first_valid"], x["seq"] is not None, x["seq"])
    accepted = sorted(order(x) for x in found if x["first_valid"] is not None)

    def area(x: dict) -> str | None:
        if x["first_valid"] is None:
            return None
        next_ = bisect_right(accepted, order(x))
        rest = text[x["first_valid"] - 1 + len(x["title"]) : accepted[next_][0] - 1 if next_ < len(accepted) else None]
        return rest[: m.start()] if (m := AREA_BREAKS.search(rest)) else rest

    return [{**x, "work_area": area(x)} for x in found]


def _read(text: str, titles: list[dict] | None) -> list[dict] | None:
    return None if titles is None else _with_areas(text, [{**(t or NO_TITLE), **x} for t, x in zip(titles, _told(text, titles), strict=True)])


_areas_of = each(lambda text, titles: None if titles is None else [{c: x[c] for c in AREA} for x in _read(text, titles)], "array<struct<matches:int,valid:int,first_valid:int,work_area:string>>", pa.list_(pa.struct(AREA_TYPE)))


def with_areas(text: Column, titles: Column) -> Column:
    """X12. What ``matched`` gives, with the ``work_area`` of each accepted title; null for others.

    An area goes from the title's end to the next accepted title of the text, or to a numbered or stop heading.
    """
    return F.zip_with(titles, _areas_of(text, titles), lambda x, y: F.struct(*[x[c].alias(c) for c in MATCH[:3]], *[y[c].alias(c) for c in AREA]))


def header_matches(df: DataFrame, keep: list[str], text: str, titles: str) -> DataFrame:
    """X11. One row per title of each form: ``(keep, *MATCH)``."""
    return df.select(*keep, F.explode(matched(F.col(text), F.col(titles))).alias("x")).select(*keep, "x.*")


def work_areas(df: DataFrame, keep: list[str], text: str, titles: str) -> DataFrame:
    """X12. One row per accepted title of each form: ``(keep, *MATCH, work_area)``."""
    areas = with_areas(F.col(text), F.col(titles))
    return df.select(*keep, F.explode(areas).alias("x")).select(*keep, "x.*").filter("work_area is not null")


_area_topics_of = each(lambda text, titles: None if titles is None else [None if x["work_area"] is None else _topics(x["work_area"], x["n"]) for x in _read(text, titles)], "array<array<struct<no:int,topic:string>>>", pa.list_(pa.list_(TOPIC_TYPE)))


def area_topics(df: DataFrame, keep: list[str], text: str, titles: str) -> DataFrame:
    """X12, X13. ``(keep, seq, no, topic)``: the topics in the work area of each accepted title of a form, whose text is read once for all."""
    read = F.zip_with(titles, _area_topics_of(F.col(text), F.col(titles)), lambda x, y: F.struct(x["seq"].alias("seq"), y.alias("topics")))
    return df.select(*keep, F.explode(read).alias("x")).select(*keep, "x.seq", F.explode("x.topics").alias("y")).select(*keep, "seq", "y.*")


@F.arrow_udf(ArrayType(IntegerType()))
def _number_places(text: pa.Array) -> pa.Array:
    """Where (from 1) numbers stand that white space or nothing precedes and a dot or a space follows."""
    return pa.array([None if x is None else [m.start() + 1 for m in re.finditer(r"(?<![^ \t\r\n])[0-9]+(?=[. ])", x)] for x in text.to_pylist()], pa.list_(pa.int32()))


#: What follows the number of a topic, by priority.
NUMBER_ENDS = (". ", " ", ".")


def _items(area: Column) -> Column:
    """``array<struct<at, no, end0, end1, end2>>`` of the numbers of a text, and after which ends each numbers an item (F25)."""

    def item(p: Column) -> Column:
        before, after = F.substr(area, F.greatest(p - 1, F.lit(1)), F.when(p > 1, 1).otherwise(0)), F.substr(area, p, F.lit(VALID_WITHIN))
        number = F.regexp_extract(after, "^[0-9]+", 0)
        numbers = lambda end: after.startswith(F.concat(number, F.lit(end))) & T.is_item_number(before, F.substr(after, F.length(number) + len(end) + 1))
        return F.struct(p.alias("at"), number.alias("no"), *[numbers(end).alias(f"end{i}") for i, end in enumerate(NUMBER_ENDS)])

    return F.transform(_number_places(area), item)


def _topics(area: str, n: int | None) -> list[dict] | None:
    """What ``topics`` gives for one text, without asking what a number numbers."""
    if n is None or n < 1:
        return None
    marks = lambda k, start: [area.find(f"{k}{end}", start) for end in NUMBER_ENDS]
    out, at = [], 0
    for k in range(1, n + 1):
        places = marks(k, at)
        here = next((p for p in places if p >= 0), -1)
        if here < 0:
            out.append({"no": k, "topic": NOT_FOUND})
            continue
        until = min((p for p in marks(k + 1, here + 1) if p >= 0), default=None) if k < n else None
        out.append({"no": k, "topic": T.spaces_of(_NUMBERED.sub("", area[here:until].strip(" ")))})
        at = here + len(str(k)) + (2 if places[0] >= 0 else 1)
    return out


_NUMBERED = re.compile(r"\A[0-9]+\.? ")
_topics_of = each(_topics, "array<struct<no:int,topic:string>>", pa.list_(TOPIC_TYPE))


def topics(area: Column, n: Column, checked: bool = False) -> Column:
    """X13. ``array<struct<no, topic>>``: what follows each number from 1 to n, each sought behind the one before.

    ``checked``: only where the number numbers an item (F25), so centuries, years and amounts in the text end no topic. All such
    numbers are found in one pass over the text; each k takes the first of its own behind the one before.
    """
    if checked:
        return let(_items(area), lambda items: _segments(area, n, lambda k, start: _first_items(items, k, start)))
    return _topics_of(F.coalesce(area, F.lit("")), n)


def _first_items(items: Column, k: Column, start: Column) -> tuple[Column, ...]:
    own = lambda i: F.filter(items, lambda x: (x["no"] == k.cast("string")) & (x["at"] >= start) & x[f"end{i}"])
    return tuple(F.get(own(i), F.lit(0))["at"] for i in range(len(NUMBER_ENDS)))


def _segments(area: Column, n: Column, marks) -> Column:
    """The topics between the marks that ``marks(k, start)`` gives: the first places from ``start`` on of the number k before each of the ends."""

    def step(s: Column, k: Column) -> Column:
        def row(m: Column) -> Column:
            width = F.length(k.cast("string")) + F.when(m["dotted"], 2).otherwise(1)
            until = F.when(k < n, F.least(*marks(k + 1, m["here"] + 1)))
            body = T.spaces(F.regexp_replace(F.trim(cut(area, m["here"], until)), r"^\d+\.? ", ""))
            made = F.struct(k.alias("no"), F.when(m["here"].isNull(), NOT_FOUND).otherwise(body).alias("topic"))
            return F.struct(F.coalesce(m["here"] + width, s["at"]).alias("at"), F.concat(s["out"], F.array(made)).alias("out"))

        dot_space, space, dot = marks(k, s["at"])
        return let(F.struct(F.coalesce(dot_space, space, dot).alias("here"), dot_space.isNotNull().alias("dotted")), row)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<no:int,topic:string>>").alias("out"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda s: s["out"]))


def fallback_title(text: Column, n: Column) -> Column:
    """X14. The sentence before the first lone 1 that has one of ten characters, with all numbers up to n close after it."""
    parts = F.split(text, r"(?<=^|[.\s])(?=1[.\s])")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(p.rlike(r"^1[.\s]"), F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out"))
    places = F.aggregate(parts, start, step, lambda s: s["out"])  # one per lone 1

    def title(p: Column) -> Column:
        before = F.substr(text, F.greatest(p - BACK, F.lit(1)), F.least(F.lit(BACK), p - 1))
        return F.trim(F.element_at(F.split(before, "[.!?]"), -1))

    enough = lambda p: (F.length(title(p)) >= TITLE_LEAST) & F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, p, F.lit(AHEAD)).contains(i.cast("string")))
    return let(F.get(F.filter(places, enough), F.lit(0)), lambda p: F.when(p.isNotNull(), title(p)))


#: Markers of outcomes by priority.
MARKERS = (r"^\d+\.\d+\.\s*", r"^[•-]\s*", r"^[a-z]\)\s*", r"^\(\d+\)\s*")
ANY_MARK = r"^(\d+\.|[•-]|[a-z]\)|\(\d+\)|[A-Z])"


def outcomes(content: Column) -> Column:
    """X15. Outcomes of a topic: lines after one family of markers with the lines that continue them; the first family that has any."""
    lines = F.split(content, "\n")

    def family(mark: str) -> Column:
        start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, raw: Column) -> Column:
            line = F.trim(raw)
            new, goes_on = line.rlike(mark), s["open"] & ~line.rlike(ANY_MARK)
            last = F.concat(F.try_element_at(s["out"], F.lit(-1)), F.lit(" "), line)
            out = F.when(new, F.concat(s["out"], F.array(F.regexp_replace(line, mark, "")))).when(goes_on, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(last))).otherwise(s["out"])
            return F.struct((new | goes_on).alias("open"), out.alias("out"))

        items = F.transform(F.aggregate(lines, start, step, lambda s: s["out"]), T.spaces)
        return F.filter(items, lambda x: T.is_outcome(x) & (F.length(x) <= 200))

    found = F.filter(F.array(*[family(m) for m in MARKERS]), lambda x: F.size(x) > 0)
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def numbered_items(text: Column) -> Column:
    """X16. Items of a text: a line that begins with a number begins one, other lines go on with it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    mark = r"^\d+(?:\.\d+)*\.?\s*"

    def step(out: Column, line: Column) -> Column:
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.try_element_at(out, F.lit(-1)), F.lit(" "), line)))
        return F.when(line.rlike(mark) | (F.size(out) == 0), F.concat(out, F.array(F.regexp_replace(line, mark, "")))).otherwise(grown)

    return F.transform(F.aggregate(lines, F.array().cast("array<string>"), step), lambda x: F.trim(x))


def _block(x: dict) -> str:
    if x["title"] is None or x["n"] is None:
        return ""
    if x["first_valid"] is None:
        return f"{x['title']} ({x['n']}) -> eşleşme yok\n"
    lines = [f"{y['no']}. {y['topic']}" for y in _topics(x["work_area"], x["n"]) or ()]
    return f"{x['title']} ({x['n']}) -> {x['valid']} eşleşme\n" + "\n".join(lines)


_report_of = each(lambda text, titles: None if titles is None else "\n".join(_block(x) for x in _read(text, titles)))


def report(df: DataFrame, keep: list[str], text: str, titles: str) -> DataFrame:
    """X18. ``(keep, report)``, one text per form: a line per title with its matches, then its topics; titles without a valid match say so."""
    sorted_ = F.array_sort(F.transform(titles, lambda x: F.struct(*[x[c].alias(c) for c in MATCH[:3]])))
    return df.select(*keep, _report_of(F.col(text), sorted_).alias("report"))


def _job(text: str) -> dict:
    low = low_of(text)
    table = _table(text, low)
    return {**_sections(text, low), "n_units": len(_rows(table) or ()) if table is not None else 0}


_job_of = each(_job, f"struct<{','.join(f'{name}:string' for name, _ in FIELD_TYPE)},n_units:int>", pa.struct([*FIELD_TYPE, ("n_units", pa.int32())]))


def form_job(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """X19. Per form: its fields, the number of its units, and whether it could be read; its text is folded once for all."""
    read = df.select(key, _job_of(F.coalesce(text, F.lit(""))).alias("x")).select(key, "x.*")
    status = F.when(F.col("name").isNull(), "error: no name").when(F.col("n_units") == 0, "error: no table").otherwise("success")
    return read.withColumn("status", status)


def form_names(forms: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """X27. Per form the first field named like a name (``ADI``) that is not blank, with the folder and file of its path."""
    values = [F.when(F.trim(f) != "", F.trim(f)) for f in fields if "ADI" in _fold_literal(f.replace("_", " "))]
    return forms.select(F.regexp_extract(path, r"^(?:.*/)?([^/]+)/[^/]*$", 1).alias("folder"), F.substring_index(path, "/", -1).alias("file"), F.coalesce(*values).alias("course"))
