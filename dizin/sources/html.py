"""Records from HTML texts: links, options, cards and grids.

Pages are read as they come: tags in any case, attributes in any quotes or none, elements that are never closed, that nest in one another or that
are closed by what follows. Tags are found once, from left to right, by a pattern that can match in one way only, and a stack of open elements tells where each
element ends, so a page costs time in proportion to its length. Comments, scripts and styles hold no elements and no text; texts and values have their entities decoded.
The reading is a function on Arrow batches of the text column; what is made of the elements are column expressions. Cards and grids, whose elements
are read in elements, come from one pass of such a function, so no element moves from and to Python again.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dizin.functions import text as T

#: Elements without content, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
#: Open elements that a new one closes, and elements that neither it nor an end tag reaches out of.
CLOSED_BY = {
    "a": ("a",), "li": ("li",), "option": ("option",), "optgroup": ("option", "optgroup"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot"),
    "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",), "div": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",),
}
LIST, TABLE, CELL = ("ul", "ol"), ("table",), ("table", "td", "th")
WITHIN = {"li": LIST + CELL, "option": ("select",), "optgroup": ("select",), **dict.fromkeys(("td", "th", "tr", "thead", "tbody", "tfoot"), TABLE), "ul": CELL, "ol": CELL, "table": (), "select": ()}
#: Elements nest so deep at most; what is deeper counts as beside the last, so the texts of nested elements stay in proportion to the page.
DEPTH = 128
OPENS = re.compile("/?[a-zA-Z]")
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")


def _tags(html: str):
    """``(start, end, is_end, name, attributes)`` of each tag, with name ``!`` for what is no markup and no text, and no name for raw text. A tag that is never ended ends the page."""
    at = 0
    while (at := html.find("<", at)) >= 0:
        end = at + 1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = end if end > 2 else len(html)
            yield at, end, False, "!", ""
        elif html[end : end + 1] in ("!", "?"):
            end = html.find(">", at) + 1 or len(html)
            yield at, end, False, "!", ""
        elif m := TAG.match(html, end):
            end, name = m.end(), m[2].lower()
            yield at, end, bool(m[1]), name, m[3]
            if name in RAW and not m[1]:
                start, close = end, re.compile(f"</{name}[^>]*+>", re.I).search(html, end)
                end = close.start() if close else len(html)
                yield start, end, False, "!" if name in ("script", "style") else "", ""
        elif OPENS.match(html, end):
            yield at, len(html), False, "!", ""
            return
        at = end


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def found(html: str, names: frozenset[str], outermost: bool) -> list[tuple[str, dict[str, str], str, str]]:
    """``(name, attributes, inner, text)`` of the elements of some names, by where they begin; if ``outermost``, only those that are in no other of them."""
    opened: list[tuple[str, int]] = []  # name, and number among the elements found or -1
    out: list[list] = []  # name, attributes, and where content and pieces of text begin and end
    pieces: list[str] = []

    def close(down_to: int, at: int) -> None:
        while len(opened) > down_to:
            _, number = opened.pop()
            if number >= 0:
                out[number][3:] = at, out[number][4], len(pieces)

    def open_ones(name: str, sought: tuple[str, ...]) -> list[int]:
        """Places of the open elements sought, the inner ones first, as far as an element of this name reaches."""
        inside: list[int] = []
        if not sought:
            return inside
        border = WITHIN.get(name, CELL)
        for i in range(len(opened) - 1, -1, -1):
            if opened[i][0] in sought:
                inside.append(i)
            if opened[i][0] in border:
                break
        return inside

    done = 0
    for start, end, is_end, name, attributes in _tags(html):
        if start > done:
            pieces.append(unescape(html[done:start]))
        done = end
        if name in ("", "!"):
            pieces.append("" if name else unescape(html[start:end]))
            continue
        pieces.append(" ")
        ended = open_ones(name, (name,) if is_end else CLOSED_BY.get(name, ()))
        if ended:
            close(ended[0 if is_end else -1], start)
        if is_end:
            continue
        wanted = name in names and not (outermost and any(n >= 0 for _, n in opened))
        if wanted:
            out.append([name, attributes, end, end, len(pieces), len(pieces)])
        if name not in VOID:
            close(DEPTH - 1, start)
            opened.append((name, len(out) - 1 if wanted else -1))
    pieces.append(unescape(html[done:]))
    close(0, len(html))
    return [(name, _attributes(attributes), html[a:b], "".join(pieces[i:j])) for name, attributes, a, b, i, j in out]


ELEMENT = pa.struct([("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("inner", pa.string()), ("text", pa.string())])


def elements(html: Column, *names: str, outermost: bool = False) -> Column:
    """``array<struct<name, attributes, inner, text>>`` of the elements of these names, in the order in which they begin; null for a null page.

    ``attributes`` is a map from names in small letters (of equal ones the first counts), ``inner`` the HTML between the tags, ``text`` its text with a space for each tag.
    """
    wanted = frozenset(names)

    @F.arrow_udf("array<struct<name:string,attributes:map<string,string>,inner:string,text:string>>")
    def read(pages: pa.Array) -> pa.Array:
        told = [None if x is None else found(x, wanted, outermost) for x in pages.to_pylist()]
        return pa.array([x if x is None else [{"name": n, "attributes": list(a.items()), "inner": i, "text": t} for n, a, i, t in x] for x in told], pa.list_(ELEMENT))

    return read(html)


def plain(element: Column) -> Column:
    """The text of an element, spaces collapsed."""
    return T.spaces(element["text"])


def attribute(element: Column, name: str) -> Column:
    """The value of an attribute; null without it."""
    return F.try_element_at(element["attributes"], F.lit(name))


def _first(each: Column, test) -> Column:
    return F.get(F.filter(each, test), F.lit(0))


def links(pages: DataFrame, suffix: str, tag: str) -> DataFrame:
    """S1. ``(page_id, pos, href, text, absolute, year)`` of links that end in ``suffix`` and hold ``tag``.

    The year is the page's, so all its links share it.
    """
    each = pages.select("page_id", "url", T.year_all(F.col("html")).alias("year"), F.posexplode(elements(F.col("html"), "a")).alias("pos", "x"))
    each = each.withColumn("href", F.trim(attribute(F.col("x"), "href")))
    kept = each.filter(F.col("href").endswith(suffix) & F.col("href").contains(tag))
    return kept.select("page_id", "pos", "href", plain(F.col("x")).alias("text"), T.absolute_url(F.col("href"), F.col("url")).alias("absolute"), "year")


#: Option values and titles that stand for no choice.
NO_VALUE, NO_TITLE = ("", "00", "0"), ("Alan Seçiniz", "Seçiniz")


def options(df: DataFrame, html: str, keep: list[str], tag: str = "option", value: str = "value") -> DataFrame:
    """S2. ``(keep, pos, value, label)`` of a list's choices; empty values and placeholder titles are left out."""
    each = df.select(*keep, F.posexplode(elements(F.col(html), tag)).alias("pos", "x"))
    out = each.select(*keep, "pos", F.trim(attribute(F.col("x"), value)).alias("value"), plain(F.col("x")).alias("label"))
    return out.filter(~F.col("value").isin(*NO_VALUE) & (F.col("label") != "") & ~F.col("label").isin(*NO_TITLE))


CARD = pa.struct([("url", pa.string()), ("title", pa.string()), ("items", pa.list_(pa.string()))])
_CARD_PARTS, _ROWS, _CELLS, _LINKS = frozenset(("a", "b", "li")), frozenset(("tr",)), frozenset(("td", "th")), frozenset(("a",))


def _cards(page: str, tag: str, kind: str) -> list[dict]:
    """The first link, the first bold text and the list items of each card of a page."""
    out = []
    for _, attributes, inner, _ in found(page, frozenset((tag,)), False):
        if kind in re.split(r"\s+", attributes.get("class", ""), flags=re.A):
            parts = found(inner, _CARD_PARTS, False)
            bold = next((b for name, _, _, x in parts if name == "b" and (b := T.spaces_of(x))), "")
            out.append({"url": _link(parts), "title": bold, "items": [T.spaces_of(x) for name, _, _, x in parts if name == "li"]})
    return out


def _link(elements_: list[tuple[str, dict[str, str], str, str]]) -> str | None:
    return next((a["href"] for name, a, _, _ in elements_ if name == "a" and a.get("href")), None)


def cards(df: DataFrame, html: str, keep: list[str], tag: str = "div", kind: str = "card") -> DataFrame:
    """S3. One row per element of the class ``kind``, however deep: its first link, first bold text, and its list items told apart by content.

    An item with a dotted date is the date, one with ``Sınıf`` the grade, the first other one the area. A card in a card is a card of its own, and part of the outer one.
    """
    def read(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _cards(x, tag, kind) for x in pages.to_pylist()], pa.list_(CARD))

    each = df.select(*keep, F.posexplode(F.arrow_udf(read, "array<struct<url:string,title:string,items:array<string>>>")(html)).alias("card", "x")).select(*keep, "card", "x.*")
    is_date = lambda x: x.rlike(r"\d{2}\.\d{2}\.\d{4}")
    is_grade = lambda x: x.rlike("[Ss]ınıf")
    pick = lambda test: _first(F.col("items"), test)
    out = each.select(
        *keep, "card", "url", "title",
        T.grade(pick(is_grade)).alias("grade"), pick(is_date).alias("date"), pick(lambda x: ~is_date(x) & ~is_grade(x)).alias("area"),
    )
    return out.withColumn("year", T.year_single(F.regexp_extract("date", r"(\d{4})", 1)))


GRID_ROW = pa.struct([("row", pa.int32()), ("name", pa.string()), ("link", pa.string()), ("date", pa.string())])


def _grid(page: str) -> list[dict]:
    out = []
    for row, (_, _, inner, _) in enumerate(found(page, _ROWS, True)):
        if row and len(cells := found(inner, _CELLS, True)) >= 2:
            name, link, *rest = cells
            out.append({"row": row, "name": T.spaces_of(name[3]), "link": _link(found(link[2], _LINKS, False)), "date": T.spaces_of(rest[0][3]) if rest else None})
    return out


def grid(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """S4. Rows of a page's tables below the first row, of two cells or more: name, link of the second cell, date of the third.

    A table in a cell belongs to that cell: it makes no rows and no cells of its own.
    """
    def read(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _grid(x) for x in pages.to_pylist()], pa.list_(GRID_ROW))

    rows = df.select(*keep, F.explode(F.arrow_udf(read, "array<struct<row:int,name:string,link:string,date:string>>")(html)).alias("x"))
    return rows.select(*keep, "x.*")
