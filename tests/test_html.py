"""Elements of pages against a plain parser, hostile pages in linear time, and what is made of them."""

import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from dizin.sources import html as H


class Plain(HTMLParser):
    """The same rules over the standard library's tags: a plain tree, then all elements of a name in order."""

    VOID = {"br", "img"}
    ENDS = {"li": ({"li"}, {"ul", "table", "td"}), "option": ({"option"}, {"select"}), "td": ({"td"}, {"table"}), "tr": ({"td", "tr"}, {"table"}), "a": ({"a"}, {"table", "td"})}

    def __init__(self, html):
        super().__init__()
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, name, attributes):
        closes, limit = self.ENDS.get(name, (set(), set()))
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] in closes:
                upper = min(j for j in range(1, i + 1) if self.path[j][0] in closes and not any(x[0] in limit for x in self.path[j + 1 : i + 1]))
                del self.path[upper:]
                break
            if self.path[i][0] in limit:
                break
        self.path[-1][2].append(" ")
        node = [name, dict(reversed(attributes)), []]
        self.path[-1][2].append(node)
        if name not in self.VOID:
            self.path.append(node)

    def handle_endtag(self, name):
        limit = {"li": {"ul", "table", "td"}, "option": {"select"}, "td": {"table"}, "tr": {"table"}, "ul": {"table", "td"}, "table": set(), "select": set()}.get(name, {"table", "td"})
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] == name:
                del self.path[i:]
                break
            if self.path[i][0] in limit:
                break
        self.path[-1][2].append(" ")

    def handle_data(self, text):
        self.path[-1][2].append(text)

    def elements(self, names):
        def text(node):
            return "".join(x if isinstance(x, str) else text(x) for x in node[2])

        def walk(node):
            for x in node[2]:
                if not isinstance(x, str):
                    if x[0] in names:
                        yield x[0], x[1], " ".join(text(x).split())
                    yield from walk(x)

        return list(walk(self.root))


def page(rng):
    def part(depth):
        kind = rng.choice(["text", "a", "li", "ul", "div", "table", "select", "b", "br", "stray"])
        end = lambda name: f"</{name}>" if rng.random() < 0.6 else ""
        inner = lambda: "".join(part(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else "x"
        if kind == "text":
            return rng.choice([" one ", "two &amp; ", "< 3", "&uuml;"])
        if kind == "br":
            return "<br>"
        if kind == "stray":
            return rng.choice(["</li>", "</b>", "</A>", "<!-- <a href=no> -->"])
        if kind == "table":
            return "<table>" + "".join("<TR>" + "".join(f"<td>{inner()}" + end("td") for _ in range(2)) + end("tr") for _ in range(2)) + "</table>"
        if kind == "select":
            return "<select>" + "".join(f"<option value={i}>o{i}" + end("option") for i in range(3)) + "</select>"
        if kind == "ul":
            return f"<ul>{inner()}</ul>"
        attribute = rng.choice(["", " href=/x", ' href="/a > b"', " HREF='/q\"'", " title=\"it's\" href=/y class=card"])
        return f"<{kind}{attribute}>{inner()}" + end(kind)

    return "".join(part(0) for _ in range(6))


def test_elements_are_those_of_a_plain_parser():
    rng, names = random.Random(7), frozenset(("a", "li", "option", "td", "tr", "div", "b"))
    for _ in range(400):
        html = page(rng)
        assert [(n, a, " ".join(t.split())) for n, a, _, t in H.found(html, names, False)] == Plain(html).elements(names), html


def test_hostile_pages_take_linear_time():
    for part in ('<a x="y" b=c>', "<div class=card><b>", '<a x="', "<!--", "<a ", "<a =' ", "<option>", "<td><table>", "<script>", "<", "</a", "<a href='x\" ", "<li></ul>"):
        html = part * (1_000_000 // len(part))
        began = time.process_time()
        H.found(html, frozenset(("a", "option", "li", "td")), False)
        assert time.process_time() - began < 6, part


def test_depth_is_bounded():
    found = H.found("<div>" * 1000 + "x", frozenset(("div",)), False)
    assert len(found) == 1000 and sum(t.strip() == "x" for _, _, _, t in found) == H.DEPTH


def test_options_cards_and_grids_without_end_tags(spark):
    one = lambda html: spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, html string")
    assert [tuple(r) for r in H.options(one("<select><option value=0>Seçiniz<option value=5>A &amp; B<option value=6>C</select><p>x"), "html", ["k"]).collect()] == [(1, 1, "5", "A & B"), (1, 2, "6", "C")]
    card = "<div class='card'><div><a href='/u.pdf'></div><div class=card-body><ul><li><b>T</b><li>9.Sınıf<li>12.12.2024 00:00:00</ul></div></div>"
    got = H.cards(one(f"<div>{card}{card.replace('/u', '/v')}</div>"), "html", ["k"]).orderBy("card").collect()
    assert [(r["url"], r["title"], r["grade"], r["date"], r["area"], r["year"]) for r in got] == [("/u.pdf", "T", 9, "12.12.2024 00:00:00", "T", "2024"), ("/v.pdf", "T", 9, "12.12.2024 00:00:00", "T", "2024")]
    rows = "<table><tr><th>h<th>h<tr><td>n<table><tr><td>in<td>in</table><td><a>no</a><a href=/l.rar>x<td>1.1.2020<tr><td>only"
    assert [tuple(r) for r in H.grid(one(rows), "html", ["k"]).collect()] == [(1, 1, "n in in", "/l.rar", "1.1.2020")]


def test_null_and_repeated_attributes(spark):
    df = spark.createDataFrame([(None,), ("<a href=1 href=2 HREF=3 x>t",)], "html string").select(H.elements(F.col("html"), "a").alias("e"))
    got = [r["e"] for r in df.collect()]
    assert got[0] is None and [(x["attributes"], x["text"]) for x in got[1]] == [({"href": "1", "x": ""}, "t")]
