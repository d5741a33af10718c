import random

import pytest

from medialens.llm.html import extract

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; <b>bold</b> text", "plain & bold text"),
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b", "a\nb"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>c", "- a\n- b\n  3. x\n  4. y\n\nc"),
    ("<table><tr><th>Name<th>N<tr><td>long one<td>1</table>z", "Name      N\nlong one  1\n\nz"),
    ("<table><tr><td rowspan=2>r<td>2<tr><td>3</table>", "r  2\n   3"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na     b"),
    ("<table><caption>T</caption><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "T\n日本   x\nabcde  y"),
    ("<p hidden>no</p><p style='display: none'>no</p><script>var t='</p>';</script><style>p{}</style><!-- no --><template>no</template>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>S</summary>in</details>", "S\nS\nin"),
    ("<head><title>no</title></head><body>yes", "yes"),
    ("<pre>a  b\n c</pre>", "a  b\n c"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("x</i></div></table>y", "xy"),
    ("<a href='a>b'>link</a> a < b", "link a < b"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<select><option>a<option>b</select>", "a\nb"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert extract(page) == text


def test_any_depth_and_length():
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert extract("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(extract("<p>word " * 50_000).split()) == 50_000


def test_visible_words_all_stay(spark, sf_dir):
    import html
    import re

    from medialens.llm.queries import op10_html_extraction, table

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in op10_html_extraction(spark, sf_dir).collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title|head|noscript|template)\b.*?</\1\s*>", " ", pages[r.page_id])
        if re.search(r"hidden|display\s*:\s*none|<details|<dialog", body):
            continue
        want = "".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        got = re.sub(r"(?m)^\s*(- |\d+\. )", "", r.text)
        assert sorted(want) == sorted("".join(got.split())) or len(want) - len("".join(got.split())) < 3


class Maker:
    """Random pages with the text that they should give, made from their structure without reading any HTML."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def words(self, most=6):
        return [self.rng.choice(["alpha", "be", "gamma", "d", "epsilon", "日本", "éa", "x1"]) for _ in range(self.rng.randint(1, most))]

    def said(self, words):
        """Inline HTML of some words: white space runs, emphasis, entities, comments and unseen elements between."""
        out = []
        for w in words:
            w = self.rng.choice([w, w, f"<b>{w}</b>", f"<a href='u>v'>{w}</a>", w[0] + "<!-- c -->" + w[1:]])
            out.append(w + self.rng.choice(["", "", "<script>if (a<b) x='</p>'</script>", "<span hidden>no</span>"]))
        return self.rng.choice([" ", "\n  ", "\t "]).join(out)

    def close(self, tag):
        return self.rng.choice(["", f"</{tag}>"])

    def block(self, depth=0):
        """(html, lines, gap around)"""
        kind = self.rng.choice(["p", "div", "h2", "list", "table", "pre", "quote"] if depth < 3 else ["div", "p"])
        if kind in ("p", "div", "h2"):
            w = self.words()
            return f"<{kind}>{self.said(w)}" + (self.close("p") if kind == "p" else f"</{kind}>"), [" ".join(w)], 1 if kind == "div" else 2
        if kind == "list":
            page, lines = self.list(depth)
            return page, lines, 2
        if kind == "pre":
            lines = ["  ".join(self.words(3)) for _ in range(self.rng.randint(1, 3))]
            return "<pre>" + "\n".join(lines) + "</pre>", lines, 2
        if kind == "quote":
            page, lines = self.flow(depth + 1)
            return f"<blockquote>{page}</blockquote>", ["  " + x if x else "" for x in lines], 2
        rows = [[self.words(2) for _ in range(self.rng.randint(1, 4))] for _ in range(self.rng.randint(1, 4))]
        page = "<table>" + "".join("<tr>" + "".join(f"<{(t := self.rng.choice(['td', 'th']))}>{self.said(c)}" + self.close(t) for c in r) + self.close("tr") for r in rows) + "</table>"
        wide = lambda s: sum(2 if c in "日本" else 1 for c in s)
        cells = [[" ".join(c) for c in r] for r in rows]
        widths = [max(wide(r[k]) for r in cells if k < len(r)) for k in range(max(map(len, cells)))]
        return page, ["  ".join(c + " " * (widths[k] - wide(c)) for k, c in enumerate(r)).rstrip() for r in cells], 2

    def list(self, depth):
        tag, first = self.rng.choice([("ul", 1), ("ol", 1), ("ol", 7)])
        page, lines = f"<{tag} start={first}>" if first > 1 else f"<{tag}>", []
        for n in range(self.rng.randint(1, 3)):
            mark = "- " if tag == "ul" else f"{first + n}. "
            w = self.words()
            page += f"<li>{self.said(w)}"
            lines.append(mark + " ".join(w))
            if depth < 2 and self.rng.random() < 0.4:
                inner, more = self.list(depth + 1)
                page += inner
                lines += [" " * len(mark) + x for x in more]
            page += self.close("li")
        return page + f"</{tag}>", lines

    def flow(self, depth=0):
        page, lines, gap = "", [], 0
        for _ in range(self.rng.randint(1, 4)):
            html, more, around = self.block(depth)
            page += html + self.rng.choice(["", "\n", "<!-- x -->", "<div style='color:red; display : none'>no<p>no</div>"])
            lines += ([""] if lines and max(gap, around) > 1 else []) + more
            gap = around
        return page, lines


def test_layout_of_made_pages():
    for seed in range(1500):
        page, lines = Maker(seed).flow()
        assert extract(f"<html><head><title>no</title></head><body>{page}") == "\n".join(lines), page


def test_hostile_pages_take_bounded_time_and_space():
    import time

    n = 10_000
    pages = ["<a " * n + ">", "<a \"'" * n, "<b>" * n + "</i>" * n, "<i><table><tr><td>" + "<b>" * n + "</i>" * n, "<table><tr><td>" + "x" * n + "<tr><td><td>y" * n]
    pages += ["<table><tr>" + "<td>a" * n + "<tr><td>b" * n, "<ul><li>x" * n, "<table><tr><td>é<td>" * 3000, "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 3000, "<!x " * n, "<table>" + "<tr><td colspan=99><td>x" * n]
    for page in pages:
        began = time.perf_counter()
        assert len(extract(page)) < 16 * len(page)
        assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("rows", "size"), [(40, 500), (60, 300), (200, 200), (3000, 5000)])
def test_long_cells_stand_out_of_aligned_columns(rows, size):
    cell = lambda i: "L" * size if i == 5 else "x" * (i % 7 + 1)
    page = "<table>" + "".join(f"<tr><td>row {i % 10}<td>{cell(i)}<td>end {i}" for i in range(rows)) + "</table>"
    lines = extract(page).split("\n")
    assert lines == ["row 5  " + "L" * size + "  end 5" if i == 5 else f"row {i % 10}  {cell(i):7}  end {i}" for i in range(rows)]


def test_columns_that_can_not_be_afforded_are_not_aligned():
    cells = ["w" * 400 if i % 50 == 0 else "" for i in range(1000)]
    page = "<table>" + "".join(f"<tr><td>{x}<td>e{i}" for i, x in enumerate(cells)) + "</table>"
    lines = extract(page).split("\n")
    assert len("".join(lines)) < 8 * len("".join(cells)) + 20_000 and all(line.split()[-1] == f"e{i}" for i, line in enumerate(lines))


@pytest.mark.parametrize("depth", [3, 9, 12, 40])
def test_cells_beside_nested_tables_stand_in_their_first_line(depth):
    page = "one<br>two"
    for k in range(depth):
        page = f"<table><tr><td>{page}<td>side{k}</table>"
    first, second = extract(page).split("\n")
    assert first.split() == ["one", *[f"side{k}" for k in range(depth)]] and second == "two"
