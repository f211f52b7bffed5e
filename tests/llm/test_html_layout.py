"""HTML rendering: layout, implied tags, visibility, broken markup."""

import random
import time

import pytest

from pixelyard.llm.html_layout import extract_text, page_text

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>One<p>Two  <b>bold</b>\n text<br>next", "One\n\nTwo bold text\nnext"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "- x\n- y\n  - z\n\nend"),
    ("<ol start=3><li>c<p>more</p><li>d</ol>", "3. c\n\n   more\n\n4. d"),
    ("<table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>200</table>", "Name  | N\napple | 1\nfig   | 200"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b<tr><td>1<br>2<td>c</table>", "wide cell here\na | b\n1 | c\n2 |"),
    ("<table><td>a<table><td>in<td>ner</table><td>b</table>", "a        | b\n         |\nin | ner |"),
    ("<head><title>T</title><style>p{}</style></head><body>x<script>var t='</p>';</script>y", "xy"),
    ("a<span hidden>b</span><i style='display: none'>c<b>d</b></i><u aria-hidden=true>e</u>f", "aef"),
    ("<pre>\n a  b\n   c</pre>d", " a  b\n   c\n\nd".lstrip("\n")),
    ("a<!-- <p>no --> b <![CDATA[c]]> <!doctype html>d", "a b c d"),
    ("</div></p>x</b></td>y", "xy"),
    ("<p>cut <a href='>'>link</a> off <b", "cut link off"),
    ("a < b &lt;c&gt; 1<2", "a < b <c> 1<2"),
    ("<h1>T</h1>text<hr>more<blockquote>q<br>r</blockquote>", "T\n\ntext\n\n---\n\nmore\n\n> q\n> r"),
    ("<i style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</i>d", "bd"),
    ("x<svg><title>t</title><text>s</text></svg><math><mi>m</mi></math><dialog>n</dialog><dialog open>o</dialog>", "x s mo"),
    ("<select><option>a<option selected>b</select><textarea> c &lt; </textarea><input value=v><input type=hidden value=h>", "b c < v"),
    ("<table><tr><td>" + "w" * 130 + "<td>a<tr><td>b<td>c</table>", "w" * 130 + " | a\nb | c"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n    v\nl\n    w"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert page_text(page) == text


def test_deep_and_random_markup():
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<ul><li>" * 3000 + "x").endswith("- x")
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<table>", "</table>", "<td>", "</td>", "<tr>", "</tr>", "<li>", "<ul>", "</ul>", "<div hidden>", "</div>", "<", ">", "&", "w", " ", "<script>", "</script>", "<!--", "-->", "<pre>", "</pre>", "\n", "<br/>", '<a b="', '"', "<dd>", "</li>"]
    for _ in range(3000):
        page_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))))
    page = "".join(f"<p>w{i} <b>b{i}</b><ul><li>l{i}</ul><table><tr><td>t{i}</table>" for i in range(200))
    assert [w for w in page_text(page).replace("-", " ").split()] == [x for i in range(200) for x in (f"w{i}", f"b{i}", f"l{i}", f"t{i}")]


def outline(node, listed=False):
    """Blocks of a tree of (tag, children) by the rules in words: a list of (blank lines wanted around, lines)."""
    tag, children = node
    listed = listed or tag == "li"
    blocks, inline = [], []

    def flush():
        if inline:
            blocks.append((1, [" ".join(inline)], 1))
            inline.clear()

    number = 0
    for child in children:
        if isinstance(child, str):
            inline.append(child)
        elif child[0] == "b":
            inline.extend(child[1])
        else:
            flush()
            inner = outline(child, listed)
            if child[0] == "li":
                number += 1
                marker = f"{number}. " if tag == "ol" else "- "
                lines = lay(inner)
                if lines:
                    blocks.append((inner[0][0], [(marker if i == 0 else " " * len(marker)) + line if line else "" for i, line in enumerate(lines)], inner[-1][2]))
            elif inner:
                gap = 2 if child[0] == "p" or child[0] in ("ul", "ol") and not listed else 1
                (a, first, b), *rest = inner
                inner = [(max(a, gap), first, b), *rest]
                a, final, b = inner[-1]
                blocks += [*inner[:-1], (a, final, max(b, gap))]
    flush()
    return blocks


def lay(blocks):
    lines, due = [], 0
    for before, text, after in blocks:
        if lines:
            lines += [""] * (max(due, before) - 1)
        lines += text
        due = after
    return lines


def test_against_outline_of_random_trees():
    rng = random.Random(21)
    count = 0

    def word():
        nonlocal count
        count += 1
        return f"w{count}"

    def tree(tag, depth):
        if tag in ("ul", "ol"):
            return tag, [tree("li", depth - 1) for _ in range(rng.randint(1, 3))]
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5 or tag == "p" or depth <= 0:
                out.append(rng.choice([word(), ("b", [word()])]))
            else:
                out.append(tree(rng.choice(["div", "p", "ul", "ol"]), depth - 1))
        return tag, out

    def markup(node):
        if isinstance(node, str):
            return f" {node} "
        return f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"

    for _ in range(400):
        node = tree("div", 4)
        assert page_text(markup(node)) == "\n".join(lay(outline(node))), markup(node)


def test_time_follows_length():
    for unit in ("<section>", "<b>", "<b>x</i>", "<td>", "<dt>"):
        began = time.time()
        page_text(unit * 60_000 + "x")
        assert time.time() - began < 5, unit


def test_query_form(spark):
    rows = [(1, "<p>a", 5), (2, None, 5), (2, "", 5), (None, "<b>x</b>", 5)]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()), key=repr)
    assert got == [(1, "a"), (2, ""), (2, ""), (None, "x")]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
