"""Accordion pages and category indexes against the standard library's parser, on nested and broken pages."""

import random
import re
from html.parser import HTMLParser

from corpusloom.sources import listings


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = self.at = {"tag": "", "class": "", "children": [], "up": None}
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        node = {"tag": tag, "class": a.get("class") or "", "href": a.get("href"), "children": [], "up": self.at}
        self.at["children"].append(node)
        if tag in ("div", "a", "b", "span"):
            self.at = node

    def handle_endtag(self, tag):
        if self.at["tag"] == tag:
            self.at = self.at["up"]

    def handle_data(self, data):
        self.at["children"].append(data)


def _text(node):
    return " ".join("".join(x if isinstance(x, str) else _text_raw(x) for x in node["children"]).split())


def _text_raw(node):
    return "".join(x if isinstance(x, str) else _text_raw(x) for x in node["children"])


def _all(node, test):
    return ([node] if test(node) else []) + [y for x in node["children"] if not isinstance(x, str) for y in _all(x, test)]


def _plain(html):
    out = []
    for t in _all(Tree(html).root, lambda n: n["tag"] == "div" and "accordion-section-title" in n["class"]):
        links = _all(t, lambda n: n["tag"] == "a")
        if not links:
            continue
        beside = [x for x in t["up"]["children"] if not isinstance(x, str)]
        later = [x for x in beside[beside.index(t) + 1 :] if "accordion-section" in x["class"] and x["tag"] == "div"]
        meta = _text(later[0]) if later and "content" in later[0]["class"] else ""
        parts = [p.strip() for p in meta.split("|")]
        date = re.search(r"Promulgation Date:\s*(.+)$", meta)
        out.append((_text(links[0]), links[0]["href"], parts[1] if len(parts) > 1 and re.search(r"\bof\b", parts[1]) else None, date[1].strip() if date else None))
    return out


def _page(rnd):
    blocks = []
    for n in range(rnd.randrange(6)):
        name = rnd.choice(["Rent &amp; Tenancy Act", "Family <b>Courts</b> Act", "Goods  Act\n, 1930"])
        link = rnd.choice([f'<a class="x" href="law?id={n}&amp;v=1">{name}</a>', f"<A HREF='law?id={n}'><span>{name}</span></A> <a href='other'>other</a>", "no link"])
        inner = rnd.choice([link, f"<div class='in'><div>{link}</div></div> tail", f"<!-- <a href='no'>no</a> --><span>x</span>{link}"])
        meta = rnd.choice(["Family Laws | VII of 1909 | Promulgation Date: October 22 1909", "Laws | none | x", "<div>Laws | <b>X of 1950</b></div><div>| Promulgation Date: May 2</div>", ""])
        body = rnd.choice([f'<div class="accordion-section-content c">{meta}</div>', f"<div>between</div>\n<div class='accordion-section-content'>{meta}</div>", "", f"</div><div class='other'><div class='accordion-section-content'>{meta}</div>"])
        blocks.append(f'<div class="group"><div class="accordion-section-title">{inner}</div>{body}</div>')
    return "<html><br><p>" + "\n".join(blocks) + "</html>"


def test_accordions_by_a_parser(spark):
    rnd = random.Random(31)
    pages = [(i, _page(rnd)) for i in range(80)] + [(100, None), (101, ""), (102, "no tags | at all <")]
    got = {}
    for r in listings.accordion(spark.createDataFrame(pages, "page long, html string"), "page").orderBy("page", "nth").collect():
        got.setdefault(r.page, []).append((r.title, r.target.replace("&amp;", "&"), r.act_number, r.promulgated))
    want = {i: rows for i, html in pages if html and (rows := _plain(html))}
    assert got == want and sum(r[2] is not None for rows in want.values() for r in rows) > 20


def test_categories(spark):
    html = '<ul><li><a href="list.php?catid=7">Family <b>Laws</b></a> (69)</li><li><a href="x?catid=8&a=1">Rent Laws</a></li><li><a href="?catid=7">again</a><a href="about">About (3)</a></li><li><a href="?catid=9">Tax (Old)</a> (5)</li></ul>'
    rows = listings.categories(spark.createDataFrame([(1, html), (2, None)], "page long, html string"), "page").orderBy("catid").collect()
    assert [(r.page, r.catid, r.name, r.target, r.badge) for r in rows] == [(1, 7, "Family Laws", "list.php?catid=7", 69), (1, 8, "Rent Laws", "x?catid=8&a=1", None), (1, 9, "Tax (Old)", "?catid=9", 5)]
