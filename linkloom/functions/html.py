"""Extraction from HTML that isn't well formed: Arrow-batched functions over the standard event parser.

A page that can't be read gives null (or false), never an error. Elements are kept in a
light tree; ``page`` reads a page once for all that is extracted from it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attrs: dict, parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, tag: str | None = None, id: str | None = None, cls: str | None = None):
        for n in self.walk():
            if (tag is None or n.tag == tag) and (id is None or n.attrs.get("id") == id) and (cls is None or cls in (n.attrs.get("class") or "").split()):
                yield n

    def first(self, tag: str | None = None, **by):
        return next(self.all(tag, **by), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _safe(f, default=None):
    def run(root):
        if root is None:
            return default
        try:
            return f(root)
        except (AttributeError, KeyError, ValueError, IndexError, StopIteration):
            return default

    return run


def _page_id(href: str, base: str = "https://dblp.org/db/") -> str:
    return re.sub(r"\.html$", "", re.sub(r"/index\.html$", "", href.removeprefix(base)))


def _headline(root: Node):
    head = root.first(id="headline")
    return (head or root).first("h1").text().strip()


def _links(root: Node):
    return [n.attrs["href"] for n in root.all("a") if n.attrs.get("href")]


def _items(root: Node):
    return [n.text().strip() for n in root.all("li")]


def _crumbs(root: Node) -> list[Node]:
    return [li for b in root.all(id="breadcrumbs") for li in b.all("li")]


def _parents(root: Node):
    """Series that the breadcrumbs name: of each item the link with the highest position."""
    out = []
    for li in _crumbs(root):
        best = None
        for span in li.all("span"):
            meta = next((m for m in span.all("meta") if m.attrs.get("itemprop") == "position"), None)
            a = span.first("a")
            if meta and a and a.attrs.get("href") and (best is None or int(meta.attrs["content"]) > best[0]):
                best = (int(meta.attrs["content"]), a)
        if best:
            id_ = _page_id(best[1].attrs["href"])
            if id_.startswith("conf/") and id_.count("/") == 1:
                out.append({"dblp_id": id_, "name": best[1].text().strip()})
    return out


def _is_series(root: Node) -> bool:
    links = [a.attrs.get("href") for li in _crumbs(root) for a in li.all("a")]
    return bool(links) and links[-1].rstrip("/") == "https://dblp.org/db/conf"


def _header_id(root: Node):
    head = root.first(id="headline")
    stream = head.attrs.get("data-stream") or ""
    if stream.startswith("conf/"):
        return stream
    key = (head.attrs.get("data-bhtkey") or "").removeprefix("db/").removesuffix("/index")
    return key if key.startswith("conf/") else None


def _mentioned(root: Node):
    main = root.first(id="main")
    return [h.text().strip() for c in main.children if isinstance(c, Node) and c.tag == "header" for h in c.children if isinstance(h, Node) and h.tag == "h2"]


# Relations of the venue box, alphabetically.
RELATIONS = ("access", "has part", "is part of", "not to be confused with", "predecessor", "related", "status", "successor")


def _venue(root: Node):
    """List items of the venue box: relation, name, reference and the item's text; an item may carry several relations."""
    box = root.first("div", cls="hide-body") or root.first(id="info-section")
    if box is None:
        return []
    out = []
    for li in box.all("li"):
        em = li.first("em")
        if em is None:
            continue
        said, a = em.text().lower(), li.first("a")
        own = "".join(c if isinstance(c, str) else "" for c in li.children).strip(" :")
        for relation in RELATIONS:
            if relation in said:
                out.append({"relation": relation, "name": a.text().strip() if a else own, "reference": _page_id(a.attrs.get("href", "")) if a else None, "label": em.text().strip(), "text": li.text().strip()})
    return out


def _volume_title(root: Node):
    return root.first("span", cls="CEURVOLTITLE").text().strip()


def _index_links(root: Node):
    box = root.first(id="browse-conf-output")
    return [a.attrs["href"] for li in box.all("li") for a in li.all("a") if a.attrs.get("href")]


def _redirect(root: Node):
    title = root.first("title")
    if title is None or "Redirecting" not in title.text():
        return None
    return _page_id(root.first("a").attrs["href"])


def _title(root: Node):
    return root.first("title").text().strip()


_ITEM = pa.struct([(n, pa.string()) for n in ("relation", "name", "reference", "label", "text")])
_FIELDS = {
    "title": (_title, pa.string()), "headline": (_headline, pa.string()), "items": (_items, pa.list_(pa.string())), "links": (_links, pa.list_(pa.string())),
    "parents": (_parents, pa.list_(pa.struct([("dblp_id", pa.string()), ("name", pa.string())]))), "is_series": (_is_series, pa.bool_()),
    "id": (_header_id, pa.string()), "headers": (_mentioned, pa.list_(pa.string())), "venue": (_venue, pa.list_(_ITEM)),
    "volume_title": (_volume_title, pa.string()), "index": (_index_links, pa.list_(pa.string())), "redirect": (_redirect, pa.string()),
}
_SCHEMA = "title string, headline string, items array<string>, links array<string>, parents array<struct<dblp_id:string,name:string>>, is_series boolean, id string, headers array<string>, venue array<struct<relation:string,name:string,reference:string,label:string,text:string>>, volume_title string, index array<string>, redirect string"


def _read(html: str | None) -> dict:
    root = None
    if html is not None:
        try:
            root = tree(html)
        except (AssertionError, ValueError):
            pass
    return {name: _safe(f, False if name == "is_series" else None)(root) for name, (f, _) in _FIELDS.items()}


def page(html: Column) -> Column:
    """All that is extracted from a page, as one struct; the page is parsed once."""
    kind = pa.struct([(name, k) for name, (_, k) in _FIELDS.items()])

    def read(values: pa.Array) -> pa.Array:
        return pa.array([_read(v) for v in values.to_pylist()], kind)

    read.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, _SCHEMA)(html)


def event(page: Column, id: Column | None = None) -> Column:
    """(dblp_id, title, year, location, ordinal) of an event's page; null without a headline."""
    e = T.event_from_title(page["headline"])
    out = F.struct((page["id"] if id is None else id).alias("dblp_id"), *[e[c].alias(c) for c in ("title", "year", "location", "ordinal")])
    return F.when(page["headline"].isNotNull(), out)


def _related(page: Column, relation: str, extra) -> Column:
    """(name, reference, ...) of the venue box's items of a relation."""
    own = F.filter(page["venue"], lambda v: v["relation"] == relation)
    return F.transform(own, lambda v: F.struct(v["name"].alias("name"), v["reference"].alias("reference"), *extra(v)))


def _years(v: Column) -> Column:
    return F.when(F.contains(v["label"], F.lit("(")), T.year_range(v["label"]))


def venue_information(page: Column) -> Column:
    """The venue box by relation; null without one. Years, qualifier and merger are said in brackets after the relation."""
    years = lambda v: [_years(v).alias("years")]
    merged = lambda v: F.contains(v["label"], F.lit("(")) & F.contains(v["label"], F.lit("merged into"))
    status = F.filter(page["venue"], lambda v: v["relation"] == "status")
    access = F.filter(page["venue"], lambda v: v["relation"] == "access")
    out = F.struct(
        F.exists(access, lambda v: F.contains(v["text"], F.lit("some or all publications openly available"))).alias("open_access"),
        _related(page, "has part", years).alias("has_part"), _related(page, "is part of", years).alias("is_part_of"),
        _related(page, "not to be confused with", lambda v: []).alias("not_to_be_confused_with"), _related(page, "predecessor", years).alias("predecessor"),
        _related(page, "related", lambda v: [T.relation_qualifier(v["label"]).alias("qualifier")]).alias("related"),
        T.discontinuation_year(F.get(status, 0)["text"]).alias("discontinued"),
        _related(page, "successor", lambda v: [F.when(~merged(v), _years(v)).alias("years"), merged(v).alias("merged_into")]).alias("successor"),
    )
    return F.when(F.size(page["venue"]) > 0, out)


def series(page: Column) -> Column:
    """(dblp_id, name, abbreviation, venue, events) of a series' page; null for other pages."""
    events = F.flatten(F.transform(page["headers"], lambda h: T.events_from_header(h)))
    out = F.struct(page["id"].alias("dblp_id"), page["headline"].alias("name"), T.abbreviation(page["headline"]).alias("abbreviation"), venue_information(page).alias("venue"), events.alias("events"))
    return F.when(page["is_series"], out)


def headline(html):
    return page(html)["headline"]


def breadcrumb_parents(html):
    return page(html)["parents"]


def is_series_page(html):
    return page(html)["is_series"]


def header_id(html):
    return page(html)["id"]


def mentioned_headers(html):
    return page(html)["headers"]


def redirect_target(html):
    return page(html)["redirect"]
