"""Extraction of a page from html: a small tree builder with optional end tags, then metadata, root and blocks."""

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.functions.hashing import base36, content_hash_value

#: The version that goes into the hash, noise that is removed, and what carries a block.
EXTRACTOR_VERSION = 1
NOISE_TAGS = frozenset("script style noscript nav header footer aside form iframe svg template".split())
NOISE_ROLES = frozenset("navigation banner contentinfo".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre figcaption dd dt td th".split())

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: Which open elements a start tag ends, up to the boundary that stops the search.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_CONTAINERS = frozenset("html body div section article main aside nav header footer form table td th ul ol dl li blockquote".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)

    def find(self, test) -> "Node | None":
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#document", {}, None)

    def _close(self, which: set, stop: set) -> None:
        node = self.here
        while node is not self.root and node.tag not in stop:
            if node.tag in which:
                self.here = node.parent
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            old = self.root.find(lambda n: n.tag == tag)
            if old:
                for k, v in attrs:
                    old.attrs.setdefault(k, v or "")
                return
            if tag == "body":
                self._close({"head"}, set())
        if tag in _ENDS_P:
            self._close({"p"}, _CONTAINERS - {"html", "body"})
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.tag != tag:
            if node.tag in _CONTAINERS and tag not in _CONTAINERS:
                return
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse_html(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _meta(doc: Node, key: str, value: str) -> str | None:
    found = doc.find(lambda n: n.tag == "meta" and n.attrs.get(key) == value)
    return (found.attrs.get("content", "").strip() or None) if found else None


def json_ld(doc: Node) -> list[dict]:
    """Objects of the JSON-LD scripts, with those of arrays and @graph; invalid ones are left out."""
    out = []
    for node in doc.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                found = json.loads(node.text())
            except ValueError:
                continue
            for item in found if isinstance(found, list) else [found]:
                if isinstance(item, dict):
                    graph = item.get("@graph")
                    out += [item, *(g for g in (graph if isinstance(graph, list) else []) if isinstance(g, dict))]
    return out


def _first_string(nodes: list[dict], *keys: str) -> str | None:
    return next((n[k].strip() for n in nodes for k in keys if isinstance(n.get(k), str) and n[k].strip()), None)


def page_title(doc: Node, data: list[dict]) -> str:
    found = _meta(doc, "property", "og:title")
    if found is None:
        tag = doc.find(lambda n: n.tag == "title")
        found = tag.text().strip() if tag else _first_string(data, "headline", "name")
    if found is None:
        h1 = doc.find(lambda n: n.tag == "h1")
        found = h1.text().strip() if h1 else "Untitled"
    return found


def page_category(doc: Node, data: list[dict], url: str) -> str | None:
    """The last but one breadcrumb of JSON-LD, else of the page, else the first directory of the URL."""
    trail = next((n for n in data if n.get("@type") == "BreadcrumbList"), {}).get("itemListElement")
    if isinstance(trail, list) and len(trail) > 1 and isinstance(trail[-2], dict):
        name = trail[-2].get("name")
        if not isinstance(name, str):
            item = trail[-2].get("item")
            name = item.get("name") if isinstance(item, dict) else None
        if isinstance(name, str) and name.strip():
            return name.strip()
    nav = doc.find(lambda n: "readcrumb" in n.attrs.get("aria-label", "") or {"breadcrumbs", "breadcrumb"} & set(n.attrs.get("class", "").split()))
    if nav:
        crumbs = [t for n in nav.walk() if n is not nav and n.tag in ("li", "a") and (t := _squeezed(n.text()))]
        if len(crumbs) > 1:
            return crumbs[-2]
    try:
        parts = [p for p in urlsplit(url).path.split("/") if p] if "://" in url else []
    except ValueError:
        return None
    if parts and not re.search(r"\.[a-z0-9]+$", parts[0], re.I):
        return parts[0][:1].upper() + parts[0][1:]
    return None


def _is_noise(node: Node) -> bool:
    return node.tag in NOISE_TAGS or node.attrs.get("aria-hidden") == "true" or node.attrs.get("role") in NOISE_ROLES


def page_blocks(doc: Node, title: str) -> list[dict]:
    """Outermost text elements of main, else article, else body, without noise and without an h1 that the title holds."""
    root = next((r for tag in ("main", "article", "body") if (r := doc.find(lambda n, tag=tag: n.tag == tag))), doc)
    out: list[dict] = []
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if node is not root and _is_noise(node):
            continue
        if node is not root and node.tag in TEXT_BLOCKS:
            text = _squeezed(_quiet_text(node))
            if text:
                level = int(node.tag[1]) if node.tag[0] == "h" and node.tag[1].isdigit() else None
                out.append({"type": "heading" if level else "text", "level": level, "text": text})
            continue
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    if out and out[0]["level"] == 1 and out[0]["text"].lower() in title.lower():
        out = out[1:]
    return out


def _quiet_text(node: Node) -> str:
    if isinstance(node, str):
        return node
    return "".join(_quiet_text(c) for c in node.children if isinstance(c, str) or not _is_noise(c))


def extract(source: str, url: str) -> dict:
    doc = parse_html(source)
    data = json_ld(doc)
    title = page_title(doc, data)
    page = doc.find(lambda n: n.tag == "html")
    blocks = page_blocks(doc, title)
    text = "\n".join(b["text"] for b in blocks)
    return {
        "title": title,
        "description": _meta(doc, "name", "description") or _meta(doc, "property", "og:description") or _first_string(data, "description"),
        "category": page_category(doc, data, url),
        "blocks": blocks,
        "text": text,
        "hash": base36(content_hash_value(f"{EXTRACTOR_VERSION} {title} {text}")),
        "lang": (page.attrs.get("lang", "").strip() or None) if page else None,
    }


PAGE_SCHEMA = "title string, description string, category string, blocks array<struct<type:string,level:int,text:string>>, text string, hash string, lang string"
_BLOCKS = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string())]))


def extract_pages(fetched: DataFrame, keep: tuple[str, ...] = ("fetch_id", "url", "fetched_at", "etag", "last_modified")) -> DataFrame:
    """Extracted pages of fetched(url, html, *keep). Rows with null html or url give no page; empty html a page without blocks."""
    kept = [c for c in keep if c in fetched.columns]
    rows = fetched.where("html is not null and url is not null").select(*kept, F.col("url").alias("_url"), F.col("html").alias("_html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [extract(h, u) for h, u in zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist())]
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array([p[n] for p in pages], _BLOCKS if n == "blocks" else pa.string()) for n in ("title", "description", "category", "blocks", "text", "hash", "lang")]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "title", "description", "category", "blocks", "text", "hash", "lang"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), PAGE_SCHEMA]))
