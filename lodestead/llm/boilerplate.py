"""Problem 1: page boilerplate mixed with main content, by maximum-scoring subsequences of weighted words and tags."""

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.tables import site_of

#: Labelled pages that the weights are learned from, at most (about), chosen by the hash of fetch_id.
FIT_PAGES = 1500
#: Hashed weights.
WEIGHTS = 1 << 18
#: Class names that name the role of a box: `<role>-box`; this role holds the page's own content, all others furniture.
ROLE_BOX = re.compile(r"^([a-z]+)-box$")
CONTENT_ROLE = "content"
#: What an edge of a content region costs: between two containers, and within one, whose tags hold its blocks together.
EDGE, INNER_EDGE = 0.25, 9.0
#: The most that one block adds to a region's score, or takes from it.
MOST_SCORE = 6.0
#: Blocks of fewer characters are kept with their score, as many as REPEATED of them, for the pages on which they come again.
SHORT, REPEATED = 120, 50_000
#: Words up to which features are summed one by one.
FEW_WORDS = 24

TOKEN = re.compile(r"<!--.*?-->|<(script|style|title)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|role)\s*=\s*["']([^"']*)["']""", re.I)
BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre figcaption dd dt td th".split())
CONTAINERS = frozenset("nav aside footer header main article div section ul ol table form dialog".split())
WORD = re.compile(r"[^\W\d_]+|\d[\d.,:/\-]*")
#: What a shape writes for a date, a number and a word; marks around a text don't count.
SHAPES = (
    (re.compile(r"^[^\w©]+|(?:\s*(?:\.{3}|[→›»!…]))+$"), ""),
    (re.compile(r"\b\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}\b|\b\d{1,2}\.? [^\W\d_]{3,} \d{4}\b"), "D"),
    (re.compile(r"\d[\d.,:/\-]*"), "0"),
    (re.compile(r"(?!D\b)[^\W\d_]+"), "a"),
)


def plain(text: str) -> str:
    return " ".join(text.split())


def text_key(text: str) -> int:
    """32-bit key by which a block of the page finds its place in the html."""
    return zlib.crc32(plain(text).lower().encode("utf-8", "surrogatepass")) - (1 << 31)


def parse(source: str) -> list[tuple[str, str, str, int]]:
    """(text, tags, role, box) of the blocks of an html document in order.

    tags: the block's tag, whether all of it is a link, and the containers around it with their classes. role: the role
    that the innermost labelled box names, or ''; such names are no tags. box: number of the innermost container, of which
    a table cell is one if it holds blocks. Tags that are never closed end with their container.
    """
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str, str, int]] = []  # tag, mark, role, number
    name, text, linked, in_link, mark, around = "", [], 0, False, "", ""
    last = boxes = cell = 0

    def close() -> None:
        nonlocal name, text, linked
        if name:
            joined = plain(entities.unescape("".join(text)))
            if joined:
                link = "a" if linked and 2 * linked >= len(joined) else "-"
                out.append((joined, f"{name} {link}{around}{mark}", next((r for _, _, r, _ in reversed(stack) if r), ""), cell or (stack[-1][3] if stack else 0)))
        name, text, linked = "", [], 0

    for m in TOKEN.finditer(source):
        if name and m.start() > last:
            piece = source[last : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        last = m.end()
        tag = (m[3] or "").lower()
        if tag == "a":
            in_link = not m[2]
        elif tag in BLOCK_TAGS:
            attributes = dict((k.lower(), v) for k, v in ATTRIBUTE.findall(m[4])) if not m[2] and "=" in m[4] else {}
            if name == "td" and not m[2] and tag not in ("td", "th") and not "".join(text).strip():
                boxes += 1
                cell = boxes
            close()
            if tag == "td":
                cell = 0
            if not m[2]:
                name = tag
                # an empty classed block marks what follows it
                mark = f" after.{attributes['class']}" if attributes.get("class") else mark
        elif tag in CONTAINERS or tag == "body":
            close()
            mark = ""
            boxes += 1
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        if stack:
                            stack[-1] = (*stack[-1][:3], boxes)
                        break
            else:
                attributes = dict((k.lower(), v) for k, v in ATTRIBUTE.findall(m[4])) if "=" in m[4] else {}
                classes = attributes.get("class", "").lower().split()
                role = next((b[1] for c in classes if (b := ROLE_BOX.match(c))), "")
                shown = [c for c in classes if not ROLE_BOX.match(c)]
                stack.append((tag, ".".join([tag, *shown, *([attributes["role"]] if "role" in attributes else [])]), role, boxes))
            around = "".join(f" {m}" for m in dict.fromkeys(m for _, m, _, _ in stack))
    if name and last < len(source):
        text.append(source[last:])
    close()
    return out


def masked_words(text: str, site: str) -> list[str]:
    """Words in lower case; numbers as 0, the site's name as {site}."""
    return ["0" if w[0].isdigit() else "{site}" if w == site else w for w in WORD.findall(text.lower())]


def shape(text: str) -> str:
    """Outline of a text without its words."""
    text = plain(text).lower()
    for pattern, sign in SHAPES:
        text = pattern.sub(sign, text)
    return text


def site_name(site: str | None) -> str:
    """The label of a host that names the site."""
    parts = (site or "").split(".")
    return parts[-2] if len(parts) > 1 else parts[0]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _feature(name: int, value: int) -> int:
    x = (value ^ name) * 0x9E3779B1 & 0xFFFFFFFF
    return (x ^ x >> 15) & (WEIGHTS - 1)


def _forms(kind: str, level: int | None, text: str, site: str, known: dict[str, int]) -> tuple[list[int], list[int], int, int]:
    """(hashes of a block's words, features of its form, hash of its whole text, hash of its kind and length)."""
    w = masked_words(text, site)
    for x in w:
        if x not in known:
            known[x] = _hash(x)
    ids = [known[x] for x in w]
    form = f"{'h%s' % level if kind == 'heading' else 't'} {len(w) if len(w) < 7 else 7 if len(w) < 12 else 8} {text.rstrip()[-1:] in '.!?…'}"
    # the outline of a long text is that of its words without its marks
    outline = _hash(shape(text) if len(text) < SHORT else "".join(["0" if x == "0" else "a" for x in w]))
    whole, shaped = _hash(" ".join(w)), _hash(form)
    first, last = (ids[0], ids[-1]) if ids else (0, 0)
    single = (
        (13, shaped), (14, whole), (15, first), (16, last), (17, _hash(text[:1]) if not text[:1].isalnum() else 1), (18, outline),
        (19, outline ^ first * 3), (20, outline ^ last * 5), (21, shaped + ("{site}" in w)),
    )
    return ids, [_feature(n, v) for n, v in single], whole, shaped


def _word_features(ids: list[int]) -> np.ndarray:
    """Features of words and of word pairs."""
    x, mask = np.array(ids, np.int64), 0xFFFFFFFF
    pairs = (x[:-1] * 0x85EBCA6B & mask) ^ x[1:]
    words = np.concatenate(((x ^ 11) * 0x9E3779B1 & mask, (pairs ^ 12) * 0x9E3779B1 & mask))
    return ((words ^ words >> 15) & (WEIGHTS - 1)).astype(np.int32)


def _contexts(blocks: list[tuple[str, int | None, str]], own: list[tuple], tags: list[str], title: str, site: str, known: dict) -> list[list[int]]:
    """What each block has by its place: its tags, the kind of its neighbours, whether it repeats the title.

    own: (anything, hash of the whole text, hash of kind and length) of the blocks.
    """
    own_title, out, marks = _hash(" ".join(masked_words(title, site))), [], []
    for tag in tags:
        mark = known.get("<" + tag)
        if mark is None:
            names = tag.split(" ") if tag else []
            mark = known["<" + tag] = (_hash(" ".join(names[:2])) if tag else 0, [_feature(31, _hash(x)) for x in names[2:]])
        marks.append(mark)
    for i, (_, whole, shaped) in enumerate(own):
        kind, level, _ = blocks[i]
        f = [_feature(30, (whole == own_title) * 7 + (kind == "heading") * 3 + (level or 0) * 17)]
        if tags[i]:
            f.append(_feature(32, marks[i][0]))
            f += marks[i][1]
        for n, k in ((40, i - 1), (50, i + 1)):
            if 0 <= k < len(own):
                f += [_feature(n, own[k][2] ^ shaped * 3), _feature(n + 1, own[k][1])]
                if tags[k]:
                    f.append(_feature(n + 2, marks[k][0]))
            else:
                f.append(_feature(n + 3, 0))
        out.append(f)
    return out


def features(blocks: list[tuple[str, int | None, str]], tags: list[str], site: str, title: str, known: dict | None = None) -> list[np.ndarray]:
    """Hashed words and tags of every block: its own, and the kind of its neighbours. known keeps the hashes of words."""
    known = {} if known is None else known
    own = []
    for kind, level, text in blocks:
        ids, single, whole, shaped = _forms(kind, level, text, site, known)
        own.append((np.concatenate((_word_features(ids), np.array(single, np.int32))), whole, shaped))
    return [np.concatenate((o[0], np.array(f, np.int32))) for o, f in zip(own, _contexts(blocks, own, tags, title, site, known))]


class Scorer:
    """Scores of the blocks of pages: the sum of the weights of their features. What blocks that come again have by
    themselves is kept from page to page, within bounds.
    """

    def __init__(self, weights: np.ndarray):
        self.weights, self.bias, self.each = weights, float(weights[-1]), weights.tolist()
        self.known: dict = {}
        self.seen: dict[tuple, tuple] = {}
        self.keys: dict[str, int] = {}
        self.marks: dict[str, tuple] = {}
        self.near: dict[tuple, float] = {}

    def text_key(self, text: str) -> int:
        """text_key, kept for short texts."""
        found = self.keys.get(text)
        if found is None:
            if len(self.keys) > REPEATED:
                self.keys.clear()
            found = text_key(text)
            if len(text) < SHORT:
                self.keys[text] = found
        return found

    def _mark(self, tag: str) -> tuple[float, float, float]:
        """Weights of a block's tags: its own, and those for the block after and before it."""
        if not tag:
            return 0.0, 0.0, 0.0
        names, each = tag.split(" "), self.each
        kind = _hash(" ".join(names[:2]))
        return each[_feature(32, kind)] + sum([each[_feature(31, _hash(x))] for x in names[2:]]), each[_feature(42, kind)], each[_feature(52, kind)]

    def _block(self, kind: str, level: int | None, text: str, site: str) -> tuple[float, int, int, float, float]:
        """(weights by itself, hash of the whole text, hash of kind and length, weights for the block after and before it)."""
        ids, single, whole, shaped = _forms(kind, level, text, site, self.known)
        each = self.each
        if len(ids) > FEW_WORDS:
            total = float(self.weights[_word_features(ids)].sum())
        else:
            pairs = [(x * 0x85EBCA6B & 0xFFFFFFFF) ^ y for x, y in zip(ids, ids[1:])]
            total = sum([each[_feature(11, x)] for x in ids]) + sum([each[_feature(12, x)] for x in pairs])
        return total + sum([each[x] for x in single]), whole, shaped, each[_feature(41, whole)], each[_feature(51, whole)]

    def scores(self, blocks: list[tuple[str, int | None, str]], tags: list[str], site: str, title: str) -> np.ndarray:
        """Of each block the sum of the weights of what features gives, looked up part by part."""
        for kept, most in ((self.known, 300_000), (self.seen, REPEATED), (self.marks, REPEATED), (self.near, REPEATED)):
            if len(kept) > most:
                kept.clear()
        own, marks, out, each = [], [], [], self.each
        for kind, level, text in blocks:
            key = (kind, level, text, site if site in text.lower() else "")
            found = self.seen.get(key)
            if found is None:
                found = self._block(*key)
                if len(text) < SHORT:
                    self.seen[key] = found
            own.append(found)
        for tag in tags:
            mark = self.marks.get(tag)
            if mark is None:
                mark = self.marks[tag] = self._mark(tag)
            marks.append(mark)
        own_title, last = _hash(" ".join(masked_words(title, site))), len(own) - 1
        first_edge, last_edge = each[_feature(43, 0)], each[_feature(53, 0)]
        for i, (total, whole, shaped, _, _) in enumerate(own):
            kind, level, _ = blocks[i]
            total += self.bias + each[_feature(30, (whole == own_title) * 7 + (kind == "heading") * 3 + (level or 0) * 17)] + marks[i][0]
            for k, at, n, outside in ((i - 1, 0, 40, first_edge), (i + 1, 1, 50, last_edge)):
                if not 0 <= k <= last:
                    total += outside
                    continue
                other = own[k]
                key = (n, other[2], shaped)
                near = self.near.get(key)
                if near is None:
                    near = self.near[key] = each[_feature(n, other[2] ^ shaped * 3)]
                total += near + other[3 + at] + marks[k][1 + at]
            out.append(total)
        return np.array(out)


def learn(rows: list[np.ndarray], content: list[bool], rounds: int = 40, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression on sets of hashed features, positive for content; the last one is the bias."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    y = np.array(content, np.float64)
    w, b, g2 = np.zeros(WEIGHTS), 0.0, np.full(WEIGHTS, 1e-8)
    for _ in range(rounds):
        s = np.bincount(row, w[flat], len(rows)) + b
        e = y - 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = np.bincount(flat, e[row], WEIGHTS) - decay * w * len(rows)
        g2 += g * g
        w += rate * g / np.sqrt(g2)
        b += 0.1 * e.mean()
    return np.append(w, b).astype(np.float32)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous region [start, end) of the greatest sum, in one linear scan; (0, 0) if no score is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def regions(scores: list[float], edges: list[float]) -> list[bool]:
    """Which blocks lie in the contiguous regions that together score most: the sum of their blocks less the price of their edges.

    edges[k] is the price of an edge between block k - 1 and block k; the page's own ends are free. One linear scan keeps
    the best sum that ends inside and outside of a region; with very high prices inside the page it gives the one best
    region that reaches an end, with prices of 0 the blocks of positive score. So weak blocks go with what is around them,
    and what stands out pays its edges.
    """
    inside, outside = 0.0, 0.0
    back: list[tuple[bool, bool]] = []  # whether the best way into a block, inside and outside, comes from inside
    for s, price in zip(scores, edges):
        enter, leave = outside - price, inside - price
        back.append((inside >= enter, leave > outside))
        inside, outside = max(inside, enter) + s, max(outside, leave)
    content, here = [], inside > outside
    for stays, left in reversed(back):
        content.append(here)
        here = stays if here else left
    return content[::-1]


def scan(scores: np.ndarray, boxes: list[int], edge: float = EDGE, inner: float = INNER_EDGE) -> list[bool]:
    """regions of a page's blocks, whose edges cost `inner` within a container and `edge` elsewhere.

    The weights of a block's words and tags are its score; a region begins and ends at tags, so they enter as one sum,
    of at most MOST_SCORE either way. Box -1 stands for a block that is not in the html.
    """
    prices = [0.0] + [inner if a == b >= 0 else edge for a, b in zip(boxes, boxes[1:])]
    return regions(np.clip(scores, -MOST_SCORE, MOST_SCORE).tolist(), prices[: len(scores)])


def with_body(content: list[bool], scores: np.ndarray, boxes: list[int], body: list[bool]) -> list[bool]:
    """content, but with a body: where no body block is content, the box of the best one is, however low it scores.

    A page has something to say, if only that it can't be shown; that scores low, being nothing that other pages hold.
    """
    at = [k for k, b in enumerate(body) if b]
    if not at or any(content[k] for k in at):
        return content
    best = max(at, key=lambda k: scores[k])
    return [c or k == best or boxes[k] == boxes[best] >= 0 for k, c in enumerate(content)]


def align(keys: list[int], marks: list[int]) -> list[int]:
    """For each block key the position of the next equal mark, or -1; both are read in order."""
    out, at = [], 0
    where: dict[int, list[int]] = {}
    for i, m in enumerate(marks):
        where.setdefault(m, []).append(i)
    for k in keys:
        found = where.get(k, ())
        n = next((i for i in found if i >= at), found[-1] if found else -1)
        if n >= 0:
            at = n + 1
        out.append(n)
    return out


def page_marks(fetched: DataFrame) -> DataFrame:
    """(fetch_id, keys, tags, boxes): the blocks of each document's html, without their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, boxes = [], [], []
            for source in batch.column("html").to_pylist():
                found = parse(source)
                keys.append([text_key(x[0]) for x in found])
                tags.append([x[1] for x in found])
                boxes.append([x[3] for x in found])
            kinds = (pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("fetch_id"), *(pa.array(c, pa.list_(k)) for c, k in zip((keys, tags, boxes), kinds))], names=["fetch_id", "keys", "tags", "boxes"]
            )

    # of rows that repeat a fetch_id the page may take any html of that id; they are byte-identical
    return fetched.where("html is not null and fetch_id is not null").select(F.col("fetch_id").cast("bigint").alias("fetch_id"), "html").mapInArrow(
        run, "fetch_id bigint, keys array<int>, tags array<string>, boxes array<int>"
    ).dropDuplicates(["fetch_id"])


def fit(fetched: DataFrame, fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights from labelled pages: documents whose boxes name their roles. Without any, all weights are 0.

    The html of about fit_pages of them comes to the driver. The names of the boxes are labels and never tags. A page is
    learned twice, with its tags and without, so that pages with no html can be scored too.
    """
    labelled = fetched.where(F.col("html").contains(f'class="{CONTENT_ROLE}-box"')).select("fetch_id", "url", "html")
    step = max(1, -(-labelled.count() // fit_pages))
    sample = labelled.where(F.pmod(F.xxhash64("fetch_id"), F.lit(step)) == 0).select(site_of(F.col("url")).alias("site"), "html")
    rows, content, known = [], [], {}
    for site, source in sorted({(r.site or "", r.html) for r in sample.collect()}):
        title = re.search(r'property="og:title" content="([^"]*)"', source) or re.search(r"<title>(.*?)</title>", source, re.S)
        found = [x for x in parse(source) if x[2]]
        blocks = [("heading" if t[0] == "h" and t[1].isdigit() else "text", int(t[1]) if t[0] == "h" and t[1].isdigit() else None, x) for x, t, _, _ in found]
        name, heading = site_name(site), plain(entities.unescape(title[1])) if title else ""
        tags = [x[1] for x in found]
        for seen in (tags, [""] * len(found)):
            rows += features(blocks, seen, name, heading, known)
            content += [x[2] == CONTENT_ROLE for x in found]
    return learn(rows, content) if rows else np.zeros(WEIGHTS + 1, np.float32)


def judged(pages: DataFrame, fetched: DataFrame, emit, names: tuple[str, ...], kinds: tuple[pa.DataType, ...], schema: str, fit_pages: int = FIT_PAGES) -> DataFrame:
    """Rows that emit(page_id, site, blocks, content) gives for each page; content says of each block whether it is the page's own.

    blocks are (type, level, text). Byte-identical repeated rows count once. Pages with null blocks are left out; a block
    with null or blank text is no furniture. A page whose html is missing is scored by its words alone.
    """
    weights = fit(fetched, fit_pages)
    rows = pages.where("page_id is not null and blocks is not null").select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("fetch_id").cast("bigint").alias("fetch_id"), F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), F.coalesce("title", F.lit("")).alias("title"),
        F.transform("blocks", lambda b: F.coalesce(b["type"], F.lit("text"))).alias("types"),
        F.transform("blocks", lambda b: b["level"]).alias("levels"),
        F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))).alias("texts"),
    ).distinct()
    joined = rows.join(page_marks(fetched), "fetch_id", "left")
    columns = ("page_id", "site", "title", "types", "levels", "texts", "keys", "tags", "boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            out: list[tuple] = []
            for page, site, title, types, levels, texts, keys, tags, boxes in zip(*(batch.column(c).to_pylist() for c in columns)):
                parts = list(zip(types, levels, texts))
                at = align([scorer.text_key(t) for t in texts], keys) if keys else [-1] * len(parts)
                scores = scorer.scores(parts, [tags[k] if k >= 0 else "" for k in at], site_name(site), title)
                scores[[not t.strip() for t in texts]] = 0.0
                inside = [boxes[k] if k >= 0 else -1 for k in at]
                body = [kind != "heading" and bool(t.strip()) for kind, t in zip(types, texts)]
                kept = with_body(scan(scores, inside), scores, inside, body)
                out += emit(page, site, parts, [k or not t.strip() for k, t in zip(kept, texts)])
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    return joined.select(*columns).mapInArrow(run, schema)


def classify(pages: DataFrame, fetched: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, content array<boolean>): for each block of a page whether it is the page's own, as in judged."""
    kinds = (pa.int64(), pa.list_(pa.bool_()))
    return judged(pages, fetched, lambda page, site, parts, content: [(page, content)], ("page_id", "content"), kinds, "page_id bigint, content array<boolean>", fit_pages)


def furniture(classified: DataFrame) -> DataFrame:
    """(page_id, block_pos): the blocks that are not the page's own content."""
    return classified.select("page_id", F.posexplode("content").alias("block_pos", "own")).where("not own").select("page_id", "block_pos").distinct()


def own_content(pages: DataFrame, classified: DataFrame) -> DataFrame:
    """(page_id, blocks, text): pages with the blocks of their own and the texts of those, joined by newlines.

    A page with null blocks keeps its text.
    """
    rows = pages.where("page_id is not null").select("page_id", "blocks", "text").distinct().join(classified, "page_id", "left")
    kept = F.filter("blocks", lambda b, i: F.element_at("content", i + 1))
    return rows.select(
        "page_id", kept.alias("blocks"), F.when(F.col("blocks").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).alias("text")
    )
