"""Chunks of a page: text blocks packed under a target, cut at sentence ends, with heading paths and overlaps."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes in characters.
TARGET, MOST, OVERLAP, LEAST = 700, 900, 120, 90

_SENTENCE_END = re.compile(r"[.!?…](?=[\s\"'”’)\]]|$)")
_SENTENCE_GAP = re.compile(r"[.!?…]\s+")

CHUNK_SCHEMA = "page_key string, chunk_index int, heading_path array<string>, body string"


def break_point(text: str, target: int, most: int) -> int:
    """Where to cut a text longer than most: behind the last sentence end of the window, else at a line end, a space, or hard."""
    start = max(1, int(0.6 * target))
    window = text[start:most]
    ends = [m.start() for m in _SENTENCE_END.finditer(window)]
    if ends:
        return start + ends[-1] + 1
    for sign in "\n ":
        at = window.rfind(sign)
        if at >= 0:
            return start + at
    return most


def carried(text: str, chars: int) -> str:
    """What the next chunk repeats: the end of the text from a sentence start, else from a word start."""
    if chars <= 0 or not text:
        return ""
    tail = text[-chars:]
    gaps = [m.start() for m in _SENTENCE_GAP.finditer(tail)]
    if gaps:
        return tail[gaps[-1] + 1 :].strip()
    return tail[tail.find(" ") + 1 :].strip()


def sections(blocks: list[dict]) -> Iterator[tuple[list[str], list[str]]]:
    """(heading path, texts) of each stretch of blocks between two headings; blank blocks count for nothing."""
    path: dict[int, str] = {}
    texts: list[str] = []
    for block in blocks:
        text = (block["text"] or "").strip()
        if text and block["type"] == "heading":
            if texts:
                yield [path[k] for k in sorted(path)], texts
            level = 2 if block["level"] is None else min(6, max(1, round(block["level"])))
            path, texts = {k: v for k, v in path.items() if k < level} | {level: text}, []
        elif text:
            texts.append(text)
    if texts:
        yield [path[k] for k in sorted(path)], texts


def cut_long(text: str, target: int, most: int, overlap: int) -> list[str]:
    """A text as pieces of at most `most` characters, each but the first with the end of the one before it."""
    pieces = []
    while len(text) > most:
        at = break_point(text, target, most)
        pieces.append(text[:at].strip())
        again, text = carried(pieces[-1], overlap), text[at:].lstrip()
        text = f"{again} {text}" if again else text
    return [*pieces, text]


def packed(texts: list[str], target: int, most: int, overlap: int) -> list[str]:
    """The texts of a section as pieces: a text joins the last piece while both stay within the target; long ones are cut."""
    pieces: list[str] = []
    for text in texts:
        if pieces and pieces[-1] and len(pieces[-1]) + len(text) <= target:
            text = f"{pieces.pop()}\n{text}"
        pieces += cut_long(text, target, most, overlap)
    return pieces


def chunk_blocks(blocks: list[dict], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[list[str], str]]:
    """(heading path, body) of each chunk: the pieces of the sections, of which a short one joins the piece before it if
    the heading path of one begins that of the other; what is joined keeps the shorter path.
    """
    out: list[tuple[list[str], str]] = []
    for path, texts in sections(blocks):
        for piece in filter(None, map(str.strip, packed(texts, target, most, overlap))):
            before, body = out[-1] if out else ([], "")
            common = min(len(path), len(before))
            if out and len(piece) < least and len(body) + len(piece) < most and path[:common] == before[:common]:
                out[-1] = (path[:common], f"{body}\n{piece}")
            else:
                out.append((path, piece))
    return out


def chunk_pages(pages: DataFrame, key: str = "url", **sizes: int) -> DataFrame:
    """(page_key, chunk_index, heading_path, body) of pages(key, blocks). Null blocks and headings alone give no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, n, where, body)
                for k, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, (where, body) in enumerate(chunk_blocks(blocks, **sizes))
            ]
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_key", "chunk_index", "heading_path", "body"])

    return pages.where(F.col("blocks").isNotNull()).select(F.col(key).cast("string").alias("page_key"), "blocks").mapInArrow(run, CHUNK_SCHEMA)
