"""Problem 4: oversized items cut at natural boundaries by recursive bisection, with overlaps."""

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 900
OVERLAP = 120
#: Kinds of boundary from strong to weak, with their strength; the position is the end of the match.
BOUNDARIES = (
    (6.0, re.compile(r"\n[^\S\n]*\n\s*")),
    (5.0, re.compile(r"\n\s*")),
    (4.0, re.compile(r"[.!?…]+[\"'”’)\]»]*\s+")),
    (3.0, re.compile(r"[;:]\s+")),
    (2.0, re.compile(r"[,–—]\s+")),
    (1.0, re.compile(r"\s+")),
)


def boundaries(text: str) -> tuple[list[int], list[float]]:
    """Sorted positions inside text before which it may be cut, and the strength of each."""
    best: dict[int, float] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                best.setdefault(m.end(), strength)
    at = sorted(best)
    return at, [best[p] for p in at]


def cut_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans that tile text: the first at most `limit` long, the others at most limit - overlap.

    A span that is too long is cut at the strongest boundary near its midpoint: the strength counts, less up to 2 by the
    distance from the middle, among the boundaries in the middle half; if that has none, in the whole span; if there is
    none at all, at the midpoint.
    """
    at, strength = boundaries(text)
    rest = max(1, limit - overlap)
    done, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= (limit if start == 0 else rest):
            done.append((start, end))
            continue
        half = (end - start) / 2
        mid = start + half
        cut = None
        for low, high in ((start + half / 2, end - half / 2), (start + 1, end - 1)):
            i, j = bisect.bisect_left(at, low), bisect.bisect_right(at, high)
            if i < j:
                cut = at[max(range(i, j), key=lambda k: (strength[k] - 2 * abs(at[k] - mid) / half, -at[k]))]
                break
        if cut is None:
            cut = start + (end - start) // 2
        todo += [(cut, end), (start, cut)]
    return done


def merge_spans(spans: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined again where the bisection left both small enough to share a piece."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s[1] - out[-1][0] <= (limit if out[-1][0] == 0 else max(1, limit - overlap)):
            out[-1] = (out[-1][0], s[1])
        else:
            out.append(s)
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, own start, end) of each piece of text; the last characters of a piece before may be carried over.

    The overlap starts at the strongest boundary within `overlap` characters before the own start (the farthest of equals);
    where there is none, exactly that many characters back.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    at, strength = boundaries(text)
    out = []
    for start, end in merge_spans(cut_spans(text, limit, overlap), limit, overlap):
        low = max(0, start - overlap)
        i, j = bisect.bisect_left(at, low), bisect.bisect_left(at, start)
        begin = start if start == 0 else low
        if start and i < j:
            begin = at[max(range(i, j), key=lambda k: (min(strength[k], 4.0), -at[k]))]
        out.append((begin, start, end))
    return out


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "id", text_col: str = "body", keep: tuple[str, ...] = ("heading_path",)) -> DataFrame:
    """(id, piece_no, n_pieces, start, own_start, piece, *keep): every item as pieces of at most `limit` code points.

    White space at both ends of the text and of a piece is left out. An item within the limit is one piece. Repeated rows
    count once. Null text: one empty piece, so that no item is lost. Only items that may be above the limit leave the
    JVM. start is the position of the piece in the stripped text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    kept = [c for c in keep if c in items.columns]
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *kept)
    schema = f"id {dict(rows.dtypes)['id']}, piece_no int, n_pieces int, start int, own_start int, piece string" + "".join(f", {c} {dict(rows.dtypes)[c]}" for c in kept)
    long = F.char_length("_text") > limit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, cols = [], {n: [] for n in ("piece_no", "n_pieces", "start", "own_start", "piece")}
            for row, text in enumerate(batch.column("_text").to_pylist()):
                text = text.strip()
                parts = pieces(text, limit, overlap)
                for k, (begin, own, end) in enumerate(parts):
                    piece = text[begin:end]
                    source.append(row)
                    lead = len(piece) - len(piece.lstrip())
                    for name, v in zip(cols, (k, len(parts), begin + lead, own, piece.strip())):
                        cols[name].append(v)
            taken = batch.take(pa.array(source, pa.int32()))
            arrays = {"id": taken.column("id")}
            arrays |= {n: pa.array(v, pa.string() if n == "piece" else pa.int32()) for n, v in cols.items()}
            arrays |= {c: taken.column(c) for c in kept}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    oversized = rows.where(long).dropDuplicates().mapInArrow(cut, schema)
    whole = F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?U)^\s+|\s+$", "")
    zero = F.lit(0)
    fits = rows.where(F.coalesce(~long, F.lit(True))).select(
        "id", zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("start"), zero.alias("own_start"), whole.alias("piece"), *kept
    ).dropDuplicates()
    return fits.unionByName(oversized)
