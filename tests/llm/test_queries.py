"""The subpackage's queries on the smallest tables: against their SQL, and what must hold of those without SQL."""

import os
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestead.llm import queries

DATA = os.environ.get("LODESTEAD_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns) or None).to_pylist()


def got(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want = con.sql(queries.SQL[name])
    assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).select(*want.columns).collect())) == sorted(want.fetchall())


def test_p1_found_and_content(spark):
    """What is found is a block with text, each once; what is left of a page is exactly its other blocks, and no page loses all its body."""
    pages = {r["page_id"]: r for r in rows_of("extracted_pages")}
    found = [tuple(r) for r in got(spark, "p1_found")]
    assert len(found) == len(set(found)) > 100
    gone = defaultdict(set)
    for page, pos in found:
        assert pages[page]["blocks"][pos]["text"].strip()
        gone[page].add(pos)
    left = {r.page_id: r for r in got(spark, "p1_content")}
    assert set(left) == set(pages)
    for page, r in pages.items():
        if r["blocks"] is None:
            assert left[page].text == r["text"] and page not in gone
        else:
            kept = [b["text"] for k, b in enumerate(r["blocks"]) if k not in gone[page]]
            assert left[page].n_blocks == len(kept) and left[page].text == "\n".join(kept)
            assert any(b["type"] != "heading" for k, b in enumerate(r["blocks"]) if k not in gone[page])


def test_p2_clean_and_sequences(spark):
    """Clean text is the text without the lines found; a sequence's lines are frequent and no more frequent than its parts."""
    lines = defaultdict(set)
    for r in got(spark, "p2_found"):
        lines[r.page_id].add(r.line_no)
    clean = {r.page_id: r for r in got(spark, "p2_clean")}
    for r in rows_of("extracted_pages", "page_id", "text"):
        kept = [x for k, x in enumerate(r["text"].split("\n")) if k not in lines[r["page_id"]]]
        assert clean[r["page_id"]].clean_text == "\n".join(kept) and clean[r["page_id"]].n_removed == len(lines[r["page_id"]])
    support = {(r.site, r.pattern): r.support for r in got(spark, "p2_sequences")}
    assert support and min(support.values()) >= 5
    for (site, pattern), n in support.items():
        keys = pattern.split(",")
        for part in (keys[1:], keys[:-1]):
            assert not part or support[site, ",".join(part)] >= n


def test_p3_groups_and_walk(spark):
    groups = {r.page_id: r for r in got(spark, "p3_groups")}
    for r in groups.values():
        assert r.component <= r.rep <= r.page_id and groups[r.rep].rep == r.rep and groups[r.rep].component == r.component
    for a, b in map(tuple, got(spark, "p3_found")):
        assert groups[a].component == groups[b].component
    assert all(r.node_pairs >= r.tasks and r.n_rows > 1 for r in got(spark, "p3_walk"))


def test_p4_pieces(spark):
    """Every chunk has its pieces in order, none over 900 characters, which overlap by 120 at most and give its whole body again."""
    bodies = {(r["id"], (r["body"] or "").strip()) for r in rows_of("chunks", "id", "body") if r["id"]}
    pieces = defaultdict(list)
    for r in got(spark, "p4_pieces"):
        pieces[r.id].append(r)
    single = {i for i in pieces if sum(x[0] == i for x in bodies) == 1}
    assert set(pieces) == {i for i, _ in bodies} and len(single) > 100
    for i, body in bodies:
        if i not in single:
            continue
        own = sorted(pieces[i], key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(own[0].n_pieces)) and all(len(r.piece) <= 900 for r in own)
        covered = 0
        for k, r in enumerate(own):
            assert body[r.start : r.start + len(r.piece)] == r.piece and not body[covered : r.start].strip()
            assert k == 0 or r.own_start - r.start <= 120
            covered = r.start + len(r.piece)
        assert not body[covered:].strip()


def test_p5_found_and_pages(spark):
    judged = {r.page_id: r for r in got(spark, "p5_pages")}
    assert {r.page_id for r in got(spark, "p5_found")} == {k for k, r in judged.items() if r.excluded}
    assert set(judged) == {r["page_id"] for r in rows_of("extracted_pages", "page_id", "text") if (r["text"] or "").strip()}
    assert all(r.residue_words > 0 and r.residue_words >= r.own_words for r in judged.values() if r.excluded)


def test_p6_neighbours(spark):
    """Neighbours are ordered, their cosines are right, and at least nine in ten of the exact ones are there."""
    found = defaultdict(list)
    for r in got(spark, "p6_neighbours"):
        found[r.source, r.id].append(r)
    hit = total = 0
    for name, key in (("chunk_vectors", "id"), ("manifest_entries", "url")):
        table = {}
        for r in rows_of(name, key, "vector"):
            v = r["vector"]
            if r[key] is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
                table[r[key]] = np.array(v, float) / np.linalg.norm(v)
        for (source, i), own in found.items():
            if source != name:
                continue
            sims = {j: float(table[i] @ x) for j, x in table.items() if j != i}
            own = sorted(own, key=lambda r: r.place)
            assert [r.place for r in own] == list(range(1, len(own) + 1)) and len(own) == min(5, len(sims))
            assert all(abs(sims[r.neighbour] - r.similarity) < 1e-5 for r in own)
            assert all(a.similarity >= b.similarity for a, b in zip(own, own[1:]))
            best = sorted(sims, key=lambda j: (-sims[j], j))[:5]
            hit, total = hit + len(set(best) & {r.neighbour for r in own}), total + len(best)
    assert total > 20 and hit >= 0.9 * total


def test_p7_pack(spark):
    """Every token of every document lies in one container of at most 4,096, only larger documents are split, little is unused."""
    size, spans, held = {}, defaultdict(list), defaultdict(int)
    for r in rows_of("documents", "doc_id", "n_tokens", "text"):
        size[r["doc_id"]] = r["n_tokens"] if r["n_tokens"] and r["n_tokens"] >= 1 else len((r["text"] or "").encode()) + 1
    for r in got(spark, "p7_pack"):
        spans[r.doc_id].append((r.token_start, r.token_end))
        held[r.container] += r.token_end - r.token_start
    assert set(spans) == set(size) and max(held.values()) <= 4096
    for d, own in spans.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == size[d] and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert len(own) == -(-size[d] // 4096)
    assert sum(size.values()) >= 0.95 * 4096 * len(held)


def test_p8_leaks(spark):
    found = {(r.doc_id, r.item_id): r for r in got(spark, "p8_leaks")}
    assert {tuple(r) for r in got(spark, "p8_found")} == {k for k, r in found.items() if r.longest_run >= 12}
    assert all(0 < r.share <= 1 and 2 * r.longest_run <= r.score for r in found.values())


def test_p9_spans_and_shared(spark):
    """Spans are equal, cannot be extended, and add up to what each document shares."""
    text = {r["doc_id"]: r["text"] for r in rows_of("documents", "doc_id", "text")}
    cover = defaultdict(set)
    spans = got(spark, "p9_spans")
    for r in spans:
        a, b = text[r.rep_a], text[r.rep_b]
        i, j, n = r.start_a, r.start_b, r.length
        assert n >= 300 and a[i : i + n] == b[j : j + n] and r.rep_a < r.rep_b
        assert not (i and j and a[i - 1] == b[j - 1]) and not (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n])
        cover[r.rep_a] |= set(range(i, i + n))
        cover[r.rep_b] |= set(range(j, j + n))
    assert spans
    for r in got(spark, "p9_shared"):
        assert text[r.rep] == text[r.doc_id] and r.n_chars == len(text[r.doc_id])
        assert r.shared_chars == (r.n_chars if r.copies > 1 else len(cover[r.rep]))
