"""Repeated lines, splitting, packing, leaks and shared spans against brute force, with edge cases."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestead.llm import leakage, packing, repeated_lines, shared_spans, splitting

PAGES = "page_id bigint, url string, text string"


def rows(df):
    return sorted(map(tuple, df.collect()))


# repeated lines


def letters(line):
    return "".join(c for c in line.lower() if c.isalpha())


def brute_lines(pages):
    sites = defaultdict(dict)
    for page, url, text in pages:
        sites[url.split("/")[2].lower()][page] = text.split("\n")
    out = []
    for own in sites.values():
        on = defaultdict(set)
        for page, lines in own.items():
            for line in lines:
                on[letters(line)].add(page)
        for page, lines in own.items():
            out += [(page, n) for n, line in enumerate(lines) if letters(line) and len(on[letters(line)]) >= max(5, 0.1 * len(own))]
    return sorted(out)


def some_pages(seed=3):
    r = random.Random(seed)
    furniture = ["Home | About", "© 2024 Acme", "share this!", "READ MORE", "42", ""]
    pages = []
    for i in range(160):
        host = ["https://A.example/", "http://b.example/", "https://c.example/"][0 if i < 90 else 1 + i % 2]
        lines = [f"own text number {'abcdefghij'[j]}{i} {r.random()}".translate(str.maketrans("0123456789", "qwertzuiop")) for j in range(r.randint(0, 4))]
        lines += [x.upper() if r.random() < 0.3 else x for x in furniture if r.random() < 0.6]
        r.shuffle(lines)
        pages.append((i, host + str(i), "\n".join(lines)))
    return pages


def test_repeated_lines(spark):
    pages = some_pages()
    twice = pages + pages[:20]
    got = repeated_lines.repeated_lines(spark.createDataFrame(twice, PAGES))
    assert rows(got) == brute_lines(pages)


def test_sequences_are_those_counted_plainly(spark):
    pages = some_pages(4)
    seqs = repeated_lines.page_sequences(spark.createDataFrame(pages, PAGES))
    found, _ = repeated_lines.prefix_span(seqs, repeated_lines.frequent_lines(seqs))
    got = {(r.site, tuple(r.pattern)): r.support for r in found.collect()}
    own = [(r.site, r.page_id, [k for k in r["keys"] if k is not None]) for r in seqs.collect()]
    size, support = defaultdict(int), defaultdict(set)
    for site, page, keys in own:
        size[site] += 1
        for a in range(len(keys)):
            for b in range(a + 1, len(keys) + 1):
                support[site, tuple(keys[a:b])].add(page)
    want = {k: len(v) for k, v in support.items() if len(v) >= max(5, 0.1 * size[k[0]])}
    assert got == want and any(len(k[1]) > 1 for k in want)


def test_clean_text_and_edges(spark):
    pages = spark.createDataFrame(
        [(i, "https://x.example/a", f"Same line\nown {'x' * (i + 1)}\n12", "clash", i) for i in range(6)] + [(90, None, None, "c", 0), (91, None, "", "c", 0), (None, "https://x.example/", "Same line", "c", 0)],
        PAGES + ", clean_text string, site int",
    )
    got = {r.page_id: (r.clean_text, r.removed_lines) for r in repeated_lines.without_repeated_lines(pages).collect()}
    assert got[0] == ("own x\n12", [0]) and got[90] == (None, []) and got[91] == ("", []) and len(got) == 9
    assert repeated_lines.repeated_lines(spark.createDataFrame([], PAGES)).count() == 0


# splitting

texts = st.text(alphabet=st.sampled_from("ab .,\n;é😀"), max_size=900)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(5, 60), st.data())
def test_pieces_hold_the_whole_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts = splitting.pieces(text, limit, overlap)
    assert [p[1] for p in parts] == [0] + [p[2] for p in parts[:-1]] and parts[-1][2] == len(text)
    for begin, own, end in parts:
        assert end - begin <= limit and own - overlap <= begin <= own
        assert len(parts) == 1 or end > own


def test_pieces_end_at_boundaries():
    text = " ".join(f"This is sentence {i}, and it has a clause." for i in range(80))
    parts = splitting.pieces(text)
    assert len(parts) > 2
    assert all(text[:end].rstrip().endswith(".") for _, _, end in parts)
    assert all(text[begin:].startswith("This") and begin < own for begin, own, _ in parts[1:])


def test_split_table(spark):
    long = "\n\n".join("word " * 60 for _ in range(10))
    table = [("a", ["H"], long, 1), ("a", ["H"], long, 1), ("b", None, "  short \n", 2), ("c", [], None, 3), ("d", [], "", 4), ("e", ["X"], "x" * 100_000, 5), ("f", [], " " * 2000 + "y", 6), ("g", [], "z" * 900, 7)]
    df = splitting.split_oversized(spark.createDataFrame(table, "id string, heading_path array<string>, body string, piece_no int"))
    got = defaultdict(list)
    for r in df.collect():
        got[r.id].append(r)
        assert len(r.piece) <= 900
    assert [(i, len(v)) for i, v in sorted(got.items()) if i not in "ae"] == [("b", 1), ("c", 1), ("d", 1), ("f", 1), ("g", 1)]
    assert got["b"][0].piece == "short" and got["f"][0].piece == "y" and got["c"][0].piece == ""
    e = sorted(got["e"], key=lambda r: r.piece_no)
    assert "".join("x" * (n.own_start - r.own_start) for r, n in zip(e, e[1:])) == "x" * e[-1].own_start and e[-1].start + len(e[-1].piece) == 100_000
    assert all(r.heading_path == ["H"] and r.n_pieces == len(got["a"]) for r in got["a"]) and len({r.piece_no for r in got["a"]}) == len(got["a"]) > 1
    assert splitting.split_oversized(spark.createDataFrame([], "id string, body string")).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df.withColumnRenamed("piece", "body"), 10, 10)


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_pack_keeps_every_item_once(sizes):
    bins = packing.pack(sizes, 50)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 50 for b in bins)


def test_smallest_is_replaced_by_two():
    assert sorted(map(sorted, packing.pack([60, 35, 22, 17], 100))) == [[0, 2, 3], [1]]


def test_pack_fills_well():
    r = random.Random(1)
    sizes = [min(4096, int(r.lognormvariate(7, 0.7)) + 1) for _ in range(5000)]
    bins = packing.pack(sizes)
    assert sum(sizes) / (4096 * len(bins)) > 0.99


def test_pack_documents(spark):
    r = random.Random(2)
    docs = [(i, r.choice([None, r.randint(1, 9000), 0]), "ab é" * r.randint(0, 900), i) for i in range(300)]
    docs += docs[:10] + [(900, None, None, 0), (None, 5, "x", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint, text string, part int")
    got = packing.pack_documents(df, shard_items=100).collect()
    size = {d: n if n else len((t or "").encode()) + 1 for d, n, t, _ in docs if d is not None}
    by_doc, by_bin = defaultdict(list), defaultdict(int)
    for x in got:
        by_doc[x.doc_id].append((x.token_start, x.token_end))
        by_bin[x.container] += x.token_end - x.token_start
    assert max(by_bin.values()) <= 4096 and set(by_doc) == set(size)
    for d, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == size[d] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == -(-size[d] // 4096)
    assert packing.pack_documents(df.limit(0)).count() == 0


# leaks


def longest_run(a, b):
    best, last = 0, {}
    for x in a:
        new = {}
        for j, y in enumerate(b):
            if x == y:
                new[j] = last.get(j - 1, 0) + 1
                best = max(best, new[j])
        last = new
    return best


def test_leaks(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünder", "x1"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(3, 40))) for i in range(20)] + [(50, None), (51, ""), (52, "a b c"), (None, "x"), (0, None)]
    docs = []
    for d in range(120):
        own = text(r.randint(0, 80)).split()
        if d % 2:
            passage = items[r.randrange(20)][1].split()
            a, n = r.randrange(len(passage)), r.randint(1, len(passage))
            own[len(own) // 2 : len(own) // 2] = passage[a : a + n]
        docs.append((d, r.choice([" ", ", ", "\n- "]).join(w.upper() if r.random() < 0.1 else w for w in own)))
    docs += docs[:5] + [(900, None), (901, ""), (None, "w1 w2")]
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    got = {(x.doc_id, x.item_id): x for x in found.collect()}
    want = {(d, i) for d, t in docs if t and d is not None for i, p in items if p and i is not None and longest_run(leakage.words(t), leakage.words(p)) >= 12}
    assert {k for k, x in got.items() if x.longest_run >= 12} == want and want
    for (d, i), x in got.items():
        assert x.longest_run == longest_run(leakage.words(dict(docs)[d]), leakage.words(next(p for k, p in items if k == i and p)))
        assert 0 < x.share <= 1
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, passage string")).count() == 0


def test_windows_do_not_span_two_passages_of_an_item(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "h i j k l m n o")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g h i j k l m n")], "item_id bigint, passage string")
    got = {(x.doc_id, x.item_id): x.longest_run for x in leakage.leaks(docs, items).collect()}
    # document 2 has fewer words of item 2 in a row than a window, so it may lack a seed
    assert (got[1, 1], got[1, 2], got[2, 1]) == (7, 14, 7) and got.get((2, 2), 7) == 7


def test_edited_copies_are_found_and_rank_above_the_rest(spark):
    """Of passages of 60 words in which one word in eight is replaced, dropped or doubled, at least 95 % are found, with a share above chance."""
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ar", "el", "in", "os", "ut", "and", "ert", "ill", "onk", "ush")]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(60)) for i in range(40)]
    docs, planted = [], set()
    for d in range(200):
        own = text(300)
        if d % 2:
            i, passage = r.choice(items)
            copy = [x for w in passage for x in ((w,) if r.random() > 0.125 else r.choice([(), (w, w), (r.choice(vocabulary),)]))]
            own[100:100] = copy
            planted.add((d, i))
        docs.append((d, " ".join(own)))
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id bigint, passage string"))
    share = {(x.doc_id, x.item_id): x.share for x in found.collect()}
    assert sum(k in share and share[k] >= 0.5 for k in planted) >= 0.95 * len(planted)
    assert all(v < 0.5 for k, v in share.items() if k not in planted)


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -2), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=15), st.lists(st.integers(0, 3), max_size=12))
def test_alignment_is_smith_waterman(a, b):
    score, _, run = leakage.align(np.array(a, int), np.array(b, int))
    assert score == brute_align(a, b) and run == longest_run(a, b)


# shared spans


def maximal_repeats(a, b, least):
    out = set()
    for shift in range(-len(a), len(b)):
        i = max(0, -shift)
        while i < min(len(a), len(b) - shift):
            j = i
            while j < min(len(a), len(b) - shift) and a[j] == b[j + shift]:
                j += 1
            if j - i >= least:
                out.add((i, i + shift, j - i))
            i = j + 1
    return out


@pytest.mark.parametrize("index, block", [("blocks", None), ("blocks", 13), ("content", 25)])
def test_shared_spans(spark, index, block):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh é\n😀") for _ in range(n))
    stock = [text(r.randint(70, 120)) for _ in range(8)]
    docs = []
    for d in range(60):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            s = r.choice(stock)
            a = r.randrange(len(s))
            t += s[a : a + r.randint(30, 110)] + text(r.randint(0, 30))
        docs.append((d, t))
    docs += [(70, docs[3][1]), (71, docs[3][1]), (72, ""), (73, None), (74, "ab" * 60), (75, "ab" * 50 + "x"), (None, docs[3][1]), docs[3]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans, classes = shared_spans.shared_spans(df, 40, block, index)
    pairs = rows(shared_spans.document_pairs(spans, classes, df, 40))
    unique = {d: t for d, t in docs if d is not None and t is not None}
    want = [(a, b) for a, b in combinations(sorted(unique), 2) if (len(unique[a]) >= 40 and unique[a] == unique[b]) or maximal_repeats(unique[a], unique[b], 40)]
    assert pairs == want and len(want) > 10
    reps = {x.doc_id: x.rep for x in classes.collect()}
    assert reps[70] == reps[71] == reps[3] == 3 and reps[72] == 72 and 73 not in reps
    got = defaultdict(set)
    for x in spans.collect():
        got[x.rep_a, x.rep_b].add((x.start_a, x.start_b, x.length))
    for (a, b), found in got.items():
        if index == "blocks" or {a, b} != {74, 75}:  # there every diagonal is a repeat of its own; one on each side of the anchors is enough
            assert found == maximal_repeats(unique[a], unique[b], 40)
        assert found <= maximal_repeats(unique[a], unique[b], 40)
    share = {x.doc_id: x for x in shared_spans.shared_share(spans, classes, df).collect()}
    assert share[70].shared_chars == len(docs[3][1]) and share[72].shared_chars == 0 and set(share) == set(unique)
    for d in list(unique)[:20]:
        cover = set()
        for (a, b), found in got.items():
            for i, j, n in found:
                cover |= set(range(i, i + n)) if a == reps[d] else set(range(j, j + n)) if b == reps[d] else set()
        assert share[d].shared_chars == (len(unique[d]) if share[d].copies > 1 else len(cover))
    assert shared_spans.shared_spans(df.limit(0), index=index)[0].count() == 0
    with pytest.raises(ValueError, match="block"):
        shared_spans.shared_spans(df, 40, 41, index)


def test_all_pairs_of_a_hundred_copies(spark):
    """Of one text, and of a text that shares a stretch with it."""
    stretch = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(130))
    docs = [(i, stretch) for i in range(100)] + [(200, "x" * 50 + stretch + "y")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spans, classes = shared_spans.shared_spans(df)
    every = set(combinations([*range(100), 200], 2))
    assert set(rows(shared_spans.document_pairs(spans, classes, df))) == every == set(rows(shared_spans.document_pairs(spans, classes, df, copies=None)))
    assert set(rows(shared_spans.document_pairs(spans, classes, df, copies=50))) == {(0, i) for i in range(1, 100)} | {(0, 200)}


def test_filter_passes_all_that_is_in_it(spark):
    from lodestead.llm import filters

    keys = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 60_000)
    words = filters.bloom(spark.createDataFrame([(int(k),) for k in keys[:20_000]], "key bigint"))
    found = filters.passing(words, keys.view(np.uint64))
    assert set(range(20_000)) <= set(found.tolist()) and len(found) < 20_000 + 800
    full = filters.bloom(spark.createDataFrame([(int(k),) for k in keys[:5000]], "key bigint"), most_words=64)
    assert len(full) == 64 and len(filters.passing(full, keys[:5000].view(np.uint64))) == 5000
    assert len(filters.passing(filters.bloom(spark.createDataFrame([], "key bigint")), keys.view(np.uint64))) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", min_size=40, max_size=60), st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60))
def test_equal_stretches_have_an_anchor_in_common(before, shared, after, other):
    def keys(t):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        up, down = shared_spans._powers(shared_spans._BASE, len(codes)), shared_spans._powers(shared_spans._INVERSE, len(codes))
        h = shared_spans.window_hashes(codes, 15, up, down)
        where = defaultdict(set)
        for i in range(len(h)):
            where[int(h[i])].add(t[i : i + 15])
        assert all(len(v) == 1 for v in where.values())
        return {int(h[i]): i for i in shared_spans.anchors(h, 40 - 15 + 1)}

    assert set(keys(before + shared + after)) & set(keys(other + shared))
