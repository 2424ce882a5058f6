"""Embeddings, SimHash and line deduplication against brute force, and odd input."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from colscope.llm import linededup, nndescent, simhash
from colscope.llm.common import connected_components

from .conftest import sentence


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, j) for j in range(501, 600)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = components({n for x in links for n in x}, links)
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# ------------------------------------------------------------------ embeddings

def brute_vectors(rows, threshold=0.93):
    cells = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and any(v) and all(x is not None and np.isfinite(x) for x in v):
            cells[label, len(v)].append(i)
    links = set()
    for own in cells.values():
        x = np.array([np.float32(rows[i][1]) for i in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        links |= {(own[a], own[b]) for a, b in zip(*np.nonzero(x @ x.T >= threshold)) if a != b}
    root = components(range(len(rows)), links)
    least = defaultdict(lambda: 1 << 62)
    for i in range(len(rows)):
        least[root[i]] = min(least[root[i]], rows[i][0])
    degree = defaultdict(int)
    for a, _ in links:
        degree[a] += 1
    return sorted((rows[i][0], degree[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 24)).astype("float32")
    x[600:800] = x[:200] + 0.22 * rng.standard_normal((200, 24)).astype("float32")
    x[800:900] = x[7] + 0.05 * rng.standard_normal((100, 24)).astype("float32")
    x[300:330] = x[300]
    labels = rng.integers(0, 2, 900)
    labels[600:800], labels[800:900], labels[300:330] = labels[:200], labels[7], labels[300]
    rows = [(int(i), [float(v) for v in x[k]], int(labels[k])) for k, i in enumerate(rng.permutation(900))]
    got = nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


def test_poor_audit_ends_in_exact_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 24)).astype("float32")
    x[100:200] = x[:100] + 0.22 * rng.standard_normal((100, 24)).astype("float32")
    x[200:300] = x[7] + 0.05 * rng.standard_normal((100, 24)).astype("float32")
    rows = [(50 * i, [float(v) for v in x[i]], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = nndescent.near_vectors(df, trees=1, leaf=2, rounds=0, retries=0)
    assert sorted(map(tuple, got.collect())) == brute_vectors(rows)


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, v, 0), (2, w, 0), (3, v, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [float("nan")] * 3, 0),
            (8, [float("inf"), 1.0, 1.0], 0), (9, [], 0), (10, v, 1), (11, [1.0, 2.0], 0), (12, [2.0, 4.0], 0), (2, w, 0), (0, [2.0, 4.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("copies", F.lit(None).cast("int"))
    got = sorted(map(tuple, nndescent.near_vectors(df).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([*alone, (0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (2, 3, 0, False), (11, 1, 11, True), (12, 1, 11, False)])
    assert nndescent.near_vectors(df.where("false")).count() == 0


# --------------------------------------------------------------------- SimHash

def test_fingerprint_by_definition():
    for text in ["a b c d e a b c", "One\ttwo\x0b three", "x", " p  q ", "", None, "É É\u00a0x y"]:
        words = (text or "").encode()
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in words)
        parts = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
        shingles = [b" ".join(parts[i:i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.word_fingerprint(text, 3) == want


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_trees_find_every_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 60, 1400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 1400).astype(np.uint64))
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, dense, near]))
    a, b, _ = simhash.close_forest(fps, radius)
    want = components(fps.tolist(), [(int(x), int(y)) for x in fps for y in fps[np.bitwise_count(fps ^ x) <= radius]])
    assert components(fps.tolist(), list(zip(a.tolist(), b.tolist()))) == want
    tree = simhash.VpTree(fps[::3], 16, radius)
    shard, part = tree.deal(fps)
    links = []
    for s in np.unique(shard):
        a, b, _ = simhash.close_forest(part[shard == s], radius)
        links += zip(a.tolist(), b.tolist())
    assert tree.shards > 3 and components(fps.tolist(), links) == want


def test_odd_documents_group(spark, odd_docs, no_docs):
    got = simhash.simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 0
    assert by[90].component_id == 5 and by[None].component_id == 5
    assert simhash.simhash_groups(no_docs).count() == 0


def plain_kept(rows):
    """Ids kept of (doc_id, text) rows: every pair of fingerprints is compared."""
    fps = [(i, simhash.word_fingerprint(t, 3)) for i, t in rows]
    at = range(len(fps))
    name = components(at, [(x, y) for x in at for y in range(x) if (fps[x][1] ^ fps[y][1]).bit_count() <= 2])
    least = {}
    for x in at:
        least[name[x]] = min(least.get(name[x], fps[x][0]), fps[x][0])
    return {fps[x][0] for x in at if least[name[x]] == fps[x][0]}


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(80, 900)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows += [(1000 + i, " ".join(w)), (2000 + i, t.upper()), (3000 + i, t + " end")]
    rows += [(4000, ""), (4001, None), (4002, " \n"), (4003, "short"), (4004, "SHORT")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("own")).withColumn("gone", F.lit(1))
    kept = simhash.keep_one(docs)
    got = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) and set(got) == plain_kept(rows)
    assert not any(2000 <= i < 3000 for i in got) and {4001, 4002, 4004}.isdisjoint(got) and set(range(80)) <= set(got)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # Text 9 has one word, a NUL character: not the fingerprint of empty texts.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 5, 5, 6, 7, 8, 9]
    assert simhash.keep_one(no_docs).count() == 0


def test_stage_keeps_what_the_operator_names(spark, sf):
    """The pipeline's stage and the operator agree on every document of the corpus."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {i for i, c in groups.items() if i == c}


# ----------------------------------------------------------------------- lines

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i:i + 1] = rng.choice([[], ["x"], [s[i], "é"]])
    return "".join(s)


def test_banded_distance_and_segment_keys():
    rng = random.Random(1)
    keys = linededup.SegmentKeys(2)
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 40)))
        b = mutate(rng, a, rng.randrange(0, 4)) or "a"
        d = distance(a, b)
        assert linededup.within_edits(a, b, 2) == (d <= 2)
        if d <= 2 and len(b) >= 3 and a != b:
            number, key = keys([a, b])
            assert set(key[number == 0]) & set(key[number == 1])


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    pool = [sentence(rng, rng.randrange(1, 9)) for _ in range(60)]
    pool += [mutate(rng, p, rng.randrange(1, 4)) for p in pool if len(p) > 10]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lines = sorted({x for _, t in docs for x in t.split("\n")})
    links = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if min(len(a), len(b)) >= 30 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    name, seen, want = components(lines, links), set(), {}
    for i, t in docs:
        kept = []
        for x in t.split("\n"):
            if name[x] not in seen:
                kept.append(x)
            seen.add(name[x])
        want[i] = ("\n".join(kept), len(t.split("\n")) - len(kept))
    assert got == want


def test_hot_segment_is_split(spark):
    line = "a shared beginning that a great many lines have in common, number "
    docs = [(i, line + f"{i:06d} {i * i:010d}") for i in range(900)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = [t for _, t in docs]
    x, y = np.triu_indices(len(texts), 1)
    near = linededup.Lines(texts).within(x, y, 2)
    links = [(texts[i], texts[j]) for i, j in zip(x[near], y[near])]
    assert len(got) == 900 and sum(r.n_removed for r in got) == len(texts) - len(set(components(texts, links).values()))


def test_many_lines_share_a_beginning(spark):
    """4000 lines meet in the same segments; only the planted copies within two edits go, and no pair is compared twice in a block."""
    rng = random.Random(12)
    start = "a shared beginning that a great many lines have in common, and then "
    texts = [start + "".join(rng.choice("abcdefghijklmnop 0123456789") for _ in range(40)) for _ in range(4000)]
    copies = [mutate(rng, texts[i], 2) for i in range(0, 4000, 80)]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(7)
    keys = linededup.SegmentKeys(2)(texts)
    met = np.unique(np.stack(keys[::-1]).view(np.int64), axis=1)
    assert np.unique(met[0], return_counts=True)[1].max() == 4000
    began = time.time()
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs).collect()}
    assert {i for i, n in got.items() if n} == set(range(4000, 4050))
    assert time.time() - began < 120


def test_pairs_offered_once(spark):
    """Blocks of one and of two sides: each allowed pair once, none within a side of two."""
    rng = random.Random(3)
    texts = [sentence(rng, 6)[:30] for _ in range(90)]
    table = pa.table({"part": [1] * 40 + [2] * 50, "side": [0] * 40 + [i % 2 for i in range(50)], "line": texts})
    lines = linededup.Lines(texts)
    for small in (0, 16, 100):
        linededup.SMALL, kept = small, linededup.SMALL
        try:
            pairs = [(int(a), int(b)) for x, y in linededup._candidates(table, np.array([0, 40, 90]), lines.lens, np.zeros((90, 8), np.uint64), 30) for a, b in zip(x, y)]
        finally:
            linededup.SMALL = kept
        assert len(pairs) == len(set(pairs)) == 40 * 39 // 2 + 25 * 25 and all(a < b for a, b in pairs)


def test_letter_pairs_never_lose_a_near_line():
    rng = random.Random(6)
    for _ in range(300):
        a = sentence(rng, rng.randrange(2, 30))
        marks = linededup.Lines([a, mutate(rng, a, 2), mutate(rng, a, 1)]).signatures()
        assert all(np.bitwise_count(marks[0] ^ m).sum() <= 8 for m in marks)


def test_working_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "same line that is long enough to count\nx", "a", "b", "c", "d"), (2, "same line that is long enough to count\ny", "a", "b", "c", "d")],
                                 "doc_id long, text string, id string, removed string, row string, __gone string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert (got[2].text, got[2].n_removed, got[2].id, got[2].removed, got[2].row, got[2]["__gone"]) == ("y", 1, "a", "b", "c", "d") and got[1].n_removed == 0


def test_odd_lines(spark, odd_docs, no_docs):
    got = linededup.dedup_lines(odd_docs)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text is None and by[0].n_lines == 0 and by[1].text == "" and by[2].n_removed == 0
    assert by[90].n_removed == 1 and by[90].text == "" and by[None].n_removed == 0
    assert by[5].n_removed == 0 and by[6].n_lines == 2000
    clean = linededup.clean_lines(odd_docs)
    assert clean.columns == odd_docs.columns and 90 not in {r.doc_id for r in clean.collect()}
    assert linededup.dedup_lines(no_docs).count() == 0
