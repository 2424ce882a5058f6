"""Conversation trie, sequence packing and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colscope.llm import fillmiddle, packing, prefixtrie
from colscope.llm.common import read_table

# ------------------------------------------------------------------------- trie

TURNS = "conv_id long, turn long, role string, text string, depth string, x1 string, bytes string, `_part` string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    out = set()
    for path, who in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        parents = {p[:-1] for p in nodes if p}
        out.add((who[0], len(path), nodes[path[:-1]][0] if path else None, len(who), sum(p[:-1] == path for p in nodes if p),
                 sum(p not in parents for p in under), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
                 hashlib.sha256(",".join(str(c) for c in who if built[c] == path).encode()).hexdigest()))
    return out


def columns(rows):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


def random_chats(seed, n, longest):
    rng = random.Random(seed)
    for c in range(-7, n):
        for t in range(rng.choice([1, 2, 5, 9, 12, longest])):
            yield (c if c % 11 else c * 1000, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""]), "x", "x", "x", "x")


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_equals_plain_walk(spark, height):
    rows = list(random_chats(height, 60, 30)) + [(None, 0, "user", "x", None, None, None, None)] + [(c, None, None, None, None, None, None, None) for c in range(100, 160)]
    got = prefixtrie.conversation_trie(spark.createDataFrame(rows, TURNS), height).collect()
    assert len(got) == len(columns(got)) and columns(got) == plain_trie(rows)


def test_long_conversations_and_a_common_end(spark):
    """Deeper than a block of the running names and than several bands; more ends at one node than a joined text holds."""
    rows = [(5, i, "user", f"t{i % 3}") for i in range(1400)] + [(6, i, "user", f"t{i % 3}") for i in range(1300)] + [(c, 0, "user", "same") for c in range(1000, 2000, 5)]
    rows += [(c, 0, "user", "only") for c in range(10_001, 11_001)]
    turns = spark.createDataFrame([(*r, None, None, None, None) for r in rows], TURNS)
    got = prefixtrie.conversation_trie(turns)
    by = {(r.conv_id, r.depth): r for r in got.collect()}
    assert max(d for _, d in by) == 1400
    # 6 repeats the first 1300 turns of 5, two bytes each
    assert all(by[5, d].n_leaves == 1 and by[5, d].n_convs == 1 + (d <= 1300) and by[5, d].saved_tokens == 2 * max(0, 1301 - d) for d in range(1, 1401))
    assert all(by[5, d].parent_conv_id == 5 for d in range(2, 1401)) and by[5, 1400].n_children == 0
    root = by[min(c for c, _ in by), 0]
    assert root.n_convs == len({r[0] for r in rows}) and root.parent_conv_id is None
    # turnless conversations end at the root, over many joined texts
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(10_001, 11_001)}
    turnless = sorted(c for c in h if h[c] and (c % 5 != 0) and not (c - c % 5 in h and h[c]))
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest()


def test_odd_conversations(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = prefixtrie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "", "")], TURNS))
    assert lone.count() == 0


# ---------------------------------------------------------------------- packing

def greedy_bins(counts, limit):
    """Minimum bin slack one bin at a time, every bin found anew."""
    left, bins = counts.copy(), []
    while left.any():
        combo = packing.fullest(left, limit)
        for n, k in combo:
            left[n] -= k
        bins.append(tuple(combo))
    return bins


def best_sum(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


def test_fullest_combination_and_plan():
    rng = random.Random(1)
    for _ in range(60):
        limit = rng.choice([12, 30, 64])
        pieces = [rng.randint(1, limit) for _ in range(rng.randint(1, 40))]
        counts = np.bincount(pieces, minlength=limit + 1)
        combo = packing.fullest(counts, limit)
        first = max(pieces)
        rest = sorted(pieces)
        rest.remove(first)
        assert sum(n * k for n, k in combo) == first + best_sum(rest, limit - first) and all(k <= counts[n] for n, k in combo)
        rows, bins = packing.plan(counts, limit)
        single = greedy_bins(counts, limit)
        assert bins == len(single) >= -(-sum(pieces) // limit)
        placed = defaultdict(list)
        for n, count in enumerate(counts):
            mine = rows[rows[:, 0] == n]
            for rank in range(count):
                _, at, times, offset, bin_ = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                placed[bin_ + (rank - at) // times].append((offset + (rank - at) % times * n, n))
        assert sorted(tuple(sorted(n for _, n in v)) for v in placed.values()) == sorted(tuple(sorted(n for n, k in c for _ in range(k))) for c in single)
        for v in placed.values():
            ends = np.cumsum([0] + [n for _, n in sorted(v)])
            assert [o for o, _ in sorted(v)] == ends[:-1].tolist() and ends[-1] <= limit


def test_hot_lengths_need_few_rows():
    counts = np.zeros(1025, np.int64)
    counts[1:] = np.random.default_rng(2).integers(0, 10**9, 1024)
    counts[3] = 10**12
    rows, bins = packing.plan(counts)
    assert len(rows) < 60_000 and bins <= 1.001 * (counts * np.arange(1025)).sum() / 1024 + 1


def packed_rows(spark, docs, **kw):
    return packing.pack(docs, **kw).collect()


def check_packing(rows, docs, limit):
    reader = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = defaultdict(list)
    for doc, text in docs:
        ids = reader.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % limit + 1
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[doc].append((i, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), sum(r.length for r in rows)


def test_pack_whole_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    bins, tokens = check_packing(packed_rows(spark, docs.repartition(13)), [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert bins <= 1.01 * tokens / 1024 + 1


@pytest.mark.parametrize("limit", [7, 64])
def test_pack_odd_documents(spark, odd_docs, no_docs, limit):
    docs = odd_docs.unionByName(odd_docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, '<|endoftext|> x<|endoftext') as text", "lang", "source", "n_chars", "score", "fp", "key", "a", "removed"))
    check_packing(packed_rows(spark, docs, limit=limit), [(r.doc_id, r.text) for r in docs.collect()], limit)
    assert packing.pack(no_docs).count() == 0


def test_sequences_hold_the_ids(spark, sf):
    docs = read_table(spark, sf, "documents")
    packed = packing.pack(docs)
    pieces = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert r.length * 4 == len(r.ids) <= 4096
        for offset in r.offsets:
            piece = pieces[r.sequence_id, offset]
            assert zlib.crc32(bytes(r.ids)[4 * offset:4 * (offset + piece.length)]) == piece.ids_crc32


def test_ids_of_cut_texts(monkeypatch):
    """A long text goes through the tokenizer in parts; the ids are those of the whole."""
    rng = random.Random(3)
    vocabulary, ranks = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)
    reader = Tokenizer.from_file(vocabulary)
    monkeypatch.setattr(packing, "PART", 40)
    marks = ["'s", "'", "  ", "\n\n ", "12", "<|endoftext|>", "é", "東京", "|", "...", "\u0085", "　", "x'll", "\t", " "]
    for _ in range(300):
        text = "".join(rng.choice(marks) if rng.random() < 0.5 else "".join(rng.choice("abcXYZ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 200)))
        assert packing.text_ids(text, vocabulary, ranks).tolist() == reader.encode(text, add_special_tokens=False).ids


def test_both_libraries_class_characters_alike():
    """Each assigned code point among letters, digits, marks and spaces."""
    exact, quick = packing._load(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    for at in range(0, 0x30000, 0x4000):
        texts = [f"a{c}a 1{c}1 {c}!{c}! {c} {c}" for c in map(chr, range(at, at + 0x4000)) if not "\ud800" <= c <= "\udfff"]
        assert [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)] == quick.encode_ordinary_batch(texts, num_threads=4)


# -------------------------------------------------------------- fill in the middle

def plain_middle(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(units), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i:i + 8], 16) for i in range(0, 32, 8))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return (doc, n, form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), *sha), out


def middle_texts(seed):
    rng = random.Random(seed)
    bits = ["<P", "<S>", "<M", ">", "<", "é", "東京", "😀", "a", "Zz", " ", "\n", "abcdefgh" * 5, "1", "\x00", "P>", "S", "M>"]
    for i in range(300):
        pool = bits if i % 7 == 0 else [b for b in bits if b != "<S>"]
        yield i, "".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 20, 200])))
    yield 1001, "x" * 5000
    yield 1002, "é" * 3000 + "abc" * 1000
    yield 1003, None
    yield None, "no id here"
    yield 7, "same id"
    yield 7, "same id"


@pytest.mark.parametrize("frame", [8, 64, 1 << 16])
def test_middle_equals_plain_python(spark, frame):
    rows = list(middle_texts(frame))
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, frames string, n string")
    got = [tuple(r) for r in fillmiddle.transformed_digests(docs, frame).collect()]
    want = [plain_middle(d, t)[0] for d, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_frames_are_seekable_and_outputs_whole(spark):
    rows = [(d, t) for d, t in middle_texts(5) if d is not None and d != 7] + [(2000 + i, "word 12 é " * 3000) for i in range(8)]
    stored = fillmiddle.store_frames(spark.createDataFrame(rows, "doc_id long, text string"), 1000).cache()
    for r in stored.collect():
        assert all(f.size <= 1000 for f in r.frames) and sum(f.size for f in r.frames) == len((dict(rows)[r.doc_id] or "").encode())
    out = {r.doc_id: r.text for r in fillmiddle.output_texts(fillmiddle.fill_in_middle(stored, 1000)).collect()}
    assert out == {d: plain_middle(d, t)[1] for d, t in rows}


def test_middle_of_odd_documents(spark, odd_docs, no_docs):
    got = sorted(repr(tuple(r)) for r in fillmiddle.transformed_digests(odd_docs).collect())
    assert got == sorted(repr(plain_middle(r.doc_id, r.text)[0]) for r in odd_docs.collect())
    assert fillmiddle.transformed_digests(no_docs).count() == 0
