"""Language ID, decontamination, toxicity and quality."""

import random
import re

import numpy as np

from colscope.llm import decontaminate, langid, quality, toxicity
from colscope.llm.common import read_table
from colscope.llm.words import WordHashes

from .conftest import sentence


def test_word_hashes_follow_words():
    texts = ["One two, one_2 TWO", None, "", "é東 é", "x" * 3000 + " one", "one"]
    hashes, counts = WordHashes()(texts)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


# ------------------------------------------------------------------ language ID

def test_language_accuracy(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 40
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_long_text_goes_in_pieces():
    rng = random.Random(3)
    text = sentence(rng, 200_000)
    piece, langid.PIECE = langid.PIECE, 1 << 30
    try:
        whole, _ = langid.Profiles()([text])
    finally:
        langid.PIECE = piece
    parts, _ = langid.Profiles()([text])
    assert np.dot(whole[0], parts[0]) / np.linalg.norm(whole) / np.linalg.norm(parts) > 0.9999


def test_odd_languages(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count() and {by[i].lang_pred for i in (0, 1, 2, 4, 9)} == {"und"} and by[5].lang_pred == "en"
    assert not by[None].held_out
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and not {0, 1, 2, 4, 9} & {r.doc_id for r in kept.collect()}
    assert langid.identify(no_docs).count() == 0 and langid.keep_identified(no_docs).count() == 0
    nothing = langid.identify(odd_docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# -------------------------------------------------------------- decontamination

def brute_hits(docs, items):
    out = set()
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t in items}
    for doc, text in docs:
        d = re.findall(r"\w+", (text or "").lower())
        for i, w in toks.items():
            n = min(13, len(w))
            if not w or len(w) < 8 and d != w:
                continue
            if any(sum(x == y for x, y in zip(d[p:p + n], w[q:q + n])) >= n - decontaminate.tolerance(n)
                   for q in range(len(w) - n + 1) for p in range(len(d) - n + 1)):
                out.add((doc, min(j for j, v in toks.items() if v == w)))
    return out


def test_spaced_seeds_match_brute_force(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice([13, 20, 40]))) for i in range(20)]
    docs = [(i, sentence(rng, 60)) for i in range(30)]
    for i, t in items:
        for subs in range(4):
            w = t.split()
            w = w[:13] if i % 2 else w
            for p in rng.sample(range(len(w)), subs):
                w[p] = "other"
            docs.append((100 + 10 * i + subs, sentence(rng, 9) + " " + ", ".join(w) + "\n" + sentence(rng, 5)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_hits(docs, items)


def test_masks_meet_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(not {a, b} & {o + m for m in mask} for mask in decontaminate.MASKS for o in range(13 - max(mask)))


def test_short_items_with_a_substitution_anywhere(spark):
    rng = random.Random(16)
    items = [(n, sentence(rng, n)) for n in range(1, 14)]
    docs = [(100 * n, t) for n, t in items]
    for n, t in items:
        for p in range(n):
            w = t.split()
            w[p] = "other"
            docs.append((100 * n + p + 1, " ".join(w)))
            docs.append((100 * n + p + 21, sentence(rng, 9) + " " + ", ".join(w) + "\n" + sentence(rng, 5)))
            w[(p + 3) % n] = "second"
            docs.append((100 * n + p + 41, sentence(rng, 3) + " " + " ".join(w)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_hits(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {(100 * n + p + 21, n) for n in range(8, 14) for p in range(n)} <= want


def test_odd_decontamination(spark, odd_docs, no_docs):
    items = [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "!!!"), (None, "one two three four five six seven eight")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as words")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, bench).collect()} == {(3, 3)}
    kept = decontaminate.without_benchmark(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.where("false")).count() == 0


# --------------------------------------------------------------------- toxicity

def swaps(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(0)
    words = []
    for _ in range(1500):
        w = list(rng.choice(toxicity.INSULTS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], ["a"], [w[i], "x"], [w[i], w[i]]]) or ["q"]
        words.append("".join(w))
    joined = " ".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lens = np.array([len(w) for w in words])
    ends = np.cumsum(lens + 1) - 1
    a = toxicity.Automaton(sorted(toxicity.INSULTS), [])
    hit, state = a.run(a.classes[codes], ends - lens, ends)
    got = dict(zip(hit.tolist(), a.errors[state].tolist()))
    for i, w in enumerate(words):
        near = [swaps(w, t) for t in toxicity.INSULTS if swaps(w, t) <= toxicity.allowed_errors(t)]
        assert got.get(i) == (min(near) if near else None)


def test_context_and_spelling():
    scan = toxicity.Scanner(toxicity.Automaton(sorted(toxicity.INSULTS), []))
    at = {n: i for i, n in enumerate(toxicity.COUNTS)}
    sums, words = scan(["you are an idiot", "you are an id1ot and stup!d", 'he said "idiot" was the word', "clean text", None, "st*pid."])
    assert sums[:, at["exact"]].tolist() == [1, 0, 1, 0, 0, 0] and sums[:, at["fuzzy"]].tolist() == [0, 2, 0, 0, 0, 1]
    assert sums[0, at["abuse"]] > 1 > sums[2, at["abuse"]] and sums[2, at["quoted"]] == 1 and words.tolist()[3:5] == [2, 0]


def test_toxicity_held_out(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_odd_toxicity(odd_docs, no_docs, some_labels):
    got = toxicity.toxicity(odd_docs, some_labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    plain = toxicity.toxicity(odd_docs, some_labels.where("false")).collect()
    assert {r.score for r in plain} == {0.0}
    assert toxicity.toxicity(no_docs, some_labels).count() == 0


# ---------------------------------------------------------------------- quality

def test_rules_are_tree_paths():
    text = """GBTClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 1.0
     Else (feature 1 > 2.0)
      Predict: -1.0
    Else (feature 3 > 0.5)
     Predict: 0.0"""
    assert quality.tree_rules(text) == sorted([((3, True, 0.5),), ((3, False, 0.5),), ((1, True, 2.0), (3, True, 0.5)), ((1, False, 2.0), (3, True, 0.5))])


def test_statistics(spark):
    rows = [(1, "Aa aa aa. 12\nB| c"), (2, None), (3, "")]
    got = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert round(np.expm1(got[1].words)) == 6 and got[1].distinct == 1.0 and got[1].symbols == 1 / 17 and round(np.expm1(got[1].lines)) == 2
    assert got[2][1:] == got[3][1:]


def test_quality_held_out(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = quality.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_odd_quality(odd_docs, no_docs, some_labels):
    got = quality.quality(odd_docs, some_labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(odd_docs, some_labels.where("false")).collect()} == {0.5}
    assert quality.quality(no_docs, some_labels).count() == 0


