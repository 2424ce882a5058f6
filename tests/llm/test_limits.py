"""Thresholds, caps and cuts: cases just beyond a bound, and scores against a plain walk."""

import math
import random
import re

import numpy as np

from colscope.llm import common, decontaminate, langid, mixing, nndescent, quality, simhash, toxicity
from colscope.llm.common import member_words, membership, read_table

from .conftest import sentence


def test_no_link_just_below_the_threshold(spark):
    def at(cosine):
        return [1.0, 0.0], [cosine, math.sqrt(1 - cosine * cosine)]

    rows = [(i, 1, v) for i, v in enumerate(at(0.92999999997))] + [(i + 10, 2, v) for i, v in enumerate(at(0.93000000003))]
    got = {r.vec_id: r.n_links for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {0: 0, 1: 0, 10: 1, 11: 1}
    assert nndescent.ranked_similarity(np.array([0.92999999997, 0.93, 0.5]), 0.93).tolist() == [np.nextafter(0.93, 0), 0.93, 0.5]


def test_audit_asks_every_fiftieth_id(spark):
    rows = [(3, 1, [1.0, 2.0]), (50, 1, [1.0, 2.0]), (7, 1, [2.0, 1.0])]
    nodes = nndescent.distinct_vectors(spark.createDataFrame(rows, "vec_id long, label int, vec array<double>")).collect()
    assert {r["first"]: r.audited for r in nodes} == {3: True, 7: False}


def test_many_letters_and_short_and_long_terms(spark):
    letters = [chr(0x4E00 + i) for i in range(300)]
    terms = ["".join(letters[i:i + 4]) for i in range(0, 300, 4)]
    scan = toxicity.Scanner(toxicity.Automaton(terms, []))
    other = "".join(chr(0x6000 + i) for i in range(4))
    assert scan([other, terms[-1], other + terms[-1]])[0][:, 0].tolist() == [0, 1, 0]
    rng = random.Random(2)
    bad = [f"bad{i:03d}{rng.randrange(10**6):06d}" for i in range(90)] + ["zq", "q" * 40]
    rows = [(1 if i % 2 else 0, sentence(rng, 12) + (" " + " ".join(bad) if i % 2 else "")) for i in range(60)]
    whole, stems = toxicity.learned_terms(spark.createDataFrame(rows, "y int, text string"))
    assert set(bad) <= set(whole) and all(any(b.startswith(s) for s in stems) for b in bad if len(b) > 3)


def test_toxicity_scores_follow_summed_hits(spark, sf):
    """Sums of hits against a plain scan of the words, with the distance from every term."""
    docs = read_table(spark, sf, "documents").where("doc_id < 120")
    terms = sorted(toxicity.INSULTS)
    got = {r.doc_id: r for r in toxicity.hit_sums(docs, terms, ["zzzz"]).collect()}

    def distance(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
        return table[-1][-1]

    known: dict[str, int | None] = {}
    for d in docs.collect():
        exact = fuzzy = 0
        for w in re.findall(r"[^\W_]+(?:[@$*!][^\W_]+)*", (d.text or "").lower()):
            if w not in known:
                known[w] = min((e for t in terms if abs(len(t) - len(w)) <= 2 and (e := distance(w, t)) <= toxicity.allowed_errors(t)), default=None)
            exact, fuzzy = exact + (known[w] == 0), fuzzy + (known[w] is not None and known[w] > 0)
        assert (got[d.doc_id].exact, got[d.doc_id].fuzzy) == (exact, fuzzy)


def test_rules_scored_as_a_plain_walk(spark, sf):
    train = quality.statistics(read_table(spark, sf, "documents")).join(read_table(spark, sf, "labels").select("doc_id", quality.F.col("quality").alias("y")), "doc_id").where("y is not null").cache()
    rules, intercept = quality.fit_rules(train)
    assert rules
    for r in train.select("*", quality.compile_score(rules, intercept).alias("score")).collect():
        total = intercept + sum(w for rule, w in rules if all((r[quality.STATISTICS[f]] <= bound) == low for f, low, bound in rule))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_all_rules_are_offered(spark):
    rng = random.Random(9)
    rows = [(*(rng.random() for _ in quality.STATISTICS), rng.randrange(2)) for _ in range(3000)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in quality.STATISTICS) + ", y int")
    rules, _ = quality.fit_rules(train, trees=40, depth=3, penalties=(1e-9,))
    assert len(rules) > 160


def test_statistics_match_plain_python(spark, sf):
    docs = read_table(spark, sf, "documents")
    got = {r.doc_id: r for r in quality.statistics(docs).collect()}
    for d in docs.collect():
        text, r = d.text or "", got[d.doc_id]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        n, lines = max(1, len(words)), text.count("\n") + 1
        want = {"chars": math.log1p(len(text)), "words": math.log1p(len(words)), "word_chars": sum(map(len, words)) / n, "distinct": len(set(words)) / n,
                "repeated": sum(a == b for a, b in zip(words, words[1:])) / n, "digits": sum(c in "0123456789" for c in text) / max(1, len(text)),
                "symbols": sum(c in quality.SYMBOLS for c in text) / max(1, len(text)), "capitals": sum("A" <= c <= "Z" for c in text) / max(1, len(text)),
                "stops": sum(c in ".,;:?" for c in text) / n, "lines": math.log1p(lines), "line_chars": len(text) / lines, "no_space": sum(len(w) > 20 for w in words) / n}
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items())


def test_language_profile_is_a_sum_of_bound_letters():
    """A document's vector against trigrams bound one by one."""
    text = "Hello, wörld!  42 two\nthree"
    dim = 64
    profiles = langid.Profiles(dim)
    letters = [" "]
    for c in text.lower() + " ":
        if c.isalpha() or letters[-1] != " ":
            letters.append(c if c.isalpha() else " ")
    want = np.zeros(dim)
    for trio in zip(letters, letters[1:], letters[2:]):
        a, b, c = (profiles._letter(0 if x == " " else ord(x)).astype(int) for x in trio)
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert profiles([text])[0][0].tolist() == want.tolist()


def test_language_pieces_lose_no_trigram(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "é", " ", "  ", "...", "\n12 ", "zz"]) for _ in range(rng.randrange(1, 60)))
        monkeypatch.setattr(langid, "PIECE", 10**6)
        whole, _ = langid.Profiles(32)([text])
        monkeypatch.setattr(langid, "PIECE", rng.randrange(1, 9))
        parts, _ = langid.Profiles(32)([text])
        assert (whole == parts).all()


def test_rows_without_id_spread_over_blocks(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text number ', id) as text", "'s' as source")
    out = mixing.mix_sources(docs, block_tokens=60)
    assert out.count() == 4000 and out.select("block").distinct().count() > 150


def test_shards_follow_the_fingerprints(spark):
    rng = np.random.default_rng(4)
    fps = rng.integers(-2**63, 2**63 - 1, 6000)
    near = fps[:300] ^ (np.int64(1) << rng.integers(0, 63, 300))
    df = spark.createDataFrame([(0, int(x)) for x in np.unique(np.concatenate([fps, near]))], "t long, fp long")
    links = simhash.hamming_links(df, 2, sample=64, per_shard=40)
    got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    assert {tuple(sorted((int(a), int(b)))) for a, b in zip(fps[:300], near)} <= got


def test_components_both_ways(spark, monkeypatch):
    """A hub, a chain and a pair, with the minima written before the joins and without."""
    edges = [(0, i) for i in range(10, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 4000)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: 0 for n in (0, *range(10, 400))} | {n: 1000 for n in range(1000, 1061)} | {5000: 4000, 4000: 4000}
    for few in (0, 1_000_000):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert {r.node: r.component for r in common.connected_components(df, "t").collect()} == want


def test_filter_grows_with_its_rows(spark):
    rows = spark.range(3_000_000).selectExpr("xxhash64(id) as h")
    words = member_words(rows, "h")
    some = np.array([r.h for r in rows.limit(1000).collect()])
    assert len(words) * 64 >= 16 * 3_000_000 and membership(words, some).all()
    assert membership(words, np.random.default_rng(1).integers(-2**63, 2**63 - 1, 100_000)).mean() < 0.1


def test_a_document_that_quotes_the_whole_benchmark(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(5, 60))) for i in range(120)]
    docs = [(1, " ".join(t for _, t in items)), (2, sentence(rng, 500)), (3, items[7][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    least = {i for i, t in items if len(t.split()) >= 8}
    assert {r.item_id for r in got if r.doc_id == 1} == least and 2 not in {r.doc_id for r in got} and 7 in {r.item_id for r in got if r.doc_id == 3}
    starts = np.cumsum([0] + [len(t.split()) for _, t in items])
    assert all(r.matches == r.item_words for r in got if r.doc_id == 1)
    assert all(starts[r.item_id] <= r.doc_at < starts[r.item_id + 1] for r in got if r.doc_id == 1)
