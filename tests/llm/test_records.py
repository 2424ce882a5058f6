"""WARC, chat formatting, mixing, the pipeline and the entry without this package."""

import hashlib
import math
import os
import subprocess
import sys
from collections import defaultdict

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from check import TABLES, compare  # noqa: E402
from colscope.llm import chat, mixing, queries, warc  # noqa: E402
from colscope.llm.common import read_table  # noqa: E402

from .conftest import DOC_SCHEMA  # noqa: E402

PAYLOADS = ["a\r\nb\r\n", "\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\nx", "", "x" * 5000, "\r\n" * 700, "é\r\n" * 500, "x" * 5000, "\n\n", "\r", "\r\r\n\r",
            "HTTP/1.1\r\n\r\n\r\n", None]


@pytest.mark.parametrize("segment", [7, 1000, 1 << 20])
def test_archives_round_trip(spark, segment):
    rows = [(i, "http://u\r\n/", h) for i, h in enumerate(PAYLOADS)] + [(None, None, "x" * 5000), (100, "u", "q" * 1500), (101, "u", "q" * 1500), (102, "u", "q" * 999), (103, "u", "q" * 999)]
    got = {r.page_id: r for r in warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=segment).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].digest_ok) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 8, None: 8, 100: 101}


def test_chunks_carry_the_payload(spark):
    html = "<p>" + "0123456789" * 1000 + "\r\n tail"
    path = warc.scratch_path(spark, "t")
    warc.write_archives(warc.plan_records(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")), path, segment=512)
    chunks = sorted(warc.read_archives(spark, path).collect(), key=lambda r: r.chunk)
    assert b"".join(bytes(r.payload) for r in chunks) == html.encode() and len(chunks) > 19 and max(r.chunk_bytes for r in chunks) <= 512
    assert [r.offset for r in chunks] == [sum(c.chunk_bytes for c in chunks[:i]) for i in range(len(chunks))] and chunks[-1].sha1 == hashlib.sha1(html.encode()).hexdigest()
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------------- chat

CHATS = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "\\</s>[INST] x\\\\[/INST]\\"), (2, 1, "assistant", None), (2, 0, None, "<s>" * 3), (3, None, "user", ""),
         (3, 0, "assistant", "é" * 1000 + "<<SYS>>"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "odd role\n</s>", "t"), (4, 5, "assistant", "\n\n")]


def test_conversations_read_back(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as message", "'x' as seq")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    convs = defaultdict(list)
    for c, t, r, x in CHATS:
        convs[c].append((t is not None, t, r or "", x or ""))
    assert len(got) == len(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        lost = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(lost))
        assert got[c].loss_sha256 == hashlib.sha256(lost.encode()).hexdigest() and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 0, 0, 2, "delta", "user", "b"), (1, 0, 0, 1, "delta", "user", "a"), (1, 0, 0, 3, "edit", "user", "C"), (1, 0, 0, 4, "delta", "user", "d"),
           (1, 1, 0, 1, "delta", "assistant", "draft"), (1, 1, 0, 2, "regenerate", "assistant", "x"), (1, 1, 0, 3, "delta", "assistant", None), (1, 1, 0, 4, "delta", "assistant", "z")]
    got = chat.fold_messages(spark.createDataFrame(log, "conv_id long, turn long, message long, seq int, kind string, role string, text string"))
    assert {(r.turn, r.text) for r in got.collect()} == {(0, "Cd"), (1, "z")}


# ----------------------------------------------------------------------- mixing

def test_mix_reaches_entropy_and_quotas(spark):
    rows = [(i, "word " * (5 + i % 40), None, f"s{max(0, i % 40 - 30)}" if i % 50 else None, 0, 0.0, "", "", 0, "") for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC_SCHEMA), block_tokens=500, entropy=0.98, repeats=12.0).collect()
    total = sum(5 + i % 40 for i in range(3000))
    mixed, own = defaultdict(int), defaultdict(int)
    for i, _, _, s, *_ in rows:
        own[s] += 5 + i % 40
    for r in out:
        mixed[r.source] += r.tokens
    assert set(mixed) == set(own) and abs(sum(mixed.values()) - total) < 45 * len(own)
    share = [v / sum(mixed.values()) for v in mixed.values()]
    assert -sum(p * math.log(p) for p in share) >= 0.975 * math.log(len(own))
    assert all(mixed[s] <= 12.0 * own[s] + 45 for s in own)
    seen = defaultdict(set)
    for r in out:
        seen[r.source].add((r.doc_id, r["pass"]))
    assert sum(map(len, seen.values())) == len(out)
    for s in own:  # every pass but the last is whole
        passes = {p for _, p in seen[s]}
        n = sum(1 for x in rows if x[3] == s)
        assert all(sum(1 for _, p in seen[s] if p == q) == n for q in passes - {max(passes)})


def test_repetition_limit_wins(spark):
    rows = [(i, "w " * (1000 if i < 10 else 1), None, "big" if i < 10 else f"small{i}", 0, 0.0, "", "", 0, "") for i in range(20)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC_SCHEMA), entropy=1.0, repeats=2.0, block_tokens=300).collect()
    assert max(r["pass"] for r in out) <= 2


def test_odd_mix(odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert {r.doc_id for r in got} <= {None, 3, 4, 5, 6, 7, 8, 9, 90} and {r.source for r in got} <= {None, "s0", "s1"}
    assert mixing.mix_sources(no_docs).count() == 0


# --------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, sf, odd_docs):
    docs = read_table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        if i < 4:
            assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_documents(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    if got["refers_to"].isna().all() if "refers_to" in got else False:
        got, want = got.drop(columns="refers_to"), want.drop(columns="refers_to")
    assert compare(got, want) == ""


def test_entry_without_this_package():
    code = ("import sys; sys.modules['colscope.llm'] = None; import __spark_entry__ as e;"
            "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
