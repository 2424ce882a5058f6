"""Benchmark decontamination by spaced seeds.

A seed hashes six of eight words in a row; the words its mask leaves out may differ.
The two masks together meet every window of 13 words with up to two substitutions, and
every item of 10 to 12 words with one. Items of 8 and 9 words have their first and their
last four words as seeds, of which one substitution leaves one. Seeds of the corpus are joined with those of the benchmark, and around each hit the aligned
words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .common import member_words, membership
from .words import WordHashes, mix

MASKS = ((0, 1, 4, 5, 6, 7), (0, 1, 2, 4, 6, 7))
ENDS, ENDS_OF = (0, 1, 2, 3), (8, 9)
WINDOW = 13
LEAST = 8
REGION = "doc_id long, start long, doc_words long, words array<long>, seeds array<struct<key:long,at:int>>"


def _mask_keys(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Key at each place where the mask fits."""
    n = max(0, len(hashes) - max(mask))
    key = np.full(n, np.uint64(number * 0x632BE5AB + 1))
    for at in mask:
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[at:at + n]
    return mix(key)


def _masks(short: list[int]) -> list[tuple[int, ...]]:
    """The fixed masks, the one for the ends of short items, and a full one for each length below ``LEAST``."""
    return [*MASKS, *([ENDS] if set(short) & set(ENDS_OF) else []), *(tuple(range(n)) for n in short if n < LEAST)]


def _seeds_of(hashes: np.ndarray, masks: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of an item's seeds and their places."""
    n, keys, places = len(hashes), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for number, mask in enumerate(masks):
        key = _mask_keys(hashes, mask, number)
        if mask in MASKS:
            at = np.arange(len(key))
        elif n in ENDS_OF and mask == ENDS:
            at = np.array([0, n - len(ENDS)])
        else:
            at = np.arange(int(n < LEAST and len(mask) == n))
        keys.append(key[at]), places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def tolerance(words: int) -> int:
    """Substitutions allowed in a window of so many words."""
    return 2 * words // WINDOW if words >= LEAST else 0


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id`` (the smallest of items with equal words) and ``words``; items without words go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for b in batches:
            words, n = hashed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(words.view(np.int64)))], names=["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words array<long>")
    return items.where("size(words) > 0").groupBy("words").agg(F.min("item_id").alias("item_id"))


def _item_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column("item_id").to_pylist(), b.column("words")):
                key, at = _seeds_of(words.values.to_numpy().view(np.uint64), masks)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), item), pa.int64()), pa.array(at, pa.int32()), pa.array(np.full(len(at), len(words.values)), pa.int32())],
                                                 names=["key", "item_id", "item_at", "item_n"])

    return items.select("item_id", "words").mapInArrow(run, "key long, item_id long, item_at int, item_n int")


def _regions(docs: DataFrame, masks: list[tuple[int, ...]], filter_words: np.ndarray) -> DataFrame:
    """Stretches of documents around possible seeds, with their words."""
    longest = max(len(m) and max(m) + 1 for m in masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                words, n = hashed(b.column(1).to_pylist())
                ends = np.cumsum(n)
                owner = np.repeat(np.arange(len(n)), n)
                places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for k, mask in enumerate(masks):
                    key = _mask_keys(words, mask, k)
                    hit = np.flatnonzero(membership(filter_words, key))
                    hit = hit[owner[hit] == owner[hit + max(mask)]]
                    places.append(hit), keys.append(key[hit])
                places, keys = np.concatenate(places), np.concatenate(keys)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, keys = places[order], keys[order]
                cuts = np.flatnonzero((np.diff(places) > 2 * WINDOW + longest) | (np.diff(owner[places]) != 0)) + 1
                cols: list[list] = [[], [], [], [], []]
                for p, q in zip(np.split(places, cuts), np.split(keys, cuts)):
                    doc = owner[p[0]]
                    begin = ends[doc] - n[doc]
                    s, e = max(begin, p[0] - 2 * WINDOW), min(ends[doc], p[-1] + longest + 2 * WINDOW)
                    row = (b.column(0)[int(doc)].as_py(), int(s - begin), int(n[doc]), words[s:e].view(np.int64),
                           [{"key": int(x), "at": int(y)} for x, y in zip(q.view(np.int64), p - s)])
                    for c, v in zip(cols, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())])))],
                    names=["doc_id", "start", "doc_words", "words", "seeds"])

    return docs.mapInArrow(run, REGION)


def aligned(doc: np.ndarray, item: np.ndarray, shift: int, start: int, doc_words: int) -> tuple[int, int, int] | None:
    """Best window, all equal words and first place, of an item laid over a stretch; None if no overlap counts."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    if hi - lo < window or window < LEAST and not (start == 0 and doc_words == len(item)):
        return None
    same = (doc[lo + shift:hi + shift] == item[lo:hi]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    rolled = sums[window:] - sums[:-window]
    best = int(rolled.max())
    if best < window - tolerance(window):
        return None
    return best, int(same.sum()), int(start + lo + shift + int(rolled.argmax()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        docs, items = b.column("words"), b.column("item_words")
        for i, (doc, item, shift, start, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "shift", "start", "doc_words")))):
            words = items[i].values.to_numpy()
            got = aligned(docs[i].values.to_numpy(), words, shift, start, n)
            if got:
                for c, v in zip(out, (doc, item, got[0], got[1], len(words), got[2])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "window_matches", "matches", "item_words", "doc_at"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold benchmark passages: a row per document and item.

    A document holds an item if, at some alignment without gaps, a window of 13 words has
    11 or more in common. Items of 8 to 12 words must stand whole with one substitution at
    most, shorter ones must be the whole document. Words are lower-cased runs of letters
    and digits. ``window_matches`` and ``matches`` count equal words in the best window
    and over the alignment, ``doc_at`` is the window's first word. Items with equal words
    are reported under the smallest id. NULL and wordless texts never match; documents
    without an id are reported under NULL; a repeated document gives one row. Empty
    tables give no rows. Other columns are ignored.
    """
    items = materialize(benchmark_items(benchmark), "bench-items")
    short = [r.n for r in items.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().orderBy("n").collect()]
    masks = _masks(short)
    seeds = materialize(_item_seeds(items, masks).distinct(), "bench-seeds")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    regions = _regions(docs, masks, member_words(seeds, "key")).withColumn("region", F.monotonically_increasing_id())
    regions = materialize(regions, "bench-regions")
    hits = regions.select("region", F.explode("seeds").alias("seed")).select("region", F.col("seed.key").alias("key"), F.col("seed.at").alias("at"))
    pairs = hits.join(seeds, "key").select("region", "item_id", "item_n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    # Only the words under the item go on, however long the stretch around them.
    ahead, behind = F.greatest("shift", F.lit(0)), F.least("shift", F.lit(0))
    laid = (pairs.join(regions.drop("seeds"), "region")
            .select("doc_id", "item_id", behind.alias("shift"), (F.col("start") + ahead).alias("start"), "doc_words",
                    F.slice("words", ahead + 1, F.col("item_n") + behind).alias("words"))
            .join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
            .select("doc_id", "item_id", "shift", "start", "doc_words", "words", "item_words"))
    found = laid.mapInArrow(_verify, "doc_id long, item_id long, window_matches long, matches long, item_words long, doc_at long")
    best = F.max(F.struct("matches", "window_matches", (-F.col("doc_at")).alias("before"), "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.window_matches").alias("window_matches"), F.col("b.matches").alias("matches"),
        F.col("b.item_words").alias("item_words"), (-F.col("b.before")).alias("doc_at"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark passage, all columns; those without an id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
