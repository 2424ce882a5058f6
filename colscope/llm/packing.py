"""Packing of tokenised documents into fixed-length sequences by minimum bin slack.

There are only as many different piece lengths as a sequence has tokens, so the packing
is planned on their histogram. Each bin takes the longest piece left; a bitset
subset-sum program over the lengths left (as often as they are left) then finds the
fullest combination with it, which is removed. The same combination is the best one
until one of its lengths runs short, so equal bins are planned at once. Spark then gives
every piece its rank among the pieces of its length, and the rank its place in the plan.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colscope.session import materialize

LIMIT, END = 1024, 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
PART = 1 << 20
# No token of this vocabulary holds a letter before another character, so the ids of a text cut there
# are those of its parts. The bar is left out, as it stands within the special token.
CUT = re.compile(r"(?<=[A-Za-z])(?=[\x00-\x40\x5b-\x60\x7b\x7d-\x7f])|(?<=[^\W\d_])(?=[ \n])")


@functools.cache
def _load(vocabulary: str, ranks: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Tokenizer.from_file(vocabulary), tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def text_ids(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """Ids of the vocabulary (``tokenizers``, without added special tokens), about ``PART`` characters at a time.

    Texts without the special token's string go through ``tiktoken``, which gives the same
    ids from the same vocabulary in a third of the time.
    """
    exact, quick = _load(vocabulary, ranks)
    out, at = [np.zeros(0, np.uint32)], 0
    while at < len(text):
        cut = CUT.search(text, at + PART) if len(text) - at > 2 * PART else None
        part = text[at:cut.start()] if cut else text[at:]
        ids = exact.encode(part, add_special_tokens=False).ids if SPECIAL in part else quick.encode_ordinary(part)
        out.append(np.array(ids, np.uint32))
        at += len(part)
    return np.concatenate(out)


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, with the place of the piece: ``part``, ``nth``.

    A document is its ids and then ``END``; only one longer than ``limit`` is cut, so that
    all its pieces but the first are full. ``nth`` counts the pieces of that length in
    their task ``part``. ``ids`` (little-endian 32-bit ids) is there if asked for.
    """
    vocabulary, ranks = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        rows, held = [], []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + ([pa.array(held, pa.binary())] if with_ids else [])
            rows.clear(), held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(text_ids(text.as_py() or "", vocabulary, ranks), np.uint32(END)).astype("<u4")
                start, end = 0, (len(ids) - 1) % limit + 1
                for piece in range(-(-len(ids) // limit)):
                    raw = ids[start:end].tobytes()
                    rows.append((doc, piece, start, end - start, zlib.crc32(raw), part, int(seen[end - start])))
                    seen[end - start] += 1
                    if with_ids:
                        held.append(raw)
                    start, end = end, end + limit
                    if len(rows) >= 4096:
                        yield emit()
        if rows:
            yield emit()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fullest(left: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """The fullest bin with the longest length left: ``(length, times)``, long ones first.

    ``left`` counts the pieces by length. Bit s of a set says that lengths tried so far
    add up to s; of equally full bins the one with longer pieces is read back.
    """
    lengths = np.flatnonzero(left)[::-1].tolist()
    room, goal = limit - lengths[0], 1 << (limit - lengths[0])
    mask, reach, tried = (goal << 1) - 1, 1, []
    for n in lengths:
        times = min(int(left[n]) - (n == lengths[0]), room // n)
        if times > 0 and not reach & goal:
            tried.append((n, times, reach))
            have, step = times, 1
            while have:  # 1, 2, 4, ... pieces at once reach every number of them
                step = min(step, have)
                reach |= (reach << step * n) & mask
                have, step = have - step, step * 2
    total = reach.bit_length() - 1
    taken = {lengths[0]: 1}
    for n, times, before in reversed(tried):
        k = next(k for k in range(times + 1) if total >= k * n and before >> (total - k * n) & 1)
        if k:
            taken[n] = taken.get(n, 0) + k
            total -= k * n
    return sorted(taken.items(), reverse=True)


def plan(counts: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Rows ``length, first rank, pieces a bin, offset, first bin`` that place all ``counts[length]`` pieces, and the number of bins.

    The number of rows depends on ``limit`` and not on the counts: each step uses up what
    a length has left for the combination.
    """
    left, used, rows, bins = counts.astype(np.int64), np.zeros(limit + 1, np.int64), [], 0
    while left.any():
        combination, at = fullest(left, limit), 0
        repeat = min(int(left[n]) // k for n, k in combination)
        for n, k in combination:
            rows.append((n, int(used[n]), k, at, bins))
            used[n] += repeat * k
            left[n] -= repeat * k
            at += n * k
        bins += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` (from 0) and ``offset``; see ``pieces``.

    A NULL or empty text is its ``END`` alone. Rows of one doc_id, equal or not, and rows
    without one are documents of their own. Ties are broken by the place of the rows in the
    table. An empty table gives no rows. Other columns are ignored. With ``with_ids`` the
    pieces' ids come along (see ``sequences``).
    """
    cut = materialize(pieces(docs, limit, vocabulary, ranks, with_ids), "pack-pieces")
    here = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    here = materialize(here.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "pack-counts")
    counts = np.zeros(limit + 1, np.int64)
    for n, k in here.groupBy("length").agg(F.sum("n")).collect():  # a row per length: ``limit`` at most
        counts[n] = k
    rows, _ = plan(counts, limit)
    keys = (rows[:, 0] << 48) + rows[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            _, first, times, at, bin_ = rows[np.searchsorted(keys, (n << 48) + rank, side="right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(bin_ + (rank - first) // times), pa.array(at + (rank - first) % times * n)],
                names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    ranked = cut.join(here.select("part", "length", "before"), ["part", "length"])
    return ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``ids`` (little-endian 32-bit) and ``offsets`` of the pieces: what a trainer reads."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("offsets"))
