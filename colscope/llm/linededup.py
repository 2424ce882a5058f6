"""Line deduplication within an edit distance, by a segment-partition join.

Equal lines collapse on a 128-bit hash. Of a line pair within ``edits`` edits, some of
the ``edits + 1`` even segments of the shorter line stands unchanged in the longer one,
at a place that its index and the length difference bound. Segments and the few
substrings that may equal one become 64-bit keys; keys met by two lines give
candidates. Keys met by the same lines count once. A key's lines are compared in blocks:
letter pairs that differ too much settle most candidates, the others go through a banded
bit-parallel edit distance for many pairs at once, unless they are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .common import connected_components, key_runs, membership, member_words, per_run
from .words import BASE, PIECE, mix, powers

GROUP = 512
PAIRS = 4096
SMALL = 16
HOT, SALTS = 64, 64
SIGNATURE = 512


def split_lines(text: str | None) -> list[str]:
    return [x.strip() for x in text.split("\n")] if text else []


def line_hashes(line: str) -> tuple[int, int]:
    """XXH64 of the line with seed 42, and again with that value as the seed."""
    raw = line.encode("utf-8", "surrogatepass")
    first = xxhash.xxh64_intdigest(raw, 42)
    return first, xxhash.xxh64_intdigest(raw, first)


class SegmentKeys:
    """Keys of lines: own segments, and substrings that may be a segment of a line shorter by up to ``edits``."""

    def __init__(self, edits: int):
        self.edits = edits
        self.letters = mix(np.arange(0x110000, dtype=np.uint64) + BASE)
        self._grow(PIECE + 1)

    def _grow(self, n: int) -> None:
        self.powers, self.inverses = powers(BASE, n), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Line numbers and keys; a line's equal keys may repeat."""
        lens = np.fromiter(map(len, lines), np.int64, len(lines))
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) >= len(self.powers):
            self._grow(2 * len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.letters[codes] * self.powers[:len(codes)], out=sums[1:])
        ends = np.cumsum(lens)
        starts, t = ends - lens, self.edits
        numbers, keys = [], []
        for less in range(t + 1):
            size = lens - less
            short, extra = size // (t + 1), size % (t + 1)
            for i in range(t + 1):
                longer = np.maximum(0, i - (t + 1 - extra))
                at, width = short * i + longer, short + (i >= t + 1 - extra)
                for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                    s = starts + at + shift
                    ok = np.flatnonzero((at + shift >= 0) & (at + shift + width <= lens) & (short > 0))
                    s, w = s[ok], width[ok]
                    value = (sums[s + w] - sums[s]) * self.inverses[s]
                    numbers.append(ok)
                    keys.append(mix(value ^ (size[ok].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i * 0x5851F42D))))
        return np.concatenate(numbers), np.concatenate(keys)


class Lines:
    """Code points of many lines in one array."""

    def __init__(self, lines: list[str]):
        self.lens = np.fromiter(map(len, lines), np.int64, len(lines))
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum(self.lens) - self.lens

    def padded(self, rows: np.ndarray, width: int, front: int, fill: int) -> np.ndarray:
        """Lines as columns of equal height, ``front`` fillers before and ``fill`` behind."""
        at = np.arange(width)[:, None] - front
        inside = (at >= 0) & (at < self.lens[rows])
        return np.where(inside, self.codes[np.where(inside, self.starts[rows] + at, 0)] if len(self.codes) else 0, np.uint32(fill))

    def signatures(self) -> np.ndarray:
        """Which hashed pairs of neighbouring letters a line has, in ``SIGNATURE`` bits: an edit changes four at most."""
        rows = np.repeat(np.arange(len(self.lens)), self.lens)
        bits = np.zeros((len(self.lens), SIGNATURE), bool)
        if len(rows) > 1:
            same = rows[1:] == rows[:-1]
            pair = mix(self.codes[:-1].astype(np.uint64) * BASE + self.codes[1:])
            bits[rows[1:][same], (pair[same] % np.uint64(SIGNATURE)).astype(np.int64)] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    def within(self, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
        """Whether lines ``x`` and ``y`` lie within ``edits``, pair by pair.

        Banded bit-parallel edit distance: bit w of row d says that, with d edits, the first
        j letters of y match the first j - edits + w of x.
        """
        longest = int(max(self.lens[x].max(initial=0), self.lens[y].max(initial=0)))
        step = max(1, min(PAIRS, (1 << 22) // (longest + 1)))
        return np.concatenate([np.zeros(0, bool), *(self._within(x[i:i + step], y[i:i + step], edits) for i in range(0, len(x), step))])

    def _within(self, x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
        more = self.lens[x] - self.lens[y]
        width = int(self.lens[y].max())
        a, b = self.padded(x, width + 2 * edits + 1, edits, 0xFFFFFFFF), self.padded(y, width, 0, 0xFFFFFFFE)
        kind = np.uint8 if edits < 4 else np.uint64
        mask = kind((1 << (2 * edits + 1)) - 1)
        rows = [np.full(len(x), kind((((1 << (d + 1)) - 1) << edits) & int(mask))) for d in range(edits + 1)]
        last = rows[edits].copy()
        for j in range(width):
            same = np.zeros(len(x), kind)
            for w in range(2 * edits + 1):
                same |= (a[j + w] == b[j]).astype(kind) << kind(w)
            before = fresh = None
            for d in range(edits + 1):
                new = rows[d] & same
                if d:
                    new |= (before >> kind(1)) | before | (fresh << kind(1))
                new &= mask
                rows[d], before, fresh = new, rows[d], new
            np.copyto(last, rows[edits], where=self.lens[y] > j)
            if not rows[edits].any():
                last[self.lens[y] > j] = 0
                break
        near = np.abs(more) <= edits
        return near & ((last >> np.where(near, more + edits, 0).astype(kind)) & kind(1) > 0)


def within_edits(a: str, b: str, edits: int) -> bool:
    return bool(Lines([a, b]).within(np.array([0]), np.array([1]), edits)[0])


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row per non-blank line: place, hash, length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, h1, h2 = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for i, line in enumerate(split_lines(text.as_py())):
                    if line:
                        x, y = line_hashes(line)
                        ids.append(doc), pos.append(i), h1.append(x), h2.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()),
                                              *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2))], names=["doc_id", "pos", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, pos int, h1 long, h2 long")


def _keys(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Keys of the lines of ``least`` characters or more; repeats within a task once.

    A key that ``HOT`` lines of one batch meet is spread by line (``salt`` from 1 on). Two
    of its lines also go to salt 0, so that the key counts as shared there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, seen = SegmentKeys(edits), set()

        def emit(lines: list[str], hashes: list[int]) -> pa.RecordBatch:
            number, key = keyed(lines)
            key, h = key.view(np.int64), np.array(hashes, np.uint64).view(np.int64)[number]
            order = np.lexsort((h, key))
            key, h = key[order], h[order]
            fresh = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(h) != 0)])[:len(key)]
            key, h = key[fresh], h[fresh]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])[:len(key)])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            hot = starts[sizes >= HOT]
            salt = np.where(np.repeat(sizes >= HOT, sizes), 1 + h % SALTS, 0)
            seen_by = np.concatenate([hot, hot + 1]).astype(np.int64)
            columns = [np.concatenate([key, key[seen_by]]), np.concatenate([salt, np.zeros(len(seen_by), np.int64)]), np.concatenate([h, h[seen_by]])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "salt", "h1"])

        for b in batches:
            lines, hashes, chars = [], [], 0
            for text in b.column(1):
                for line in split_lines(text.as_py()):
                    if len(line) >= least:
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                        if h not in seen:
                            seen.add(h)
                            lines.append(line), hashes.append(h)
                            chars += len(line)
                            if chars >= PIECE // 2:
                                yield emit(lines, hashes)
                                lines, hashes, chars = [], [], 0
            if lines:
                yield emit(lines, hashes)
            if len(seen) > 200_000:  # only saves repeats; a line may come again
                seen.clear()

    return docs.mapInArrow(run, "key long, salt long, h1 long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys met by two lines, from sorted rows. Only one row is held from batch to
    batch: a key with a single line so far needs no more, one with two passes straight on,
    and so do spread rows."""
    held_key, held_line, open_key = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        key, h, spread = b.column("key").to_numpy(), b.column("h1").to_numpy(), b.column("salt").to_numpy() > 0
        if held_key is not None and key[0] == held_key:
            key, h, spread = np.concatenate([[held_key], key]), np.concatenate([[held_line], h]), np.concatenate([[False], spread])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        many = np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts)
        many |= np.logical_or.reduceat(spread, starts)
        many[0] |= open_key is not None and key[0] == open_key
        open_key = key[-1] if many[-1] else None
        held_key, held_line = (None, None) if many[-1] else (key[-1], h[-1])
        rows = np.repeat(many, np.diff(np.concatenate([starts, [len(key)]])))
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(h[rows])], names=["key", "h1"])


def _lines_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text of the wanted lines (``h1``), once or more; a fixed-size filter goes to the tasks."""
    words = member_words(wanted, "h1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            lines, hashes = [], []
            for text in b.column(1):
                for line in split_lines(text.as_py()):
                    lines.append(line)
                    hashes.append(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) if line else 0)
            h = np.array(hashes, np.uint64).view(np.int64)
            hit = [i for i in np.flatnonzero(membership(words, h)) if hashes[i] not in seen and not seen.add(hashes[i])]
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array([lines[i] for i in hit], pa.string())], names=["h1", "line"])

    return docs.mapInArrow(run, "h1 long, line string").join(wanted, "h1", "left_semi").dropDuplicates(["h1"])


def _roots(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _candidates(table: pa.Table, starts: np.ndarray, lens: np.ndarray, marks: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that length and letter pairs allow; close neighbours in line order first."""
    side, sizes = table.column("side").to_numpy(), np.diff(starts)
    two = np.minimum.reduceat(side, starts[:-1]) != np.maximum.reduceat(side, starts[:-1])

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.abs(lens[x] - lens[y]) <= edits) & (np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1) <= 4 * edits)

    small, row = sizes <= SMALL, np.arange(len(side))
    ends, crossing = (np.repeat(a, sizes) for a in (np.where(small, starts[1:], 0), two))
    for step in range(1, min(SMALL, int(sizes.max()))):
        x = row[row + step < ends]
        x = x[~crossing[x] | (side[x] != side[x + step])]
        x = x[allowed(x, x + step)]
        yield x, x + step
    for k in np.flatnonzero(~small).tolist():
        s, e = int(starts[k]), int(starts[k + 1])
        close = np.abs(lens[s:e, None] - lens[s:e]) <= edits
        apart = np.zeros((e - s, e - s), np.uint16)
        for word in range(marks.shape[1]):
            apart += np.bitwise_count(marks[s:e, word, None] ^ marks[s:e, word])
        close &= apart <= 4 * edits
        if two[k]:
            close &= side[s:e, None] != side[s:e]
        x, y = np.nonzero(np.triu(close, 1))
        order = np.argsort(y - x, kind="stable")
        yield x[order] + s, y[order] + s


def _verified(groups: DataFrame, edits: int) -> DataFrame:
    """Spanning links (``a``, ``b``) of every block's lines that lie within ``edits``.

    ``groups`` has ``part`` (the block, bounded in size), ``side`` (of a block of two sides
    only crossing pairs count), ``h1``, ``known`` (its class so far) and ``line``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, "part"):
            table = table.combine_chunks()
            order = np.lexsort((pc.rank(table.column("line"), tiebreaker="dense").to_numpy(), table.column("part").to_numpy()))
            table = table.take(pa.array(order))
            ids, lines = table.column("h1").to_numpy(), Lines(table.column("line").to_pylist())
            known, root_of = np.unique(table.column("known").to_numpy(), return_inverse=True)
            root, marks, out = np.arange(len(known)), lines.signatures(), []

            def settle(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
                nonlocal root
                x, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                for at in range(0, len(x), PAIRS):
                    root = _roots(root)
                    u, v = x[at:at + PAIRS], y[at:at + PAIRS]
                    apart = root[root_of[u]] != root[root_of[v]]
                    u, v = u[apart], v[apart]
                    near = lines.within(u, v, edits)
                    for i, j in zip(u[near].tolist(), v[near].tolist()):
                        p, q = root_of[i], root_of[j]
                        while root[p] != p:
                            p = root[p]
                        while root[q] != q:
                            q = root[q]
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            out.append((ids[i], ids[j]))

            held, count = [], 0
            for pair in _candidates(table, starts, lines.lens, marks, edits):
                held.append(pair)
                count += len(pair[0])
                if count >= PAIRS:
                    settle(held)
                    held, count = [], 0
            if held:
                settle(held)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return per_run(groups, "part", run, "a long, b long")


def similar_lines(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Spanning links (``a``, ``b``: line hashes) of the distinct lines within ``edits``.

    First every key's blocks are compared inside; where a key has several blocks, lines of
    different ones are then compared unless the links found so far connect them. A key
    whose lines are all connected needs no more.
    """
    keys = _keys(docs, edits, least).repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_shared, "key long, h1 long")
    met = materialize(keys.distinct(), "line-keys")
    text = materialize(_lines_of(docs, met.select("h1").distinct()), "line-texts")
    sets = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h1")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "h1")).alias("s2"))
    kept = materialize(sets.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).where("n > 1")
                       .select("key", F.ceil(F.col("n") / GROUP).alias("parts")), "line-sets")
    dealt = met.join(kept, "key").withColumn("side", F.pmod(F.xxhash64("h1"), F.col("parts")))
    inside = dealt.select(F.xxhash64("key", "side").alias("part"), F.lit(0).cast("long").alias("side"), "h1", F.col("h1").alias("known"))
    links = materialize(_verified(inside.join(text, "h1"), edits), "line-links")
    wide = materialize(dealt.where("parts > 1"), "line-wide")
    if wide.isEmpty():
        return links
    classes = materialize(connected_components(links, "line-inner").withColumnRenamed("node", "h1"), "line-classes")
    wide = materialize(wide.join(classes, "h1", "left").withColumn("known", F.coalesce("component", "h1")), "line-known")
    open_ = materialize(wide.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("key"), "line-open")
    across = (wide.join(open_, "key").select("key", "h1", "known", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
              .where("side <> other"))
    across = across.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("part"), "side", "h1", "known")
    return links.unionByName(_verified(across.join(text, "h1"), edits))


def removed_lines(docs: DataFrame, edits: int = 2, least: int = 30) -> DataFrame:
    """``doc_id`` and ``removed``, the places of its lines that stand earlier in the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    places = materialize(_occurrences(docs), "line-places")
    classes = connected_components(similar_lines(docs, edits, least), "lines")
    named = places.join(classes.withColumnRenamed("node", "h1"), "h1", "left").select(
        "doc_id", "pos", F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).alias("c2"))
    named = named.withColumn("c2", F.coalesce("c2", F.lit(0)))
    first = (named.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
             .where("n > 1"))
    # Written, so that both sides of the join are plain shuffles: Spark splits a class of very many lines.
    first = materialize(first, "line-firsts")
    return (named.join(first, ["c1", "c2"]).where("doc_id <> first.doc_id or pos <> first.pos")
            .groupBy("doc_id").agg(F.collect_set("pos").alias("removed")))


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 30) -> DataFrame:
    """All columns of ``docs`` plus ``n_lines`` and ``n_removed``, ``text`` without repeated lines.

    Lines are compared without the white space around them. Lines of ``least`` characters
    or more are the same within ``edits`` edits (and through chains of such lines),
    shorter ones only when equal. Of each class the first line stays, by doc_id and place;
    blank lines always stay. NULL texts stay NULL with 0 lines, documents without an id
    are returned unchanged, and rows of one id count as one document. An empty table gives
    no rows. A document's own columns ``n_lines`` and ``n_removed`` are replaced.
    """
    rows = docs.drop("n_lines", "n_removed")
    gone = removed_lines(docs, edits, least).select(F.col("doc_id").alias("id"), "removed")
    lines = F.split("row.text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    return (rows.select(F.struct(*rows.columns).alias("row")).join(gone, F.col("row.doc_id") == F.col("id"), "left")
            .select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in rows.columns], count(lines).alias("n_lines"), count(F.col("removed")).alias("n_removed")))


def clean_lines(docs: DataFrame, edits: int = 2, least: int = 30) -> DataFrame:
    """``docs`` with repeated lines taken out, same columns; ``n_chars`` follows the text.

    A document of which only white space is left was a copy line by line and goes; one
    that was blank before stays.
    """
    out = dedup_lines(docs.drop("n_lines", "n_removed"), edits, least).where("n_removed = 0 or length(trim(both ' \t\n\r' from text)) > 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, pos, lines[pos] AS raw, regexp_replace(lines[pos], '^\s+|\s+$', '', 'g') AS line
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
u AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM x WHERE line <> '')),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN (SELECT u.*, unnest(range(-2, 3)) AS s FROM u) b ON a.n = b.n + b.s AND a.id <> b.id
      WHERE least(a.n, b.n) >= 30 AND levenshtein(a.line, b.line) <= 2),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT u.line, least(u.id, coalesce(min(r.b), u.id)) AS class FROM u LEFT JOIN r ON r.a = u.id GROUP BY u.line, u.id),
f AS (SELECT x.*, class, class IS NOT NULL AND row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) > 1 AS gone FROM x LEFT JOIN c USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM f GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
