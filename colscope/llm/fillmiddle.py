"""Fill-in-the-middle over seekable compressed texts.

A text is stored as independent zstandard frames, each with the number of units, code
points and bytes before it. The counts find the frames that hold the two cuts; only those
are unpacked to place the cuts, whole frames go into the output as they are. Digests
stream over the output's frames in order, and the restored text is read by seeking in
them, so a task holds one frame and the compressed text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ENTRY = [("units", pa.int64()), ("chars", pa.int64()), ("size", pa.int32()), ("after_letter", pa.bool_()), ("data", pa.binary())]
FRAMES = "array<struct<units:long,chars:long,size:int,after_letter:boolean,data:binary>>"
Frame = tuple[int, int, int, bool, bytes]


def _frames_array(texts: list[list[Frame]]) -> pa.Array:
    flat = [f for frames in texts for f in frames]
    columns = [pa.array([f[i] for f in flat], kind) for i, (_, kind) in enumerate(ENTRY)]
    ends = np.concatenate([[0], np.cumsum([len(frames) for frames in texts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=[n for n, _ in ENTRY]))


def _frames_of(column: pa.ListArray) -> list[list[Frame]]:
    flat = column.flatten()
    rows = list(zip(*(flat.field(n).to_pylist() for n, _ in ENTRY)))
    ends = np.cumsum([len(x) if x.is_valid else 0 for x in column]).tolist()
    return [rows[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def unit_starts(raw: np.ndarray, after_letter: bool) -> np.ndarray:
    """Bytes at which a unit starts: every character but a letter A-Z, a-z that follows another."""
    letter = ((raw | 32) - np.uint8(97)) < 26
    before = np.empty_like(letter)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return ((raw & 0xC0) != 0x80) & ~(letter & before)


class _Writer:
    """Cuts bytes into frames of about ``size`` bytes between characters."""

    def __init__(self, size: int):
        self.size, self.pack = size, zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress
        self.begin()

    def begin(self) -> None:
        self.frames: list[Frame] = []
        self.units = self.chars = 0
        self.after, self.held = False, b""

    def add(self, data: bytes | memoryview) -> None:
        at = 0
        if self.held:
            data, self.held = self.held + bytes(data), b""
        while len(data) - at > self.size:
            end = at + self.size
            while data[end] & 0xC0 == 0x80:
                end -= 1
            self._emit(bytes(data[at:end]))
            at = end
        self.held = bytes(data[at:])

    def whole(self, frame: Frame, raw_units: int, raw_chars: int, last_letter: bool) -> None:
        """A frame that is copied unread; ``after_letter`` is kept, so its units are as before."""
        self.flush()
        self.frames.append((self.units, self.chars, frame[2], frame[3], frame[4]))
        self.units, self.chars, self.after = self.units + raw_units, self.chars + raw_chars, last_letter

    def _emit(self, raw: bytes) -> None:
        codes = np.frombuffer(raw, np.uint8)
        self.frames.append((self.units, self.chars, len(raw), self.after, self.pack(raw)))
        self.units += int(np.count_nonzero(unit_starts(codes, self.after)))
        self.chars += int(np.count_nonzero((codes & 0xC0) != 0x80))
        self.after = raw[-1:].isalpha()

    def flush(self) -> None:
        if self.held:
            self._emit(self.held)
            self.held = b""

    def end(self) -> list[Frame]:
        self.flush()
        return self.frames


class _Store:
    """A stored text: frames and the totals of units and characters."""

    def __init__(self, frames: list[Frame], units: int, chars: int, unpack):
        self.frames, self.units, self.chars, self.unpack = frames, units, chars, unpack
        self.at = [f[0] for f in frames]
        self.open: tuple[int, bytes] = (-1, b"")

    def raw(self, k: int) -> bytes:
        if self.open[0] != k:
            self.open = (k, self.unpack(self.frames[k][4]))
        return self.open[1]

    def cut(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and characters before the start of ``unit``."""
        if unit >= self.units:
            return len(self.frames), 0, self.chars
        k = bisect_right(self.at, unit) - 1
        codes = np.frombuffer(self.raw(k), np.uint8)
        byte = int(np.flatnonzero(unit_starts(codes, self.frames[k][3]))[unit - self.at[k]])
        return k, byte, self.frames[k][1] + int(np.count_nonzero((codes[:byte] & 0xC0) != 0x80))

    def copy(self, out: _Writer, start: tuple[int, int, int], end: tuple[int, int, int]) -> None:
        for k in range(start[0], min(end[0] + 1, len(self.frames))):
            a, z = start[1] if k == start[0] else 0, end[1] if k == end[0] else None
            if a == 0 and z is None and self.frames[k][2] >= out.size // 2:
                after = (self.frames[k + 1][:2] if k + 1 < len(self.frames) else (self.units, self.chars))
                out.whole(self.frames[k], after[0] - self.frames[k][0], after[1] - self.frames[k][1], k + 1 < len(self.frames) and self.frames[k + 1][3])
            elif z != 0:
                out.add(self.raw(k)[a:z])


def store_frames(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """``doc_id``, ``units``, ``chars``, ``marked`` (the text holds a marker) and ``frames``, in one pass over the bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(frame)
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows = []
            for text in b.column(1):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                writer.begin()
                marked, at = False, 0
                while at < len(raw):  # the two bytes before show a marker that lies across
                    step = bytes(raw[max(0, at - 2):at + frame])
                    marked = marked or PREFIX in step or SUFFIX in step or MIDDLE in step
                    at += frame
                writer.add(raw)
                rows.append((writer.end(), writer.units, writer.chars, marked))
            frames, units, chars, marked = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(marked), _frames_array(list(frames))],
                                             names=["doc_id", "units", "chars", "marked", "frames"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, units long, chars long, marked boolean, frames {FRAMES}")


def fill_in_middle(stored: DataFrame, frame: int = FRAME) -> DataFrame:
    """Transformed texts as frames: ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``frames``.

    The cuts and the form come from the SHA-256 of ``1:`` and the decimal doc_id (nothing
    for NULL). Frames between the cuts are copied without being unpacked.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, unpack = _Writer(frame), zstandard.ZstdDecompressor().decompress
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows, texts = [], []
            columns = [b.column(c).to_pylist() for c in ("doc_id", "units", "chars", "marked")]
            for doc, n, chars, marked, frames in zip(*columns, _frames_of(b.column("frames"))):
                key = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(key[i:i + 8], 16) for i in (0, 8, 16, 24))
                if n == 0 or marked or h3 % 100 >= 90:
                    rows.append((doc, n, "plain", None, None))
                    texts.append(frames)
                    continue
                text = _Store(frames, n, chars, unpack)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                cuts = [(0, 0, 0), text.cut(low), text.cut(high), text.cut(n)]
                form = "spm" if h4 % 100 < 20 else "psm"
                parts = [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)] if form == "psm" else [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)]
                writer.begin()
                for marker, i in parts:
                    writer.add(marker)
                    text.copy(writer, cuts[i], cuts[i + 1])
                rows.append((doc, n, form, cuts[1][2], cuts[2][2] - cuts[1][2]))
                texts.append(writer.end())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [_frames_array(texts)],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return stored.mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}")


def _ranges(frames: list[Frame], form: str, raw) -> list[tuple[int, int]]:
    """Byte ranges of prefix, middle and suffix in an output, found by its markers."""
    found, carry, at = {}, b"", 0
    for k, f in enumerate(frames):
        step = carry + raw(k)
        for marker in (PREFIX, SUFFIX, MIDDLE):
            if marker not in found and (i := step.find(marker)) >= 0:
                found[marker] = at - len(carry) + i
        at, carry = at + f[2], step[-2:]
    p, s, m = found[PREFIX], found[SUFFIX], found[MIDDLE]
    return [(p + 3, s), (m + 3, at), (s + 3, m)] if form == "psm" else [(p + 3, m), (m + 3, at), (s + 3, p)]


def read_ranges(frames: list[Frame], ranges: list[tuple[int, int]], raw) -> Iterator[bytes]:
    """Bytes of the ranges in the order given; frames outside are skipped."""
    ends = np.cumsum([f[2] for f in frames])
    for start, end in ranges:
        k = int(np.searchsorted(ends, start, side="right"))
        while start < end:
            base = int(ends[k]) - frames[k][2]
            yield raw(k)[start - base:end - base]
            start, k = int(ends[k]), k + 1


def read_texts(transformed: DataFrame) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` in place of the frames, read from frames and form alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            digests = []
            for form, frames in zip(b.column("form").to_pylist(), _frames_of(b.column("frames"))):
                store = _Store(frames, 0, 0, unpack)
                size = sum(f[2] for f in frames)
                pair = []
                for ranges in ([(0, size)], [(0, size)] if form == "plain" else _ranges(frames, form, store.raw)):
                    digest = hashlib.sha256()
                    for data in read_ranges(frames, ranges, store.raw):
                        digest.update(data)
                    pair.append(digest.hexdigest())
                digests.append(pair)
            kept = b.drop_columns(["frames"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([d[i] for d in digests], pa.string()) for i in (0, 1))],
                                             names=[*kept.schema.names, "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def output_texts(transformed: DataFrame) -> DataFrame:
    """``doc_id``, ``form`` and the output as ``text``; a text must then fit into a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            texts = [b"".join(unpack(f[4]) for f in frames).decode("utf-8", "replace") for frames in _frames_of(b.column("frames"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("form"), pa.array(texts, pa.string())], names=["doc_id", "form", "text"])

    return transformed.select("doc_id", "form", "frames").mapInArrow(run, "doc_id long, form string, text string")


def transformed_digests(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """Store, transform and read back whole texts; see ``fill_in_middle`` and ``read_texts``.

    Returns ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (NULL if
    plain), ``output_sha256`` and ``restored_sha256``. NULL texts are empty and plain. Rows
    of one doc_id, equal or not, are transformed one by one; without a doc_id the key is
    ``1:``. An empty table gives no rows. Other columns are ignored.
    """
    return read_texts(fill_in_middle(materialize(store_frames(docs, frame), "fim-frames"), frame))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
             array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
