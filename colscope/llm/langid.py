"""Language identification with hyperdimensional profiles.

Each letter (and the gap between words) has a random +-1 vector. A trigram binds its
letters' vectors, permuted by place, by multiplication; a text bundles its trigrams by
addition. A language's prototype is the sum of its documents' unit vectors, and a text
gets the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
PIECE = 1 << 18
CELLS = 400_000


class Profiles:
    """Hypervectors of texts; letter vectors depend on the code point alone."""

    def __init__(self, dim: int = DIM, cache: int = 60_000):
        self.dim, self.cache = dim, cache
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.grams = np.zeros((4096, dim), np.int8)
        self.known: dict[int, bool] = {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.default_rng([11, code]).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def _is_letter(self, codes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(codes, return_inverse=True)
        flags = np.fromiter((chr(c).isalpha() for c in distinct.tolist()), bool, len(distinct))
        return flags[back]

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of trigrams; ids hold three code points of 21 bits."""
        if len(self.rows) + len(ids) > self.cache:
            self.rows.clear()
        at = np.empty(len(ids), np.int64)
        for i, g in enumerate(ids.tolist()):
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                if row >= len(self.grams):
                    self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
                a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
                self.grams[row] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            at[i] = row
        return self.grams[at].astype(np.float32)

    def _codes(self, piece: str) -> np.ndarray:
        """Code points of the lower-cased letters, 0 for other characters."""
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return np.where(self._is_letter(codes), codes, 0) if len(codes) else codes

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A vector per text, and whether the text holds a letter.

        A long text goes through in pieces; memory depends on the pieces.
        """
        out, lettered = np.zeros((len(texts), self.dim), np.float64), np.zeros(len(texts), bool)
        ids, owners, held = [], [], 0

        def flush() -> None:
            nonlocal ids, owners, held
            if ids:
                distinct, back = np.unique(np.concatenate(ids), return_inverse=True)
                own = np.concatenate(owners)
                rows, own = np.unique(own, return_inverse=True)
                step = max(1, CELLS // max(1, len(rows)))
                for s in range(0, len(distinct), step):
                    part = distinct[s:s + step]
                    mine = (back >= s) & (back < s + len(part))
                    counts = np.bincount(own[mine] * len(part) + back[mine] - s, minlength=len(rows) * len(part))
                    out[rows] += counts.reshape(len(rows), len(part)).astype(np.float32) @ self._grams(part)
            ids, owners, held = [], [], 0

        for i, text in enumerate(texts):
            text, before = text or "", np.zeros(1, np.int64)
            for at in range(0, len(text), PIECE):  # the last two codes go on, so no trigram is lost at a cut
                codes = np.concatenate([before, self._codes(text[at:at + PIECE]), np.zeros(int(at + PIECE >= len(text)), np.int64)])
                lettered[i] |= bool((codes > 0).any())
                codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
                before = codes[-2:]
                if len(codes) > 2:
                    gram = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
                    ids.append(gram), owners.append(np.full(len(gram), i))
                    held += len(gram)
                if held > PIECE:
                    flush()
        flush()
        return out, lettered


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def learn(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototype of each value of ``lang`` over all of ``docs`` (``text``, ``lang``).

    Tasks send a partial sum per language; the driver gets languages x ``dim`` numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dim), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                vectors, _ = profiles(b.column("text").to_pylist())
                for lang, v in zip(b.column("lang").to_pylist(), _units(vectors)):
                    sums[lang] = sums[lang] + v if lang in sums else v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    rows = (docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, i int, v double")
            .groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas())
    return {lang: _units(part.sort_values("i")["v"].to_numpy()[None, :])[0] for lang, part in rows.groupby("lang")}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` columns ``doc_id`` and ``text`` to ``doc_id``, ``lang_pred``, ``score``."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] for x in names]) if names else np.zeros((0, DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(matrix.shape[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                vectors, lettered = profiles(b.column("text").to_pylist())
                if names:
                    close = _units(vectors) @ matrix.T
                    best = close.argmax(1)
                    lang = [names[k] if ok else "und" for k, ok in zip(best, lettered)]
                    score = np.where(lettered, np.clip(close[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                else:
                    lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Language of every document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Prototypes come from the documents with a language whose crc32(doc_id as text) modulo
    ``modulus`` is not ``held``; ``lang`` plays no part in a prediction. A text that is
    NULL or has no letter is ``und`` with score 0, as is any text if nothing could be
    learned. Ties go to the first name. A document without an id is never held out. Repeated
    rows are returned as often; an empty table gives no rows. Other columns are ignored.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))
    known = docs.where(~out).select("text", "lang")
    return predict(docs, learn(known)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.04) -> DataFrame:
    """All columns of the documents whose language can be told.

    Prototypes come from all documents with a language. Rejected are texts that are NULL or
    have no letter, and those whose best cosine is below ``least``, about what unrelated
    vectors reach by chance; nothing is rejected for being in the wrong language. If
    nothing could be learned, only the texts without letters go. One pass, no shuffle.
    """
    prototypes = learn(docs)
    matrix = np.stack([prototypes[x] for x in sorted(prototypes)]) if prototypes else np.zeros((0, DIM))
    names, at_text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(matrix.shape[1])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                vectors, keep = profiles(b.column(at_text).to_pylist())
                if len(matrix):
                    keep &= (_units(vectors) @ matrix.T).max(1) >= least
                yield b.filter(pa.array(keep))

    return docs.select(*names).mapInArrow(run, docs.schema)
