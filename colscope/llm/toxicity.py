"""Toxicity by a lexicon trie met with Levenshtein automata.

Terms (a small fixed list and what the labels teach) form a trie. The set of trie nodes
reachable with so many errors is the automaton's state; the sets are turned into one
table, which runs over all words of a batch at once. Hits are weighed by their context
window: quotation and reporting count less, address in the second person more. A
logistic regression over the summed hits gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .labelled import held_out, labelled_sample, training_labels
from .words import NOT_WORD, PIECE

INSULTS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "clown", "scum", "trash", "loser", "imbecile", "bastard")
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting word words term terms reported reporting claimed alleged".split())
ADDRESS = frozenset("you your yours yourself youre u ur are du dein tu vous te usted".split())
QUOTES = frozenset("\"“”„«»‹›")
INNER = "@$*!"
SPAN = 8
COUNTS = ("exact", "fuzzy", "stem", "quoted", "abuse", "terms")


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic table of a trie with errors. State 0 is dead, 1 the start; rows fill as texts need them.

    ``terms`` are matched whole with ``allowed_errors`` edits (a swap of neighbours is
    one), ``stems`` without errors at the start of a word.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.names = [*terms, *stems]
        letters = sorted({c for t in self.names for c in t})
        self.classes = np.zeros(0x110000, np.uint32)  # 0: a character of no term
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, bool]] = {}
        limits = [0]
        for number, term in enumerate(self.names):
            errors, at = (allowed_errors(term) if number < len(terms) else 0), 0
            key = [("stem",) if number >= len(terms) else ("word", errors), *(int(self.classes[ord(c)]) for c in term)]
            for step in key:  # a first step keeps words of unlike limits in tries of their own
                if step not in nodes[at]:
                    nodes[at][step] = len(nodes)
                    nodes.append({})
                    limits.append(errors)
                at = nodes[at][step]
            ends.setdefault(at, (number, number >= len(terms)))
        self.nodes, self.ends, self.limits = nodes, ends, limits
        start = self._closed({(root, 0, 0) for root in nodes[0].values()})
        self.sets, self.numbers = [], {}
        self.table = np.full((64, self.width), -1, np.int32)
        self.term, self.errors, self.final = np.full(64, -1), np.zeros(64, np.int64), np.zeros(64, bool)
        self._number(frozenset())
        self._number(start)
        self.table[0] = 0

    def _closed(self, items: set) -> frozenset:
        """With what is reached by leaving letters out."""
        todo, got = list(items), set(items)
        while todo:
            node, errors, swap = todo.pop()
            if not swap and errors < self.limits[node]:
                for child in self.nodes[node].values():
                    if (child, errors + 1, 0) not in got:
                        got.add((child, errors + 1, 0))
                        todo.append((child, errors + 1, 0))
        return frozenset(got)

    def _step(self, state: frozenset, c: int) -> frozenset:
        nodes, out = self.nodes, set()
        for node, errors, swap in state:
            if swap:
                if c == swap:
                    out.add((node, errors, 0))
                continue
            child = nodes[node].get(c)
            if child is not None:
                out.add((child, errors, 0))
            if errors < self.limits[node]:
                out.add((node, errors + 1, 0))
                for first, x in nodes[node].items():
                    out.add((x, errors + 1, 0))
                    if c in nodes[x] and first != c:
                        out.add((nodes[x][c], errors + 1, first))
        return self._closed(out)

    def _number(self, state: frozenset) -> int:
        """The state's number; a new state gets an empty row."""
        if state not in self.numbers:
            n = self.numbers[state] = len(self.sets)
            self.sets.append(state)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.term, self.errors, self.final = (np.concatenate([x, np.full_like(x, fill)]) for x, fill in ((self.term, -1), (self.errors, 0), (self.final, False)))
            best = min(((e, *self.ends[at]) for at, e, swap in state if not swap and at in self.ends), default=None)
            if best:
                self.errors[n], self.term[n], self.final[n] = best
            if best and best[2]:
                self.table[n] = 0
        return self.numbers[state]

    def _next(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Following states; steps met for the first time are worked out and kept."""
        out = self.table[state, classes]
        new = np.flatnonzero(out < 0)
        if len(new):
            for s, c in {*zip(state[new].tolist(), classes[new].tolist())}:
                to = self._number(self._step(self.sets[s], c))
                self.table[s, c] = to
            out = self.table[state, classes]
        return out

    def run(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that match, and their last states."""
        words, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        hit_words, hit_states = [], []
        while len(words):
            state = self._next(state, classes[at])
            at = at + 1
            live = state > 0
            words, state, at = words[live], state[live], at[live]
            done = (at == ends[words]) | self.final[state]
            hit = done & (self.term[state] >= 0)
            hit_words.append(words[hit]), hit_states.append(state[hit])
            words, state, at = words[~done], state[~done], at[~done]
        return (np.concatenate(hit_words), np.concatenate(hit_states)) if hit_words else (words, state)


class Scanner:
    """Sums of hits per text."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        self.inner = np.zeros(0x110000, bool)
        self.inner[[ord(c) for c in INNER]] = True

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums (a column per name of COUNTS) and word counts; long texts go through in pieces."""
        sums, words = np.zeros((len(texts), len(COUNTS))), np.zeros(len(texts), np.int64)
        seen: dict[int, set[int]] = {}
        held, owners, chars = [], [], 0

        def flush() -> None:
            nonlocal held, owners, chars
            if held:
                self._piece(held, owners, sums, words, seen)
            held, owners, chars = [], [], 0

        for i, text in enumerate(texts):
            at, text = 0, (text or "").lower()
            while at < len(text):
                end = len(text)
                if end - at > PIECE:
                    cut = NOT_WORD.search(text, at + PIECE)
                    end = cut.start() if cut else end
                if chars + end - at > PIECE:
                    flush()
                held.append(text[at:end]), owners.append(i)
                chars += end - at + 1
                at = end
        flush()
        for i, terms in seen.items():
            sums[i, COUNTS.index("terms")] = len(terms)
        return sums, words

    def _piece(self, texts: list[str], owners: list[int], sums: np.ndarray, words: np.ndarray, seen: dict) -> None:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.word[codes]
        inside[1:-1] |= self.inner[codes[1:-1]] & inside[:-2] & inside[2:]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(bounds, starts, side="right")
        np.add.at(words, owners, np.bincount(owner, minlength=len(texts)))
        a = self.automaton
        for w, state in zip(*(x.tolist() for x in a.run(a.classes[codes], starts, ends))):
            text, doc = int(owner[w]), owners[int(owner[w])]
            weight = self._context(joined, starts, ends, owner, w, bounds[text] - len(texts[text]) - 1, bounds[text])
            kind = "stem" if a.final[state] else "fuzzy" if a.errors[state] else "exact"
            sums[doc, COUNTS.index(kind)] += 1
            sums[doc, COUNTS.index("quoted")] += weight < 0.5
            sums[doc, COUNTS.index("abuse")] += weight * (0.6 if kind == "fuzzy" else 1.0)
            seen.setdefault(doc, set()).add(int(a.term[state]))

    @staticmethod
    def _context(joined: str, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, w: int, low: int, high: int) -> float:
        """Weight of a hit by the words and marks around it."""
        lo, hi = max(0, w - SPAN), min(len(starts), w + SPAN + 1)
        before = [joined[starts[k]:ends[k]] for k in range(lo, w) if owner[k] == owner[w]]
        after = [joined[starts[k]:ends[k]] for k in range(w + 1, hi) if owner[k] == owner[w]]
        left, right = joined[max(low, starts[w] - 60):starts[w]], joined[ends[w]:min(high, ends[w] + 60)]
        weight = 1.0
        if any(c in QUOTES for c in left) and any(c in QUOTES for c in right):
            weight *= 0.4
        if REPORTING.intersection(before[-4:]):
            weight *= 0.6
        if ADDRESS.intersection(before) or ADDRESS.intersection(after[:3]):
            weight *= 1.5
        return weight


def learned_terms(sample: DataFrame, ratio: float = 20.0, support: float = 0.01) -> tuple[list[str], list[str]]:
    """Whole words and stems that mark label 1 in the sample (``text``, ``y``).

    A term of any length is taken if its rate in toxic documents is ``ratio`` times that in
    the others and it stands in ``support`` of the toxic ones (5 at least); a stem is the
    first 4 to 8 letters of such words, and none that begins with another stem. Counts are
    aggregates over distinct words per document; only the chosen terms come to the driver,
    and the sample bounds their number.
    """
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return [], []
    words = sample.select("y", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("term"))
    counted = words.where("term <> ''").groupBy("term").agg(F.sum("y").alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    counted = materialize(counted, "tox-words")
    strong = (F.col("bad") >= max(5, support * bad)) & ((F.col("bad") + 0.5) / bad >= ratio * (F.col("good") + 0.5) / good)
    chosen = lambda df: sorted(r.term for r in df.where(strong).select("term").collect())
    prefixes = counted.where(F.length("term") >= 4).select(
        F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.length("term"))), lambda n: F.substring("term", 1, n))).alias("term"), "bad", "good")
    stems: set[str] = set()
    for stem in sorted(chosen(prefixes.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))), key=len):
        if not any(stem[:n] in stems for n in range(4, len(stem))):
            stems.add(stem)
    return chosen(counted), sorted(stems)


def hit_sums(docs: DataFrame, terms: list[str], stems: list[str]) -> DataFrame:
    """``doc_id``, ``words`` and the sums of COUNTS of every document."""
    automaton = Automaton(terms, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(automaton)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sums, words = scan(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), *(pa.array(c) for c in sums.T)], names=["doc_id", "words", *COUNTS])

    schema = "doc_id long, words long, " + ", ".join(f"{c} double" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _features() -> list[Column]:
    return [*(F.log1p(c) for c in COUNTS), F.log1p(100.0 * (F.col("exact") + F.col("stem")) / F.greatest("words", F.lit(1)))]


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", most_labelled: int = 20_000) -> DataFrame:
    """Toxicity of every document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Terms are learned from at most ``most_labelled`` labelled rows that are not held out
    (crc32 of the id as text modulo 5 is 0 for those held out), weights from all of them.
    NULL and empty texts have no hits and get the score of none. Without labels of both
    kinds the score is 1 - exp(-abuse) over the fixed list. Repeated rows are returned as
    often; a NULL id is never held out; an empty table gives no rows. Other columns are
    ignored.
    """
    known = materialize(training_labels(labels, column), "tox-labels")
    whole, stems = learned_terms(labelled_sample(docs, known, most_labelled))
    sums = materialize(hit_sums(docs, sorted({*INSULTS, *whole}), stems), "tox-hits")
    wide = sums.select("doc_id", "abuse", *(f.alias(f"f{i}") for i, f in enumerate(_features())))
    train = wide.join(known, "doc_id").select("y", *(c for c in wide.columns if c[0] == "f"))
    if {r.y for r in train.select("y").distinct().collect()} == {0, 1}:
        names = [c for c in train.columns if c != "y"]
        fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=60).fit(
            VectorAssembler(inputCols=names, outputCol="x").transform(train))
        total = sum((F.col(n) * float(w) for n, w in zip(names, fitted.coefficients)), F.lit(float(fitted.intercept)))
        score = 1 / (1 + F.exp(-total))
    else:
        score = 1 - F.exp(-F.col("abuse"))
    return wide.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
