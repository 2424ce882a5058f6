"""Quality by a sparse rule ensemble.

Boosted shallow trees over text statistics are taken apart into their paths, each a
conjunction of comparisons. A lasso logistic regression keeps few of these rules, and
what it keeps is compiled into one Spark column expression.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.session import materialize

from .labelled import held_out, labelled_sample, training_labels

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#%*$&|!<>{}[]~^=+_\\/@"
STATISTICS = ("chars", "words", "word_chars", "distinct", "repeated", "symbols", "capitals", "digits", "stops", "lines", "line_chars", "no_space")
_NODE = re.compile(r"(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+|NaN|Infinity)\)")

Rule = tuple[tuple[int, bool, float], ...]


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and STATISTICS of whole texts, by built-in functions; NULL counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE, -1), lambda w: w != ""))
    chars, words = F.length("text"), F.size("words")
    per_char = F.greatest(chars, F.lit(1)).cast("double")
    per_word = F.greatest(words, F.lit(1)).cast("double")
    spaces = chars - _without(F.col("text"), " \t\n\r\x0b\f")
    lines = chars - _without(F.col("text"), "\n") + 1
    same = F.aggregate(F.zip_with("words", F.slice("words", 2, F.greatest(words, F.lit(1))), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return rows.select(
        "doc_id", F.log1p(chars).alias("chars"), F.log1p(words).alias("words"), ((chars - spaces) / per_word).alias("word_chars"),
        (F.size(F.array_distinct("words")) / per_word).alias("distinct"), (same / per_word).alias("repeated"),
        ((chars - _without(F.col("text"), SYMBOLS)) / per_char).alias("symbols"),
        ((chars - _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / per_char).alias("capitals"),
        ((chars - _without(F.col("text"), "0123456789")) / per_char).alias("digits"),
        ((chars - _without(F.col("text"), ".,;:?")) / per_word).alias("stops"), F.log1p(lines).alias("lines"),
        (chars / lines).alias("line_chars"), (F.size(F.filter("words", lambda w: F.length(w) > 20)) / per_word).alias("no_space"))


def tree_rules(debug: str) -> list[Rule]:
    """Every path prefix of the printed trees as a rule: (statistic, at most?, bound) triples."""
    rules, path = set(), []
    for line in debug.splitlines():
        found = _NODE.search(line)
        if "Tree " in line and "weight" in line:
            path = []
        if not found:
            continue
        depth = len(line) - len(line.lstrip())
        path = [p for p in path if p[0] < depth] + [(depth, (int(found[1]), found[2] == "<=", float(found[3])))]
        rules.add(tuple(sorted({p[1] for p in path})))
    return sorted(rules)


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, at_most, bound in rule:
        c = F.col(STATISTICS[feature])
        out = out & ((c <= bound) if at_most else (c > bound))
    return out


def fit_rules(train: DataFrame, trees: int = 12, depth: int = 3, penalties: tuple[float, ...] = (0.002, 0.0005, 0.0001)) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and intercept from ``train`` (STATISTICS and ``y``), a bounded table.

    All path prefixes of the trees are offered. Of the ``penalties`` (strong ones first) the
    lasso takes the one with the least log loss on a fifth of ``train`` it is not fitted on,
    and is then fitted on all of it.
    """
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="x", handleInvalid="keep").transform(train)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5).fit(assembled)
    rules = tree_rules(model.toDebugString)
    marked = train.select("y", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("v"),
                          (F.pmod(F.xxhash64(*STATISTICS), F.lit(5)) == 0).alias("aside"))
    marked = materialize(marked, "quality-rules")

    def fitted(rows: DataFrame, penalty: float):
        return LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=True).fit(rows)

    fit_on, aside = marked.where("not aside"), marked.where("aside")
    if fit_on.select("y").distinct().count() == 2 and not aside.isEmpty():
        loss = {p: log_loss(fitted(fit_on, p).transform(aside)) for p in penalties}
    else:
        loss = {penalties[0]: 0.0}
    model = fitted(marked, min(loss, key=loss.get))
    return [(r, float(w)) for r, w in zip(rules, model.coefficients) if w], float(model.intercept)


def log_loss(scored: DataFrame) -> float:
    p = F.greatest(F.lit(1e-9), F.get(vector_to_array("probability"), F.col("y")))
    return scored.agg(F.avg(-F.ln(p))).first()[0]


def compile_score(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, column: str = "quality", most_labelled: int = 20_000) -> DataFrame:
    """Quality of every document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Rules and weights are fitted on at most ``most_labelled`` labelled rows that are not
    held out (crc32 of the id as text modulo 5 is 0 for those held out). NULL and empty
    texts have zero statistics and are scored like any. With labels of one kind only the
    score is that label (0.5 without labels). Repeated rows are returned as often; a NULL
    id is never held out; an empty table gives no rows. Other columns are ignored.
    """
    known = materialize(training_labels(labels, column), "quality-labels")
    sample = labelled_sample(docs, known, most_labelled)
    train = materialize(statistics(sample).join(known, "doc_id").select(*STATISTICS, "y"), "quality-train")
    kinds = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) == 2:
        score = compile_score(*fit_rules(train))
    else:
        score = F.lit(float(next(iter(kinds), 0.5)))
    return statistics(docs).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))
