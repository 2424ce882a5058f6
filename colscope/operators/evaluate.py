"""Evaluation of predicted results and classifier scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as va
from .prep import matrix_columns
from .relational import apply_corrections, chunk_numbers, column_recall, table_recall

STAGES = ["final", "table", "column"]


def _count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def seconds(text: Column) -> Column:
    """Number of seconds from texts such as ``1.23s``."""
    return F.regexp_replace(F.trim(text), "s$", "").try_cast("double")


def evaluate_cases(cases: DataFrame, variant: str = "v1", pairing: str = "sorted") -> DataFrame:
    """Add ``final_correct``, ``table_correct`` and ``column_correct``.

    Lists count in order only for cases that ask for a sort.
    """
    ordered = F.coalesce(F.col("sort") != "", F.lit(False))
    return cases.select(
        "*",
        va.list_match(F.col("expected"), F.col("predicted"), ordered, variant, pairing).alias("final_correct"),
        table_recall(F.col("predicted_tables"), F.col("tables")).alias("table_correct"),
        column_recall(F.col("predicted_columns"), F.col("columns")).alias("column_correct"))


def _stage_aggs(stages: Sequence[str]) -> list[Column]:
    n = F.count(F.lit(1))
    out = []
    for s in stages:
        hits = _count_if(F.col(f"{s}_correct"))
        out += [hits.alias(f"{s}_correct_cases"), F.try_divide(hits, n).alias(f"{s}_accuracy")]
    return out


def summary(results: DataFrame, stages: Sequence[str] = STAGES, by: Sequence[str] = ()) -> DataFrame:
    """Totals, correct cases and accuracy per stage, and tokens."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), *_stage_aggs(stages),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def _counted(results: DataFrame, run: str, order: str, stages: Sequence[str]) -> DataFrame:
    """Only what a report counts: long lists and texts stay out of the ranking."""
    return results.select(run, order, *[f"{s}_correct" for s in stages], "tokens")


def chunk_reports(results: DataFrame, run: str, order: str, interval: int = 10,
                  stages: Sequence[str] = STAGES) -> DataFrame:
    """Report per chunk of ``interval`` results of a run."""
    return summary(chunk_numbers(_counted(results, run, order, stages), run, order, interval), stages, [run, "chunk_number"])


def chunk_rollup(results: DataFrame, run: str, order: str, interval: int = 10,
                 stages: Sequence[str] = STAGES) -> DataFrame:
    """Chunk reports with the total of each run and of everything."""
    numbered = chunk_numbers(_counted(results, run, order, stages), run, order, interval)
    return numbered.rollup(run, "chunk_number").agg(
        F.count(F.lit(1)).alias("total_cases"), *_stage_aggs(stages),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))


def merge_reports(reports: DataFrame, counts: Sequence[str], total: str = "total_cases") -> DataFrame:
    """One report from many: counts are added, ratios computed at the end."""
    sums = reports.agg(F.sum(total).cast("bigint").alias(total),
                       *[F.sum(c).cast("bigint").alias(c) for c in counts])
    return sums.select("*", *[F.coalesce(F.try_divide(F.col(c), F.col(total)), F.lit(0.0)).alias(f"{c}_share")
                              for c in counts])


def by_hardness(results: DataFrame) -> DataFrame:
    """Cases, correct cases and accuracy of the successful results per hardness."""
    n, hits = F.count(F.lit(1)), _count_if(F.col("correct"))
    return (results.where("status = 'success'").groupBy("hardness")
            .agg(n.alias("cases"), hits.alias("correct_cases"), F.try_divide(hits, n).alias("accuracy")))


def reevaluate(results: DataFrame, dataset: DataFrame, variant: str = "v3") -> DataFrame:
    """Judge every result again; a wrong one with classes gets a second chance.

    ``results``: data_id, expected, predicted, correct. ``dataset``: id, x_data,
    y_data, classify. Where the comparison fails the old verdict stays.
    """
    ref = dataset.select(F.col("id").alias("data_id"), "x_data", "y_data", "classify")
    joined = results.join(ref, "data_id", "left")
    again = va.list_match(F.col("expected"), F.col("predicted"), False, variant)
    merged = va.list_match(matrix_columns(F.col("x_data"), F.col("y_data"), F.col("classify")),
                           F.col("predicted"), False, variant)
    has_classes = F.coalesce(F.size("classify"), F.lit(0)) > 0
    tried = joined.withColumn("_again", again)
    second = F.when(~F.col("correct") & ~F.col("_again") & has_classes, F.coalesce(merged, F.lit(False)))
    return (tried.withColumn("second_chance", F.coalesce(second, F.lit(False)))
            .withColumn("new_correct", F.coalesce(F.col("_again") | F.col("second_chance"), F.col("correct")))
            .drop("x_data", "y_data", "classify", "_again"))


def flip_counts(reevaluated: DataFrame) -> DataFrame:
    old, new = F.col("correct"), F.col("new_correct")
    return reevaluated.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(~old & new & ~F.col("second_chance")).alias("wrong_to_right"),
        F.count_if("second_chance").alias("rescued_by_merge"), F.count_if(old & ~new).alias("right_to_wrong"),
        F.count_if(new).alias("correct_cases"),
        F.try_divide(F.count_if(new), F.count(F.lit(1))).alias("accuracy"))


def corrected_accuracy(results: DataFrame, corrections: DataFrame) -> DataFrame:
    fixed = apply_corrections(results, corrections)
    hits = _count_if(F.col("correct"))
    return fixed.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if("manual").alias("reviewed"),
                     hits.alias("correct_cases"), F.try_divide(hits, F.count(F.lit(1))).alias("accuracy"))


# ---------------------------------------------------------------- chart ranks

def rank_cases(cases: DataFrame, predicted: str = "predicted", truth: str = "expected",
               succeeded: Column | None = None) -> DataFrame:
    """Verdict, hit@2 and rank of the true chart type in a ranked list.

    A missing type ranks after the last one; an empty list is an error. A run
    that did not succeed is a failure, whose rank still counts in the total.
    """
    ended = F.lit(True) if succeeded is None else F.coalesce(succeeded, F.lit(False))
    at = F.array_position(predicted, F.col(truth))
    usable = F.coalesce(F.size(predicted), F.lit(0)) > 0
    rank = F.when(at > 0, at).otherwise(F.size(predicted) + 1)
    return cases.select(
        "*", F.when(~usable, "error").when(ended, "success").otherwise("failure").alias("status"),
        F.when(usable, at == 1).alias("correct"), F.when(usable, at.between(1, 2)).alias("correct_hit2"),
        F.when(usable, rank).cast("bigint").alias("rank"))


def rank_summary(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and hit@2 over all cases; mean rank over the successful ones."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status") == "success")
    hits, hit2 = _count_if(F.col("correct")), _count_if(F.col("correct_hit2"))
    total_rank = F.coalesce(F.sum("rank"), F.lit(0))
    return ranked.groupBy(*by).agg(
        n.alias("total_cases"), ok.alias("success_cases"), hits.alias("correct_cases"), hit2.alias("hit2_cases"),
        F.try_divide(hits, n).alias("accuracy"), F.try_divide(hit2, n).alias("hit_at_2"),
        total_rank.alias("total_rank"),
        F.coalesce(F.try_divide(total_rank, ok), F.lit(0.0)).alias("mean_rank"))


# ---------------------------------------------------------- class probabilities

def ranked_classes(probability: Column) -> Column:
    """``(prob, idx)`` by falling probability; equal ones by class number."""
    pairs = F.transform(probability, lambda p, i: F.struct((-p).alias("neg"), i.alias("idx")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct((-s["neg"]).alias("prob"), s["idx"].alias("idx")))


def top_k(scored: DataFrame, probability: str, labels: Column, k: int = 2) -> DataFrame:
    """Best class, its probability and the ``k`` best classes with theirs.

    ``labels`` is the array of class names by index; missing ones are ``unknown``.
    """
    ranked = scored.withColumn("_rank", ranked_classes(F.col(probability)))

    def label(i: int) -> Column:
        return F.coalesce(F.get(labels, F.get("_rank", F.lit(i))["idx"]), F.lit("unknown"))

    tops = [c for i in range(k) for c in (label(i).alias(f"top{i + 1}_type"),
                                          F.get("_rank", F.lit(i))["prob"].alias(f"top{i + 1}_prob"))]
    return ranked.select("*", label(0).alias("predicted_trace_type"),
                         F.get("_rank", F.lit(0))["prob"].alias("confidence"), *tops).drop("_rank")


def rank_metrics(scored: DataFrame, probability: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, hit@1, hit@2 and mean rank (first place is 1) of the true class."""
    order = F.transform(ranked_classes(F.col(probability)), lambda s: s["idx"])
    place = scored.select(*by, (F.array_position(order, F.col(truth).cast("int")) - 1).alias("place"))
    rank = F.col("place")
    hit1 = F.avg((rank <= 0).cast("double"))
    return place.groupBy(*by).agg(
        hit1.alias("acc"), hit1.alias("hit_at_1"), F.avg((rank <= 1).cast("double")).alias("hit_at_2"),
        (F.avg(rank) + 1).alias("MR"))


def binary_long(df: DataFrame, scores: str, truth: str) -> DataFrame:
    """Arrays of class scores and 0/1 truths to ``(score, y)`` rows."""
    return df.select(F.explode(F.arrays_zip(F.col(scores).alias("score"), F.col(truth).alias("y"))).alias("p")).select(
        "p.score", "p.y")


def macro_scores(long: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Macro precision, recall and F1 over the two values, and element accuracy."""
    marked = long.select(*by, (F.col("score") > threshold).cast("int").alias("p"), F.col("y").cast("int").alias("y"))

    def count(p: int, y: int) -> Column:
        return F.count_if((F.col("p") == p) & (F.col("y") == y)).cast("double")

    cells = marked.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"),
                                    count(1, 0).alias("fp"), count(0, 1).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    # A value absent from truth and prediction is not averaged.
    has1, has0 = ((tp + fp + fn) > 0).cast("double"), ((tn + fp + fn) > 0).cast("double")

    def macro(one: Column, zero: Column) -> Column:
        return ratio(one * has1 + zero * has0, has1 + has0)

    return cells.select(
        *by, macro(ratio(tp, tp + fp), ratio(tn, tn + fn)).alias("precision"),
        macro(ratio(tp, tp + fn), ratio(tn, tn + fp)).alias("recall"),
        macro(ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def argmax_accuracy(df: DataFrame, tasks: dict[str, tuple[str, str]]) -> DataFrame:
    """Arg-max accuracy per task ``name -> (scores, one-hot truth)`` and their mean."""
    hits = {t: F.avg((argmax(F.col(p)) == argmax(F.col(y))).cast("double")) for t, (p, y) in tasks.items()}
    out = df.agg(*[h.alias(t) for t, h in hits.items()])
    if len(tasks) < 2:
        return out
    mean = sum((F.col(t) for t in tasks), F.lit(0.0)) / len(tasks)
    return out.withColumn("avg", mean)


def logit_loss(logit: Column, y: Column) -> Column:
    """Mean binary cross-entropy on logits, in the form that does not overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit))))
