"""End-to-end plans: corpus to training tables, scoring, batch evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as js
from ..operators import evaluate as ev
from ..operators import labels as lb
from ..operators import models as ml
from ..operators import prep
from ..operators import profile as pr
from ..operators import prompts as pt
from ..operators.ledger import answer_once
from ..operators import relational as rl
from ..operators import sampling as sm
from ..session import materialize
from ..sources import corpus as co


def corpus_features(raw: DataFrame, max_fields: int | None = None, label_mode: str = "reference",
                    quantile_scale: str = "reference") -> tuple[DataFrame, DataFrame]:
    """Feature rows and outcome rows of a raw corpus, written: finding the first row of a field reads them twice."""
    charts = materialize(co.clean_corpus(co.parse_corpus(raw), max_fields), "charts")
    return (pr.profile_columns(co.corpus_cells(charts), quantile_scale),
            materialize(lb.field_outcomes(charts, label_mode), "outcomes"))


def prepare_training(features: DataFrame, outcomes: DataFrame, numeric: Sequence[str], seed: str = "",
                     train_share: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and test tables and the clip bounds learned on the training part."""
    labels = outcomes.select("field_id", "fid", "trace_type", "is_xsrc", "is_ysrc")
    joined = rl.known_traces(rl.labeled_features(features, labels))
    joined = joined.withColumn("is_x_or_y", lb.axis_role(F.col("is_xsrc"), F.col("is_ysrc")))
    flags = [f.name for f in joined.schema.fields if f.dataType.simpleString() == "boolean"]
    ready = materialize(prep.fill_flags(joined, flags), "training")
    split = sm.assign_split(ready, "fid", {"train": train_share, "test": 1 - train_share}, seed)
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")
    bounds = materialize(prep.fit_bounds(train, numeric), "bounds")
    return prep.apply_bounds(train, bounds), prep.apply_bounds(test, bounds), bounds


def training_tables(raw: DataFrame, numeric: Sequence[str], seed: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    features, outcomes = corpus_features(raw)
    return prepare_training(features, outcomes, numeric, seed)


def score_tables(cells: DataFrame, model: PipelineModel, bounds: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Predicted chart types of new, unlabeled columns with the saved bounds."""
    features = pr.profile_columns(cells)
    flags = [f.name for f in features.schema.fields if f.dataType.simpleString() == "boolean"]
    ready = prep.apply_bounds(prep.fill_flags(features, flags, as_number=True), bounds)
    return ml.predict(model, ready.select("fid", "field_id", *inputs))


def run_stage(requests: DataFrame, stage: str, model: pt.Model, schemas: DataFrame | None = None,
              ledger: str | None = None) -> DataFrame:
    """Prompts, model answers and parsed answers of one stage, kept as a record table.

    The answers are written before they are read again: a model call is neither
    free nor repeatable. With a ``ledger`` folder a stopped run goes on where it was.
    """
    prompted = pt.stage_prompts(requests, stage, schemas)
    if ledger:
        runs = answer_once(prompted, model, ledger, stage=stage)
    else:
        runs = materialize(pt.batch_infer(prompted, model, stage=stage), f"stage_{stage}")
    # Written: a filter on ``valid`` would be pushed through the parse and repeat its steps beyond measure.
    return materialize(js.parse_responses(runs, "raw_response"), f"parsed_{stage}")


def evaluate_batch(cases: DataFrame, run: str = "run_id", order: str = "test_case_id", interval: int = 10,
                   variant: str = "v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged cases, chunk reports and the overall summary."""
    judged = ev.evaluate_cases(cases, variant)
    return judged, ev.chunk_reports(judged, run, order, interval), ev.summary(judged)
