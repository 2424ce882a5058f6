"""Batch scoring that may be stopped and started again.

A model call is neither free nor repeatable, so answers go to a ledger in shared
storage as they come. A run asks only what the ledger does not hold, in commits of
bounded size: a lost executor repeats the unit it was working on, a lost driver
the commit that was open, and nothing that was committed is asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .prompts import RUN_FIELDS, Model, batch_infer

ANSWERS = RUN_FIELDS.replace("status string", "status string, digest string, stage string")


def request_digest(stage: str, prompt: Column) -> Column:
    """Name of a request: equal prompts of a stage are one request, NULL is not the empty text."""
    return F.sha2(F.concat(F.lit(f"{len(stage)}:{stage}:"), F.when(prompt.isNull(), "0").otherwise(F.concat(F.lit("1"), prompt))), 256)


def recorded_answers(requests: DataFrame, ledger: str, retry_failed: bool = True) -> DataFrame:
    """Best record of each request digest in the ledger; failed ones only if they are not to be asked again."""
    spark = requests.sparkSession
    # An empty append creates the folder of a first run and changes nothing later.
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(ledger)
    rows = spark.read.schema(ANSWERS).parquet(ledger)
    rows = rows.where("status = 'success'") if retry_failed else rows
    best = F.struct((F.col("status") == "success").alias("ok"), *[c for c in rows.columns if c != "digest"])
    return rows.groupBy("digest").agg(F.max(best).alias("r")).select("digest", "r.*").drop("ok")


def answer_once(requests: DataFrame, model: Model, ledger: str, prompt: str = "prompt", stage: str = "stage",
                retries: int = 3, retry_failed: bool = True, unit: int = 64, units: int = 256) -> DataFrame:
    """``batch_infer`` with a memory: rows of ``requests`` with the answer the ``ledger`` folder holds.

    Each distinct prompt without an answer is asked once. ``units`` tasks of about
    ``unit`` requests make one commit. Failed requests stay in the ledger and are asked
    again by the next run unless ``retry_failed`` is off. Of several records of a request (two
    runs at the same time) a successful one counts. Repeated rows share their answer, a
    NULL prompt is a request of its own, an empty table asks nothing. ``requests`` must
    not have columns named like the record's.
    """
    spark = requests.sparkSession
    named = requests.withColumn("digest", request_digest(stage, F.col(prompt)))
    held = recorded_answers(requests, ledger, retry_failed)
    todo = (named.select("digest", F.col(prompt).alias("prompt")).dropDuplicates(["digest"])
            .join(held.select("digest"), "digest", "left_anti"))
    todo = materialize(todo, "unanswered")
    commits = -(-todo.count() // (unit * units))
    if commits:
        path = scratch_path(spark, "commits")
        (todo.withColumn("commit", F.pmod(F.xxhash64("digest"), F.lit(commits))).repartition("commit")
         .write.partitionBy("commit").parquet(path))
        waiting = spark.read.schema(todo.schema.add("commit", "long")).parquet(path)
    for number in range(commits):
        part = waiting.where(F.col("commit") == number).drop("commit").repartition(units, "digest")
        (batch_infer(part, model, "prompt", stage, retries).drop("prompt")
         .select(*spark.createDataFrame([], ANSWERS).columns).write.mode("append").parquet(ledger))
    # Written, so that a prompt that many rows share meets a plain side, which Spark splits.
    answers = materialize(recorded_answers(requests, ledger, False), "answers")
    return named.join(answers, "digest").drop("digest")
