"""Mixing sources to target weights, in DataFrame operations only.

Source token shares are raised to an exponent (the inverse temperature) and normalised.
The exponent is bisected, many points a pass, to the largest that reaches the wanted
entropy and keeps within the repetition limit. Each source's token quota is then dealt as
passes over its documents: every pass is a new permutation of the source's blocks, and
the last pass stops where the quota is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colscope.session import materialize

STEPS = 10_000
SECTIONS = 10
SUPERS = 256
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; NULL and blank have none."""
    body = F.regexp_replace(F.regexp_replace(text, f"^{SPACE}", ""), f"{SPACE}$", "")
    return F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.size(F.split(body, SPACE, -1))).cast("long")


def hash60(*parts: Column | str) -> Column:
    """The first 15 hex digits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """``source``, ``tokens`` and ``share`` of the sources that hold tokens."""
    sums = materialize(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.withColumn("total", F.lit(total).cast("long")).withColumn("share", F.col("tokens") / F.col("total"))


def _measures(sources: DataFrame, steps: list[int]) -> dict[int, tuple[float, float]]:
    """Entropy and repetitions per unit of budget over tokens, at each exponent."""
    power = F.pow("share", F.col("step") / STEPS)
    rows = (sources.select("share", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
            .groupBy("step").agg(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("l"),
                                 F.max(power / F.col("share")).alias("m")).collect())
    return {r.step: (math.log(r.z) - r.step / STEPS * r.l / r.z, r.m / r.z) for r in rows}


def _largest(sources: DataFrame, good) -> int:
    """Largest step whose measures are good; good ones come first. -1 if none is."""
    low, high = -1, STEPS + 1
    while high - low > 1:
        steps = sorted({low + (high - low) * i // SECTIONS for i in range(1, SECTIONS)} - {low, high} or {low + 1})
        got = _measures(sources, [s for s in steps if 0 <= s <= STEPS])
        for s in sorted(got):
            if good(got[s]):
                low = s
            else:
                high = s
                break
        else:
            low = max(got)
    return low


def exponent(sources: DataFrame, budget_share: float, entropy: float, repeats: float) -> tuple[int, float]:
    """Exponent in ten-thousandths, and the share of the corpus's tokens to deal.

    The largest exponent up to 1 whose entropy is at least ``entropy`` of the most
    possible. If some source would be repeated more than ``repeats`` times there, the
    smallest exponent within that limit instead: the limit wins. A budget beyond
    ``repeats`` times the corpus is cut to that.
    """
    at = _measures(sources, [0])
    budget = min(budget_share, repeats)
    if not at:
        return STEPS, budget
    step = max(0, _largest(sources, lambda m: m[0] >= entropy * at[0][0] - 1e-9))
    over = _largest(sources, lambda m: budget * m[1] > repeats + 1e-9)
    return max(step, min(over + 1, STEPS)), budget


def mix_sources(docs: DataFrame, budget_share: float = 1.0, entropy: float = 0.95, repeats: float = 4.0,
                block_tokens: int = 200_000, seed: str = "mix") -> DataFrame:
    """Which documents to read how often, and in which order.

    Returns a row per document and pass: ``doc_id``, ``source``, ``tokens``, ``pass`` (0
    is the first), ``block``, ``place`` (tokens of the source before it in the pass) and
    ``slot`` in 0 to 1; reading by slot interleaves the sources at their weights. The last
    document of a source may pass its quota by less than its own length. Tokens are words
    between ASCII white space. NULL is a source of its own; documents without tokens are
    not dealt; rows of one id are documents of their own. An empty table gives no rows.
    Other columns are ignored, whatever their names.

    Everything per document is a hash, an aggregate or a window over one block of about
    ``block_tokens``; blocks are put in order in two levels, so no source, however large,
    meets in one task. The hash takes in the text, so that rows of one id, or without one,
    spread over the blocks too.
    """
    name = hash60(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.col("text").cast("binary")))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("source"),
                         n_words(F.col("text")).alias("tokens"), name.alias("h")).where("tokens > 0")
    narrow = materialize(narrow, "mix-docs")
    sources = source_totals(narrow)
    step, budget = exponent(sources, budget_share, entropy, repeats)
    power = F.pow("share", F.lit(step / STEPS))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    quotas = sources.select(
        "source", F.col("tokens").alias("all"), F.round(F.lit(budget) * F.col("total") * power / F.lit(z)).cast("long").alias("quota"),
        F.ceil(F.col("tokens") / block_tokens).alias("blocks"))
    dealt = narrow.join(quotas.select("source", "blocks"), "source").withColumn("block", F.pmod("h", F.col("blocks")))
    inner = W.partitionBy("source", "block").orderBy("h", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    passes = (dealt.groupBy("source", "block").agg(F.sum("tokens").alias("held")).join(quotas, "source")
              .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("all")))))
              .withColumn("r", hash60(F.lit(seed), "source", F.col("pass").cast("string"), F.col("block").cast("string"))))
    passes = passes.withColumn("super", F.floor(F.col("r") * F.lit(float(SUPERS)) / F.lit(float(1 << 60))))
    over = W.partitionBy("source", "pass").orderBy("super").rowsBetween(W.unboundedPreceding, -1)
    supers = (passes.groupBy("source", "pass", "super").agg(F.sum("held").alias("sum"))
              .withColumn("base", F.coalesce(F.sum("sum").over(over), F.lit(0))).drop("sum"))
    within = W.partitionBy("source", "pass", "super").orderBy("r", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = (passes.join(supers, ["source", "pass", "super"])
              .withColumn("start", F.col("base") + F.coalesce(F.sum("held").over(within), F.lit(0)))
              .where("quota > 0 and pass * all + start < quota").select("source", "block", "pass", "start", "all", "quota"))
    out = placed.join(starts, ["source", "block"]).withColumn("place", F.col("start") + F.col("before")).where("pass * all + place < quota")
    return out.select("doc_id", F.when(F.col("source") != "-", F.expr("substring(source, 2)")).alias("source"), "tokens", "pass", "block",
                      "place", F.round((F.col("pass") * F.col("all") + F.col("place")) / F.col("quota"), 9).alias("slot"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce('s' || source, '-') AS source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(text)), 1, 15))::BIGINT AS h
  FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0),
sources AS (
  SELECT source, sum(tokens)::BIGINT AS n, sum(tokens) / sum(sum(tokens)) OVER () AS share, sum(sum(tokens)) OVER ()::BIGINT AS total
  FROM docs GROUP BY source),
grid AS (
  SELECT step, ln(sum(pow(share, step / 10000.0::DOUBLE))) - step / 10000.0::DOUBLE * sum(pow(share, step / 10000.0::DOUBLE) * ln(share))
         / sum(pow(share, step / 10000.0::DOUBLE)) AS entropy,
         max(pow(share, step / 10000.0::DOUBLE) / share) / sum(pow(share, step / 10000.0::DOUBLE)) AS repeats
  FROM sources, range(0, 10001) g(step) GROUP BY step),
chosen AS (
  SELECT greatest(coalesce((SELECT max(step) FROM grid WHERE entropy >= 0.95 * (SELECT entropy FROM grid WHERE step = 0) - 1e-9), 0),
                  least(coalesce((SELECT max(step) FROM grid WHERE repeats > 4.0 + 1e-9), -1) + 1, 10000)) AS step),
quotas AS (
  SELECT source, n, round(total * pow(share, step / 10000.0::DOUBLE) / sum(pow(share, step / 10000.0::DOUBLE)) OVER ())::BIGINT AS quota,
         ceil(n / 200000.0)::BIGINT AS blocks
  FROM sources, chosen),
dealt AS (
  SELECT docs.*, n, quota, h % blocks AS block,
         coalesce(sum(tokens) OVER (PARTITION BY docs.source, h % blocks ORDER BY h, doc_id, tokens
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs JOIN quotas USING (source)),
passes AS (
  SELECT source, block, pass, held, coalesce(sum(held) OVER (PARTITION BY source, pass ORDER BY r, block
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT source, block, held, pass, ('0x' || substr(md5('mix:' || source || ':' || pass || ':' || block), 1, 15))::BIGINT AS r
        FROM (SELECT source, block, sum(tokens) AS held, unnest(range(0, (max(quota) - 1) // max(n) + 1)) AS pass
              FROM dealt GROUP BY source, block)))
SELECT doc_id, CASE WHEN source <> '-' THEN substr(source, 2) END AS source, tokens, pass, block, start + before AS place,
       round((pass * n + start + before) / quota, 9) AS slot
FROM dealt JOIN passes USING (source, block) WHERE pass * n + start + before < quota
"""
