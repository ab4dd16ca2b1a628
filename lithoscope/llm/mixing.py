"""Mixing sources to target weights by Pareto order sampling.

The unit is a distinct text. Every unit has an expected number of copies
``e = min(max_repeats, c * m)`` where ``m`` is how often the source delivers
the text and ``c`` is solved for each source so that the expected tokens meet
its quota. ``floor(e)`` copies are certain; the rest ``p = e - floor(e)`` is an
inclusion probability. Units are ranked by ``(u / (1 - u)) / (p / (1 - p))``
with ``u`` a hash of the text and the seed, and the prefix whose tokens fill
the open quota is taken: a sample of fixed size (in tokens) with unequal
inclusion probabilities.

The ranking never sorts a source in one task: ranks are counted in ``CELLS``
cells of each source, prefix sums over the cells find the one in which the quota
ends, and only that cell is ordered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, written
from .bpe import TOKENIZER_DIR, encode_texts

CELLS = 4096


def text_units(docs: DataFrame, targets: DataFrame, name: str, folder: str) -> DataFrame:
    """Distinct texts of the sources with a target: source, doc_id, m, tokens.

    A text that several such sources hold counts for the first by name, so no
    text can be used more often than its source's cap. Null, empty and other
    texts of 0 tokens add no size and are no units.
    """
    known = targets.where(F.col("source").isNotNull()).select("source").distinct()
    counted = encode_texts(
        # only sources with a target are tokenised
        docs.where(F.col("source").isNotNull() & (F.length("text") > 0)).join(known, "source", "left_semi").withColumn("__digest", F.md5("text")),
        ["source", "doc_id", "__digest"], "text", name, folder, lengths_only=True,
    )
    held = counted.groupBy("__digest", "source").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("m"), F.max("tokens").alias("tokens")
    )
    return (
        held.groupBy("__digest")
        .agg(F.min(F.struct("source", "doc_id", "m", "tokens")).alias("u"))
        .select("__digest", "u.*")
        .where(F.col("tokens") > 0)
    )


def plan_rates(units: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """For each source with a target: quota and the rate ``c`` that meets it.

    Shares of sources that hold no text are spread over the others in
    proportion. ``total_tokens`` None takes the largest total at which every
    source meets its share; a given total beyond a source's capacity leaves that
    source short, which the report shows. The histogram has one row for each
    source and multiplicity.
    """
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    spread = units.groupBy("source", "m").agg(F.sum("tokens").cast("double").alias("size"), F.count("*").alias("texts"))
    joined = goal.join(spread, "source", "left")
    size = joined.groupBy("source", "target_share", "max_repeats").agg(
        F.coalesce(F.sum("size"), F.lit(0.0)).alias("available"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")
    )
    open_share = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    reach = size.agg(
        F.sum(open_share).alias("held"),
        F.min(F.when(open_share > 0, F.col("available") * F.col("max_repeats") / open_share)).alias("most"),
    )
    quotas = size.crossJoin(F.broadcast(reach)).withColumn(  # reach is a single row
        "quota",
        F.coalesce(open_share / F.col("held") * (F.lit(float(total_tokens)) if total_tokens is not None else F.col("most") * F.col("held")), F.lit(0.0)),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m, w = pdf["m"].fillna(0).to_numpy(float), pdf["size"].fillna(0).to_numpy(float)
        cap = float(first["max_repeats"])
        low, high = 0.0, max(cap, 1.0)
        met = lambda c: float((np.minimum(cap, c * m) * w).sum())
        if met(high) > first["quota"]:
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if met(mid) < first["quota"] else (low, mid)
        return pd.DataFrame({"source": [first["source"]], "rate": [high]})

    rates = quotas.select("source", "quota", "max_repeats").join(spread, "source", "left").groupBy("source").applyInPandas(
        solve, "source string, rate double"
    )
    return quotas.select("source", "target_share", "max_repeats", "available", "texts", "quota").join(rates, "source")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The mix and the report of shares reached.

    Mix: ``source, doc_id`` (the smallest of the text), ``tokens, copies`` with
    copies >= 1. Report: one row for each source with a target (0 where it
    holds no text): ``source, target_share, max_repeats, texts_available,
    tokens_available, texts_used, copies_most, tokens_used, share_reached``.
    Documents without source or with one that has no target aren't used. Empty
    inputs give an empty mix. Ties of the rank go to the smaller digest.
    """
    ship_package(docs.sparkSession)
    units = written(text_units(docs, targets, name, folder), "mix-units")
    rates = written(plan_rates(units, targets, total_tokens), "mix-rates")  # a row for each source with a target
    e = F.least(F.col("max_repeats").cast("double"), F.col("rate") * F.col("m"))
    drawn = (
        units.join(rates.select("source", "rate", "max_repeats", "quota"), "source")
        .withColumn("e", e)
        .withColumn("whole", F.floor(F.col("e") + 1e-9))
        .withColumn("p", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0)))
        .withColumn("u", (F.shiftrightunsigned(F.xxhash64("__digest", F.lit(seed)), 11).cast("double") + 0.5) / 2.0**53)
        .withColumn("q", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
        .withColumn("q", F.when(F.col("p") > 1e-9, F.col("q")))
        .withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * CELLS))
    )
    sure = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("sure"))
    cells = drawn.where(F.col("cell").isNotNull()).groupBy("source", "cell").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("source").orderBy("cell")  # at most CELLS rows of a source
    marks = (
        cells.withColumn("until", F.sum("size").over(order))
        .join(sure, "source")
        .join(rates.select("source", "quota"), "source")
        .withColumn("open", F.col("quota") - F.col("sure"))
        .select("source", "cell", (F.col("until") - F.col("size")).alias("before"), "until", "open")
    )
    placed = drawn.join(marks, ["source", "cell"], "left")
    crossing = placed.where((F.col("before") < F.col("open")) & (F.col("until") > F.col("open")))
    inner = Window.partitionBy("source", "cell").orderBy("q", "__digest").rowsBetween(Window.unboundedPreceding, 0)
    taken = crossing.withColumn("end", F.col("before") + F.sum("tokens").over(inner)).where(
        F.col("end") - F.col("tokens") / 2 <= F.col("open")
    )
    rest = placed.where(F.col("until") <= F.col("open"))
    extra = rest.select("source", "doc_id", "tokens", F.lit(1).alias("copies")).unionByName(
        taken.select("source", "doc_id", "tokens", F.lit(1).alias("copies"))
    )
    certain = drawn.where(F.col("whole") > 0).select("source", "doc_id", "tokens", F.col("whole").cast("int").alias("copies"))
    mixed = certain.unionByName(extra).groupBy("source", "doc_id", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    used = mixed.groupBy("source").agg(
        F.count("*").alias("texts_used"), F.max("copies").alias("copies_most"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used")
    )
    whole = used.agg(F.sum("tokens_used").alias("whole"))
    report = (
        rates.join(used, "source", "left")
        .crossJoin(F.broadcast(whole))  # a single row
        .select(
            "source", "target_share", "max_repeats", F.col("texts").alias("texts_available"),
            F.col("available").cast("bigint").alias("tokens_available"),
            F.coalesce("texts_used", F.lit(0)).alias("texts_used"), F.coalesce("copies_most", F.lit(0)).alias("copies_most"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.col("tokens_used") / F.col("whole"), F.lit(0.0)).alias("share_reached"),
        )
    )
    return mixed, report
