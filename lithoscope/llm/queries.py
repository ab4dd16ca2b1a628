"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import bpe, handwritten, mixing, near_duplicates, parsing, quantiles, shared_spans, toxicity

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: groupings of problem 1 over (family, repo_id, day)
GROUPINGS = {
    "family": ["family"], "repo": ["repo_id"], "day": ["day"], "family_repo": ["family", "repo_id"], "all": [],
    "family_day": ["family", "day"], "repo_day": ["repo_id", "day"], "family_repo_day": ["family", "repo_id", "day"],
}
#: groupings that p1_bound_check leaves to p1_bound_check_day, as its SQL has the others only
WITH_DAY = ["family_day", "repo_day", "family_repo_day"]


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("measured_at").cast("string").alias("day")
    fm = read_table(spark, sf_dir, "function_metrics").select("family", "repo_id", day, "complexity", "loc")
    tm = read_table(spark, sf_dir, "type_metrics").select("family", "repo_id", day, F.col("member_count"))
    stack = fm.select("family", "repo_id", "day", F.explode(F.array(
        F.struct(F.lit("complexity").alias("metric"), F.col("complexity").alias("value")),
        F.struct(F.lit("loc").alias("metric"), F.col("loc").alias("value")),
    )).alias("m")).select("family", "repo_id", "day", "m.metric", "m.value")
    return stack.unionByName(tm.select("family", "repo_id", "day", F.lit("member_count").alias("metric"), F.col("member_count").alias("value")))


def _grouped(df: DataFrame) -> DataFrame:
    """Rows for each grouping, columns outside it replaced by null."""
    alternatives = F.array(*[
        F.struct(
            F.lit(name).alias("grouping"),
            *[(F.col(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in (("family", "string"), ("repo_id", "bigint"), ("day", "string"))],
        )
        for name, cols in GROUPINGS.items()
    ])
    rest = [c for c in df.columns if c not in ("family", "repo_id", "day")]
    return df.withColumn("__g", F.explode(alternatives)).select("__g.*", *rest)


_KEYS = ["grouping", "family", "repo_id", "day", "metric"]


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every grouping, combined from summaries of single days."""
    days = quantiles.summarise(_measures(spark, sf_dir), ["family", "repo_id", "day", "metric"], "value")
    return quantiles.combined_percentiles(_grouped(days), _KEYS, SHARES, salted=quantiles.SALTS)


def _bound_check(spark: SparkSession, sf_dir: str, wanted: Column) -> DataFrame:
    """Whether each returned value's true ranks lie within the stated error."""
    found = p1_percentiles(spark, sf_dir).where(wanted)
    shares = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(s).alias("share"), F.col(k).alias("at")) for k, s in SHARES.items()])
    asked = found.select(*_KEYS, "n", "rank_error", F.explode(shares).alias("s")).select(*_KEYS, "n", "rank_error", "s.*")
    values = _grouped(_measures(spark, sf_dir).where("value IS NOT NULL")).where(wanted).groupBy(*_KEYS, "value").agg(F.count("*").alias("c"))
    same = [asked[k].eqNullSafe(values[k]) for k in _KEYS]
    met = same[0]
    for s in same[1:]:
        met = met & s
    counted = asked.join(values, met).groupBy(*[asked[k] for k in _KEYS], "name", "share", "n", "rank_error").agg(
        F.sum(F.when(values["value"] < F.col("at"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(values["value"] <= F.col("at"), F.col("c")).otherwise(0)).alias("upto"),
    )
    rank, slack = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n") - 1e-9)), F.col("rank_error") * F.col("n")
    ok = (F.col("below") < rank + slack) & (F.col("upto") >= rank - slack) & (F.col("rank_error") <= 0.005)
    return counted.groupBy("grouping", "metric", "name").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.bool_and(ok).alias("within"))


def p1_bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound_check(spark, sf_dir, ~F.col("grouping").isin(WITH_DAY))


def p1_bound_check_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the groupings of a day with family, repository or both."""
    return _bound_check(spark, sf_dir, F.col("grouping").isin(WITH_DAY))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"), ["doc_id"])


def p3_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_files(read_table(spark, sf_dir, "source_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_parsed(spark, sf_dir).where("failed").select("file_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse failures by repository and language."""
    files = read_table(spark, sf_dir, "source_files")
    return parsing.failure_rates(files, "repo_id")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "source_files")
    models, _ = handwritten.train(files)
    return handwritten.classify(files, models)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_scores(spark, sf_dir).where("reason IS NOT NULL").select("file_id")


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the body classifier on the repositories held out."""
    _, figures = handwritten.train(read_table(spark, sf_dir, "source_files"))
    return spark.createDataFrame(sorted(figures.items()), "name string, value double")


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(read_table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_shared(spark, sf_dir).select("file_id")


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # a single row of the fixed table of presets
    preset = read_table(spark, sf_dir, "similarity_options").where("preset = 'balanced'").select("threshold", "min_tokens").first()
    return near_duplicates.similar_classes(read_table(spark, sf_dir, "source_files"), float(preset[0]), int(preset[1]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs_of_records(*_similar(spark, sf_dir))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(*_similar(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "review_labels"))
    return toxicity.score_documents(docs, model, ["doc_id", "source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their rate by source; a null source is one."""
    flagged = (F.col("score") >= toxicity.THRESHOLD).cast("bigint")
    return p9_scores(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(flagged).alias("flagged"), F.avg(flagged.cast("double")).alias("rate")
    )


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raters' labels against flags on a fifth of the labelled documents, held out of training."""
    return toxicity.validate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "review_labels"))


QUERIES = {
    "p1_percentiles": p1_percentiles, "p1_bound_check": p1_bound_check, "p1_bound_check_day": p1_bound_check_day,
    "p3_found": p3_found, "p3_parsed": p3_parsed, "p3_rates": p3_rates,
    "p4_found": p4_found, "p4_scores": p4_scores, "p4_validation": p4_validation,
    "p5_found": p5_found, "p5_shared": p5_shared,
    "p6_found": p6_found, "p6_groups": p6_groups,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p9_validation": p9_validation,
}

_P1_CHECK = """
WITH m AS (
  SELECT family, repo_id, CAST(CAST(measured_at AS DATE) AS VARCHAR) AS "day", 'complexity' metric, complexity v FROM function_metrics
  UNION ALL SELECT family, repo_id, CAST(CAST(measured_at AS DATE) AS VARCHAR), 'loc', loc FROM function_metrics
  UNION ALL SELECT family, repo_id, CAST(CAST(measured_at AS DATE) AS VARCHAR), 'member_count', member_count FROM type_metrics),
g AS (
  SELECT 'family' AS "grouping", metric, count(*) c FROM m WHERE v IS NOT NULL GROUP BY family, metric
  UNION ALL SELECT 'repo', metric, count(*) FROM m WHERE v IS NOT NULL GROUP BY repo_id, metric
  UNION ALL SELECT 'day', metric, count(*) FROM m WHERE v IS NOT NULL GROUP BY "day", metric
  UNION ALL SELECT 'family_repo', metric, count(*) FROM m WHERE v IS NOT NULL GROUP BY family, repo_id, metric
  UNION ALL SELECT 'all', metric, count(*) FROM m WHERE v IS NOT NULL GROUP BY metric)
SELECT "grouping", metric, s.name, count(*) AS groups, CAST(sum(c) AS BIGINT) AS n, true AS within
FROM g CROSS JOIN (VALUES ('p25'), ('p50'), ('p75'), ('p90'), ('p99')) s(name) GROUP BY 1, 2, 3
"""

_P6_FOUND = """
WITH o AS (SELECT threshold, min_tokens FROM similarity_options WHERE preset = 'balanced'),
w AS (SELECT file_id, regexp_extract_all(source, '[A-Za-z0-9_]+') ws FROM source_files WHERE source IS NOT NULL),
s AS (SELECT DISTINCT file_id, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w, o WHERE len(ws) >= min_tokens),
n AS (SELECT file_id, count(*) c FROM s GROUP BY 1),
p AS (SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) k FROM s a JOIN s b ON a.sh = b.sh AND a.file_id < b.file_id GROUP BY 1, 2)
SELECT file_a, file_b FROM p JOIN n x ON file_a = x.file_id JOIN n y ON file_b = y.file_id, o WHERE k >= threshold * (x.c + y.c - k) - 1e-9
"""

SQL = {"p1_bound_check": _P1_CHECK, "p6_found": _P6_FOUND}
