"""Scoring of customers, checks on the scores, request routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesync.operators import score
from lakesync.operators.score import Feature, ScoreSpec
from lakesync.operators.sync import StreamSpec, enrich, raw_envelope
from lakesync.queries.registry import query, table
from lakesync.queries.sources import RUN_AT

SPEC = ScoreSpec(
    "likely", (
        Feature("segment", 2.0, score_if_set=1.0, default=0.1),
        Feature("c_acctbal", 3.0, score_if_gt=1.0, threshold=4000.0, default=0.25),
        Feature("c_nationkey", 1.0, score_if_set=0.5),
        Feature("missing", 1.5, score_if_set=1.0, default=0.3),
        Feature("c_name", 0.5, score_if_gt=1.0, threshold=-1.0),
    ),
)

_SCORE = """(0.0::DOUBLE + 2.0::DOUBLE * (CASE WHEN c_custkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)
    + 3.0::DOUBLE * (CASE WHEN c_acctbal > 4000 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END)
    + 1.0::DOUBLE * (CASE WHEN c_nationkey <> 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)
    + 1.5::DOUBLE * 0.3::DOUBLE + 0.5::DOUBLE * 1.0::DOUBLE) / 8.0::DOUBLE"""


def contacts(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").withColumns(
        {
            "segment": F.when(key % 3 != 0, F.col("c_mktsegment")).when(key % 2 == 0, ""),
            "_sync_raw_id": F.format_string("run1:%012d", key),
        }
    )


@query("score_weighted", f"SELECT c_custkey, {_SCORE} AS _score FROM customer")
def score_weighted(spark, sf_dir):
    rows = contacts(spark, sf_dir)
    return rows.select("c_custkey", score.weighted_score(SPEC, rows.schema).alias("_score"))


@query("score_rank", f"""
    SELECT c_custkey, s AS _score, row_number() OVER (ORDER BY s DESC, printf('run1:%012d', c_custkey)) AS _score_rank
    FROM (SELECT c_custkey, {_SCORE} AS s FROM customer)
""")
def score_rank(spark, sf_dir):
    scored = score.score(contacts(spark, sf_dir), SPEC, RUN_AT).select("c_custkey", "_score", "_sync_raw_id")
    return score.rank_scored(scored).drop("_sync_raw_id")


@query("score_output", f"""
    SELECT c_custkey, c_name, c_acctbal, {_SCORE} AS _score, 'deterministic' AS _score_mode, 'likely' AS _score_spec, '{RUN_AT}' AS _scored_at
    FROM customer
""")
def score_output(spark, sf_dir):
    scored = score.score(contacts(spark, sf_dir), SPEC, RUN_AT)
    return scored.drop("c_nationkey", "c_mktsegment", "segment", "_sync_raw_id")


@query("score_from_raw_history", f"""
    SELECT c_custkey, {_SCORE} AS _score, true AS has_raw_id FROM customer
""")
def score_from_raw_history(spark, sf_dir):
    bare = contacts(spark, sf_dir).drop("_sync_raw_id")
    raw = raw_envelope(enrich(bare, "run1", RUN_AT), StreamSpec("contacts"), "run1", 1, RUN_AT)
    records = score.records_of(raw)
    scored = score.score(records, SPEC, RUN_AT)
    return scored.select("c_custkey", "_score", F.col("_sync_raw_id").startswith("run1:").alias("has_raw_id"))


@query("score_validate", """
    SELECT c AS source, chk, passed FROM (VALUES
        ('whole', 'schema.required', true), ('whole', 'score.range', true), ('whole', 'result.rowcount', true),
        ('whole', 'card.equality', true), ('whole', 'ref.coverage', true), ('whole', 'ref.no_dupes', true),
        ('whole', 'ref.no_orphans', true), ('whole', 'dist.not_degenerate', true),
        ('broken', 'schema.required', true), ('broken', 'score.range', false), ('broken', 'result.rowcount', true),
        ('broken', 'card.equality', false), ('broken', 'ref.coverage', false), ('broken', 'ref.no_dupes', false),
        ('broken', 'ref.no_orphans', false), ('broken', 'dist.not_degenerate', true)) t(c, chk, passed)
    WHERE (SELECT count(*) FROM customer) > 0
""")
def score_validate(spark, sf_dir):
    source = contacts(spark, sf_dir)
    result = score.score(source, SPEC, RUN_AT)
    key = F.col("c_custkey")
    # Lost rows, a stray id, copies, and a score out of range.
    damaged = result.where(key % 5 != 0).withColumns(
        {
            "_sync_raw_id": F.when(key % 7 == 1, "stray").otherwise(F.col("_sync_raw_id")),
            "_score": F.when(key % 11 == 2, 1.5).otherwise(F.col("_score")),
        }
    )
    parts = [
        score.validate_scores(source, r).withColumn("source", F.lit(n)) for n, r in (("whole", result), ("broken", damaged))
    ]
    return parts[0].unionByName(parts[1])


# The words in the SQL are written out, so that the lists of the operator are checked too.
@query("route_requests", """
    WITH r AS (SELECT conv_id, turn, lower(coalesce(text, '') || CASE conv_id % 4 WHEN 0 THEN ' Forecast churn with a random forest'
                   WHEN 1 THEN ' Compare growth, rolling by month' WHEN 2 THEN ' JOIN the share of top contributors' ELSE '' END) AS t FROM conversations),
    h AS (SELECT conv_id, turn, list_filter(['train', 'predict', 'prediction', 'forecast', 'classify', 'classification', 'regression',
              'cluster', 'clustering', 'segment customers', 'anomaly', 'accuracy', 'precision', 'recall', 'f1', 'cross-validation',
              'feature importance', 'logistic', 'random forest', 'naive bayes', 'svm', 'decision tree', 'neural network', 'churn',
              'recommend', 'recommendation', 'propensity'], lambda w: contains(t, w)) AS ml,
          list_filter(['correlat', 'trend', 'cohort', 'distribution', 'group by', 'aggregate', 'average over', 'compare', 'comparison',
              'percentile', 'growth', 'retention', 'funnel', 'join', 'across tables', 'month over month', 'year over year', 'breakdown',
              'rolling', 'moving average', 'bus factor', 'concentration', 'gini', 'contribution', 'contributor', 'key people',
              'key contributors', 'share of', 'top contributors'], lambda w: contains(t, w)) AS an FROM r)
    SELECT conv_id, turn, CASE WHEN len(ml) > 0 THEN 'ml' WHEN len(an) > 0 THEN 'data_analysis' ELSE 'simple_query' END AS task,
           CASE WHEN len(ml) > 0 THEN 0.6::DOUBLE WHEN len(an) > 0 THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
           array_to_string(CASE WHEN len(ml) > 0 THEN ml ELSE an END, ',') AS key_indicators
    FROM h
""")
def route_requests(spark, sf_dir):
    """The texts as they are, three in four with a sentence added that holds listed words."""
    kind = F.col("conv_id") % 4
    tail = (
        F.when(kind == 0, " Forecast churn with a random forest").when(kind == 1, " Compare growth, rolling by month")
        .when(kind == 2, " JOIN the share of top contributors").otherwise("")
    )
    talks = table(spark, sf_dir, "conversations").withColumn("request", F.concat(F.coalesce("text", F.lit("")), tail))
    routed = score.route_requests(talks, "request")
    return routed.select("conv_id", "turn", "task", "confidence", F.array_join("key_indicators", ",").alias("key_indicators"))
