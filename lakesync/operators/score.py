"""Declarative scoring, checks on the scored table, and request routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakesync.functions.values import is_non_empty
from lakesync.operators.ordered import row_index


@dataclass(frozen=True)
class Feature:
    name: str
    weight: float
    score_if_set: float = 0.0
    score_if_gt: float | None = None
    threshold: float | None = None
    default: float = 0.0


@dataclass(frozen=True)
class ScoreSpec:
    name: str
    features: tuple[Feature, ...]

    def check(self) -> None:
        if not self.name:
            raise ValueError("the spec needs a name")
        if not self.features:
            raise ValueError("the spec needs a feature")
        for feature in self.features:
            if feature.weight < 0:
                raise ValueError(f"weight of {feature.name!r} is below zero")
            if feature.score_if_gt is not None and feature.threshold is None:
                raise ValueError(f"{feature.name!r} compares with no threshold")


def feature_score(feature: Feature, schema: T.StructType) -> Column:
    """Score of one feature before its weight."""
    default = F.lit(float(feature.default))
    if feature.name not in schema.names:
        return default
    col, dtype = F.col(f"`{feature.name}`"), schema[feature.name].dataType
    if feature.score_if_set != 0:
        return F.when(is_non_empty(col, dtype), F.lit(float(feature.score_if_set))).otherwise(default)
    if feature.score_if_gt is not None and feature.threshold is not None:
        number = col.cast("double") if isinstance(dtype, T.NumericType) else F.lit(0.0)
        above = col.isNotNull() & (F.coalesce(number, F.lit(0.0)) > float(feature.threshold))
        return F.when(above, F.lit(float(feature.score_if_gt))).otherwise(default)
    return default


def weighted_score(spec: ScoreSpec, schema: T.StructType) -> Column:
    """Weighted mean of the feature scores, summed in spec order."""
    spec.check()
    total = sum(f.weight for f in spec.features)
    if total <= 0:
        return F.lit(0.0)
    raw = reduce(
        lambda a, b: a + b,
        (F.lit(float(f.weight)) * feature_score(f, schema) for f in spec.features),
        F.lit(0.0),
    )
    return raw / F.lit(float(total))


def score(df: DataFrame, spec: ScoreSpec, scored_at: str, mode: str = "deterministic") -> DataFrame:
    """All source columns with score, mode, spec name and time."""
    return df.withColumns(
        {
            "_score": weighted_score(spec, df.schema),
            "_score_mode": F.lit(mode),
            "_score_spec": F.lit(spec.name),
            "_scored_at": F.lit(scored_at),
        }
    )


def rank_scored(scored: DataFrame, raw_id: str = "_sync_raw_id") -> DataFrame:
    """Rank by score descending, then raw id; the sort is by range, not in one task."""
    ranked = row_index(scored, [F.desc("_score"), F.asc(raw_id)], out="_score_rank")
    return ranked.withColumn("_score_rank", F.col("_score_rank") + 1)


def records_of(df: DataFrame, raw_id: str = "_sync_raw_id") -> DataFrame:
    """Bare records from either raw envelopes or bare rows; the raw id comes along."""
    if "record" not in df.columns:
        return df
    own = df.schema["record"].dataType.names
    taken = [F.col("record.*")]
    if raw_id in df.columns and raw_id not in own:
        taken.append(F.col(raw_id))
    return df.select(*taken)


def validate_scores(
    source: DataFrame, result: DataFrame, raw_id: str = "_sync_raw_id", value: str = "_score"
) -> DataFrame:
    """Eight named checks; a check that evaluates to null fails.

    Needs one aggregate over the result and one count per raw id over both sides.
    """
    named = raw_id in result.columns and value in result.columns
    if not named:
        return _verdicts(source.sparkSession.range(1), {"schema.required": F.lit(False)})
    number = F.col(value).cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    bad = (number < 0) | (number > 1) | number.isNull() | F.isnan(number) | infinite
    stats = result.agg(
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"),
        (F.min(number) < F.max(number)).alias("varies"),
        F.stddev_pop(number).alias("spread"),
    )
    sides = source.select(F.col(raw_id).alias("id"), F.lit(1).alias("i"), F.lit(0).alias("r")).unionByName(
        result.select(F.col(raw_id).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("r"))
    )
    per_id = sides.groupBy("id").agg(F.sum("i").alias("i"), F.sum("r").alias("r"))
    matched = F.col("id").isNotNull() & (F.col("i") > 0) & (F.col("r") > 0)
    refs = per_id.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_out"),
        F.count_if((F.col("i") > 0) & ~matched).alias("missing"),
        F.count_if(F.col("r") > 1).alias("dupes"),
        F.count_if((F.col("r") > 0) & ~matched).alias("orphans"),
    )
    both = refs.withColumn("__s", stats.select(F.struct(*stats.columns)).scalar()).select("*", "__s.*")
    return _verdicts(
        both,
        {
            "schema.required": F.lit(True),
            "score.range": F.col("bad") == 0,
            "result.rowcount": F.col("n_out") > 0,
            "card.equality": F.col("n_in") == F.col("n_out"),
            "ref.coverage": F.col("missing") == 0,
            "ref.no_dupes": F.col("dupes") == 0,
            "ref.no_orphans": F.col("orphans") == 0,
            "dist.not_degenerate": F.col("varies") & (F.col("spread") > 1e-9),
        },
    )


def _verdicts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("chk"), F.coalesce(ok, F.lit(False)).alias("passed"))
            for name, ok in checks.items()
        )
    )
    return df.select(F.inline(rows))


# Words that route a request, in reporting order.
ML_WORDS = (
    "train", "predict", "prediction", "forecast", "classify", "classification", "regression",
    "cluster", "clustering", "segment customers", "anomaly", "accuracy", "precision", "recall",
    "f1", "cross-validation", "feature importance", "logistic", "random forest", "naive bayes",
    "svm", "decision tree", "neural network", "churn", "recommend", "recommendation", "propensity",
)
ANALYSIS_WORDS = (
    "correlat", "trend", "cohort", "distribution", "group by", "aggregate", "average over",
    "compare", "comparison", "percentile", "growth", "retention", "funnel", "join",
    "across tables", "month over month", "year over year", "breakdown", "rolling",
    "moving average", "bus factor", "concentration", "gini", "contribution", "contributor",
    "key people", "key contributors", "share of", "top contributors",
)


def route_requests(df: DataFrame, text: str) -> DataFrame:
    """Task, confidence and matched words of each request text."""
    def hits(words: Sequence[str]) -> Column:
        return F.array_compact(F.array(*(F.when(F.contains(F.col("__low"), F.lit(w)), F.lit(w)) for w in words)))

    lowered = df.withColumn("__low", F.lower(F.col(text)))
    marked = lowered.withColumns({"__ml": hits(ML_WORDS), "__an": hits(ANALYSIS_WORDS)}).drop("__low")
    is_ml, is_analysis = F.size("__ml") > 0, F.size("__an") > 0
    return marked.withColumns(
        {
            "task": F.when(is_ml, "ml").when(is_analysis, "data_analysis").otherwise("simple_query"),
            "confidence": F.when(is_ml, 0.6).when(is_analysis, 0.55).otherwise(0.5),
            "key_indicators": F.when(is_ml, F.col("__ml")).otherwise(F.col("__an")),
        }
    ).drop("__ml", "__an")
