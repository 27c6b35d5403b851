"""Statistics over processed logs (log columns plus detection columns and ``classification``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.functions import dictionaries as fixed
from agentlog.operators.classify import cause_key, intent_outcome


def _anomalies(df: DataFrame) -> DataFrame:
    return df.where("is_anomaly")


def _type() -> Column:
    return F.col("classification.anomaly_type")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _label_counts(pairs: Column) -> Column:
    return F.map_from_entries(F.array_sort(pairs))


def stats(df: DataFrame) -> DataFrame:
    """Totals, anomaly rate and anomalies per type, in one pass. Anomalies without a type are counted as None."""
    kind = F.when(F.col("is_anomaly"), F.coalesce(_type(), F.lit("None")))
    cells = df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    # One entry per anomaly type.
    pairs = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n")))
    return cells.agg(
        total.alias("total_logs"),
        found.alias("anomaly_count"),
        _share(found, total).alias("anomaly_rate"),
        _label_counts(pairs).alias("type_distribution"),
    )


def recurring(df: DataFrame, min_count: int = 2) -> DataFrame:
    counts = _anomalies(df).groupBy(_type().alias("anomaly_type")).agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= min_count).orderBy(F.desc("count"), "anomaly_type")


LATEST_COLUMNS = [
    "log_id", "ts", "session_id", "protocol", "agent_id", "is_anomaly", "rule_lane_triggered",
    "embedding_lane_score", "embedding_lane_threshold", "arbitration_mode",
]


def latest(df: DataFrame, n: int = 10) -> DataFrame:
    """The n newest logs; type and confidence only for anomalies. Ties go to the first arrival."""
    rows = df.orderBy(F.desc("ts"), "arrival_seq").limit(n)
    shown = lambda c: F.when(F.col("is_anomaly"), c)
    return rows.select(
        *LATEST_COLUMNS,
        shown(_type()).alias("anomaly_type"),
        shown(F.col("classification.confidence")).alias("confidence"),
    )


def list_anomalies(df: DataFrame, anomaly_type: str | None = None, agent: str | None = None) -> DataFrame:
    """Anomalies, newest first, optionally of one type or agent."""
    rows = _anomalies(df)
    if anomaly_type:
        rows = rows.where(_type() == anomaly_type)
    if agent:
        rows = rows.where(F.col("agent_id") == agent)
    return rows.orderBy(F.desc("ts"), "arrival_seq").select(
        "log_id",
        "ts",
        "agent_id",
        "protocol",
        _type().alias("anomaly_type"),
        "anomaly_score",
        F.col("classification.confidence").alias("confidence"),
        "rule_lane_triggered",
        "embedding_lane_score",
        "embedding_lane_threshold",
        "arbitration_mode",
    )


def anomaly_detail(df: DataFrame, log_id: str) -> DataFrame:
    """The full row of one anomaly."""
    return _anomalies(df).where(F.col("log_id") == log_id)


def cognitive_stats(df: DataFrame, high_gap: float = 0.70) -> DataFrame:
    scored = intent_outcome(df)
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return scored.agg(
        F.count(F.lit(1)).alias("total_logs"),
        mean("gap_score").alias("avg_intent_outcome_gap"),
        mean("coherence_score").alias("avg_thought_action_coherence"),
        F.count_if(F.col("gap_score") >= high_gap).alias("high_gap_count"),
    )


def hourly(df: DataFrame) -> DataFrame:
    """Anomalies per hour from the first to the last hour with any; empty hours have 0, unknown times are dropped."""
    hours = (
        _anomalies(df)
        .where(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("anomalies"))
    )
    ends = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where(F.col("a").isNotNull())
    axis = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return axis.join(hours, "hour", "left").select("hour", F.coalesce("anomalies", F.lit(0)).alias("anomalies"))


def type_distribution(df: DataFrame, fixed_types: bool = False) -> DataFrame:
    """Anomalies per type; with fixed_types all four types and nothing else."""
    if fixed_types:
        totals = _anomalies(df).agg(
            *[F.count_if(_type() == t).alias(t) for t in fixed.ANOMALY_TYPES]
        )
        pairs = F.array(*[F.struct(F.lit(t).alias("anomaly_type"), F.col(t).alias("count")) for t in fixed.ANOMALY_TYPES])
        return totals.select(F.explode(pairs).alias("p")).select("p.*")
    known = _anomalies(df).where(_type().isNotNull())
    return known.groupBy(_type().alias("anomaly_type")).agg(F.count(F.lit(1)).alias("count"))


def lane_diagnostics(df: DataFrame) -> DataFrame:
    """Over the anomalies: rule-lane count, mean score and mean threshold, missing values as 0."""
    return _anomalies(df).agg(
        F.count_if(F.coalesce("rule_lane_triggered", F.lit(False))).alias("rule_lane_count"),
        F.avg(F.coalesce("embedding_lane_score", F.lit(0.0))).alias("avg_score"),
        F.avg(F.coalesce("embedding_lane_threshold", F.lit(0.0))).alias("avg_threshold"),
    )


def mode_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("arbitration_mode", F.lit("unknown")).alias("arbitration_mode")).agg(
        F.count(F.lit(1)).alias("count")
    )


def group_stats(df: DataFrame, by: str | None = None) -> DataFrame:
    """Logs, anomalies, rate and mean score of the anomalies."""
    total, found = F.count(F.lit(1)), F.count_if(F.col("is_anomaly"))
    mean = F.avg(F.when(F.col("is_anomaly"), F.coalesce("anomaly_score", F.lit(0.0))))
    return df.groupBy(*([by] if by else [])).agg(
        total.alias("logs"),
        found.alias("anomalies"),
        _share(found, total).alias("anomaly_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_anomaly_score"),
    )


def lane_summary(df: DataFrame) -> DataFrame:
    """Lane diagnostics of a whole group with the counts per mode, in one pass."""
    cells = df.groupBy(F.coalesce("arbitration_mode", F.lit("unknown")).alias("mode")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_anomaly").alias("found"),
        F.count_if(F.coalesce("rule_lane_triggered", F.lit(False))).alias("by_rule"),
        F.sum(F.coalesce("embedding_lane_score", F.lit(0.0))).alias("score"),
        F.sum(F.coalesce("embedding_lane_threshold", F.lit(0.0))).alias("threshold"),
    )
    n, found = F.sum("n"), F.sum("found")
    return cells.agg(
        n.alias("total_logs_analysed"),
        found.alias("anomalies_found"),
        F.bround(_share(found, n) * 100.0, 2).alias("anomaly_density_pct"),
        F.sum("by_rule").alias("rule_lane_triggered_count"),
        F.bround(F.sum("score") / n, 4).alias("avg_embedding_lane_score"),
        F.bround(F.sum("threshold") / n, 4).alias("avg_embedding_lane_threshold"),
        _label_counts(F.collect_list(F.struct("mode", "n"))).alias("by_arbitration_mode"),
    )


def histogram(df: DataFrame, column: str = "anomaly_score", bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the largest belongs to the last bin."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    ends = values.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # A scalar subquery: two numbers reach the rows, nothing is joined.
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    place = F.when(b > a, F.least(F.floor((F.col("x") - a) / (b - a) * bins), F.lit(bins - 1))).otherwise(0)
    counted = values.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def cause_table(df: DataFrame) -> DataFrame:
    """One row per anomaly: type, cause key, root and reason."""
    reason = F.col("classification.reasoning")
    key = cause_key(
        _type(), F.coalesce("tool_name", "target_agent"), F.coalesce("event", "message_type"), reason
    )
    return _anomalies(df).select(
        "log_id",
        _type().alias("anomaly_type"),
        key.alias("cause_key"),
        F.coalesce("root_cause_log_id", F.lit("n/a")).alias("root_cause_log_id"),
        F.coalesce(F.nullif(reason, F.lit("")), F.lit("rule_match")).alias("reason"),
    )


def top_causes(causes: DataFrame, n: int = 30) -> DataFrame:
    counts = causes.groupBy("cause_key").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "cause_key").limit(n)
