"""Evaluation of detectors and classifiers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.functions.skew import running_before

# Thresholds of the sweep: start + i * step, with the step as floating point arithmetic gives it.
SWEEP_START, SWEEP_POINTS = 0.20, 41
_STEP = (0.20 + 0.01) - 0.20
TAUS = [SWEEP_START + i * _STEP for i in range(SWEEP_POINTS)]


def _ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def sweep_points(df: DataFrame, by: str | None = None) -> DataFrame:
    """F1 per threshold. Rows are reduced to counts per score interval first, so there are at most 42 x 2 cells."""
    keys = [by] if by else []
    taus = F.array(*[F.lit(t) for t in TAUS])
    # The number of thresholds a score exceeds says at which of them the row is predicted positive.
    passed = F.size(F.filter(taus, lambda t: t < F.col("score")))
    cells = df.groupBy(*keys, passed.alias("passed")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    above = F.explode(F.sequence(F.lit(0), F.lit(SWEEP_POINTS - 1))).alias("i")
    at = cells.select(*keys, "passed", "pos", "neg", above)
    predicted = F.col("passed") > F.col("i")
    total = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    counts = at.groupBy(*keys, "i").agg(
        total("pos", predicted).alias("tp"), total("neg", predicted).alias("fp"), total("pos", ~predicted).alias("fn")
    )
    return counts.select(
        *keys,
        F.element_at(taus, F.col("i") + 1).alias("tau"),
        f1_score(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
    )


def threshold_sweep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Best threshold (two places) and its F1, overall or per group; the lowest threshold wins ties."""
    keys = [by] if by else []
    best = F.max(F.struct("f1", (-F.col("tau")).alias("neg_tau")))
    return (
        sweep_points(df, by)
        .groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.bround(-F.col("b.neg_tau"), 2).alias("threshold"), F.col("b.f1").alias("f1"))
    )


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and the confusion matrix at a threshold."""
    hit = F.col("score") > threshold
    pos = F.col("label") == 1
    counts = df.agg(
        F.count_if(~pos & ~hit).alias("tn"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"),
        F.count_if(pos & hit).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tn",
        "fp",
        "fn",
        "tp",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1_score(tp, fp, fn).alias("f1"),
    )


def roc_auc(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties counting half.

    Rows are first reduced to one row per distinct score; the running count of negatives is cut into score ranges when
    there are many, so no task has to sort all scores.
    """
    scores = df.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranked = running_before(scores.withColumn("_all", F.lit(0)), "_all", "score", F.col("neg"), "below", "sum", cfg)
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return ranked.agg(pairs.alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc")
    )


def binary_metrics(df: DataFrame, threshold: float, cfg: Settings = DEFAULT) -> DataFrame:
    return confusion(df, threshold).withColumn("auc", roc_auc(df, cfg).scalar())


# --- answer keys ------------------------------------------------------------------------------------------------------


def _outcomes(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Every id of the key or the findings with its two flags."""
    expected = key.groupBy("log_id").agg(F.bool_or(F.col("label") == "anomaly").alias("expected"))
    predicted = findings.select("log_id").distinct().withColumn("predicted", F.lit(True))
    no = F.lit(False)
    return expected.join(predicted, "log_id", "full").select(
        "log_id", F.coalesce("expected", no).alias("expected"), F.coalesce("predicted", no).alias("predicted")
    )


def key_mismatches(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Ids on which findings and key disagree, one row each, sorted."""
    rows = _outcomes(findings, key).where(F.col("expected") != F.col("predicted"))
    kind = F.when(F.col("predicted"), "false_positive").otherwise("false_negative")
    return rows.select(kind.alias("kind"), "log_id").orderBy("kind", "log_id")


def key_match(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Totals and scores of the comparison; the ids themselves come from ``key_mismatches``."""
    e, p = F.col("expected"), F.col("predicted")
    counts = _outcomes(findings, key).agg(
        F.count_if(e).alias("expected_anomalies"),
        F.count_if(p).alias("predicted_anomalies"),
        F.count_if(e & p).alias("true_positive"),
        F.count_if(~e & p).alias("false_positive"),
        F.count_if(e & ~p).alias("false_negative"),
    )
    tp = F.col("true_positive")
    scored = counts.withColumns(
        {
            "precision": _ratio(tp, F.col("predicted_anomalies"), 1.0),
            "recall": _ratio(tp, F.col("expected_anomalies"), 1.0),
        }
    )
    pr, re = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(2 * pr * re, pr + re)).withColumns(
        {
            "precision": F.bround("precision", 6),
            "recall": F.bround("recall", 6),
            "f1": F.bround("f1", 6),
            "score": F.concat(tp.cast("string"), F.lit("/"), F.col("expected_anomalies").cast("string")),
        }
    )


def _key_with_findings(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Key rows with the latest finding of their log."""
    last = findings.groupBy("log_id").agg(F.max_by(F.struct(*[c for c in findings.columns if c != "log_id"]), "arrival_seq").alias("f"))
    return key.join(last, "log_id", "left")


def session_matrix(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Expected, predicted, tp, fp, fn and verdict per session of the key."""
    predicted = findings.select("log_id").distinct().withColumn("_p", F.lit(True))
    e, p = F.col("label") == "anomaly", F.coalesce("_p", F.lit(False))
    counts = (
        key.join(predicted, "log_id", "left")
        .groupBy(F.coalesce("session_id", F.lit("unknown")).alias("session_id"))
        .agg(
            F.count_if(e).alias("expected"),
            F.count_if(p).alias("predicted"),
            F.count_if(e & p).alias("tp"),
            F.count_if(~e & p).alias("fp"),
            F.count_if(e & ~p).alias("fn"),
        )
    )
    clean = (F.col("fp") == 0) & (F.col("fn") == 0)
    return counts.withColumn("match_status", F.when(clean, "PASS").otherwise("FAIL"))


def log_comparison(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Expected and predicted outcome per key row; missing values are empty text."""
    rows = _key_with_findings(findings, key)
    found = F.col("f").isNotNull()
    text = lambda c: F.coalesce(F.col("f." + c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join("f." + c, "|"), F.lit(""))
    label = F.when(found, "anomaly").otherwise("normal")
    expected = F.coalesce("label", F.lit("normal"))
    return rows.select(
        "log_id",
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"),
        expected.alias("expected_label"),
        F.coalesce("anomaly_type", F.lit("")).alias("expected_anomaly_type"),
        label.alias("predicted_label"),
        text("anomaly_type").alias("predicted_anomaly_type"),
        text("legacy_anomaly_type").alias("predicted_legacy_type"),
        text("confidence").alias("confidence"),
        text("promotion_source").alias("promotion_source"),
        text("policy_decision").alias("policy_decision"),
        text("ml_score").alias("ml_score"),
        text("ml_label").alias("ml_label"),
        listed("context_rule_ids").alias("context_rule_ids"),
        listed("signals_triggered").alias("signals"),
        F.when(expected == label, "PASS").otherwise("FAIL").alias("match_status"),
    )


def promotion_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("promotion_source").agg(F.count(F.lit(1)).alias("count"))


def verdict_table(findings: DataFrame, key: DataFrame) -> DataFrame:
    """Expected and found anomaly type per key row and whether they agree; key has ``expected_type`` (NULL = normal)."""
    rows = _key_with_findings(findings, key)
    return rows.select(
        "log_id",
        F.col("expected_type").alias("expected_legacy_type"),
        F.col("expected_type").isNotNull().alias("expected_is_anomaly"),
        F.col("f.anomaly_type").alias("prompt_type"),
        F.col("f.legacy_anomaly_type").alias("legacy_type"),
        F.col("f.confidence").alias("confidence"),
        F.coalesce(F.array_join("f.signals_triggered", "|"), F.lit("")).alias("signals"),
        F.col("f.legacy_anomaly_type").eqNullSafe(F.col("expected_type")).alias("matched"),
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Rows, matching rows, and expected and found counts per type."""
    types = verdicts.select(
        "matched",
        F.explode(
            F.array(
                F.struct(F.lit("expected").alias("side"), F.col("expected_legacy_type").alias("type")),
                F.struct(F.lit("found").alias("side"), F.col("legacy_type").alias("type")),
            )
        ).alias("x"),
    )
    return types.groupBy("x.type").agg(
        F.count_if(F.col("x.side") == "expected").alias("expected"),
        F.count_if(F.col("x.side") == "found").alias("found"),
        F.count_if((F.col("x.side") == "expected") & F.col("matched")).alias("matched"),
    )


# --- classes, latency, root causes ------------------------------------------------------------------------------------


def class_report(df: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, with accuracy and macro and weighted means as further rows.

    Input has ``truth`` and ``predicted``; missing values count as class None. All steps after the first work on one
    row per (truth, predicted) pair.
    """
    none = F.lit("None")
    cells = df.groupBy(
        F.coalesce("truth", none).alias("truth"), F.coalesce("predicted", none).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    roles = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")),
        F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_truth")),
    )
    hit = F.col("truth") == F.col("predicted")
    per_class = (
        cells.select("n", hit.alias("hit"), F.explode(roles).alias("r"))
        .groupBy("r.label")
        .agg(
            F.sum(F.when(F.col("r.is_truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("r.is_truth"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("r.is_truth"), F.col("n")).otherwise(0)).alias("named"),
        )
        .select(
            "label",
            "tp",
            "support",
            _ratio(F.col("tp"), F.col("named")).alias("precision"),
            _ratio(F.col("tp"), F.col("support")).alias("recall"),
            _ratio(2.0 * F.col("tp"), F.col("named") + F.col("support")).alias("f1"),
        )
    )
    total = F.sum("support")
    mean = lambda c: F.avg(c)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    accuracy = F.sum("tp") / total
    row = lambda name, p, r, f: F.struct(
        F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support")
    )
    means = per_class.agg(
        F.array(
            row("accuracy", accuracy, accuracy, accuracy),
            row("macro avg", mean("precision"), mean("recall"), mean("f1")),
            row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r"))
    return per_class.select("label", "precision", "recall", "f1", "support").unionByName(means.select("r.*"))


def latency_percentiles(
    df: DataFrame, by: str, column: str = "latency_ms", cfg: Settings = DEFAULT, accuracy: int | None = None
) -> DataFrame:
    """p50, p95 and p99 per group, linear between neighbours.

    Exact on any group size: values are reduced to counts per distinct value, ranked by a running sum that is cut into
    ranges where a group is large, and the two neighbours of each rank are picked. ``accuracy`` switches to a sketch.
    """
    names = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    if accuracy is not None:
        sketch = F.percentile_approx(column, list(names.values()), accuracy)
        picked = df.groupBy(by).agg(sketch.alias("_p"))
        return picked.select(by, *[F.element_at("_p", i + 1).cast("double").alias(n) for i, n in enumerate(names)])
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(by, F.col(column).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    # A key that NULL has too, and that no value shares with it.
    keyed = counts.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    ranked = running_before(keyed, "_key", "_x", F.col("_n"), "_before", "sum", cfg)
    rows = ranked.join(keyed.groupBy("_key").agg(F.sum("_n").alias("_total")), "_key")
    out = []
    for name, q in names.items():
        position = F.lit(q) * (F.col("_total") - 1)
        low = F.floor(position)
        holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        lower = F.max(F.when(holds(low), F.col("_x")))
        upper = F.max(F.when(holds(F.ceil(position)), F.col("_x")))
        share = F.max(position - low)
        out.append((lower + (upper - lower) * share).alias(name))
    return rows.groupBy(by).agg(*out)


def rca_precision(traces: DataFrame, max_hops: int = 3) -> DataFrame:
    """Share of traced anomalies whose root is within max_hops; 0 when nothing was traced."""
    hit = F.avg((F.col("hop_count") <= max_hops).cast("double"))
    return traces.agg(
        F.coalesce(hit, F.lit(0.0)).alias("precision_at_3"), F.count(F.lit(1)).alias("tested")
    )
