"""Model output from class probabilities, and the hybrid verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import scoring as S


def score_hierarchical(df: DataFrame, tau: float) -> DataFrame:
    """Gate, family and leaf decision from ``stage1_p``, ``stage2_probs`` and ``stage3_probs`` (class maps).

    Rows below the gate are Normal with confidence 1 - p. Above it the family and the leaf are the most probable classes;
    families with one leaf skip the third stage with probability 1.
    """
    d = df.withColumn("_f", S.best_entry("stage2_probs")).withColumn("_l", S.best_entry("stage3_probs"))
    attack = F.col("stage1_p") >= F.lit(tau)
    family, family_p = F.col("_f.label"), -F.col("_f.minus_p")
    single = F.lit(None).cast("string")
    for name, leaf in fixed.SINGLE_LEAF.items():
        single = F.when(family == name, F.lit(leaf)).otherwise(single)
    leaf = F.coalesce(single, F.col("_l.label"), family)
    leaf_p = F.when(single.isNotNull() | F.col("_l").isNull(), F.lit(1.0)).otherwise(-F.col("_l.minus_p"))
    leaf_probs = F.when(single.isNotNull() | F.col("_l").isNull(), F.create_map(leaf, F.lit(1.0))).otherwise(F.col("stage3_probs"))
    rounded = lambda m: F.transform_values(m, lambda k, v: S.round_to(v))
    out = d.withColumns({"_leaf": leaf, "_leaf_p": leaf_p})
    only = lambda c: F.when(attack, c)
    return out.withColumns({
        "prediction": F.when(attack, "Malicious").otherwise("Normal"),
        "confidence": F.when(attack, S.chained_confidence(F.col("stage1_p"), family_p, F.col("_leaf_p"))).otherwise(
            S.round_to(1 - F.col("stage1_p"))),
        "severity": only(S.hierarchical_severity(F.col("_leaf_p"), family_p)),
        "attack_type": only(F.col("_leaf")),
        "family": only(family),
        "stage2_p": only(S.round_to(family_p)),
        "stage3_p": only(S.round_to("_leaf_p")),
        "stage2_probs": only(rounded(F.col("stage2_probs"))),
        "stage3_probs": only(rounded(leaf_probs)),
        "stage1_p": S.round_to("stage1_p"),
    }).drop("_f", "_l", "_leaf", "_leaf_p")


def score_single(df: DataFrame, probs: str = "probs") -> DataFrame:
    """One multiclass model: most probable label, its probability, severity by probability, attack probability."""
    best = S.best_entry(probs)
    d = df.withColumn("_b", best)
    attack, p = F.col("_b.label") != fixed.BENIGN, -F.col("_b.minus_p")
    benign_p = F.coalesce(F.try_element_at(F.col(probs), F.lit(fixed.BENIGN)), F.lit(0.0))
    return d.withColumns({
        "prediction": F.when(attack, "Malicious").otherwise("Normal"),
        "confidence": S.round_to(p),
        "severity": F.when(attack, S.single_severity(p)),
        "attack_type": F.when(attack, F.col("_b.label")),
        "stage1_p": S.round_to(1 - benign_p),
    }).drop("_b")


def hybrid_verdict(df: DataFrame, alert: str = "alert") -> DataFrame:
    """Adds ``source`` from (alert there, model says Malicious) and applies the headline changes that follow from it."""
    source = S.verdict(F.col(alert).isNotNull(), F.col("prediction") == "Malicious")
    d = df.withColumn("source", source)
    return d.withColumns(
        S.overridden(F.col("source"), F.col("prediction"), F.col("severity"), F.col("confidence"), F.col("stage2_p"), F.col("stage3_p"))
    )


def headline_label(prediction: Column, alert: Column) -> Column:
    """Label before the verdict is applied: without a model output a flow is ``Snort-Only`` or ``Normal``."""
    return F.coalesce(prediction, F.when(alert.isNotNull(), "Snort-Only").otherwise("Normal"))
