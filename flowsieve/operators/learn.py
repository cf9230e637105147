"""Splits, models and evaluation. Models are Spark ML estimators; metrics are aggregates over the predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import scoring as S
from flowsieve.operators import enrich, verdict
from flowsieve.operators.distributed import hash_bucket, running_totals, same
from flowsieve.session import cut_lineage

# ---- splits and scaling ---------------------------------------------------------------------------------------------


def _half_up(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 50) / 100)


def stratified_split(df: DataFrame, label: str, hash_column: str, test: int = 15, val: int = 20) -> DataFrame:
    """Adds ``split``: per label the given percentage for test, then of the rest for validation, by a seeded hash.

    The position of a row is needed only to the side of the two cuts. Hash buckets that lie wholly on one side are labelled
    by a join with the bucket sizes; only rows of a bucket a cut runs through are ranked. Rows without a label are a class of their own, rows without a hash
    come first.
    """
    cut = df.withColumn("_b", hash_bucket(hash_column))
    sizes = cut.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    plan = sizes.withColumns({
        "_total": F.sum("_n").over(w),
        "_before": F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    plan = plan.withColumn("_t", _half_up(F.col("_total"), test))
    plan = plan.withColumn("_v", F.col("_t") + _half_up(F.col("_total") - F.col("_t"), val))
    upto = F.col("_before") + F.col("_n")
    side = (
        F.when(upto <= F.col("_t"), "test").when((F.col("_before") >= F.col("_t")) & (upto <= F.col("_v")), "val")
        .when(F.col("_before") >= F.col("_v"), "train")
    )
    plan = plan.select(label, "_b", "_before", "_t", "_v", side.alias("_side"))
    j = same(cut, plan, [label, "_b"])
    sure = j.filter("_side is not null").select(*df.columns, F.col("_side").alias("split"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy(hash_column))
    edge = j.filter("_side is null").withColumn("_r", rank)
    split = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_v"), "val").otherwise("train")
    return sure.unionByName(edge.select(*df.columns, split.alias("split")))


def moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per feature, one row per feature (and key), in one pass."""
    parts = []
    for f in features:
        c = F.col(f"`{f}`").cast("double")
        parts += [F.avg(c).alias(f"m|{f}"), F.stddev_pop(c).alias(f"s|{f}")]
    one = df.groupBy(*keys).agg(*parts)
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`m|{f}`").alias("mean"), F.col(f"`s|{f}`").alias("sd")) for f in features])
    return one.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*")


def stage_slices(df: DataFrame, label: str = "label", family: str = "family") -> DataFrame:
    """Rows with the training slices they belong to: ``S1`` all, ``S2`` attacks, ``S3:<family>`` families with several
    leaves."""
    multi = [f for f, leaves in fixed.LEAVES_OF_FAMILY.items() if len(leaves) > 1]
    attack = F.col(label) != fixed.BENIGN
    slices = F.array_compact(F.array(
        F.lit("S1"), F.when(attack, F.lit("S2")), F.when(F.col(family).isin(*multi), F.concat(F.lit("S3:"), F.col(family)))))
    return df.withColumn("slice", F.explode(slices))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Square-root balanced weight per class: sqrt(size of the largest class / size of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.sqrt(F.max("n").over(Window.partitionBy()).cast("double") / F.col("n")))


# ---- models ---------------------------------------------------------------------------------------------------------


def _prepared(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
    ]


def fit_gate(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Benign against attack, with its own scaler."""
    y = train.withColumn("_y", (F.col(label) != fixed.BENIGN).cast("double"))
    model = GBTClassifier(featuresCol="_scaled", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="_yhat")
    model.set(model.rawPredictionCol, "_rp")
    model.set(model.probabilityCol, "_p")
    return Pipeline(stages=[*_prepared(features), model]).fit(y)


def gate_scores(model: PipelineModel, df: DataFrame, name: str = "stage1_p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("_p")[1])
    return out.drop("_raw", "_scaled", "_rp", "_p", "_yhat")


def fit_classes(train: DataFrame, features: Sequence[str], label: str, trees: int = 40, depth: int = 8, seed: int = 42, balanced: bool = False) -> PipelineModel:
    """A multiclass model with its own scaler; ``balanced`` weighs classes by ``class_weights``. The forest reads its rows half a dozen times, so they are written once, scaled."""
    weight = {}
    if balanced:
        train = train.join(class_weights(train, label).select(label, F.col("weight").alias("_w")), label)
        weight = {"weightCol": "_w"}
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    model = RandomForestClassifier(featuresCol="_scaled", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                   rawPredictionCol="_rp", probabilityCol="_p", predictionCol="_yhat", **weight)
    prepared = Pipeline(stages=[index, *_prepared(features)]).fit(train)
    ready = cut_lineage(prepared.transform(train).select("_y", "_scaled", *weight.values()))
    return PipelineModel(stages=[*prepared.stages, model.fit(ready)])


def class_probabilities(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Adds a class → probability map."""
    labels, stages = model.stages[0].labels, model.stages[1:]
    out = df
    for stage in stages:
        out = stage.transform(out)
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), vector_to_array("_p"))
    return out.withColumn(name, probs).drop("_raw", "_scaled", "_rp", "_p", "_yhat")


@dataclass
class HierarchicalModel:
    """Gate, family model and one leaf model per family with several leaves."""

    gate: PipelineModel
    family: PipelineModel
    leaf: dict[str, PipelineModel] = field(default_factory=dict)
    tau: float = 0.5

    def score(self, df: DataFrame) -> DataFrame:
        """Model output per row. Families and leaves are evaluated on attack rows only, which are kept in between."""
        gated = gate_scores(self.gate, df)
        none = F.lit(None).cast("map<string,double>")
        benign = gated.filter(F.col("stage1_p") < self.tau).withColumns({"stage2_probs": none, "stage3_probs": none})
        attacks = cut_lineage(class_probabilities(self.family, gated.filter(F.col("stage1_p") >= self.tau), "stage2_probs"))
        attacks = attacks.withColumn("_fam", S.best_entry("stage2_probs")["label"])
        rest = attacks.filter(~F.col("_fam").isin(*self.leaf)).withColumn("stage3_probs", none)
        for name, model in self.leaf.items():
            part = class_probabilities(model, attacks.filter(F.col("_fam") == name), "stage3_probs")
            rest = rest.unionByName(part.select(*rest.columns))
        return verdict.score_hierarchical(benign.unionByName(rest.drop("_fam")), self.tau)


def fit_hierarchy(
    train: DataFrame, features: Sequence[str], label: str = "label", tau: float = 0.5, trees: int = 20, depth: int = 5, seed: int = 42, id_column: str | None = None,
) -> HierarchicalModel:
    """All three stages; each is fitted on its own slice of the training rows. With an ``id_column`` the leaves of the smallest family are oversampled.

    A fit reads its rows a dozen times, so the training rows are written once.
    """
    named = enrich.with_family(train, label, "_family")
    attacks = named.filter(F.col(label) != fixed.BENIGN)
    d = cut_lineage(named.select("_family", label, *[F.col(f"`{f}`") for f in features]))
    kept = d.filter(F.col(label) != fixed.BENIGN)
    model = HierarchicalModel(
        gate=fit_gate(d, features, label, trees, depth, seed),
        family=fit_classes(attacks.drop(label).withColumnRenamed("_family", label), features, label, trees, depth, seed, balanced=True),
        tau=tau,
    )
    present = {r[0]: r[1] for r in kept.groupBy("_family").count().collect()}  # six families at most
    several = [name for name, leaves in fixed.LEAVES_OF_FAMILY.items() if len(leaves) > 1 and name in present]
    smallest = min(several, key=lambda name: (present[name], name), default=None)
    for name in several:
        rows = kept.filter(F.col("_family") == name)
        if id_column is not None and name == smallest:
            rows = oversample(attacks.filter(F.col("_family") == name), id_column, features, label, seed=seed)
        model.leaf[name] = fit_classes(rows, features, label, trees, depth, seed)
    return model


def search_gate(train: DataFrame, features: Sequence[str], label: str = "label", depths: Sequence[int] = (3, 5), trees: Sequence[int] = (10, 20), seed: int = 42):
    """Hyper-parameters of the gate by area under the ROC curve on a held-out fifth."""
    y = train.withColumn("_y", (F.col(label) != fixed.BENIGN).cast("double"))
    gbt = GBTClassifier(featuresCol="_scaled", labelCol="_y", seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(trees)).build()
    search = TrainValidationSplit(
        estimator=Pipeline(stages=[*_prepared(features), gbt]), estimatorParamMaps=grid, seed=seed, trainRatio=0.8,
        evaluator=BinaryClassificationEvaluator(labelCol="_y", metricName="areaUnderROC"))
    fitted = search.fit(y)
    return fitted.bestModel, list(zip([{p.name: v for p, v in g.items()} for g in grid], fitted.validationMetrics))


def cross_corpus(train: DataFrame, test: DataFrame, features: Sequence[str], sources: Sequence[str], label: str = "label", source: str = "source", trees: int = 10, depth: int = 4) -> DataFrame:
    """Area under the curve and macro F1 of a gate trained on one corpus and tested on another, for all combinations."""
    out = None
    for a in sources:
        model = fit_gate(train.filter(F.col(source) == a), features, label, trees, depth)
        for b in sources:
            scored = gate_scores(model, test.filter(F.col(source) == b)).withColumn("truth", F.col(label) != fixed.BENIGN)
            auc = roc_auc(scored, "truth", "stage1_p")
            named = lambda c: F.when(c, "Attack").otherwise("Benign")
            pred = scored.select(named(F.col("truth")).alias("truth"), named(F.col("stage1_p") >= 0.5).alias("pred"))
            f1 = summary(report(confusion(pred, "truth", "pred"))).select("f1_macro")
            one = auc.select(F.lit(a).alias("train"), F.lit(b).alias("test"), "auc", F.lit(1).alias("_j")).join(f1.withColumn("_j", F.lit(1)), "_j").drop("_j")
            out = one if out is None else out.unionByName(one)
    return out


# ---- oversampling ---------------------------------------------------------------------------------------------------


NEIGHBOUR_ROWS = 20_000


def nearest(df: DataFrame, id_column: str, features: Sequence[str], k: int, block: int = 512, most: int = NEIGHBOUR_ROWS) -> DataFrame:
    """The ``k`` nearest other rows of each row by Euclidean distance, as (id, neighbour, rank).

    Neighbours are looked for among at most ``most`` rows, those with the smallest hash of their id: a bound on labelled rows. They are sent to every task once;
    a task compares ``block`` rows with them at a time and keeps the ``k`` best per row. Distances are sums of squared differences for any number of rows. Only what is not
    farther than the ``k``-th of a row is put in order.
    """
    cols = list(features)
    points = df.select(F.col(id_column).cast("long").alias("id"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(cols)])
    fs = [f"f{i}" for i in range(len(cols))]
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()
    shared = df.sparkSession.sparkContext.broadcast((chosen["id"].to_numpy(), chosen[fs].to_numpy()))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, xs = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), block):
                some = pdf.iloc[at:at + block]
                own, x = some["id"].to_numpy(), some[fs].to_numpy()
                d = np.zeros((len(x), len(xs)))
                for j in range(len(fs)):
                    d += (x[:, j, None] - xs[None, :, j]) ** 2
                d[own[:, None] == ids[None, :]] = np.inf
                d[np.isnan(d)] = np.inf
                if len(xs) > k:
                    row, col = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1, None]) & (d < np.inf))
                else:
                    row, col = np.nonzero(d < np.inf)
                order = np.lexsort((ids[col], d[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                kept = rank <= k
                yield pd.DataFrame({"id": own[row[kept]], "neighbour": ids[col[kept]], "rank": rank[kept].astype("int32")})

    return points.mapInPandas(best, "id long, neighbour long, rank int")


def oversample(df: DataFrame, id_column: str, features: Sequence[str], label: str = "label", k: int = 5, seed: int = 42, block: int = 512) -> DataFrame:
    """The rows plus synthetic ones that bring every class to the size of the largest.

    A synthetic row lies at a seeded random place between a row and one of its nearest rows of the same class.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one entry per class
    k = min(k, max(1, min(sizes.values()) - 1))
    largest, out = max(sizes.values()), df.select(label, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    for name, n in sorted(sizes.items()):
        missing = largest - n
        if missing == 0 or n < 2:
            continue
        members = df.filter(F.col(label) == name)
        near = nearest(members, id_column, features, k, block)
        # each row is the base of missing/n new rows; the remainder goes to the rows first in a seeded order
        position = F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
        spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(64))
        ids = members.select(F.col(id_column).cast("long").alias("id")).withColumn("_g", spread)
        per = ids.groupBy("_g").agg(F.count("*").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ids.join(per.select("_g", before.alias("_before")), "_g").withColumn("pos", F.col("_before") + position)
        share, extra = divmod(missing, n)
        copies = F.when(F.col("pos") <= extra, share + 1).otherwise(share)
        made = ranked.filter(copies > 0).select("id", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
        draw = lambda salt: F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
        made = made.withColumns({"rank": (draw(1) % k + 1).cast("int"), "u": draw(2) / F.lit(float(1 << 30))})
        body = members.select(F.col(id_column).cast("long").alias("id"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
        j = made.join(near, ["id", "rank"]).join(body, "id").join(body.select(F.col("id").alias("neighbour"), F.col("x").alias("y")), "neighbour")
        mixed = F.zip_with("x", "y", lambda a, b: a + (b - a) * F.col("u"))
        rows = j.select(F.lit(name).alias(label), mixed.alias("_z"))
        out = out.unionByName(rows.select(label, *[F.col("_z")[i].alias(f) for i, f in enumerate(features)]))
    return out


# ---- evaluation -----------------------------------------------------------------------------------------------------


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per true and predicted class (and ``by``), and their share of the true class."""
    g = df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("count"))
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by, "truth")))


def report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (and ``by``) from a confusion matrix; 0 where undefined."""
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted"), F.lit(0).cast("long").alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted"),
                 F.when(F.col("truth") == F.col("pred"), F.col("count")).otherwise(0).alias("hit")))
    g = matrix.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return g.select(
        *by, "class", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"), "support", "hit")


def summary(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted averages in one row (per ``by``). Classes that never occur as truth count in the
    macro averages, not in the balanced accuracy."""
    r6 = lambda c: S.round_to(c, 6)
    n = F.sum("support").cast("double")
    seen = F.when(F.col("support") > 0, F.col("recall"))
    mean = lambda c: r6(F.avg(c))
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("rows"), F.count("*").alias("classes"), r6(F.sum("hit") / n).alias("accuracy"), mean(seen).alias("balanced_accuracy"),
        mean("precision").alias("precision_macro"), mean("recall").alias("recall_macro"), mean("f1").alias("f1_macro"),
        r6(F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"))


def tier_results(df: DataFrame, tiers: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One summary row per tier. A tier is a condition on the rows it judges, their true and their predicted class; all are counted in one pass over ``df``. A tier
    without rows has no classes and no values."""
    judged = [F.when(where, F.struct(F.lit(name).alias("tier"), truth.alias("truth"), pred.alias("pred"))) for name, (where, truth, pred) in tiers.items()]
    rows = df.select(F.explode(F.array_compact(F.array(*judged))).alias("e")).select("e.*")
    found = summary(report(confusion(rows, "truth", "pred", ["tier"]), ["tier"]), ["tier"])
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in tiers])).alias("tier"))
    return names.join(found, "tier", "left").withColumn("classes", F.coalesce("classes", F.lit(0).cast("long")))


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    t = F.col(truth).cast("boolean")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """True and false positives when everything from this score up is called positive, per distinct score."""
    return running_totals(_by_score(df, truth, score), "score", {"tp": "pos", "fp": "neg"}, descending=True)


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC and precision–recall values per distinct score. The two class totals are one row each task receives."""
    points = roc_points(df, truth, score)
    total = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).withColumn("_j", F.lit(1))
    j = points.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j")
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return j.select(
        "score", "tp", "fp", rate("tp", "p").alias("tpr"), rate("fp", "n").alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right order, draws counting half.

    Counted in whole numbers of 38 digits, so the result does not depend on the order of additions.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    p = roc_points(df, truth, score)
    # negatives seen before a score (higher scores) are pairs in the wrong order
    wrong = (big("pos") * (2 * (F.col("fp") - F.col("neg")) + F.col("neg")).cast("decimal(19,0)")).cast("decimal(38,0)")
    g = p.agg(F.sum(wrong).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return g.select(F.col("p").alias("positives"), F.col("n").alias("negatives"), S.round_to(1 - F.try_divide(F.col("w").cast("double"), 2 * pairs), 9).alias("auc"))


def gate_threshold(df: DataFrame, truth: str, score: str, max_fpr: float = 0.01) -> DataFrame:
    """The lowest score whose false-positive rate does not exceed ``max_fpr``; null if even the highest one exceeds it."""
    curve = roc_curve(df, truth, score)
    return curve.filter(F.col("fpr") <= max_fpr).agg(F.min("score").alias("tau"), F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr"))


def verdict_quality(df: DataFrame, truth: Column) -> DataFrame:
    """Per verdict: rows, truly malicious rows, precision, and the share of all malicious rows it holds."""
    g = df.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(truth).alias("hits"))
    total = F.sum("hits").over(Window.partitionBy())
    return g.select("source", "rows", "hits", (F.col("hits") / F.col("rows")).alias("precision"),
                    F.coalesce(F.try_divide(F.col("hits").cast("double"), total), F.lit(0.0)).alias("recall"))


# ---- second corpus --------------------------------------------------------------------------------------------------


def impute(df: DataFrame, numbers: Sequence[str], texts: dict[str, str] | None = None) -> DataFrame:
    """Missing numbers become the column's mean, missing texts the given word."""
    d = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    out = Imputer(inputCols=list(numbers), outputCols=list(numbers), strategy="mean").fit(d).transform(d)
    for c, word in (texts or {}).items():
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(word)))
    return out


def merge_categories(df: DataFrame, column: str, merged: dict[str, str]) -> DataFrame:
    c = F.trim(F.col(column))
    for old, new in merged.items():
        c = F.when(F.trim(F.col(column)) == old, new).otherwise(c)
    return df.withColumn(column, c)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with one value only (nulls aside), found from minimum and maximum in one pass."""
    one = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(f"l|{c}") for c in columns], *[F.max(F.col(f"`{c}`").cast("double")).alias(f"h|{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"`l|{c}`") == F.col(f"`h|{c}`"), F.lit(True)).alias("constant")) for c in columns])
    return one.select(F.explode(rows).alias("e")).select("e.*").filter("constant").select("feature")


def correlated_pairs(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[tuple[str, str, float]]:
    """Column pairs whose absolute correlation exceeds the limit. The matrix has columns × columns entries."""
    d = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(df)
    m = Correlation.corr(d, "_v").head()[0].toArray()
    return [(a, columns[j], float(m[i, j])) for i, a in enumerate(columns) for j in range(i + 1, len(columns)) if abs(m[i, j]) > limit]


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair as rows (for short column lists)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return one.select(F.explode(rows).alias("e")).select("e.*")


def select_features(df: DataFrame, columns: Sequence[str], identifiers: Sequence[str] = (), limit: float = 0.95) -> list[str]:
    """Columns left after dropping identifiers, constants and the second of each highly correlated pair."""
    left = [c for c in columns if c not in identifiers]
    constant = {r[0] for r in constant_columns(df, left).collect()}  # one row per column at most
    left = [c for c in left if c not in constant]
    dropped: set[str] = set()
    for a, b, _ in correlated_pairs(df, left, limit):
        if a not in dropped:
            dropped.add(b)
    return [c for c in left if c not in dropped]
