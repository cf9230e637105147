"""Registered queries: splits, scaling, evaluation, and the fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import scoring as S
from flowsieve.operators import learn as L
from flowsieve.operators.distributed import seeded_hash
from flowsieve.plans import driver_tables as D

SC = f"WITH {D.SCORED_SQL} "
ROW_ID = "((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey"
FEATS = ["quantity", "line", "part"]
LEAVES = D._sql_list(fixed.LEAVES)


def _rows(s, d):
    """Labelled training rows: numeric columns of the line items."""
    t = D.table(s, d, "lineitem").selectExpr(
        f"{ROW_ID} AS row_id", f"element_at(array({D._quoted(fixed.LEAVES)}), CAST(l_partkey % 15 + 1 AS INT)) AS label",
        "if(l_suppkey % 2 = 0, 'A', 'B') AS source", "l_quantity AS quantity", "CAST(l_linenumber AS DOUBLE) AS line", "CAST(l_partkey % 97 AS DOUBLE) AS part")
    fam = F.lit(None).cast("string")
    for leaf, family in fixed.FAMILY_OF_LEAF.items():
        fam = F.when(F.col("label") == leaf, family).otherwise(fam)
    return t.withColumn("family", fam)


ROWS_SQL = f"""WITH rows AS (SELECT {ROW_ID} AS row_id, ({LEAVES})[CAST(l_partkey % 15 AS INT) + 1] AS label, l_quantity AS quantity, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_partkey % 97 AS DOUBLE) AS part FROM lineitem),
fam AS (SELECT *, {D._case('label', fixed.FAMILY_OF_LEAF, 'NULL')} AS family FROM rows)
"""


def _split(s, d):
    r = _rows(s, d).withColumn("h", seeded_hash(["row_id"], 42))
    return L.stratified_split(r, "label", "h").select("row_id", "label", "split")


SPLIT_SQL = ROWS_SQL + """, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM rows),
t AS (SELECT *, (n * 15 + 50) // 100 AS nt FROM r), v AS (SELECT *, nt + ((n - nt) * 20 + 50) // 100 AS nv FROM t)
SELECT row_id, label, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nv THEN 'val' ELSE 'train' END AS split FROM v"""


def _moments(s, d):
    m = L.moments(L.stage_slices(_rows(s, d)), FEATS, ["slice"])
    return m.select("slice", "feature", S.round_to("mean", 6).alias("mean"), S.round_to("sd", 6).alias("sd"))


def r6(x):
    return f"CAST(round(CAST({x} AS DECIMAL(24,12)), 6) AS DOUBLE)"


_SLICES = f"(SELECT 'S1' AS slice, * FROM fam UNION ALL SELECT 'S2', * FROM fam WHERE label <> 'Benign' UNION ALL SELECT 'S3:' || family, * FROM fam WHERE family IN ('DoS', 'BruteForce', 'BotnetInfiltration'))"
MOMENTS_SQL = ROWS_SQL + " UNION ALL ".join(f"SELECT slice, '{f}' AS feature, {r6(f'avg({f})')} AS mean, {r6(f'stddev_pop({f})')} AS sd FROM {_SLICES} GROUP BY slice" for f in FEATS)


def _truth(s, d):
    """Scored flows with a made-up truth that the gate probability predicts only in part."""
    return D.scored(s, d).withColumn("truth", (F.col("o") * 7919 + F.col("c")) % 100 < F.col("stage1_p") * 60)


TRUTH_SQL = SC + ", t AS (SELECT *, (o * 7919 + c) % 100 < stage1_p * 60 AS truth FROM scored)"
ROC_SQL = TRUTH_SQL + """, g AS (SELECT stage1_p AS score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM t GROUP BY 1),
roc AS (SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, (SELECT CAST(sum(pos) AS BIGINT) FROM g) AS p, (SELECT CAST(sum(neg) AS BIGINT) FROM g) AS n, pos, neg FROM g WINDOW w AS (ORDER BY score DESC)),
curve AS (SELECT score, tp, fp, CAST(tp AS DOUBLE) / p AS tpr, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM roc)
"""
AUC_SQL = TRUTH_SQL + f""", pairs AS (SELECT count(*) FILTER (truth) AS positives, count(*) FILTER (NOT truth) AS negatives FROM t),
r AS (SELECT truth, rank() OVER (ORDER BY stage1_p) + (count(*) OVER (PARTITION BY stage1_p) - 1) / CAST(2 AS DOUBLE) AS rk FROM t),
s AS (SELECT sum(rk) FILTER (truth) AS ranks FROM r)
SELECT positives, negatives, CAST(round(CAST((ranks - positives * (positives + 1) / CAST(2 AS DOUBLE)) / (positives * CAST(negatives AS DOUBLE)) AS DECIMAL(24,12)), 9) AS DOUBLE) AS auc FROM pairs, s"""


def _quality(s, d):
    """Document quality labels against the parity of their length."""
    lab = D.table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("truth"))
    doc = D.table(s, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("string").alias("pred"))
    return lab.join(doc, "doc_id")


Q_SQL = "q AS (SELECT CAST(quality AS VARCHAR) AS truth, CAST(n_chars % 2 AS VARCHAR) AS pred FROM labels JOIN documents USING (doc_id))"


def _report_sql(src: str) -> str:
    return f"""cls AS (SELECT truth AS class FROM {src} UNION SELECT pred FROM {src}),
    cnt AS (SELECT class, (SELECT count(*) FROM {src} WHERE truth = class) AS support, (SELECT count(*) FROM {src} WHERE pred = class) AS predicted, (SELECT count(*) FROM {src} WHERE truth = class AND pred = class) AS hit FROM cls),
    rep AS (SELECT class, CASE WHEN predicted > 0 THEN CAST(hit AS DOUBLE) / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS recall,
      CASE WHEN predicted + support > 0 THEN CAST(2 * hit AS DOUBLE) / (predicted + support) ELSE 0 END AS f1, support, hit FROM cnt)"""


def _summary_sql(extra: str = "") -> str:
    return f"""SELECT CAST(sum(support) AS BIGINT) AS rows, count(*) AS classes, {r6('sum(hit) / CAST(sum(support) AS DOUBLE)')} AS accuracy, {r6('avg(recall) FILTER (support > 0)')} AS balanced_accuracy, {r6('avg(precision)')} AS precision_macro,
      {r6('avg(recall)')} AS recall_macro, {r6('avg(f1)')} AS f1_macro, {r6('sum(f1 * support) / CAST(sum(support) AS DOUBLE)')} AS f1_weighted{extra} FROM rep"""


TRUE_LEAF = "CASE WHEN o % 5 = 0 THEN 'Benign' WHEN o % 7 = 0 THEN 'DDoS' ELSE raw_leaf END"
TRUE_FAMILY = "CASE WHEN o % 5 = 0 THEN 'Benign' WHEN o % 7 = 0 THEN 'DDoS' ELSE raw_family END"


def _tiers(s, d):
    p = D.scored(s, d).selectExpr(f"{TRUE_LEAF} AS leaf", f"{TRUE_FAMILY} AS fam", "coalesce(attack_type, 'Benign') AS pleaf", "coalesce(family, 'Benign') AS pfam")
    leaf, pleaf, fam, pfam = (F.col(c) for c in ("leaf", "pleaf", "fam", "pfam"))
    two = lambda c: F.when(c == "Benign", "Benign").otherwise("Attack")
    tiers = {"gate": (F.lit(True), two(leaf), two(pleaf)), "family": (leaf != "Benign", fam, pfam), "leaf": (F.lit(True), leaf, pleaf)}
    return L.tier_results(p, tiers | {f"leaf:{f}": (fam == f, leaf, pleaf) for f in ("DoS", "BruteForce", "BotnetInfiltration")})


def _tier_sql():
    base = SC + f", p AS (SELECT {TRUE_LEAF} AS leaf, {TRUE_FAMILY} AS fam, coalesce(attack_type, 'Benign') AS pleaf, coalesce(family, 'Benign') AS pfam FROM scored)"
    two = lambda c: f"CASE WHEN {c} = 'Benign' THEN 'Benign' ELSE 'Attack' END"
    tiers = {"gate": f"SELECT {two('leaf')} AS truth, {two('pleaf')} AS pred FROM p", "family": "SELECT fam AS truth, pfam AS pred FROM p WHERE leaf <> 'Benign'", "leaf": "SELECT leaf AS truth, pleaf AS pred FROM p",
             **{f"leaf:{f}": f"SELECT leaf AS truth, pleaf AS pred FROM p WHERE fam = '{f}'" for f in ("DoS", "BruteForce", "BotnetInfiltration")}}
    parts = []
    for i, (name, sql) in enumerate(tiers.items()):
        body = _report_sql(f"s{i}").replace("cls AS", f"cls{i} AS").replace("FROM cls)", f"FROM cls{i})").replace("cnt AS", f"cnt{i} AS").replace("FROM cnt)", f"FROM cnt{i})").replace("rep AS", f"rep{i} AS")
        base += f", s{i} AS ({sql}), {body}"
        parts.append(_summary_sql(f", '{name}' AS tier").replace("FROM rep", f"FROM rep{i}"))
    return base + " " + " UNION ALL ".join(parts)


def _weights(s, d):
    attacks = _rows(s, d).filter(F.col("label") != fixed.BENIGN)
    return L.class_weights(attacks, "family").select("family", "n", S.round_to("weight", 6).alias("weight"))


def _imputed(s, d):
    t = D.table(s, d, "lineitem").selectExpr(f"{ROW_ID} AS row_id", "if(l_partkey % 10 = 0, NULL, l_quantity) AS quantity", "if(l_partkey % 7 = 0, ' ', l_returnflag) AS flag")
    out = L.merge_categories(L.impute(t, ["quantity"], {"flag": "Normal"}), "flag", {"R": "Returned", "A": "Returned"})
    return out.select("row_id", S.round_to("quantity", 6).alias("quantity"), "flag")


def _features(s, d):
    t = D.table(s, d, "lineitem").selectExpr("l_quantity AS quantity", "l_quantity * 3 + l_linenumber AS heavy", "l_linenumber AS line", "5 AS fixed_value", "l_partkey % 97 AS part", "l_orderkey AS id")
    return t, ["quantity", "heavy", "line", "fixed_value", "part", "id"]


def _correlations(s, d):
    t, cols = _features(s, d)
    return L.pairwise_correlation(t, [c for c in cols if c not in ("fixed_value", "id")]).select("a", "b", S.round_to("corr", 6).alias("corr"))


def _selected(s, d):
    t, cols = _features(s, d)
    left = L.select_features(t, cols, ["id"])
    return t.select(F.posexplode(F.array(*[F.lit(c) for c in left])).alias("position", "feature")).groupBy("position", "feature").agg(F.count("*").alias("rows"))


def _selected_sql():
    """A column goes if it is constant or correlated with an earlier one that stays."""
    names = ["quantity", "heavy", "line", "fixed_value", "part"]
    gone = []
    for j, b in enumerate(names):
        earlier = [f"(NOT gone{i} AND coalesce(abs(corr_{a}_{b}), 0) > 0.95)" for i, a in enumerate(names[:j])]
        gone.append(" OR ".join([f"constant_{b}", *earlier]) + f" AS gone{j}")
    values = [f"min({n}) = max({n}) AS constant_{n}" for n in names] + [f"corr({a}, {b}) AS corr_{a}_{b}" for j, b in enumerate(names) for a in names[:j] if "fixed_value" not in (a, b)]
    values += [f"0 AS corr_{a}_{b}" for j, b in enumerate(names) for a in names[:j] if "fixed_value" in (a, b)]
    kept = " UNION ALL ".join(f"SELECT {j} AS place, '{n}' AS feature, rows FROM flags WHERE NOT gone{j}" for j, n in enumerate(names))
    return ("WITH t AS (SELECT l_quantity AS quantity, l_quantity * 3 + l_linenumber AS heavy, l_linenumber AS line, 5 AS fixed_value, l_partkey % 97 AS part FROM lineitem), "
            f"v AS (SELECT count(*) AS rows, {', '.join(values)} FROM t), flags AS (SELECT *, {', '.join(gone)} FROM v), kept AS ({kept}) "
            "SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS position, feature, rows FROM kept")


def _model_rows(s, d):
    """Flows with numeric features that tell their leaf in part."""
    base = D.flows(s, d)
    fam = F.array_position(F.array(*[F.lit(x) for x in fixed.FAMILIES]), F.col("raw_family")).cast("double")
    leaf = F.array_position(F.array(*[F.lit(x) for x in fixed.LEAVES]), F.col("raw_leaf")).cast("double")
    return base.select(
        "o", F.when((F.col("o") * 7919 + F.col("c")) % 100 < F.col("stage1_p") * 60, F.col("raw_leaf")).otherwise(fixed.BENIGN).alias("label"),
        F.when(F.col("o") % 2 == 0, "A").otherwise("B").alias("source"), (F.col("stage1_p") * 10).alias("f1"), (fam + F.col("raw2_p")).alias("f2"), (leaf + F.col("raw3_p")).alias("f3"))


MF = ["f1", "f2", "f3"]


def _parts(s, d):
    r = L.stratified_split(_model_rows(s, d).withColumn("h", seeded_hash(["o"], 42)), "label", "h")
    return r.filter("split = 'train'"), r.filter("split = 'test'")


def _gate(s, d):
    train, test = _parts(s, d)
    scored = L.gate_scores(L.fit_gate(train, MF, trees=5, depth=3), test)
    return L.roc_auc(scored.withColumn("truth", F.col("label") != fixed.BENIGN), "truth", "stage1_p")


def _hierarchy(s, d):
    train, test = _parts(s, d)
    out = L.fit_hierarchy(train, MF, tau=0.3, trees=5, depth=4, id_column="o").score(test)
    return out.groupBy("label", F.coalesce("attack_type", F.lit(fixed.BENIGN)).alias("predicted")).agg(F.count("*").alias("rows"))


def _family_model(s, d):
    train, test = _parts(s, d)
    attacks = lambda x: L.enrich.with_family(x.filter(F.col("label") != fixed.BENIGN), "label", "family")
    model = L.fit_classes(attacks(train), MF, "family", trees=5, depth=4, balanced=True)
    out = L.class_probabilities(model, attacks(test), "probs").withColumn("pred", S.best_entry("probs")["label"])
    return L.summary(L.report(L.confusion(out, "family", "pred")))


def _oversampled(s, d):
    r = _model_rows(s, d).join(F.broadcast(s.createDataFrame([(x,) for x in fixed.LEAVES_OF_FAMILY["BotnetInfiltration"]], "label string")), "label")
    return L.oversample(r, "o", MF).groupBy("label").agg(F.count("*").alias("rows"))


def _cross(s, d):
    train, test = _parts(s, d)
    return L.cross_corpus(train, test, MF, ["A", "B"], trees=3, depth=3)


def _search(s, d):
    train, _ = _parts(s, d)
    _, results = L.search_gate(train, MF, depths=(2, 3), trees=(3,))
    return s.createDataFrame([(str(sorted(g.items())), float(m)) for g, m in results], "params string, auc double")


OVERSAMPLED_SQL = f"""WITH {D.FLOWS_SQL}, r AS (SELECT CASE WHEN (o * 7919 + c) % 100 < stage1_p * 60 THEN raw_leaf ELSE '{fixed.BENIGN}' END AS label FROM flows),
n AS (SELECT label, count(*) AS n FROM r WHERE label IN ({', '.join(f"'{x}'" for x in fixed.LEAVES_OF_FAMILY["BotnetInfiltration"])}) GROUP BY label)
SELECT label, CASE WHEN n < 2 THEN n ELSE (SELECT max(n) FROM n) END AS rows FROM n"""

QUERIES = {
    "m01_stratified_split": (_split, SPLIT_SQL),
    "m02_scaler_moments": (_moments, MOMENTS_SQL),
    "m03_gate_model": (_gate, None),
    "m04_threshold": (lambda s, d: L.gate_threshold(_truth(s, d), "truth", "stage1_p"), ROC_SQL + "SELECT min(score) AS tau, max(fpr) AS fpr, max(tpr) AS tpr FROM curve WHERE fpr <= 0.01"),
    "m05_class_weights": (_weights, ROWS_SQL + f", n AS (SELECT family, count(*) AS n FROM fam WHERE label <> 'Benign' GROUP BY family) SELECT family, n, {r6('sqrt(CAST((SELECT max(n) FROM n) AS DOUBLE) / n)')} AS weight FROM n"),
    "m05_family_model": (_family_model, None),
    "m06_hierarchy_model": (_hierarchy, None),
    "m07_oversample": (_oversampled, OVERSAMPLED_SQL),
    "m10_confusion": (lambda s, d: L.confusion(_quality(s, d), "truth", "pred"), f"WITH {Q_SQL} SELECT truth, pred, count(*) AS count, count(*) / CAST(sum(count(*)) OVER (PARTITION BY truth) AS DOUBLE) AS share FROM q GROUP BY truth, pred"),
    "m11_report": (lambda s, d: L.report(L.confusion(_quality(s, d), "truth", "pred")), f"WITH {Q_SQL}, {_report_sql('q')} SELECT * FROM rep"),
    "m11_summary": (lambda s, d: L.summary(L.report(L.confusion(_quality(s, d), "truth", "pred"))), f"WITH {Q_SQL}, {_report_sql('q')} {_summary_sql()}"),
    "m12_roc_curve": (lambda s, d: L.roc_curve(_truth(s, d), "truth", "stage1_p"), ROC_SQL + "SELECT * FROM curve"),
    "m12_auc": (lambda s, d: L.roc_auc(_truth(s, d), "truth", "stage1_p"), AUC_SQL),
    "m13_tier_results": (_tiers, _tier_sql()),
    "m14_cross_corpus": (_cross, None),
    "m15_search": (_search, None),
    "m16_impute_merge": (_imputed, f"WITH t AS (SELECT {ROW_ID} AS row_id, CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 7 = 0 THEN 'Normal' WHEN l_returnflag IN ('R', 'A') THEN 'Returned' ELSE l_returnflag END AS flag FROM lineitem) SELECT row_id, {r6('coalesce(q, (SELECT avg(q) FROM t))')} AS quantity, flag FROM t"),
    "m16_correlations": (_correlations, "WITH t AS (SELECT l_quantity AS quantity, l_quantity * 3 + l_linenumber AS heavy, l_linenumber AS line, l_partkey % 97 AS part FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS corr FROM t" for a, b in [("quantity", "heavy"), ("quantity", "line"), ("quantity", "part"), ("heavy", "line"), ("heavy", "part"), ("line", "part")])),
    "m16_select_features": (_selected, _selected_sql()),
    "m17_verdict_quality": (lambda s, d: L.verdict_quality(D.judged(s, d).withColumn("truth", (F.col("o") * 7919 + F.col("c")) % 100 < F.col("stage1_p") * 60), F.col("truth")),
                            f"WITH {D.JUDGED_SQL}, g AS (SELECT source, count(*) AS rows, count(*) FILTER ((o * 7919 + c) % 100 < stage1_p * 60) AS hits FROM judged GROUP BY source) SELECT source, rows, hits, hits / CAST(rows AS DOUBLE) AS precision, hits / CAST(sum(hits) OVER () AS DOUBLE) AS recall FROM g"),
}
