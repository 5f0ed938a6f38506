"""Registered queries: training data, models and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import evaluation as E, features as X, models as M
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import table

C = F.col
FS = 2e6


def vectors(spark, d):
    return table(spark, d, "embeddings").select(C("vec_id").alias("id"), "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("p1_overlapping_segments", """SELECT vec_id AS frame_id, CAST(s AS INTEGER) AS segment, round(list_sum(list_transform(range(12), lambda k: embedding[2 * (s * 6 + k) + 1]::DOUBLE)), 6) AS sum_i
   FROM embeddings, range(4) t(s)""")
def _(spark, d):
    s = X.segments(V.iq_frames(spark, d), 12, 0.5)
    return rounded(s.select("frame_id", "segment", F.aggregate("i", F.lit(0.0), lambda a, x: a + x).alias("sum_i")))


@query("p2_snr_gate", "SELECT frame_id FROM (SELECT frame_id, greatest(0.0, 10*log10(avg(p)/quantile_cont(p, 0.1))) AS snr FROM iq_power GROUP BY 1) WHERE snr >= 6")
def _(spark, d):
    return X.snr_gate(V.iq_frames(spark, d), 6.0).select("frame_id")


@query("p3_feature_vectors")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    f = X.assembled(X.extract(V.iq_frames(spark, d), FS))
    return f.select("frame_id", "label", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))


@query("p4_feature_validation", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 10 = 0 THEN 'missing evm_rms' WHEN p_size / 40.0 > 1 THEN 'range evm_rms' END,
   CASE WHEN p_retailprice - 950 > 80 THEN 'range peak_prominence' WHEN p_retailprice - 950 < 0 THEN 'range peak_prominence' END], lambda x: x IS NOT NULL), ',') AS faults FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(C("p_size") % 10 != 0, C("p_size") / 40.0).alias("evm_rms"), (C("p_retailprice") - 950).alias("peak_prominence"))
    return p.select("p_partkey", F.array_join(X.faults(["evm_rms", "peak_prominence"]), ",").alias("faults"))


@query("p5_feature_normalisation", """SELECT p_partkey, round((p_retailprice - 950 - 16.5) / 6.75, 6) AS peak_prominence, round(ln(1 + p_size * 1e5), 6) AS peak_width, round(p_size / 40.0::DOUBLE, 6) AS evm_rms,
   round((p_size - 0) / 50.0::DOUBLE, 6) AS scaled FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (C("p_retailprice") - 950).alias("peak_prominence"), (C("p_size") * 1e5).alias("peak_width"), (C("p_size") / 40.0).alias("evm_rms"),
                                       X.min_max("p_size", 0, 50).alias("scaled"))
    return rounded(X.normalised(p, ["peak_prominence", "peak_width", "evm_rms"]))


@query("p6_global_scaler", """WITH s AS (SELECT avg(i) AS mi, stddev_samp(i) AS si, avg(q) AS mq, stddev_samp(q) AS sq FROM iq_samples)
   SELECT frame_id, n, round((i - mi) / si, 6) AS i, round((q - mq) / sq, 6) AS q FROM iq_samples, s""")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array
    v = V.iq_samples(spark, d).select("frame_id", "n", array_to_vector(F.array("i", "q")).alias("features"))
    out = M.standard_scaled(v).select("frame_id", "n", vector_to_array("scaled").alias("z"))
    return rounded(out.select("frame_id", "n", F.get("z", F.lit(0)).alias("i"), F.get("z", F.lit(1)).alias("q")))


@query("p7_class_balance", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, CAST(n AS BIGINT) AS n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 6) AS percent,
   round((SELECT max(n) FROM c)::DOUBLE / (SELECT min(n) FROM c), 6) AS imbalance, (SELECT max(n) FROM c)::DOUBLE / (SELECT min(n) FROM c) > 3 AS imbalanced FROM c""")
def _(spark, d):
    return rounded(M.class_balance(table(spark, d, "embeddings").select("label")))


SPLIT = """SELECT vec_id, label, CASE WHEN r <= round(n * 0.70) THEN 'train' WHEN r <= round(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM
   (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('42:' || vec_id), 1, 13) AS BIGINT)) AS r FROM embeddings)"""


@query("p8_stratified_split", SPLIT)
def _(spark, d):
    return M.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", "label", "split")


@query("p9_dataset_info", f"SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM ({SPLIT}) GROUP BY 1, 2")
def _(spark, d):
    return M.dataset_info(M.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id"))


@query("p10_augmentation")
def _(spark, d):
    a = X.augment(V.iq_frames(spark, d), FS)
    return rounded(a.select("frame_id", "draw.snr_db", "draw.shift_hz", "draw.scale", F.aggregate("i", F.lit(0.0), lambda s, x: s + x).alias("sum_i")), 4)


def _forest(spark, d, trees=100, depth=20):
    split = M.stratified_split(vectors(spark, d).withColumn("key", C("id")), "key")
    return M.random_forest(split.filter(C("split") == "train"), trees=trees, depth=depth), split


@query("p11_random_forest")
def _(spark, d):
    model, split = _forest(spark, d)
    pairs = E.confusion(model.transform(split.filter(C("split") != "train")), "label", "prediction")
    return rounded(E.averages(pairs.select("truth", C("predicted").cast("int").alias("predicted"), "n")))


@query("p12_gradient_boosted")
def _(spark, d):
    split = M.stratified_split(vectors(spark, d).withColumn("key", C("id")), "key")
    model = M.gradient_boosted(split.filter(C("split") == "train"), rounds=5, depth=3)
    pairs = E.confusion(model.transform(split.filter(C("split") != "train")), "label", "prediction")
    return rounded(E.averages(pairs.select("truth", C("predicted").cast("int").alias("predicted"), "n")))


def _search(spark, d, sample=None):
    _, scores = M.grid_search(vectors(spark, d), {"numTrees": [10, 20], "maxDepth": [4, 6]}, "id", folds=5, sample=sample)
    return rounded(scores.select(F.element_at("params", F.lit("numTrees")).alias("trees"), F.element_at("params", F.lit("maxDepth")).alias("depth"), "f1"))


@query("p13_grid_search")
def _(spark, d):
    return _search(spark, d)


@query("p13_random_search")
def _(spark, d):
    return _search(spark, d, sample=2)


@query("p14_model_comparison", """SELECT 'model-' || c AS model, round(avg(CASE WHEN predicted = truth AND score >= c * 0.2 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS f1
   FROM predictions, range(3) t(c) GROUP BY c""")
def _(spark, d):
    rows = V.predictions(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    hit = (C("truth") == C("predicted")) & (C("score") >= C("c") * 0.2)
    f1 = rows.groupBy(F.concat(F.lit("model-"), C("c").cast("string")).alias("model")).agg(F.avg(hit.cast("double")).alias("f1"))
    return M.compare_models(rounded(f1))


@query("p15_batch_scoring")
def _(spark, d):
    model, split = _forest(spark, d)
    return rounded(M.score(model, split).select("id", "predicted", "confidence"))


def _probabilities(spark, d):
    """Ten class shares per row from non-negative weights."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: F.pow(F.abs(x.cast("double")), 3)).alias("w"))
    return e.select("vec_id", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, y: a + y)).alias("p"))


@query("p16_top_classes", """WITH w AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: pow(abs(x::DOUBLE), 3)) AS w FROM embeddings),
   p AS (SELECT vec_id, k - 1 AS cls, w[k] / list_sum(w) AS p FROM w, range(1, 11) t(k)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rank FROM p WHERE p > 0.3)
   SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(cls AS INTEGER) AS cls, round(p, 6) AS p FROM r WHERE rank <= 5""")
def _(spark, d):
    return rounded(M.top_classes(_probabilities(spark, d), "vec_id"))


PAIRS = "SELECT truth, predicted, count(*) AS n FROM predictions GROUP BY 1, 2"


def pairs(spark, d):
    return E.confusion(V.predictions(spark, d))


@query("p17_confusion_matrix", "SELECT truth, " + ", ".join(f'CAST(count(*) FILTER (WHERE predicted = {k}) AS BIGINT) AS "{k}"' for k in range(10)) + " FROM predictions GROUP BY 1")
def _(spark, d):
    return E.confusion_matrix(pairs(spark, d), list(range(10)))


REPORT = """WITH c AS (SELECT k AS cls, (SELECT count(*) FROM predictions WHERE truth = k) AS support, (SELECT count(*) FROM predictions WHERE predicted = k) AS called,
     (SELECT count(*) FROM predictions WHERE truth = k AND predicted = k) AS tp FROM (SELECT DISTINCT label AS k FROM embeddings)),
   r AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE tp::DOUBLE / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall FROM c),
   f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


@query("p18_averaged_scores", REPORT + """, a AS (SELECT sum(tp)::DOUBLE / sum(support) AS acc FROM f)
   SELECT round(acc, 6) AS accuracy, 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f, a GROUP BY acc
   UNION ALL SELECT round(acc, 6), 'weighted', round(sum(precision*support)/sum(support), 6), round(sum(recall*support)/sum(support), 6), round(sum(f1*support)/sum(support), 6) FROM f, a GROUP BY acc
   UNION ALL SELECT round(acc, 6), 'micro', round(acc, 6), round(acc, 6), round(acc, 6) FROM a""")
def _(spark, d):
    return rounded(E.averages(pairs(spark, d)))


@query("p19_kappa_matthews", REPORT + """, t AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support::DOUBLE*called) AS pt, sum(called::DOUBLE*called) AS pp, sum(support::DOUBLE*support) AS tt FROM f)
   SELECT round((c/s - pt/(s*s)) / (1 - pt/(s*s)), 6) AS kappa, round((c*s - pt) / sqrt((s*s - pp) * (s*s - tt)), 6) AS mcc FROM t""")
def _(spark, d):
    return rounded(E.agreement(pairs(spark, d)))


@query("p20_class_report", REPORT + " SELECT cls, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(spark, d):
    return rounded(E.class_report(pairs(spark, d)).select("cls", "support", "precision", "recall", "f1"))


ROC = """WITH x AS (SELECT CAST(k AS INTEGER) AS cls, round(CASE WHEN predicted = k THEN score ELSE (1 - score) / 9 END, 6) AS score, truth = k AS hit FROM predictions, range(10) t(k)),
   g AS (SELECT cls, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM x GROUP BY 1, 2),
   c AS (SELECT cls, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY cls) AS tt, sum(n) OVER (PARTITION BY cls) AS ft FROM g WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
   r AS (SELECT cls, score AS threshold, fp::DOUBLE / ft AS fpr, tp::DOUBLE / tt AS tpr, tp::DOUBLE / (tp + fp) AS precision FROM c)"""


def _roc(spark, d):
    p = V.predictions(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls"))
    score = F.round(F.when(C("predicted") == C("cls"), C("score")).otherwise((1 - C("score")) / 9), 6)
    return E.roc_points(p.select("cls", score.alias("score"), (C("truth") == C("cls")).alias("hit")), positive=C("hit"))


@query("p21_roc_points", ROC + " SELECT cls, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision FROM r")
def _(spark, d):
    return rounded(_roc(spark, d).drop("_down"))


@query("p21_area_under_roc", ROC + """ SELECT cls, round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER w, 0) AS pf, coalesce(lag(tpr) OVER w, 0) AS pt FROM r
   WINDOW w AS (PARTITION BY cls ORDER BY threshold DESC)) GROUP BY 1""")
def _(spark, d):
    return rounded(E.area_under_roc(_roc(spark, d)))


@query("p22_misclassified_pairs", "SELECT truth, predicted, CAST(count(*) AS BIGINT) AS n FROM predictions WHERE truth <> predicted GROUP BY 1, 2")
def _(spark, d):
    return E.misclassified(pairs(spark, d))


@query("p23_feature_importance")
def _(spark, d):
    model, _ = _forest(spark, d)
    return rounded(M.feature_importance(model, [f"e{k}" for k in range(64)], spark))


@query("p24_prediction_log", """SELECT 'model-1' AS model_id, id AS detection_id, predicted, score AS confidence, '[' || truth || ',' || predicted || ']' AS alternatives,
   (id % 40)::DOUBLE AS processing_ms, TIMESTAMP '2024-01-30' AS created_at FROM predictions""")
def _(spark, d):
    p = V.predictions(spark, d).withColumn("alternatives", F.array("truth", "predicted")).withColumn("confidence", C("score"))
    return M.prediction_log(p, "model-1", "alternatives", (C("id") % 40).cast("double"), F.lit("2024-01-30").cast("timestamp_ntz"))


@query("p25_active_model", "SELECT p_partkey AS id, p_brand AS name FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 1")
def _(spark, d):
    r = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_brand").alias("name"), C("p_retailprice").alias("created_at"), (C("p_size") > 10).alias("is_active"))
    return M.active_model(r).select("id", "name")


@query("p26_detection_quality", """WITH t AS (SELECT DISTINCT emitter, CAST(ts AS DATE) AS day FROM rid_messages), f AS (SELECT DISTINCT emitter, CAST(ts AS DATE) AS day FROM detections WHERE confidence > 0.6),
   j AS (SELECT count(*) FILTER (WHERE t.day IS NOT NULL AND f.day IS NOT NULL) AS tp, count(*) FILTER (WHERE f.day IS NULL) AS fn, count(*) FILTER (WHERE t.day IS NULL) AS fp FROM t FULL JOIN f ON t.emitter = f.emitter AND t.day = f.day)
   SELECT CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(tp::DOUBLE / (tp + fn), 6) AS detection_rate, round(fp::DOUBLE / (tp + fp), 6) AS false_positive_rate FROM j""")
def _(spark, d):
    day = F.to_date("ts").alias("day")
    truth = V.rid_messages(spark, d).select("emitter", day)
    found = V.detections(spark, d).filter(C("confidence") > 0.6).select("emitter", day)
    return rounded(E.detection_quality(truth, found, ["emitter", "day"]))


@query("p27_rate_by_snr_step", "SELECT floor(snr / 5) * 5 AS step, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN confidence > 0.3 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM detections GROUP BY 1")
def _(spark, d):
    return rounded(E.rate_by_step(V.detections(spark, d), (F.floor(C("snr") / 5) * 5).cast("double"), C("confidence") > 0.3))


@query("p28_modulation_accuracy", "SELECT truth AS step, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM predictions GROUP BY 1")
def _(spark, d):
    return rounded(E.rate_by_step(V.predictions(spark, d), C("truth"), C("truth") == C("predicted")))
