"""Registered queries: user-extension surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import detectors as D, extensions as U
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.plans.streams import detections as detection_stream
from aeroband.session import run_directory, table

C = F.col


class SignOfSum:
    """Smallest possible user model."""

    def predict(self, matrix):
        total = matrix.astype(float).sum(axis=1)
        return np.where(total > 0, "positive", "negative"), np.minimum(1.0, np.abs(total))


@query("r1_classifier_interface", "SELECT vec_id, CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE)) > 0 THEN 'positive' ELSE 'negative' END AS label FROM embeddings")
def _(spark, d):
    return U.classify_with(table(spark, d, "embeddings"), "embedding", SignOfSum).select("vec_id", C("prediction.label").alias("label"))


@query("r2_chunk_processor", "SELECT vec_id, label + 100 AS label FROM embeddings WHERE label <> 3")
def _(spark, d):
    def keep(batch: pd.DataFrame):
        return batch[batch["label"] != 3].assign(label=lambda x: x["label"] + 100)

    return U.process_chunks(table(spark, d, "embeddings").select("vec_id", "label"), keep)


@query("r3_trigger_predicate", """WITH k AS (SELECT emitter, list([[epoch_us(ts), id]] ORDER BY ts, id) AS v FROM detections WHERE value > 250 GROUP BY 1),
   f AS (SELECT emitter, unnest(list_reduce(v, lambda a, b: CASE WHEN b[1][1] - a[-1][1] >= 7200000000 THEN list_concat(a, b) ELSE a END)) AS x FROM k),
   t AS (SELECT CAST(x[2] AS BIGINT) AS trigger_id, emitter, make_timestamp(CAST(x[1] AS BIGINT)) AS ts FROM f)
   SELECT t.trigger_id, d.id FROM t JOIN detections d ON d.emitter = t.emitter AND d.ts BETWEEN t.ts - INTERVAL 1 HOUR AND t.ts + INTERVAL 3 HOUR""")
def _(spark, d):
    def loud(values: pd.Series) -> pd.Series:
        return values > 250

    base = V.detections(spark, d).select("id", "emitter", "ts", "value")
    return U.capture_when(base, loud, ["emitter"], "value", before_s=3600, after_s=10800, spacing_s=7200).select("trigger_id", "id")


@query("r4_event_handler", "SELECT drone_type, CAST(count(*) AS BIGINT) AS n FROM detections GROUP BY 1")
def _(spark, d):
    out, state = run_directory(spark, "handler-out"), run_directory(spark, "handler-state")

    def count(batch, batch_id):
        batch.groupBy("drone_type").count().write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    U.on_batch(detection_stream(spark, d).select("drone_type"), count, state).awaitTermination()
    return spark.read.parquet(out).groupBy("drone_type").agg(F.sum("count").alias("n"))


@query("r5_capture_processor", "SELECT CAST(label AS VARCHAR) AS path, CAST(count(*) * 32 AS BIGINT) AS samples FROM embeddings GROUP BY 1")
def _(spark, d):
    frames = V.iq_frames(spark, d).select(C("label").cast("string").alias("path"), C("frame_id").alias("chunk"), "i")

    def size(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [part["path"].iloc[0]], "samples": [int(part["i"].map(len).sum())]})

    return U.per_capture(frames, size, "path string, samples long").groupBy("path").agg(F.sum("samples").alias("samples"))


@query("r6_composed_detector")
def _(spark, d):
    return rounded(D.gated(D.score_frames(V.iq_frames(spark, d), 2e6), 0.5))
