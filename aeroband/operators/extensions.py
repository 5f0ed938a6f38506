"""Places where users plug in their own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from aeroband.operators import detectors

C = F.col


def classify_with(df: DataFrame, features: str, load: Callable[[], object], output: str = "prediction") -> DataFrame:
    """Label and confidence from a user model with ``predict(matrix) -> (labels, confidences)``.

    ``load`` runs once per task; batches are scored as whole matrices.
    """
    @F.pandas_udf("label string, confidence double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            labels, confidences = model.predict(np.stack(batch.to_list()))
            yield pd.DataFrame({"label": labels, "confidence": confidences})

    return df.withColumn(output, predict(features))


def process_chunks(df: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame | None], schema=None) -> DataFrame:
    """A user function on Arrow batches of chunks; None drops the batch."""
    def run(batches):
        for batch in batches:
            out = process(batch)
            if out is not None and len(out):
                yield out

    return df.mapInPandas(run, schema or df.schema)


def capture_when(samples: DataFrame, predicate: Column | Callable[[pd.Series], pd.Series], keys: list[str], value: str | None = None, **window) -> DataFrame:
    """Triggered capture with a Column or a vectorised Python predicate of one column."""
    if not isinstance(predicate, Column):
        predicate = F.pandas_udf(predicate, "boolean")(C(value))
    return detectors.triggered_capture(samples, predicate, keys, **window)


def on_batch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """A user handler per micro-batch."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_capture(frames: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str, path: str = "path", chunk: str = "chunk", chunks_per_group: int = 64) -> DataFrame:
    """A user function per capture part of at most ``chunks_per_group`` chunks; results carry the path.

    A capture of any length is handed over in parts, so fold the parts with an aggregate.
    """
    part = F.floor(C(chunk) / chunks_per_group).alias("_part")
    return frames.groupBy(path, part).applyInPandas(process, schema)
