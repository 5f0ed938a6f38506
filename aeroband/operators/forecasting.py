"""Next-day detection count with an error band."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

C = F.col


def _daily(detections: DataFrame, origin: str) -> DataFrame:
    day = F.to_date("ts")
    return detections.groupBy(day.alias("day")).agg(F.count("*").alias("y")).withColumn(
        "x", F.datediff("day", F.lit(origin).cast("date")).cast("double"))


def trend_forecast(detections: DataFrame, origin: str) -> DataFrame:
    """Least-squares trend over daily counts; the band is 1.96 root-mean-square errors."""
    daily = _daily(detections, origin)
    fit = daily.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
                    F.max("day").alias("last"), F.max("x").alias("mx"),
                    F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"))
    error = F.sqrt(F.greatest(F.lit(0.0), C("syy") - C("b") * C("sxy")) / C("n"))
    at = C("a") + C("b") * (C("mx") + 1)
    return fit.select(F.date_add("last", 1).alias("day"), at.alias("expected"), (at - 1.96 * error).alias("low"),
                      (at + 1.96 * error).alias("high"))


def calendar_forecast(detections: DataFrame, origin: str) -> DataFrame:
    """Regression on trend and weekday over daily counts (one row per day of history)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    daily = _daily(detections, origin)
    weekday = [(F.weekday("day") == k).cast("double").alias(f"w{k}") for k in range(6)]
    frame = daily.select("day", "x", C("y").cast("double").alias("y"), *weekday)
    assembler = VectorAssembler(inputCols=["x"] + [f"w{k}" for k in range(6)], outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=0.1, solver="normal").fit(assembler.transform(frame))
    error = float(model.summary.rootMeanSquaredError)
    target = daily.agg(F.date_add(F.max("day"), 1).alias("day"), (F.max("x") + 1).alias("x"))
    scored = model.transform(assembler.transform(target.select("day", "x", *weekday)))
    return scored.select("day", C("prediction").alias("expected"), (C("prediction") - 1.96 * error).alias("low"),
                         (C("prediction") + 1.96 * error).alias("high"))
