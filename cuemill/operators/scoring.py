"""Batch scoring with any model that runs in Python: the one Python operator on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

Predict = Callable[[np.ndarray], np.ndarray]


def batch_predict(
    df: DataFrame, make_predict_fn: Callable[[], Predict], column: str,
    shape: Sequence[int], batch_size: int = 16,
) -> DataFrame:
    """Adds ``prediction`` and ``probability`` of class 1.

    ``make_predict_fn`` loads the model once per worker and returns a function from a batch of
    inputs to class logits; softmax and argmax follow here, natively.
    """
    logits = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()),
                               batch_size=batch_size, input_tensor_shapes=[list(shape)])
    scored = df.withColumn("_logits", logits(column))
    # Subtracting the maximum keeps exp in range.
    exps = F.transform("_logits", lambda x: F.exp(x - F.array_max("_logits")))
    scored = scored.withColumn("_exps", exps)
    total = F.aggregate("_exps", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("_logits", F.array_max("_logits")) - 1
    return (scored.withColumn("prediction", best.cast("int"))
            .withColumn("probability", F.get("_exps", F.lit(1)) / total)
            .drop("_logits", "_exps"))


def linear_head(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Predict]:
    """Predictor for a fixed linear layer over ``(rows, features)`` inputs."""

    def make() -> Predict:
        return lambda batch: batch.astype("float64") @ weights.T + bias

    return make
