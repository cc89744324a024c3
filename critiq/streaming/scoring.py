"""Score arriving reviews with a fitted sentiment classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, fitted) -> DataFrame:
    """Apply the fitted feature chain and model (batch or streaming input).

    ``fitted`` is ``SentimentModel.model`` from
    ``operators.ml.sentiment_classifier``: (feature chain, logistic
    regression).  All stages are row-local and run in the JVM, so a stream
    needs no state and no Python worker.
    """
    vectors, model = fitted
    out = model.transform(vectors.transform(df.withColumn("_t", F.col("review_content"))))
    return out.select(*df.columns, (F.col("prediction") - 1).cast("int").alias("predicted_label"))
