"""Image features, projection and range selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.predicates import in_rectangle


def extract(images: DataFrame, model: Callable[[list[bytes]], list[list[float]]], batch: int = 32) -> DataFrame:
    """U4: add ``features`` by a model that takes batches of encoded images."""

    @F.pandas_udf("array<float>")
    def run(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in contents:
            out: list[list[float]] = []
            for i in range(0, len(series), batch):
                out += model(series.iloc[i : i + batch].tolist())
            yield pd.Series(out, index=series.index)

    return images.withColumn("features", run("content"))


def project(rows: DataFrame, features: str = "features") -> DataFrame:
    """Add x and y, the first two principal components.

    They keep the table's main directions; ``neighbours.embed`` keeps neighbours instead.
    """
    vectors = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    point = vector_to_array("_p")
    return model.transform(vectors).withColumns({"x": point[0], "y": point[1]}).drop("_v", "_p")


def select_rectangle(rows: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Rows inside the rectangle, its border included."""
    return rows.where(in_rectangle(F.col("x"), F.col("y"), x0, x1, y0, y1))
