"""Nearest-neighbour regression and classification as MLlib estimators."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import col
from .neighbours import nearest


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def setLabelCol(self, name: str):  # noqa: N802  # as MLlib spells it
        return self._set(labelCol=name)


class KNeighbors(Estimator, _Columns):
    """Mean label, or class with most votes, of the ``k`` nearest training rows.

    ``weights`` is "uniform" or "distance" (1/distance; rows at distance 0 outweigh all
    others). Classes are whole numbers from 0; ties go to the smaller class. The
    model is the training table, written once and searched by cells.
    """

    def __init__(self, task: str, featuresCol: str = "features", labelCol: str = "label", k: int = 5, weights: str = "uniform"):  # noqa: N803
        super().__init__()
        self.task, self.k, self.weights = task, k, weights
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol="prediction")

    def _fit(self, dataset: DataFrame) -> KNeighborsModel:
        rows = dataset.select(
            F.monotonically_increasing_id().alias("rid"),
            vector_to_array(col(self.getFeaturesCol())).alias("v"),
            col(self.getLabelCol()).cast("double").alias("y"),
        )
        rows = scratch.materialise(rows.where("v is not null and y is not null"))
        classes = 0 if self.task == "regression" else int(rows.agg(F.max("y")).first()[0] or 0) + 1
        return KNeighborsModel(rows, classes, self.k, self.weights)._copy_columns(self)


class KNeighborsModel(Model, _Columns):
    def __init__(self, rows: DataFrame, classes: int, k: int, weights: str):
        super().__init__()
        self.rows, self.classes, self.k, self.weights = rows, classes, k, weights

    def _copy_columns(self, other: KNeighbors) -> KNeighborsModel:
        return self._set(featuresCol=other.getFeaturesCol(), labelCol=other.getLabelCol(), predictionCol=other.getPredictionCol())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with prediction, for classes also probability (the shares of the votes).

        Rows with equal features are searched and voted on once.
        """
        asked = scratch.materialise(dataset.withColumn("__v", vector_to_array(col(self.getFeaturesCol()))))
        once = asked.where("__v is not null").select(F.col("__v").alias("v")).distinct()
        once = scratch.materialise(once.withColumn("lid", F.monotonically_increasing_id()))
        nn = nearest(once.select("lid", "v", F.lit(-1).alias("target")), self.rows.select("rid", "v"), self.k)
        near = nn.select("lid", "rid", "dist").join(self.rows.select("rid", "y"), "rid")
        if self.weights == "distance":
            # At most k rows of a row: those at distance 0 alone, if there are any.
            exact = F.sum(F.when(F.col("dist") == 0, F.lit(1.0)))
            far = 1 / F.nullif(F.col("dist"), F.lit(0.0))
            parts = [("e", exact, lambda e: F.sum(F.when(F.col("dist") == 0, e))), ("f", F.sum(far), lambda e: F.sum(far * e))]
        else:
            parts = [("f", F.count(F.lit(1)).cast("double"), F.sum)]
        aggs = []
        for name, total, of in parts:
            aggs.append(total.alias(f"t{name}"))
            if self.classes:
                aggs.append(F.array(*[F.coalesce(of((F.col("y") == c).cast("double")), F.lit(0.0)) for c in range(self.classes)]).alias(f"s{name}"))
            else:
                aggs.append(of(F.col("y")).alias(f"s{name}"))
        got = near.groupBy(F.col("lid").alias("__l")).agg(*aggs)
        total, votes = F.col("tf"), F.col("sf")
        if self.weights == "distance":
            total, votes = F.coalesce("te", "tf"), F.when(F.col("te").isNotNull(), F.col("se")).otherwise(F.col("sf"))
        if self.classes:
            share = F.transform(votes, lambda x: x / F.col("__total"))
            got = got.withColumn("__total", total).withColumn("__share", share)
            first = (F.array_position("__share", F.array_max("__share")) - 1).cast("double")
            got = got.select("__l", first.alias("__p"), array_to_vector(F.col("__share")).alias("__s"))
        else:
            got = got.select("__l", (votes / total).alias("__p"))
        got = once.join(got, F.col("lid") == F.col("__l")).drop("lid", "__l").withColumnRenamed("v", "__w")
        out = asked.join(got, F.col("__v") == F.col("__w"), "left")
        made = {self.getPredictionCol(): F.col("__p")} | ({"probability": F.col("__s")} if self.classes else {})
        return out.withColumns(made).drop("__v", "__w", "__p", "__s")
