"""Boosted regression trees with Spark MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantab.functions.scalars import clean_double
from spantab.staging import held

# The configured tree parameters.
DEFAULTS = {"maxDepth": 10, "stepSize": 0.02, "maxIter": 600, "subsamplingRate": 0.6, "seed": 42}
FEATURE_SHARE = "0.8"

_FEATURES = "_features"


def gbt_fit(df: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    """Squared-error boosted trees; missing features count as 0.

    Feature sampling is per node here, and there is no leaf penalty, so the
    trees resemble those of other boosting libraries without equalling them.
    """
    clean = df.select(
        *(clean_double(F.col(c)).alias(c) for c in features), F.col(target).cast("double").alias("_label")
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol=_FEATURES)
    trees = GBTRegressor(
        featuresCol=_FEATURES, labelCol="_label", predictionCol="p", featureSubsetStrategy=FEATURE_SHARE,
        **{**DEFAULTS, **params},
    )
    # Each pass that counts, samples and bins the rows would read and parse them again; held rows keep their order.
    with held(clean, [F.col(c) for c in clean.columns]) as rows:
        model = trees.fit(assembler.transform(rows))
    return PipelineModel([assembler, model])


def gbt_predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the prediction ``p``; feature cells are cleaned on a copy, not in ``df``."""
    assembler, trees = model.stages
    names = assembler.getInputCols()
    copies = {f"_f_{c}": clean_double(F.col(c)) for c in names}
    reader = VectorAssembler(inputCols=list(copies), outputCol=_FEATURES)
    scored = trees.transform(reader.transform(df.withColumns(copies)))
    return scored.drop(_FEATURES, *copies)
