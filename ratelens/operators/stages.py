"""Fitted encodings as Spark ML stages, so that a saved pipeline holds them."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.operators.features import fit_target_encoding
from ratelens.operators.stats import standardize, standardize_stats


class _TargetParams(HasInputCols, HasOutputCols, HasLabelCol):
    smoothing = Param(Params._dummy(), "smoothing", "rows' worth of the global mean in each category's mean", TypeConverters.toFloat)
    minSamplesLeaf = Param(Params._dummy(), "minSamplesLeaf", "least rows of a category of its own", TypeConverters.toInt)


class SmoothedTargetEncoder(Estimator, _TargetParams, DefaultParamsReadable, DefaultParamsWritable):
    """M2 as an estimator: categories as ``(n mean + s global) / (n + s)``, those of fewer than ``minSamplesLeaf`` rows and
    unseen ones as the global mean. The state is one number a category, held by the driver as ``StringIndexer`` holds labels."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, labelCol="label", smoothing=1.0, minSamplesLeaf=1):
        super().__init__()
        self._setDefault(smoothing=1.0, minSamplesLeaf=1)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SmoothedTargetEncoderModel:
        cols = self.getInputCols()
        fitted = fit_target_encoding(dataset, cols, self.getLabelCol(), self.getOrDefault("smoothing"), self.getOrDefault("minSamplesLeaf"))
        table: dict[str, dict[str, float]] = {c: {} for c in cols}
        for r in fitted.table.select("variable", "category", "encoding").collect():
            table[r.variable][r.category] = r.encoding
        model = SmoothedTargetEncoderModel(json.dumps(table, sort_keys=True), fitted.global_mean)
        return self._copyValues(model)


class SmoothedTargetEncoderModel(Model, _TargetParams, DefaultParamsReadable, DefaultParamsWritable):
    table = Param(Params._dummy(), "table", "encodings by column and category, as JSON", TypeConverters.toString)
    globalMean = Param(Params._dummy(), "globalMean", "mean of the label", TypeConverters.toFloat)

    def __init__(self, table: str = "{}", global_mean: float = 0.0):
        super().__init__()
        self._setDefault(smoothing=1.0, minSamplesLeaf=1)
        self._set(table=table, globalMean=global_mean)

    def encoding(self, column: str) -> Column:
        """The encoding of ``column`` as an expression over a literal map."""
        known = json.loads(self.getOrDefault("table")).get(column, {})
        rest = F.lit(self.getOrDefault("globalMean"))
        if not known:
            return rest
        pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(pairs, F.col(column).cast("string")), rest)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({o: self.encoding(c) for c, o in zip(self.getInputCols(), self.getOutputCols())})


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """C8 as an estimator: (x - mean) / population std, a std of 0 as 1."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        stats = standardize_stats(dataset, self.getInputCols())
        return self._copyValues(PopulationScalerModel([stats[c][0] for c in self.getInputCols()], [stats[c][1] for c in self.getInputCols()]))


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std of each column, 1 for 0", TypeConverters.toListFloat)

    def __init__(self, means=(), stds=()):
        super().__init__()
        self._set(means=list(means), stds=list(stds))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        held = dict(zip(outs, zip(self.getOrDefault("means"), self.getOrDefault("stds"))))
        return standardize(dataset.withColumns({o: F.col(c) for c, o in zip(cols, outs)}), outs, held)
