"""One pyspark.ml Transformer per method: a DataFrame of series in, a DataFrame of replicates out."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .plans.api import bootstrap
from .sources.series import from_frame
from .specs import AR, ARIMA, IID, VAR, CircularBlock, MethodSpec, MovingBlock, NonOverlappingBlock, ResidualBootstrap, SieveAR, StationaryBlock, TaperedBlock


class SeriesBootstrap(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Common part. Parameters: valueCols, orderCol, seriesCol ("" for one series), numBootstraps, seed, returnIndices."""

    valueCols = Param(Params._dummy(), "valueCols", "value columns", TypeConverters.toListString)
    orderCol = Param(Params._dummy(), "orderCol", "column that orders a series", TypeConverters.toString)
    seriesCol = Param(Params._dummy(), "seriesCol", "column that names a series, or ''", TypeConverters.toString)
    numBootstraps = Param(Params._dummy(), "numBootstraps", "replicates", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    returnIndices = Param(Params._dummy(), "returnIndices", "whether to return idx", TypeConverters.toBoolean)
    own: dict[str, Any] = {}

    def __init__(self, **given: Any) -> None:
        super().__init__()
        self._setDefault(valueCols=["value"], orderCol="ts", seriesCol="", numBootstraps=10, seed=0, returnIndices=False)
        self._setDefault(**{k: v for k, v in self.own.items() if v is not None})
        self._set(**{k: v for k, v in given.items() if v is not None})

    def spec(self) -> MethodSpec:
        raise NotImplementedError

    def _value(self, name: str) -> Any:
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self._value("valueCols")
        series = from_frame(dataset, columns if len(columns) > 1 else columns[0], order=self._value("orderCol"), series=self._value("seriesCol") or None)
        out = bootstrap(series, method=self.spec(), n_bootstraps=self._value("numBootstraps"), random_state=self._value("seed")).frame
        return out if self._value("returnIndices") else out.drop("idx")


def _param(name: str, convert: Any) -> Param:
    return Param(Params._dummy(), name, name, convert)


class IIDBootstrap(SeriesBootstrap):
    def spec(self) -> MethodSpec:
        return IID()


class _Blocks(SeriesBootstrap):
    """blockLength 0: automatic."""

    blockLength = _param("blockLength", TypeConverters.toInt)
    own = {"blockLength": 0}
    method: type = MovingBlock

    def spec(self) -> MethodSpec:
        return self.method(self._value("blockLength") or "auto")


class MovingBlockBootstrap(_Blocks):
    method = MovingBlock


class CircularBlockBootstrap(_Blocks):
    method = CircularBlock


class NonOverlappingBlockBootstrap(_Blocks):
    method = NonOverlappingBlock


class StationaryBlockBootstrap(_Blocks):
    method = StationaryBlock


class TaperedBlockBootstrap(_Blocks):
    window = _param("window", TypeConverters.toString)
    alpha = _param("alpha", TypeConverters.toFloat)
    own = {"blockLength": 0, "window": "bartlett", "alpha": 0.5}

    def spec(self) -> MethodSpec:
        return TaperedBlock(self._value("blockLength") or "auto", self._value("window"), self._value("alpha"))


class ARResidualBootstrap(SeriesBootstrap):
    order = _param("order", TypeConverters.toInt)
    own = {"order": 1}
    model: type = AR

    def spec(self) -> MethodSpec:
        return ResidualBootstrap(self.model(order=self._value("order")))


class VARResidualBootstrap(ARResidualBootstrap):
    model = VAR


class ARIMAResidualBootstrap(SeriesBootstrap):
    order = _param("order", TypeConverters.toListInt)
    own = {"order": [1, 0, 0]}

    def spec(self) -> MethodSpec:
        return ResidualBootstrap(ARIMA(order=tuple(self._value("order"))))


class SieveBootstrap(SeriesBootstrap):
    """maxLag 0: by the length of the series."""

    minLag = _param("minLag", TypeConverters.toInt)
    maxLag = _param("maxLag", TypeConverters.toInt)
    criterion = _param("criterion", TypeConverters.toString)
    own = {"minLag": 1, "maxLag": 0, "criterion": "bic"}

    def spec(self) -> MethodSpec:
        return SieveAR(min_lag=self._value("minLag"), max_lag=self._value("maxLag") or None, criterion=self._value("criterion"))
