"""What each method assumes and supports."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import Codes, MethodConfigError
from ..specs import CircularBlock, IID, MethodSpec, MovingBlock, NonOverlappingBlock, ResidualBootstrap, SieveAR, StationaryBlock, TaperedBlock


@dataclass(frozen=True)
class MethodMetadata:
    name: str
    assumptions: tuple[str, ...]
    supports_multivariate: bool
    supports_exog: bool
    supports_indices: bool
    supports_oob: bool
    preserves_temporal_dependence: bool
    references: tuple[str, ...]
    complexity: str
    failure_modes: tuple[str, ...]


def _block(name: str, references: tuple[str, ...], *failures: str) -> MethodMetadata:
    return MethodMetadata(name, ("stationarity", "weak dependence"), True, False, True, True, True, references, "O(B*n)", failures)


_KNOWN: dict[type, MethodMetadata] = {
    IID: MethodMetadata("iid", ("exchangeable observations",), True, False, True, True, False, ("Efron 1979",), "O(B*n)", ("wrong under serial dependence",)),
    MovingBlock: _block("moving_block", ("Kunsch 1989", "Liu-Singh 1992"), "depends on block length", "ends of the series are drawn less often"),
    CircularBlock: _block("circular_block", ("Politis-Romano 1992",), "depends on block length"),
    StationaryBlock: _block("stationary_block", ("Politis-Romano 1994",), "depends on mean block length"),
    NonOverlappingBlock: _block("non_overlapping_block", ("Carlstein 1986",), "more variance than overlapping blocks"),
    TaperedBlock: _block("tapered_block", ("Paparoditis-Politis 2001",), "depends on window and block length"),
    ResidualBootstrap: MethodMetadata("residual", ("a well-specified model", "exchangeable residuals"), True, True, False, False, True, ("Freedman 1984", "Bose 1988"), "O(B*n*p)", ("wrong model", "unstable fit")),
    SieveAR: MethodMetadata("sieve_ar", ("linear process",), False, False, False, False, True, ("Buhlmann 1997",), "O(B*n*p)", ("non-linear or long-memory series",)),
}
_OWN = dict(_KNOWN)


def register_metadata(kind: type, metadata: MethodMetadata) -> None:
    _KNOWN[kind] = metadata


def metadata_for(method: MethodSpec | type) -> MethodMetadata:
    kind = method if isinstance(method, type) else type(method)
    if kind not in _KNOWN:
        raise MethodConfigError(f"no metadata for {kind.__name__}", code=Codes.UNKNOWN_METHOD)
    return _KNOWN[kind]


def metadata_frame(spark: SparkSession, registered: bool = True) -> DataFrame:
    """A row for each method; registered: those that callers have registered, too."""
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(m).values()) for m in (_KNOWN if registered else _OWN).values()]
    return spark.createDataFrame(rows, "name string, assumptions array<string>, supports_multivariate boolean, supports_exog boolean, supports_indices boolean, supports_oob boolean, preserves_temporal_dependence boolean, references array<string>, complexity string, failure_modes array<string>")


