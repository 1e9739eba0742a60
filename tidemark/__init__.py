"""Spark-native time-series resampling and uncertainty."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .errors import (  # noqa: E402
    Codes,
    DegenerateBlockBootstrapWarning,
    InputDataError,
    MethodConfigError,
    ModelStabilityError,
    NearUnitRootWarning,
    OOBUnavailableError,
    RNGContractError,
    TidemarkError,
    TidemarkWarning,
)
from .operators.conformal import agaci_bounds, aci_halfwidths, fit_ensemble, intervals, nexcp_quantile, register_calibrator, sliding_window_halfwidths, static_halfwidths  # noqa: E402
from .operators.diagnostics import Diagnosis, diagnose  # noqa: E402
from .operators.enbpi import EnbPI, enbpi_intervals, fit_predict_oob  # noqa: E402
from .operators.forecast import forecast_frame, forecast_intervals  # noqa: E402
from .operators.intervals import basic_interval, bca_interval, block_jackknife_se, jackknife_acceleration, jackknife_statistics, percentile_interval, studentized_interval  # noqa: E402
from .plans.api import Bootstrap, Reduced, RunMetadata, bootstrap, bootstrap_frame, bootstrap_iter, bootstrap_reduce, bootstrap_reduce_panel, conf_int, conf_int_panel, register_method  # noqa: E402
from .plans.metadata import MethodMetadata, metadata_for  # noqa: E402
from .sources.series import SeriesFrame, from_arrays, from_frame  # noqa: E402
from .specs import ACI, AR, ARIMA, IID, VAR, AgACI, BlockWild, CalibratorSpec, CircularBlock, MethodSpec, MovingBlock, NexCP, NonOverlappingBlock, ResidualBootstrap, SieveAR, SlidingWindow, Static, StationaryBlock, TaperedBlock, Wild  # noqa: E402

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_") and n not in ("sys", "cloudpickle")]
