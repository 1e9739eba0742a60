"""Errors and warnings, each with a stable code and a context that says what was met."""

from __future__ import annotations


class Codes:
    INVALID_SHAPE = "TM_INVALID_SHAPE"
    NONFINITE_INPUT = "TM_NONFINITE_INPUT"
    TOO_FEW_OBSERVATIONS = "TM_TOO_FEW_OBSERVATIONS"
    EXOG_LENGTH_MISMATCH = "TM_EXOG_LENGTH_MISMATCH"
    UNSUPPORTED_EXOG = "TM_UNSUPPORTED_EXOG"
    PERFECT_COLLINEARITY = "TM_PERFECT_COLLINEARITY"
    UNKNOWN_METHOD = "TM_UNKNOWN_METHOD"
    INVALID_PARAMETER = "TM_INVALID_PARAMETER"
    BLOCK_LENGTH_GT_N = "TM_BLOCK_LENGTH_GT_N"
    BLOCK_LENGTH_GT_RESIDUALS = "TM_BLOCK_LENGTH_GT_RESIDUALS"
    DEGENERATE_BLOCK_BOOTSTRAP = "TM_DEGENERATE_BLOCK_BOOTSTRAP"
    ORDER_TOO_LARGE = "TM_ORDER_TOO_LARGE"
    UNSUPPORTED_MODEL_FEATURE = "TM_UNSUPPORTED_MODEL_FEATURE"
    VAR_REQUIRES_MULTIVARIATE = "TM_VAR_REQUIRES_MULTIVARIATE"
    UNSTABLE_MODEL = "TM_UNSTABLE_MODEL"
    NEAR_UNIT_ROOT = "TM_NEAR_UNIT_ROOT"
    RNG_CONTRACT_VIOLATION = "TM_RNG_CONTRACT_VIOLATION"
    OOB_UNAVAILABLE = "TM_OOB_UNAVAILABLE"


class TidemarkError(Exception):
    def __init__(self, message: str, *, code: str, **context: object) -> None:
        super().__init__(message)
        self.code, self.context = code, context

    def __reduce__(self):  # noqa: ANN204  (errors travel between processes)
        return (_remade, (type(self), str(self), self.code, self.context))


def _remade(kind: type[TidemarkError], message: str, code: str, context: dict) -> TidemarkError:
    return kind(message, code=code, **context)


class InputDataError(TidemarkError, ValueError):
    """The observations can't be used."""


class MethodConfigError(TidemarkError, ValueError):
    """A method, statistic or option can't be used, or not with this input."""


class ModelStabilityError(TidemarkError, RuntimeError):
    """A fitted model explodes."""


class OOBUnavailableError(TidemarkError, RuntimeError):
    """A method without observation indices was asked for out-of-bag rows."""


class RNGContractError(TidemarkError, TypeError):
    """Not a seed."""


class TidemarkWarning(UserWarning):
    pass


class NearUnitRootWarning(TidemarkWarning):
    pass


class DegenerateBlockBootstrapWarning(TidemarkWarning):
    pass
