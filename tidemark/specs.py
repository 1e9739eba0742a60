"""What to do: frozen specifications of methods, models, innovations and calibrators."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar, Literal

from .errors import Codes, MethodConfigError


def _need(ok: bool, message: str, **context: object) -> None:
    if not ok:
        raise MethodConfigError(message, code=Codes.INVALID_PARAMETER, **context)


def _whole(value: object, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def _length(value: object, name: str) -> None:
    _need(value == "auto" or _whole(value, 1), f"{name} must be an integer of 1 or more, or 'auto'", given=value)


@dataclass(frozen=True)
class MethodSpec:
    kind: ClassVar[str] = ""


@dataclass(frozen=True)
class IID(MethodSpec):
    kind = "iid"


@dataclass(frozen=True)
class _Block(MethodSpec):
    block_length: int | Literal["auto"] = "auto"

    def __post_init__(self) -> None:
        _length(self.block_length, "block_length")


@dataclass(frozen=True)
class MovingBlock(_Block):
    kind = "moving_block"


@dataclass(frozen=True)
class CircularBlock(_Block):
    kind = "circular_block"


@dataclass(frozen=True)
class NonOverlappingBlock(_Block):
    kind = "non_overlapping_block"


@dataclass(frozen=True)
class StationaryBlock(MethodSpec):
    avg_block_length: int | Literal["auto"] = "auto"
    kind = "stationary_block"

    def __post_init__(self) -> None:
        _length(self.avg_block_length, "avg_block_length")

    @property
    def block_length(self) -> int | str:
        return self.avg_block_length


WINDOWS = ("bartlett", "blackman", "hamming", "hann", "tukey")


@dataclass(frozen=True)
class TaperedBlock(_Block):
    window: str = "bartlett"
    alpha: float = 0.5
    kind = "tapered_block"

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.window in WINDOWS, f"window must be one of {WINDOWS}", given=self.window)
        _need(0 < self.alpha <= 1, "alpha must be in (0, 1]", given=self.alpha)


DISTRIBUTIONS = ("rademacher", "gaussian", "mammen")


@dataclass(frozen=True)
class Wild(MethodSpec):
    """An innovation: residuals stay in place and get random signs or weights."""

    distribution: str = "rademacher"
    kind = "wild"

    def __post_init__(self) -> None:
        _need(self.distribution in DISTRIBUTIONS, f"distribution must be one of {DISTRIBUTIONS}", given=self.distribution)


@dataclass(frozen=True)
class BlockWild(Wild):
    """As Wild, with one weight for each block of residuals."""

    block_length: int | Literal["auto"] = "auto"
    kind = "block_wild"

    def __post_init__(self) -> None:
        super().__post_init__()
        _length(self.block_length, "block_length")


@dataclass(frozen=True)
class _Recursive:
    burn_in: int = 0
    initial: str = "fixed"
    stability_policy: str = "raise"

    def __post_init__(self) -> None:
        _need(_whole(self.burn_in, 0), "burn_in must be 0 or more", given=self.burn_in)
        _need(self.initial in ("fixed", "random_block"), "initial must be 'fixed' or 'random_block'", given=self.initial)
        _need(self.stability_policy in ("raise", "skip"), "stability_policy must be 'raise' or 'skip'", given=self.stability_policy)


@dataclass(frozen=True)
class AR(_Recursive):
    order: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(_whole(self.order, 1), "order must be 1 or more", given=self.order)


@dataclass(frozen=True)
class VAR(AR):
    pass


@dataclass(frozen=True)
class ARIMA:
    order: tuple[int, int, int] = (1, 0, 0)
    stability_policy: str = "raise"

    def __post_init__(self) -> None:
        _need(len(self.order) == 3 and all(_whole(x, 0) for x in self.order), "order must be three integers of 0 or more", given=self.order)
        _need(self.order[0] > 0 or self.order[2] > 0, "order needs p > 0 or q > 0", given=self.order)
        _need(self.stability_policy in ("raise", "skip"), "stability_policy must be 'raise' or 'skip'", given=self.stability_policy)


@dataclass(frozen=True)
class ResidualBootstrap(MethodSpec):
    model: AR | VAR | ARIMA = field(default_factory=AR)
    innovation: MethodSpec = field(default_factory=IID)
    kind = "residual"


@dataclass(frozen=True)
class SieveAR(_Recursive, MethodSpec):
    min_lag: int = 1
    max_lag: int | None = None
    criterion: str = "bic"
    innovation: MethodSpec = field(default_factory=IID)
    kind = "sieve_ar"

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(_whole(self.min_lag, 1), "min_lag must be 1 or more", given=self.min_lag)
        _need(self.max_lag is None or _whole(self.max_lag, self.min_lag), "max_lag must be min_lag or more", given=self.max_lag)
        _need(self.criterion in ("aic", "bic", "hqic"), "criterion must be 'aic', 'bic' or 'hqic'", given=self.criterion)


OBSERVATION_METHODS = (IID, MovingBlock, CircularBlock, NonOverlappingBlock, StationaryBlock, TaperedBlock)


@dataclass(frozen=True)
class CalibratorSpec:
    pass


@dataclass(frozen=True)
class Static(CalibratorSpec):
    pass


@dataclass(frozen=True)
class SlidingWindow(CalibratorSpec):
    window: int | None = None

    def __post_init__(self) -> None:
        _need(self.window is None or _whole(self.window, 1), "window must be 1 or more", given=self.window)


@dataclass(frozen=True)
class ACI(CalibratorSpec):
    gamma: float = 0.05

    def __post_init__(self) -> None:
        _need(self.gamma >= 0, "gamma must be 0 or more", given=self.gamma)


@dataclass(frozen=True)
class NexCP(CalibratorSpec):
    decay: float = 0.99

    def __post_init__(self) -> None:
        _need(0 < self.decay <= 1, "decay must be in (0, 1]", given=self.decay)


@dataclass(frozen=True)
class AgACI(CalibratorSpec):
    gammas: tuple[float, ...] | None = None
    require_signed: bool = True
    boa_regret_constant: float = 2.2
    infinite_sentinel: float | None = None

    def __post_init__(self) -> None:
        _need(self.gammas is None or (len(self.gammas) > 0 and all(g >= 0 for g in self.gammas)), "gammas must be 0 or more", given=self.gammas)
        _need(self.boa_regret_constant > 0, "boa_regret_constant must be positive", given=self.boa_regret_constant)
