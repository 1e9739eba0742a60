"""Index resampling: which observation stands at each place of a replicate.

One rule per method, two streams. "counter": Philox, a function of (seed, series, replicate, place), in numpy here and as
DataFrame columns in index_frame(); both give the same indices. "seedseq": a PCG64 generator for each replicate, spawned
from one root, bit for bit what numpy's spawn() gives.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Codes, DegenerateBlockBootstrapWarning, MethodConfigError, RNGContractError
from ..functions import philox
from ..specs import IID, CircularBlock, MethodSpec, MovingBlock, NonOverlappingBlock, StationaryBlock, TaperedBlock


def root_of(random_state: object) -> np.random.SeedSequence:
    """The root of all streams: None: fresh entropy; an integer; a SeedSequence; a Generator, of which four words are used."""
    if isinstance(random_state, np.random.SeedSequence):
        return random_state
    if random_state is None:
        return np.random.SeedSequence()
    if isinstance(random_state, np.random.Generator):
        return np.random.SeedSequence(random_state.integers(0, 2**32, size=4, dtype=np.uint32).tolist())
    if isinstance(random_state, (int, np.integer)) and not isinstance(random_state, bool) and random_state >= 0:
        return np.random.SeedSequence(int(random_state))
    raise RNGContractError("random_state must be None, an integer of 0 or more, a Generator or a SeedSequence", code=Codes.RNG_CONTRACT_VIOLATION, given=repr(random_state))


def seed64(random_state: object) -> int:
    """64 bits for the counter stream: a small integer is itself, so that SQL can repeat it."""
    if isinstance(random_state, (int, np.integer)) and not isinstance(random_state, bool) and 0 <= random_state < 2**63:
        return int(random_state)
    a, b = root_of(random_state).generate_state(2, np.uint32)
    return int(a) | (int(b) & 0x7FFFFFFF) << 32


def child(root: np.random.SeedSequence, *place: int) -> np.random.SeedSequence:
    """What root.spawn() gives at a place, anywhere and without spawning those before it."""
    first = place[0] + root.n_children_spawned
    return np.random.SeedSequence(root.entropy, spawn_key=(*root.spawn_key, first, *place[1:]), pool_size=root.pool_size)


def generators(root: np.random.SeedSequence, first: int, count: int) -> Iterator[np.random.Generator]:
    for b in range(first, first + count):
        yield np.random.default_rng(child(root, b))


def block_length(method: MethodSpec, n: int, warn: bool = True) -> int:
    """The length used with n observations; the spec's must be an integer by now ("auto" is resolved per series)."""
    if isinstance(method, IID):
        return 1
    length = int(method.block_length)
    if isinstance(method, StationaryBlock):
        return max(1, min(length, n))
    if length >= n and warn:
        warnings.warn(DegenerateBlockBootstrapWarning(f"block length {length} with {n} observations: each replicate is one block"), stacklevel=2)
    return min(length, n)


def check_length(length: int, n: int) -> None:
    if length > n:
        raise MethodConfigError(f"block length {length} exceeds {n} observations", code=Codes.BLOCK_LENGTH_GT_N, block_length=length, n=n)


def _from_starts(starts: np.ndarray, length: int, n: int, wrap: bool) -> np.ndarray:
    idx = (starts[:, :, None] + np.arange(length)).reshape(len(starts), -1)[:, :n]
    return idx % n if wrap else idx


def _segments(restart: np.ndarray, position: np.ndarray) -> np.ndarray:
    n = restart.shape[1]
    restart[:, 0] = True
    t = np.arange(n)
    at = np.maximum.accumulate(np.where(restart, t, 0), axis=1)
    return (np.take_along_axis(position, at, axis=1) + t - at) % n


def _starts_below(method: MethodSpec, length: int, n: int) -> tuple[int, int]:
    """(number of possible draws, factor) of a block's start."""
    if isinstance(method, CircularBlock):
        return n, 1
    if isinstance(method, NonOverlappingBlock):
        return max(1, n // length), length
    return n - length + 1, 1


def counter_starts(method: MethodSpec, length: int, n: int, seed: int, slot: int, first: int, count: int) -> np.ndarray:
    """(count, blocks) starts of a block method."""
    top, factor = _starts_below(method, length, n)
    return philox.draws(seed, philox.BLOCK_START, slot, first, count, -(-n // length), top) * factor


def counter_segments(length: int, n: int, seed: int, slot: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of stationary replicates: (begin, start) by segment, and the segment of each place (count, n).

    Segment lengths are geometric with mean `length`, from a word each; as many are drawn as the longest replicate needs.
    """
    begin, start = segment_table(length, n, seed, slot, first, count)
    edge = np.zeros((count, n), np.int64)
    row, k = np.nonzero((begin > 0) & (begin < n))
    edge[row, begin[row, k]] = 1
    return begin, start, np.cumsum(edge, axis=1)


def segment_table(length: int, n: int, seed: int, slot: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, start) of the segments of each replicate, enough of them to reach n."""
    k = min(n, 2 * -(-n // length) + 8)
    while True:
        sizes = geometric(philox.draws(seed, philox.RESTART, slot, first, count, k), length)
        end = np.cumsum(np.minimum(sizes, n), axis=1)
        if k == n or end[:, -1].min() >= n:
            break
        k = min(n, 2 * k)
    return end - np.minimum(sizes, n), philox.draws(seed, philox.SEGMENT_START, slot, first, count, k, n)


def geometric(words: np.ndarray, length: int) -> np.ndarray:
    """Lengths 1, 2, ... of mean `length` from 32-bit words, by inversion."""
    if length == 1:
        return np.ones(words.shape, np.int64)
    return 1 + np.floor(np.log((words.astype(float) + 0.5) * 2.0**-32) / np.log(1 - 1 / length)).astype(np.int64)


def counter_indices(method: MethodSpec, length: int, n: int, seed: int, slot: int, first: int, count: int) -> np.ndarray:
    """(count, n) indices of replicates first, first + 1, ..."""
    if isinstance(method, IID):
        return philox.draws(seed, philox.IID_INDEX, slot, first, count, n, n)
    if isinstance(method, StationaryBlock):
        begin, start, segment = counter_segments(length, n, seed, slot, first, count)
        t = np.arange(n)
        return (np.take_along_axis(start, segment, axis=1) + t - np.take_along_axis(begin, segment, axis=1)) % n
    return _from_starts(counter_starts(method, length, n, seed, slot, first, count), length, n, isinstance(method, CircularBlock))


def seedseq_indices(method: MethodSpec, length: int, n: int, root: np.random.SeedSequence, first: int, count: int) -> np.ndarray:
    """As counter_indices(), from one generator for each replicate."""
    blocks = -(-n // length)
    rows = []
    for g in generators(root, first, count):
        if isinstance(method, IID):
            rows.append(g.integers(0, n, size=n, dtype=np.int32))
        elif isinstance(method, StationaryBlock):
            restart = g.random(n) < 1.0 / length
            rows.append(_segments(restart[None], g.integers(0, n, size=n, dtype=np.int32)[None].astype(np.int64))[0])
        else:
            top, factor = _starts_below(method, length, n)
            rows.append(_from_starts(g.integers(0, top, size=blocks, dtype=np.int32)[None].astype(np.int64) * factor, length, n, isinstance(method, CircularBlock))[0])
    return np.array(rows, np.int32).reshape(count, n)


def taper(window: str, length: int, alpha: float = 0.5) -> np.ndarray:
    """Symmetric window of unit mean square; all ones where the window is zero throughout."""
    if length == 1:
        return np.ones(1)
    x = np.arange(length) / (length - 1)
    if window == "bartlett":
        w = 1 - np.abs(2 * x - 1)
    elif window == "hann":
        w = 0.5 - 0.5 * np.cos(2 * np.pi * x)
    elif window == "hamming":
        w = 0.54 - 0.46 * np.cos(2 * np.pi * x)
    elif window == "blackman":
        w = 0.42 - 0.5 * np.cos(2 * np.pi * x) + 0.08 * np.cos(4 * np.pi * x)
    else:
        edge = np.minimum(x, 1 - x)
        w = np.where(edge < alpha / 2, 0.5 - 0.5 * np.cos(2 * np.pi * edge / alpha), 1.0)
    size = np.sqrt(np.mean(w**2))
    return w / size if size > 0 else np.ones(length)


def tapered(values: np.ndarray, idx: np.ndarray, method: TaperedBlock, length: int) -> np.ndarray:
    """values (n, d), idx (B, n) -> (B, n, d): deviations from the mean, weighted by the place in the block."""
    weight = taper(method.window, length, method.alpha)[np.arange(idx.shape[1]) % length]
    mean = values.mean(axis=0)
    return mean + weight[None, :, None] * (values[idx] - mean)


def taper_column(method: TaperedBlock, place: Column, length: Column) -> Column:
    """The window of taper() at a place of a block of any length, not yet scaled to unit mean square."""
    x = place / F.greatest(length - 1, F.lit(1))
    wave = lambda k: F.cos(2 * k * np.pi * x)
    if method.window == "bartlett":
        return 1 - F.abs(2 * x - 1)
    if method.window == "hann":
        return 0.5 - 0.5 * wave(1)
    if method.window == "hamming":
        return 0.54 - 0.46 * wave(1)
    if method.window == "blackman":
        return 0.42 - 0.5 * wave(1) + 0.08 * wave(2)
    edge = F.least(x, 1 - x)
    return F.when(edge < method.alpha / 2, 0.5 - 0.5 * F.cos(2 * np.pi * edge / method.alpha)).otherwise(1.0)


def taper_scale(method: TaperedBlock, length: Column) -> Column:
    """What the window of a length is divided by, worked out once a series; null where all weights are one."""
    squares = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0.0), lambda a, i: a + F.pow(taper_column(method, i, length), 2))
    return F.when((length > 1) & (squares > 0), F.sqrt(squares / length))


# ---- the same as DataFrames -------------------------------------------------------------------------------------------


def replicates(sizes: DataFrame, n_bootstraps: int) -> DataFrame:
    """sizes (series_id, slot, n, length) times b = 0, 1, ...; dealt out again, since a small table times many is one task's."""
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bootstraps - 1))).alias("b"))
    return rows.repartition("series_id", "b")


def index_frame(sizes: DataFrame, method: MethodSpec, n_bootstraps: int, seed: int) -> DataFrame:
    """(series_id, b, t, idx) of all replicates of sizes (series_id, slot, n int, length int)."""
    rows = replicates(sizes, n_bootstraps)
    if isinstance(method, (IID, StationaryBlock)):
        purposes = [philox.IID_INDEX] if isinstance(method, IID) else [philox.RESTART, philox.SEGMENT_START]
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div 4 as int)"))).alias("k"))
        names = []
        for i, purpose in enumerate(purposes):
            names.append([f"p{i}_{j}" for j in range(4)])
            rows = philox.add_words(rows, [F.col("k"), F.col("b"), F.col("slot"), F.lit(purpose)], seed, names[-1])
        each = F.array(*[F.struct((F.col("k") * 4 + j).cast("int").alias("t"), *[F.col(n[j]).alias(f"w{i}") for i, n in enumerate(names)]) for j in range(4)])
        rows = rows.select("series_id", "b", "n", "length", F.explode(each).alias("e")).select("series_id", "b", "n", "length", "e.*").where("t < n")
        if isinstance(method, IID):
            return rows.select("series_id", "b", "t", philox.below(F.col("w0"), F.col("n")).cast("int").alias("idx"))
        # here t counts segments, each of at least one place
        u = F.log((F.col("w0") + 0.5) * 2.0**-32) / F.log(1 - 1 / F.nullif(F.col("length"), F.lit(1)))
        size = F.least(F.coalesce(1 + F.floor(u), F.lit(1)), F.col("n")).cast("int")
        upto = F.sum("size").over(Window.partitionBy("series_id", "b").orderBy("t"))
        segments = rows.withColumn("size", size).withColumn("begin", (upto - F.col("size")).cast("int")).where("begin < n")
        cells = segments.select("series_id", "b", "n", "begin", philox.below(F.col("w1"), F.col("n")).alias("at"), F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.col("n") - F.col("begin")) - 1)).alias("o"))
        return cells.select("series_id", "b", (F.col("begin") + F.col("o")).cast("int").alias("t"), F.pmod(F.col("at") + F.col("o"), F.col("n")).cast("int").alias("idx"))
    starts = start_frame(sizes, method, n_bootstraps, seed)
    idx = F.col("start") + F.col("o")
    cells = starts.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("length"), F.col("n") - F.col("k") * F.col("length")) - 1)).alias("o"))
    return cells.select("series_id", "b", (F.col("k") * F.col("length") + F.col("o")).cast("int").alias("t"), (F.pmod(idx, F.col("n")) if isinstance(method, CircularBlock) else idx).cast("int").alias("idx"))


def start_frame(sizes: DataFrame, method: MethodSpec, n_bootstraps: int, seed: int) -> DataFrame:
    """(series_id, b, k, start, n, length): one row a block; drawn by block, four draws from one permutation."""
    rows = replicates(sizes, n_bootstraps).select("*", F.expr("cast((n + length - 1) div length as int)").alias("blocks"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((blocks - 1) div 4 as int)"))).alias("k4"))
    rows = philox.add_words(rows, [F.col("k4"), F.col("b"), F.col("slot"), F.lit(philox.BLOCK_START)], seed)
    each = F.array(*[F.struct((F.col("k4") * 4 + j).cast("int").alias("k"), F.col(f"w{j}").alias("w")) for j in range(4)])
    rows = rows.select("series_id", "b", "n", "length", "blocks", F.explode(each).alias("e")).select("series_id", "b", "n", "length", "blocks", "e.*").where("k < blocks")
    if isinstance(method, NonOverlappingBlock):
        start = philox.below(F.col("w"), F.greatest(F.lit(1), F.expr("cast(n div length as int)"))) * F.col("length")
    elif isinstance(method, CircularBlock):
        start = philox.below(F.col("w"), F.col("n"))
    elif isinstance(method, (MovingBlock, TaperedBlock)):
        start = philox.below(F.col("w"), F.col("n") - F.col("length") + 1)
    else:
        raise MethodConfigError(f"no index rule for {method!r}", code=Codes.UNKNOWN_METHOD)
    return rows.select("series_id", "b", "k", start.cast("int").alias("start"), "n", "length")


def inbag_counts(indices: DataFrame) -> DataFrame:
    """(series_id, b, t, n_inbag) for every observation: how often replicate b holds it, also if never.

    Each place counts nothing for itself and one for the observation it holds, so one grouping does, on the partitions that
    the replicates are dealt by already.
    """
    each = F.explode(F.array(F.struct(F.col("t"), F.lit(0).alias("one")), F.struct(F.col("idx").alias("t"), F.lit(1).alias("one")))).alias("e")
    return indices.select("series_id", "b", each).groupBy("series_id", "b", F.col("e.t").alias("t")).agg(F.sum("e.one").alias("n_inbag"))


def out_of_bag(indices: DataFrame) -> DataFrame:
    """(series_id, b, t) of the observations that replicate b doesn't hold."""
    return inbag_counts(indices).where("n_inbag = 0").drop("n_inbag")


def gathered(rows: DataFrame, indices: DataFrame) -> DataFrame:
    """(series_id, b, t, idx, x): observations of rows (series_id, t, x) at the places of indices.

    Spark's estimates know nothing of how many rows an explode makes, so it would broadcast all replicates: the join is by sorting.
    """
    source = rows.select(F.col("series_id").alias("_s"), F.col("t").alias("_t"), "x").hint("merge")
    return indices.join(source, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("idx") == F.col("_t"))).select("series_id", "b", "t", "idx", "x")
