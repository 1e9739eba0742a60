import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.functions import philox
from tidemark.operators import resample
from tidemark.plans import api

# Known answers of Philox-4x32-10 for (counter, key) of zeros, ones and the digits of pi.
KNOWN = [
    ((0, 0, 0, 0), 0, (0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8)),
    ((0xFFFFFFFF,) * 4, 0xFFFFFFFFFFFFFFFF, (0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD)),
    ((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), 0x299F31D0A4093822, (0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1)),
]


@pytest.mark.parametrize(("counter", "seed", "words"), KNOWN)
def test_known_words(spark, counter, seed, words):
    assert tuple(int(x) for x in philox.words(tuple(np.array(c) for c in counter), seed)) == words
    row = philox.add_words(spark.range(1), [F.lit(c) for c in counter], seed).first()
    assert tuple(row)[1:] == words


def test_children_are_those_that_spawn_gives():
    root = np.random.SeedSequence(7)
    for b, s in enumerate(np.random.SeedSequence(7).spawn(5)):
        assert (resample.child(root, b).generate_state(4) == s.generate_state(4)).all()
    used = np.random.SeedSequence(7)
    used.spawn(3)
    assert (resample.child(used, 0).generate_state(4) == used.spawn(1)[0].generate_state(4)).all()


@pytest.mark.parametrize("bad", [-1, 1.5, "x", True])
def test_not_a_seed(bad):
    with pytest.raises(tm.RNGContractError):
        resample.root_of(bad)


METHODS = [tm.IID(), tm.MovingBlock(4), tm.CircularBlock(4), tm.NonOverlappingBlock(4), tm.StationaryBlock(4)]


@pytest.mark.parametrize("method", METHODS, ids=lambda m: m.kind)
def test_frames_and_kernels_draw_the_same(spark, method):
    rng = np.random.default_rng(0)
    series = tm.from_arrays([rng.normal(size=(n, 1)) for n in (3, 10, 11, 4)], spark)
    frame = resample.index_frame(api.with_lengths(series, method), method, 6, 99).toPandas().sort_values(["series_id", "b", "t"])
    for s, n in enumerate((3, 10, 11, 4)):
        length = resample.block_length(method, n, warn=False)
        want = resample.counter_indices(method, length, n, 99, s, 0, 6)
        got = frame[frame.series_id == s].idx.to_numpy().reshape(6, n)
        assert (got == want).all()
        assert ((want >= 0) & (want < n)).all()
        assert (resample.counter_indices(method, length, n, 99, s, 2, 3) == want[2:5]).all()  # a part is a part of the whole


@pytest.mark.parametrize("method", METHODS[1:4], ids=lambda m: m.kind)
def test_blocks_are_contiguous(method):
    idx = resample.counter_indices(method, 4, 11, 3, 0, 0, 50).reshape(50, 11)
    for k in range(0, 11, 4):
        steps = np.diff(idx[:, k : k + 4], axis=1)
        assert ((steps == 1) | (isinstance(method, tm.CircularBlock) & (steps == -10))).all()
    if isinstance(method, tm.NonOverlappingBlock):
        assert set(idx[:, 0]) <= {0, 4}


def test_results_do_not_depend_on_partitions(spark):
    series = tm.from_arrays([np.arange(20.0)[:, None], np.arange(7.0)[:, None]], spark)
    spread = tm.SeriesFrame(series.rows.repartition(7), 1, True)
    for s in (series, spread):
        got = [tuple(r) for r in tm.bootstrap_reduce_panel(s, method=tm.MovingBlock(3), statistic="mean", n_bootstraps=9, random_state=5).long().orderBy("series_id", "b").collect()]
        first = got if s is series else first
    assert got == first


def test_segments_are_geometric():
    begin, start = resample.segment_table(5, 4000, 1, 0, 0, 20)
    sizes = np.diff(np.minimum(begin, 4000), axis=1)
    assert abs(sizes[sizes > 0].mean() - 5) < 0.2 and start.max() < 4000
    assert (resample.geometric(np.array([0, 2**32 - 1], np.uint64), 1) == 1).all()
    assert resample.geometric(np.array([2**32 - 1], np.uint64), 9) == 1


@pytest.mark.parametrize("length", [1, 3, 40])
def test_stationary_means_are_means(length):
    from tidemark.operators.engine import make_job, statistics_of
    from tidemark.operators.reduce import statistic_of

    x = np.random.default_rng(0).normal(size=(37, 2))
    got = statistics_of(make_job(tm.StationaryBlock(length), 30, 3, "counter"), statistic_of("mean"), x, 2, 0, 30)
    idx = resample.counter_indices(tm.StationaryBlock(length), min(length, 37), 37, 3, 2, 0, 30)
    np.testing.assert_allclose(got, x[idx].mean(axis=1), atol=1e-12)
