"""BCa: replicates that equal the estimate but for the order of their sums count as ties."""

import numpy as np
import pytest

from tidemark.operators import intervals

EXACT = np.array([1.0, 1.25, 1.5, 1.75, 2.0, 2.0, 2.0, 2.5, 3.0, 3.5])


@pytest.mark.parametrize("way", [0.0, 3.0])
def test_sums_in_another_order_are_ties(spark, way):
    noisy = np.where(EXACT == 2, np.nextafter(2.0, way), EXACT)
    want = intervals.bca_interval(EXACT, np.array(2.0), np.array(0.01), 0.2)
    np.testing.assert_allclose(intervals.bca_interval(noisy, np.array(2.0), np.array(0.01), 0.2), want, rtol=1e-12)
    statistics = spark.createDataFrame([(1, b, float(x)) for b, x in enumerate(noisy)], "series_id long, b int, theta double")
    points, accelerations = spark.createDataFrame([(1, 2.0)], "series_id long, point double"), spark.createDataFrame([(1, 0.01)], "series_id long, acceleration double")
    row = intervals.bca_frame(statistics, points, accelerations, 0.2).first()
    np.testing.assert_allclose((row["lower"], row["upper"]), want, rtol=1e-12)
