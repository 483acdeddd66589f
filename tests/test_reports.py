"""Reports over feature tables with constant and missing columns."""

from __future__ import annotations

import pytest

from ledgersignal.operators import evaluate as EV


def test_correlation_of_constant_missing_and_equal_columns(spark):
    rows = [(0, 1.0, 3.0, None, 5.0), (1, 1.0, 4.0, None, None), (1, 1.0, 4.0, 2.0, 6.0), (0, 1.0, 3.0, None, 5.0)]
    df = spark.createDataFrame(rows, "y int, same double, twin double, rare double, part double")
    got = {r["feature"]: r["abs_corr"] for r in EV.corr_with_target(df, "y", ["same", "twin", "rare", "part"]).collect()}
    assert got == {"same": None, "twin": pytest.approx(1.0), "rare": None, "part": pytest.approx(1.0)}
