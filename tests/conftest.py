import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def series_frame(spark):
    """Three series, one with most of the rows, one with three; irregular times; some nulls."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for name, n in (("hot", 700), ("mid", 95), ("tiny", 3)):
        at = np.cumsum(rng.integers(0, 4_000_000, n)) + 1_564_000_000_000_000
        x = 50 + np.cumsum(rng.normal(0, 0.02, n))
        v = np.where(rng.random(n) < 0.25, np.nan, np.round(rng.normal(5, 3, n), 3))
        parts.append(pd.DataFrame({"series": name, "us": at, "id": np.arange(n) + 1000 * len(parts), "x": x, "v": v}))
    pdf = pd.concat(parts, ignore_index=True)
    rows = [
        (r.series, int(r.us), int(r.id), float(r.x), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()
    ]
    df = spark.createDataFrame(rows, "series string, us bigint, id bigint, x double, v double")
    return df.selectExpr("series", "timestamp_micros(us) AS ts", "id", "x", "v").repartition(5)
