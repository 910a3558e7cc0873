from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("gridspark-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("test tables are not there")
    return str(DATA)


@pytest.fixture(scope="session")
def make_fields(spark):
    """A grid table from arrays of shape (time, ny, nx), one column per named array."""
    import numpy as np

    def build(grid=None, **arrays):
        first = next(iter(arrays.values()))
        nt, ny, nx = first.shape
        t, iy, ix = (a.ravel().tolist() for a in np.meshgrid(range(nt), range(ny), range(nx), indexing="ij"))
        cols = [a.ravel() for a in arrays.values()]
        rows = [(a, b, c, *[None if np.isnan(v[i]) else float(v[i]) for v in cols])
                for i, (a, b, c) in enumerate(zip(t, iy, ix))]
        df = spark.createDataFrame(rows, "time bigint, iy int, ix int, " + ", ".join(f"{n} double" for n in arrays))
        if grid is not None:
            from pyspark.sql import functions as F
            df = df.withColumns({"lat": grid.y0 + grid.dy * F.col("iy"), "lon": grid.x0 + grid.dx * F.col("ix")})
        return df
    return build


@pytest.fixture(scope="session")
def to_array():
    """The array of shape (time, ny, nx) of one column."""
    import numpy as np

    def build(df, value):
        rows = df.select("time", "iy", "ix", value).collect()
        shape = [max(r[i] for r in rows) + 1 for i in range(3)]
        out = np.full(shape, np.nan)
        for t, iy, ix, v in rows:
            out[t, iy, ix] = np.nan if v is None else v
        return out
    return build
