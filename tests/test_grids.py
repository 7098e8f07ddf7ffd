"""Grids by blocks: many tasks read and write one file."""

import numpy as np
import pytest

from mosaiq.sources import grids


def test_a_grid_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "SPLIT_BYTES", 4096)
    monkeypatch.setattr(grids, "BLOCK_CELLS", 700)
    x = np.random.default_rng(0).normal(size=(101, 67)).astype(np.float32)
    rows = [(a, b, float(v)) for (a, b), v in np.ndenumerate(x) if (a + b) % 5 and a not in (40, 41)]
    path = str(tmp_path / "g.sgrd")
    df = spark.createDataFrame([*rows, (40, 3, None)], "r int, c int, value double").repartition(5)
    grids.write_grid(df, path, 67, 101, nodata=-5.0)
    raw = np.fromfile(tmp_path / "g.sdat", "<f4").reshape(101, 67)[::-1]
    assert (raw[40] == -5).all() and raw[3, 3] == x[3, 3] and not list(tmp_path.glob("*.tmp"))
    got = grids.read_grid(spark, path)
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    text = (tmp_path / "g.sgrd").read_text()
    (tmp_path / "g.sgrd").write_text(text.replace("TOPTOBOTTOM\t= FALSE", "TOPTOBOTTOM\t= TRUE"))
    assert {(100 - r, c, v) for r, c, v in got.collect()} == {tuple(r) for r in grids.read_grid(spark, path).collect()}
    grids.write_grid(df.limit(0), path, 3, 2)
    assert grids.read_grid(spark, f"file://{path}").count() == 0 and (tmp_path / "g.sdat").stat().st_size == 24


def test_bad_grids(spark, tmp_path):
    path = str(tmp_path / "b.sgrd")
    df = lambda rows: spark.createDataFrame(rows, "r int, c int, value double")
    with pytest.raises(ValueError, match="outside"):
        grids.write_grid(df([(0, 3, 1.0)]), path, 3, 3)
    with pytest.raises(ValueError, match="one cell"):
        grids.write_grid(df([(0, 2, 1.0), (0, 2, 2.0)]), path, 3, 3)
    grids.write_grid(df([(0, 2, 1.0)]), path, 3, 3)
    (tmp_path / "b.sdat").write_bytes(b"\0" * 35)
    with pytest.raises(ValueError, match="35 bytes"):
        grids.read_grid(spark, path)
