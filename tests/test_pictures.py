"""Pictures as rows: resampling against direct convolution, previews, measures, covers."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.functions import pixels
from lumiquarry.sources import pictures


def direct(x, width, height):
    """Each new pixel as a sum over all old ones."""
    kernel = lambda t: np.sinc(t) * np.sinc(t / 3) if abs(t) < 3 else 0.0
    out = np.zeros((height, width, 3))
    sy, sx = max(x.shape[0] / height, 1), max(x.shape[1] / width, 1)
    for i in range(height):
        for j in range(width):
            wy = np.array([kernel((k + 0.5 - (i + 0.5) * x.shape[0] / height) / sy) for k in range(x.shape[0])])
            wx = np.array([kernel((k + 0.5 - (j + 0.5) * x.shape[1] / width) / sx) for k in range(x.shape[1])])
            w = np.outer(wy / wy.sum(), wx / wx.sum())
            out[i, j] = (w[..., None] * x).sum(axis=(0, 1))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size", [(7, 5), (20, 3), (1, 1), (13, 17)])
def test_resampling_is_convolution(size):
    x = np.random.default_rng(3).integers(0, 256, (17, 13, 3), np.uint8)
    got = pixels.lanczos(x, *size)
    assert np.abs(got.astype(int) - direct(x, *size)).max() <= 1 and (got == direct(x, *size)).mean() > 0.99
    assert (pixels.lanczos(x, 13, 17) == x).all() and (pixels.lanczos(np.full((9, 9, 3), 77, np.uint8), 4, 4) == 77).all()


def test_png():
    x = np.random.default_rng(1).integers(0, 256, (5, 4, 3), np.uint8)
    data = pixels.png(x)
    at = data.index(b"IDAT")
    n = int.from_bytes(data[at - 4 : at], "big")
    raw = zlib.decompress(data[at + 4 : at + 4 + n])
    assert (np.frombuffer(raw, np.uint8).reshape(5, 13)[:, 1:].reshape(5, 4, 3) == x).all() and data[16:24] == b"\0\0\0\4\0\0\0\5"


def frames(spark, rows):
    return spark.createDataFrame([(k, w, h, None if p is None else bytearray(p), "x", 1.0) for k, w, h, p in rows], "path string, width int, height int, pixels binary, size string, exposure double")


def test_previews_and_measures(spark, tmp_path):
    r = np.random.default_rng(2)
    big, small = r.integers(0, 256, (300, 1500, 3), np.uint8), r.integers(0, 256, (20, 30, 3), np.uint8)
    rows = [("big", 1500, 300, big.tobytes()), ("small", 30, 20, small.tobytes()), ("short", 30, 20, b"abc"), ("null", 30, 20, None), ("zero", 0, 20, b""), ("no", None, 20, b"")]
    df = frames(spark, rows)
    got = {(x["path"], x["size"]): x for x in pictures.previews(df).collect()}
    assert {k: (x["width"], x["height"]) for k, x in got.items()} == {("big", "thumb"): (256, 51), ("big", "preview"): (1024, 204), ("small", "thumb"): (30, 20), ("small", "preview"): (30, 20)}
    assert bytes(got["small", "thumb"]["pixels"]) == small.tobytes() and bytes(got["big", "thumb"]["pixels"]) == pixels.lanczos(big, 256, 51).tobytes()
    m = {x["path"]: x for x in pictures.measured(df).collect()}
    assert m["big"]["sharpness"] == pytest.approx(pixels.laplacian_variance(big)) and m["small"]["exposure"] == pytest.approx(pixels.exposure(small)["score"]) and not m["small"]["low_light"]
    assert all(m[k]["sharpness"] is None and m[k]["low_light"] is None for k in ("short", "null", "zero", "no")) and len(m) == 6
    t = {x["path"]: x for x in pictures.toned(df).collect()}
    assert bytes(t["small"]["pixels"]) == pixels.auto_tone(small).tobytes() and t["null"]["pixels"] is None
    for _ in range(2):  # again over what is there
        files = pictures.previews_written(df.withColumnRenamed("path", "sha256"), str(tmp_path)).collect()
        assert len(files) == 4 and all(open(x["path"], "rb").read(4) == b"\x89PNG" for x in files)
        assert sorted(os.listdir(tmp_path / "thumb")) == ["big.png", "small.png"]
    assert pictures.measured(df.where("false")).count() == pictures.previews(df.where("false")).count() == 0


def test_covers(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.png").write_bytes(b"x")
    rows = [(1, "gone.png", 9.0), (2, str(tmp_path / "c.png"), 5.0), (3, str(tmp_path / "b.png"), 5.0), (4, None, 8.0), (5, str(tmp_path / "b.png"), None)]
    df = spark.createDataFrame(rows, "photo_id long, thumb string, score double")
    pick = lambda d, **more: [tuple(x) for x in pictures.cover(d, F.col("score"), "thumb", **more).collect()]
    assert pick(df) == [(2, str(tmp_path / "c.png"))] and pick(df, most=2) == [] and pick(df.where("photo_id = 5")) == [(5, str(tmp_path / "b.png"))] and pick(df.where("false")) == []
