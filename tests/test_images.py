"""Image metrics of colour frames against plain loops."""

import colorsys

import numpy as np
import pytest

from strandlight.operators import images


def plain_sharpness(levels):
    h, w = levels.shape
    at = lambda y, x: int(levels[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x])
    values = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    return float(np.var(values))


def test_frames_of_a_file(spark):
    rng = np.random.default_rng(3)
    shots = [rng.integers(0, 256, (9, 11, 3), np.uint8) for _ in range(3)]
    rows = [("f", float(t), 9, 11, bytearray(x.tobytes())) for t, x in enumerate(shots)] + [("f", 3.0, 9, 11, None), ("f", 4.0, 9, 11, bytearray(b"short")), ("g", 0.0, 9, 11, bytearray(shots[0].tobytes()))]
    df = spark.createDataFrame(rows, "file_id string, time_s double, height int, width int, pixels binary")
    got = {(r.file_id, r.time_s): r for r in images.frame_metrics(df).collect()}
    assert len(got) == 6 and got["f", 3.0].sharpness is None and got["f", 4.0].motion is None
    levels = [images.gray(x) for x in shots]
    for t, x in enumerate(shots):
        r, flat = got["f", float(t)], x.reshape(-1, 3).astype(int)
        assert np.abs(levels[t].ravel() - flat @ np.array([0.299, 0.587, 0.114])).max() <= 0.51
        assert r.sharpness == pytest.approx(plain_sharpness(levels[t]))
        rg, yb = flat[:, 0] - flat[:, 1], (flat[:, 0] + flat[:, 1]) / 2 - flat[:, 2]
        assert r.colorfulness == pytest.approx((np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())) / 255)
        assert r.exposure_clipped == np.isin(levels[t], (0, 255)).mean()
        assert sum(r.histogram) == pytest.approx(1) and r.histogram[int(flat[0, 0] // 32 * 64 + flat[0, 1] // 32 * 8 + flat[0, 2] // 32)] > 0
        before = levels[t - 1] if t else levels[1]
        assert r.motion == pytest.approx(np.abs(levels[t] - before).mean() / 255)
    tones = [images.hsv(x) for x in shots]
    for x, tone in zip(shots, tones):
        for rgb, (h, s, v) in zip(x.reshape(-1, 3) / 255, tone.reshape(-1, 3)):
            eh, es, ev = colorsys.rgb_to_hsv(*rgb)
            assert abs(s - es * 255) <= 1 and v == round(ev * 255) and min(abs(h - eh * 180), 180 - abs(h - eh * 180)) <= 1
    assert got["f", 0.0].content == 0 and got["f", 1.0].content == pytest.approx(np.abs(tones[1] - tones[0]).mean() / 255)
    assert got["g", 0.0].motion == 0 and got["g", 0.0].hash == got["f", 0.0].hash
    assert images.center(shots[0], 0.5).shape == (4, 6, 3) and images.sharpness(levels[0][:1]) >= 0
    assert images.frame_metrics(df.limit(0)).count() == 0
