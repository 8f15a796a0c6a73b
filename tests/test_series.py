"""Stencils over whole signals, against plain Python."""

from collections import defaultdict

from tessera.operators import series
from tessera.plans import bank

SIGNALS = {1: [5.0], 2: [1.0, 4.0], 3: [float((k * k) % 11) for k in range(7)], 4: [float((7 * k) % 13) for k in range(9)], None: [float(k % 5) for k in range(99)]}


def signals(spark):
    return spark.createDataFrame([(u, i, v) for u, s in SIGNALS.items() for i, v in enumerate(s)], "user_id long, i long, value double")


def upsampled(s, target):
    out = []
    for x in range(target):
        at = x * (len(s) - 1) / max(1, target - 1)
        low = min(int(at + 1e-9), len(s) - 1)
        out.append(s[low] + (at - low) * (s[min(low + 1, len(s) - 1)] - s[low]))
    return out


def test_upsample_takes_whole_signals(spark):
    for factor in (1, 2, 3):
        got = defaultdict(dict)
        for r in series.upsample(signals(spark), ["user_id"], "i", "value", factor).collect():
            assert r.x not in got[r.user_id]
            got[r.user_id][r.x] = r.value
        assert set(got) == set(SIGNALS)
        for u, s in SIGNALS.items():
            want = upsampled(s, factor * len(s))
            assert sorted(got[u]) == list(range(len(want))) and all(abs(got[u][x] - v) < 1e-9 for x, v in enumerate(want))


def test_upsample_signal_uses_every_event(spark):
    import pytest

    from test_bank import SF

    try:
        n = spark.read.parquet(f"{SF}/events.parquet").count()
    except Exception:
        pytest.skip("no test data")
    assert bank.QUERIES["upsample_signal"](spark, SF).count() == 2 * n


def test_downsampling_blurs_first(spark):
    got = {(r.user_id, r.i): r.y16 for r in series.blur_downsample2(signals(spark), ["user_id"], ["i"], "i", "value").collect()}
    want = {}
    for u, s in SIGNALS.items():
        at = lambda k, s=s: s[min(max(k, 0), len(s) - 1)]
        for k in range(0, len(s), 2):
            want[u, k // 2] = sum(w * at(k + d) for d, w in zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True))
    assert got == want


def test_downsample_blurred_has_the_values(spark):
    assert {"event_id", "half", "y16"} <= set(bank.QUERIES["downsample_blurred"](spark, "/root/testdata/sf0.001").columns)
