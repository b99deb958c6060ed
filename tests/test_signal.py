import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from songloom.operators import signal as sg

SR, N = 48000, 16384
SCHEMA = "clip_id string, sr int, block_idx bigint, left array<float>, right array<float>, mode string"


def tone(freq):
    return (0.5 * np.sin(2 * np.pi * freq * np.arange(N) / SR)).astype(np.float32)


@pytest.fixture(scope="module")
def clips(spark):
    silence = np.zeros(N, np.float32)
    sounds = {"center": (tone(1000), tone(1000)), "left": (tone(1000), silence), "bass": (tone(60), tone(60))}
    rng = np.random.default_rng(3)
    sounds["noise"] = tuple(rng.normal(0, .2, N).astype(np.float32) for _ in range(2))
    rows = [(c, SR, i, l[i * 128:(i + 1) * 128].tolist(), r[i * 128:(i + 1) * 128].tolist(), "stft")
            for c, (l, r) in sounds.items() for i in range(N // 128)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def signal(df, clip, side="left"):
    rows = df.filter(F.col("clip_id") == clip).orderBy("block_idx").select(side).collect()
    return np.concatenate([np.array(r[0], np.float64) for r in rows])


def ratios(clips, out, first, last):
    return {r["clip_id"]: (r["ratio"], r["finite"]) for r in sg.signal_quality(clips, out, first, last).collect()}


def test_spectral_mode_bounds(clips):
    got = ratios(clips, sg.remove_center(clips, 0.85), 32, 95)
    assert all(finite for _, finite in got.values())
    assert got["center"][0] < 0.5 and got["left"][0] > 1.3 and got["bass"][0] > 1.2
    whole = ratios(clips, sg.remove_center(clips, 0.0), 32, 95)
    assert 1.4 < whole["center"][0] < 1.6


def test_basic_mode_bounds(clips):
    got = ratios(clips, sg.center_cancel(clips, 0.85), 16, 79)
    assert got["center"][0] < 0.4 and got["left"][0] > 0.5 and got["bass"][0] > 0.7
    kept = ["clip_id", "block_idx", "left", "right"]
    assert sg.center_cancel(clips, 0).exceptAll(clips.select(kept)).count() == 0


def test_spans_do_not_show(clips):
    one = clips.filter("clip_id = 'noise'")
    jobs = [lambda n: sg.remove_center(one, 0.85, 1.0, span_hops=n)]
    jobs += [lambda n, m=m: sg.mode_dispatch(one.withColumn("mode", F.lit(m)), span_hops=n) for m in ("basic", "stft_deep")]
    for job in jobs:
        whole, cut = signal(job(256), "noise"), signal(job(6), "noise")
        assert len(whole) == len(cut) == N and np.allclose(whole, cut, atol=1e-7)
    low = np.zeros(N)
    x, a, y = signal(one, "noise"), sg.bass_coefficient(SR), 0.0
    for i in range(N):
        y += a * (x[i] - y)
        low[i] = y
    assert np.allclose(sg._low_pass(x, a), low, atol=1e-12)


@pytest.mark.parametrize("depth", [0.0, 1.0])
def test_staged_operators_equal_the_fused_job(clips, depth):
    one = clips.filter("clip_id = 'noise'")
    table = sg.frames(one)
    assert table.count() == (N - sg.FFT) // sg.HOP + 1
    staged = sg.overlap_add(sg.attenuate_center(table, 0.85, depth))
    rows = {r["hop_idx"]: np.array(r["left"]) for r in staged.collect()}
    fused = signal(sg.remove_center(one, 0.85, depth), "noise")
    for hop in range(4, N // sg.HOP):
        assert np.allclose(rows[hop], fused[hop * sg.HOP:(hop + 1) * sg.HOP], atol=1e-6)
    assert not fused[: sg.FFT].any()


def test_features_weights_and_modes(spark, clips):
    feature = sg.spectral_features(sg.frames(clips.filter("clip_id in ('center', 'left')")))
    peak = round(1000 / (SR / sg.FFT))
    got = {r["clip_id"]: r["c"] for r in feature.groupBy("clip_id").agg(F.avg(F.get("centerness", F.lit(peak))).alias("c")).collect()}
    assert got["center"] > 0.99 and got["left"] < 0.01
    table = {r["bin"]: (r["band"], r["core"]) for r in sg.bin_weights(spark, SR).collect()}
    assert table[0] == (0.0, 0.0) and table[100] == (1.0, 1.0) and table[1000] == (0.0, 0.0)
    mono = clips.filter("clip_id = 'center'").withColumn("right", F.lit(None).cast("array<float>"))
    modes = mono.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in sg.MODES])))
    modes = modes.withColumn("clip_id", F.concat("clip_id", F.lit("-"), "mode"))
    quality = ratios(modes, sg.mode_dispatch(modes), 32, 95)
    assert quality["center-passthrough_muted"][0] == 0 and quality["center-stft"][0] < 0.5
    assert quality["center-stft_deep"][0] < quality["center-stft"][0] and quality["center-basic"][0] < 0.4


@pytest.mark.parametrize("sr, block", [(48000, 128), (8000, 128), (44100, 4096)])
def test_states_equal_a_loop_over_a_million_samples(spark, sr, block):
    """Also with blocks missing, which count as silence."""
    n = 10**6 // block
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.3, (n, block)).astype(np.float32)
    x[n // 3 : n // 3 + 5] = 0
    there = [i for i in range(n) if not n // 3 <= i < n // 3 + 5]
    table = pd.DataFrame({"clip_id": "c", "sr": sr, "block_idx": there, "left": [x[i].tolist() for i in there], "right": [x[i, ::-1].tolist() for i in there]})
    clips = spark.createDataFrame(table, "clip_id string, sr int, block_idx bigint, left array<float>, right array<float>")
    states = sg.bass_states(clips, block).select("block_idx", "low_l", "low_r").toPandas().set_index("block_idx").sort_index()
    a = sg.bass_coefficient(sr)
    for side, column in ((x, "low_l"), (x[:, ::-1], "low_r")):
        y, want = 0.0, []
        for row in side.astype(np.float64).tolist():
            want.append(y)
            for v in row:
                y += a * (v - y)
        assert np.abs(states[column].to_numpy() - np.array(want)[there]).max() < 1e-12


def test_missing_blocks_are_silent(clips):
    one = clips.filter("clip_id = 'noise'")
    gap = F.col("block_idx").between(40, 47)
    zero = F.transform("left", lambda _: F.lit(0.0).cast("float"))
    silent = one.withColumns({s: F.when(gap, zero).otherwise(F.col(s)) for s in ("left", "right")})
    holed = one.filter(~gap)
    for job in (lambda d: sg.remove_center(d, span_hops=6), lambda d: sg.mode_dispatch(d.withColumn("mode", F.lit("basic")), span_hops=6)):
        assert np.allclose(signal(job(holed), "noise"), signal(job(silent), "noise"), atol=1e-7)
    kept = sg.center_cancel(silent).filter(~gap)
    assert np.allclose(signal(sg.center_cancel(holed), "noise"), signal(kept, "noise"), atol=1e-7)


def test_modes_read_the_samples_once(spark, clips, tmp_path):
    clips.write.parquet(str(tmp_path / "clips"))
    plan = sg.mode_dispatch(spark.read.parquet(str(tmp_path / "clips")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("left" in line for line in scans) == 1 and plan.count("FlatMapGroupsInPandas") == 1
    noise = clips.filter("clip_id = 'noise'")
    one = noise.withColumn("mode", F.lit("stft_deep"))
    assert np.allclose(signal(sg.mode_dispatch(one), "noise"), signal(sg.remove_center(noise, 0.85, 1.0), "noise"), atol=1e-7)
    basic = noise.withColumn("mode", F.lit("no such mode"))
    assert np.allclose(signal(sg.mode_dispatch(basic), "noise"), signal(sg.center_cancel(noise), "noise"), atol=1e-6)
