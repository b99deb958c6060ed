"""Windowed spectral jobs over tables of stereo PCM.

Clips arrive as blocks: ``clip_id, sr, block_idx, left, right`` with a fixed number of
samples per block. A clip of any length is cut into *spans* of whole hops; each span
takes the neighbouring blocks it needs along, so spans are independent, a group holds a
fixed number of samples, and the samples are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FFT, HOP = 2048, 512
OVERLAP = FFT // HOP
SPAN_HOPS = 256
BLOCK = 128

# Band edges in Hz, bass cut-off, and strength of the deep mode.
RAMP_LOW, FULL_LOW, FULL_HIGH, RAMP_HIGH = 90.0, 160.0, 9000.0, 12000.0
CORE_EDGES = (180.0, 300.0, 5000.0, 8000.0)
DEEP_LOW, DEEP_HIGH, DEEP_ATTEN, DEEP_LIFT, DEEP_SIDE = 60.0, 1500.0, 0.85, 0.2, 0.7
EXPONENT, EXPONENT_DROP, EXPONENT_MIN = 1.5, 1.2, 0.3
EPS = 1e-9
BASS_CUTOFF = 150.0

_BLOCK_SCHEMA = "clip_id {id}, block_idx bigint, left array<float>, right array<float>"


def _id_type(clips: DataFrame) -> str:
    return clips.schema["clip_id"].dataType.simpleString()


# ── Weights and kernels ──────────────────────────────────────────────────────

def hann() -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(FFT) / FFT))


def _trapezoid(freq: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    """Raised-cosine weight: 0 up to ``a``, 1 between ``b`` and ``c``, 0 from ``d``."""
    rise = np.clip((freq - a) / (b - a), 0.0, 1.0)
    fall = np.clip((d - freq) / (d - c), 0.0, 1.0)
    return 0.5 * (1.0 - np.cos(np.pi * np.minimum(rise, fall)))


def band_weight(freq: np.ndarray, depth: float = 0.0) -> np.ndarray:
    """How much a frequency may be attenuated."""
    return _trapezoid(
        freq, RAMP_LOW, FULL_LOW - DEEP_LOW * depth, FULL_HIGH + DEEP_HIGH * depth, RAMP_HIGH + DEEP_HIGH * depth
    )


def vocal_core_weight(freq: np.ndarray) -> np.ndarray:
    """How much of the side signal the deep mode may thin."""
    return _trapezoid(freq, *CORE_EDGES)


def bin_weights(spark, sr: int, depth: float = 0.0) -> DataFrame:
    """X3 as a table ``[bin, freq, band, core]``."""
    freq = np.arange(FFT // 2 + 1) * sr / FFT
    pdf = pd.DataFrame(
        {"bin": np.arange(len(freq)), "freq": freq, "band": band_weight(freq, depth), "core": vocal_core_weight(freq)}
    )
    return spark.createDataFrame(pdf)


def _centerness(left: np.ndarray, right: np.ndarray, depth: float) -> np.ndarray:
    """X2 per bin: 1 where both channels agree in level and phase."""
    power_l, power_r = np.abs(left) ** 2, np.abs(right) ** 2
    product = np.sqrt(power_l * power_r)
    balance = 2.0 * product / (power_l + power_r + EPS)
    coherence = np.clip(np.real(left * np.conj(right)) / (product + EPS), 0.0, 1.0)
    sharp = (balance * coherence) ** max(EXPONENT - EXPONENT_DROP * depth, EXPONENT_MIN)
    return sharp + depth * DEEP_LIFT * (1.0 - sharp)


def _filtered(left: np.ndarray, right: np.ndarray, sr: int, atten: float, depth: float):
    """X2–X4 over stacked frames; returns frames ready for overlap-add."""
    window = hann()
    spec_l, spec_r = np.fft.rfft(left * window), np.fft.rfft(right * window)
    freq = np.arange(FFT // 2 + 1) * sr / FFT
    band = band_weight(freq, depth)
    band[0] = 0.0
    strength = atten + depth * (1.0 - atten) * DEEP_ATTEN
    keep_mid = 1.0 - np.minimum(1.0, strength * band * _centerness(spec_l, spec_r, depth))
    keep_side = np.where(band > 0, 1.0 - depth * DEEP_SIDE * vocal_core_weight(freq), 1.0)
    mid, side = (spec_l + spec_r) / 2.0, (spec_l - spec_r) / 2.0
    mid, side = mid * keep_mid, side * keep_side
    return np.fft.irfft(mid + side, FFT) * window, np.fft.irfft(mid - side, FFT) * window


# ── Spans ────────────────────────────────────────────────────────────────────

def _spans(clips: DataFrame, blocks: int, before: Column, after: Column) -> DataFrame:
    """Blocks with the spans that need them: their own, and those whose halo they are in."""
    own = F.col("block_idx")
    first = F.greatest(F.lit(0), F.floor((own - after) / blocks))
    last = F.floor((own + before) / blocks)
    return clips.withColumn("span", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _placed(pdf: pd.DataFrame, side: str, first: int, count: int, block: int) -> np.ndarray:
    """Samples of ``count`` blocks from block ``first`` on; blocks that are missing are silent."""
    out = np.zeros((count, block))
    at = pdf["block_idx"].to_numpy() - first
    inside = (at >= 0) & (at < count)
    if inside.any():
        out[at[inside]] = np.stack(pdf[side].to_numpy()[inside])
    return out.reshape(-1)


def _blocks_of(left: np.ndarray, right: np.ndarray, size: int) -> tuple[list, list]:
    return (
        list(left.astype(np.float32).reshape(-1, size)),
        list(right.astype(np.float32).reshape(-1, size)),
    )


def frames(clips: DataFrame, block: int = BLOCK) -> DataFrame:
    """``[clip_id, sr, frame_idx, left, right]``, complete frames of 2048 samples.

    Each block names the (at most 4 hops of) frames it belongs to; a frame collects the
    fixed number of blocks it is made of.
    """
    per_hop, per_frame = HOP // block, FFT // block
    hop = F.floor(F.col("block_idx") / per_hop)
    starts = F.sequence(F.greatest(F.lit(0), hop - (OVERLAP - 1)).cast("long"), hop.cast("long"))
    part = F.struct("block_idx", "left", "right")
    gathered = (
        clips.withColumn("frame_idx", F.explode(starts))
        .groupBy("clip_id", "sr", "frame_idx")
        .agg(F.sort_array(F.collect_list(part)).alias("p"))
        .filter(F.size("p") == per_frame)
    )
    return gathered.select(
        "clip_id", "sr", "frame_idx", F.flatten("p.left").alias("left"), F.flatten("p.right").alias("right")
    )


def _map_frames(frame_table: DataFrame, fn, schema: str) -> DataFrame:
    """Apply a numpy kernel to the stacked frames of each sampling rate in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sr, part in pdf.groupby("sr"):
                left, right = (np.stack(part[s].to_numpy()).astype(np.float64) for s in ("left", "right"))
                yield fn(part, left, right, int(sr))

    return frame_table.mapInPandas(run, schema)


def spectral_features(frame_table: DataFrame, depth: float = 0.0) -> DataFrame:
    """``[clip_id, frame_idx, centerness]``, one array of bins per frame."""

    def kernel(part, left, right, sr):
        window = hann()
        found = _centerness(np.fft.rfft(left * window), np.fft.rfft(right * window), depth)
        return part[["clip_id", "frame_idx"]].assign(centerness=list(found))

    schema = f"clip_id {_id_type(frame_table)}, frame_idx bigint, centerness array<double>"
    return _map_frames(frame_table, kernel, schema)


def attenuate_center(frame_table: DataFrame, atten: float = 0.85, depth: float = 0.0) -> DataFrame:
    """Filtered frames, windowed for :func:`overlap_add`."""

    def kernel(part, left, right, sr):
        out_l, out_r = _filtered(left, right, sr, atten, depth)
        return part[["clip_id", "sr", "frame_idx"]].assign(left=list(out_l), right=list(out_r))

    schema = f"clip_id {_id_type(frame_table)}, sr int, frame_idx bigint, left array<double>, right array<double>"
    return _map_frames(frame_table, kernel, schema)


def overlap_add(frame_table: DataFrame) -> DataFrame:
    """``[clip_id, hop_idx, left, right]``: frames summed hop by hop.

    Hop ``h`` of the output is hop ``h − 4`` of the sum: the result comes one frame late.
    At most four frames meet in a hop.
    """
    piece = F.explode(F.sequence(F.lit(0), F.lit(OVERLAP - 1)))
    cut = frame_table.select("clip_id", "frame_idx", "left", "right", piece.alias("i"))
    start = F.col("i") * HOP + 1
    cut = cut.select(
        "clip_id",
        (F.col("frame_idx") + F.col("i") + OVERLAP).alias("hop_idx"),
        "frame_idx",
        F.slice("left", start, F.lit(HOP)).alias("left"),
        F.slice("right", start, F.lit(HOP)).alias("right"),
    )

    def total(side: str) -> Column:
        zero = F.array_repeat(F.lit(0.0).cast("double"), HOP)
        added = F.aggregate(
            F.transform("p", lambda p: p[side]), zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)
        )
        return F.transform(added, lambda v: v.cast("float")).alias(side)

    met = cut.groupBy("clip_id", "hop_idx").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "left", "right"))).alias("p")
    )
    return met.select("clip_id", "hop_idx", total("left"), total("right"))


def _spectral(left: np.ndarray, right: np.ndarray, sr: int, atten: float, depth: float) -> tuple[np.ndarray, np.ndarray]:
    """X2–X5 over a stretch of whole hops: the sum of its filtered frames."""
    total_l, total_r = np.zeros(len(left)), np.zeros(len(right))
    count = max(0, (len(left) - FFT) // HOP + 1)
    if count:
        view = np.lib.stride_tricks.sliding_window_view
        out_l, out_r = _filtered(view(left, FFT)[::HOP][:count], view(right, FFT)[::HOP][:count], sr, atten, depth)
        for i in range(OVERLAP):  # frames i, i+4, … do not overlap each other
            tiles = out_l[i::OVERLAP]
            at = slice(i * HOP, i * HOP + tiles.size)
            total_l[at] += tiles.reshape(-1)
            total_r[at] += out_r[i::OVERLAP].reshape(-1)
    return total_l, total_r


def _with_last(clips: DataFrame) -> DataFrame:
    """Blocks with the last block of their clip, from a pass over block numbers only."""
    return clips.join(clips.groupBy("clip_id").agg(F.max("block_idx").alias("_last")), "clip_id")


def _span_blocks(pdf: pd.DataFrame, block: int, span_blocks: int, halo: int, kernel) -> pd.DataFrame:
    """Blocks of one span after ``kernel(left, right)`` over the span and its halos.

    The kernel returns the samples and by how many blocks they come late. The output goes on from
    the clip's first block number 0 to its last, whether or not blocks are missing.
    """
    clip, span, last = pdf["clip_id"].iloc[0], int(pdf["span"].iloc[0]), int(pdf["_last"].iloc[0])
    low, high = span * span_blocks, min((span + 1) * span_blocks, last + 1)
    if low > last:  # the span only holds the halo of the one before
        return pd.DataFrame(columns=["clip_id", "block_idx", "left", "right"], dtype=object)
    origin = max(0, low - halo)
    count = min((span + 1) * span_blocks + halo, last + 1) - origin
    left, right, delay = kernel(*(_placed(pdf, side, origin, count, block) for side in ("left", "right")))
    size = slice((low - origin) * block, (high - origin) * block)
    blocks_l, blocks_r = _blocks_of(left[size], right[size], block)
    out = pd.DataFrame({"clip_id": clip, "block_idx": np.arange(low, high) + delay, "left": blocks_l, "right": blocks_r})
    return out[out["block_idx"] <= last]


def _lead(clips: DataFrame, block: int) -> DataFrame:
    """The silence before the first filtered frame: one block for each of the first blocks."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), block)
    first = clips.groupBy("clip_id").agg(F.max("block_idx").alias("_last"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_last"), F.lit(FFT // block - 1)))
    return first.select("clip_id", F.explode(numbers).alias("block_idx"), silence.alias("left"), silence.alias("right"))


def _of_span(clips: DataFrame, span_blocks: int, halo: Column, run, schema: str) -> DataFrame:
    return _spans(_with_last(clips), span_blocks, halo, halo).groupBy("clip_id", "span").applyInPandas(run, schema)


def remove_center(
    clips: DataFrame, atten: float = 0.85, depth: float = 0.0, block: int = BLOCK, span_hops: int = SPAN_HOPS
) -> DataFrame:
    """X1–X5 in one stage: filtered blocks from 0 to the clip's last, one frame late.

    A span of hops needs the frames that touch it, hence a frame less one hop on either
    side. Frames are views into the span, so overlapping samples are never shuffled. Blocks are
    placed by their number; missing ones are silent.
    """
    atten, depth = min(max(atten, 0.0), 1.0), min(max(depth, 0.0), 1.0)
    halo, span_blocks = (OVERLAP - 1) * HOP // block, span_hops * HOP // block

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sr = int(pdf["sr"].iloc[0])
        return _span_blocks(pdf, block, span_blocks, halo, lambda l, r: (*_spectral(l, r, sr, atten, depth), FFT // block))

    return _lead(clips, block).unionByName(_of_span(clips, span_blocks, F.lit(halo), run, _BLOCK_SCHEMA.format(id=_id_type(clips))))


# ── Basic mode ───────────────────────────────────────────────────────────────

def mid_side_blend(left: Column, right: Column, mix: float) -> tuple[Column, Column]:
    """Center cancellation of arrays without bass protection: blend with ±(L−R)/2."""

    def blend(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x * (1.0 - mix) + (x - y) * 0.5 * mix)

    return blend(left, right), blend(right, left)


def bass_coefficient(sr: int) -> float:
    """Step of the one-pole low-pass at 150 Hz."""
    dt, rc = 1.0 / sr, 1.0 / (2.0 * math.pi * BASS_CUTOFF)
    return dt / (rc + dt)


def bass_halo(sr: Column) -> Column:
    """Samples after which the low-pass has forgotten its state to 1e-17.

    ``ln 1e-17 / ln(1 − a)`` is at most ``0.042 sr + 64`` for a cut-off of 150 Hz.
    """
    return sr * 0.042 + 64


def _low_pass(x: np.ndarray, a: float, width: int = 64) -> np.ndarray:
    """``y[n] = y[n−1] + a (x[n] − y[n−1])`` from rest, in blocks of ``width`` samples."""
    decay = (1.0 - a) ** np.arange(width + 1)
    lag = np.subtract.outer(np.arange(width), np.arange(width))
    response = np.where(lag >= 0, a * decay[np.maximum(lag, 0)], 0.0)
    pad = -len(x) % width
    rows = np.pad(x, (0, pad)).reshape(-1, width) @ response.T
    carry = 0.0
    for row in rows:
        row += decay[1:] * carry
        carry = row[-1]
    return rows.reshape(-1)[: len(x)]


def bass_states(clips: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks with ``low_l`` and ``low_r``, the low-pass of either side just before the block.

    Over a block the low-pass is an affine map of its state: it keeps ``d = (1 - a)^block`` of it and
    adds what the block leaves from rest. Composed along blocks this is a sum weighted by
    powers of ``d``, taken in slices in which no power leaves the range of doubles; a slice hands
    its last state to the next one, and what is older has vanished (``e^-250`` at most). Missing
    blocks count as silence.
    """
    dt = 1.0 / F.col("sr").cast("double")
    a = dt / (F.lit(1.0 / (2.0 * math.pi * BASS_CUTOFF)) + dt)
    decay = -F.log1p(-F.col("_a")) * block  # of a block, as a logarithm
    per_slice = F.greatest(F.lit(1), F.floor(500 / F.col("_decay")))

    def left_behind(side: str) -> Column:
        return F.aggregate(side, F.lit(0.0), lambda acc, x: acc + F.col("_a") * (x.cast("double") - acc))

    base = clips.withColumn("_a", a).withColumn("_decay", decay).withColumn("_per", per_slice)
    base = base.withColumn("_slice", F.floor(F.col("block_idx") / F.col("_per")))
    base = base.withColumn("_at", F.col("block_idx") - F.col("_slice") * F.col("_per"))
    base = base.withColumns({"_e_l": left_behind("left"), "_e_r": left_behind("right")})
    weight = F.exp(F.col("_decay") * F.col("_at"))
    to_end = F.exp(F.col("_decay") * (F.col("_at") - F.col("_per") + 1))
    before = W.partitionBy("clip_id", "_slice").orderBy("block_idx").rowsBetween(W.unboundedPreceding, -1)
    local = base.withColumns({f"_s_{x}": F.sum(weight * F.col(f"_e_{x}")).over(before) for x in "lr"})
    ends = base.groupBy("clip_id", (F.col("_slice") + 1).alias("_slice")).agg(*(F.sum(to_end * F.col(f"_e_{x}")).alias(f"_c_{x}") for x in "lr"))

    def state(x: str) -> Column:
        inside = F.exp(-F.col("_decay") * (F.col("_at") - 1)) * F.coalesce(f"_s_{x}", F.lit(0.0))
        return inside + F.exp(-F.col("_decay") * F.col("_at")) * F.coalesce(f"_c_{x}", F.lit(0.0))

    both = local.join(ends, ["clip_id", "_slice"], "left")
    return both.select(*clips.columns, state("l").alias("low_l"), state("r").alias("low_r"))


def _low_pass_rows(x: np.ndarray, a: float, state: np.ndarray, width: int = 64) -> np.ndarray:
    """The low-pass along each row, from a state of its own."""
    out, carry = np.empty_like(x), state.copy()
    for at in range(0, x.shape[1], width):
        part = x[:, at : at + width]
        n = part.shape[1]
        lag = np.subtract.outer(np.arange(n), np.arange(n))
        decay = (1.0 - a) ** np.arange(n + 1)
        response = np.where(lag >= 0, a * decay[np.maximum(lag, 0)], 0.0)
        out[:, at : at + n] = part @ response.T + carry[:, None] * decay[1:]
        carry = out[:, at + n - 1]
    return out


def _cancelled(left: np.ndarray, right: np.ndarray, low_l: np.ndarray, low_r: np.ndarray, mix: float):
    side = ((left - low_l) - (right - low_r)) / 2.0
    return left * (1.0 - mix) + (low_l + side) * mix, right * (1.0 - mix) + (low_r - side) * mix


def center_cancel(clips: DataFrame, mix: float = 0.85, block: int = BLOCK) -> DataFrame:
    """Cancel the center above 150 Hz; the low band stays. ``mix`` 0 changes nothing.

    The low-pass is a linear recurrence over the whole clip: :func:`bass_states` finds the state
    before every block, and with it each block is filtered where it lies.
    """
    if mix == 0:
        return clips.select("clip_id", "block_idx", "left", "right")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sr, part in pdf.groupby("sr"):
                a = bass_coefficient(int(sr))
                left, right = (np.stack(part[s].to_numpy()).astype(np.float64) for s in ("left", "right"))
                low_l, low_r = (_low_pass_rows(x, a, part[c].to_numpy()) for x, c in ((left, "low_l"), (right, "low_r")))
                out = (x.astype(np.float32) for x in _cancelled(left, right, low_l, low_r, mix))
                yield part[["clip_id", "block_idx"]].assign(**{n: list(x) for n, x in zip(("left", "right"), out)})

    ready = bass_states(clips, block).select("clip_id", "sr", "block_idx", "left", "right", "low_l", "low_r")
    return ready.mapInPandas(run, _BLOCK_SCHEMA.format(id=_id_type(clips)))


# ── Modes and quality ────────────────────────────────────────────────────────

MODES = ("basic", "stft", "stft_deep", "passthrough_muted")


def stereo(clips: DataFrame) -> DataFrame:
    """Mono clips (null right channel) use the left channel twice."""
    return clips.withColumn("right", F.coalesce("right", "left"))


def mode_dispatch(clips: DataFrame, amount: float = 0.85, block: int = BLOCK, span_hops: int = SPAN_HOPS) -> DataFrame:
    """Each clip through the filter its ``mode`` names; unknown modes are basic.

    One grouped stage for all modes: the samples are read and shuffled once, and a span takes along
    the larger of the halos, that of the low-pass (which forgets what came before it).
    """
    depths = {"stft": 0.0, "stft_deep": 1.0}
    mode = F.coalesce("mode", F.lit("basic"))
    named = F.when(mode.isin(*MODES), mode).otherwise(F.lit("basic"))
    base = stereo(clips).withColumn("mode", named)
    span_blocks = span_hops * HOP // block
    forgets = F.ceil(bass_halo(F.col("sr")) / block)
    halo = F.greatest(forgets, F.lit((OVERLAP - 1) * HOP // block))
    whole_hops = F.ceil(halo * block / HOP) * (HOP // block)  # frames begin at whole hops

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sr, name, reach = int(pdf["sr"].iloc[0]), pdf["mode"].iloc[0], int(pdf["_halo"].iloc[0])

        def kernel(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            if name in depths:
                return *_spectral(left, right, sr, amount, depths[name]), FFT // block
            if name == "passthrough_muted":
                return np.zeros_like(left), np.zeros_like(right), 0
            a = bass_coefficient(sr)
            return *_cancelled(left, right, _low_pass(left, a), _low_pass(right, a), amount), 0

        return _span_blocks(pdf, block, span_blocks, reach, kernel)

    ready = base.withColumn("_halo", whole_hops.cast("long"))
    lead = _lead(base.filter(F.col("mode").isin(*depths)), block)
    return lead.unionByName(_of_span(ready, span_blocks, F.col("_halo"), run, _BLOCK_SCHEMA.format(id=_id_type(clips))))


def _square_sum(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def signal_quality(
    source: DataFrame, result: DataFrame, first_block: int, last_block: int
) -> DataFrame:
    """RMS of result over source on the left channel, and whether all is finite.

    The range of blocks is the steady region; finiteness looks at the whole result.
    """
    steady = F.col("block_idx").between(first_block, last_block)

    def rms(df: DataFrame, name: str) -> DataFrame:
        return df.filter(steady).groupBy("clip_id").agg(
            F.sqrt(F.sum(_square_sum("left")) / F.sum(F.size("left"))).alias(name)
        )

    def bad(c: str) -> Column:
        return F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))

    finite = result.groupBy("clip_id").agg((~F.max(bad("left") | bad("right"))).alias("finite"))
    both = rms(source, "rms_in").join(rms(result, "rms_out"), "clip_id").join(finite, "clip_id")
    return both.withColumn("ratio", F.when(F.col("rms_in") > 0, F.col("rms_out") / F.col("rms_in")))
