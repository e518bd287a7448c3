"""Trace kernels on Arrow batches: analytic envelope, spline resampling, mode decomposition, component statistics.

Traces of one length are handled as one matrix; other lengths in a batch make further matrices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("mean", "std", "rms", "energy", "abs_mean", "peak_abs", "zero_crossing_rate", "spectral_centroid")


def by_length(column: pa.Array):
    """(rows, matrix) for the traces of each length; null traces are in none."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), int(n))


def lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """n lists, of which those in the parts' rows hold the parts' rows; the others are null."""
    size, known = np.zeros(n, np.int64), np.zeros(n, bool)
    for rows, m in parts:
        size[rows], known[rows] = m.shape[1], True
    at = np.concatenate(([0], np.cumsum(size)))
    values = np.zeros(at[-1])
    for rows, m in parts:
        values[at[rows][:, None] + np.arange(m.shape[1])] = m
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values), mask=pa.array(~known))


def ragged(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """n lists of the places that are set in the rows of the parts' masks; lists of no part are null."""
    owner, place, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, bool)
    for rows, mask in parts:
        known[rows] = True
        r, c = np.nonzero(mask)
        owner.append(rows[r])
        place.append(c)
    owner, place = np.concatenate(owner), np.concatenate(place)
    at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    values = place[np.argsort(owner, kind="stable")]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(~known))


def envelope_of(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of each row."""
    n = x.shape[1]
    if not n:
        return x
    spectrum = np.fft.fft(x, axis=1)
    gain = np.zeros(n)
    gain[0], gain[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * gain, axis=1))


def kernel(f: Callable, kind: str, *args: Column) -> Column:
    """f as an Arrow function of whole columns. It is marked so that the optimizer runs it once and never moves it into a lambda."""
    return F.arrow_udf(f, kind).asNondeterministic()(*args)


def envelope(signal: Column) -> Column:
    return kernel(lambda c: lists(len(c), [(r, envelope_of(m)) for r, m in by_length(c)]), "array<double>", signal)


@lru_cache(maxsize=64)
def spline_weights(source: int, target: int) -> np.ndarray:
    """Matrix that takes a trace to a cubic spline through it at `target` places from end to end (third derivative continuous at the outer inner knots)."""
    if source < 4 or target < 1:
        raise ValueError("a cubic spline needs at least four points and a positive target length")
    if source == target:
        return np.eye(source)
    a, b = np.zeros((source, source)), np.zeros((source, source))
    k = np.arange(1, source - 1)
    a[k, k - 1], a[k, k], a[k, k + 1] = 1, 4, 1
    b[k, k - 1], b[k, k], b[k, k + 1] = 6, -12, 6
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    curve = np.linalg.solve(a, b)
    at = np.linspace(0, source - 1, target)
    i = np.minimum(at.astype(int), source - 2)
    v = (at - i)[:, None]
    u = 1 - v
    eye = np.eye(source)
    return u * eye[i] + v * eye[i + 1] + ((u**3 - u) * curve[i] + (v**3 - v) * curve[i + 1]) / 6


def resample_cubic(signal: Column, target: int) -> Column:
    return kernel(lambda c: lists(len(c), [(r, m @ spline_weights(m.shape[1], target).T) for r, m in by_length(c)]), "array<double>", signal)


def resample_linear(signal: Column, target: int) -> Column:
    """End-aligned linear interpolation, in column functions."""
    last = F.size(signal) - 1
    at = lambda k: k * last / F.lit(float(max(target - 1, 1)))
    i = lambda k: F.least(F.floor(at(k)).cast("int"), F.greatest(last - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: F.get(signal, i(k)) + (at(k) - i(k)) * (F.get(signal, F.least(i(k) + 1, last)) - F.get(signal, i(k))))


def extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of inner maxima and minima of each row; of a plateau its first point."""
    up, down = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    if x.shape[1] > 2:
        left, mid, right = x[:, :-2], x[:, 1:-1], x[:, 2:]
        up[:, 1:-1] = (mid > left) & (mid >= right)
        down[:, 1:-1] = (mid < left) & (mid <= right)
    return up, down


def through(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Straight lines through the knots and both ends of each row; the mean of a row without knots."""
    n = x.shape[1]
    any_ = knots.any(1)
    k = knots.copy()
    k[:, [0, -1]] = True
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(k, at, 0), axis=1)
    after = np.minimum.accumulate(np.where(k, at, n - 1)[:, ::-1], axis=1)[:, ::-1]
    y0, y1 = np.take_along_axis(x, before, 1), np.take_along_axis(x, after, 1)
    y = y0 + (y1 - y0) * (at - before) / np.maximum(after - before, 1)
    y[~any_] = x[~any_].mean(1, keepdims=True)
    return y


def crossings(x: np.ndarray) -> np.ndarray:
    return ((x[:, :-1] * x[:, 1:]) < 0).sum(1)


def sift(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sifting step of each row: the candidate, its relative energy, its extrema and its zero crossings."""
    up, down = extrema(h)
    mean = (through(h, up) + through(h, down)) / 2
    c = h - mean
    up, down = extrema(c)
    return c, (c * c).sum(1) / ((h * h).sum(1) + 1e-12), up.sum(1) + down.sum(1), crossings(c)


def decompose(x: np.ndarray, modes: int = 5, sifts: int = 30, limit: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Modes and residue of each row as (rows, modes + 1, points), absent modes zero, and how many modes each row has.

    All rows are sifted together; a row that is done leaves the active set.
    """
    m, n = x.shape
    out, count, rest = np.zeros((m, modes + 1, n)), np.zeros(m, np.int64), x.copy()
    oscillates = lambda r: sum(e.sum(1) for e in extrema(r)) >= 2
    live = np.flatnonzero(oscillates(rest)) if n >= 4 else np.zeros(0, int)
    for k in range(modes):
        if not len(live):
            break
        h = rest[live]
        open_ = np.arange(len(live))
        for _ in range(sifts):
            open_ = open_[oscillates(h[open_])]
            if not len(open_):
                break
            c, energy, ext, zero = sift(h[open_])
            h[open_] = c
            open_ = open_[~((energy < limit) & (np.abs(zero - ext) <= 1))]
        out[live, k] = h
        count[live] += 1
        rest[live] -= h
        live = live[oscillates(rest[live])]
    out[:, modes] = rest
    return out, count


def emd(signal: Column, modes: int = 5, sifts: int = 30, limit: float = 0.2) -> Column:
    """Struct of n_modes and components (modes first, then the residue)."""

    def run(c: pa.Array) -> pa.Array:
        parts, n_modes, slots = [], np.zeros(len(c), np.int64), modes + 1
        for rows, m in by_length(c):
            comp, n_modes[rows] = decompose(m, modes, sifts, limit)
            parts.append(((rows[:, None] * slots + np.arange(slots)).ravel(), comp.reshape(-1, m.shape[1])))
        each = lists(len(c) * slots, parts)
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * slots), each, mask=c.is_null())
        return pa.StructArray.from_arrays([pa.array(n_modes), whole], names=["n_modes", "components"])

    return kernel(run, "n_modes long, components array<array<double>>", signal)


def statistics(x: np.ndarray, spacing: np.ndarray) -> np.ndarray:
    """STATS of each row; the centroid in cycles per unit of spacing."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    freq = np.arange(power.shape[1]) / x.shape[1]
    energy = (x * x).mean(1)
    cols = [x.mean(1), x.std(1), np.sqrt(energy), energy, np.abs(x).mean(1), np.abs(x).max(1), crossings(x) / max(1, x.shape[1] - 1), (power @ freq) / (power.sum(1) + 1e-12) / spacing]
    return np.stack(cols, 1)


def component_stats(signal: Column, spacing: Column | float = 1.0) -> Column:
    """Struct of STATS of a trace."""

    def run(c: pa.Array, s: pa.Array) -> pa.Array:
        out, step = np.zeros((len(c), len(STATS))), s.to_numpy(zero_copy_only=False)
        for rows, m in by_length(c):
            if m.shape[1]:
                out[rows] = statistics(m, step[rows])
        return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(STATS))], names=list(STATS))

    spacing = F.lit(float(spacing)) if isinstance(spacing, (int, float)) else spacing
    return kernel(run, ", ".join(f"{s} double" for s in STATS), signal, spacing)


def similarity_of(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """For each pair of rows: largest absolute correlation over lags, times the ratio of the smaller rms to the larger."""
    ra, rb = np.sqrt((a * a).mean(1)), np.sqrt((b * b).mean(1))
    large = np.maximum(ra, rb)
    ratio = np.divide(np.minimum(ra, rb), large, out=np.zeros_like(large), where=large > 0)
    best, n = np.zeros(len(a)), a.shape[1]
    for lag in range(-min(lags, n - 1), min(lags, n - 1) + 1):
        x, y = a[:, max(lag, 0) : n + min(lag, 0)], b[:, max(-lag, 0) : n + min(-lag, 0)]
        x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        best = np.maximum(best, np.abs(np.divide((x * y).sum(1), norm, out=np.zeros_like(norm), where=norm > 0)))
    return best * ratio


def lagged_similarity(left: Column, right: Column, lags: int = 5) -> Column:
    """Similarity of two traces of one length."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for rows, m in by_length(a):
            other = b.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(m.shape)
            out[rows] = similarity_of(m, other, lags) if m.shape[1] else 0
        return pa.array(out)

    return kernel(run, "double", left, right)


def local_extrema(signal: Column) -> Column:
    """Struct of the places of inner maxima and minima."""

    def run(c: pa.Array) -> pa.Array:
        found = [(rows, *extrema(m)) for rows, m in by_length(c)]
        return pa.StructArray.from_arrays([ragged(len(c), [(f[0], f[k]) for f in found]) for k in (1, 2)], names=["maxima", "minima"])

    return kernel(run, "maxima array<int>, minima array<int>", signal)


def linear_envelope(signal: Column, upper: bool = True) -> Column:
    """Lines through the maxima (or minima) and both ends."""
    return kernel(lambda c: lists(len(c), [(r, through(m, extrema(m)[0 if upper else 1])) for r, m in by_length(c)]), "array<double>", signal)


def zero_crossings(signal: Column) -> Column:
    """Adjacent points of opposite sign, in column functions."""
    pairs = F.zip_with(F.slice(signal, 1, F.size(signal) - 1), F.slice(signal, 2, F.size(signal) - 1), lambda a, b: (a * b < 0).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def sift_once(signal: Column) -> Column:
    """Struct of one sifting step: candidate, its relative energy, extrema and zero crossings."""

    def run(c: pa.Array) -> pa.Array:
        cand, sd, ext, zero = [], np.zeros(len(c)), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for rows, m in by_length(c):
            h, sd[rows], ext[rows], zero[rows] = sift(m)
            cand.append((rows, h))
        return pa.StructArray.from_arrays([lists(len(c), cand), pa.array(sd), pa.array(ext), pa.array(zero)], names=["candidate", "sd", "n_extrema", "n_crossings"])

    return kernel(run, "candidate array<double>, sd double, n_extrema long, n_crossings long", signal)
