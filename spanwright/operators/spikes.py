"""Implausible values in measurements of a source: impossible, spikes and drops, stuck.

Every source (endpoint) is cut into days with margins of two hours, so that a source holding a
third of all rows is spread over many tasks. A first aggregation learns what each source reports
under each load (quantiles of power, means of temperature and memory traffic by load level). Then
each field of each source-day is decoded by a hidden Markov model with the states normal, spike,
stuck and out of range; hard bounds decide the last, forward-backward probabilities the others.

Defined results: null and NaN values are never flagged and do not break a run of repeated values;
a repeated delivery of a sample counts once; a sample without a usable time has no neighbours and
is judged by the hard bounds only; a null endpoint is a source of its own without a baseline; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.telemetry import sample_micros
from spanwright.runtime import sorted_groups

FIELDS = ("gpu_util_pct", "mem_used_mib", "power_w")
NORMAL, SPIKE, STUCK, RANGE = range(4)
BINS = 21  # load levels 0, 5, ..., 100 %
OUT_SCHEMA = "endpoint string, sample_id bigint, field string, kind string, probability double"


@dataclass(frozen=True)
class SpikeModel:
    """Parameters of the model; all have a meaning of their own and none depends on the size of the data."""

    chunk_hours: int = 24
    margin_hours: int = 2
    silence_sec: float = 120.0  # a longer silence may end a serve
    silence_intervals: float = 8.0  # ... if it also is that many sampling intervals long
    min_stuck: int = 12  # members of a run of one value to call it stuck
    max_spike: int = 5  # members of a brief excursion
    enter_spike: float = 1e-4
    enter_stuck: float = 1e-4
    stay_spike: float = 0.5
    stay_stuck: float = 0.97
    power_over_limit: float = 1.3  # of the power limit: beyond it no GPU draws
    leave_range: float = 0.5  # a value out of range is followed by one within as often as not
    enter_range: float = 1e-4
    load_scale_pct: float = 6.0
    load_slack_pct: float = 8.0  # how far the load may be from what power or heat tell of it
    power_slack_pct: float = 6.0  # the load's own noise when power is judged by it
    heat_slack_pct: float = 12.0  # heat follows the load slowly
    trusted_load_pct: float = 20.0  # a load that agrees with power this well is the load
    idle_below_pct: float = 8.0
    saturated_above_pct: float = 96.0
    below_idle: float = 0.8  # share of idle power that a powered GPU still draws
    repeats_of_varying: float = 0.34  # a field whose normal values repeat less often than this varies
    runs_to_judge: int = 8  # values from which that is told
    held_share: float = 0.6  # a level held for this share of a day is normal, however few runs that takes
    far: float = 4.0  # scales from which a repeated value is an excursion rather than the usual level
    mem_scale_share: float = 0.004
    power_scale_share: float = 0.012


def _learned(samples: DataFrame, chunk: Column) -> DataFrame:
    """One row per source: its normal behaviour by load level (21 at most), and the chunks in which it has samples.

    Both come from one pass over the samples.
    """
    load, power = F.col("gpu_util_pct"), F.col("power_w")
    known = F.coalesce(load.between(0, 100) & ~F.isnan(load) & (power > 0) & ~F.isnan(power), F.lit(False))
    seen = lambda c: F.when(known, F.nanvl(c, F.lit(None).cast("double")))
    by_level = samples.groupBy("endpoint", F.when(known, F.round(load / 5).cast("int")).alias("level")).agg(
        F.percentile_approx(F.when(known, power), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 200).alias("power"),
        F.avg(seen("temperature_c")).alias("heat"),
        F.avg(seen("mem_util_pct")).alias("traffic"),
        F.count("*").alias("n"),
        F.collect_set(chunk).alias("chunks"),
    )
    levels = F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "power", "heat", "traffic", "n")))
    return by_level.groupBy("endpoint").agg(levels.alias("levels"), F.array_distinct(F.flatten(F.collect_list("chunks"))).alias("chunks"))


def implausible_values(gpu_log: DataFrame, endpoints: DataFrame | None = None, model: SpikeModel = SpikeModel()) -> DataFrame:
    """One row (endpoint, sample_id, field, kind, probability) per implausible value.

    ``kind`` is ``range``, ``spike`` or ``stuck``. ``endpoints`` gives ``mem_total_mib`` and
    ``power_limit_w`` by endpoint for the hard bounds; without it only the row's own
    ``mem_total_mib`` and the learned behaviour bound the values.
    """
    measures = [F.col(c).cast("double").alias(c) for c in (*FIELDS, "mem_util_pct", "temperature_c", "mem_total_mib")]
    samples = gpu_log.where(F.col("error").isNull() & F.col("sample_id").isNotNull()).select(
        "endpoint", F.col("sample_id").cast("bigint").alias("sample_id"), sample_micros(F.col("logged_at"), F.col("sampled_at")).alias("us"), *measures
    )
    width, margin = model.chunk_hours * 3_600_000_000, model.margin_hours * 3_600_000_000
    day = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    low, high = F.floor((F.col("us") - margin) / F.lit(width)).cast("bigint"), F.floor((F.col("us") + margin) / F.lit(width)).cast("bigint")
    # a sample without a time forms a chunk apart, spread by its id so that no such chunk grows with the source
    apart = F.pmod(F.xxhash64("sample_id"), F.lit(256)) - F.lit(1 << 40)
    copies = samples.withColumn("chunk", F.explode(F.when(F.col("us").isNull(), F.array(apart)).otherwise(F.sequence(low, high))))
    rows = copies.withColumn("own", F.col("us").isNull() | (F.col("chunk") == day))

    # heads carry each source's baseline into all of its chunks
    learned = _learned(samples, F.coalesce(day, apart))
    if endpoints is not None:
        bounds = endpoints.where(F.col("endpoint").isNotNull()).groupBy("endpoint").agg(F.max(F.col("power_limit_w").cast("double")).alias("limit_w"), F.max(F.col("mem_total_mib").cast("double")).alias("total_mib"))
        learned = learned.join(bounds, "endpoint", "left")
    else:
        learned = learned.withColumns({"limit_w": F.lit(None).cast("double"), "total_mib": F.lit(None).cast("double")})
    heads = learned.select("endpoint", F.explode("chunks").alias("chunk"), "limit_w", "total_mib", "levels", F.lit(0).alias("head"))
    everything = heads.unionByName(rows.withColumn("head", F.lit(1)), allowMissingColumns=True)
    keyed = everything.repartition("endpoint", "chunk").sortWithinPartitions("endpoint", "chunk", "head", "us", "sample_id")
    options = asdict(model)
    return keyed.mapInArrow(lambda batches: _decode(batches, SpikeModel(**options)), OUT_SCHEMA)


def _decode(batches: Iterator[pa.RecordBatch], model: SpikeModel) -> Iterator[pa.RecordBatch]:
    yield from sorted_groups(batches, ["endpoint", "chunk"], lambda table: _flag(table, model))


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(float, copy=False)


def _group_starts(table: pa.Table) -> np.ndarray:
    chunk = table.column("chunk").to_numpy(zero_copy_only=False)
    codes = table.column("endpoint").combine_chunks().dictionary_encode()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    endpoint = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (endpoint[1:] != endpoint[:-1])])


class _Curve:
    """What one source reports by load: power quartiles on a grid of whole per cent, and load by heat and traffic."""

    def __init__(self, levels: list[dict] | None, model: SpikeModel, limit: float):
        levels = sorted((x for x in levels or [] if x["n"] >= 3 and x["level"] is not None), key=lambda x: x["level"])
        self.known = len(levels) >= 2
        if not self.known:
            return
        at = np.array([x["level"] * 5.0 for x in levels])
        q = np.array([x["power"] for x in levels])
        grid = np.arange(101.0)
        mid = np.maximum.accumulate(np.interp(grid, at, q[:, 1]))
        self.mid = mid + np.arange(101) * 1e-6
        self.full = float(limit) if limit > 0 else float(mid[-1])
        spread = np.interp(grid, at, (q[:, 2] - q[:, 0]) / 1.35)
        # below idle there is nothing a powered GPU reports, whatever its load
        self.idle = float(q[0, 1]) if levels[0]["level"] == 0 and levels[0]["n"] >= 20 else np.nan
        self.scale = np.clip(np.maximum(spread, model.power_scale_share * self.full), None, 0.05 * self.full)
        self.inverse: list[tuple[np.ndarray, np.ndarray]] = []
        for name in ("heat", "traffic"):
            pairs = [(x["level"] * 5.0, x[name]) for x in levels if x[name] is not None and not np.isnan(x[name])]
            if len(pairs) >= 2:
                y = np.maximum.accumulate(np.array([b for _, b in pairs])) + np.arange(len(pairs)) * 1e-6
                self.inverse.append((y, np.array([a for a, _ in pairs])))
            else:
                self.inverse.append((np.array([0.0]), np.array([np.nan])))


def _flag(table: pa.Table, model: SpikeModel) -> pa.Table | None:
    starts = _group_starts(table)
    n = table.num_rows
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    head = table.column("head").to_numpy(zero_copy_only=False) == 0
    us = table.column("us").fill_null(0).to_numpy(zero_copy_only=False)
    timed = ~table.column("us").is_null().to_numpy(zero_copy_only=False)
    sample = table.column("sample_id").fill_null(0).to_numpy(zero_copy_only=False)
    own = table.column("own").fill_null(False).to_numpy(zero_copy_only=False)
    # the rows are sorted by time and id, so a repeated delivery follows its twin
    repeat = np.r_[False, (sample[1:] == sample[:-1]) & (us[1:] == us[:-1]) & (group[1:] == group[:-1])] & ~head
    x = {f: _floats(table, f) for f in (*FIELDS, "mem_util_pct", "temperature_c", "mem_total_mib")}
    levels = table.column("levels")
    limits, totals = _floats(table, "limit_w"), _floats(table, "total_mib")
    keep = np.flatnonzero(~head & ~repeat)
    if not keep.size:
        return None
    g, t, own, sample, timed = group[keep], us[keep] / 1e6, own[keep], sample[keep], timed[keep]
    v = {f: a[keep] for f, a in x.items()}
    m = keep.size
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    last = np.r_[first[1:], m]

    limit, total = np.full(m, np.nan), v["mem_total_mib"].copy()
    deviance = {f: np.full(m, np.nan) for f in FIELDS}  # in robust scales of what is normal under the load
    busy = np.full(m, -1)
    for a, b in zip(first, last):
        s = slice(a, b)
        h = starts[g[a]]
        has_head = head[h]
        lim, tot = (limits[h], totals[h]) if has_head else (np.nan, np.nan)
        limit[s] = lim
        if tot > 0:
            total[s] = tot
        if not timed[a]:
            continue
        curve = _Curve(levels[h].as_py() if has_head else None, model, lim)
        if not curve.known:
            continue
        u, p = v["gpu_util_pct"][s], v["power_w"][s]
        u_ok = np.where((u >= 0) & (u <= 100), u, np.nan)
        by_power = np.where(p > 0, np.interp(p, curve.mid, np.arange(101.0)), np.nan)
        others = [np.where(np.isnan(z), np.nan, np.interp(z, *inv)) for z, inv in zip((v["temperature_c"][s], v["mem_util_pct"][s]), curve.inverse)]
        both = np.stack(others)
        seen = ~np.isnan(both)
        by_heat = np.where(seen.any(0), np.where(seen, both, 0).sum(0) / np.maximum(seen.sum(0), 1), np.nan)
        near = np.fmin(np.abs(u - by_power), np.abs(u - by_heat))
        deviance["gpu_util_pct"][s] = np.maximum(near - model.load_slack_pct, 0) / model.load_scale_pct

        def power_gap(load: np.ndarray, slack: float) -> np.ndarray:
            at = np.nan_to_num(load, nan=0.0)
            low, high = np.interp(at - slack, np.arange(101.0), curve.mid), np.interp(at + slack, np.arange(101.0), curve.mid)
            scale = np.interp(at, np.arange(101.0), curve.scale)
            return np.where(np.isnan(load), np.nan, np.maximum(np.maximum(low - p, p - high), 0) / scale)

        below_idle = np.nan_to_num(np.maximum(model.below_idle * curve.idle - p, 0) / (0.05 * curve.idle))
        deviance["power_w"][s] = np.fmax(np.fmin(power_gap(u_ok, model.power_slack_pct), power_gap(by_heat, model.heat_slack_pct)), below_idle)
        load = np.where(np.isnan(u_ok), by_heat, np.where(np.abs(u_ok - by_power) < model.trusted_load_pct, u_ok, np.where(np.abs(u_ok - by_heat) < np.abs(by_power - by_heat), u_ok, by_power)))
        busy[s] = np.where(np.isnan(load), -1, np.where(load < model.idle_below_pct, 0, np.where(load > model.saturated_above_pct, 2, 1)))
    deviance["mem_used_mib"] = _memory_deviance(v["mem_used_mib"], total, g, t, timed, first, last, model)

    out: list[tuple[np.ndarray, str, str | np.ndarray, np.ndarray]] = []
    for f in FIELDS:
        y = v[f]
        top = {"gpu_util_pct": np.full(m, 100.0), "mem_used_mib": total, "power_w": model.power_over_limit * limit}[f]
        outside = (y < 0) | (y > np.where(np.isnan(top), np.inf, top)) | np.isinf(y)
        if f == "power_w":
            outside |= y == 0  # a powered GPU draws something
        here = np.flatnonzero(~np.isnan(y) & timed)
        alone = np.flatnonzero(~np.isnan(y) & ~timed & outside & own)
        if alone.size:
            out.append((alone, f, "range", np.ones(alone.size)))
        if not here.size:
            continue
        span = np.where(np.isnan(top[here]), np.nanmax(np.abs(y[here])) + 1, top[here])
        scale = {"gpu_util_pct": model.load_scale_pct, "mem_used_mib": 1.0, "power_w": 1.0}[f]
        kind, prob = _posterior(y[here], deviance[f][here], outside[here], g[here], busy[here], span / scale, f, model)
        hit = np.flatnonzero((kind != NORMAL) & own[here])
        names = np.array(["normal", "spike", "stuck", "range"])
        for k in (SPIKE, STUCK, RANGE):
            at = hit[kind[hit] == k]
            if at.size:
                out.append((here[at], f, str(names[k]), prob[at]))
    if not out:
        return None
    endpoint = table.column("endpoint").take(pa.array(keep))
    parts = [
        pa.table({"endpoint": endpoint.take(pa.array(i)), "sample_id": pa.array(sample[i], pa.int64()), "field": pa.array([f] * len(i), pa.string()), "kind": pa.array([k] * len(i), pa.string()), "probability": pa.array(p, pa.float64())})
        for i, f, k, p in out
    ]
    return pa.concat_tables(parts)


def _median_rows(a: np.ndarray) -> np.ndarray:
    """Median of each row without NaN; NaN for a row of nothing else."""
    a = np.sort(a, axis=1)  # NaN last
    k = (~np.isnan(a)).sum(1)
    r = np.arange(len(a))
    return (a[r, np.maximum(k - 1, 0) // 2] + a[r, k // 2]) / 2


def _memory_deviance(y: np.ndarray, total: np.ndarray, g: np.ndarray, t: np.ndarray, timed: np.ndarray, first: np.ndarray, last: np.ndarray, model: SpikeModel) -> np.ndarray:
    """Distance of a level from those before and after it within a serve, in robust scales.

    A value between both levels is normal, which covers every climb; so is a strictly climbing start of a serve.
    """
    deviance = np.full(y.size, np.nan)
    here = np.flatnonzero(~np.isnan(y) & timed)
    if not here.size:
        return deviance
    v, gg, tt = y[here], g[here], t[here]
    gap = np.diff(tt, prepend=tt[0])
    new_group = np.r_[True, gg[1:] != gg[:-1]]
    begin = np.flatnonzero(new_group)
    normal_gap = np.zeros(v.size)
    for a, b in zip(begin, np.r_[begin[1:], v.size]):
        normal_gap[a:b] = np.median(gap[a + 1 : b]) if b - a > 2 else 60.0
    serve = np.cumsum(new_group | (gap > np.maximum(model.silence_sec, model.silence_intervals * normal_gap)))
    k = 6
    pad_v, pad_s = np.pad(v, k, constant_values=np.nan), np.pad(serve.astype(float), k, constant_values=np.nan)
    n = v.size

    def shifted(offsets: range) -> np.ndarray:
        return np.stack([np.where(pad_s[k + o : k + o + n] == serve, pad_v[k + o : k + o + n], np.nan) for o in offsets], axis=1)

    back, ahead = shifted(range(-k, 0)), shifted(range(1, k + 1))
    before, after = _median_rows(back), _median_rows(ahead)
    low, high = np.fmin(before, after), np.fmax(before, after)
    off = np.where(np.isnan(low), 0.0, np.where(v < low, low - v, np.where(v > high, v - high, 0.0)))
    to_next = np.diff(np.concatenate([v[:, None], ahead[:, :3]], axis=1), axis=1)
    climbing = np.where(np.isnan(to_next), True, to_next > 0).all(1) & (~np.isnan(to_next)).any(1)
    from_start = np.arange(n) - np.maximum.accumulate(np.where(np.r_[True, serve[1:] != serve[:-1]], np.arange(n), 0))
    rise = np.r_[True, v[1:] > v[:-1]] | (from_start == 0)
    rising = np.cumsum(~rise)
    start_at = np.arange(n) - from_start
    # a serve that starts by loading its model climbs in strict steps
    loading = (from_start < 12) & (rising == rising[start_at]) & climbing & (v > 0)
    off = np.where(loading, 0.0, off)
    # a serve that ends within its climb has nothing after it to compare with: its own range holds
    ends_early = np.isnan(after) & (from_start > 0) & (from_start < 12)
    least, most = np.nanmin(np.where(ends_early[:, None], back, 0.0), axis=1), np.nanmax(np.where(ends_early[:, None], back, 0.0), axis=1)
    within = np.where(v < least, least - v, np.where(v > most, v - most, 0.0))
    off = np.where(ends_early, np.where(rising == rising[start_at], 0.0, within), off)
    centre = _median_rows(np.concatenate([back, ahead], axis=1))
    residual = np.abs(v - centre)
    scale = np.zeros(n)
    for a, b in zip(begin, np.r_[begin[1:], n]):
        r = residual[a:b]
        r = r[~np.isnan(r)]
        share = model.mem_scale_share * np.nanmedian(total[here[a:b]]) if not np.isnan(total[here[a:b]]).all() else model.mem_scale_share * np.median(np.abs(v[a:b]))
        scale[a:b] = max(1.4826 * float(np.median(r)) if r.size else 0.0, share, 1.0)
    deviance[here] = off / scale
    return deviance


def _run_lengths(y: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start index of each run of one repeated value within a group, and the run number of each value."""
    start = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (g[1:] != g[:-1])])
    run = np.zeros(y.size, np.int64)
    run[start[1:]] = 1
    return start, np.cumsum(run)


def _posterior(y: np.ndarray, deviance: np.ndarray, outside: np.ndarray, g: np.ndarray, busy: np.ndarray, span: np.ndarray, field: str, model: SpikeModel) -> tuple[np.ndarray, np.ndarray]:
    """State and its probability for each value of one field, groups side by side in ``y``."""
    n = y.size
    start, run = _run_lengths(y, g)
    length = np.diff(np.r_[start, n])
    again = np.r_[False, run[1:] == run[:-1]]
    ahead = np.r_[run[1:] == run[:-1], False]

    # chance that a normal value repeats its predecessor, by source, day and load; long runs are trimmed
    # so that a stuck sensor does not pass for a constant field
    # memory is held or moves whatever the load; 0 % and 100 % repeat while idle or saturated, other values hardly do
    kind_of_load = busy + 1
    if field == "mem_used_mib":
        kind_of_load = np.zeros(n, np.int64)
    elif field == "gpu_util_pct":
        kind_of_load = np.where((y == 0) & (busy <= 0), 1, np.where((y == 100) & (busy != 0) & (busy != 1), 3, 2))
    cell = g * 4 + kind_of_load
    run_cell = cell[start]
    size = int(cell.max()) + 1
    repeats = np.bincount(run_cell, np.minimum(length - 1, 3), size)
    counted = np.bincount(run_cell, np.minimum(length, 4), size)
    chance = (repeats + 0.02) / (counted + 1)
    rho = np.clip(chance, 0.01, 1)[cell]
    varies = (rho < model.repeats_of_varying) & (counted[cell] >= model.runs_to_judge)
    if field == "gpu_util_pct":
        varies &= kind_of_load == 2  # idle at 0 % and saturation at 100 % are normal where the other fields agree
    if field == "mem_used_mib":
        # a level that is held for most of the day is held, however few runs that takes
        held = np.bincount(run_cell, np.where(length >= model.min_stuck, length, 0), size) / np.maximum(np.bincount(run_cell, length, size), 1)
        varies &= held[cell] < model.held_share
    rho = np.where(varies, rho, 0.5)

    d = np.nan_to_num(deviance, nan=0.0)
    wide = 1.0 / np.maximum(span, 1.0) if field == "gpu_util_pct" else np.full(n, 1e-4)
    normal = np.exp(-0.5 * np.minimum(d, 37.0) ** 2) * 0.4 + 1e-300
    repeat_normal = np.where(again, rho, 1 - rho)
    e = np.empty((n, 4))
    e[:, NORMAL] = normal * repeat_normal
    e[:, SPIKE] = wide * np.where(again, rho, 1 - rho) * np.where(d > 0, 1.0, 1e-3)
    e[:, STUCK] = np.where(varies & (again | ahead), np.where(d > model.far, wide, 0.4 * np.exp(-0.5 * np.minimum(d, model.far) ** 2) + wide), 1e-12) * np.where(again | ahead, 1.0, 1e-6)
    e[:, RANGE] = 1e-12
    e[outside] = np.array([1e-12, 1e-12, 1e-12, 1.0])
    e /= e.max(1, keepdims=True)
    e = np.maximum(e, 1e-30)

    out = model.enter_range
    s, k = model.enter_spike, model.enter_stuck
    move = np.array(
        [
            [1 - s - k - out, s, k, out],
            [1 - model.stay_spike - k - out, model.stay_spike, k, out],
            [1 - model.stay_stuck - s - out, s, model.stay_stuck, out],
            [model.leave_range - s - k, s, k, 1 - model.leave_range],
        ]
    )
    gamma = _forward_backward(e, g, move, np.array([1 - s - k - out, s, k, out]))
    kind = gamma.argmax(1)
    prob = gamma.max(1)
    kind[outside] = RANGE

    # exact checks: a stuck value belongs to a long run, all of which is stuck; an excursion is brief
    runs = start.size
    stuck_share = np.bincount(run, gamma[:, STUCK], runs) / length
    long_stuck = (length >= model.min_stuck) & (stuck_share > 0.5)
    kind = np.where(long_stuck[run], STUCK, np.where(kind == STUCK, np.where(gamma[:, SPIKE] > gamma[:, NORMAL], SPIKE, NORMAL), kind))
    kind[outside] = RANGE
    prob = np.where(kind == STUCK, stuck_share[run], prob)
    spike = kind == SPIKE
    change = np.flatnonzero(np.r_[True, (spike[1:] != spike[:-1]) | (g[1:] != g[:-1])])
    lengths = np.diff(np.r_[change, n])
    too_long = np.repeat(lengths > model.max_spike, lengths) & spike
    kind[too_long] = NORMAL
    return kind, prob


def _forward_backward(e: np.ndarray, g: np.ndarray, move: np.ndarray, prior: np.ndarray, window: int = 128, margin: int = 32) -> np.ndarray:
    """State probabilities of each row; sequences are cut into windows with margins that run side by side.

    The chain forgets its start within a few steps, so a margin of 32 leaves no trace of the cut.
    """
    n = e.shape[0]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    end = np.r_[begin[1:], n]
    firsts = np.concatenate([np.arange(a, b, window) for a, b in zip(begin, end)])
    which = np.repeat(np.arange(begin.size), [len(range(a, b, window)) for a, b in zip(begin, end)])
    lo, hi = begin[which], end[which]
    steps = window + 2 * margin
    at = firsts[:, None] - margin + np.arange(steps)[None, :]
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    at = np.clip(at, 0, n - 1)
    ones = np.ones(4)
    alpha = np.empty((steps, firsts.size, 4))
    a = np.broadcast_to(prior, (firsts.size, 4)).copy()
    started = np.zeros(firsts.size, bool)
    for i in range(steps):
        ins = inside[:, i]
        emit = np.where(ins[:, None], e[at[:, i]], ones)
        a = np.where((ins & started)[:, None], a @ move, a) * emit
        a /= a.sum(1, keepdims=True)
        started |= ins
        alpha[i] = a
    b = np.ones((firsts.size, 4))
    gamma = np.empty((n, 4))
    for i in range(steps - 1, -1, -1):
        if margin <= i < margin + window:
            take = inside[:, i]
            p = alpha[i] * b
            p /= p.sum(1, keepdims=True)
            gamma[at[take, i]] = p[take]
        emit = np.where(inside[:, i][:, None], e[at[:, i]], ones)
        nb = np.where(inside[:, i][:, None], (b * emit) @ move.T, b)
        b = nb / nb.max(1, keepdims=True)
    return gamma
