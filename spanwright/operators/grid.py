"""Irregular readings onto a regular grid, with gaps filled by a Kalman smoother.

Each source and field follows a local linear trend in continuous time (an integrated Wiener level
and slope). Samples are reduced to one reading a slot (mean value at mean time) inside the one
exchange of the raw rows; forward filter and backward smoother then run over source-days with
margins, many days side by side, and are evaluated at the grid times. Slots without a usable
sample get the smoothed value, its standard deviation and the flag ``missing``.

Defined results: a repeated delivery counts once; a sample without a time, with an error, or with
a null or NaN field is not usable; a null endpoint is a source of its own; slots in silences of
``max_gap`` or more are not part of the grid; an empty table gives no rows; extra columns are
ignored. A filled value uses the readings of its own day, the first two hours of readings of the next
and the last two of the day before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.telemetry import sample_micros
from spanwright.runtime import materialize, sorted_groups

FIELDS = ("gpu_util_pct", "mem_used_mib")
BOUNDS = ((0.0, 100.0), (0.0, None))  # what a filled value may be; no upper bound: the memory that the source has
DAY = 86_400
CELLS = 400_000  # steps times sequences that are smoothed side by side; each takes about 300 bytes
OUT_SCHEMA = "endpoint string, slot bigint, gpu_util_pct double, gpu_util_pct_sd double, mem_used_mib double, mem_used_mib_sd double, n_samples bigint, missing boolean"


def slot_means(gpu_log: DataFrame, step_sec: int = 60) -> DataFrame:
    """One row per source and occupied slot: number, mean time and mean fields of its usable samples.

    The raw rows are exchanged once, by source and day; removing repeated deliveries and the means
    both work within that partitioning.
    """
    us = sample_micros(F.col("logged_at"), F.col("sampled_at"))
    total = F.col("mem_total_mib").cast("double") if "mem_total_mib" in gpu_log.columns else F.lit(None).cast("double")
    top = F.when((total > 0) & ~F.isnan(total), total)
    usable = gpu_log.where(F.col("error").isNull() & F.col("sample_id").isNotNull()).select(
        "endpoint", F.col("sample_id").cast("bigint").alias("sample_id"), us.alias("us"), top.alias("top"), *(F.col(f).cast("double").alias(f) for f in FIELDS)
    )
    for f in FIELDS:
        usable = usable.where(F.col(f).isNotNull() & ~F.isnan(f))
    step = step_sec * 1_000_000
    slotted = usable.where(F.col("us").isNotNull()).withColumns(
        {"day": F.floor(F.col("us") / F.lit(DAY * 1_000_000)).cast("bigint"), "slot": F.floor(F.col("us") / F.lit(step)).cast("bigint") * step_sec}
    )
    once = slotted.repartition("endpoint", "day").groupBy("endpoint", "day", "slot", "sample_id").agg(F.min("us").alias("us"), F.max("top").alias("top"), *(F.min(f).alias(f) for f in FIELDS))
    return once.groupBy("endpoint", "day", "slot").agg(
        F.max("top").alias("top"), F.count("*").alias("n"), (F.avg(F.col("us") / 1e6 - F.col("slot")) + F.col("slot")).alias("at"), *(F.avg(f).alias(f) for f in FIELDS)
    )


def regular_grid(gpu_log: DataFrame, step_sec: int = 60, max_gap: int = DAY, margin_sec: int = 7200) -> DataFrame:
    """One row per source and slot of the grid (see ``OUT_SCHEMA``).

    The grid of a source spans its occupied slots and every silence between two of them whose
    starts are less than ``max_gap`` (at most a day) apart.
    """
    if not 0 < max_gap <= DAY or DAY % step_sec:
        raise ValueError("max_gap must be within a day and a day a whole number of slots")
    # a gap shorter than a day ends in its own day or the next, whose first readings serve it
    day = Window.partitionBy("endpoint", "day")
    means = slot_means(gpu_log, step_sec).withColumns({"low": F.min("slot").over(day), "high": F.max("slot").over(day)})
    means = materialize(means, "slots")
    reach = F.filter(
        F.array(F.col("day"), F.when(F.col("slot") <= F.col("low") + margin_sec, F.col("day") - 1), F.when(F.col("slot") >= F.col("high") - margin_sec, F.col("day") + 1)),
        lambda x: x.isNotNull(),
    )
    copies = means.select("endpoint", F.explode(reach).alias("chunk"), "slot", "n", "at", "top", *FIELDS)
    keyed = copies.repartition("endpoint", "chunk").sortWithinPartitions("endpoint", "chunk", "slot")
    return keyed.mapInArrow(lambda batches: _smooth_days(batches, step_sec, max_gap), OUT_SCHEMA)


def _smooth_days(batches: Iterator[pa.RecordBatch], step: int, max_gap: int) -> Iterator[pa.RecordBatch]:
    yield from sorted_groups(batches, ["endpoint", "chunk"], lambda table: _smooth(table, step, max_gap))


def _smooth(table: pa.Table, step: int, max_gap: int) -> Iterator[pa.Table]:
    chunk = table.column("chunk").to_numpy()
    codes = table.column("endpoint").combine_chunks().dictionary_encode()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    endpoint = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    slot = table.column("slot").to_numpy()
    n, at = table.column("n").to_numpy(), table.column("at").to_numpy()
    y = np.stack([table.column(f).to_numpy() for f in FIELDS])
    first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (endpoint[1:] != endpoint[:-1])])
    last = np.r_[first[1:], slot.size]
    top = np.fmax.reduceat(table.column("top").to_numpy(zero_copy_only=False).astype(float), first)  # NaN where no row has it
    top = np.where(np.isnan(top), np.inf, top)

    # how many slots each gap leaves to fill within its day, counted before any is made
    of_row, gap = np.repeat(np.arange(first.size), last - first), np.diff(slot)
    inner = np.flatnonzero((gap > step) & (gap < max_gap) & (of_row[1:] == of_row[:-1]))
    gap_low = np.maximum(slot[inner] + step, chunk[inner] * DAY)
    gap_high = np.minimum(slot[inner + 1], (chunk[inner] + 1) * DAY)
    slots_of = np.maximum((gap_high - gap_low + step - 1) // step, 0)
    gap_group = of_row[inner]
    size = (last - first) + np.bincount(gap_group, slots_of, first.size).astype(np.int64)

    # sequences of like length share a slab of bounded size, however many slots sparse sources have to fill
    by_length = np.argsort(-size, kind="stable")
    at_group = 0
    names = table.column("endpoint").take(pa.array(first))
    while at_group < by_length.size:
        share = max(1, CELLS // int(size[by_length[at_group]]))
        mine = np.sort(by_length[at_group : at_group + share])
        at_group += share
        part = _smooth_slab(mine, first, last, slot, chunk, n, at, y, top, inner, gap_group, gap_low, slots_of, step)
        if part is not None:
            owner, columns = part
            yield pa.table({"endpoint": names.take(pa.array(owner)), **columns})


def _smooth_slab(
    mine: np.ndarray, first: np.ndarray, last: np.ndarray, slot: np.ndarray, chunk: np.ndarray, n: np.ndarray, at: np.ndarray, y: np.ndarray, top: np.ndarray,
    inner: np.ndarray, gap_group: np.ndarray, gap_low: np.ndarray, slots_of: np.ndarray, step: int,
) -> tuple[np.ndarray, dict[str, pa.Array]] | None:
    """The rows of the sequences ``mine``: the sequence of each, and its columns."""
    sizes = last[mine] - first[mine]
    rows = np.repeat(first[mine] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    group = np.repeat(np.arange(mine.size), sizes)
    place = np.full(first.size, -1)
    place[mine] = np.arange(mine.size)
    gaps = np.flatnonzero((place[gap_group] >= 0) & (slots_of > 0))
    many = slots_of[gaps]
    fill_at = np.repeat(gap_low[gaps] - step * np.r_[0, np.cumsum(many)[:-1]], many) + step * np.arange(int(many.sum()))
    fill_of = np.repeat(place[gap_group[gaps]], many)
    slot, n, at, y, top = slot[rows], n[rows], at[rows], y[:, rows], top[mine]
    day = chunk[first[mine]]

    # all events of these days, sorted by day and time: readings at their mean time, fills at mid-slot
    when = np.r_[at, fill_at + step / 2]
    of = np.r_[group, fill_of]
    order = np.lexsort((when, of))
    is_reading = order < rows.size
    source = np.where(is_reading, order, 0)
    when, of = when[order], of[order]
    value = np.where(is_reading, y[:, source], np.nan)
    weight = np.where(is_reading, n[source], 1)
    slots = np.where(is_reading, slot[source], fill_at[np.where(is_reading, 0, order - rows.size)] if fill_at.size else 0)
    mean, sd = _kalman(when, value, weight, of, top)

    inside = (slots >= day[of] * DAY) & (slots < (day[of] + 1) * DAY)
    out = np.flatnonzero(inside)
    if not out.size:
        return None
    read = is_reading[out]
    columns = {"slot": pa.array(slots[out], pa.int64())}
    for j, f in enumerate(FIELDS):
        columns[f] = pa.array(np.where(read, value[j, out], np.clip(mean[j, out], BOUNDS[j][0], top[of[out]] if BOUNDS[j][1] is None else BOUNDS[j][1])), pa.float64())
        columns[f"{f}_sd"] = pa.array(sd[j, out], pa.float64())
    columns["n_samples"] = pa.array(np.where(read, weight[out], 0), pa.int64())
    columns["missing"] = pa.array(~read)
    return mine[of[out]], columns


def _kalman(when: np.ndarray, value: np.ndarray, weight: np.ndarray, of: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed mean and standard deviation of each field at each event.

    ``value`` is (fields, events), NaN where there is no reading; events are sorted by sequence
    ``of`` and time; ``top`` holds each sequence's bound of the fields that have none. All sequences and fields advance together, one event of each a step.
    """
    fields, events = value.shape
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    length = np.diff(np.r_[start, events])
    by_length = np.argsort(-length, kind="stable")  # so that the running sequences are a prefix
    start, length = start[by_length], length[by_length]
    steps, width = int(length.max()), start.size
    dt = np.r_[0.0, np.diff(when)]
    dt[start] = 0.0
    running = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than each step

    r, wander, q, level = (np.empty((fields, width)) for _ in range(4))
    value = value.copy()
    for k, (a, m) in enumerate(zip(start, length)):
        for j in range(fields):
            x, t = value[j, a : a + m], when[a : a + m]
            ok = ~np.isnan(x)
            low, high = BOUNDS[j]
            x = np.clip(x, low, top[of[a]] if high is None else high)
            value[j, a : a + m] = x
            x, t = x[ok], t[ok]
            d, h = np.diff(x), np.maximum(np.diff(t), 1.0)
            usual = float(np.median(h)) if h.size else 60.0
            spread = max(1.25 * float(np.abs(d).mean()) if d.size else 0.0, 1e-3 * max(1.0, float(np.median(np.abs(x))) if x.size else 1.0))
            r[j, k] = 0.3 * spread**2
            wander[j, k] = 0.3 * spread**2 / usual  # the level moves by the usual step over the usual interval
            q[j, k] = 0.01 * spread**2 / usual**3
            level[j, k] = x[0] if x.size else 0.0

    m = np.stack([level, np.zeros_like(level)])
    p00, p01, p11 = 100 * r, np.zeros_like(level), q * 60.0
    keep_m, keep_p = np.empty((steps, 2, fields, width)), np.empty((steps, 3, fields, width))
    fore_m, fore_p = np.empty((steps, 2, fields, width)), np.empty((steps, 3, fields, width))
    damp = 300.0  # the slope decays with this time constant, so that long gaps do not run away
    for i in range(steps):
        c = running[i]
        at = start[:c] + i
        h = np.minimum(dt[at], 86_400.0)
        f = np.exp(-h / damp)
        g = damp * (1 - f)
        a0, a1 = m[0, :, :c] + g * m[1, :, :c], f * m[1, :, :c]
        s00, s01, s11 = p00[:, :c], p01[:, :c], p11[:, :c]
        hq = np.minimum(h, damp)
        w = q[:, :c]
        b00 = s00 + 2 * g * s01 + g * g * s11 + wander[:, :c] * h + w * hq**3 / 3
        b01 = f * (s01 + g * s11) + w * hq**2 / 2
        b11 = f * f * s11 + w * hq
        fore_m[i, 0, :, :c], fore_m[i, 1, :, :c] = a0, a1
        fore_p[i, 0, :, :c], fore_p[i, 1, :, :c], fore_p[i, 2, :, :c] = b00, b01, b11
        z = value[:, at]
        seen = ~np.isnan(z)
        noise = r[:, :c] / weight[at]
        k0 = np.where(seen, b00 / (b00 + noise), 0.0)
        k1 = np.where(seen, b01 / (b00 + noise), 0.0)
        miss = np.where(seen, z - a0, 0.0)
        m[0, :, :c], m[1, :, :c] = a0 + k0 * miss, a1 + k1 * miss
        p00[:, :c], p01[:, :c], p11[:, :c] = (1 - k0) * b00, (1 - k0) * b01, np.maximum(b11 - k1 * b01, 1e-18)
        keep_m[i], keep_p[i, 0], keep_p[i, 1], keep_p[i, 2] = m, p00, p01, p11

    mean, sd = np.empty((fields, events)), np.empty((fields, events))
    sm, s00, s01, s11 = m.copy(), p00.copy(), p01.copy(), p11.copy()
    for i in range(steps - 1, -1, -1):
        c = running[i]
        more = running[i + 1] if i + 1 < steps else 0
        km, kp = keep_m[i][:, :, :c], keep_p[i][:, :, :c]
        sm[:, :, more:c] = km[:, :, more:]
        s00[:, more:c], s01[:, more:c], s11[:, more:c] = kp[0, :, more:], kp[1, :, more:], kp[2, :, more:]
        if more:
            h = np.minimum(dt[start[:more] + i + 1], 86_400.0)
            f = np.exp(-h / damp)
            g = damp * (1 - f)
            u00, u01, u11 = kp[0, :, :more], kp[1, :, :more], kp[2, :, :more]
            b00, b01, b11 = (fore_p[i + 1, j][:, :more] for j in range(3))
            det = np.maximum(b00 * b11 - b01 * b01, 1e-300)
            # gain = P F' B^-1
            x00, x01, x10, x11 = u00 + g * u01, f * u01, u01 + g * u11, f * u11
            g00, g01 = (x00 * b11 - x01 * b01) / det, (x01 * b00 - x00 * b01) / det
            g10, g11 = (x10 * b11 - x11 * b01) / det, (x11 * b00 - x10 * b01) / det
            e0, e1 = sm[0, :, :more] - fore_m[i + 1, 0][:, :more], sm[1, :, :more] - fore_m[i + 1, 1][:, :more]
            v00, v01, v11 = s00[:, :more] - b00, s01[:, :more] - b01, s11[:, :more] - b11
            sm[0, :, :more], sm[1, :, :more] = km[0, :, :more] + g00 * e0 + g01 * e1, km[1, :, :more] + g10 * e0 + g11 * e1
            w0, w1 = g00 * v00 + g01 * v01, g00 * v01 + g01 * v11
            w2, w3 = g10 * v00 + g11 * v01, g10 * v01 + g11 * v11
            s00[:, :more] = np.maximum(u00 + w0 * g00 + w1 * g01, 1e-12)
            s01[:, :more] = u01 + w0 * g10 + w1 * g11
            s11[:, :more] = np.maximum(u11 + w2 * g10 + w3 * g11, 1e-18)
        at = start[:c] + i
        mean[:, at], sd[:, at] = sm[0, :, :c], np.sqrt(s00[:, :c])
    return mean, sd
