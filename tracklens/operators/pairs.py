"""Pairs of a tick, tested as blocks of arrays in the task that holds two tiles of it; only counts or the pairs found leave the task."""

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracklens import constants as K
from tracklens.operators.ticks import TICK
from tracklens.session import prepare, stage_table

TILE = 16_384  # aircraft of a tick that one task pairs with as many others
BLOCK = 65_536  # pairs tested at once, so that a block stays in a core's cache
PAIRS_AT_ONCE = 100_000


def tiled(points: DataFrame, fields: list[str], tile: int = TILE) -> DataFrame:
    """Points dealt to the rows of two tiles each; a tick of at most `tile` aircraft is one tile and nothing is copied."""
    if tile <= 0:
        raise ValueError("tile must be positive")
    crowded = points.groupBy(*TICK).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > tile)
    sized = points.select(*TICK, *fields).join(crowded, TICK, "left").withColumn("tiles_", F.coalesce(F.ceil(F.col("n_") / tile), F.lit(1)).cast("int"))
    placed = sized.withColumn("tile_", F.pmod(F.xxhash64("aircraft_id"), F.col("tiles_")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("tiles_") - 1), lambda j: F.struct(F.least(j, F.col("tile_")).alias("low"), F.greatest(j, F.col("tile_")).alias("high")))
    return placed.select(*TICK, "tile_", *fields, F.explode(met).alias("t_")).select(*TICK, F.col("t_.low").alias("low_"), F.col("t_.high").alias("high_"), "tile_", *fields)


def mapped(points: DataFrame, fields: list[str], run, schema: str, staged: bool = False, tile: int = TILE) -> DataFrame:
    """`run(table)` yields dicts of arrays for the aircraft of two tiles; its rows get the keys of their tick."""
    prepare(points.sparkSession)
    # Two passes read these rows: the count of a tick and its tiles.
    source = points if staged else stage_table(points.select(*TICK, *fields), "paired")
    rows = tiled(source, fields, tile)
    keys = ", ".join(f"{n} {t}" for n, t in rows.select(*TICK).dtypes)

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for found in run(table):
            arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in found.values()]
            size = len(arrays[0])
            yield pa.RecordBatch.from_arrays([pa.repeat(v, size) for v in key[:3]] + arrays, names=TICK + list(found))

    return rows.groupBy(*TICK, "low_", "high_").applyInArrow(each, f"{keys}, {schema}")


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles; null becomes NaN, which passes no test."""
    return pc.cast(table.column(name), pa.float64(), safe=False).to_numpy().astype(np.float64)


def half_chord(lat_a, lon_a, lat_b, lon_b):
    """Squared half-chord of `near.pair_term`, of arrays in degrees."""
    s_lat, s_lon = np.sin((np.radians(lat_b) - np.radians(lat_a)) / 2), np.sin((np.radians(lon_b) - np.radians(lon_a)) / 2)
    return s_lat * s_lat + np.cos(np.radians(lat_a)) * np.cos(np.radians(lat_b)) * s_lon * s_lon


def _factors(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product is the squared chord of all pairs in single precision, and a bound of its error."""
    la, lo = np.radians(lat), np.radians(lon)
    u = np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    if np.isfinite(u).any():
        u = u - np.nanmean(u, axis=0)
    square = (u * u).sum(axis=1)
    one = np.ones_like(square)
    left = np.column_stack([-2 * u, square, one]).astype(np.float32)
    right = np.ascontiguousarray(np.column_stack([u, one, square]).astype(np.float32).T)
    return left, right, 2e-6 * (float(np.nanmax(square)) if np.isfinite(square).any() else 0.0)


def interval(values: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of every value, and the first and the end of the ranks whose values differ from it by less than `width`."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    u, first, at, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    starts, size = ends - n, len(u)
    high, low = np.searchsorted(u, u + width), np.searchsorted(u, u - width, side="right")
    # The sums are rounded; the test is the difference, so the edges are set by it.
    while (more := (high < size) & (u[np.minimum(high, size - 1)] - u < width)).any():
        high = high + more
    while (less := (high > 0) & ~(u[high - 1] - u < width)).any():
        high = high - less
    while (more := (low > 0) & (u - u[low - 1] < width)).any():
        low = low - more
    while (less := (low < size) & ~(u - u[np.minimum(low, size - 1)] < width)).any():
        low = low + less
    return rank, starts[np.minimum(low, size - 1)][at], ends[high - 1][at]


def _near(left, right, guard, limit, rows, cols, lat, lon, work):
    """Pairs of a block inside a limit: by the product, and by the exact formula where that is too close to call."""
    shape = rows.stop - rows.start, cols.stop - cols.start
    chord = np.matmul(left[rows], right[:, cols], out=work[:math.prod(shape)].reshape(shape))

    def test(half: float) -> np.ndarray:
        sure, maybe = chord < np.float32(4 * half - guard - 1e-6 * half), chord < np.float32(4 * half + guard + 1e-6 * half)
        if np.count_nonzero(sure) != np.count_nonzero(maybe):
            i, j = np.divmod(np.flatnonzero(maybe.ravel() != sure.ravel()), sure.shape[1])
            a, b = i + rows.start, j + cols.start
            sure[i, j] = half_chord(lat[a], lon[a], lat[b], lon[b]) < half
        return sure

    return [test(h) for h in limit]


def close_blocks(table: pa.Table, settings: list[tuple[float, float]], previous: bool) -> Iterator[tuple]:
    """Blocks of pairs inside the limits of each setting: row numbers, first row, first column, one mask a setting, one for the tick before."""
    lat, lon, alt = (numbers(table, c) for c in ("lat_deg", "lon_deg", "altitude_m"))
    widest = max(v for _, v in settings)
    known = np.isfinite(lat) & np.isfinite(lon) & ~np.asarray(table.column("aircraft_id").is_null())
    kept = np.flatnonzero(known & np.isfinite(alt) if math.isfinite(widest) else known)
    kept = kept[np.argsort(alt[kept], kind="stable")]
    n = len(kept)
    if n < 2:
        return
    lat, lon, alt = lat[kept], lon[kept], alt[kept]
    names = table.column("aircraft_id").combine_chunks().dictionary_encode()
    repeated = len(names.dictionary) < len(names) - names.null_count
    code = np.asarray(names.indices.fill_null(-1))[kept]
    tile = np.asarray(table.column("tile_"))[kept]
    crossing = tile.min() != tile.max()
    limits = sorted({h for h, _ in settings})
    half = [math.sin(h / (2 * K.EARTH_RADIUS_M)) ** 2 for h in limits]
    left, right, guard = _factors(lat, lon)
    work = np.empty(max(256 * 256, BLOCK + 256 * n if n > BLOCK // 8 else 256 * n), np.float32)
    position = np.uint16 if n < 65_000 else np.uint32
    place = np.arange(n, dtype=position)
    ends = {v: interval(alt, v)[2].astype(position) if math.isfinite(v) else np.full(n, n, position) for _, v in settings}
    if previous:
        was_lat, was_lon, was_alt = (numbers(table, c)[kept] for c in ("was_lat", "was_lon", "was_alt"))
        seen = np.isfinite(was_lat) & np.isfinite(was_lon) & np.isfinite(was_alt)
        was_left, was_right, was_guard = _factors(np.where(seen, was_lat, np.nan), was_lon)
        bands = {}
        for v in {v for _, v in settings} if seen.any() else ():
            rank, low, wide = np.full(n, n, position), np.zeros(n, position), np.zeros(n, position)
            r, a, b = interval(was_alt[seen], v)
            rank[seen], low[seen], wide[seen] = r, a, b - a
            bands[v] = rank, low, wide
    start = 0
    while start < n:
        size = max(8, min(256, BLOCK // max(1, int(ends[widest][start]) - start)))
        stop = min(n, start + size)
        rows, cols = slice(start, stop), slice(start, int(ends[widest][stop - 1]))
        later = np.ones((stop - start, cols.stop - start), bool)
        later[:, :stop - start] = np.triu(later[:, :stop - start], 1)
        if crossing:
            later &= tile[rows, None] != tile[None, cols]
        if repeated:
            later &= code[rows, None] != code[None, cols]
        level = {v: later & (place[None, cols] < ends[v][rows, None]) for v in ends}
        near = dict(zip(limits, _near(left, right, guard, half, rows, cols, lat, lon, work)))
        now = [near[h] & level[v] for h, v in settings]
        held = None
        if previous:
            held = [np.zeros_like(m) for m in now]
            if bands:
                was = dict(zip(limits, _near(was_left, was_right, was_guard, half, rows, cols, was_lat, was_lon, work)))
                same = {v: (rank[None, cols] - low[rows, None]) < wide[rows, None] for v, (rank, low, wide) in bands.items()}
                held = [m & was[h] & same[v] for m, (h, v) in zip(now, settings)]
        yield kept, rows, cols, now, held
        start = stop


def _marks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(codes, return_inverse=True)
    marks = np.zeros((len(values), len(codes)), np.float32)
    marks[at, np.arange(len(codes))] = 1
    return values, marks


def _tally(total: np.ndarray, marks: np.ndarray, mask: np.ndarray, rows: slice, cols: slice) -> None:
    """Adds the pairs of a block by the classes of both sides; single precision holds the count of a block's rows exactly."""
    total += (marks[:, rows] @ mask.astype(np.float32)).astype(np.float64) @ marks[:, cols].T.astype(np.float64)


def _folded(found: dict, values: np.ndarray, total: np.ndarray, sign: int, previous: bool) -> None:
    for i, j in zip(*np.nonzero(total)):
        a, b = values[i], values[j]
        key = (max(a // 1000, b // 1000), max(a % 1000, b % 1000) if previous else None)
        found[key] = found.get(key, 0) + sign * int(total[i, j])


def counted(settings: list[tuple[float, float]], previous: bool, reach: bool):
    """Counts of pairs by setting, age of the older report and, where the pair was inside one tick earlier, its age there."""
    def run(table: pa.Table) -> Iterator[dict]:
        out = {"setting": [], "age": [], "age_prev": [], "n": []}
        ages, before = np.asarray(table.column("age")), np.asarray(table.column("was_age").fill_null(0))
        sums = None
        for kept, rows, cols, now, held in close_blocks(table, settings, previous):
            if sums is None:
                values, marks = _marks(ages[kept] * 1000)
                both, was_marks = _marks(ages[kept] * 1000 + before[kept])
                sums = [(np.zeros((len(values),) * 2), np.zeros((len(both),) * 2)) for _ in settings]
            for s, (all_, kept_) in enumerate(sums):
                _tally(all_, marks, now[s], rows, cols)
                if previous and held[s].any():
                    _tally(kept_, was_marks, held[s], rows, cols)
        for s, (all_, kept_) in enumerate(sums or ()):
            found: dict = {}
            _folded(found, values, all_, 1, False)
            stayed: dict = {}
            _folded(stayed, both, kept_, 1, True)
            for (age, was), n in stayed.items():
                found[age, None] -= n
                found[age, was] = n
            for (age, was), n in found.items():
                if n:
                    for name, value in zip(out, (s, int(age), was if was is None else int(was), n)):
                        out[name].append(value)
        if reach and not out["n"]:
            # Pairs near enough but at other heights still give their airport a row of zeros.
            if any(m[0].any() for _, _, _, m, _ in close_blocks(table, [(max(h for h, _ in settings), math.inf)], False)):
                out = {"setting": [0], "age": [0], "age_prev": [None], "n": [0]}
        if out["n"]:
            yield {"setting": pa.array(out["setting"], pa.int32()), "age": pa.array(out["age"], pa.int64()), "age_prev": pa.array(out["age_prev"], pa.int64()), "n": pa.array(out["n"], pa.int64())}

    return run


def found(settings: list[tuple[float, float]], previous: bool):
    """The pairs themselves, a bounded number of rows at once."""
    def run(table: pa.Table) -> Iterator[dict]:
        ids = table.column("aircraft_id").combine_chunks()
        order = np.empty(len(ids), np.int64)
        order[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))
        seen_us, t0 = np.asarray(table.column("timestamp_us")), table.column("t0_us")[0]
        was_us = np.asarray(table.column("was_us").fill_null(0))
        for kept, rows, cols, now, held in close_blocks(table, settings, previous):
            i, j = np.nonzero(now[0])
            stayed = held[0][i, j] if previous else None
            for at in range(0, len(i), PAIRS_AT_ONCE):
                cut = slice(at, at + PAIRS_AT_ONCE)
                a, b = kept[i[cut] + rows.start], kept[j[cut] + cols.start]
                swap = order[a] > order[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                batch: dict[str, Any] = {"a_id": ids.take(pa.array(a)), "b_id": ids.take(pa.array(b)), "older_us": np.minimum(seen_us[a], seen_us[b]), "t0_us": pa.repeat(t0, len(a))}
                if previous:
                    batch["older_prev"] = pa.array(np.minimum(was_us[a], was_us[b]), mask=~stayed[cut])
                yield batch

    return run


SIDE = (128, 512)  # aircraft by aircraft of a block of measured pairs
STATES = ["x", "y", "altitude_m", "nx", "ny", "vx", "vy", "vz"]


def java_hypot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`hypot` digit by digit as the JVM has it, for pairs whose two distances differ in the last digit only."""
    def high(v):
        return (v.view(np.int64) & np.int64(-1 << 32)).view(np.float64)

    a, b = np.maximum(np.abs(x), np.abs(y)), np.minimum(np.abs(x), np.abs(y))
    w = a - b
    t1 = high(a)
    far = np.sqrt(t1 * t1 - (b * -b - (a - t1) * (a + t1)))
    two = a + a
    t1, y1 = high(two), high(b)
    close = np.sqrt(t1 * y1 - (w * -w - (t1 * (b - y1) + (two - t1) * b)))
    return np.where(a >= b * 2.0**60, a + b, np.where(w > b, far, close))


def _sides(table: pa.Table) -> list[dict]:
    """The two sides that meet: the members of two tiles, or twice those of one. Aircraft with a velocity come first."""
    tile = np.asarray(table.column("tile_"))
    sides = []
    for t in np.unique(tile):
        part = table.filter(pa.array(tile == t)) if tile.min() != tile.max() else table
        side = {c: numbers(part, c) for c in STATES}
        order = np.argsort(np.isnan(side["vx"]), kind="stable")
        side = {c: np.ascontiguousarray(v[order]) for c, v in side.items()}
        side["still"] = (side["nx"] == side["x"]) & (side["ny"] == side["y"])
        side["moving"] = int((~np.isnan(side["vx"])).sum())
        sides.append(side)
    return sides


def _blocks(sides: list[dict]) -> Iterator[tuple]:
    """Indexes of both sides that broadcast to blocks of pairs, each pair once; blocks of pairs that all have velocities say so."""
    a, b = sides[0], sides[-1]
    rows, cols = SIDE

    def cut(n: int, moving: int, size: int):
        edges = sorted({*range(0, n, size), moving, n})
        return [(s, e) for s, e in zip(edges, edges[1:]) if e > s]

    left = cut(len(a["x"]), a["moving"], rows)
    if a is not b:
        for s, e in left:
            for c, d in cut(len(b["x"]), b["moving"], cols):
                yield np.s_[s:e, None], np.s_[None, c:d], e <= a["moving"] and d <= b["moving"]
        return
    n, moving = len(a["x"]), a["moving"]
    for s, e in left:
        i, j = np.triu_indices(e - s, 1)
        if len(i):
            yield i + s, j + s, e <= moving
        for c, d in cut(n - e, max(0, moving - e), cols):
            yield np.s_[s:e, None], np.s_[None, c + e:d + e], e <= moving and d + e <= moving


def _least_gap(sides: list[dict]) -> float:
    """Smallest difference of two heights, by their order."""
    a, b = (np.sort(s["altitude_m"][~np.isnan(s["altitude_m"])]) for s in (sides[0], sides[-1]))
    if sides[0] is sides[-1]:
        return float(np.diff(a).min()) if len(a) > 1 else math.nan
    if not len(a) or not len(b):
        return math.nan
    at = np.searchsorted(b, a)
    return float(min(np.abs(a - b[np.minimum(at, len(b) - 1)]).min(), np.abs(a - b[np.maximum(at - 1, 0)]).min()))


def measured(wanted: list[str], horizons: dict[str, float], sphere: tuple[float, float]):
    """Sums, counts and least values over the pairs of two tiles. States are local metres; a null state makes what needs it null.

    `wanted` names what is measured: active, closing, mean_h, min_h, min_rz, sphere, and count_, min_ph_ and min_pv_ of a horizon.
    """
    does = set(wanted)
    plane = bool(does & {"active", "closing", "mean_h", "min_h"})
    ahead = {n: h for n, h in horizons.items() if does & {f"count_{n}", f"min_ph_{n}", f"min_pv_{n}"}}
    near2, closing2 = K.PROXIMITY_HORIZONTAL_M**2, K.CLOSING_RANGE_M**2

    def run(table: pa.Table) -> Iterator[dict]:
        sides = _sides(table)
        a, b = sides[0], sides[-1]
        n = len(a["x"])
        pairs = n * (n - 1) // 2 if a is b else n * len(b["x"])
        if not pairs:
            return
        counts = {c: 0 for c in wanted if c.startswith("count_") or c in ("active", "closing")}
        least = {c: math.nan for c in wanted if c.startswith(("min_h", "min_ph_", "min_pv_"))}
        total, total_n = 0.0, 0
        whole = not any(np.isnan(s[c]).any() for s in sides for c in ("x", "y", "altitude_m"))
        whole_v = whole and not any(np.isnan(s[c][:s["moving"]]).any() for s in sides for c in ("vx", "vy", "vz"))
        smallest = lambda v, full: float(v.min() if full else np.fmin.reduce(v, axis=None))

        def keep(name: str, value: float) -> None:
            least[name] = float(np.fmin(least[name], value))

        # Blocks are worked on in the same few arrays: fresh ones would cost more than the arithmetic.
        work, masks = np.empty((12, SIDE[0] * SIDE[1])), np.empty((3, SIDE[0] * SIDE[1]), bool)
        for p, q, moving in _blocks(sides) if plane or ahead else ():
            shape = np.broadcast_shapes(a["x"][p].shape, b["x"][q].shape)
            w, m = ([v[:math.prod(shape)].reshape(shape) for v in store] for store in (work, masks))
            rel = lambda c, to: np.subtract(a[c][p], b[c][q], out=to)  # noqa: B023,E731

            def norm2(x, y, to, spare):
                np.add(np.multiply(x, x, out=to), np.multiply(y, y, out=spare), out=to)
                return to

            def both(name, left, right):  # noqa: B023
                counts[name] += int(np.count_nonzero(np.logical_and(left, right, out=left)))

            rx, ry = rel("x", w[0]), rel("y", w[1])
            if plane:
                d2 = norm2(rx, ry, w[2], w[3])
                if "mean_h" in does:
                    h = np.sqrt(d2, out=w[3])
                    total += float(h.sum() if whole else np.nansum(h))
                    total_n += h.size if whole else int(np.count_nonzero(~np.isnan(h)))
                if "min_h" in does:
                    keep("min_h", smallest(d2, whole))
                if "active" in does:
                    rz = np.abs(rel("altitude_m", w[3]), out=w[3])
                    both("active", np.less(d2, near2, out=m[0]), np.less(rz, K.PROXIMITY_VERTICAL_M, out=m[1]))
                if "closing" in does:
                    wx, wy = rel("nx", w[3]), rel("ny", w[4])
                    gap = np.subtract(norm2(wx, wy, w[5], w[6]), d2, out=w[5])
                    both("closing", np.greater(gap, 0, out=m[0]), np.less(d2, closing2, out=m[1]))
                    tie = np.less_equal(np.abs(gap, out=w[5]), np.multiply(d2, 1e-13, out=w[6]), out=m[1])
                    tie = np.greater(tie, np.logical_and(a["still"][p], b["still"][q], out=m[2]), out=tie)
                    if tie.any():
                        at = np.flatnonzero(tie.ravel())
                        flat = lambda v: v.ravel()[at]  # noqa: B023,E731
                        true = (java_hypot(flat(wx), flat(wy)) > java_hypot(flat(rx), flat(ry))) & (flat(d2) < closing2)
                        counts["closing"] += int(true.sum()) - int(flat(m[0]).sum())
            if not (ahead and moving):
                continue
            vx, vy, vz, rz = rel("vx", w[3]), rel("vy", w[4]), rel("vz", w[5]), rel("altitude_m", w[6])
            v2 = norm2(vx, vy, w[7], w[8])
            free = np.add(np.multiply(rx, vx, out=w[8]), np.multiply(ry, vy, out=w[9]), out=w[8])
            np.negative(free, out=free)
            with np.errstate(divide="ignore", invalid="ignore"):
                np.divide(free, v2, out=free)
            np.copyto(free, 0.0, where=np.less_equal(v2, 1e-9, out=m[0]))
            for name, horizon in ahead.items():
                if whole_v:
                    t = np.maximum(np.minimum(free, horizon, out=w[9]), 0.0, out=w[9])
                else:
                    t = np.fmax(np.fmin(free, horizon, out=w[9]), 0.0, out=w[9])
                px = np.add(np.multiply(vx, t, out=w[10]), rx, out=w[10])
                py = np.add(np.multiply(vy, t, out=w[11]), ry, out=w[11])
                np.multiply(px, px, out=px)
                ph = np.add(px, np.multiply(py, py, out=py), out=px)
                pv = np.add(np.multiply(vz, t, out=w[9]), rz, out=w[9])
                np.abs(pv, out=pv)
                if f"count_{name}" in does:
                    both(f"count_{name}", np.less(ph, near2, out=m[0]), np.less(pv, K.PROXIMITY_VERTICAL_M, out=m[1]))
                if f"min_ph_{name}" in does:
                    keep(f"min_ph_{name}", smallest(ph, whole_v))
                if f"min_pv_{name}" in does:
                    keep(f"min_pv_{name}", smallest(pv, whole_v))
        if "sphere" in does:
            counts["sphere"] = sum(int(np.count_nonzero(now[0])) for _, _, _, now, _ in close_blocks(table, [sphere], False))
        if "min_rz" in does:
            least["min_rz"] = _least_gap(sides)
        roots = {c: math.sqrt(v) if c.startswith(("min_h", "min_ph_")) else v for c, v in least.items()}
        out = {"pairs": pairs, "sum_h": total, "n_h": total_n} | counts
        yield {c: pa.array([v], pa.float64() if c == "sum_h" else pa.int64()) for c, v in out.items()} | {
            c: pa.array([None if math.isnan(v) else v], pa.float64()) for c, v in roots.items()}

    names = [c for c in wanted if c.startswith("count_") or c in ("active", "closing")] + [c for c in wanted if c == "sphere"]
    mins = [c for c in wanted if c.startswith(("min_h", "min_ph_", "min_pv_"))] + [c for c in wanted if c == "min_rz"]
    return run, "pairs long, sum_h double, n_h long" + "".join(f", {c} long" for c in names) + "".join(f", {c} double" for c in mins)
