"""Vehicle support: radio bearers, relay routes, fused navigation, terrain fixes, and sonar contacts.

Bearers and routes are joins. A drive is folded step by step, so drives are spread over the tasks and each is one group; a
terrain search and a sonar image are one row each, worked on as arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .link import Tables

# Sources of position fixes and the mode that each stands for; plausible sizes in metres.
MODES = {"gnss": "gnss", "lidar_slam": "odometry-aided", "vio": "odometry-aided", "terrain": "terrain-relative", "manual": "dead-reckoning"}
LENGTHS, HEIGHTS = (0.3, 3.5), (0.1, 2.0)
#: Cells of a terrain grid that is sent to each task: 8 MB.
MAX_GRID = 1_000_000


def _ahead(bearers: DataFrame, place: dict[str, Column]) -> DataFrame:
    """For each preference the bearers of a vehicle that may be some need's best, and their place o in its order: left out is
    one that stands behind another which carries as much, as fast and as far. Of those alike but in name the first stands for
    all. A bearer that lacks a name or a number, or holds NaN, stays in and keeps none out."""
    number = F.col("bw").isNotNull() & ~F.isnan("bw") & ~F.isnan("ms") & ~F.isnan("sig") & ~F.isnan("reach_km")
    whole = F.coalesce(F.col("name").isNotNull() & number & F.col("sig").isNotNull() & F.col("ms").isNotNull() & F.col("reach_km").isNotNull(), F.lit(False))
    marked = bearers.withColumn("_whole", whole)
    one = marked.where("_whole").groupBy("vehicle", "bw", "ms", "sig", "reach_km").agg(F.min("name").alias("name"))
    ordered = lambda df: reduce(DataFrame.unionByName, [df.withColumn("prefer", F.lit(p)).withColumn("o", o) for p, o in place.items()])

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y", "z", "name"], kind="stable")
        can = np.stack([rows["bw"], -rows["ms"], rows["reach_km"]], axis=1).astype(float)
        kept, n, at = np.empty((64, 3)), 0, []
        for i, c in enumerate(can):
            if not (kept[:n] >= c).all(axis=1).any():
                kept = np.concatenate([kept, np.empty_like(kept)]) if n == len(kept) else kept
                kept[n], n = c, n + 1
                at.append(i)
        return rows.iloc[at]

    flat = ordered(one).select("vehicle", "name", "bw", "ms", "sig", "reach_km", "prefer", F.col("o.x").alias("x"), F.col("o.y").alias("y"), F.col("o.z").alias("z"))
    kept = flat.groupBy("vehicle", "prefer").applyInPandas(first, flat.schema)
    cols = ["vehicle", "prefer", "name", "bw", "ms", "reach_km", F.struct("x", "y", "z", F.col("name").alias("n")).alias("o")]
    return kept.select(*cols).unionByName(ordered(marked.where("NOT _whole")).select(*cols[:-1], "o"))


def choose_bearers(needs: DataFrame, bearers: DataFrame) -> DataFrame:
    """need and the name of its vehicle's best bearer (null: none will do). needs: need, vehicle, min_bandwidth, max_latency,
    range_km, prefer (low_signature, bandwidth or latency). bearers: vehicle, name, bandwidth, latency, available, signature,
    reach_km.

    Needs that ask for the same are answered once, and only by bearers that no better one makes needless (``_ahead``): a
    vehicle's needs don't meet all its bearers. The search holds the distinct bearers of one vehicle at once."""
    b = bearers.where("available").select("vehicle", "name", F.greatest("bandwidth", F.lit(0.0)).alias("bw"), F.greatest("latency", F.lit(0.0)).alias("ms"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "signature")).alias("sig"), F.col("reach_km").cast("double").alias("reach_km"))
    keys = {"low_signature": ("sig", "ms", -F.col("bw")), "bandwidth": (-F.col("bw"), "sig", "ms"), "latency": ("ms", "sig", -F.col("bw"))}
    place = lambda cols: F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(k) for k, c in zip("xyz", cols, strict=True)], F.col("name").alias("n"))
    ahead = _ahead(b, {name: place(cols) for name, cols in keys.items()})
    asks = ["vehicle", "prefer", "min_bandwidth", "max_latency", "range_km"]
    fits = (F.col("bw") >= F.col("min_bandwidth")) & (F.col("ms") <= F.col("max_latency")) & (F.col("reach_km") >= F.col("range_km"))
    answer = needs.select(*asks).distinct().join(ahead, ["vehicle", "prefer"]).where(fits).groupBy(*asks).agg(F.min_by(F.struct("name", "o"), "o").alias("_best"))
    best = needs.join(answer, asks).groupBy("need").agg(F.min_by("_best.name", "_best.o").alias("bearer"))
    return needs.select("need").join(best, "need", "left")


def widest_routes(links: DataFrame, sources: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """src, node, bottleneck, hops, path: for each stated source and each node it reaches over links better than
    min_quality the largest weakest link of any path, and one such path. links: a, b, quality (0 to 1; of a pair given
    several times the last by ``seq``, if there is one, else the best counts). Rounds of a join and an aggregate, each
    a table; as many as the longest path has links."""
    tables = Tables(links.sparkSession)
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "quality"))
    one = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.max_by(q, "seq") if "seq" in links.columns else F.max(q)).alias("q")).where((F.col("q") > min_quality) & (F.col("a") != F.col("b")))
    both = tables.keep(one.select(F.col("a").alias("u"), F.col("b").alias("v"), "q").unionByName(one.select(F.col("b").alias("u"), F.col("a").alias("v"), "q")))
    best = tables.keep(sources.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(1.0).alias("bottleneck"), F.array("src").alias("path")))
    moved = best
    while True:
        step = moved.join(both, F.col("node") == F.col("u")).select("src", F.col("v").alias("node"), F.least("bottleneck", "q").alias("bottleneck"), F.concat("path", F.array("v")).alias("path"))
        first = F.min_by(F.struct("bottleneck", "path"), F.struct((-F.col("bottleneck")).alias("w"), F.size("path").alias("h"), "path"))
        new = tables.keep(step.groupBy("src", "node").agg(first.alias("x")).select("src", "node", "x.*"))
        have = best.select(F.col("src").alias("_s"), F.col("node").alias("_n"), F.col("bottleneck").alias("_q"))
        moved = tables.keep(new.join(have, (F.col("src") == F.col("_s")) & (F.col("node") == F.col("_n")), "left").where(F.col("_q").isNull() | (F.col("bottleneck") > F.col("_q"))).select("src", "node", "bottleneck", "path"))
        if moved.isEmpty():
            return best.select("src", "node", "bottleneck", (F.size("path") - 1).alias("hops"), "path")
        best = tables.keep(best.join(moved.select("src", "node"), ["src", "node"], "left_anti").unionByName(moved))


def navigate(steps: DataFrame, position_variance: float = 25.0, noise: float = 0.5, most_variance: float = 1e6) -> DataFrame:
    """The estimate after each step of each drive: x, y, heading, variance, sigma, quality (1 to 0) and mode.

    steps: drive, seq, speed, heading_rate, dt, and a fix or nulls: fix_x, fix_y, fix_variance, fix_source. Odometry moves the
    estimate along the heading in the middle of the turn and lets the variance grow; a fix then pulls it by the Kalman
    gain. Both axes have one variance, as they start, grow and are fixed alike."""

    def drive(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        x = y = heading = 0.0
        var, mode, out = position_variance, "dead-reckoning", []
        for r in rows.itertuples():
            dt = max(0.0, r.dt)
            middle, far = heading + r.heading_rate * dt / 2, r.speed * dt
            heading = math.remainder(heading + r.heading_rate * dt, 2 * math.pi)
            x, y, var = x + far * math.cos(middle), y + far * math.sin(middle), min(most_variance, var + max(0.0, noise) * dt)
            if not (pd.isna(r.fix_x) or pd.isna(r.fix_y) or pd.isna(r.fix_variance)):
                gain = var / (var + max(1e-6, r.fix_variance))
                x, y, var = x + gain * (r.fix_x - x), y + gain * (r.fix_y - y), (1 - gain) * var
                mode = MODES.get(r.fix_source, MODES["manual"])
            out.append((r.drive, r.seq, x, y, heading, var, math.sqrt(var), 1 / (1 + var / 100), mode))
        return pd.DataFrame(out, columns=["drive", "seq", "x", "y", "heading", "variance", "sigma", "quality", "mode"])

    kind = dict(steps.dtypes)
    return steps.groupBy("drive").applyInPandas(drive, f"drive {kind['drive']}, seq {kind['seq']}, x double, y double, heading double, variance double, sigma double, quality double, mode string")


def _heights(grid: np.ndarray, x: np.ndarray, y: np.ndarray, cell: float) -> np.ndarray:
    """Bilinear heights; points outside take the border's."""
    rows, cols = grid.shape
    i, j = np.clip(np.floor(x / cell), 0, cols - 2).astype(int), np.clip(np.floor(y / cell), 0, rows - 2).astype(int)
    tx, ty = np.clip(x / cell - i, 0, 1), np.clip(y / cell - j, 0, 1)
    low, high = grid[j, i] * (1 - tx) + grid[j, i + 1] * tx, grid[j + 1, i] * (1 - tx) + grid[j + 1, i + 1] * tx
    return low * (1 - ty) + high * ty


def terrain_fixes(asked: DataFrame, grid: list[list[float]], cell: float = 10.0, origin: tuple[float, float] = (0.0, 0.0), search: float = 40.0) -> DataFrame:
    """key, x, y, variance: where around the guess the measured heights fit the grid best (ties: the smallest x, then y).
    asked: key, guess_x, guess_y, samples (array of dx, dy, height)."""
    heights = np.array(grid, float)
    if heights.ndim != 2 or min(heights.shape) < 2 or heights.size > MAX_GRID:
        raise ValueError(f"a grid has 2 x 2 to {MAX_GRID} cells")
    shared, step = asked.sparkSession.sparkContext.broadcast(heights), cell / 2
    n = max(1, round(search / step))
    shift = np.arange(-n, n + 1) * step
    dx, dy = (a.ravel() for a in np.meshgrid(shift, shift, indexing="ij"))  # by x, then y

    def fix(x: np.ndarray, y: np.ndarray, many: np.ndarray, sample: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Keys with as many samples each, their samples one after another."""
        error = np.zeros((len(x), len(dx)))
        for j in range(many):
            sx, sy, height = (a[:, j, None] for a in sample)
            error += (_heights(shared.value, x[:, None] + dx + sx - origin[0], y[:, None] + dy + sy - origin[1], cell) - height) ** 2
        at = np.argmax(error <= error.min(axis=1, keepdims=True) + 1e-12, axis=1)
        rms = np.sqrt(error[np.arange(len(x)), at] / many)
        return x + dx[at], y + dy[at], np.array([max(1.0, (e + 1) ** 2 * 4 / many) for e in rms.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                n = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
                flat = b.column(3).flatten()
                of = [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]
                x, y = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                first, out = np.cumsum(n) - n, np.empty((3, b.num_rows))
                for many in np.unique(n):
                    rows = np.flatnonzero(n == many)
                    at = first[rows, None] + np.arange(many)
                    out[:, rows] = fix(x[rows], y[rows], int(many), tuple(a[at].astype(float) for a in of))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], ["key", "x", "y", "variance"])

    parts = F.transform("samples", lambda s: F.struct(*[s[c].cast("double").alias(c) for c in ("dx", "dy", "height")]))
    rows = asked.where(F.size("samples") > 0).select("key", "guess_x", "guess_y", parts.alias("samples"))
    # A small file is one task; a search takes long for its bytes.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    return rows.mapInArrow(run, f"key {dict(asked.dtypes)['key']}, x double, y double, variance double")


def bright_boxes(pixels: np.ndarray, floor: float, least: int) -> list[tuple[int, int, int, int]]:
    """(first column, first row, last column, last row) of groups of at least so many pixels above the floor that touch by a
    side, from top to bottom. Runs of a row are joined to the runs of the row before that they overlap."""
    up: list[int] = []
    box: list[list[int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    bright = np.zeros((len(pixels), pixels.shape[1] + 2), np.int8)
    bright[:, 1:-1] = pixels > floor
    edges = np.flatnonzero(np.diff(bright, axis=1))
    wide = pixels.shape[1] + 1
    above: list[tuple[int, int, int]] = []
    here: list[tuple[int, int, int]] = []
    last = -1
    for j, a, b in zip((edges[::2] // wide).tolist(), (edges[::2] % wide).tolist(), (edges[1::2] % wide).tolist(), strict=True):
        if j != last:
            above, here, last = here if j == last + 1 else [], [], j
        me = len(up)
        up.append(me)
        box.append([a, j, b - 1, j, b - a])
        for p, q, other in above:
            if p < b and a < q and (o := root(other)) != (m := root(me)):
                keep, gone = min(o, m), max(o, m)
                up[gone] = keep
                k, g = box[keep], box[gone]
                box[keep] = [min(k[0], g[0]), min(k[1], g[1]), max(k[2], g[2]), max(k[3], g[3]), k[4] + g[4]]
        here.append((a, b, me))
    return sorted((tuple(b[:4]) for i, b in enumerate(box) if up[i] == i and b[4] >= least), key=lambda b: (b[1], b[0], b[3], b[2]))


CONTACT = "image {key}, contact int, along_m double, range_m double, length_m double, width_m double, height_m double, shadow_m double, aspect double, grazing_deg double, class string, score double"


def sonar_contacts(images: DataFrame, least_pixels: int = 3, threshold: float = 0.5, physics: float = 0.5, longest_shadow: int = 200) -> DataFrame:
    """Contacts of each image with the geometry that highlight and shadow tell, a score, and a class; contact is the place
    in the order by score. images: image, pixels (rows along the track, columns by range), across_m and along_m (sizes of a
    pixel) and altitude. Images of unequal rows, or without pixels, give no contact."""

    def score_of(length: float, height: float, aspect: float, shadow: int, quality: float) -> float:
        off = max(LENGTHS[0] - length, length - LENGTHS[1], 0.0)
        size = max(0.0, 1 - off / 2)
        cast = 0.05 if not shadow else 0.5 + 0.5 * quality if HEIGHTS[0] <= height <= HEIGHTS[1] else 0.3 * quality
        shape = 1.0 if 0.5 <= aspect <= 4 else max(0.0, 1 - abs(aspect - 2) / 6)
        engineered = min(1.0, max(0.0, 0.45 * size + 0.4 * cast + 0.15 * shape))
        z = (1.8 if shadow else -1.8) + 1.1 * (2 * quality - 1) - 0.6 * abs(length / 1.5 - 1) - 0.5 * abs(2 * height - 1) + 0.2
        return physics * engineered + (1 - physics) / (1 + math.exp(-z))

    def contacts(x: np.ndarray, across: float, along: float, altitude: float) -> list[tuple]:
        mean, spread = float(x.mean()), float(x.std())
        dark, out = max(0.0, mean - spread), []
        for i0, j0, i1, j1 in bright_boxes(x, mean + spread, least_pixels):
            behind = x[(j0 + j1) // 2, i1 + 1 : i1 + 1 + longest_shadow] > dark
            shadow = int(np.argmax(behind)) if behind.any() else len(behind)
            length, width, far, cast = (i1 - i0 + 1) * across, (j1 - j0 + 1) * along, i1 * across, shadow * across
            height = altitude * cast / (far + cast) if shadow and far + cast > 0 else 0.0
            contrast = min(1.0, (mean - dark + 1e-9) / (spread + 1e-9) + 0.5) if spread > 0 else 1.0
            quality = round(min(1.0, shadow / 10) * max(0.2, contrast), 4) if shadow else 0.0
            aspect = length / width if width > 0 else 0.0
            score = score_of(length, height, aspect, shadow, quality)
            grazing = math.degrees(math.atan2(altitude, far)) if far > 0 else 90.0
            out.append(((j0 + j1) / 2 * along, far, length, width, height, cast, aspect, grazing, "mine_like" if score >= threshold else "clutter", score))
        return sorted(out, key=lambda c: (-c[-1], c[0], c[1]))

    schema = CONTACT.format(key=dict(images.dtypes)["image"])
    names = [c.split()[0] for c in CONTACT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # All pixels of the batch are one array; an image is a slice of it.
            rows = b.column(1).flatten()
            wide = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            values = rows.flatten().to_numpy(zero_copy_only=False)
            many = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, at = np.r_[0, np.cumsum(many)].tolist(), np.r_[0, np.cumsum(np.maximum(wide, 0))].tolist()
            sizes = [b.column(i).to_pylist() for i in (2, 3, 4)]
            who, out = [], []
            for i, (across, along, altitude) in enumerate(zip(*sizes, strict=True)):
                r, end = row[i], row[i + 1]
                if r < end and wide[r] > 0 and (wide[r:end] == wide[r]).all():
                    got = contacts(values[at[r] : at[end]].reshape(end - r, -1), across, along, altitude)
                    who += [i] * len(got)
                    out += [(place, *c) for place, c in enumerate(got)]
            columns = list(zip(*out, strict=True)) or [[] for _ in names[1:]]
            kinds = [pa.int32(), *[pa.float64()] * 8, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    pixels = F.col("pixels").cast("array<array<double>>").alias("pixels")
    return images.select("image", pixels, "across_m", "along_m", "altitude").mapInArrow(run, schema)


def contact_summary(contacts: DataFrame) -> DataFrame:
    """Contacts of each image, those of each class, and the best score of a mine-like one."""
    mine = F.col("class") == "mine_like"
    return contacts.groupBy("image").agg(F.count("*").alias("contacts"), F.count_if(mine).alias("mine_like"), F.count_if(~mine).alias("clutter"), F.max(F.when(mine, F.col("score"))).alias("top_score"))
