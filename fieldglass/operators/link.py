"""Linking events: spatio-temporal clusters, near-duplicate reports, and their merged incidents.

Pair searches are equi-joins on blocks: a day bucket as wide as the gap and, for clusters, a grid cell as wide as the
radius; each event is filed in its own block and one side also in the neighbouring ones. The exact predicate runs on the
pairs that meet. Components are found by star contraction over tables, so nothing is collected.

Clusters and incidents don't need all pairs: events that are alike in all that the predicate reads are one class, linked by
a star to their first, and only the classes are paired. So a place and day with a third of all events costs its classes."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def _shared(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldglass-core-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Tables:
    """Intermediate tables in the folder all executors share; writing one cuts the lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{_shared(spark)}/events-{uuid.uuid4().hex}", 0
        atexit.register(self._remove)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def measured(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``keep``, with aggregates of the rows that the same job computes as it writes them."""
        seen = Observation()
        return self.keep(df.observe(seen, *[m.alias(n) for n, m in metrics.items()])), seen.get

    def ranked(self, df: DataFrame, *order: Column | str) -> DataFrame:
        """Rows with their place (from 1) in a total order, as column rank. They are dealt by ranges and written, each range
        is numbered by itself, and the sizes of the ranges before are added: no task holds all rows."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.keep(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_range", "_before")
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
        # At most a row for each range.
        return dealt.join(F.broadcast(sizes), "_range").withColumn("rank", (place + F.col("_before")).cast("int")).drop("_range", "_before")

    def _remove(self) -> None:
        try:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            pass


def connected_components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node and component (the smallest node reachable) of edges (a, b) with a < b."""
    tables = tables or Tables(edges.sparkSession)
    edges, before = tables.keep(edges.select("a", "b").distinct()), None
    while True:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = sides.where("b > a").join(low, "a").select("m", "b").distinct()
        least = wide.groupBy("b").agg(F.min("m").alias("_to"))
        narrow = wide.join(least, "b").select(F.col("_to").alias("a"), F.explode(F.array("m", "b")).alias("b")).where("a < b").distinct()
        # A round that changes nothing has left stars: every edge leads to its smallest node.
        edges, now = tables.measured(narrow, n=F.count("*"), rows=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now


def _near_spots(spots: DataFrame, radius_km: float, max_day_gap: int) -> DataFrame:
    """Pairs of spots (date, lat, lon, block, each once) within the radius and the gap of days: da, la, lo, block, db, la2, lo2,
    block2. Each pair is listed once, the earlier first, and a spot with itself. What a block is, is up to the caller.

    Cells are as high as the radius; a cell's width in degrees grows with latitude, so the longitude bands of a row of
    cells are sized by the latitude farthest from the equator in it and its neighbours. Bands wrap at 180 degrees."""
    step = math.degrees(radius_km / X.EARTH_KM) * 1.000001
    pts = spots.select(*_SPOT, "block", F.floor(F.col("lat") / step).cast("int").alias("_row"), F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / (max_day_gap + 1)).cast("int").alias("_day"))
    # Bands around the globe in a row of cells, by the widest degree in reach. Near a pole there is one.
    far = lambda row: F.least(F.lit(90.0), F.greatest(F.abs((row + 2) * step), F.abs((row - 1) * step)))
    half = math.sin(math.radians(step) / 2)
    reach = lambda row: F.when(far(row) >= 90.0 - 1.5 * step, 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(half) / F.cos(F.radians(far(row)))))) * 1.000001)
    bands = lambda row: F.greatest(F.lit(1), F.floor(360.0 / reach(row)).cast("int"))
    band = lambda row: F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / (360.0 / bands(row))).cast("int")
    left = pts.select(F.col("date").alias("da"), F.col("lat").alias("la"), F.col("lon").alias("lo"), "block", F.col("_row").alias("row"), band(F.col("_row")).alias("band"), F.col("_day").alias("day"))
    # The right side is the later one (of one day: the one farther north, or east), so it is filed under its own and the day
    # bucket before.
    near = pts.withColumn("row", F.explode(F.sequence(F.col("_row") - 1, F.col("_row") + 1))).withColumn("day", F.explode(F.array(F.col("_day") - 1, F.col("_day"))))
    near = near.withColumn("_n", bands(F.col("row"))).withColumn("_b", band(F.col("row")))
    near = near.withColumn("band", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(F.col("_b") + k, F.col("_n"))))))
    right = near.select(F.col("date").alias("db"), F.col("lat").alias("la2"), F.col("lon").alias("lo2"), F.col("block").alias("block2"), "row", "band", "day")
    east = (F.col("lo") < F.col("lo2")) | ((F.col("lo") == F.col("lo2")) & (F.col("block") <= F.col("block2")))
    later = F.datediff("db", "da").between(0, max_day_gap) & ((F.col("da") < F.col("db")) | (F.col("la") < F.col("la2")) | ((F.col("la") == F.col("la2")) & east))
    # A pair meets once: its left side stands in one block, and the right side is filed there once.
    return left.join(right, ["row", "band", "day"]).where(later & (X.haversine_km(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")) <= radius_km)).drop("row", "band", "day")


_SPOT = ["date", "lat", "lon"]

#: Events, and characters of their words, that a row with the events of a spot holds at most; a longer text has its own.
BLOCK, BLOCK_CHARS = 512, 1 << 20
#: Words times events from which on two blocks are compared by themselves.
ALONE = 1 << 16


def _met(ev: DataFrame, held: Column, radius_km: float, max_day_gap: int, chars: Column | None = None) -> DataFrame:
    """Located, dated events that are near, a row for two blocks of them: what is held of each side's events, as arrays xs and
    ys, and whether both are one block (itself). A block is a slice of a spot's events; each two meet once.

    Blocks, not events, are joined, so a pair of events costs no more than its turn in two arrays, and a spot with very
    many events is dealt out by its blocks."""
    spark = ev.sparkSession
    pts = ev.where("seq IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND date IS NOT NULL")
    before = Window.partitionBy(*_SPOT).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.floor((F.row_number().over(before) - 1) / BLOCK)
    if chars is not None:
        nth += F.floor(F.sum(chars).over(before) / BLOCK_CHARS)
    blocks = pts.select(*_SPOT, held.alias("held"), nth.alias("_nth")).groupBy(*_SPOT, "_nth").agg(F.collect_list("held").alias("held"))
    blocks = Tables(spark).keep(blocks.select(*_SPOT, "held", F.monotonically_increasing_id().alias("block")))
    near = _near_spots(blocks, radius_km, max_day_gap).select("block", "block2")
    # The bytes of two blocks are no measure of what comes of them: the number of tasks is set, not left to be coalesced.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = near.join(blocks.select("block", F.col("held").alias("xs")), "block").repartition(n, "block2")
    met = met.join(blocks.select(F.col("block").alias("block2"), F.col("held").alias("ys")).repartition(n, "block2"), "block2")
    return met.select("xs", "ys", (F.col("block") == F.col("block2")).alias("itself"))


def near_pairs(ev: DataFrame, radius_km: float = 50.0, max_day_gap: int = 3) -> DataFrame:
    """Pairs a < b of located, dated events within the radius and the gap of days."""
    met = _met(ev.select("seq", *_SPOT), F.col("seq"), radius_km, max_day_gap)
    each = met.select("ys", "itself", F.explode("xs").alias("x")).select("x", "itself", F.explode("ys").alias("y"))
    return each.where("x < y OR x > y AND NOT itself").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), _ends(lists.value_lengths().to_numpy(zero_copy_only=False))


def _shared_words(x: np.ndarray, xi: np.ndarray, nx: int, y: np.ndarray, yi: np.ndarray, ny: int) -> np.ndarray:
    """How many words each two events share: words x (as codes) stand in the events xi, words y in yi, each once an event."""
    codes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    cx, cy = np.bincount(x, minlength=len(codes)), np.bincount(y, minlength=len(codes))
    # Words of many pairs are counted by a product of matrices, of which there are few; those of few pairs are listed.
    often = cx * cy * 8 >= nx * ny
    place, n = np.cumsum(often) - 1, int(often.sum())
    left, right = np.zeros((nx, n), np.float32), np.zeros((ny, n), np.float32)
    kx, ky = often[x], often[y]
    left[xi[kx], place[x[kx]]] = 1
    right[yi[ky], place[y[ky]]] = 1
    shared = (left @ right.T).astype(np.int64)
    x, xi, y, yi = x[~kx], xi[~kx], y[~ky], yi[~ky]
    order = np.argsort(y, kind="stable")
    start = np.searchsorted(y[order], x)
    # Some words at a time, as long texts share many.
    for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(cy[x]) >> 20)) + 1):
        i, nth = _turns(cy[x[some]])
        shared += np.bincount(xi[some][i].astype(np.int64) * ny + yi[order[start[some][i] + nth]], minlength=nx * ny).reshape(nx, ny)
    return shared


def _coded(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Strings of both sides as numbers of one list; -1: null."""
    both = pa.concat_arrays([x, y]).dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: len(x)], codes[len(x) :], both.dictionary


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has."""
    lists = pc.split_pattern(text, " ")
    words, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return words.filter(pc.not_equal(words, "")), np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, n)


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _turns(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. n[i] - 1 for each i in a row, with its i."""
    i = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return i, np.arange(len(i), dtype=np.int32) - (np.cumsum(n) - n).astype(np.int32)[i]


def _compare(threshold: float, same_kind: bool):
    """Pairs of blocks to pairs of events whose words are alike or, if same_kind, that share a specific type; without
    same_kind, the latter are left out. Small blocks are compared many at once, large ones one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, ex), (ys, ey) = _flat(batch.column(0)), _flat(batch.column(1))
            (sx, kx, tx), (sy, ky, ty) = ([e.field(c) for c in ("seq", "kind", "words")] for e in (xs, ys))
            itself, seq = batch.column(2).to_numpy(zero_copy_only=False), sx.type
            sx, sy = sx.to_numpy(zero_copy_only=False), sy.to_numpy(zero_copy_only=False)
            kx, ky, kinds = _coded(kx, ky)
            other = pc.index(kinds, "other").as_py()
            kx = np.where((kx == other) | (kx < 0), -2, kx)
            (wx, lx), (wy, ly) = _words(tx), _words(ty)
            wx, wy, words = _coded(wx, wy)
            ux, uy, nx, ny = _ends(lx), _ends(ly), np.diff(ex), np.diff(ey)
            (rx, ix), (ry, iy) = _turns(nx), _turns(ny)
            vx, vy = np.repeat(np.arange(len(lx)), lx), np.repeat(np.arange(len(ly)), ly)  # events of words
            # Words by the row they stand in.
            ax, ay = (r[v].astype(np.int64) * len(words) + w for r, v, w in ((rx, vx, wx), (ry, vy, wy)))
            order = np.argsort(ay, kind="stable")
            ay = ay[order]
            cost = np.maximum(nx, np.diff(ux[ex])) * ny
            row = 0
            while row < batch.num_rows:
                # Rows that together list no more than a bound, or a costly one by itself.
                few = int(np.argmax(cost[row : row + 4096] > ALONE)) or len(cost[row : row + 4096])
                few = 1 if cost[row] > ALONE else min(few, int(np.searchsorted(np.cumsum(cost[row : row + few]), 1 << 20, "right")))
                rows = np.arange(row, row + few)
                row = int(rows[-1]) + 1
                cells = nx[rows] * ny[rows]
                base = np.cumsum(cells) - cells
                if len(rows) == 1 and cost[rows[0]] > ALONE:
                    x, y = slice(ux[ex[rows[0]]], ux[ex[row]]), slice(uy[ey[rows[0]]], uy[ey[row]])
                    both = _shared_words(wx[x], ix[vx[x]], nx[rows[0]], wy[y], iy[vy[y]], ny[rows[0]]).ravel()
                else:
                    x = slice(ux[ex[rows[0]]], ux[ex[row]])
                    start = np.searchsorted(ay, ax[x])
                    i, nth = _turns(np.searchsorted(ay, ax[x], "right") - start)
                    e, f = vx[x][i], vy[order[start[i] + nth]]
                    both = np.bincount(base[rx[e] - rows[0]] + ix[e] * ny[rx[e]] + iy[f], minlength=cells.sum())
                i, nth = _turns(cells)
                i += rows[0]
                e, f = np.divmod(nth, ny[i].astype(np.int32))
                e, f = e + ex[i], f + ey[i]
                union = lx[e] + ly[f] - both
                alike = np.divide(both, union, out=np.zeros(len(both)), where=union > 0) >= threshold
                same = kx[e] == ky[f]
                alike = alike | same if same_kind else alike & ~same
                a, b, i = sx[e[alike]], sy[f[alike]], i[alike]
                kept = (a < b) | (a > b) & ~itself[i]
                a, b = a[kept], b[kept]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), seq), pa.array(np.maximum(a, b), seq)], names=["a", "b"])

    return run


def _alike_pairs(ev: DataFrame, max_day_gap: int, radius_km: float, threshold: float, same_kind: bool = True) -> DataFrame:
    """Pairs a < b of near events with alike words or, if same_kind, one specific type; without it, the others of them."""
    words, kind = F.array_join("_tok", " "), ev.schema["seq"].dataType.simpleString()
    event = F.struct("seq", F.col("event_type").alias("kind"), words.alias("words"))
    return _met(ev, event, radius_km, max_day_gap, F.length(words)).mapInArrow(_compare(threshold, same_kind), f"a {kind}, b {kind}")


def _pair() -> list[Column]:
    return [F.least("x.seq", "y.seq").alias("a"), F.greatest("x.seq", "y.seq").alias("b")]


def near_links(ev: DataFrame, radius_km: float = 50.0, max_day_gap: int = 3) -> DataFrame:
    """Edges a < b that join the same events as ``near_pairs`` does, without all pairs: the spots' first events are paired,
    and a star joins each to the others of its spot."""
    spots, star = _classes(ev.where("lat IS NOT NULL AND lon IS NOT NULL AND date IS NOT NULL").select("seq", *_SPOT), _SPOT)
    near = _near_spots(spots.withColumn("block", F.col("seq")), radius_km, max_day_gap).where("block <> block2")
    return near.select(F.least("block", "block2").alias("a"), F.greatest("block", "block2").alias("b")).unionByName(star.select("a", "b"))


def _classes(ev: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of events alike in the keys the first (its seq and the keys), and a star of edges a < b from it to the others."""
    least = ev.groupBy(*keys).agg(F.min("seq").alias("_first"))
    one = least.select(F.col("_first").alias("seq"), *keys)
    match = reduce(lambda x, y: x & y, [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    star = ev.alias("e").join(least.alias("c"), match).where("e.seq <> c._first").select(F.col("c._first").alias("a"), F.col("e.seq").alias("b"), *[F.col(f"e.{k}") for k in keys])
    return one, star


def clusters(ev: DataFrame, radius_km: float = 50.0, max_day_gap: int = 3, min_size: int = 3) -> DataFrame:
    """Single-link clusters of at least min_size events, the largest first: size, magnitude, span, centre, radius, and up to
    six actors. Rows that repeat a seq are one event."""
    tables = Tables(ev.sparkSession)
    ev = ev.dropDuplicates(["seq"])
    member = connected_components(near_links(ev, radius_km, max_day_gap), tables)
    roots = member.select("component").distinct().select(F.col("component").alias("node"), "component")
    got = ev.join(member.unionByName(roots), F.col("seq") == F.col("node"))
    base = got.groupBy("component").agg(F.count("*").alias("size"), F.sum("magnitude").cast("long").alias("magnitude"), F.min("date").alias("start"), F.max("date").alias("end"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon")).where(F.col("size") >= min_size)
    away = got.join(base.select("component", "center_lat", "center_lon"), "component").groupBy("component").agg(F.max(X.haversine_km(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon"))).alias("radius_km"))
    actors = got.select("component", F.explode(F.filter(F.array("actor1", "actor2"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")).alias("actor")).groupBy("component", "actor").agg(F.count("*").alias("n"))
    top = actors.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "actor"))).where("_r <= 6").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "actor"))), lambda x: x["actor"]), ",").alias("top_actors"))
    return base.withColumn("span_days", F.datediff("end", "start") + 1).join(away, "component").join(top, "component", "left").orderBy(F.desc("size"), F.desc("magnitude"), "component")


_ALIKE_BY = ["date", "event_type", "country", "region", "location", "lat", "lon", "_tok"]


def _dated(ev: DataFrame) -> DataFrame:
    return ev.where("date IS NOT NULL").withColumn("_tok", X.event_tokens()).select("seq", *_ALIKE_BY)


def _alike(threshold: float) -> Column:
    return (X.jaccard(F.col("x._tok"), F.col("y._tok")) >= threshold) | ((F.col("x.event_type") == F.col("y.event_type")) & (F.col("x.event_type") != "other"))


def _unlocated_matches(dated: DataFrame, max_day_gap: int, radius_km: float, threshold: float) -> DataFrame:
    """Pairs a < b of dated events that tell of one incident, where one or both lack coordinates."""
    # Where one of two events lacks coordinates, their countries are equal, or one is blank and the places' names tell.
    day = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / (max_day_gap + 1)).cast("int")
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keyed = dated.withColumns({"_day": day, "_c": lower("country"), "_p": F.coalesce(X.missing(lower("location")), lower("region")), "_lacks": F.col("lat").isNull() | F.col("lon").isNull()})
    around = lambda df: df.withColumn("_day", F.explode(F.sequence(F.col("_day") - 1, F.col("_day") + 1)))
    cond = (F.col("x.seq") != F.col("y.seq")) & (F.abs(F.datediff("x.date", "y.date")) <= max_day_gap) & X.same_place("x", "y", radius_km) & _alike(threshold)
    pair = lambda df: df.select(*_pair())
    lacking = around(keyed.where("_lacks"))
    same = pair(lacking.alias("x").join(keyed.alias("y"), ["_day", "_c"]).where(cond))
    # A place's name holds another's only if it holds its first letters: the shorter stands under those, the longer under all.
    grams = F.when(F.length("_p") > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_p")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.col("_p"), i, n))))))
    long, short = keyed.withColumn("_g", F.explode(grams)), keyed.where("_p <> ''").withColumn("_g", F.substring("_p", 1, 3))
    one_blank = (F.col("x._c") == "") != (F.col("y._c") == "")
    lacks = F.col("x._lacks") | F.col("y._lacks")
    blank = pair(around(long).alias("x").join(short.alias("y"), ["_day", "_g"]).where(one_blank & lacks & cond))
    return same.unionByName(blank)


def duplicate_pairs(ev: DataFrame, max_day_gap: int = 1, radius_km: float = 15.0, threshold: float = 0.5) -> DataFrame:
    """Pairs a < b of reports of one incident: close days, alike places, and alike words or the same specific type.

    Two events match by distance alone where both are located, so located pairs are blocked by grid cell and day, and pairs
    that lack coordinates by country and day, or by day and letters of the place's name."""
    dated = _dated(ev)
    pairs = _alike_pairs(dated, max_day_gap, radius_km, threshold)
    # Near events meet once, so their pairs are distinct unless rows repeat a seq.
    if not dated.groupBy("seq").count().where("count > 1").isEmpty():
        pairs = pairs.distinct()
    if not dated.where("lat IS NULL OR lon IS NULL").isEmpty():
        lacking = _unlocated_matches(dated, max_day_gap, radius_km, threshold)
        pairs = pairs.unionByName(lacking).distinct()
    return pairs


def duplicate_links(ev: DataFrame, max_day_gap: int = 1, radius_km: float = 15.0, threshold: float = 0.5) -> DataFrame:
    """Edges a < b that join the same events as ``duplicate_pairs`` does, without all pairs.

    Events of one spot and specific type all match, and so do those of near spots: their classes are paired by the spots.
    Only alike words of other types are left to find among events."""
    dated = _dated(ev)
    located = dated.where("lat IS NOT NULL AND lon IS NOT NULL")
    first, star = _classes(located.where("event_type <> 'other'").select("seq", *_SPOT, "event_type"), [*_SPOT, "event_type"])
    typed = _near_spots(first.select(*_SPOT, F.struct("seq", "event_type").alias("block")), radius_km, max_day_gap).where("block.event_type = block2.event_type AND block.seq <> block2.seq")
    links = [star, typed.select(F.least("block.seq", "block2.seq").alias("a"), F.greatest("block.seq", "block2.seq").alias("b"))]
    # Texts alike in all that is read are one class; without words they match only at a threshold of 0.
    words, texts = _classes(located.select("seq", *_SPOT, "event_type", "_tok"), [*_SPOT, "event_type", "_tok"])
    itself = (F.size("_tok") > 0) & F.lit(threshold <= 1.0) | F.lit(threshold <= 0.0)
    links += [texts.where(itself & F.coalesce(F.col("event_type") == "other", F.lit(True))), _alike_pairs(words, max_day_gap, radius_km, threshold, same_kind=False)]
    if not dated.where("lat IS NULL OR lon IS NULL").isEmpty():
        one, alike = _classes(dated, _ALIKE_BY)
        # Events of a class match each other if an event would match itself. Those with coordinates are linked above.
        named = F.concat_ws("", F.trim("country"), F.trim("location"), F.trim("region")) != ""
        links += [alike.where((F.col("lat").isNull() | F.col("lon").isNull()) & named & (itself | (F.col("event_type") != "other"))), _unlocated_matches(one, max_day_gap, radius_km, threshold)]
    return reduce(DataFrame.unionByName, [x.select("a", "b") for x in links])


def incident_groups(ev: DataFrame, **options) -> DataFrame:
    """seq and incident (the smallest seq of its group); events without a duplicate are groups of one. Rows that repeat a seq
    are one report."""
    ev = ev.dropDuplicates(["seq"])
    member = connected_components(duplicate_links(ev, **options))
    return ev.select("seq").join(member, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("component", "seq").alias("incident"))


def merge(ev: DataFrame, **options) -> DataFrame:
    """One row for each incident: earliest date, largest magnitude, longest texts, the commonest type, sources joined, the
    first link, and all tags with merged:<reports> and, of several reports, src:<id> of each. Rows that repeat a seq are
    one report."""
    ev = ev.dropDuplicates(["seq"])
    got = ev.join(incident_groups(ev, **options), "seq")
    longest = lambda c: F.max_by(F.coalesce(c, F.lit("")), F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq"))).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    kinds = got.groupBy("incident", "event_type").agg(F.count("*").alias("n"), F.min("seq").alias("_f"))
    kind = kinds.groupBy("incident").agg(F.max_by("event_type", F.struct("n", -F.col("_f"))).alias("_top"), F.max_by("event_type", F.when(F.col("event_type") != "other", F.struct("n", -F.col("_f")))).alias("_special"))
    none = F.array().cast("array<string>")
    more = [F.min(F.when(F.col("source_url") != "", F.col("source_url"))).alias("source_url")] if "source_url" in ev.columns else []
    if "tags" in ev.columns:
        ids = F.array_compact(F.collect_set(F.concat(F.lit("src:"), F.col("id").cast("string")))) if "id" in ev.columns else none
        tags = F.concat(F.flatten(F.collect_set(F.coalesce("tags", none))), F.array(F.concat(F.lit("merged:"), F.count("*"))), F.when(F.count("*") > 1, ids).otherwise(none))
        more.append(F.sort_array(F.array_distinct(tags)).alias("tags"))
    folded = got.groupBy("incident").agg(
        F.count("*").alias("reports"), F.min("date").alias("date"), F.max("magnitude").alias("magnitude"), *[longest(c) for c in ("actor1", "actor2", "country", "region", "location", "notes")], first("lat"), first("lon"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("source") != "", F.col("source")))), " | ").alias("source"), *more,
    )
    if more and "source_url" in ev.columns:
        folded = folded.withColumn("source_url", F.coalesce("source_url", F.lit("")))
    return folded.join(kind, "incident").withColumn("event_type", F.when((F.col("_top") == "other") & F.col("_special").isNotNull(), F.col("_special")).otherwise(F.col("_top"))).drop("_top", "_special")


def merge_report(merged: DataFrame) -> DataFrame:
    """Reports in, incidents out, and how many were merged."""
    return merged.agg(F.sum("reports").alias("reports"), F.count("*").alias("incidents"), F.count_if(F.col("reports") > 1).alias("merged"), F.max("reports").alias("largest"))
