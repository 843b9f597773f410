"""Pairwise similarity from signals that may each be absent, pairs within blocks, clusters, nearest rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlight.config import Similarity
from strandlight.functions.scalar import EARTH_RADIUS_M, dot, haversine_m
from strandlight.operators.graph import components, numbered
from strandlight.operators.telemetry import around


def clipped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of the 64 bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def histogram_similarity(a: Column, b: Column) -> Column:
    """1 less half the chi-squared distance; 0 for different sizes."""
    distance = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, F.pow(x - y, 2) / F.when(x + y > 0, x + y)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(clipped(1 - 0.5 * distance))


def visual(hash_a: Column, hash_b: Column, hist_a: Column, hist_b: Column, hash_share: float) -> Column:
    return hash_share * hash_similarity(hash_a, hash_b) + (1 - hash_share) * histogram_similarity(hist_a, hist_b)


def semantic(a: Column, b: Column, floor: float) -> Column:
    """The dot product of unit vectors, stretched from ``floor`` to 1."""
    d = dot(a, b)
    return clipped(d) if floor >= 1 else clipped((d - floor) / (1 - floor))


def spatial(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float) -> Column:
    distance = haversine_m(lat1, lon1, lat2, lon2)
    return F.when(distance.isNotNull(), clipped(1 - distance / radius_m) if radius_m > 0 else F.lit(0.0))


def temporal(t1: Column, t2: Column, radius_s: float) -> Column:
    """From times in seconds."""
    return F.when(t1.isNotNull() & t2.isNotNull(), clipped(1 - F.abs(t1 - t2) / radius_s) if radius_s > 0 else F.lit(0.0))


def motion(a: Column, b: Column) -> Column:
    """(correlation + 1) / 2 of two series brought to the shorter length; two flat ones 1, one flat 0, shorter than two points null."""
    from strandlight.operators.series import resample

    n = F.least(F.size(a), F.size(b))
    x, y = resample(a, n), resample(b, n)
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v)
    mx, my = total(x) / n, total(y) / n
    dx, dy = F.transform(x, lambda v: v - mx), F.transform(y, lambda v: v - my)
    sx, sy = dot(dx, dx), dot(dy, dy)
    flat_x, flat_y = sx <= 1e-24, sy <= 1e-24
    r = F.try_divide(dot(dx, dy), F.sqrt(sx * sy))
    return F.when(a.isNull() | b.isNull() | (n < 2), F.lit(None)).when(flat_x & flat_y, F.lit(1.0)).when(flat_x | flat_y, F.lit(0.0)).otherwise(clipped((F.coalesce(r, F.lit(-1.0)) + 1) / 2))


def combined(signals: dict[str, Column], config: Similarity, faces_a: Column | None = None, faces_b: Column | None = None) -> Column:
    """Weighted mean of the signals that a pair has.  Semantic, where present, takes visual's place; different face counts give 0."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    has_semantic = signals["semantic"].isNotNull() if "semantic" in signals and config.semantic > 0 else F.lit(False)
    for name, value in signals.items():
        weight = getattr(config, name)
        if weight <= 0:
            continue
        use = value.isNotNull() & (~has_semantic if name == "visual" else F.lit(True))
        top, bottom = top + F.when(use, value * weight).otherwise(0.0), bottom + F.when(use, F.lit(weight)).otherwise(0.0)
    score = F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(F.lit(0.0))
    if config.face_guard and faces_a is not None:
        score = F.when(faces_a.isNotNull() & faces_b.isNotNull() & (faces_a != faces_b), F.lit(0.0)).otherwise(score)
    return score


class Side:
    """The signals of a table's rows (``vector`` and, if there, lat, lon, time_s, faces) as arrays, with what is there of each.

    A vector that is null or holds nulls isn't there; vectors of different lengths have no product.
    """

    NUMBERS = ("lat", "lon", "time_s", "faces")

    def __init__(self, rows: pa.Table):
        listed = rows.column("vector").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        flat = listed.flatten()
        values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)
        self.width = sizes.copy()
        self.vectors = np.zeros((len(rows), int(sizes.max(initial=0))))
        owner = np.repeat(np.arange(len(rows)), sizes)
        self.vectors[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        self.width[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        self.width[listed.is_null().to_numpy(zero_copy_only=False)] = -1
        self.vectors[self.width < 0] = 0.0
        self.has, self.value = {}, {}
        for name in self.NUMBERS:
            column = rows.column(name).combine_chunks().cast(pa.float64()) if name in rows.column_names else pa.nulls(len(rows), pa.float64())
            self.has[name] = column.is_valid().to_numpy(zero_copy_only=False)
            self.value[name] = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)

    def part(self, at: slice) -> Side:
        """The rows of a slice."""
        own = object.__new__(Side)
        own.width, own.vectors = self.width[at], self.vectors[at]
        own.has, own.value = ({k: v[at] for k, v in d.items()} for d in (self.has, self.value))
        return own


def clipped_array(x: np.ndarray) -> np.ndarray:
    """As ``clipped``: a value that is no number counts as the largest."""
    return np.fmin(np.maximum(x, 0.0), 1.0)


def in_order(row: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of one vector with all, summed in order as ``dot`` does, so that equal vectors have equal products."""
    total = np.zeros(len(vectors))
    for k in range(min(len(row), vectors.shape[1])):
        total += row[k] * vectors[:, k]
    return total


def semantic_near(rows: pa.Table):
    """For ``selection.select_near``: a row's dot products with all, held to [0, 1], from the column ``vector``."""
    side = Side(rows)

    def near(k: int) -> np.ndarray:
        both = (side.width == side.width[k]) & (side.width[k] >= 0)
        return np.where(both, clipped_array(in_order(side.vectors[k], side.vectors)), 0.0)

    return near


def haversine_array(lat1, lon1, lat2, lon2):
    """As ``haversine_m``."""
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.fmin(h, 1.0)))


def combined_array(x: Side, y: Side, dots: np.ndarray, config: Similarity, visual: float | None = None) -> np.ndarray:
    """``combined`` of the rows of ``x`` with those of ``y``, from their vectors' dot products; ``visual`` is the same for all pairs or absent."""
    top, bottom = np.zeros(dots.shape), np.zeros(dots.shape)

    def add(value, weight: float, use: np.ndarray) -> None:
        np.add(top, np.where(use, value * weight, 0.0), out=top)
        np.add(bottom, np.where(use, weight, 0.0), out=bottom)

    def both(name: str) -> np.ndarray:
        return x.has[name][:, None] & y.has[name][None, :]

    def of(name: str) -> tuple[np.ndarray, np.ndarray]:
        return x.value[name][:, None], y.value[name][None, :]

    semantic_there = (x.width[:, None] == y.width[None, :]) & (x.width >= 0)[:, None] & (config.semantic > 0)
    if visual is not None and config.visual > 0:
        add(visual, config.visual, ~semantic_there)
    if config.semantic > 0:
        floor = config.semantic_floor
        add(clipped_array(dots if floor >= 1 else (dots - floor) / (1 - floor)), config.semantic, semantic_there)
    if config.spatial > 0:
        (lat1, lat2), (lon1, lon2) = of("lat"), of("lon")
        add(clipped_array(1 - haversine_array(lat1, lon1, lat2, lon2) / config.radius_m) if config.radius_m > 0 else 0.0, config.spatial, both("lat") & both("lon"))
    if config.temporal > 0:
        t1, t2 = of("time_s")
        add(clipped_array(1 - np.abs(t1 - t2) / config.radius_s) if config.radius_s > 0 else 0.0, config.temporal, both("time_s"))
    score = np.divide(top, bottom, out=np.zeros(dots.shape), where=bottom > 0)
    if config.face_guard:
        f1, f2 = of("faces")
        score[both("faces") & (f1 != f2)] = 0.0
    return score


def combined_near(config: Similarity):
    """For ``selection.select_near``: a row's ``combined`` similarity to all, from the columns vector, lat, lon, time_s and faces."""

    def similar(rows: pa.Table):
        side = Side(rows)
        return lambda k: combined_array(side.part(slice(k, k + 1)), side, in_order(side.vectors[k], side.vectors)[None, :], config)[0]

    return similar


def combined_pairs(rows: DataFrame, by: str, ident: str, config: Similarity, least: float, visual: float | None = None) -> DataFrame:
    """(by, a, b, sim) of the pairs a < b of a block whose ``combined`` similarity is ``least`` or more; rows have vector, lat, lon, time_s and faces."""

    def score(x: Side, y: Side) -> np.ndarray:
        width = min(x.vectors.shape[1], y.vectors.shape[1])
        return combined_array(x, y, x.vectors[:, :width] @ y.vectors[:, :width].T, config, visual)

    return tile_pairs(rows.select(by, ident, "vector", "lat", "lon", "time_s", "faces"), by, ident, Side, score, least)


class Series:
    """Arrays of numbers, grouped by length, for ``motion_array``; one that is null or holds nulls isn't there."""

    def __init__(self, listed: list):
        self.listed = listed

    def part(self, at: slice) -> Series:
        return Series(self.listed[at])

    @classmethod
    def of(cls, rows: pa.Table) -> Series:
        return cls([None if v is None or None in v else np.array(v, dtype=float) for v in rows.column("series").to_pylist()])

    def by_length(self) -> dict[int, np.ndarray]:
        """Places of the arrays of each length of two or more."""
        lengths = np.array([-1 if v is None else len(v) for v in self.listed])
        return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n >= 2}

    def centred(self, places: np.ndarray, n: int) -> np.ndarray:
        """Those arrays, all of one length, at ``n`` points, less their means."""
        v = np.stack([self.listed[k] for k in places])
        at = np.arange(n) * (v.shape[1] - 1) / (n - 1)
        low = np.floor(at).astype(int)
        here = v[:, low]
        own = here + (v[:, np.minimum(low + 1, v.shape[1] - 1)] - here) * (at - low)
        return own - (reduce(np.add, own.T, np.zeros(len(own))) / n)[:, None]


def motion_array(x: Series, y: Series) -> np.ndarray:
    """``motion`` of the arrays of ``x`` with those of ``y``; 0 where there is none."""
    out = np.zeros((len(x.listed), len(y.listed)))
    for p, rows in x.by_length().items():
        for q, columns in y.by_length().items():
            n = min(p, q)
            dx, dy = x.centred(rows, n), y.centred(columns, n)
            sx, sy = (reduce(np.add, (d * d).T, np.zeros(len(d))) for d in (dx, dy))
            both = np.sqrt(sx[:, None] * sy[None, :])
            r = np.divide(dx @ dy.T, both, out=np.full(both.shape, -1.0), where=both != 0)
            flat_x, flat_y = (sx <= 1e-24)[:, None], (sy <= 1e-24)[None, :]
            out[np.ix_(rows, columns)] = np.where(flat_x & flat_y, 1.0, np.where(flat_x | flat_y, 0.0, clipped_array((r + 1) / 2)))
    return out


def motion_pairs(rows: DataFrame, by: str, ident: str, series: str, least: float) -> DataFrame:
    """(by, a, b, sim) of the pairs a < b of a block whose ``motion`` similarity, ``least`` > 0 or more, comes from arrays."""
    return tile_pairs(rows.select(by, ident, F.col(series).alias("series")), by, ident, Series.of, motion_array, least)


TILE = 1024
WIDE_TILE, STRIP = 2048, 64  # rows of a tile, and of the part of it whose matrix is held at once, where pairs take more than a product


def pairs_within(df: DataFrame, block: list[str], ident: str, tile: int = TILE) -> DataFrame:
    """Pairs a < b that share a block, as ``a_*`` and ``b_*`` columns: an equi-join on the block.

    Where a block has more than ``tile`` rows, blocks are cut into tiles, and each pair of tiles is joined on its own.
    """
    on = F.col(f"a_{ident}") < F.col(f"b_{ident}")
    for c in block:
        on &= F.col(f"a_{c}") == F.col(f"b_{c}")
    left, right = ([F.col(c).alias(f"{side}_{c}") for c in df.columns] for side in "ab")
    sizes = df.groupBy(*block).count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= tile:
        return df.select(*left).join(df.select(*right), on)
    tiles = sizes.select(*block, F.ceil(F.col("count") / tile).cast("int").alias("_k"))
    dealt = df.join(tiles, block).withColumn("_t", F.pmod(F.xxhash64(ident), F.col("_k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_k") - 1)
    a = dealt.select(*left, F.col("_t").alias("_ai"), F.explode(every).alias("_aj"))
    b = dealt.select(*right, F.explode(every).alias("_bi"), F.col("_t").alias("_bj"))
    return a.join(b, on & (F.col("_ai") == F.col("_bi")) & (F.col("_aj") == F.col("_bj"))).drop("_ai", "_aj", "_bi", "_bj")


def dot_pairs(vectors: DataFrame, by: str, ident: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """(by, a, b, sim) of the pairs a < b of a block whose vectors' dot product, held to [0, 1], is ``least`` or more.

    Blocks are cut into tiles of about ``tile`` rows; a pair of tiles is multiplied as matrices in one task, so a block of any size is
    spread, and only pairs at the threshold leave it.  Vectors that are null, hold nulls or differ in length from their partners make no pair.
    """
    kinds = {k: vectors.schema[k].dataType for k in (by, ident)}
    own = vectors.select(by, F.col(ident).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.size(vector).alias("_w")).where(F.col(ident).isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
    counts = own.groupBy(by, "_w").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_k"))
    dealt = own.join(counts, [by, "_w"]).withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_k")).cast("int"))
    left = dealt.select(by, "_w", "_id", "_v", F.col("_t").alias("_i"), F.explode(F.sequence(F.col("_t"), F.col("_k") - 1)).alias("_j"))
    right = dealt.select(by, "_w", "_id", "_v", F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_i"), F.col("_t").alias("_j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    block = [by, "_w", "_i", "_j"]
    schema = StructType([StructField(by, kinds[by]), StructField("a", kinds[ident]), StructField("b", kinds[ident]), StructField("sim", DoubleType())])

    def multiply(these: pa.Table, those: pa.Table) -> pa.Table:
        names = [by, "a", "b", "sim"]
        if not len(these) or not len(those):
            return pa.table([pa.array([], t) for t in (these.schema.field(by).type, these.schema.field("_id").type, these.schema.field("_id").type, pa.float64())], names=names)
        width = these.column("_w")[0].as_py()
        x, y = (t.column("_v").combine_chunks().flatten().to_numpy().reshape(-1, width) for t in (these, those))
        sims = np.clip(x @ y.T, 0.0, 1.0)
        hit = sims >= least
        if these.column("_i")[0].as_py() == these.column("_j")[0].as_py():
            ids = these.column("_id").to_pylist()
            rank = np.argsort(np.argsort(np.array(ids, dtype=object if isinstance(ids[0], str) else None), kind="stable"), kind="stable")
            place = dict(zip(ids, rank.tolist()))
            other = np.array([place[i] for i in those.column("_id").to_pylist()])
            hit &= rank[:, None] < other[None, :]
        r, c = np.nonzero(hit)
        one, two = these.column("_id").take(pa.array(r)), those.column("_id").take(pa.array(c))
        swap = pc.greater(one, two)
        return pa.table([pa.array([these.column(by)[0].as_py()] * len(r), these.schema.field(by).type), pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(sims[r, c])], names=names)

    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(multiply, schema)


def tile_pairs(rows: DataFrame, by: str, ident: str, load: Callable, score: Callable, least: float, tile: int = WIDE_TILE, strip: int = STRIP) -> DataFrame:
    """(by, a, b, sim) of the pairs a < b of a block that ``score`` gives ``least`` or more.

    As in ``dot_pairs``, blocks are cut into tiles and each pair of tiles is scored in one task.  ``load`` makes an object with ``part(slice)``
    from a tile's rows; ``score`` makes a matrix from two of them, of which only ``strip`` rows at a time are held.
    """
    own = rows.where(F.col(ident).isNotNull() & F.col(by).isNotNull())
    counts = own.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_k"))
    dealt = own.join(counts, by).withColumn("_t", F.pmod(F.xxhash64(ident), F.col("_k")).cast("int"))
    left = dealt.select(*rows.columns, F.col("_t").alias("_i"), F.explode(F.sequence(F.col("_t"), F.col("_k") - 1)).alias("_j"))
    right = dealt.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_i"), F.col("_t").alias("_j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    kind, key = rows.schema[ident].dataType, rows.schema[by].dataType
    schema = StructType([StructField(by, key), StructField("a", kind), StructField("b", kind), StructField("sim", DoubleType())])

    def compare(these: pa.Table, those: pa.Table) -> pa.Table:
        ones, twos = these.column(ident).combine_chunks(), those.column(ident).combine_chunks()
        out = []
        if len(ones) and len(twos):
            x, y = load(these), load(those)
            alone = these.column("_i")[0].as_py() == these.column("_j")[0].as_py()
            # places in the order of both sides' ids: equal ids have one place
            order = pa.chunked_array([ones, twos]).combine_chunks().dictionary_encode()
            rank = np.argsort(pc.array_sort_indices(order.dictionary).to_numpy())[order.indices.to_numpy()]
            first, second = rank[: len(ones)], rank[len(ones) :]
            for at in range(0, len(ones), strip):
                own = slice(at, at + strip)
                sims = score(x.part(own), y)
                hit = sims >= least
                hit &= first[own, None] < second[None, :] if alone else first[own, None] != second[None, :]
                r, c = np.nonzero(hit)
                swap = first[own][r] > second[c]
                one, two = ones.take(pa.array(r + at)), twos.take(pa.array(c))
                out.append(pa.table([pc.if_else(pa.array(swap), two, one), pc.if_else(pa.array(swap), one, two), pa.array(sims[r, c])], names=["a", "b", "sim"]))
        found = pa.concat_tables(out) if out else pa.table([ones.slice(0, 0), ones.slice(0, 0), pa.array([], pa.float64())], names=["a", "b", "sim"])
        label = these.column(by)[0].as_py() if len(found) else None
        return found.add_column(0, by, pa.array([label] * len(found), these.schema.field(by).type))

    block = [by, "_i", "_j"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(compare, schema)


def single_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float, ident: str = "id") -> DataFrame:
    """``nodes(id)`` with cluster_id: components of the pairs (a, b, sim) at or over the threshold, numbered by first id."""
    linked = pairs.where(F.col("sim") >= threshold).select("a", "b")
    return numbered(components(nodes.select(ident), linked, ident), ident, "cluster_id")


def spots(points: DataFrame, ident: str = "id", by: str | None = None) -> DataFrame:
    """(ident, lat, lon, _by, spot) of the points that have a position: points at one position (and alike in ``by``) have one spot, the smallest id of them."""
    placed = points.where("lat is not null and lon is not null").select(F.col(ident), "lat", "lon", (F.lit(0) if by is None else F.col(by)).alias("_by")).distinct()
    # a position that is no number is at no distance to itself
    alone = F.when(F.isnan(haversine_m(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon"))) | F.isnan("lat") | F.isnan("lon"), F.col(ident))
    placed = placed.withColumn("_alone", alone)
    first = placed.groupBy("lat", "lon", "_by", "_alone").agg(F.min(ident).alias("spot"))
    first = first.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("_by").alias("_b"), F.col("_alone").alias("_a"), "spot")
    return placed.join(first, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")) & F.col("_by").eqNullSafe(F.col("_b")) & F.col("_alone").eqNullSafe(F.col("_a"))).select(ident, "lat", "lon", "_by", "spot")


def within_radius(points: DataFrame, radius_m: float, ident: str = "id", by: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, metres) of points at most ``radius_m`` apart (and, if given, alike in ``by``), metres rounded to ``digits`` places if given.

    Positions are compared once each, however many points have them; the links of positions are then joined with their points.
    """
    own = spots(points, ident, by)
    own = own.withColumn("_self", haversine_m(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon")))
    links = spot_links(own, radius_m)
    # points of one position
    same = own.where(F.col("_self") <= radius_m).groupBy("spot").agg(F.count(F.lit(1)).alias("n"), F.min("_self").alias("metres")).where("n > 1")
    links = links.unionByName(same.select(F.col("spot").alias("p"), F.col("spot").alias("q"), "metres"))
    if digits is not None:
        links = links.withColumn("metres", F.round("metres", digits))
    one = own.select(F.col("spot").alias("p"), F.col(ident).alias("_one"))
    two = own.select(F.col("spot").alias("q"), F.col(ident).alias("_two"))
    met = links.join(one, "p").join(two, "q").where(F.when(F.col("p") == F.col("q"), F.col("_one") < F.col("_two")).otherwise(F.col("_one") != F.col("_two")))
    return met.select(F.least("_one", "_two").alias("a"), F.greatest("_one", "_two").alias("b"), "metres")


def spot_links(own: DataFrame, radius_m: float) -> DataFrame:
    """(p, q, metres) of different spots of ``spots`` at most ``radius_m`` apart: they meet in grid cells of that size, then are measured.

    Rows of cells are a radius high, and cells wide enough for their latitude; each spot is looked up in
    its own cell and the eight around it, so no pair of spots that are far apart is made.
    """
    points = own.select("spot", "lat", "lon", "_by").where("not isnan(lat) and not isnan(lon)").dropDuplicates(["spot"])
    degrees = radius_m / EARTH_RADIUS_M * 180 / 3.141592653589793
    row = F.floor(F.col("lat") / degrees).cast("long")
    placed = points.select(F.col("spot"), "lat", "lon", row.alias("row"), "_by")

    def cell(lon: Column, r: Column) -> Column:
        edge = F.least(F.greatest(F.abs(r * degrees), F.abs((r + 1) * degrees)) + degrees, F.lit(89.9))
        wide = degrees / F.cos(F.radians(edge))
        return F.floor((lon + 180) / wide).cast("long"), F.floor(F.lit(360.0) / wide).cast("long")

    home, _ = cell(F.col("lon"), F.col("row"))
    right = placed.select(F.col("spot").alias("q"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("row").alias("r"), home.alias("c"), "_by")
    near = placed.select(F.col("spot").alias("p"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.array(*[F.col("row") + d for d in (-1, 0, 1)])).alias("r"), "_by")
    own, last = cell(F.col("lon_a"), F.col("r"))
    # the grid joins at 180 degrees: the cells past either end are those of the other
    around = F.array(*[own + d for d in (-1, 0, 1)])
    around = F.array_distinct(F.concat(around, F.transform(F.filter(around, lambda c: c <= 0), lambda c: c + last), F.transform(F.filter(around, lambda c: c <= 0), lambda c: c + last + 1), F.transform(F.filter(around, lambda c: c >= last - 1), lambda c: c - last), F.transform(F.filter(around, lambda c: c >= last - 1), lambda c: c - last - 1)))
    left = near.select("p", "lat_a", "lon_a", "r", "_by", F.explode(around).alias("c"))
    metres = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return left.join(right, ["r", "c", "_by"]).where("p < q").withColumn("metres", metres).where(F.col("metres") <= radius_m).select("p", "q", "metres").distinct()



def radius_components(points: DataFrame, radius_m: float, ident: str = "id", by: str | None = None) -> DataFrame:
    """(ident, root) of the points that have a position: single linkage by distance (within ``by``), by way of their spots."""
    own = spots(points, ident, by)
    if radius_m < 0:
        return own.select(ident, F.col(ident).alias("root"))
    rooted = components(own.select("spot").distinct(), spot_links(own, radius_m).select(F.col("p").alias("a"), F.col("q").alias("b")), "spot")
    return own.join(rooted, "spot").select(ident, "root")


def places(points: DataFrame, radius_m: float, at: str, ident: str = "id") -> DataFrame:
    """(id, place_id): single linkage by distance, numbered by earliest time, undated ones last by smallest id."""
    located = points.where("lat is not null and lon is not null")
    rooted = radius_components(located, radius_m, ident)
    first = rooted.join(located.select(ident, F.struct(F.col(at).isNull().alias("undated"), F.col(at).alias("t"), F.col(ident).alias("i")).alias("_o")), ident)
    return numbered(first, "_o", "place_id").select(ident, "place_id")


def nearest_fix(targets: DataFrame, fixes: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(seg_id, lat, lon): the file's fix nearest in time, the first of equals; without one, the file's own tag.

    ``targets`` has seg_id, file_id, time_s; ``fixes`` file_id, seq, time_s, lat, lon.  Where the fix or the target has no time
    they count as at distance 0.  A file's fixes and targets are sorted together once; no pairs of them are made.
    """
    good = fixes.where("lat is not null and lon is not null").select("file_id", F.col("time_s").alias("_t"), F.struct("seq", "lat", "lon").alias("_row"))
    undated = good.groupBy("file_id").agg(F.min(F.when(F.col("_t").isNull(), F.col("_row"))).alias("_undated"), F.min("_row").alias("_first"))
    asked = targets.select("seg_id", "file_id", F.col("time_s").alias("_t"))
    near = around(asked.where("_t is not null"), good.where("_t is not null")).unionByName(asked.where("_t is null"), allowMissingColumns=True)
    joined = near.join(undated, "file_id", "left")

    def offer(row: Column, distance: Column) -> Column:
        return F.when(row.isNotNull(), F.struct(distance.cast("double").alias("d"), row.alias("row")))

    zero = F.lit(0.0)
    offers = [offer(F.col(f"{side}.row"), F.abs(F.col(f"{side}.at") - F.col("_t"))) for side in ("before", "after")]
    offers += [offer(F.col("_undated"), zero), offer(F.when(F.col("_t").isNull(), F.col("_first")), zero)]
    best = joined.select("seg_id", "file_id", F.array_min(F.array(*offers))["row"].alias("p"))
    if fallback is None:
        return best.select("seg_id", "p.lat", "p.lon")
    tags = fallback.select("file_id", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    return best.join(tags, "file_id", "left").select("seg_id", F.coalesce("p.lat", "_la").alias("lat"), F.coalesce("p.lon", "_lo").alias("lon"))


def best_selected(candidates: DataFrame, pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, similarity, winner): the most similar selected row, the first in edit order of equals; only similarities over 0 count."""
    both = pairs.select("a", "b", "sim").union(pairs.select("b", "a", "sim")).toDF("id", "other", "sim")
    hit = both.where("sim > 0").join(selected.select(F.col("id").alias("other"), F.col("order").alias("_o")), "other")
    best = hit.groupBy("id").agg(F.min_by(F.struct("sim", "other"), F.struct((-F.col("sim")).alias("s"), F.col("_o"))).alias("w"))
    return candidates.select("id").join(best, "id", "left").select("id", F.coalesce("w.sim", F.lit(0.0)).alias("similarity"), F.col("w.other").alias("winner"))
