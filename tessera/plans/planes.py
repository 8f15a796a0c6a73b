"""Queries for the kernels in two dimensions, with DuckDB SQL for each.

``part`` is cut into planes of 32 x 32 cells by its key, one cell a row; cells without a row are 0. Every
kernel runs as the library has it, a plane at a time, over all planes; the SQL does the same sums cell by
cell. The solvers run on points whose true maps the SQL knows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import blend, burst, features, raster, solve
from tessera.operators import catalog, color, geometry
from tessera.plans.bank import _t, query
from tessera.sources import blobs

SIDE = 32

_PX = """
    gr as (select im, y, x from (select unnest(range(0, (select max(p_partkey // 1024) + 1 from part))) im), (select unnest(range(0, 32)) y), (select unnest(range(0, 32)) x)),
    px as (select gr.im::bigint im, gr.y::int y, gr.x::int x, coalesce(p.p_size * 1000 + p.p_partkey % 997, 0)::bigint v from gr left join part p on p.p_partkey = gr.im * 1024 + gr.y * 32 + gr.x),
    k5(o, w) as (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)), k3(o) as (values (-1), (0), (1))"""


def _at(y: str, x: str, side: int = SIDE) -> str:
    """The cell at y, x of the same plane, the edge's beyond an edge."""
    return f"p.im = c.im and p.y = least(greatest({y}, 0), {side - 1}) and p.x = least(greatest({x}, 0), {side - 1})"


def _blur_sql(src: str, side: int = SIDE) -> str:
    return f"select c.im, c.y, c.x, sum(a.w * b.w * p.v) / 256.0::double as v from {src} c cross join k5 a cross join k5 b join {src} p on {_at('c.y + a.o', 'c.x + b.o', side)} group by 1, 2, 3"


def _down_sql(src: str, side: int = SIDE) -> str:
    return f"select im, (y // 2)::int y, (x // 2)::int x, v from ({_blur_sql(src, side)}) where y % 2 = 0 and x % 2 = 0"


def _up_sql(src: str, m: int, h: int, w: int) -> str:
    """Bilinear from m x m to h x w, first along y."""

    def places(n: int, axis: str) -> str:
        return f"(select {axis}, floor(pos)::int lo, least(floor(pos)::int + 1, {m - 1}) hi, pos - floor(pos) f from (select i::int as {axis}, i * {(m - 1) / (n - 1)!r}::double as pos from (select unnest(range(0, {n})) i)))"

    rows = f"select a.im, g.y, a.x, a.v * (1 - g.f) + b.v * g.f as v from {places(h, 'y')} g join {src} a on a.y = g.lo join {src} b on b.im = a.im and b.x = a.x and b.y = g.hi"
    return f"select a.im, a.y, g.x, a.v * (1 - g.f) + b.v * g.f as v from {places(w, 'x')} g join ({rows}) a on a.x = g.lo join ({rows}) b on b.im = a.im and b.y = a.y and b.x = g.hi"


def _planes(spark, sf_dir) -> DataFrame:
    """image_id, plane: the 1024 values of each plane, row by row; a group is one plane, whatever the table's size."""
    cells = _t(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 1024).cast("long").alias("im"), (F.col("p_partkey") % 1024).cast("int").alias("at"), (F.col("p_size") * 1000 + F.col("p_partkey") % 997).cast("int").alias("v"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(SIDE * SIDE, dtype=np.int64)
        a[pdf["at"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"image_id": [pdf["im"].iloc[0]], "plane": [a]})

    return cells.groupBy("im").applyInPandas(gather, "image_id long, plane array<long>")


def _cells(spark, sf_dir, kernel, columns: dict[str, str]) -> DataFrame:
    """im, y, x and the kernel's arrays of one shape, a row for each cell. kernel: plane -> arrays."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                out = kernel(np.asarray(r.plane).reshape(SIDE, SIDE))
                y, x = np.mgrid[0 : out[0].shape[0], 0 : out[0].shape[1]].astype(np.int32)
                yield pd.DataFrame({"im": r.image_id, "y": y.ravel(), "x": x.ravel()} | {c: a.ravel() for c, a in zip(columns, out, strict=True)})

    return _planes(spark, sf_dir).mapInPandas(run, "im long, y int, x int, " + ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def _three(a: np.ndarray) -> np.ndarray:
    return np.repeat(a[..., None], 3, axis=2)


def _moved(a: np.ndarray) -> np.ndarray:
    """A second frame: the plane two to the left and one down, with a little added."""
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    return a[np.clip(y - 1, 0, SIDE - 1), np.clip(x + 2, 0, SIDE - 1)] + (x * y) % 5 * 100


_SRC = f"src as (select c.im, c.y, c.x, p.v + (c.x * c.y) % 5 * 100 as v from px c join px p on {_at('c.y - 1', 'c.x + 2')})"


# stencils ----------------------------------------------------------------------------------------


@query(f"with {_PX} select im, y, x, (v * 256)::bigint as v256 from ({_blur_sql('px')})")
def blur_2d(spark, sf_dir):
    return _cells(spark, sf_dir, lambda a: [(blend.blur(a.astype(float)) * 256).astype(np.int64)], {"v256": "long"})


@query(f"with {_PX} select im, y, x, (v * 256)::bigint as v256 from ({_down_sql('px')})")
def downsample_2d(spark, sf_dir):
    return _cells(spark, sf_dir, lambda a: [(blend.down(a.astype(float)) * 256).astype(np.int64)], {"v256": "long"})


@query(f"with {_PX} select im, y, x, round(v, 4) as v from ({_up_sql('px', 32, 48, 40)})")
def upsample_2d(spark, sf_dir):
    return _cells(spark, sf_dir, lambda a: [blend.up(a.astype(float), 48, 40)], {"v": "double"}).withColumn("v", F.round("v", 4))


@query(f"""
    with {_PX}, lower as materialized ({_down_sql('px')}), higher as ({_up_sql('lower', 16, 32, 32)})
    select c.im, c.y, c.x, round(c.v - h.v, 4) as detail, round(h.v + (c.v - h.v), 4) as whole from px c join higher h on h.im = c.im and h.y = c.y and h.x = c.x""")
def pyramid_2d(spark, sf_dir):
    """The finest band of a pyramid of two levels, and the levels put together again."""

    def kernel(a):
        bands = blend.laplacian(blend.gaussian(a.astype(float), 2))
        return [bands[0], blend.collapse(bands)]

    out = _cells(spark, sf_dir, kernel, {"detail": "double", "whole": "double"})
    return out.select("im", "y", "x", F.round("detail", 4).alias("detail"), F.round("whole", 4).alias("whole"))


@query(f"""
    with {_PX}, gap as (select im, y, x from px where v % 7 = 0),
    far as (select c.im, c.y, c.x, min(greatest(abs(c.y - g.y), abs(c.x - g.x)) - least(abs(c.y - g.y), abs(c.x - g.x)) + sqrt(2.0::double) * least(abs(c.y - g.y), abs(c.x - g.x))) d from px c join gap g on g.im = c.im group by 1, 2, 3)
    select c.im, c.y, c.x, round(coalesce(d, 64.0::double), 6) as d from px c left join far using (im, y, x)""")
def coverage_distance_2d(spark, sf_dir):
    return _cells(spark, sf_dir, lambda a: [blend.coverage_distance(a % 7 != 0)], {"d": "double"}).withColumn("d", F.round("d", 6))


@query(f"with {_PX} select im, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1 from px where v > 49000 group by im")
def coverage_box_2d(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            found = [(r.image_id, *b) for r in pdf.itertuples() if (b := blend.box(np.asarray(r.plane).reshape(SIDE, SIDE) > 49000)) is not None]
            yield pd.DataFrame(found, columns=["im", "x0", "y0", "x1", "y1"])

    return _planes(spark, sf_dir).mapInPandas(run, "im long, x0 int, y0 int, x1 int, y1 int")


_TENSOR = f"""
    gr_ as (select c.im, c.y, c.x, (max(p.v) filter (where k.o = 1) - max(p.v) filter (where k.o = -1)) / 2.0::double gx from px c cross join k3 k join px p on {_at('c.y', 'c.x + k.o')} group by 1, 2, 3),
    gc_ as (select c.im, c.y, c.x, (max(p.v) filter (where k.o = 1) - max(p.v) filter (where k.o = -1)) / 2.0::double gy from px c cross join k3 k join px p on {_at('c.y + k.o', 'c.x')} group by 1, 2, 3),
    gd as materialized (select im, y, x, gx, gy from gr_ join gc_ using (im, y, x))"""


@query(f"""
    with {_PX}, {_TENSOR},
    s as (select c.im, c.y, c.x, sum(p.gx * p.gx) xx, sum(p.gy * p.gy) yy, sum(p.gx * p.gy) xy from gd c cross join k5 a cross join k5 b join gd p on {_at('c.y + a.o', 'c.x + b.o')} group by 1, 2, 3),
    r as (select *, (xx + yy) / 2 h, sqrt(greatest(0, ((xx + yy) / 2) * ((xx + yy) / 2) - (xx * yy - xy * xy))) q, 0.5::double * atan2(2 * xy, xx - yy) t from s)
    select im, y, x, round(cos(t), 4) + 0.0::double as c, round(sin(t), 4) + 0.0::double as s, round(((h + q) - greatest(0, h - q)) / ((h + q) + greatest(0, h - q) + 0.000001::double), 4) + 0.0::double as coherence from r""")
def structure_tensor_2d(spark, sf_dir):
    out = _cells(spark, sf_dir, lambda a: list(burst.structure_tensor(_three(a))), {"c": "double", "s": "double", "coherence": "double"})
    return out.select("im", "y", "x", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("c", "s", "coherence")))


# sensor planes, maps -----------------------------------------------------------------------------


@query(f"""
    with {_PX}, c0 as (select im, y, x, ((2492765332::bigint >> ((((y * 2) & 14) | (x & 1)) * 2)::bigint) & 3)::int col, greatest(v - 64, 0) raw from px),
    cc as materialized (select im, y, x, case when col = 3 then 1 else col end col, trunc(least(raw * [1.5::double, 1.0::double, 2.0::double, 1.0::double][col + 1], 65535))::bigint v from c0),
    m as (select c.im, c.y, c.x, k.ch, any_value(c.col) own, any_value(c.v) mine, floor(coalesce(sum(p.v) filter (where p.col = k.ch) / nullif(count(*) filter (where p.col = k.ch), 0)::double, 0)) others
          from cc c cross join (select unnest([0, 1, 2]) ch) k join cc p on p.im = c.im and abs(p.y - c.y) <= 1 and abs(p.x - c.x) <= 1 group by 1, 2, 3, 4),
    rgb as (select im, y, x, max(case when ch = 0 then case when own = ch then mine else others end end)::int r, max(case when ch = 1 then case when own = ch then mine else others end end)::int g,
                   max(case when ch = 2 then case when own = ch then mine else others end end)::int b from m group by 1, 2, 3)
    select im, y, x, r, g, b from rgb""")
def demosaic_2d(spark, sf_dir):
    """Black level, white balance and the mean of the like-coloured neighbours, without a colour matrix."""
    unit = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]

    def kernel(a):
        out = raster.demosaic(a, 64, (1.5, 1.0, 2.0, 1.0), unit, 0x94949494)
        return [out[..., k].astype(np.int32) for k in range(3)]

    return _cells(spark, sf_dir, kernel, {"r": "int", "g": "int", "b": "int"})


_H = (0.98, 0.05, -1.5, -0.03, 1.02, 0.7, 0.0004, -0.0002, 1.0)
_TAPS = "(a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy"


@query(f"""
    with {_PX}, w as (select im, y, x, 0.0004::double * (x + 2) + -0.0002::double * (y + 1) + 1.0::double q from (select distinct im from px), (select unnest(range(0, 36))::int y), (select unnest(range(0, 40))::int x)),
    uv as (select im, y, x, (0.98::double * (x + 2) + 0.05::double * (y + 1) + -1.5::double) / q u, (-0.03::double * (x + 2) + 1.02::double * (y + 1) + 0.7::double) / q v from w),
    f as (select *, floor(u)::int u0, floor(v)::int v0, u - floor(u) fx, v - floor(v) fy from uv)
    select f.im, f.y, f.x, coalesce(trunc(least(greatest({_TAPS}, 0), 65535)), 0)::int as v from f
    left join px a on a.im = f.im and a.y = v0 and a.x = u0 and u0 < 31 and v0 < 31 left join px b on b.im = a.im and b.y = v0 and b.x = u0 + 1 left join px c on c.im = a.im and c.y = v0 + 1 and c.x = u0
    left join px d on d.im = a.im and d.y = v0 + 1 and d.x = u0 + 1""")
def warp_2d(spark, sf_dir):
    return _cells(spark, sf_dir, lambda a: [raster.warp(a, np.array(_H), 40, 36, (2, 1)).astype(np.int32)], {"v": "int"})


@query(f"""
    with {_PX}, uv as (select im, y, x, least(greatest(x * 1.37::double - 2.5::double, 0), 31) u, least(greatest(y * 0.81::double + 3.25::double, 0), 31) v from px),
    f as (select *, floor(u)::int u0, floor(v)::int v0, least(floor(u)::int + 1, 31) u1, least(floor(v)::int + 1, 31) v1, u - floor(u) fx, v - floor(v) fy from uv)
    select f.im, f.y, f.x, round({_TAPS}, 4) as v from f join px a on a.im = f.im and a.y = v0 and a.x = u0 join px b on b.im = f.im and b.y = v0 and b.x = u1 join px c on c.im = f.im and c.y = v1 and c.x = u0
    join px d on d.im = f.im and d.y = v1 and d.x = u1""")
def sample_2d(spark, sf_dir):
    def kernel(a):
        y, x = np.mgrid[0:SIDE, 0:SIDE].astype(float)
        return [raster.bilinear(a, x * 1.37 - 2.5, y * 0.81 + 3.25)]

    return _cells(spark, sf_dir, kernel, {"v": "double"}).withColumn("v", F.round("v", 4))


# corners and descriptors -------------------------------------------------------------------------


@query(f"""
    with {_PX}, g8 as materialized (select im, y, x, (v % 256)::int v from px),
    ring(k, dx, dy) as (values (0, 0, -3), (1, 1, -3), (2, 2, -2), (3, 3, -1), (4, 3, 0), (5, 3, 1), (6, 2, 2), (7, 1, 3), (8, 0, 3), (9, -1, 3), (10, -2, 2), (11, -3, 1), (12, -3, 0), (13, -3, -1), (14, -2, -2), (15, -1, -3)),
    f as (select c.im, c.y, c.x, string_agg(case when p.v > c.v + 20 then 'b' when p.v < c.v - 20 then 'd' else 'o' end, '' order by r.k) s
          from g8 c cross join ring r join g8 p on p.im = c.im and p.y = c.y + r.dy and p.x = c.x + r.dx where c.y between 3 and 28 and c.x between 3 and 28 group by 1, 2, 3)
    select im, y, x from f where contains(s || s, 'bbbbbbbbb') or contains(s || s, 'ddddddddd')""")
def fast_corners_2d(spark, sf_dir):
    """Corners by the circle of sixteen, nine in a row all brighter or all darker by over 20."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                p = features.fast_corners((np.asarray(r.plane).reshape(SIDE, SIDE) % 256).astype(np.uint8), most=None)
                yield pd.DataFrame({"im": r.image_id, "y": p[:, 1].astype(np.int32), "x": p[:, 0].astype(np.int32)})

    return _planes(spark, sf_dir).mapInPandas(run, "im long, y int, x int")


_M32 = "4294967296"


def _hash_sql() -> str:
    """h0 .. h3 of each bit's number: the pattern's hash, each round from the one before."""
    stir = lambda h: f"xor((xor({h}, {h} >> 13) * 60493) % {_M32}, ((xor({h}, {h} >> 13) * 60493) % {_M32}) >> 15)"
    out = f"select i, {stir('s')} as h0 from (select i, (i::hugeint * 2654435761 % {_M32})::bigint s from (select unnest(range(0, 256)) i))"
    for k, step in enumerate((2246822519, 3266489917, 668265263)):
        out = f"select * exclude s, {stir('s')} as h{k + 1} from (select *, ((h{k}::hugeint * {step} + 1) % {_M32})::bigint s from ({out}))"
    return out


@query(f"select i::int as i, h0::bigint as h, (h0 % 31 - 15)::int as dx0, (h1 % 31 - 15)::int as dy0, (h2 % 31 - 15)::int as dx1, (h3 % 31 - 15)::int as dy1 from ({_hash_sql()})")
def brief_hash(spark, sf_dir):
    """The pattern of a binary descriptor: the hash of each bit's number, and the two offsets that the bit compares."""

    def run(batches):
        p, h = features.pattern(), features.hashes()
        for pdf in batches:
            i = pdf["id"].to_numpy()
            yield pd.DataFrame({"i": i.astype(np.int32), "h": h[i].astype(np.int64)} | {c: p[i, k].astype(np.int32) for k, c in enumerate(("dx0", "dy0", "dx1", "dy1"))})

    return spark.range(features.BITS).mapInPandas(run, "i int, h long, dx0 int, dy0 int, dx1 int, dy1 int")


@query(f"""
    with {_PX}, hs as materialized ({_hash_sql()}), pt(y, x) as (values (7, 5), (16, 16), (0, 31)),
    bits as (select c.im, pt.y, pt.x, hs.i, p.v < q.v as less from (select distinct im from px) c cross join pt cross join hs
             join px p on p.im = c.im and p.y = least(greatest(pt.y + h1 % 31 - 15, 0), 31) and p.x = least(greatest(pt.x + h0 % 31 - 15, 0), 31)
             join px q on q.im = c.im and q.y = least(greatest(pt.y + h3 % 31 - 15, 0), 31) and q.x = least(greatest(pt.x + h2 % 31 - 15, 0), 31))
    select im, y::int as y, x::int as x, (i // 32)::int as word, sum(case when less then 1::bigint << (i % 32)::bigint else 0 end)::bigint as bits from bits group by 1, 2, 3, 4""")
def brief_2d(spark, sf_dir):
    """Descriptors at three points of each plane, as eight words of 32 bits."""
    points = np.array([(5, 7), (16, 16), (31, 0)])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                d = features.describe(np.asarray(r.plane).reshape(SIDE, SIDE), points).view("<u4").reshape(len(points), 8)
                yield pd.DataFrame({"im": r.image_id, "y": np.repeat(points[:, 1], 8).astype(np.int32), "x": np.repeat(points[:, 0], 8).astype(np.int32), "word": np.tile(np.arange(8, dtype=np.int32), len(points)), "bits": d.ravel().astype(np.int64)})

    return _planes(spark, sf_dir).mapInPandas(run, "im long, y int, x int, word int, bits long")


# bursts ------------------------------------------------------------------------------------------


@query(f"""
    with {_PX}, {_SRC}, d as (select dx, dy from (select unnest(range(-3, 4))::int dx), (select unnest(range(-3, 4))::int dy)),
    sad as (select c.im, (c.y // 16)::int ty, (c.x // 16)::int tx, d.dx, d.dy, sum(abs(c.v - p.v)) s, count(*) n from px c cross join d join src p on p.im = c.im and p.y = c.y + d.dy and p.x = c.x + d.dx group by 1, 2, 3, 4, 5),
    r as (select *, row_number() over (partition by im, ty, tx order by s, abs(dx) + abs(dy), dy, dx) rn from sad where n = 256)
    select im, ty as y, tx as x, dx, dy from r where rn = 1""")
def block_match_2d(spark, sf_dir):
    """The shift of each tile of a plane's second frame with the least sum of absolute differences."""

    def kernel(a):
        out = burst.block_match(a[..., None], _moved(a)[..., None], 16, 3)
        return [out[..., 0], out[..., 1]]

    return _cells(spark, sf_dir, kernel, {"dx": "int", "dy": "int"})


@query(f"""
    with {_PX}, {_SRC}, s as (select c.im, c.y, c.x, c.v r, p.v w from px c left join src p on p.im = c.im and p.x = c.x + 1 + c.x // 16 and p.y = c.y - c.y // 16),
    k as (select *, exp(-((w - r) * (w - r))::double / (2 * 2000.0::double * 2000.0::double)) g from s)
    select im, y, x, trunc(least(greatest((r + coalesce(g * w, 0)) / (1 + coalesce(g, 0)), 0), 65535))::int as v from k""")
def robust_merge_2d(spark, sf_dir):
    """Two frames merged, the second looked up at its tile's offset; what falls outside does not count."""
    field = np.array([[(1, 0), (2, 0)], [(1, -1), (2, -1)]])
    return _cells(spark, sf_dir, lambda a: [burst.robust_merge([_three(a), _three(_moved(a))], [field])[..., 0].astype(np.int32)], {"v": "int"})


@query(f"""
    with {_PX}, {_SRC}, t as (select c.im, c.y // 16 ty, c.x // 16 tx, c.y % 16 y, c.x % 16 x, c.v r, p.v - c.v d from px c join src p on p.im = c.im and p.y = c.y and p.x = c.x),
    f as (select unnest(range(0, 16)) i), w as materialized (select i as n, cos(2 * pi() * i / 16) co, sin(2 * pi() * i / 16) si from f),
    ft as materialized (select t.im, t.ty, t.tx, a.i u, b.i v, sum(t.d * w.co) re, -sum(t.d * w.si) im_ from t cross join f a cross join f b join w on w.n = (a.i * t.y + b.i * t.x) % 16 group by 1, 2, 3, 4, 5),
    k as materialized (select *, (re * re + im_ * im_) / (re * re + im_ * im_ + 100000000.0::double) g from ft),
    back as (select t.im, t.ty, t.tx, t.y, t.x, any_value(t.r) r, sum(k.g * (k.re * w.co - k.im_ * w.si)) / 256 d from t join k on k.im = t.im and k.ty = t.ty and k.tx = t.tx join w on w.n = (k.u * t.y + k.v * t.x) % 16 group by 1, 2, 3, 4, 5)
    select im, (ty * 16 + y)::int as y, (tx * 16 + x)::int as x, floor(least(greatest(r + d, 0), 65535) + 0.5::double)::int as v from back""")
def fourier_merge_2d(spark, sf_dir):
    """The spectra of a frame's tiles plus the weighted difference of the second frame's."""
    still = np.zeros((2, 2, 2), dtype=np.int64)
    return _cells(spark, sf_dir, lambda a: [burst.fourier_merge([_three(a), _three(_moved(a))], [still], variance=1e8)[..., 0].astype(np.int32)], {"v": "int"})


@query(f"""
    with {_PX}, {_SRC}, {_TENSOR},
    s as (select g.im, (g.y // 16)::int y, (g.x // 16)::int x, sum(gx * gx) xx, sum(gy * gy) yy, sum(gx * gy) xy, sum(gx * (p.v - c.v)) xt, sum(gy * (p.v - c.v)) yt
          from gd g join px c on c.im = g.im and c.y = g.y and c.x = g.x join src p on p.im = g.im and p.y = g.y and p.x = g.x group by 1, 2, 3),
    st as (select im, y, x, case when abs(xx * yy - xy * xy) >= 0.001::double then least(greatest((yt * xy - xt * yy) / (xx * yy - xy * xy), -1), 1) else 0 end dx,
                  case when abs(xx * yy - xy * xy) >= 0.001::double then least(greatest((xt * xy - yt * xx) / (xx * yy - xy * xy), -1), 1) else 0 end dy from s)
    select c.im, c.y, c.x, round(avg(p.dx), 6) + 0.0::double as dx, round(avg(p.dy), 6) + 0.0::double as dy from st c join st p on p.im = c.im group by 1, 2, 3""")
def refine_2d(spark, sf_dir):
    """One gradient step of each tile's offset, then the field is smoothed over the neighbours."""

    def kernel(a):
        out = burst.refine(a[..., None], _moved(a)[..., None], np.zeros((2, 2, 2)), iterations=1)
        return [out[..., 0], out[..., 1]]

    out = _cells(spark, sf_dir, kernel, {"dx": "double", "dy": "double"})
    return out.select("im", "y", "x", (F.round("dx", 6) + F.lit(0.0)).alias("dx"), (F.round("dy", 6) + F.lit(0.0)).alias("dy"))


@query(f"""
    with {_PX}, {_SRC}, v as (select c.im, c.y, c.x, c.v / 65535.0::double a, p.v / 65535.0::double b from px c join src p on p.im = c.im and p.y = c.y and p.x = c.x),
    g as (select *, exp(-((a - 0.5::double) * (a - 0.5::double)) / (2 * 0.2::double * 0.2::double)) ga, exp(-((b - 0.5::double) * (b - 0.5::double)) / (2 * 0.2::double * 0.2::double)) gb from v),
    s as (select *, case when ga * ga * ga + gb * gb * gb > 0.000001::double then ga * ga * ga / (ga * ga * ga + gb * gb * gb) else 0.5::double end w from g)
    select im, y, x, floor(least(greatest((w * a + (1 - w) * b) * 65535, 0), 65535) + 0.5::double)::int as v from s""")
def fuse_2d(spark, sf_dir):
    """Two exposures, weighed by how well exposed each is, in one band."""
    return _cells(spark, sf_dir, lambda a: [blend.fuse(_three(a), _three(_moved(a)), bands=1)[..., 0].astype(np.int32)], {"v": "int"})


@query(f"""
    with {_PX}, {_SRC} select c.im, c.y, c.x, (c.v // 2 + p.v // 2)::int as v from px c join src p on p.im = c.im and p.y = c.y and p.x = c.x""")
def even_blend_2d(spark, sf_dir):
    """Two frames of even values half and half in every band, which is their mean."""
    return _cells(spark, sf_dir, lambda a: [(blend.even_blend(_three(a // 2 * 2), _three(_moved(a) // 2 * 2))[..., 0]).astype(np.int32)], {"v": "int"})


@query(f"""
    with {_PX} select a.im, a.y, b.x, sum((a.v % 50) * (b.v % 37))::bigint as v from px a join px b on b.im = a.im and b.y = a.x group by 1, 2, 3""")
def batched_product_2d(spark, sf_dir):
    """The products of two matrices of each plane, with small whole numbers that half precision holds."""
    return _cells(spark, sf_dir, lambda a: [solve.batched_product((a % 50)[None], (a % 37)[None])[0].astype(np.int64)], {"v": "long"})


# solvers: the true maps are known ------------------------------------------------------------------


def _true_map(k: int) -> np.ndarray:
    return np.array([1 + k % 7 * 0.01, 0.02, k % 13, -0.03, 1 - k % 5 * 0.01, k % 11, 0.0001, 0.0002, 1.0])


_PROJECTED = """round(((1 + {k} % 7 * 0.01::double) * 37 + 0.02::double * 21 + {k} % 13) / (0.0001::double * 37 + 0.0002::double * 21 + 1), 3) as u,
                round((-0.03::double * 37 + (1 - {k} % 5 * 0.01::double) * 21 + {k} % 11) / (0.0001::double * 37 + 0.0002::double * 21 + 1), 3) as v"""


@query(f"select s_suppkey as k, {_PROJECTED.format(k='s_suppkey')} from supplier")
def homography_solve(spark, sf_dir):
    """A map solved from five points and their images takes another point where the true one does."""

    def run(batches):
        src = np.array([(0, 0), (100, 0), (100, 80), (0, 80), (40, 30)], float)
        for pdf in batches:
            found = [solve.project(solve.homography(src, solve.project(_true_map(int(k)), src)), np.array([[37.0, 21.0]]))[0] for k in pdf.k]
            yield pd.DataFrame({"k": pdf.k, "u": [p[0] for p in found], "v": [p[1] for p in found]})

    points = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return points.mapInPandas(run, f"k {points.schema['k'].dataType.simpleString()}, u double, v double").select("k", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"))


@query(f"select n_nationkey as k, {_PROJECTED.format(k='n_nationkey')}, 24::int as inliers from nation")
def ransac_solve(spark, sf_dir):
    """The same from thirty points of which every fifth is far off: the inliers are all the others."""

    def run(batches):
        src = np.array([(x * 20, y * 16) for y in range(5) for x in range(6)], float)
        for pdf in batches:
            rows = []
            for k in pdf.k:
                dst = solve.project(_true_map(int(k)), src)
                dst[::5] += np.array([(40 + 7 * i, -30 - 11 * i * (i % 2)) for i in range(len(dst[::5]))])
                h, n, _ = solve.ransac(src, dst)
                rows.append((k, *solve.project(h, np.array([[37.0, 21.0]]))[0], n))
            yield pd.DataFrame(rows, columns=["k", "u", "v", "inliers"])

    points = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return points.mapInPandas(run, f"k {points.schema['k'].dataType.simpleString()}, u double, v double, inliers int").select("k", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), "inliers")


@query("""
    with s as (select c_nationkey k, sum(c_acctbal * c_acctbal) xx, sum(c_acctbal) x, count(*) n, sum(c_acctbal * (c_custkey % 100)) xr, sum(c_custkey % 100) r from customer group by 1)
    select k, round((-xr * (n * 1.01::double) + x * r) / (xx * 1.01::double * n * 1.01::double - x * x), 8) as a, round((-r * (xx * 1.01::double) + x * xr) / (xx * 1.01::double * n * 1.01::double - x * x), 4) as b from s""")
def damped_step(spark, sf_dir):
    """One damped least-squares step of a line for each nation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = solve.damped_step(np.column_stack([pdf.x, np.ones(len(pdf))]), pdf.r.to_numpy(float), 0.01)
        return pd.DataFrame({"k": [pdf.k.iloc[0]], "a": [d[0]], "b": [d[1]]})

    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).alias("r"))
    return rows.groupBy("k").applyInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, a double, b double").select("k", F.round("a", 8).alias("a"), F.round("b", 4).alias("b"))


@query("""
    select n_nationkey as k, i::int as image, round(37 + i * (n_nationkey + 3.5::double), 2) as u, round(21 - i * (n_nationkey % 4 + 0.25::double), 2) as v
    from nation, (select unnest([0, 1, 2]) i)""")
def bundle_adjustment(spark, sf_dir):
    """Three images that overlap in a chain: the adjustment, stopped and taken up again, finds where each stands."""

    def run(batches):
        grid = np.array([(x * 23.0, y * 19.0) for y in range(4) for x in range(4)])
        for pdf in batches:
            rows = []
            for k in pdf.k:
                at = [np.array([i * (k + 3.5), -i * (k % 4 + 0.25)]) for i in range(3)]
                pairs = np.concatenate([np.column_stack([np.full(16, a), np.full(16, b), grid - at[a], grid - at[b]]) for a, b in ((0, 1), (1, 2), (0, 2))])
                part = solve.BundleAdjustment([0, 1, 2], pairs)
                part.run(most=4)
                maps = solve.BundleAdjustment([0, 1, 2], pairs, part.state).run()
                rows += [(k, i, *solve.project(maps[i], np.array([[37.0, 21.0]]))[0]) for i in range(3)]
            yield pd.DataFrame(rows, columns=["k", "image", "u", "v"])

    points = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return points.mapInPandas(run, f"k {points.schema['k'].dataType.simpleString()}, image int, u double, v double").select("k", "image", F.round("u", 2).alias("u"), F.round("v", 2).alias("v"))


@query("""
    with p as (select o_orderkey, (o_custkey % 1000)::double x, (o_orderkey % 700)::double y from orders)
    select o_orderkey, round(sqrt(power(0.3::double, 2) + power((o_orderkey % 5) * 0.4::double, 2)), 6) as err, round(1.01::double * x + 3, 6) as u from p""")
def reprojection_error(spark, sf_dir):
    """The distance of points that are off by a known step, by a map put together from its parameters."""
    h = geometry.from_parameters(F.array(*(F.lit(float(c)) for c in (1.01, 0.0, 3.0, 0.0, 0.99, -5.0, 0.0, 0.0))))
    points = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).cast("double").alias("x"), (F.col("o_orderkey") % 700).cast("double").alias("y"), h.alias("h"))
    h = [F.col("h")[k] for k in range(9)]
    u, v = geometry.project(h, F.col("x"), F.col("y"))
    err = geometry.reprojection_error(h, F.col("x"), F.col("y"), u + 0.3, v - (F.col("o_orderkey") % 5) * 0.4)
    return points.select("o_orderkey", F.round(err, 6).alias("err"), F.round(u, 6).alias("u"))


# stores and the catalog ----------------------------------------------------------------------------


@query(f"with {_PX} select im, 32::int as width, 32::int as height, sum(v)::bigint as total, (8 + 2 * 1024)::int as bytes, max(v) filter (where y = 31 and x = 31)::int as last from px group by im")
def pixel_frames(spark, sf_dir):
    """Planes as framed bytes and back: their shape, sum, size and last sample."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                raw = blobs.frame_pixels(np.asarray(r.plane).reshape(SIDE, SIDE, 1))
                a = blobs.unframe_pixels(raw)
                rows.append((r.image_id, a.shape[1], a.shape[0], int(a.sum()), len(raw), int(a.ravel()[-1])))
            yield pd.DataFrame(rows, columns=["im", "width", "height", "total", "bytes", "last"])

    return _planes(spark, sf_dir).mapInPandas(run, "im long, width int, height int, total long, bytes int, last int")


@query("""
    select label, count(*)::int as points, (4 + count(*) * 40)::int as bytes, round(sum(embedding[1])::double, 3) as x, sum(vec_id)::bigint as words from embeddings group by label""")
def feature_frames(spark, sf_dir):
    """Points and descriptors as framed bytes and back, an image for each label."""
    rows = _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = blobs.frame_features(np.column_stack([pdf.x, pdf.x]), np.column_stack([pdf.vec_id] * 4))
        points, words = blobs.unframe_features(raw)
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "points": [len(points)], "bytes": [len(raw)], "x": [float(points[:, 0].astype(float).sum())], "words": [int(words[:, 2].sum())]})

    kind = rows.schema["label"].dataType.simpleString()
    return rows.groupBy("label").applyInPandas(run, f"label {kind}, points int, bytes int, x double, words long").withColumn("x", F.round("x", 3))


@query("""
    select stage, unit_kind, count(*)::bigint as n, min(unit_key) as first from (
      select 'ALIGN' stage, 'image' unit_kind, n_nationkey::varchar unit_key from nation union all select 'ALIGN', 'pair', a.n_nationkey || ':' || b.n_nationkey from nation a join nation b on a.n_nationkey < b.n_nationkey
      union all select 'RENDER', 'chunk', p_brand from (select distinct p_brand from part) union all select 'BURST_ALIGN', 'frame', s_suppkey::varchar from supplier
      union all select 'BURST_MERGE', 'merge', unnest(['merged', 'final'])) group by 1, 2""")
def seed_all_tasks(spark, sf_dir):
    """The tasks of aligning, rendering and bursts."""
    images = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    chunks = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("chunk_id"))
    frames = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    tasks = catalog.seed_align_tasks(images).unionByName(catalog.seed_render_tasks(chunks)).unionByName(catalog.seed_burst_tasks(spark, frames))
    return tasks.groupBy("stage", "unit_kind").agg(F.count(F.lit(1)).alias("n"), F.min("unit_key").alias("first"))


@query("select 'ALIGN' as stage, 'pair' as unit_kind, '3:17' as unit_key, 'PENDING' as status")
def task_find(spark, sf_dir):
    """The task of a pair, asked for the other way round."""
    images = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return catalog.find_task(catalog.seed_align_tasks(images), "ALIGN", "pair", "17:3").select("stage", "unit_kind", "unit_key", "status")


@query("select p_brand, sum((p_size % 3 <> 0 or p_partkey % 4 <> 0)::int)::bigint as covered, count(*)::bigint as n from part group by 1")
def coverage_mask(spark, sf_dir):
    """Pixels with a channel that is not 0; null counts as 0."""
    mask = color.covered(F.col("p_size") % 3, F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 4))
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(mask.cast("long")).alias("covered"), F.count(F.lit(1)).alias("n"))
