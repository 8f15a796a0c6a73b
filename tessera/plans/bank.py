"""The query bank: every relational operator on the tables, with DuckDB SQL for each.

The tables stand in for rasters: lineitem is a stack of samples per part, events an ordered signal per
user, embeddings descriptors (their signs), orders points and tasks, part pixels with a distribution per
brand, nation, supplier and customer sums per image. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, color, geometry, match, series, stack


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# stacks ----------------------------------------------------------------------------------------


@query("""
    with st as (select l_partkey k, l_quantity v, count(*) over (partition by l_partkey) n, avg(l_quantity) over (partition by l_partkey) m,
                       stddev_pop(l_quantity) over (partition by l_partkey) sd from lineitem),
    kp as (select k, v from st where n <= 3 or (v >= m - 2 * sd and v <= m + 2 * sd)),
    a as (select k, list_sort(list(v)) arr from kp group by k)
    select k, arr[len(arr) // 2 + 1] as med from a""")
def sigma_clipped_median(spark, sf_dir):
    return stack.sigma_clipped_median(_t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity").select(F.col("l_partkey").alias("k"), F.col("median").alias("med"))


@query("""
    with t as (select user_id, value v, row_number() over (partition by user_id order by ts, event_id) rn from events),
    r as (select user_id, v rv from t where rn = 1),
    w as (select t.user_id, t.v, exp(-power(t.v - r.rv, 2) / (2 * 400.0::double)) w from t join r on t.user_id = r.user_id)
    select user_id, round(sum(w * v) / sum(w), 4) as m from w group by user_id""")
def robust_merge(spark, sf_dir):
    return stack.robust_mean(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 20.0).select("user_id", F.round("mean", 4).alias("m"))


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as mean, round(stddev_pop(l_extendedprice), 4) as std from lineitem group by all")
def lab_stats(spark, sf_dir):
    return color.channel_stats(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""
    select l_orderkey, l_quantity as best, l_linenumber as line, l_partkey as part
    from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) rn from lineitem where l_quantity > 0) where rn = 1""")
def ownership_argmax(spark, sf_dir):
    best = stack.owner(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey"], ["l_quantity", "l_linenumber", "l_partkey"])
    return best.select("l_orderkey", F.col("l_quantity").alias("best"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))


@query("""
    with f as (select user_id fr, round(avg(value), 6) mo from events group by 1),
    k as (select fr, mo, row_number() over (order by mo, fr) rn, count(*) over () n from f),
    md as (select mo med from k where rn = n // 2 + 1),
    j as (select fr, mo, rn, n, not ((med > 0 and mo > med * 1.2::double) or mo > 60) ok from k cross join md),
    c as (select *, sum(ok::int) over () kept from j)
    select fr, mo, case when kept < 2 and n >= 2 then rn <= 2 else ok end as keep from c""")
def motion_meter(spark, sf_dir):
    frames = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fr")).agg(F.round(F.avg("value"), 6).alias("mo"))
    return stack.meter_motion(frames, "fr", "mo", relative=1.2, absolute=60.0).select("fr", F.col("motion").alias("mo"), "keep")


@query("""
    with f as (select user_id fr, round(avg(value), 6) mo from events group by 1)
    select round(4000000.0::double * least(greatest(1 + 0.08::double * (3 - coalesce(avg(mo) filter (where mo <= 60), 0.0::double)), 0.4::double), 1.5::double), 4) as noise_variance from f""")
def motion_variance(spark, sf_dir):
    frames = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("motion")).withColumn("keep", F.col("motion") <= 60)
    return stack.noise_variance(frames, 4e6).select(F.round("noise_variance", 4).alias("noise_variance"))


@query("""
    select l_returnflag, sum((l_quantity * l_quantity)::bigint)::bigint as xx, sum((l_quantity * l_linenumber)::bigint)::bigint as xy, sum((l_linenumber * l_linenumber)::bigint)::bigint as yy,
           round(sum(l_quantity * l_linenumber) / sum(l_quantity * l_quantity), 8) as slope from lineitem group by 1""")
def normal_equations(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").cast("long").alias("y"))
    sums = stack.normal_equations(lines, ["x", "y"], "y", ["l_returnflag"])
    return sums.select("l_returnflag", F.col("x_x").alias("xx"), F.col("x_rhs").alias("xy"), F.col("y_y").alias("yy"), F.round(F.col("x_rhs") / F.col("x_x"), 8).alias("slope"))


@query("select l_linestatus, round(10 * log10(power(100000.0::double, 2) / avg(power(l_extendedprice - round(l_extendedprice * (1 - l_discount), 2), 2))), 6) as psnr from lineitem group by 1")
def psnr(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    rebuilt = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    return lines.groupBy("l_linestatus").agg(F.round(color.psnr(F.col("l_extendedprice"), rebuilt, 100000.0), 6).alias("psnr"))


@query("""
    with t as (select n_regionkey, count(*)::bigint n, max(c_acctbal) w, min(c_acctbal) lo from customer join nation on c_nationkey = n_nationkey group by 1)
    select n_regionkey, n, round(w * n, 4) as bound, lo from t""")
def canvas_bound(spark, sf_dir):
    joined = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    out = joined.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("w"), F.min("c_acctbal").alias("lo"))
    return out.select("n_regionkey", "n", F.round(F.col("w") * F.col("n"), 4).alias("bound"), "lo")


@query("""
    select l_shipdate::date::varchar as day, min(l_orderkey) as x0, max(l_orderkey) as x1, min(l_linenumber) as y0, max(l_linenumber) as y1 from lineitem where l_discount > 0 group by 1""")
def coverage_bbox(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return geometry.coverage_box(lines, ["day"], "l_orderkey", "l_linenumber", F.col("l_discount") > 0).select("day", "x0", "x1", "y0", "y1")


# tone and colour -------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, trunc(least(greatest(l_extendedprice * 1.37::double, 0), 65535))::int as v from lineitem")
def apply_gain(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", color.apply_gain(F.col("l_extendedprice"), 1.37).alias("v"))


@query("""
    with s as (select s_nationkey k, sum(s_acctbal) b from supplier group by 1), c as (select c_nationkey k, sum(c_acctbal) a from customer group by 1)
    select n_nationkey, round(coalesce(least(greatest(a / nullif(b, 0), 0.25::double), 4.0::double), 1.0::double), 6) as gain
    from nation left join c on n_nationkey = c.k left join s on n_nationkey = s.k""")
def gain_estimate(spark, sf_dir):
    """Customers are samples of the reference, suppliers of the target."""
    target = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(None).cast("double").alias("a"), F.col("s_acctbal").alias("b"))
    reference = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("a"), F.lit(None).cast("double").alias("b"))
    samples = _t(spark, sf_dir, "nation").select("n_nationkey").join(target.unionByName(reference), "n_nationkey", "left")
    return samples.groupBy("n_nationkey").agg(F.round(color.gain_estimate(F.col("a"), F.col("b")), 6).alias("gain"))


@query("""
    with s as (select p_brand, avg(p_retailprice) m, stddev_pop(p_retailprice) sd from part group by 1),
    r as (select m rm, sd rs from s where p_brand = (select min(p_brand) from part))
    select p_partkey, round((p_retailprice - m) * (rs / case when sd <= 1e-6::double then 1.0::double else sd end) + rm, 4) as mapped from part join s using (p_brand) cross join r""")
def reinhard_transfer(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    first = part.agg(F.min("p_brand")).first()[0]
    return color.reinhard_transfer(part, "p_brand", "p_retailprice", first).select("p_partkey", F.round("mapped", 4).alias("mapped"))


@query("""
    select l_orderkey, l_linenumber, l_partkey, floor(least(greatest(65535 * power(least(l_extendedprice, 65535) / 65535, 0.5::double), 0), 65535) + 0.5::double)::int as bright,
           round(power(least(l_extendedprice, 65535) / 65535, 1.5::double) / (1 + 0.2::double * power(least(l_extendedprice, 65535) / 65535, 1.5::double)), 6) as painterly from lineitem""")
def tone_curve(spark, sf_dir):
    v = F.least(F.col("l_extendedprice"), F.lit(65535.0))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", color.gamma_curve(v, 0.5).alias("bright"), F.round(color.painterly_curve(v), 6).alias("painterly"))


@query("""
    with w as (select p_partkey, exp(-power(p_size / 50.0::double - 0.5::double, 2) / (2 * 0.2::double * 0.2::double)) a, exp(-power(p_retailprice / 2500.0::double - 0.5::double, 2) / (2 * 0.2::double * 0.2::double)) b from part)
    select p_partkey, round(case when a + b > 1e-6::double then a / (a + b) else 0.5::double end, 6) as w from w""")
def exposure_weights(spark, sf_dir):
    a, b = color.well_exposedness(F.col("p_size") / 50.0), color.well_exposedness(F.col("p_retailprice") / 2500.0)
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(color.fusion_weight(a, b), 6).alias("w"))


_LIN = lambda c: f"case when {c} <= 0.04045::double then {c} / 12.92::double else power(({c} + 0.055::double) / 1.055::double, 2.4::double) end"
_LABF = lambda c: f"case when {c} > power(6.0::double / 29, 3) then cbrt({c}) else {c} / (3 * power(6.0::double / 29, 2)) + 4.0::double / 29 end"


@query(f"""
    with p as (select p_partkey, p_size * 1000.0::double / 65535 r, p_retailprice * 20 / 65535 g, (p_partkey % 65536) / 65535.0::double b from part),
    l as (select p_partkey, {_LIN("r")} r, {_LIN("g")} g, {_LIN("b")} b from p),
    x as (select p_partkey, (0.4124564::double * r + 0.3575761::double * g + 0.1804375::double * b) / 0.95047::double x, 0.2126729::double * r + 0.7151522::double * g + 0.0721750::double * b y,
                 (0.0193339::double * r + 0.1191920::double * g + 0.9503041::double * b) / 1.08883::double z from l),
    f as (select p_partkey, {_LABF("x")} x, {_LABF("y")} y, {_LABF("z")} z from x)
    select p_partkey, round(116 * y - 16, 4) as l, round(500 * (x - y), 4) as a, round(200 * (y - z), 4) as b from f""")
def rgb_to_lab(spark, sf_dir):
    r, g, b = F.col("p_size") * 1000.0, F.col("p_retailprice") * 20, (F.col("p_partkey") % 65536).cast("double")
    lab = color.rgb_to_lab(r, g, b)
    return _t(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 4).alias(n) for c, n in zip(lab, ("l", "a", "b"), strict=True)))


@query("select p_partkey, p_size * 1000 as r, p_size * 500 as g, p_size * 250 as b from part")
def lab_round_trip(spark, sf_dir):
    """RGB to Lab and back gives the input; values are moved off the edges at which truncation turns."""
    part = _t(spark, sf_dir, "part")
    rgb = [F.col("p_size") * k for k in (1000.0, 500.0, 250.0)]
    lab = part.select("p_partkey", *(c.alias(n) for c, n in zip(color.rgb_to_lab(*[c + 0.5 for c in rgb]), "lab", strict=True)))
    return lab.select("p_partkey", *(c.alias(n) for c, n in zip(color.lab_to_rgb(F.col("l"), F.col("a"), F.col("b")), "rgb", strict=True)))


@query("""
    with c as (select l_orderkey, l_linenumber, l_partkey, ((2492765332::bigint >> (((((l_orderkey * 2) & 14) | (l_linenumber & 1)) * 2)::bigint)) & 3)::bigint as color,
                      greatest(l_quantity::int * 1000 - 64, 0) as v from lineitem)
    select l_orderkey, l_linenumber, l_partkey, color, trunc(least(v * [1.8::double, 1.0::double, 1.5::double, 1.0::double][color + 1], 65535))::int as v from c""")
def bayer_balance(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumn("color", color.bayer_color(F.col("l_orderkey"), F.col("l_linenumber"), 0x94949494))
    v = color.black_level(F.col("l_quantity").cast("int") * 1000, 64)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "color", color.white_balance(v, F.col("color"), [1.8, 1.0, 1.5, 1.0]).alias("v"))


@query("""
    select p_partkey, trunc(least(greatest(0.299::double * p_size + 0.587::double * (p_partkey % 256) + 0.114::double * (p_size * 2), 0), 255))::int as gray, (p_size * 257)::int as wide, ((p_size * 999) >> 8)::int as narrow,
           trunc(least(greatest(1.2::double * p_size * 500 - 0.1::double * p_size * 300 - 0.1::double * p_size + 10, 0), 65535))::int as r from part""")
def gray_widen_narrow(spark, sf_dir):
    s = F.col("p_size")
    matrix = [[1.2, -0.1, -0.1, 10.0]]
    r = color.color_matrix(s * 500, s * 300, s, matrix)[0]
    return _t(spark, sf_dir, "part").select("p_partkey", color.gray(s, F.col("p_partkey") % 256, s * 2).alias("gray"), color.widen(s).alias("wide"), color.narrow(s * 999).alias("narrow"), r.alias("r"))


@query("select o_orderkey, round(1 - 0.35::double * (power(o_custkey % 640 - 319.5::double, 2) + power(o_orderkey % 480 - 239.5::double, 2)) / (319.5::double * 319.5::double + 239.5::double * 239.5::double), 6) as v from orders")
def vignette(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(color.vignette(F.col("o_custkey") % 640, F.col("o_orderkey") % 480, 640, 480), 6).alias("v"))


# matching and pairs ----------------------------------------------------------------------------

_BITS = "list_sum(list_transform(range(0, 32), lambda i: case when embedding[i + 1 + {}] > 0 then (1::bigint << i::bigint) else 0::bigint end))::bigint"


@query(f"""
    with d as (select vec_id, label, {_BITS.format(0)} d0, {_BITS.format(32)} d1 from embeddings),
    p as (select a.vec_id a, b.vec_id b, (bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)))::int h from d a join d b on b.label = a.label + 1),
    r as (select *, row_number() over (partition by a order by h, b) rn, lead(h) over (partition by a order by h, b) h2 from p)
    select a, b, h from r where rn = 1 and (h2 is null or h < 0.95::double * h2)""")
def descriptor_match(spark, sf_dir):
    """Images are labels; each is matched with the next by the two nearest of 64-bit descriptors."""
    d = _t(spark, sf_dir, "embeddings").select("vec_id", "label", match.sign_bits(F.col("embedding"), 0).alias("d0"), match.sign_bits(F.col("embedding"), 32).alias("d1"))
    a = d.select(F.col("vec_id").alias("a"), (F.col("label") + 1).alias("label"), F.col("d0").alias("a0"), F.col("d1").alias("a1"))
    pairs = a.join(d.withColumnRenamed("vec_id", "b"), "label").select("a", "b", match.hamming([F.col("a0"), F.col("a1")], [F.col("d0"), F.col("d1")]).alias("h"))
    return match.ratio_matches(pairs, ["a"], "b", "h", ratio=0.95).select("a", "b", "h")


@query("""
    select a.n_nationkey as a, b.n_nationkey as b, a.n_nationkey || ':' || b.n_nationkey as pair from nation a join nation b on a.n_nationkey < b.n_nationkey
    where not exists (select 1 from supplier s where s.s_nationkey = a.n_nationkey and s.s_suppkey % 25 = b.n_nationkey)""")
def pair_seed(spark, sf_dir):
    done = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b")).distinct()
    return match.seed_pairs(_t(spark, sf_dir, "nation"), "n_nationkey", done).select("a", "b", match.pair_key(F.col("a"), F.col("b")).alias("pair"))


@query("""
    select event_id, try_cast(split_part(k, ':', 1) as bigint) as a, try_cast(split_part(k, ':', 2) as bigint) as b
    from (select event_id, case when event_id % 7 = 0 then event_type || ':1' else least(user_id, event_id) || ':' || greatest(user_id, event_id) end k from events)
    where try_cast(split_part(k, ':', 1) as bigint) is not null""")
def pair_parse(spark, sf_dir):
    key = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit(":1"))).otherwise(match.pair_key(F.col("user_id"), F.col("event_id")))
    return _t(spark, sf_dir, "events").select("event_id", match.parse_pair(key).alias("p")).where("p is not null").select("event_id", "p.a", "p.b")


# geometry --------------------------------------------------------------------------------------


@query("""
    select 'C_' || (x // 256) || '_' || (y // 256) as id, x::int as x_offset, y::int as y_offset, least(256, 1000 - x)::int as width, least(256, 700 - y)::int as height
    from (select unnest(range(0, 1000, 256)) x) cross join (select unnest(range(0, 700, 256)) y)""")
def chunk_grid(spark, sf_dir):
    return geometry.chunk_grid(spark, 1000, 700, 256)


@query("""
    with im as (select o_orderkey id, (o_custkey % 1000)::double x0, (o_orderkey % 700)::double y0 from orders),
    ck as (select x, y from (select unnest(range(0, 1024, 256)) x) cross join (select unnest(range(0, 768, 256)) y))
    select x::int as x, y::int as y, count(*)::bigint as n, min(id) as mn from im join ck on x0 < x + 256 and x0 + 40 > x and y0 < y + 256 and y0 + 30 > y group by all""")
def overlap_cull(spark, sf_dir):
    x0, y0 = (F.col("o_custkey") % 1000).cast("double"), (F.col("o_orderkey") % 700).cast("double")
    boxes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 30).alias("y1"))
    met = geometry.overlap(boxes, geometry.chunk_grid(spark, 1024, 768, 256), 256)
    return met.groupBy(F.col("x_offset").alias("x"), F.col("y_offset").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("image").alias("mn"))


@query("""
    with p as (select o_orderkey, (o_custkey % 1000)::double x, (o_orderkey % 700)::double y from orders)
    select o_orderkey, round((1.01::double * x + 0.02::double * y + 3) / (0.00001::double * x + 0.00002::double * y + 1), 6) as u,
           round((-0.03::double * x + 0.99::double * y - 5) / (0.00001::double * x + 0.00002::double * y + 1), 6) as v from p""")
def warp_points(spark, sf_dir):
    h = (1.01, 0.02, 3.0, -0.03, 0.99, -5.0, 0.00001, 0.00002, 1.0)
    u, v = geometry.project(h, (F.col("o_custkey") % 1000).cast("double"), (F.col("o_orderkey") % 700).cast("double"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("select o_orderkey, round((o_custkey % 1000)::double, 4) as x, round((o_orderkey % 700)::double, 4) as y, round(0.0::double, 4) as err from orders")
def warp_inverse(spark, sf_dir):
    """Points there and back by a matrix and its inverse, and the reprojection error of the exact image."""
    h = [F.lit(c) for c in (1.01, 0.02, 3.0, -0.03, 0.99, -5.0, 0.00001, 0.00002, 1.0)]
    x, y = (F.col("o_custkey") % 1000).cast("double"), (F.col("o_orderkey") % 700).cast("double")
    there = _t(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), y.alias("y"), geometry.invert(h).alias("inv")).withColumn("u", geometry.project(h, F.col("x"), F.col("y"))[0]).withColumn("v", geometry.project(h, F.col("x"), F.col("y"))[1])
    back = geometry.project([F.col("inv")[k] for k in range(9)], F.col("u"), F.col("v"))
    err = geometry.reprojection_error(h, F.col("x"), F.col("y"), F.col("u"), F.col("v"))
    return there.select("o_orderkey", F.round(back[0], 4).alias("x"), F.round(back[1], 4).alias("y"), F.round(err, 4).alias("err"))


@query("""
    with c as (select o_orderkey, least(x, x + 60, x + 0.5::double * 40, x + 60 + 0.5::double * 40) x0, greatest(x, x + 60, x + 0.5::double * 40, x + 60 + 0.5::double * 40) x1 from (select o_orderkey, (o_custkey % 100)::double x from orders))
    select o_orderkey, round(x0, 4) as x0, round(x1, 4) as x1 from c""")
def corner_box(spark, sf_dir):
    h = [F.lit(1.0), F.lit(0.5), (F.col("o_custkey") % 100).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    x0, _, x1, _ = geometry.corner_box(h, F.lit(60.0), F.lit(40.0))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(x0, 4).alias("x0"), F.round(x1, 4).alias("x1"))


@query("""
    select o_orderkey, least((o_custkey % 330) // 16, 19)::int as tile, trunc((o_orderkey % 5000) * 0.3125::double)::int as place, greatest(trunc(16 * 0.3125::double / (1 + o_custkey % 9)), 1)::int as size,
           case when o_custkey % 64 >= 16 then 4096 when o_custkey % 64 >= 8 then 2048 else 1024 end::int as chunk from orders""")
def tiles_and_placement(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    place, _ = geometry.chunk_placement(o % 5000, F.lit(16), 0.3125)
    _, size = geometry.chunk_placement(o, F.lit(16) / (1 + c % 9), 0.3125)
    return _t(spark, sf_dir, "orders").select("o_orderkey", geometry.tile_of(c % 330, 16, 20).alias("tile"), place.alias("place"), size.alias("size"), geometry.recommended_chunk(c % 64).alias("chunk"))


# stencils along a signal -----------------------------------------------------------------------

_SIGNAL = "with t as (select user_id, event_id, value, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 i from events)"


def _signal(spark, sf_dir):
    return series.numbered(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type"), ["user_id"], ["ts", "event_id"])


@query("""
    with t as (select user_id, event_id, round(value * 100)::bigint v, ts from events),
    x as (select event_id, v, lag(v, 1) over w l1, lag(v, 2) over w l2, lead(v, 1) over w r1, lead(v, 2) over w r2 from t window w as (partition by user_id order by ts, event_id))
    select event_id, (coalesce(l2, l1, v) + 4 * coalesce(l1, v) + 6 * v + 4 * coalesce(r1, v) + coalesce(r2, r1, v))::bigint as y16 from x""")
def blur5(spark, sf_dir):
    signal = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))
    return series.blur5(signal, ["user_id"], ["ts", "event_id"], "v").select("event_id", "y16")


@query(_SIGNAL + """, v as (select user_id, event_id, i, round(value * 100)::bigint v from t),
    x as (select event_id, i, v, lag(v, 1) over w l1, lag(v, 2) over w l2, lead(v, 1) over w r1, lead(v, 2) over w r2 from v window w as (partition by user_id order by i))
    select event_id, (i // 2)::bigint as half, (coalesce(l2, l1, v) + 4 * coalesce(l1, v) + 6 * v + 4 * coalesce(r1, v) + coalesce(r2, r1, v))::bigint as y16 from x where i % 2 = 0""")
def downsample_blurred(spark, sf_dir):
    signal = _signal(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("long"))
    return series.blur_downsample2(signal, ["user_id"], ["ts", "event_id"], "i", "v").select("event_id", F.col("i").cast("long").alias("half"), "y16")


@query(_SIGNAL + """, k as (select user_id, count(*) n from t group by 1), g as (select user_id, n, unnest(range(0, 2 * n)) x from k),
    p as (select *, (x * (n - 1)) // (2 * n - 1) lo, ((x * (n - 1)) % (2 * n - 1))::double / (2 * n - 1) w from g)
    select p.user_id, p.x::bigint as x, round(a.value * (1 - w) + b.value * w, 4) as value
    from p join t a on a.user_id is not distinct from p.user_id and a.i = p.lo join t b on b.user_id is not distinct from p.user_id and b.i = least(p.lo + 1, p.n - 1)""")
def upsample_signal(spark, sf_dir):
    return series.upsample(_signal(spark, sf_dir), ["user_id"], "i", "value").select("user_id", "x", F.round("value", 4).alias("value"))


@query(_SIGNAL + """, g as (select user_id, i, event_type = 'error' gap from t),
    a as (select user_id, i, max(case when gap then i end) over (partition by user_id order by i rows unbounded preceding) l, min(case when gap then i end) over (partition by user_id order by i rows between current row and unbounded following) r from g)
    select user_id, i, least(coalesce(i - l, 1000000), coalesce(r - i, 1000000))::bigint as d from a""")
def coverage_distance_1d(spark, sf_dir):
    return series.gap_distance(_signal(spark, sf_dir), ["user_id"], "i", F.col("event_type") == "error").select("user_id", "i", F.col("d").cast("long").alias("d"))


@query(_SIGNAL + """, f as (select user_id, i, value > 20 f from t), g as (select user_id, f, i - row_number() over (partition by user_id, f order by i) grp from f)
    select user_id, max(c)::bigint as run from (select user_id, grp, count(*) c from g where f group by 1, 2) group by 1 having max(c) >= 3""")
def fast_run(spark, sf_dir):
    return series.longest_run(_signal(spark, sf_dir), ["user_id"], "i", F.col("value") > 20, 3)


@query(_SIGNAL + """, z as (select user_id, (i // 16)::int tile, i % 16 x, value v from t), k as (select unnest(range(0, 16)) k)
    select user_id, tile, k::int as k, round(power(sum(v * cos(2 * pi() * k * x / 16)), 2) + power(sum(v * sin(2 * pi() * k * x / 16)), 2), 2) as power from z cross join k group by 1, 2, 3""")
def tile_dft(spark, sf_dir):
    return series.tile_power(_signal(spark, sf_dir), ["user_id"], "i", "value").select("user_id", "tile", "k", F.round("power", 2).alias("power"))


@query("""
    with s as (select event_type, hour(ts)::int h, count(*) n from events group by 1, 2), o as (select unnest(range(-3, 4)) d),
    j as (select a.h, o.d, sum(abs(a.n - b.n)) sad from (select h, n from s where event_type = 'click') a cross join o join (select h, n from s where event_type = 'view') b on b.h = a.h + o.d group by 1, 2)
    select h, d::int as d from (select *, row_number() over (partition by h order by sad, abs(d), d) rn from j) where rn = 1""")
def block_match_1d(spark, sf_dir):
    counts = _t(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    click, view = (counts.where(F.col("event_type") == k).select(F.lit(0).alias("one"), "h", "n") for k in ("click", "view"))
    return series.block_match(click, view, ["one"], "h", "n", 3).select("h", "d")


@query("""
    with g as (select l_linenumber::int x, month(l_shipdate)::int y, sum(l_quantity::bigint)::bigint s from lineitem group by 1, 2)
    select a.x, a.y, round(avg(b.s), 4) as smooth from g a join g b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2""")
def smooth_field(spark, sf_dir):
    grid = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("x"), F.month("l_shipdate").alias("y")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    return series.smooth_grid(grid, "x", "y", "s").select("x", "y", F.round("smooth", 4).alias("smooth"))


# catalog ---------------------------------------------------------------------------------------

_STATUS = "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PENDING' else 'RUNNING' end"


def _tasks(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("RUNNING")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_custkey"))


@query(f"""
    with t as (select o_orderkey id, {_STATUS} st, o_orderpriority stage from orders), r as (select id, stage, case when st = 'RUNNING' then 'PENDING' else st end st from t)
    select stage, count(*)::bigint as total, sum((st = 'COMPLETED')::int)::bigint as done, round(avg((st = 'COMPLETED')::int), 6) as progress, bool_and(st = 'COMPLETED') as complete, min(case when st <> 'COMPLETED' then id end) as next_id from r group by 1""")
def task_resume(spark, sf_dir):
    return catalog.progress(catalog.reclaim(_tasks(spark, sf_dir))).withColumn("progress", F.round("progress", 6))


@query(f"select o_orderkey as task_id, o_orderpriority as stage, {_STATUS} as status from orders where o_orderstatus <> 'F'")
def task_pending(spark, sf_dir):
    return catalog.pending(_tasks(spark, sf_dir)).select("task_id", "stage", "status")


@query("""
    select s_suppkey as id, coalesce(c_acctbal, s_acctbal) as gain, s_nationkey as kind from supplier left join customer on c_custkey = s_suppkey and c_acctbal > 0
    union all select c_custkey, c_acctbal, c_nationkey from customer where c_acctbal > 0 and c_custkey not in (select s_suppkey from supplier)""")
def catalog_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("gain"), F.col("s_nationkey").alias("kind"))
    changes = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("gain"), F.col("c_nationkey").alias("kind"))
    changes = changes.join(base.select("id", F.lit(1).alias("known")), "id", "left").select("id", "gain", F.when(F.col("known").isNull(), F.col("kind")).alias("kind"))
    return catalog.upsert(base, changes, ["id"])


@query("select o_custkey as k, 'base' as origin from orders group by 1 union all select c_custkey, 'seed' from customer where c_custkey not in (select o_custkey from orders)")
def task_create_if_absent(spark, sf_dir):
    base = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("base").alias("origin")).distinct()
    seeds = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("seed").alias("origin"))
    return catalog.create_if_absent(base, seeds, ["k"])


@query("""
    select o_custkey as k, o_orderkey as v from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)
    union all select c_custkey, c_nationkey::bigint from customer where c_acctbal < 0""")
def replace_contributors(spark, sf_dir):
    base = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    rows = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    return catalog.replace_partition(base, rows, "k")


@query("""
    with met as (select distinct l_partkey, l_suppkey from lineitem), r as (select *, row_number() over (partition by l_partkey order by l_suppkey) n from met)
    select l_partkey as chunk_id, l_suppkey as image_id, s_suppkey * 10 as blob_id, s_acctbal as payload from r join supplier on s_suppkey = l_suppkey where n <= 32 and s_acctbal > 0 and s_nationkey <> 7""")
def contributor_gather(spark, sf_dir):
    """The first 32 images of each chunk, with the blobs of those whose colour is done and there."""
    met = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("image_id")).distinct()
    supplier = _t(spark, sf_dir, "supplier")
    done = F.when(F.col("s_nationkey") != 7, "COMPLETED").otherwise("RUNNING")
    tasks = supplier.select(F.lit("OPTIMIZE").alias("stage"), F.lit("color").alias("unit_kind"), F.col("s_suppkey").cast("string").alias("unit_key"), done.alias("status"), (F.col("s_suppkey") * 10).alias("output_blob_id"))
    payloads = supplier.where("s_acctbal > 0").select((F.col("s_suppkey") * 10).alias("blob_id"), F.col("s_acctbal").alias("payload"))
    return catalog.contributors(met, tasks, payloads).select("chunk_id", "image_id", "blob_id", "payload")


@query("select event_id, json_extract_string(props, '$.k')::varchar as k, case when try_cast(json_extract_string(props, '$.k') as bigint) is null then 'IDLE' else 'RUNNING' end as st from events")
def json_checkpoint(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    state = catalog.parse_enum(F.when(k.try_cast("long").isNotNull(), "RUNNING").otherwise("none"), ("IDLE", "RUNNING"), "IDLE")
    return _t(spark, sf_dir, "events").select("event_id", k.alias("k"), state.alias("st"))


@query("""
    select lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as ext, (lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) in ('jpg', 'jpeg', 'png', 'html'))::boolean as known, count(*)::bigint as n from pages group by 1, 2""")
def file_kind(spark, sf_dir):
    from tessera.sources import raster_files

    ext = raster_files.extension(F.col("url"))
    return _t(spark, sf_dir, "pages").groupBy(ext.alias("ext"), ext.isin("jpg", "jpeg", "png", "html").alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    select k, n::bigint as n, trunc(sum_x * 1.0::double)::bigint as sum_x from (select o_orderpriority as k, count(*) n, sum(o_custkey)::bigint sum_x from
      (select *, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) r from orders) where r <= 2000 group by 1)""")
def first_features(spark, sf_dir):
    """The cap of features an image keeps: the first 2000 in order, and what they add up to."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    first = _t(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).where("r <= 2000")
    return first.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("sum_x"))


@query("""
    select o_orderkey, (o_custkey % 3 + 1)::int as tiles, (o_custkey % 5 <> 0) as fits, case when o_custkey % 5 <> 0 then round((o_custkey % 3 + 1) * 2 * 0.5::double, 4) end as total from orders""")
def json_offsets(spark, sf_dir):
    """Offset fields as JSON and back; those with too few numbers are rejected."""
    from tessera.sources import blobs

    n = (F.col("o_custkey") % 3 + 1).cast("int")
    numbers = F.array_repeat(F.lit(0.5), F.when(F.col("o_custkey") % 5 == 0, 2 * n - 1).otherwise(2 * n).cast("int"))
    text = _t(spark, sf_dir, "orders").select("o_orderkey", n.alias("tiles"), blobs.offsets_to_json(n, F.lit(1), numbers).alias("t"))
    back = text.withColumn("s", blobs.offsets_from_json(F.col("t")))
    return back.select("o_orderkey", "tiles", F.col("s").isNotNull().alias("fits"), F.round(F.aggregate("s.offsets", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("""
    select stage, unit_kind, count(*)::bigint as n from (
      select 'OPTIMIZE' stage, 'gain' unit_kind from customer union all select 'OPTIMIZE', 'color' from customer union all select 'OPTIMIZE', 'ba'
      union all select 'INGEST', 'image' from supplier) group by all""")
def seed_tasks(spark, sf_dir):
    images = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    more = catalog.seed_image_tasks(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "INGEST")
    return catalog.seed_optimize_tasks(images).unionByName(more).groupBy("stage", "unit_kind").agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*)::bigint as n, round(sum(value), 4) as total, round(avg(value), 4) as mean from events group by 1, 2")
def stream_windows(spark, sf_dir):
    """Events read as a stream, in hourly windows with a watermark; run to the end of what is there, batch by batch to Parquet."""
    import tempfile
    import uuid

    from tessera.streaming import bursts

    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tessera-stream-')}"
    rows = bursts.into_table(bursts.windowed_mean(stream), ["start", "event_type"], f"{shared.rstrip('/')}/tessera/windows-{uuid.uuid4().hex}")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))
