"""More registered queries: fits, warps and components on cubes, section jobs, point
extraction, and files written from the given tables and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe import sources, streaming
from atlasframe.operators import align, blocks, clean, points, sections, spatial, stats, stencil, tiles
from atlasframe.plans import fixtures as fx
from atlasframe.plans.queries import BY, J24_SQL, J25_SQL, MATRIX, NX, NY, SCALED, SIZE, TURN, query, rounded

IDENTITY = [[float(i == k) for k in range(4)] for i in range(4)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and Spark is one process, below a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Fits

_IMPLANTS = ", g as (select cast(floor(value) as bigint) % 20 as implant_id, x / 4 as x, y * 3 as y, z / 4 as z from points)"


def _implants(s, d) -> DataFrame:
    return fx.points(s, d).selectExpr("cast(floor(value) as bigint) % 20 as implant_id", "x / 4 as x", "y * 3 as y", "z / 4 as z")


@query(_IMPLANTS + """, m as (
  select implant_id, count(*) as n, avg(x) as ox, avg(y) as oy, avg(z) as oz, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(x, z) as c, covar_pop(y, y) as d, covar_pop(y, z) as e, covar_pop(z, z) as f from g group by 1 having count(*) >= 4),
pw as (
  select implant_id, 0 as k, a / (a + d + f) as a, b / (a + d + f) as b, c / (a + d + f) as c, d / (a + d + f) as d, e / (a + d + f) as e, f / (a + d + f) as f from m
  union all select implant_id, k + 1, (a*a + b*b + c*c) / t, (a*b + b*d + c*e) / t, (a*c + b*e + c*f) / t, (b*b + d*d + e*e) / t, (b*c + d*e + e*f) / t, (c*c + e*e + f*f) / t
  from (select *, a*a + d*d + f*f + 2 * (b*b + c*c + e*e) as t from pw where k < 40)),
col as (select implant_id, case when a >= d and a >= f then a when d >= f then b else c end as vx, case when a >= d and a >= f then b when d >= f then d else e end as vy, case when a >= d and a >= f then c when d >= f then e else f end as vz from pw where k = 40),
ax as (select implant_id, vx / l as ax, vy / l as ay, vz / l as az from (select *, sqrt(vx*vx + vy*vy + vz*vz) as l from col)),
h as (select *, case when abs(ax) > 0.9 then 0.0 else 1.0 end as hx, case when abs(ax) > 0.9 then 1.0 else 0.0 end as hy from ax),
u as (select *, -az * hy as ux, az * hx as uy, ax * hy - ay * hx as uz from h),
p as (select *, ux / l as px, uy / l as py, uz / l as pz from (select *, sqrt(ux*ux + uy*uy + uz*uz) as l from u)),
fr as (select p.*, m.n, ox, oy, oz, ay * pz - az * py as qx, az * px - ax * pz as qy, ax * py - ay * px as qz from p join m using (implant_id)),
flat as (select implant_id, g.y - oy as dy, (x - ox) * ax + (y - oy) * ay + (z - oz) * az as t, (x - ox) * px + (y - oy) * py + (z - oz) * pz as g, (x - ox) * qx + (y - oy) * qy + (z - oz) * qz as h from g join fr using (implant_id)),
su as (select implant_id, avg(g*g) as gg, avg(g*h) as gh, avg(h*h) as hh, avg(g * (g*g + h*h)) as gs, avg(h * (g*g + h*h)) as hs, quantile_cont(t, 0.01) as lo, quantile_cont(t, 0.95) as en, quantile_cont(t, 0.99) as hi from flat group by 1),
ce as (select *, (hh * gs - gh * hs) / (2 * (gg * hh - gh * gh)) as cg, (gg * hs - gh * gs) / (2 * (gg * hh - gh * gh)) as ch from su),
fa as (select implant_id, quantile_cont(dy, 0.5) as far from flat join su using (implant_id) where t > en group by 1),
al as (select fr.*, ce.*, case when far < 0 then -1.0 else 1.0 end as s, case when far < 0 then lo else hi end as bottom from fr join ce using (implant_id) left join fa using (implant_id))
select implant_id, n, round(ox + cg * px + ch * qx + bottom * ax, 3) + 0 as cx, round(oy + cg * py + ch * qy + bottom * ay, 3) + 0 as cy, round(oz + cg * pz + ch * qz + bottom * az, 3) + 0 as cz,
  round(s * ax, 4) + 0 as nx, round(s * ay, 4) + 0 as ny, round(s * az, 4) + 0 as nz, round(sqrt(gg + hh + cg * cg + ch * ch), 3) as radius from al""")  # fmt: skip
def g27_fit_cylinders(s, d):
    return rounded(rounded(stats.fit_cylinders(_implants(s, d)), ["cx", "cy", "cz", "radius"], 3), ["nx", "ny", "nz"], 4)


#: Pairs under a map, with noise that the rows' values give.
_NOISE = [("u", "(value % 7 - 3) / 10"), ("v", "(value % 5 - 2) / 10"), ("w", "(value % 11 - 5) / 10")]


def _noisy(m) -> str:
    at = [f"{m[i][0]} * x + {m[i][1]} * y + {m[i][2]} * z + {m[i][3]} + {e} as {n}" for i, (n, e) in enumerate(_NOISE)]
    return f", pairs as (select point_id, x, y, z, {', '.join(at)} from points)"


def _noisy_pairs(s, d, m) -> DataFrame:
    at = [F.expr(f"{m[i][0]} * x + {m[i][1]} * y + {m[i][2]} * z + {m[i][3]} + {e}").alias(n) for i, (n, e) in enumerate(_NOISE)]
    return fx.points(s, d).select("point_id", "x", "y", "z", *at)


def _entries(s, m) -> DataFrame:
    return s.createDataFrame([(i, k, round(float(v), 5) + 0.0) for i, row in enumerate(m[:3]) for k, v in enumerate(row)], "i int, k int, value double")


#: Least squares by the inverse of the 3 x 3 covariance of x, y, z.
_AFFINE = """, c as (select avg(x) as mx, avg(y) as my, avg(z) as mz, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(x, z) as c, covar_pop(y, y) as d, covar_pop(y, z) as e, covar_pop(z, z) as f from pairs),
inv as (select *, (d*f - e*e) / t as ia, (c*e - b*f) / t as ib, (b*e - c*d) / t as ic, (a*f - c*c) / t as id, (b*c - a*e) / t as ie, (a*d - b*b) / t as if_ from (select *, a * (d*f - e*e) - b * (b*f - c*e) + c * (b*e - c*d) as t from c)),
long as (select 0 as i, x, y, z, u as o from pairs union all select 1, x, y, z, v from pairs union all select 2, x, y, z, w from pairs),
sx as (select i, avg(o) as mo, covar_pop(x, o) as p, covar_pop(y, o) as q, covar_pop(z, o) as r from long group by 1),
co as (select i, mo, mx, my, mz, ia*p + ib*q + ic*r as cx, ib*p + id*q + ie*r as cy, ic*p + ie*q + if_*r as cz from sx, inv)
select i, k, round(case k when 0 then cx when 1 then cy when 2 then cz else mo - cx*mx - cy*my - cz*mz end, 5) + 0 as value from co, (values (0), (1), (2), (3)) as kk(k)"""

#: The best turn by the greatest eigenvector of the 4 x 4 matrix of covariances (powers by squaring).
_TURN = """, s as (select avg(x) as mx, avg(y) as my, avg(z) as mz, avg(u) as mu, avg(v) as mv, avg(w) as mw, covar_pop(x, u) as xx, covar_pop(x, v) as xy, covar_pop(x, w) as xz, covar_pop(y, u) as yx, covar_pop(y, v) as yy, covar_pop(y, w) as yz,
  covar_pop(z, u) as zx, covar_pop(z, v) as zy, covar_pop(z, w) as zz, var_pop(x) + var_pop(y) + var_pop(z) as spread from pairs),
n as (select [xx + yy + zz, yz - zy, zx - xz, xy - yx, yz - zy, xx - yy - zz, xy + yx, zx + xz, zx - xz, xy + yx, yy - xx - zz, yz + zy, xy - yx, zx + xz, yz + zy, zz - xx - yy] as m from s),
pw as (select 0 as step, list_transform(range(16), lambda i: (m[i + 1] + case when i % 5 = 0 then l else 0 end) / l) as p from (select m, sqrt(list_sum(list_transform(m, lambda v: v * v))) as l from n)
  union all select step + 1, list_transform(q, lambda v: v / (q[1] + q[6] + q[11] + q[16])) from (select step, list_transform(range(16), lambda i: list_sum(list_transform(range(4), lambda k: p[4 * (i // 4) + k + 1] * p[4 * k + i % 4 + 1]))) as q from pw where step < 40)),
col as (select list_transform(range(4), lambda k: p[4 * k + big]) as v from (select p, case when p[1] >= p[6] and p[1] >= p[11] and p[1] >= p[16] then 1 when p[6] >= p[11] and p[6] >= p[16] then 2 when p[11] >= p[16] then 3 else 4 end as big from pw where step = 40)),
q as (select list_transform(v, lambda t: t / sqrt(list_sum(list_transform(v, lambda o: o * o)))) as q from col),
r as (select [1 - 2 * (q[3]*q[3] + q[4]*q[4]), 2 * (q[2]*q[3] - q[1]*q[4]), 2 * (q[2]*q[4] + q[1]*q[3]), 2 * (q[2]*q[3] + q[1]*q[4]), 1 - 2 * (q[2]*q[2] + q[4]*q[4]), 2 * (q[3]*q[4] - q[1]*q[2]), 2 * (q[2]*q[4] - q[1]*q[3]), 2 * (q[3]*q[4] + q[1]*q[2]), 1 - 2 * (q[2]*q[2] + q[3]*q[3])] as r,
  {scale} as scale, s.* from q, n, s),
ij as (select i, k, case when k < 3 then scale * r[3 * i + k + 1] else [mu, mv, mw][i + 1] - scale * (r[3 * i + 1] * mx + r[3 * i + 2] * my + r[3 * i + 3] * mz) end as value from r, (values (0), (1), (2)) as ii(i), (values (0), (1), (2), (3)) as kk(k))
select i, k, round(value, 5) + 0 as value from ij"""
_SCALE = "list_sum(list_transform(range(16), lambda i: m[i + 1] * q[i // 4 + 1] * q[i % 4 + 1])) / spread"


@query(_noisy(MATRIX) + _AFFINE)
def g23_fit_affine(s, d):
    return _entries(s, stats.fit_affine(_noisy_pairs(s, d, MATRIX)))


@query(_noisy(SCALED) + _TURN.replace("{scale}", _SCALE))
def g24_fit_similarity(s, d):
    return _entries(s, stats.fit_similarity(_noisy_pairs(s, d, SCALED)))


@query(_noisy(TURN) + _TURN.replace("{scale}", "1.0"))
def g24_fit_rigid(s, d):
    return _entries(s, stats.fit_rigid(_noisy_pairs(s, d, TURN)))


@query(_noisy(MATRIX) + _AFFINE)
def a7_live_fit(s, d):
    pairs = _noisy_pairs(s, d, MATRIX).withColumn("view_id", F.lit(1))
    side = lambda name, cols: pairs.select("view_id", F.col("point_id").alias("ordinal"), F.lit(name).alias("side"), *(F.col(c).alias(k) for c, k in zip(cols, "xyz")))
    return _entries(s, align.live_fit(side("sample", "xyz").unionByName(side("atlas", "uvw")), None)[0])


@query()
def a9_trace_implants(s, d):
    """Regions below the bottom of each implant; the intensities below it are g28's."""
    return align.trace_implants(_implants(s, d).withColumn("y", F.col("y") / 3), fx.annotation(s, d), fx.voxels(s, d), SIZE, [0.0, 2.0, 4.0])[0]


# Cubes


@query(J24_SQL)
def j24_warp_cubes(s, d):
    move = [[1, 0, 0, 1.25], [0, 1, 0, 0.5], [0, 0, 1, 0], [0, 0, 0, 1]]
    return rounded(blocks.warp(blocks.volume(fx.voxels(s, d), 16), move, SIZE).voxels(), ["value"], 6)


@query("""select v.sample_id, v.channel, g.y, g.x, g.z, coalesce(w.value, -1.0) as value from grid g cross join (select distinct sample_id, channel from voxels) v
left join voxels w on w.sample_id = v.sample_id and w.channel = v.channel and w.y = g.y - 2 and w.x = g.x + 1 and w.z = 33 - g.z""")
def j24_warp_nearest_cubes(s, d):
    move = [[1, 0, 0, 2.25], [0, 1, 0, -1.25], [0, 0, -1, 33.0], [0, 0, 0, 1]]
    return blocks.warp(blocks.volume(fx.voxels(s, d), 16), move, SIZE, "nearest", -1.0).voxels()


@query(J25_SQL)
def j25_warp_field_cubes(s, d):
    return rounded(blocks.warp(blocks.volume(fx.voxels(s, d), 16), IDENTITY, SIZE, field=fx.field(s, d)).voxels(), ["value"], 5)


@query()
def w7_components_in_tiles(s, d):
    mask = fx.voxels(s, d).where("value > 700").select(*BY, "y", "x", "z", "value")
    return stats.component_stats(blocks.connected_components(mask, BY, edge=16), [*BY, "component"]).drop("component")


@query()
def g17_largest_component(s, d):
    mask = fx.voxels(s, d).where("value > 700").select(*BY, "y", "x", "z", "value")
    return stencil.largest_component(blocks.connected_components(mask, BY, edge=16), BY).select(*BY, "y", "x", "z")


@query()
def d7_candidate_views_cubes(s, d):
    c = clean.keep_in_volume(fx.cells(s, d), (NX, NY, SIZE[2])).withColumn("cell_id", F.xxhash64("x", "y", "z", "intensity", "diameter"))
    return blocks.candidate_views(c.dropDuplicates(["cell_id"]), blocks.volume(fx.voxels(s, d), 16, size=SIZE), 1)


@query("""select v.sample_id, v.channel, v.y, v.x, v.z, round(quantile_cont(w.value, 0.5), 4) as value from voxels v join voxels w on w.sample_id = v.sample_id and w.channel = v.channel and w.z = v.z and abs(w.y - v.y) <= 1 and abs(w.x - v.x) <= 1 group by v.sample_id, v.channel, v.y, v.x, v.z""")
def w8_median_filter_cubes(s, d):
    return rounded(blocks.rank_filter(blocks.volume(fx.voxels(s, d), 16, size=SIZE), 1).voxels(), ["value"])


# Points and sections


def _cubes(s, d) -> blocks.Volume:
    return blocks.volume(fx.voxels(s, d), 16, size=SIZE)


@query()
def d2_bandpass(s, d):
    band = blocks.filtered(_cubes(s, d), 8, lambda a: tiles.bandpass(a, 6.0, 1.0))
    return rounded(band.voxels(), ["value"], 3)


@query()
def d3_signal_to_background(s, d):
    return rounded(blocks.filtered(_cubes(s, d), 8, lambda a: tiles.signal_to_background(a, 2.0)[1]).voxels(), ["value"], 3)


@query()
def d10_extract_points_gradient(s, d):
    return points.extract_points_gradient(fx.voxels(s, d), 0.1, SIZE, BY, 0.5).select(*BY, "y", "x", "z")


@query()
def d11_extract_points_std(s, d):
    return points.extract_points_std(fx.voxels(s, d), 1, 0.9, BY).select(*BY, "y", "x", "z")


@query()
def d11_extract_points_highpass(s, d):
    return points.extract_points_highpass(_cubes(s, d), 1.0).select(*BY, "y", "x", "z")


def _planes(s, d) -> DataFrame:
    return tiles.planes_of(fx.voxels(s, d).withColumn("z", F.col("z").cast("int")), NY, NX)


@query()
def d12_section_points(s, d):
    return sections.section_points(_planes(s, d), border=2, neighbours=20)


@query()
def d15_preprocess_planes(s, d):
    return tiles.preprocess_planes(_planes(s, d))


@query()
def d16_build_slice_stack(s, d):
    return sections.build_slice_stack(_planes(s, d), buffer=2, neighbours=20)


@query("select sample_id, channel, z, 40 as ny, 24 as nx, sum(floor(least(value, 65535) + 0.5)) as total from voxels group by all")
def s21_planes_round_trip(s, d):
    """Planes of voxels as bytes, and their voxels again."""
    p = _planes(s, d)
    back = tiles.plane_voxels(p).groupBy(*BY, "z").agg(F.sum("value").alias("total"))
    return p.select(*BY, "z", "ny", "nx").join(back, [*BY, "z"])


@query()
def d9_augment_views(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("view"))
    return points.augment_views(e, parts=4)


@query()
def k1_sample_n(s, d):
    return stats.sample_n(fx.points(s, d), 100, "point_id").select("point_id")


@query()
def k2_sample_fraction(s, d):
    return stats.sample_fraction(fx.points(s, d), 0.25, "point_id").select("point_id")


@query()
def u2_augment_controls(s, d):
    user = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as point_id", "(s_suppkey * 7) % 38 + 0D as x", "(s_suppkey * 5) % 22 + 0D as y", "(s_suppkey * 3) % 30 + 0D as z")
    return spatial.augment_controls(user, fx.points(s, d).select("point_id", "x", "y", "z"), 3.0)


# Files


@query("select region_id, term_set, name, acronym, red, green, blue from terms")
def s9_read_parcel_terms(s, d):
    path = scratch(s, "terms")
    fx.terms(s, d).select("region_id", "term_set", "name", "acronym", "red", "green", "blue").write.option("header", True).csv(path)
    return sources.read_parcel_terms(s, path)


@query("select id, parent_id, cast(null as varchar) as children, name, cast(null as varchar) as acronym from tree")
def s10_read_region_tree(s, d):
    path = scratch(s, "tree")
    fx.tree(s, d).selectExpr("id", "parent_id", "'' as children", "name", "'' as acronym").write.option("header", True).csv(path)
    return sources.read_region_tree(s, path)


@query("select concat('key', cast(p_partkey as varchar)) as key, concat(cast(p_size as varchar), ' mm') as value from part union all select 'reach', '40'", False)
def s16_settings_table(s, d):
    path = scratch(s, "settings")
    lines = s.read.parquet(f"{d}/part.parquet").selectExpr("concat('key', p_partkey, ' = ', p_size, ' mm  % of ', p_partkey) as value")
    lines.unionByName(s.createDataFrame([("# a comment = not a setting",)], "value string")).write.text(path)
    return sources.settings_table(s, path, {"key1": "default", "reach": "40"})


@query("select s_suppkey as original_index, s_nationkey % 3 - 1 as flip_state, 100000 - s_suppkey as new_order_original_index from supplier", False)
def s17_read_slice_decisions(s, d):
    path = scratch(s, "decisions")
    s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as original_index", "s_nationkey % 3 - 1 as flip_state", "100000 - s_suppkey as new_order_original_index").write.option("header", True).csv(path, sep="\t")
    return sources.read_slice_decisions(s, path, 0)


@query("select printf('%.10f %.10f %.10f', x, y, z) as line, count(*) as n from points group by 1")
def s20_write_points(s, d):
    path = scratch(s, "points")
    sources.write_points(fx.points(s, d), path)
    return s.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("select sample_id, channel, cast(floor((z - 1) / 32) as int) as z_block, y, x, z, value from voxels")
def s21_write_volume(s, d):
    path = scratch(s, "volume")
    sources.write_volume(fx.voxels(s, d), path)
    return s.read.parquet(path).select("sample_id", "channel", "z_block", "y", "x", "z", "value")


def _stack(s, d) -> DataFrame:
    """Planes with the number of the file (sample and channel) that they go to."""
    return _planes(s, d).withColumn("file", (F.substring("sample_id", 2, 9).cast("int") * 3 + F.col("channel")))


def _raw_files(s, d) -> str:
    """A folder of headerless files plane<number>, the planes of one sample and channel in order of z."""
    path = scratch(s, "raw")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, folder = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/plane{pdf['file'].iloc[0]}") as f:
            for data in pdf.sort_values("z")["data"]:
                f.write(data)
        return pdf[["file"]].head(1)

    _stack(s, d).groupBy("file").applyInPandas(write, "file int").count()
    return path


_STACK = ", st as (select cast(substr(sample_id, 2) as int) * 3 + channel as file, z, sum(floor(least(value, 65535) + 0.5)) as total from voxels group by all)"


@query(_STACK + " select cast(row_number() over (order by file, z) as int) as z, total from st")
def s1_read_raw_planes(s, d):
    """plane2 comes before plane10."""
    back = tiles.plane_voxels(sources.read_raw_planes(s, _raw_files(s, d), NY, NX))
    return back.groupBy("z").agg(F.sum("value").alias("total"))


@query(_STACK + " select concat('plane', file) as name, count(*) * 1920 as length, 1.0 * count(*) as planes from st group by file")
def s2_plane_catalog(s, d):
    return sources.plane_catalog(s, _raw_files(s, d), NY, NX).select(F.substring_index("path", "/", -1).alias("name"), "length", "planes")


@query("select s_suppkey as id, 1.0 * s_nationkey as x, s_suppkey / 4.0 as y, level, case level when 1 then s_acctbal else s_suppkey + 0.5 end as first, case level when 1 then 2 else 3 end as n from supplier, (values (1), (2)) as l(level) where level = 1 or s_suppkey % 2 = 0", False)
def s14_read_tile_xml(s, d):
    """Tiles as XML, blocks of a level missing in half of them."""
    path = scratch(s, "tiles")
    rows = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as ID", "1.0D * s_nationkey as X", "s_suppkey / 4.0D as Y", "concat(cast(s_acctbal as double), ', 7') as HS_1", "case when s_suppkey % 2 = 0 then concat(s_suppkey, '.5 1,2') end as HS_2")
    rows.write.format("xml").option("rowTag", "Cell").option("rootTag", "Cells").save(path)
    got = sources.read_tile_xml(s, path)
    return got.select(F.col("ID").alias("id"), F.col("X").cast("double").alias("x"), F.col("Y").cast("double").alias("y"), "level", F.get("values", F.lit(0)).alias("first"), F.size("values").alias("n"))


@query("""with t as (select s_suppkey as id, s_suppkey % 3 as kind, s_nationkey / 50.0 as a, s_suppkey / 8.0 as b from supplier),
e as (select id, i, case when kind = 0 then case i when 3 then b when 7 then a when 11 then 2 when 0 then 1 when 5 then 1 when 10 then 1 when 15 then 1 else 0 end
  when kind = 1 then case i when 0 then cos(a) when 1 then -sin(a) when 4 then sin(a) when 5 then cos(a) when 10 then 1 when 15 then 1 when 3 then b + 5 - (cos(a) * 5 - sin(a) * 6) when 7 then 1 + 6 - (sin(a) * 5 + cos(a) * 6) when 11 then 2 else 0 end
  else case i when 0 then 1 + a when 1 then a when 5 then 1 when 6 then -a when 10 then 2 when 15 then 1 when 3 then b + 5 - ((1 + a) * 5 + a * 6) when 7 then 1 + 6 - (6 - a * 7) when 11 then 2 + 7 - 14 else 0 end end as v from t, range(16) as g(i))
select id, cast(i as int) as place, round(v, 5) + 0 as value from e""", False)
def s15_transforms_from_text(s, d):
    """Translations, turns and affine maps about (5, 6, 7), a file each, written by as many tasks as the shuffle has partitions, a folder each."""
    path = scratch(s, "transforms")
    parts = {
        0: ("Translation", "concat_ws(' ', b, a, 2)"),
        1: ("Euler", "concat_ws(' ', 0, 0, a, b, 1, 2)"),
        2: ("Affine", "concat_ws(' ', 1 + a, a, 0, 0, 1, -a, 0, 0, 2, b, 1, 2)"),
    }
    text = " ".join(f"""when {k} then concat('(Transform "{name}Transform")\n(TransformParameters ', {p}, ')\n(CenterOfRotationPoint 5 6 7)')""" for k, (name, p) in parts.items())
    t = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as id", "s_suppkey % 3 as kind", "s_nationkey / 50.0D as a", "s_suppkey / 8.0D as b")
    uri = re.sub(r"^file:/+", "file:///", path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = FileSystem.from_uri(uri)
        for b in batches:
            for lot in b["lot"].unique():
                fs.create_dir(f"{folder}/lot={lot}", recursive=True)
            for lot, i, value in b.itertuples(index=False):
                with fs.open_output_stream(f"{folder}/lot={lot}/id={i}.txt") as f:
                    f.write(value.encode())
            yield b[["id"]]

    fs, folder = FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    # A number of partitions is kept as it is; without one so few bytes would be one task, which writes all files.
    dealt = t.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "id")
    dealt.select(F.spark_partition_id().alias("lot"), "id", F.expr(f"case kind {text} end").alias("value")).mapInPandas(write, "id long").count()
    got = sources.transforms_from_text(s, path)
    got = got.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("long").alias("id"), F.posexplode("m").alias("place", "value"))
    return rounded(got, ["value"], 5)


@query()
def t1_stream_cells(s, d):
    """A stream of files of planes, as many as the shuffle has partitions, a few a batch: cells leave when their tile is whole."""
    source, out, state = (scratch(s, n) for n in ("planes", "stream-cells", "stream-state"))
    _planes(s, d).repartition("z").write.parquet(source)
    stored = s.read.parquet(source).schema
    planes = s.readStream.schema(stored).option("maxFilesPerTrigger", 3).parquet(source)
    cells = streaming.stream_cells(planes, SIZE[2])
    cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(cells.schema).parquet(out)


# Alignment, each slice from where it was moved to


@query("""select z as slice_at, 2.0 as offset_at, 0.0 as error, 0.0 as back from points group by z having count(*) >= 20""")
def a3_best_offset(s, d):
    p = fx.points(s, d).withColumn("z", F.col("z"))
    slices = p.select(F.col("z").cast("string").alias("slice"), (F.col("z") - 2).alias("pos"), "x", "y")
    found = align.best_offset(slices, p, [0.0, 1.0, 2.0, 3.0], 0.4, 20)
    return rounded(found.select(F.col("slice").cast("double").alias("slice_at"), F.col("offset").alias("offset_at"), "error", "back"), ["error", "back"], 6)


@query("""select slice, round(max(cos(0.015)), 4) as m0, round(max(-sin(0.015)), 4) as m1, round(avg(x * cos(0.015) - y * sin(0.015) + 3), 3) as at_x, round(avg(x * sin(0.015) + y * cos(0.015) - 2), 3) as at_y, 0.0 as error from points group by slice having count(*) >= 10""")
def a5_refine_per_slice(s, d):
    """The slices' points turned and moved: the map found must bring their centre to where it went."""
    p = fx.points(s, d).select("slice", "x", "y")
    c, n = float(np.cos(0.015)), float(np.sin(0.015))
    moved = p.select("slice", (F.col("x") * c - F.col("y") * n + 3).alias("x"), (F.col("x") * n + F.col("y") * c - 2).alias("y"))
    found = align.refine_per_slice(p, moved)
    centre = p.groupBy("slice").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    m = lambda i: F.get("m", F.lit(i))
    at = found.join(centre, "slice").select("slice", m(0).alias("m0"), m(1).alias("m1"), (m(0) * F.col("cx") + m(1) * F.col("cy") + m(2)).alias("at_x"), (m(3) * F.col("cx") + m(4) * F.col("cy") + m(5)).alias("at_y"), "error")
    return rounded(rounded(at, ["m0", "m1"]), ["at_x", "at_y", "error"], 3)
