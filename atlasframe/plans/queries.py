"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasframe import functions as fn
from atlasframe import sources, streaming
from atlasframe.operators import align, clean, geometry, lookup, points, regions, series, spatial, stats, stencil, tiles, udf
from atlasframe.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BY = ("sample_id", "channel")
SIZE = fx.SIZE
NY, NX, NZ = SIZE
XYZ_SIZE = (NX, NY, NZ)
MATRIX = [[0.9, 0.1, 0.0, 1.5], [-0.1, 0.95, 0.05, 0.5], [0.0, 0.02, 1.1, -1.0], [0.0, 0.0, 0.0, 1.0]]


def query(sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of its oracle."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (fx.WITH if prelude else "") + sql
        return f

    return put


def rounded(df: DataFrame, cols: Sequence[str], places: int = 4) -> DataFrame:
    # 0.0 is added so that no negative zero is left.
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols})


def _labelled(s: SparkSession, d: str) -> DataFrame:
    kept = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE)
    return lookup.label_points(kept, fx.annotation(s, d))


def _rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Groups of equal rows with their number: a compact result of row-wise operators."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


#: An order-free digest of which rows are in a group.
_PLACES = "round(sum((x * 64 + y) * 64 + z), 2) as places"


def _placed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"), F.expr(_PLACES))


# Scans, sources, sinks


@query("select sample_id, count(distinct channel) as shapes from cells group by 1 having count(distinct channel) > 1")
def s3_shape_conflicts(s, d):
    return sources.shape_conflicts(fx.cells(s, d), ["sample_id"], ["channel"])


_SCENES = "select o_custkey as file, o_orderkey as scene, cast(o_orderkey * 7 % 90 + 10 as int) as width from orders"


@query(f"""with c as ({_SCENES}), t as (select *, lag(width) over (partition by file order by scene) as p from c),
k as (select * from t where p is null or width > p), m as (select file, quantile_cont(width, 0.5) as m from k group by 1)
select file, scene, width from k join m using (file) where abs(width - m) <= 0.3 * m""", False)
def s4_select_scenes(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return series.select_scenes(o.selectExpr("o_custkey as file", "o_orderkey as scene", "cast(o_orderkey * 7 % 90 + 10 as int) as width"))


@query("select sample_id, channel, y, x, z, round(value, 4) as value from voxels where z between 9 and 16")
def s6_read_z_window(s, d):
    return rounded(sources.read_z_window(fx.voxels(s, d), 10, 15, 1), ["value"])


@query("""select sample_id, channel, count(*) as n, round(sum(value), 3) as total from voxels, (select min(y) y0, ceil(max(y)) y1, min(x) x0, ceil(max(x)) x1, min(z) z0, ceil(max(z)) z1 from points where slice = 7) b
where y between floor(y0) and y1 and x between floor(x0) and x1 and z between floor(z0) and z1 group by 1, 2""")
def s7_read_bbox(s, d):
    box = sources.read_bbox(fx.voxels(s, d), fx.points(s, d).where("slice = 7"))
    return rounded(box.groupBy(*BY).agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["total"], 3)


@query(f"select channel, count(*) as n, {_PLACES} from voxels where channel in (1, 3, 9) group by 1")
def s8_select_channels(s, d):
    return _placed(sources.select_channels(fx.voxels(s, d), [1, 3, 9]), ["channel"])


@query(f"select channel, count(*) as n, {_PLACES} from cells where sample_id = 'S2' group by 1")
def s12_load_sample_points(s, d):
    return _placed(sources.load_sample_points(fx.cells(s, d).withColumn("space", F.lit("sample")), "S2", "sample"), ["channel"])


@query("select s_nationkey, count(case when s_acctbal >= 0 then 1 end) as known, count(*) as n from supplier group by 1", False)
def s13_load_background(s, d):
    b = sources.load_background(s.read.parquet(f"{d}/supplier.parquet"), "s_acctbal")
    return b.groupBy("s_nationkey").agg(F.count("s_acctbal").alias("known"), F.count("*").alias("n"))


_STATS_SQL = """, vol as (select region_id, case when z > 16 then 'L' else 'R' end as side, count(*) * 0.000001 as volume from annotation group by 1, 2),
frame as (select region_id, side, sample_id, channel from (select distinct region_id from annotation) a, (select unnest(['L', 'R']) as side) b, (select distinct sample_id, channel from labelled) c),
counts as (select f.*, coalesce(n, 0) as n from frame f left join (select sample_id, channel, region_id, side, count(*) as n from labelled group by all) x using (sample_id, channel, region_id, side)),
med as (select sample_id, channel, region_id, case when z > 16 then 'L' else 'R' end as side, quantile_cont(value, 0.5) as median from voxels join annotation using (y, x, z) group by all),
full_stats as (select f.*, counts.n, volume, median as signal from frame f join counts using (sample_id, channel, region_id, side) left join vol using (region_id, side) left join med using (sample_id, channel, region_id, side))
"""


def _full_stats(s, d):
    a = fx.annotation(s, d)
    n = regions.region_counts(_labelled(s, d), a, NZ)
    v = regions.region_volumes(a, 0.01, NZ)
    m = regions.region_medians(fx.voxels(s, d), a, NZ, fill=None)
    return n.join(v, ["region_id", "side"], "left").join(m.withColumnRenamed("median", "signal"), [*BY, "region_id", "side"], "left")


@query(_STATS_SQL + """select sample_id, channel, region_id, round(max(case when side = 'R' then signal end), 4) as right_side_intensity, round(max(case when side = 'L' then signal end), 4) as left_side_intensity,
round(max(case when side = 'R' then volume end), 6) as right_side_volume, round(max(case when side = 'L' then volume end), 6) as left_side_volume, name
from full_stats left join (select region_id, name from terms where term_set = 'substructure') using (region_id) group by sample_id, channel, region_id, name""")
def s18_region_intensities(s, d):
    names = fx.terms(s, d).where("term_set = 'substructure'").select("region_id", "name")
    out = sources.region_intensities(_full_stats(s, d), names, BY)
    return rounded(rounded(out, ["right_side_intensity", "left_side_intensity"]), ["right_side_volume", "left_side_volume"], 6)


@query(_STATS_SQL + """select sample_id, channel, region_id, max(case when side = 'R' then n end) as right_side_count, max(case when side = 'L' then n end) as left_side_count,
round(max(case when side = 'R' then volume end), 6) as right_side_volume, round(max(case when side = 'L' then volume end), 6) as left_side_volume, name
from full_stats left join (select region_id, name from terms where term_set = 'substructure') using (region_id) group by sample_id, channel, region_id, name""")
def s19_region_cell_counts(s, d):
    names = fx.terms(s, d).where("term_set = 'substructure'").select("region_id", "name")
    return rounded(sources.region_cell_counts(_full_stats(s, d), names, BY), ["right_side_volume", "left_side_volume"], 6)


# Projections, filters, predicates


@query("select point_id, round((39 * 2.0 - (y - 1) * 2.0) / 20, 4) as x, round((x - 1) * 3.0 / 20, 4) as y, round((31 * 4.0 - (z - 1) * 4.0) / 20, 4) as z from points")
def p1_to_registration_space(s, d):
    out = geometry.to_registration_space(fx.points(s, d), [3.0, 2.0, 4.0], XYZ_SIZE, [-2, 1, -3], 10.0)
    return rounded(out.select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query("select point_id, round((y - 1) * 2.5 + 1, 4) as x, round((24 + 1 - x - 1) * 2.5 + 1, 4) as y, round((z - 1) * 2.5 + 1, 4) as z from points")
def p2_from_display_space(s, d):
    return rounded(geometry.from_display_space(fx.points(s, d), XYZ_SIZE, [-2, 1, 3], 2.5).select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query("select sample_id, channel, 33 - z as y, y as x, 25 - x as z, round(value, 4) as value from voxels")
def p3_permute_flip(s, d):
    return rounded(geometry.permute_flip(fx.voxels(s, d), SIZE, [-3, 1, -2]), ["value"])


@query("select point_id, round(x * 0.9 + y * 0.1 + 1.5, 4) as x, round(x * -0.1 + y * 0.95 + z * 0.05 + 0.5, 4) as y, round(y * 0.02 + z * 1.1 - 1, 4) as z from points")
def p4_apply_affine(s, d):
    return rounded(geometry.apply_affine(fx.points(s, d), MATRIX).select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query("select count(*) as n, round(sum(10 / (diameter - 25)), 3) as total from cells where diameter <> 25")
def p5_drop_nonfinite(s, d):
    ratio = fx.cells(s, d).withColumn("r", F.coalesce(F.try_divide(F.lit(10.0), F.col("diameter") - 25), F.lit(float("nan"))))
    return rounded(clean.drop_nonfinite(ratio, ["r"]).agg(F.count("*").alias("n"), F.sum("r").alias("total")), ["total"], 3)


@query("select x, y, z, count(*) as n from kept group by all")
def p6_keep_in_volume(s, d):
    return _rows(clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE), ["x", "y", "z"])


@query("select sample_id, region_id, count(*) as n from labelled where region_id > 0 group by all")
def p7_keep_in_tissue(s, d):
    kept = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE)
    return _rows(lookup.keep_in_tissue(kept, fx.annotation(s, d)), ["sample_id", "region_id"])


@query(f"select sample_id, count(*) as n, {_PLACES} from cells where z >= 9 and z < 17 and y >= 11 and y < 31 and x >= 1 and x < 13 group by 1")
def p8_own_tile_only(s, d):
    c = fx.cells(s, d).withColumns({"z0": F.lit(9), "z1": F.lit(17), "y0": F.lit(11), "y1": F.lit(31), "x0": F.lit(1), "x1": F.lit(13)})
    return _placed(clean.own_tile_only(c, ["z0", "y0", "x0"], ["z1", "y1", "x1"]), ["sample_id"])


@query(f"select sample_id, channel, count(*) as n, {_PLACES} from cells where elongation <= 2.5 and diameter >= 4 and diameter <= 32 and intensity > 0 group by all")
def p9_shape_filter(s, d):
    return _placed(clean.shape_filter(fx.cells(s, d), 4.0), BY)


@query(f"select sample_id, channel, count(*) as n, {_PLACES} from cells where 1 / elongation >= 0.7 and diameter >= 5 and intensity >= 200 group by all")
def p10_shape_filter_2d(s, d):
    return _placed(clean.shape_filter_2d(fx.cells(s, d).withColumn("circularity", 1 / F.col("elongation")), 10.0, 200.0), BY)


@query("select x, n from (select cast(floor(x) as bigint) as x, z, count(*) as n from cells group by 1, 2) where n between 12 and 1200 ")
def p11_size_filter(s, d):
    n = fx.cells(s, d).groupBy(F.floor("x").alias("x"), "z").agg(F.count("*").alias("n"))
    return clean.size_filter(n, 120.0).select("x", "n")


@query("""select region_id, count(*) as n from labelled, (select case when m > q then 1.0 else greatest(1.0, (coalesce(m, 0) + coalesce(q, 0)) / 2) end as t from
(select (select diameter from labelled where region_id = 0 group by 1 order by count(*) desc, diameter limit 1) as m, (select quantile_cont(diameter, 0.01) from labelled where region_id > 0) as q)) where region_id > 0 and diameter >= t group by 1""")
def p12_auto_intensity_filter(s, d):
    return _rows(clean.auto_intensity_filter(_labelled(s, d), value="diameter"), ["region_id"])


@query("select point_id from points where x > 2 and x <= 36 and y > 2 and y <= 20 and z > 2 and z <= 28")
def p13_edge_margin(s, d):
    return clean.edge_margin(fx.points(s, d), (38, 22, 30), 0.1).select("point_id")


@query("""select sample_id, channel, case when v = 0 then coalesce(m, 0) else v end as value, count(*) as n from (select sample_id, channel, diameter % 7 as v from cells) c left join
(select sample_id, channel, v as m from (select sample_id, channel, diameter % 7 as v, row_number() over (partition by sample_id, channel order by count(*) desc, diameter % 7) as r from cells where diameter % 7 > 0 group by 1, 2, 3) where r = 1) using (sample_id, channel) group by all""")
def p14_fill_zeros_with_mode(s, d):
    v = fx.cells(s, d).withColumn("value", F.col("diameter") % 7)
    return _rows(clean.fill_zeros_with_mode(v, BY), [*BY, "value"])


@query("select sample_id, channel, round(case when diameter <> 0 then greatest((intensity - diameter) / diameter, 0) else 0 end, 7) as intensity, count(*) as n from cells group by all")
def p15_relative_to_background(s, d):
    c = clean.relative_to_background(fx.cells(s, d).withColumn("background", F.col("diameter")), "intensity", clip=True)
    return _rows(rounded(c, ["intensity"], 7), [*BY, "intensity"])


@query("""select sample_id, channel, cast(round(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) as double) as value, count(*) as n from voxels join
(select sample_id, channel, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from voxels group by all) using (sample_id, channel) group by all""")
def p16_rescale_to_range(s, d):
    return _rows(clean.rescale_to_range(fx.voxels(s, d), BY), [*BY, "value"])


@query("""select sample_id, channel, y, x, z, round(least(greatest(value, lo), hi), 4) as value from voxels join
(select sample_id, channel, quantile_cont(value, 0.1) as lo, quantile_cont(value, 0.9) as hi from voxels where value > 0 group by all) using (sample_id, channel)""")
def p17_clamp_background(s, d):
    return rounded(clean.clamp_background(fx.voxels(s, d), BY).select(*BY, "y", "x", "z", "value"), ["value"])


@query("select view_id, side, ordinal from controls where view_id in (select view_id from controls group by 1 having count(case when side = 'sample' then 1 end) = count(case when side = 'atlas' then 1 end))")
def p18_select_matched_controls(s, d):
    return clean.select_matched_controls(fx.control_points(s, d)).select("view_id", "side", "ordinal")


@query("select id, name from tree where not regexp_matches(lower(name), 'nerves|tracts|system|unassigned|white matter|canal|aqueduct|ventricle')")
def p19_exclude_divisions(s, d):
    return clean.exclude_divisions(fx.tree(s, d)).select("id", "name")


@query("select sample_id, case when z > 16 then 'L' else 'R' end as side, count(*) as n from cells group by all")
def p20_assign_side(s, d):
    return _rows(clean.assign_side(fx.cells(s, d), NZ), ["sample_id", "side"])


@query("select sample_id, region_id, count(*) as n from labelled where region_id in (2, 7, 11) group by all")
def p21_points_in_regions(s, d):
    kept = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE)
    return _rows(lookup.points_in_regions(kept, fx.annotation(s, d), [2, 7, 11]), ["sample_id", "region_id"])


@query("""select sample_id, channel, y, x, z, value >= med - 2 * sd and value >= 5 as good from voxels join (select sample_id, channel, quantile_cont(value, 0.5) as med from voxels group by all) m using (sample_id, channel)
join (select sample_id, channel, 1.4826 * quantile_cont(abs(value - med), 0.5) as sd from voxels join (select sample_id, channel, quantile_cont(value, 0.5) as med from voxels group by all) using (sample_id, channel) group by all) using (sample_id, channel)""")
def p22_signal_qc(s, d):
    return clean.signal_qc(fx.voxels(s, d), BY, floor=5.0).select(*BY, "y", "x", "z", "good")


@query("select z - 9 as z, count(*) as n from voxels where z between 10 and 20 group by 1")
def p23_crop_axis(s, d):
    return _rows(clean.crop_axis(fx.voxels(s, d), "z", 10, 20), ["z"])


@query("select vec_id as cell_id, cast(j as int) as place, round((v[j + 1] - lo) / (hi - lo), 4) as value from (select *, unnest(range(len(embedding))) as j from (select *, list_transform(embedding, lambda x: cast(x as double) / norm) as v from (select *, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings))), (select min(list_min(v)) as lo, max(list_max(v)) as hi from (select list_transform(embedding, lambda x: cast(x as double) / norm) as v from (select *, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings)))", False)
def p24_normalise_views(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("view"))
    out = clean.normalise_views(e)
    return rounded(out.select("cell_id", F.posexplode("view").alias("place", "value")), ["value"])


@query("""select region_id, count(*) as n, round(max(level), 4) as level from labelled join (select region_id, case when hi > lo then (n - lo) / (hi - lo) * 254 + 1 else 1 end as level from (select region_id, count(*) as n from labelled group by 1) join (select region_id, name from terms where term_set = 'division' and lower(name) like '%a%') using (region_id),
(select min(n) as lo, max(n) as hi from (select region_id, count(*) as n from labelled group by 1) join (select region_id, name from terms where term_set = 'division' and lower(name) like '%a%') using (region_id))) using (region_id) group by 1""")
def p25_highlight_regions(s, d):
    cells = _labelled(s, d)
    named = cells.groupBy("region_id").agg(F.count("*").cast("double").alias("value")).join(fx.terms(s, d).where("term_set = 'division'").select("region_id", "name"), "region_id")
    out = clean.highlight_regions(cells.select("region_id"), named, "a")
    return rounded(out.groupBy("region_id").agg(F.count("*").alias("n"), F.max("level").alias("level")), ["level"])


@query("""select sample_id, count(*) as n from (select k.sample_id, k.y, k.x, k.z, a.region_id,
exists (select 1 from annotation b where b.z = a.z and abs(b.y - a.y) + abs(b.x - a.x) = 1 and b.region_id <> a.region_id) as edge from kept k join annotation a using (y, x, z)) where edge group by 1""")
def p26_annotation_boundary(s, d):
    edge = clean.annotation_boundary(fx.annotation(s, d), ["z"]).where("boundary").select("y", "x", "z")
    return _rows(clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE).join(edge, ["y", "x", "z"]), ["sample_id"])


@query("select sample_id, channel, y, x, round(value, 4) as value from voxels where z = 12")
def p27_take_slice(s, d):
    return rounded(clean.take_slice(fx.voxels(s, d), "z", 12), ["value"])


# Joins


@query("select region_id, count(*) as n from labelled group by 1")
def j1_label_points(s, d):
    return _rows(_labelled(s, d), ["region_id"])


@query("""select region_id, coalesce(sub.name, cast(region_id as varchar)) as substructure, mid.name as structure, top.name as division, coalesce(sub.acronym, '') as acronym, coalesce(sub.red, 0) as red, coalesce(sub.green, 0) as green, coalesce(sub.blue, 0) as blue, n
from (select region_id, count(*) as n from labelled group by 1) left join (select * from terms where term_set = 'substructure') sub using (region_id) left join (select * from terms where term_set = 'structure') mid using (region_id) left join (select * from terms where term_set = 'division') top using (region_id)""")
def j2_with_region_names(s, d):
    return lookup.with_region_names(_rows(_labelled(s, d), ["region_id"]), fx.terms(s, d))


_TRILINEAR = """, corner as (select p.point_id, floor(x) + cx.v as i, floor(y) + cy.v as j, floor(z) + cz.v as k,
(case when cx.v = 1 then x - floor(x) else 1 - x + floor(x) end) * (case when cy.v = 1 then y - floor(y) else 1 - y + floor(y) end) * (case when cz.v = 1 then z - floor(z) else 1 - z + floor(z) end) as w
from points p, (values (0), (1)) cx(v), (values (0), (1)) cy(v), (values (0), (1)) cz(v)),
shift as (select point_id, case when count(*) = count(dx) then sum(w * dx) else 0 end as sx, case when count(*) = count(dx) then sum(w * dy) else 0 end as sy, case when count(*) = count(dx) then sum(w * dz) else 0 end as sz
from corner c left join field f on f.i = c.i and f.j = c.j and f.k = c.k where w > 0 group by 1)
"""


@query(_TRILINEAR + "select point_id, round(x - sx, 4) as x, round(y - sy, 4) as y, round(z - sz, 4) as z from points join shift using (point_id)")
def j3_displace_points(s, d):
    return rounded(lookup.displace_points(fx.points(s, d), fx.field(s, d)).select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query(""", flat as (select k as slice, i, j, dx, dy from field), corner as (select p.point_id, p.slice, floor(x) + cx.v as i, floor(y) + cy.v as j,
(case when cx.v = 1 then x - floor(x) else 1 - x + floor(x) end) * (case when cy.v = 1 then y - floor(y) else 1 - y + floor(y) end) as w from points p, (values (0), (1)) cx(v), (values (0), (1)) cy(v)),
shift as (select point_id, case when count(*) = count(dx) then sum(w * dx) else 0 end as sx, case when count(*) = count(dx) then sum(w * dy) else 0 end as sy from corner c left join flat f on f.i = c.i and f.j = c.j and f.slice = c.slice where w > 0 group by 1)
select point_id, round(x - sx, 4) as x, round(y - sy, 4) as y from points join shift using (point_id)""")
def j4_displace_points_2d(s, d):
    flat = fx.field(s, d).select(F.col("k").alias("slice"), "i", "j", "dx", "dy")
    return rounded(lookup.displace_points_2d(fx.points(s, d), flat).select("point_id", "x", "y"), ["x", "y"])


@query("select point_id, round(x * cos(slice * 0.1) - y * sin(slice * 0.1) + slice, 4) as x, round(x * sin(slice * 0.1) + y * cos(slice * 0.1) - 2, 4) as y from points where slice <= 20")
def j5_apply_slice_transforms(s, d):
    p = fx.points(s, d)
    a = F.col("slice") * 0.1
    t = p.select("slice").distinct().where("slice <= 20").select("slice", F.array(F.cos(a), -F.sin(a), F.col("slice").cast("double"), F.sin(a), F.cos(a), F.lit(-2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"))
    return rounded(geometry.apply_slice_transforms(p, t).select("point_id", "x", "y"), ["x", "y"])


@query("""select l.point_id, r.point_id as other, round(r.d, 4) as distance from (select * from points where point_id % 50 = 0) l, lateral (select b.point_id, sqrt((b.x - l.x) ** 2 + (b.y - l.y) ** 2 + (b.z - l.z) ** 2) as d from points b order by d, b.point_id limit 2) r""")
def j7_knn_join(s, d):
    p = fx.points(s, d)
    out = spatial.knn_join(p.where("point_id % 50 = 0"), p, 2, 3.0, "point_id", "point_id")
    return out.select("point_id", F.col("_right").alias("other"), F.round("distance", 4).alias("distance"))


#: Two further clouds: customers and suppliers at places of their own.
_CLOUD = "{0} as point_id, ({0} * 7) % 38 + cast(0.25 as double) as x, ({0} * 5) % 22 + cast(0.5 as double) as y, ({0} * 11) % 30 + cast(0.75 as double) as z"
_CLOUDS = f", atlas_cloud as (select {_CLOUD.format('s_suppkey')} from supplier), sample_cloud as (select {_CLOUD.format('c_custkey')} from customer)"


def _cloud(s, d, table: str, key: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet").selectExpr(*(c.strip() for c in _CLOUD.format(key).split(", ")))


@query(_CLOUDS + " select point_id from points p where not exists (select 1 from atlas_cloud u where sqrt((u.x - p.x) ** 2 + (u.y - p.y) ** 2 + (u.z - p.z) ** 2) <= 4)")
def j9_anti_join_within(s, d):
    return spatial.anti_join_within(fx.points(s, d), _cloud(s, d, "supplier", "s_suppkey"), 4.0).select("point_id")


@query(_CLOUDS + """, near as (select s.point_id, a.point_id as other, sqrt((a.x - s.x) ** 2 + (a.y - s.y) ** 2 + (a.z - s.z) ** 2) as dist from sample_cloud s cross join atlas_cloud a),
s as (select distinct point_id from near where dist <= 12), a as (select distinct other from near where dist <= 12),
k as (select *, row_number() over (partition by point_id order by dist, other) as r from near join s using (point_id) join a using (other)),
m as (select point_id, quantile_cont(dist, 0.5) as m from k where r <= 5 group by 1) select point_id, other, round(dist, 4) as distance from k join m using (point_id) where r = 1 and dist < 4 and m < 12""")
def j8_match_clouds(s, d):
    found = spatial.match_clouds(_cloud(s, d, "customer", "c_custkey"), _cloud(s, d, "supplier", "s_suppkey"), 12.0, 4.0, 5, 4.0)
    return found.select("point_id", F.col("_right").alias("other"), F.round("distance", 4).alias("distance"))


@query("select point_id, arg_min(pos, (abs(pos - value % 1000), pos)) as nearest from points cross join (select distinct cast(floor(s_acctbal) as bigint) % 997 as pos from supplier) group by 1")
def j10_nearest_slice(s, d):
    samples = fx.points(s, d).select("point_id", (F.col("value") % 1000).alias("pos"))
    atlas = s.read.parquet(f"{d}/supplier.parquet").selectExpr("cast(floor(s_acctbal) as bigint) % 997 as pos").distinct()
    return spatial.nearest_slice(samples, atlas).select("point_id", F.col("nearest").cast("long").alias("nearest"))


@query("select c.pos, p.point_id from points p, (select range * 3 + 1.5 as pos from range(10)) c where abs(p.z - c.pos) < 2.2")
def j11_slab_join(s, d):
    slabs = s.range(10).select((F.col("id") * 3 + 1.5).alias("pos"))
    return spatial.slab_join(fx.points(s, d), slabs, 2.2).select("pos", "point_id")


@query(f"select sample_id, segment, count(*) as n, {_PLACES} from kept join segments on z >= start_z and (z < end_z or (z = end_z and end_z = 33)) group by all")
def j12_segment_join(s, d):
    kept = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE)
    return _placed(regions.segment_join(kept, fx.segments(s, d)), ["sample_id", "segment"])


@query(", reach(id, d) as (select id, id from tree union select parent_id, id from tree union select t.parent_id, r.d from reach r join tree t on t.id = r.id) select id, count(distinct d) as n, sum(d) as total from (select distinct id, d from reach) group by 1")
def j13_descendants(s, d):
    return regions.descendants(fx.tree(s, d)).groupBy("id").agg(F.count("*").alias("n"), F.sum("descendant").alias("total"))


@query("select c_custkey as id, l.level, l.ancestor from (select *, [1000, 100 + n_regionkey, n_nationkey] as p from customer join nation on n_nationkey = c_nationkey), lateral (select unnest([1, 2, 3]) as level, unnest(p) as ancestor) l", False)
def j14_path_to_levels(s, d):
    c, n = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/nation.parquet")
    t = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.concat(F.lit("/1000/"), (F.col("n_regionkey") + 100).cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit("/")).alias("path"))
    return regions.path_to_levels(t)


_EXTERNAL = "case when s_suppkey % 3 = 0 then concat('left ', 'customer#', lpad(cast(s_suppkey % 60 as varchar(9)), 9, '0'), ', ', cast(s_suppkey as varchar(9))) else concat('TOMER#', lpad(cast(s_suppkey % 60 as varchar(9)), 9, '0')) end as ext_name"


@query(f"""select region_id, c_name as name, v as ext_value from (select c_custkey as region_id, c_name from customer) left join (select region_id, min(v) as v from (select distinct c_custkey as region_id, e, v from customer join (select replace(lower(ext_name), ',', '') as e, s_nationkey as v from (select {_EXTERNAL}, s_nationkey from supplier))
on contains(e, lower(c_name)) or contains(lower(c_name), e)) group by 1 having count(*) = 1) using (region_id)""", False)
def j15_join_by_name_unique(s, d):
    t = s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as region_id", "c_name as name")
    return regions.join_by_name_unique(t, s.read.parquet(f"{d}/supplier.parquet").selectExpr(_EXTERNAL, "s_nationkey as ext_value"))


@query("""select sample_id, channel, count(*) as n, sum(z * 1000 + x) as total from (select v.sample_id, v.channel, case when d.f = 1 then 25 - v.x else v.x end as x, o.t as z from voxels v join (select range + 1 as o, case when range % 10 = 9 then -1 when range % 3 = 0 then 1 else 0 end as f from range(32)) d on v.z = d.o
join (select range + 1 as t, ((range + 1) * 7) % 32 + 1 as s from range(32)) o on o.s = d.o where d.f <> -1) group by all""")
def j16_reorder_slices(s, d):
    i = F.col("id")
    dec = s.range(32).select((i + 1).cast("int").alias("original_index"), F.when(i % 10 == 9, -1).when(i % 3 == 0, 1).otherwise(0).alias("flip_state"), ((i + 1) * 7 % 32 + 1).cast("int").alias("new_order_original_index"))
    out = geometry.reorder_slices(fx.voxels(s, d), dec, NX)
    return out.groupBy(*BY).agg(F.count("*").alias("n"), F.sum(F.col("z") * 1000 + F.col("x")).alias("total"))


@query("select p.slice, w.t as target, p.point_id from points p join (select range % 20 + 1 as s, range + 1 as t from range(30)) w on w.s = p.slice")
def j17_warp_by_path(s, d):
    path = s.range(30).select((F.col("id") % 20 + 1).cast("int").alias("source"), (F.col("id") + 1).cast("int").alias("target"))
    out = geometry.warp_by_path(fx.points(s, d).withColumn("old", F.col("slice")), path, "slice")
    return out.select(F.col("old").alias("slice"), F.col("slice").alias("target"), "point_id")


_LINE = """, lines as (select slice as probe_id, avg(y) as oy, avg(x) as ox, avg(z) as oz from points group by 1),
samples as (select probe_id, step, cast(round(oy + 0.6 * step / 4.0) as int) as y, cast(round(ox + 0.0 * step / 4.0) as int) as x, cast(round(oz + 0.8 * step / 4.0) as int) as z from lines, (select range - 160 as step from range(321))),
hit as (select s.*, a.region_id from samples s join annotation a using (y, x, z))
"""


def _line_samples(s, d):
    lines = fx.points(s, d).groupBy(F.col("slice").alias("probe_id")).agg(F.avg("y").alias("oy"), F.avg("x").alias("ox"), F.avg("z").alias("oz"))
    lines = lines.withColumns({"dy": F.lit(0.6), "dx": F.lit(0.0), "dz": F.lit(0.8)})
    return lookup.sample_line(lines, fx.annotation(s, d), SIZE, 40, 4)


@query(_LINE + "select probe_id, region_id, count(*) as n from hit group by all")
def j18_sample_line(s, d):
    return _rows(_line_samples(s, d), ["probe_id", "region_id"])


@query("select point_id, round(x * 0.9 + y * 0.1 + 1.5, 4) as x, round(x * -0.1 + y * 0.95 + z * 0.05 + 0.5, 4) as y, round(y * 0.02 + z * 1.1 - 1, 4) as z from points where x * 0.9 + y * 0.1 + 1.5 between 1 and 24 and x * -0.1 + y * 0.95 + z * 0.05 + 0.5 between 1 and 40 and y * 0.02 + z * 1.1 - 1 between 1 and 32")
def j22_map_and_crop(s, d):
    return rounded(geometry.map_and_crop(fx.points(s, d), MATRIX, XYZ_SIZE).select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query("select distinct l_partkey as id, p_partkey * 2 as pos from lineitem join part on p_partkey = l_partkey", False)
def j23_locate_ids(s, d):
    ids = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey as id").distinct()
    return lookup.locate_ids(ids, s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", "p_partkey * 2 as pos"))


J24_SQL = """select sample_id, channel, oy as y, ox as x, oz as z, round(sum(w * value), 6) as value from (select sample_id, channel, y + gy.v as oy, x + gx.v as ox, z as oz, (case when gy.v = 1 then 0.75 else 0.25 end) * (case when gx.v = 1 then 0.5 else 0.5 end) as w, value
from voxels, (values (1), (2)) gy(v), (values (0), (1)) gx(v)) where oy between 1 and 40 and ox between 1 and 24 group by all"""


@query(J24_SQL)
def j24_warp_volume(s, d):
    move = [[1, 0, 0, 1.25], [0, 1, 0, 0.5], [0, 0, 1, 0], [0, 0, 0, 1]]
    return rounded(lookup.warp_volume(fx.voxels(s, d), move, SIZE), ["value"], 6)


# Aggregations


@query(_STATS_SQL + "select sample_id, channel, region_id, side, n from counts")
def g1_region_counts(s, d):
    return regions.region_counts(_labelled(s, d), fx.annotation(s, d), NZ)


@query("select sample_id, side, region_id, round(count(*) / max(volume), 3) as density from labelled join (select region_id, case when z > 16 then 'L' else 'R' end as side, count(*) * 0.000001 as volume from annotation group by 1, 2) using (region_id, side) group by all")
def g2_region_volumes(s, d):
    v = regions.region_volumes(fx.annotation(s, d), 0.01, NZ)
    n = clean.assign_side(_labelled(s, d), NZ).groupBy("sample_id", "side", "region_id").agg(F.count("*").alias("n"))
    return n.join(v, ["region_id", "side"]).select("sample_id", "side", "region_id", F.round(F.col("n") / F.col("volume"), 3).alias("density"))


@query(_STATS_SQL + "select f.*, round(coalesce(median, 0), 4) as median from frame f left join med using (sample_id, channel, region_id, side)")
def g3_region_medians(s, d):
    return rounded(regions.region_medians(fx.voxels(s, d), fx.annotation(s, d), NZ), ["median"])


@query(_STATS_SQL + """, m as (select f.*, coalesce(median, 0) as median from frame f left join med using (sample_id, channel, region_id, side))
select m.*exclude(median), round(median, 4) as median, round(case when b <> 0 then (median - b) / b else 0 end, 4) as relative from m join (select sample_id, channel, side, median as b from m where region_id = 0) using (sample_id, channel, side)""")
def g4_region_relative(s, d):
    return rounded(regions.region_relative(regions.region_medians(fx.voxels(s, d), fx.annotation(s, d), NZ)), ["median", "relative"])


@query(""", m as (select sample_id, channel, region_id, segment, quantile_cont(value, 0.5) as median from voxels join annotation using (y, x, z) join segments on z >= start_z and (z < end_z or (z = end_z and end_z = 33)) group by all)
select m.*exclude(median), round(median, 4) as median, round(case when b <> 0 then (median - b) / b end, 4) as relative from m left join (select sample_id, channel, segment, median as b from m where region_id = 0) using (sample_id, channel, segment)""")
def g5_region_segment_medians(s, d):
    return rounded(regions.region_segment_medians(fx.voxels(s, d), fx.annotation(s, d), fx.segments(s, d)), ["median", "relative"])


@query("select region_id, segment, n, round(n / sum(n) over (partition by region_id), 4) as share from (select region_id, segment, count(*) as n from labelled join segments on z >= start_z and (z < end_z or (z = end_z and end_z = 33)) group by all)")
def g6_region_segment_volumes(s, d):
    return rounded(regions.region_segment_volumes(_labelled(s, d), fx.segments(s, d)), ["share"])


@query(_STATS_SQL + """, leaf as (select sample_id, channel, region_id, avg(n) as n, sum(volume) as volume, avg(signal) as signal from full_stats group by all)
select sample_id, channel, t.name, round(sum(n), 4) as n, round(sum(volume) / 2, 6) as volume, round(sum(signal * volume) / sum(case when signal is not null then volume end), 4) as signal, min(dv.name) as division
from leaf join (select * from terms where term_set = 'structure') t using (region_id) left join (select * from terms where term_set = 'division') dv using (region_id) group by sample_id, channel, t.name""")
def g7_rollup_regions(s, d):
    return rounded(rounded(regions.rollup_regions(_full_stats(s, d), fx.terms(s, d)), ["n", "signal"]), ["volume"], 6)


@query("""select parent as target, segment, round(sum(v), 2) as volume, round(sum(v * sig) / sum(v), 3) as signal from (select 100 + n_regionkey as parent, concat('C', cast(c_custkey % 4 as varchar)) as segment, cast(c_custkey % 7 + 1 as double) as v, c_acctbal as sig from customer join nation on n_nationkey = c_nationkey) group by all""", False)
def g8_rollup_cord(s, d):
    leaf = s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey + 10000 as region_id", "concat('C', cast(c_custkey % 4 as string)) as segment", "cast(c_custkey % 7 + 1 as double) as volume", "c_acctbal as signal")
    out = regions.rollup_cord(leaf, fx.tree(s, d), [100, 101, 102, 103, 104], ["segment"])
    return rounded(rounded(out, ["volume"], 2), ["signal"], 3)


@query("select region_id, round((16 - quantile_cont(z, 0.5)) * 0.02, 4) as distance from labelled where z <= 16 group by 1")
def g9_midline_distance(s, d):
    return rounded(regions.midline_distance(_labelled(s, d), NZ, 0.02), ["distance"])


_WEIGHTS = ", weights as (select concat('S', cast(range as varchar)) as sample_id, cast(range + 1 as double) as weight from range(5))"


def _weights(s):
    return s.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample_id"), (F.col("id") + 1).cast("double").alias("weight"))


@query(_WEIGHTS + "select y, x, least(z, 33 - z) as z, round(sum(weight) / 2, 4) as value from kept join weights using (sample_id) group by all")
def g10_density_map(s, d):
    return rounded(stats.density_map(clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE), _weights(s), NZ), ["value"])


@query(_WEIGHTS + ", maps as (select sample_id, y, x, z, cast(count(*) as double) as value from kept group by all) select y, x, z, round(sum(weight * value) / 15, 4) as mean, round(greatest((sum(weight * value * value) - sum(weight * value) ** 2 / 15) / (15 - 55.0 / 15), 0), 4) as variance from maps join weights using (sample_id) group by all")
def g11_density_variance(s, d):
    maps = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE).groupBy("sample_id", "y", "x", "z").agg(F.count("*").cast("double").alias("value"))
    return rounded(stats.density_variance(maps, _weights(s)), ["mean", "variance"])


@query(_WEIGHTS + ", b as (select sample_id, channel, quantile_cont(value, 0.5) as b from voxels where value > 0 and y between 1 and 40 and x between 1 and 24 and z between 1 and 6 group by all) select channel, y, x, z, round(sum(weight * (value - b) / b), 4) + 0 as value from voxels join b using (sample_id, channel) join weights using (sample_id) group by all")
def g12_intensity_map(s, d):
    return rounded(stats.intensity_map(fx.voxels(s, d), _weights(s), [(1, 40), (1, 24), (1, 6)], ["channel"]), ["value"])


@query("select region_id, count(*) as n, round(avg(intensity), 3) as mean, round(sum(intensity * x) / sum(intensity), 4) as cx, round(sum(intensity * y) / sum(intensity), 4) as cy, round(sum(intensity * z) / sum(intensity), 4) as cz, round(sum(intensity * x * x) / sum(intensity) - (sum(intensity * x) / sum(intensity)) ** 2, 3) as mxx from labelled group by 1")
def g13_component_moments(s, d):
    m = stats.component_moments(_labelled(s, d), ["region_id"], "intensity").select("region_id", "n", "mean", "cx", "cy", "cz", "mxx")
    return rounded(rounded(m, ["mean", "mxx"], 3), ["cx", "cy", "cz"])


@query("""select sample_id, channel, round(med, 4) as median, round(1.4826 * quantile_cont(abs(diameter - med), 0.5), 4) as robust_sd, round(quantile_cont(diameter, 0.01), 4) as q01, round(quantile_cont(diameter, 0.99), 4) as q99, count(*) as n, max(m) as mode from cells join (select sample_id, channel, quantile_cont(diameter, 0.5) as med from cells group by all) using (sample_id, channel)
join (select sample_id, channel, diameter as m from (select sample_id, channel, diameter, row_number() over (partition by sample_id, channel order by count(*) desc, diameter) as r from cells group by 1, 2, 3) where r = 1) using (sample_id, channel) group by sample_id, channel, med""")
def g14_robust_stats(s, d):
    return rounded(stats.robust_stats(fx.cells(s, d), BY, "diameter"), ["median", "robust_sd", "q01", "q99"])


@query("select sample_id, channel, 'yx' as view, y as u, x as v, round(max(value), 4) as value from voxels group by all union all select sample_id, channel, 'zx', z, x, round(max(value), 4) from voxels group by all union all select sample_id, channel, 'zy', z, y, round(max(value), 4) from voxels group by all")
def g15_max_projections(s, d):
    return rounded(stats.max_projections(fx.voxels(s, d), BY), ["value"])


@query("""select sample_id, channel, b * 25.0 as threshold from (select *, row_number() over (partition by sample_id, channel order by round(n0 * (t - n0) * (s0 / n0 - (s - s0) / (t - n0)) ** 2, 6) desc, b) as r from (select *, sum(n) over (partition by sample_id, channel order by b rows between unbounded preceding and 1 preceding) as n0, sum(n * b) over (partition by sample_id, channel order by b rows between unbounded preceding and 1 preceding) as s0, sum(n) over (partition by sample_id, channel) as t, sum(n * b) over (partition by sample_id, channel) as s
from (select sample_id, channel, cast(floor(value / 25) as bigint) as b, count(*) as n from voxels group by all)) where n0 > 0) where r = 1""")
def g16_otsu_threshold(s, d):
    return stats.otsu_threshold(fx.voxels(s, d), BY, 25.0)


@query(""", a as (select sample_id, z, count(*) as area from voxels group by all), m as (select sample_id, quantile_cont(area, 0.5) as med from a group by 1), l as (select sample_id, med + 3 * 1.4826 * quantile_cont(abs(area - med), 0.5) as l from a join m using (sample_id) group by sample_id, med), k as (select sample_id, min(z) as a, max(z) as b from a join l using (sample_id) where area > l group by 1)
select sample_id, z, area, coalesce(z between k.a and k.b, false) as kept from a left join k using (sample_id)""")
def g18_area_profile(s, d):
    return stats.area_profile(fx.voxels(s, d))


@query("select sample_id, channel, greatest(min(y) - 1, 1) as y0, least(max(y) + 1, 40) as y1, greatest(min(x) - 1, 1) as x0, least(max(x) + 1, 24) as x1, greatest(min(z) - 1, 1) as z0, least(max(z) + 1, 32) as z1 from voxels where value > 400 group by all")
def g19_bounding_box(s, d):
    return stats.bounding_box(fx.voxels(s, d).where("value > 400"), BY, 1, SIZE)


@query("select region_id, count(*) as n from labelled group by 1 having count(*) > 0.03 * (select count(*) from labelled)")
def g20_cluster_size_filter(s, d):
    return _rows(stats.cluster_size_filter(_labelled(s, d).withColumn("component", F.col("region_id")), 0.03), ["region_id"])


@query("select sample_id, channel, count(*) as n, round(quantile_cont(intensity, 0.5), 6) as median_intensity, quantile_cont(diameter, 0.5) as median_diameter, round((quantile_cont(intensity, 0.975) - quantile_cont(intensity, 0.025)) / 2, 6) as half_range from cells group by all")
def g21_scan_pair_qc(s, d):
    return rounded(stats.scan_pair_qc(fx.cells(s, d), BY), ["median_intensity", "half_range"], 6)


@query("select sample_id, channel, round(quantile_cont(value, 0.999) - quantile_cont(value, 0.001), 6) as range from voxels group by all")
def g22_dynamic_range(s, d):
    return rounded(stats.dynamic_range(fx.voxels(s, d), BY), ["range"], 6)


@query("select slice, round(sum(x * x), 2) as xx, round(sum(x * y), 2) as xy, round(sum(z), 2) as z1, round(sum(x * (x + 1)), 2) as xu, round(sum(y * 2 * y), 2) as yv from points group by 1")
def g23_pair_moments(s, d):
    pairs = fx.points(s, d).withColumns({"u": F.col("x") + 1, "v": 2 * F.col("y"), "w": F.col("z") - 3})
    return rounded(stats.pair_moments(pairs, ["slice"]).select("slice", "xx", "xy", "z1", "xu", "yv"), ["xx", "xy", "z1", "xu", "yv"], 2)


@query("select round(avg((x * 0.9 + y * 0.1 + 1.5 - x) ** 2 + (x * -0.1 + y * 0.95 + z * 0.05 + 0.5 - y) ** 2 + (y * 0.02 + z * 1.1 - 1 - z) ** 2), 4) as mse from points")
def g25_transform_mse(s, d):
    pairs = fx.points(s, d).withColumns({"u": F.col("x"), "v": F.col("y"), "w": F.col("z")})
    return rounded(stats.transform_mse(pairs, MATRIX), ["mse"])


@query("select slice as implant_id, region_id, count(*) as n, round(count(*) / sum(count(*)) over (partition by slice), 4) as share from (select p.slice, a.region_id, p.x - 12 as g1, p.y - 12 as g2 from points p join annotation a on a.y = round(p.y) and a.x = round(p.x) and a.z = round(p.z)) where region_id > 0 and g1 * g1 + g2 * g2 <= 81 group by slice, region_id")
def g29_regions_under_implant(s, d):
    px = lookup.label_points(fx.points(s, d), fx.annotation(s, d)).select(F.col("slice").alias("implant_id"), "region_id", (F.col("x") - 12).alias("g1"), (F.col("y") - 12).alias("g2"), F.lit(9.0).alias("radius"))
    return rounded(regions.regions_under_implant(px), ["share"])


@query("select sample_id, channel, cast(ceil(y / 4) as int) as y, cast(ceil(x / 4) as int) as x, cast(ceil(z / 2) as int) as z, round(avg(value), 7) as value from voxels group by all")
def g30_downsample(s, d):
    return rounded(regions.downsample(fx.voxels(s, d), (4, 4, 2)), ["value"], 7)


@query(""", st as (select sample_id, dv.name as division, count(*) as n, cast(10 as double) as volume from labelled join (select * from terms where term_set = 'division') dv using (region_id) group by all), parts as (select sample_id, division, n, volume from st union all select sample_id, 'All', n, volume from st)
select sample_id, division, round(sum(n) / sum(volume), 4) as density, round(sum(n) / max(t), 4) as share from parts join (select sample_id, sum(n) as t from st group by 1) using (sample_id) group by all""")
def g31_density_table(s, d):
    st = lookup.with_region_names(_labelled(s, d), fx.terms(s, d)).where("division is not null").groupBy("sample_id", "division").agg(F.count("*").alias("n")).withColumn("volume", F.lit(10.0))
    return rounded(regions.density_table(st), ["density", "share"])


@query("select case when intensity > 300 then 1 else 0 end as predicted, count(*) as n, round(avg(case when (case when diameter > 25 then 1 else 0 end) = (case when intensity > 300 then 1 else 0 end) then 1.0 else 0.0 end), 4) as accuracy, count(case when (case when diameter > 25 then 1 else 0 end) <> (case when intensity > 300 then 1 else 0 end) then 1 end) as mismatches from cells group by 1")
def g34_accuracy(s, d):
    c = fx.cells(s, d).withColumns({"label": (F.col("diameter") > 25).cast("int"), "predicted": (F.col("intensity") > 300).cast("int")})
    return rounded(stats.accuracy(c, "label", "predicted"), ["accuracy"])


@query("select sample_id, channel, count(*) as n, round(avg(case when region_id > 0 then 1.0 else 0.0 end), 4) as share from labelled group by rollup (sample_id, channel)")
def g35_retention_report(s, d):
    return rounded(stats.retention_report(_labelled(s, d).withColumn("kept", F.col("region_id") > 0), BY), ["share"])


# Windows and neighbourhoods


@query("""select v.sample_id, v.channel, v.y, v.x, v.z, round(max(w.value), 4) as extreme from voxels v join voxels w on w.sample_id = v.sample_id and w.channel = v.channel and w.z = v.z and w.y between v.y - 2 and v.y + 2 and w.x = v.x group by all""")
def w1_local_max_line(s, d):
    out = stencil.local_max(fx.voxels(s, d), 2, [*BY, "x", "z"], ("y",))
    return rounded(out.select(*BY, "y", "x", "z", "extreme"), ["extreme"])


@query("""select v.sample_id, v.channel, v.y, v.x, v.z, round(max(w.value), 4) as most, round(min(w.value), 4) as least from voxels v join voxels w on w.sample_id = v.sample_id and w.channel = v.channel and w.z between v.z - 1 and v.z + 1 and w.y between v.y - 1 and v.y + 1 and w.x between v.x - 1 and v.x + 1 group by all""")
def w1_local_extremes_box(s, d):
    v = fx.voxels(s, d)
    most = stencil.local_extreme(v, 1, BY, out="most")
    return rounded(stencil.local_extreme(most, 1, BY, most=False, out="least").drop("value"), ["most", "least"])


@query("""select sample_id, y, z, round(value, 4) as value from (select sample_id, y, z, max(value) as value from voxels group by all) v where value > 300 and not exists (select 1 from (select sample_id, y, z, max(value) as value from voxels group by all) w where w.sample_id = v.sample_id and abs(w.y - v.y) <= 1 and abs(w.z - v.z) <= 1 and w.value > v.value)""")
def w2_find_peaks(s, d):
    flat = fx.voxels(s, d).groupBy("sample_id", "y", "z").agg(F.max("value").alias("value"))
    return rounded(stencil.find_peaks(flat, 1, 300.0, ["sample_id"], ("y", "z")), ["value"])


@query("""select v.sample_id, v.z, round(sum(exp(-((w.z - v.z) ** 2) / 8.0) * w.value) / sum(exp(-((w.z - v.z) ** 2) / 8.0)), 4) as background from (select sample_id, z, sum(value) as value from voxels group by all) v join (select sample_id, z, sum(value) as value from voxels group by all) w on w.sample_id = v.sample_id and abs(w.z - v.z) <= 3 group by all""")
def w3_weighted_background(s, d):
    flat = fx.voxels(s, d).groupBy("sample_id", "z").agg(F.sum("value").alias("value"))
    return rounded(stencil.weighted_background(flat, 2.0, 3, ["sample_id"], "z", ("z",)).select("sample_id", "z", "background"), ["background"])


@query("select slice, point_id, round(median(value) over (partition by slice order by point_id rows between 2 preceding and 2 following), 4) as median from points")
def w4_moving_median(s, d):
    return rounded(series.moving_median(fx.points(s, d), 2, ["slice"], "point_id", "value").select("slice", "point_id", "median"), ["median"])


@query("""select v.sample_id, v.y, v.z from (select sample_id, y, z, max(value) as value from voxels group by all) v where value > 100 and exists (select 1 from (select sample_id, y, z, max(value) as value from voxels group by all) w where w.value > 900 and w.sample_id = v.sample_id and abs(w.y - v.y) <= 2 and abs(w.z - v.z) <= 2)""")
def w6_dilate(s, d):
    flat = fx.voxels(s, d).groupBy("sample_id", "y", "z").agg(F.max("value").alias("value"))
    return stencil.dilate(flat.where("value > 900"), 2, flat, ["sample_id"], 100.0, ("y", "z")).select("sample_id", "y", "z")


@query("""select v.sample_id, v.y, v.z, round(quantile_cont(w.value, 0.5), 4) as value from (select sample_id, y, z, max(value) as value from voxels group by all) v join (select sample_id, y, z, max(value) as value from voxels group by all) w on w.sample_id = v.sample_id and abs(w.y - v.y) <= 1 and abs(w.z - v.z) <= 1 group by all""")
def w8_median_filter(s, d):
    flat = fx.voxels(s, d).groupBy("sample_id", "y", "z").agg(F.max("value").alias("value"))
    return rounded(stencil.median_filter(flat, 1, ["sample_id"], ("y", "z")), ["value"])


@query("""select v.sample_id, v.y, v.z, round(case when count(*) > 1 then stddev_samp(w.value) else 0 end, 2) as std from (select sample_id, y, z, max(value) as value from voxels group by all) v join (select sample_id, y, z, max(value) as value from voxels group by all) w on w.sample_id = v.sample_id and abs(w.y - v.y) <= 2 and abs(w.z - v.z) <= 2 group by all""")
def w10_local_std(s, d):
    flat = fx.voxels(s, d).groupBy("sample_id", "y", "z").agg(F.max("value").alias("value"))
    return rounded(stencil.local_std(flat, 2, ["sample_id"], ("y", "z")).select("sample_id", "y", "z", "std"), ["std"], 2)


@query(_LINE + """, r as (select *, sum(new) over (partition by probe_id order by step) as run from (select *, case when lag(region_id) over (partition by probe_id order by step) = region_id then 0 else 1 end as new from hit))
select r.probe_id, run, region_id, round((min(step) - e) / 4.0, 4) as d0, round((max(step) - e) / 4.0, 4) as d1, count(*) as n from r join (select probe_id, min(step) as e from hit where region_id > 0 group by 1) using (probe_id) where region_id > 0 group by r.probe_id, run, region_id, e""")
def w11_run_lengths(s, d):
    return rounded(lookup.run_lengths(_line_samples(s, d), per_voxel=4), ["d0", "d1"])


@query(""", m as (select slice, point_id, value, median(value) over (partition by slice order by point_id rows between 3 preceding and 3 following) as m from points) select slice, point_id, abs(value - m) > 2 * sd as outlier from m join (select slice, 1.4826 * quantile_cont(abs(value - m), 0.5) as sd from m group by 1) using (slice)""")
def w12_robust_outliers(s, d):
    return series.robust_outliers(fx.points(s, d), 3, ["slice"], "point_id", "value", 2.0).select("slice", "point_id", "outlier")


_GAPS = """, g as (select slice, point_id, case when point_id % 7 < 3 then value end as v from points), h as (select *, last_value(v ignore nulls) over (partition by slice order by point_id rows unbounded preceding) as v0, last_value(case when v is not null then point_id end ignore nulls) over (partition by slice order by point_id rows unbounded preceding) as p0,
first_value(v ignore nulls) over (partition by slice order by point_id rows between current row and unbounded following) as v1, first_value(case when v is not null then point_id end ignore nulls) over (partition by slice order by point_id rows between current row and unbounded following) as p1 from g)
"""


def _gaps(s, d):
    return fx.points(s, d).select("slice", "point_id", F.when(F.col("point_id") % 7 < 3, F.col("value")).alias("v"))


@query(_GAPS + "select slice, point_id, round(case when p0 is not null and p1 is not null then case when point_id - p0 <= p1 - point_id then v0 else v1 end end, 4) as v from h")
def w13_fill_nearest(s, d):
    return rounded(series.fill_nearest(_gaps(s, d), ["slice"], "point_id", "v"), ["v"])


@query(_GAPS + """, k as (select slice, point_id as p, v, row_number() over (partition by slice order by point_id) as r, row_number() over (partition by slice order by point_id desc) as l, count(*) over (partition by slice) as n from h where v is not null),
e as (select slice, max(n) as n, max(case when r = 1 then p end) as pa, max(case when r = 1 then v end) as va, max(case when r = 2 then p end) as pb, max(case when r = 2 then v end) as vb,
  max(case when l = 2 then p end) as py, max(case when l = 2 then v end) as vy, max(case when l = 1 then p end) as pz, max(case when l = 1 then v end) as vz from k group by 1)
select slice, point_id, case when h.v is not null then round(h.v, 4) when e.n < 4 or e.n is null then null when p0 is null then round(va + (vb - va) / (pb - pa) * (point_id - pa)) when p1 is null then round(vy + (vz - vy) / (pz - py) * (point_id - py))
  else round(v0 + (v1 - v0) / (p1 - p0) * (point_id - p0)) end as v from h left join e using (slice)""")
def w14_interpolate_slices(s, d):
    """All places, those beyond the known ones as well."""
    return rounded(series.interpolate_slices(_gaps(s, d), ["slice"], "point_id", "v").select("slice", "point_id", "v"), ["v"])


@query("select slice, point_id, round(a - 2 * pi() * sum(t) over (partition by slice order by point_id), 4) as a from (select *, coalesce(round((a - lag(a) over (partition by slice order by point_id)) / (2 * pi())), 0) as t from (select slice, point_id, (value % 628) / 100 - 3.14 as a from points))")
def w15_unwrap_angle(s, d):
    a = fx.points(s, d).select("slice", "point_id", ((F.col("value") % 628) / 100 - 3.14).alias("a"))
    return rounded(series.unwrap_angle(a, ["slice"], "point_id", "a"), ["a"])


@query("select point_id, round(cos(-(z / 10)), 4) as m0, round(20 - cos(-(z / 10)) * x + sin(-(z / 10)) * y, 4) as m2, round(12 - sin(-(z / 10)) * x - cos(-(z / 10)) * y, 4) as m5 from points")
def w19_straighten_transforms(s, d):
    out = series.straighten_transforms(fx.points(s, d).withColumn("angle", F.col("z") / 10), (20.0, 12.0))
    return rounded(out.select("point_id", F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(2)).alias("m2"), F.get("m", F.lit(5)).alias("m5")), ["m0", "m2", "m5"])


@query("select slice, start, gap from (select slice, point_id as start, gap, row_number() over (partition by slice order by gap desc, point_id) as r from (select slice, point_id, lead(point_id) over (partition by slice order by point_id) - point_id as gap from points) where gap is not null) where r = 1")
def w20_largest_gap(s, d):
    return series.largest_gap(fx.points(s, d), ["slice"], "point_id")


# Sorts, samples, sets, functions, streams


@query("select slice, least(count(*), 25) as n from points group by 1")
def k3_sample_per_group(s, d):
    return _rows(stats.sample_per_group(fx.points(s, d), 25, ["slice"], "point_id"), ["slice"])


@query("select slice, round(avg(x), 4) as x, round(avg(y), 4) as y, round(avg(z), 4) as z, count(*) as n from points group by slice, floor(x / 8), floor(y / 8), floor(z / 8)")
def k4_grid_downsample(s, d):
    return rounded(spatial.grid_downsample(fx.points(s, d), 8.0, ["slice"]), ["x", "y", "z"])


@query("select slice, point_id from (select slice, point_id, row_number() over (partition by slice order by y desc, point_id desc) as r from points) where r = 1")
def k8_deepest_point(s, d):
    return stats.deepest_point(fx.points(s, d), ["slice"]).select("slice", "point_id")


@query("select distinct region_id from labelled")
def u3_distinct_regions(s, d):
    return regions.distinct_regions(_labelled(s, d))


@query("select o_custkey from orders where o_orderkey % 3 = 0 except select o_custkey from orders where o_orderkey % 5 = 0", False)
def u4_except_ids(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return regions.except_ids(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0"), "o_custkey")


@query("select o_custkey from orders where o_orderkey % 3 = 0 intersect select o_custkey from orders where o_orderkey % 5 = 0", False)
def u4_intersect_ids(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return regions.intersect_ids(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0"), "o_custkey")


@query("""select point_id, cast(round(x) as bigint) as f1_round, cast(round(y) + (round(x) - 1) * 40 + (round(z) - 1) * 960 as bigint) as f2_index, round(atan2(sin(x - y), cos(x - y)), 4) as f3_circ, round(cbrt(z * 6 / pi()), 4) as f4_diameter, round((x - 1) / 39 * 254 + 1, 4) as f17_scaled from points""")
def f_scalar_functions(s, d):
    p = fx.points(s, d)
    out = p.select("point_id", fn.round_away("x").alias("f1_round"), fn.sub2ind(SIZE, fn.round_away("y"), fn.round_away("x"), fn.round_away("z")).alias("f2_index"), fn.circ_dist("x", "y").alias("f3_circ"), fn.equiv_diameter("z").alias("f4_diameter"), fn.scale_between("x", 1.0, 40.0, 1.0, 255.0).alias("f17_scaled"))
    return rounded(out, ["f3_circ", "f4_diameter", "f17_scaled"])


@query("select o_orderkey, datediff('day', timestamp '1995-01-01', o_orderdate) as days from orders", False)
def f13_days_between(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", fn.days_between(F.col("o_orderdate"), F.to_date(F.lit("1995-01-01"))).alias("days"))


@query("select time_bucket(interval '1 hour', ts) as start, sample_id, count(*) as n, round(avg(value), 7) as mean from scans group by all")
def t2_detection_counts(s, d):
    return rounded(streaming.detection_counts(fx.events(s, d)), ["mean"], 7).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select start, sample_id, round(avg(value), 7) as background, round(case when avg(value) <> 0 then (arg_max(value, (ts, value)) - avg(value)) / avg(value) else 0 end, 7) as relative from (select *, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as start from scans) group by all")
def t3_sliding_background(s, d):
    return rounded(streaming.sliding_background(fx.events(s, d)), ["background", "relative"], 7).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query('select min(ts) as start, max(ts) + interval 30 minutes as "end", sample_id, count(*) as n from (select *, sum(new) over (partition by sample_id order by ts) as k from (select *, case when ts - lag(ts) over (partition by sample_id order by ts) < interval 30 minutes then 0 else 1 end as new from scans)) group by sample_id, k')
def t4_sample_sessions(s, d):
    return streaming.sample_sessions(fx.events(s, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select distinct sample_id, channel, cast(round(x) as int) as x, cast(round(y) as int) as y, cast(round(z) as int) as z from cells")
def t5_dedupe(s, d):
    once = streaming.dedupe(fx.cells(s, d).withColumn("ts", F.lit("2024-01-01").cast("timestamp")))
    return once.select(*BY, *(F.round(c, 0).cast("int").alias(c) for c in "xyz"))


@query("select sample_id, count(*) as n, round(sum(value), 2) as total from scans group by 1")
def t6_running_total(s, d):
    return rounded(streaming.running_total(fx.events(s, d)), ["total"], 2)


@query("select sample_id, channel, round(quantile_cont(intensity, 0.5), 4) as value from cells group by all")
def x1_grouped_reduce(s, d):
    return rounded(udf.grouped_reduce(fx.cells(s, d), BY, "intensity", "median"), ["value"])


@query("""select region_id, side, t.name, count(*) as n, round(count(*) / max(volume), 3) as density from labelled join (select region_id, case when z > 16 then 'L' else 'R' end as side, count(*) * 0.000001 as volume from annotation group by 1, 2) using (region_id, side) join (select region_id, name from terms where term_set = 'substructure') t using (region_id) where region_id > 0 group by all""")
def flagship(s, d):
    """Cells by region and side with names and densities: clean, label, count, name."""
    a = fx.annotation(s, d)
    kept = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE)
    n = clean.assign_side(lookup.keep_in_tissue(kept, a), NZ).groupBy("region_id", "side").agg(F.count("*").alias("n"))
    named = n.join(fx.terms(s, d).where("term_set = 'substructure'").select("region_id", "name"), "region_id")
    rows = named.join(regions.region_volumes(a, 0.01, NZ), ["region_id", "side"])
    return rows.select("region_id", "side", "name", "n", F.round(F.col("n") / F.col("volume"), 3).alias("density"))


# Jobs that SQL cannot express: their results are tested by brute force on small cases


@query()
def w7_connected_components(s, d):
    mask = fx.voxels(s, d).where("value > 700").select(*BY, "y", "x", "z", "value")
    return stats.component_stats(stencil.connected_components(mask, BY), [*BY, "component"]).drop("component")


@query()
def d4_detect_cells_3d(s, d):
    return tiles.detect_cells_3d(fx.voxels(s, d), tiles.Detection(1.0, 0.5, 0.25, 16, 64))


@query()
def d5_detect_cells_2d(s, d):
    # All samples in one stack, so that most places of a section have a value.
    plane = fx.voxels(s, d).groupBy("z", "y", "x").agg(F.max("value").alias("value"))
    return tiles.detect_cells_2d(plane, tiles.Detection(1.0, 0.3, 0.15), ["z"])


@query()
def d7_candidate_views(s, d):
    c = clean.keep_in_volume(fx.cells(s, d), XYZ_SIZE).withColumn("cell_id", F.xxhash64("x", "y", "z", "intensity", "diameter"))
    return tiles.candidate_views(c.dropDuplicates(["cell_id"]), fx.voxels(s, d), 1)


@query()
def d8_artifact_classifier(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("view"), (F.col("label") < 5).cast("int").alias("label"))
    parts = stats.hash_split(e, "cell_id")
    model = points.ArtifactClassifier().fit(parts.where("training"))
    return model.score(parts).select("cell_id", "training", "label", "predicted")


@query()
def d12_extract_points_slices(s, d):
    return points.extract_points_slices(fx.voxels(s, d), 0.9, 20, BY).select(*BY, "y", "x", "z")


@query()
def d14_cluster_points(s, d):
    return spatial.cluster_points(fx.points(s, d), 2.0).select("point_id", "component")


@query()
def k5_thin_points(s, d):
    return spatial.thin_points(fx.points(s, d), 3.0).select("point_id")


@query()
def k6_keep_by_distance(s, d):
    return spatial.keep_by_distance(fx.points(s, d)).select("point_id")


@query()
def g26_fit_lines(s, d):
    return stats.fit_lines(fx.points(s, d).withColumnRenamed("slice", "probe_id"))


@query()
def g32_poisson_cross_validated(s, d):
    c = fx.cells(s, d).groupBy((F.col("y").cast("int") % 4).alias("fold"), "x", "z").agg(F.count("*").alias("n"))
    return stats.poisson_cross_validated(c, ["x", "z"], "n", "fold")


@query()
def g33_projection_strength(s, d):
    m = fx.cells(s, d).groupBy("sample_id", F.col("y").cast("int").alias("row")).agg(F.sum("intensity").alias("value"))
    return stats.projection_strength(m, "row")


@query()
def a8_trace_probes(s, d):
    p = fx.points(s, d).withColumnRenamed("slice", "probe_id")
    return align.trace_probes(p, fx.annotation(s, d), fx.terms(s, d), SIZE, 40)


@query(_TRILINEAR + """, moved as (select point_id, x - sx as x, y - sy as y, z - sz as z from (select point_id, x, y, z from points) join shift using (point_id))
select point_id, round(x - 1.5, 4) as x, round(y / 2 - 1, 4) as y, round(z + 3, 4) as z from moved""")
def j6_points_to_atlas(s, d):
    back = [[1.0, 0, 0, 1.5], [0, 2.0, 0, 2.0], [0, 0, 1.0, -3.0], [0, 0, 0, 1]]
    p = fx.points(s, d).withColumns({c: F.col(c) + 1 for c in "xyz"})
    out = lookup.points_to_atlas(p, fx.field(s, d), [2.0, 2.0, 2.0], (40, 24, 32), [1, 2, 3], 1.0, back)
    return rounded(out.select("point_id", "x", "y", "z"), ["x", "y", "z"])


# More operators, each row of the result checked


@query("select s_suppkey as id, s_name as name from supplier where s_name = 'Supplier#000000003'", False)
def s11_atlas_registry(s, d):
    return sources.atlas_registry(s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as id", "s_name as name"), "Supplier#000000003")


_IMPLANTS = "s_suppkey as implant_id, cast(s_suppkey % 40 + 1 as double) as cy, s_suppkey % 24 + cast(0.5 as double) as cx, cast(s_suppkey % 32 + 1 as double) as cz, cast(1 + s_suppkey % 3 as double) as radius"
_DISC = f""", implants as (select {_IMPLANTS} from supplier),
disc as (select implant_id, dp.v as depth, radius, cast(a.g as double) as g1, cast(b.g as double) as g2, least(greatest(cy + a.g, 1), 40) as y, least(greatest(cx + b.g, 1), 24) as x, least(greatest(cz + dp.v, 1), 32) as z
from implants, (values (0.0), (2.0)) dp(v), (select range - 6 as g from range(13)) a, (select range - 6 as g from range(13)) b where abs(a.g) <= 2 * radius and abs(b.g) <= 2 * radius)
"""


def _implants(s, d) -> DataFrame:
    """Cylinders along z, their discs along y and x."""
    axes = {"uy": 1.0, "ux": 0.0, "uz": 0.0, "vy": 0.0, "vx": 1.0, "vz": 0.0, "ny": 0.0, "nx": 0.0, "nz": 1.0}
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr(*(c.strip() for c in _IMPLANTS.split(", "))).withColumns({k: F.lit(v) for k, v in axes.items()})


@query(_DISC + "select implant_id, cast(depth as double) as depth, g1, g2, coalesce(a.region_id, 0) as region_id from disc left join annotation a on a.y = round(disc.y) and a.x = round(disc.x) and a.z = round(disc.z)")
def j19_sample_disc(s, d):
    return lookup.sample_disc(_implants(s, d), fx.annotation(s, d), SIZE, [0.0, 2.0]).select("implant_id", "depth", "g1", "g2", "region_id")


_DISC_VALUES = _DISC + """, flat as (select channel, y, x, z, max(value) as value from voxels group by all), chans as (select distinct channel from flat),
vals as (select implant_id, depth, radius, g1, g2, c.channel, case when disc.x = floor(disc.x) then coalesce(a.value, 0) when a.value is null or b.value is null then 0 else a.value * (1 - disc.x + floor(disc.x)) + b.value * (disc.x - floor(disc.x)) end as value
from disc cross join chans c left join flat a on a.channel = c.channel and a.y = disc.y and a.z = disc.z and a.x = floor(disc.x) left join flat b on b.channel = c.channel and b.y = disc.y and b.z = disc.z and b.x = floor(disc.x) + 1)
"""


def _disc_values(s, d) -> DataFrame:
    flat = fx.voxels(s, d).groupBy("channel", "y", "x", "z").agg(F.max("value").alias("value"))
    return lookup.sample_disc_intensity(_implants(s, d), flat, SIZE, [0.0, 2.0])


@query(_DISC_VALUES + "select implant_id, cast(depth as double) as depth, g1, g2, channel, round(value, 4) as value from vals")
def j20_sample_disc_intensity(s, d):
    return rounded(_disc_values(s, d).select("implant_id", "depth", "g1", "g2", "channel", "value"), ["value"])


@query(_DISC_VALUES + "select implant_id, cast(depth as double) as depth, channel, round(quantile_cont(value, 0.5), 6) as median from vals where g1 * g1 + g2 * g2 <= radius * radius group by all")
def g28_depth_profile(s, d):
    return rounded(stats.depth_profile(_disc_values(s, d)), ["median"], 6)


@query("select vec_id as cell_id, nullif(label, 3) as label from embeddings where label <> 3", False)
def j21_attach_labels(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return lookup.attach_labels(e.select(F.col("vec_id").alias("cell_id")), e.select(F.col("vec_id").alias("cell_id"), F.expr("nullif(label, 3)").alias("label")))


J25_SQL = """, src as (select g.y as oy, g.x as ox, g.z as oz, g.x - coalesce(dx, 0) as sx, g.y - coalesce(dy, 0) as sy, g.z - coalesce(dz, 0) as sz from grid g left join field f on f.i = g.x and f.j = g.y and f.k = g.z),
corner as (select oy, ox, oz, floor(sx) + cx.v as x, floor(sy) + cy.v as y, floor(sz) + cz.v as z, (case when cx.v = 1 then sx - floor(sx) else 1 - sx + floor(sx) end) * (case when cy.v = 1 then sy - floor(sy) else 1 - sy + floor(sy) end) * (case when cz.v = 1 then sz - floor(sz) else 1 - sz + floor(sz) end) as w from src, (values (0), (1)) cx(v), (values (0), (1)) cy(v), (values (0), (1)) cz(v))
select sample_id, channel, oy as y, ox as x, oz as z, round(sum(w * value), 5) as value from corner c join voxels v on v.y = c.y and v.x = c.x and v.z = c.z where w > 0 group by all"""


@query(J25_SQL)
def j25_warp_volume_field(s, d):
    one = [[float(i == k) for k in range(4)] for i in range(4)]
    return rounded(lookup.warp_volume_field(fx.voxels(s, d), fx.field(s, d), one, SIZE), ["value"], 5)


_FLAT = ", flat as (select sample_id, y, z, max(value) as value from voxels group by all)"


def _flat(s, d) -> DataFrame:
    return fx.voxels(s, d).groupBy("sample_id", "y", "z").agg(F.max("value").alias("value"))


@query(_FLAT + """, one as (select v.sample_id, v.y, v.z, sum(exp(-((w.y - v.y) ** 2) / 2.0) * w.value) / sum(exp(-((w.y - v.y) ** 2) / 2.0)) as value from flat v join flat w on w.sample_id = v.sample_id and w.z = v.z and abs(w.y - v.y) <= 3 group by all)
select v.sample_id, v.y, v.z, round(sum(exp(-((w.z - v.z) ** 2) / 2.0) * w.value) / sum(exp(-((w.z - v.z) ** 2) / 2.0)), 4) as value from one v join one w on w.sample_id = v.sample_id and w.y = v.y and abs(w.z - v.z) <= 3 group by all""")
def w5_gaussian_smooth(s, d):
    return rounded(stencil.gaussian_smooth(_flat(s, d), 1.0, ["sample_id"], ("y", "z")), ["value"])


@query(_FLAT + """, near as (select v.*, a.value as y0, b.value as y1, c.value as z0, e.value as z1 from flat v left join flat a on a.sample_id = v.sample_id and a.z = v.z and a.y = v.y - 1 left join flat b on b.sample_id = v.sample_id and b.z = v.z and b.y = v.y + 1
left join flat c on c.sample_id = v.sample_id and c.y = v.y and c.z = v.z - 1 left join flat e on e.sample_id = v.sample_id and e.y = v.y and e.z = v.z + 1)
select sample_id, y, z, round(sqrt(coalesce((y1 - y0) / 2, y1 - value, value - y0, 0) ** 2 + coalesce((z1 - z0) / 2, z1 - value, value - z0, 0) ** 2), 4) as gradient from near""")
def w9_gradient_magnitude(s, d):
    return rounded(stencil.gradient_magnitude(_flat(s, d), ["sample_id"], ("y", "z")).select("sample_id", "y", "z", "gradient"), ["gradient"])


@query("""select slice, point_id, round(exp(sum(ln(k)) over w), 6) as scale, round(sum(shift * coalesce(before, 1)) over w, 4) as shift
from (select *, exp(sum(ln(k)) over (partition by slice order by point_id rows between unbounded preceding and 1 preceding)) as before from (select slice, point_id, 1 + (x - 20) / 1000 as k, y as shift from points)) window w as (partition by slice order by point_id)""")
def w16_compose_along(s, d):
    """Scales and shifts, which do not commute."""
    m = fx.points(s, d).select("slice", "point_id", F.array(1 + (F.col("x") - 20) / 1000, F.col("y"), F.lit(0.0), F.lit(1.0)).alias("m"))
    found = series.compose_along(m, ["slice"], "point_id", n=2).select("slice", "point_id", F.get("m", F.lit(0)).alias("scale"), F.get("m", F.lit(1)).alias("shift"))
    return rounded(rounded(found, ["shift"]), ["scale"], 6)


@query("""select slice, point_id, round(median(y) over w, 4) as y, round(atan2(median(sin(x)) over w, median(cos(x)) over w), 4) as x from points window w as (partition by slice order by point_id rows between 2 preceding and 2 following)""")
def w18_smooth_transforms(s, d):
    return rounded(series.smooth_transforms(fx.points(s, d).select("slice", "point_id", "x", "y"), 2, ["slice"], "point_id", ["y"], "x"), ["x", "y"])


@query("select channel, least(count(*), 400) as n from cells group by 1")
def k7_cap_per_class(s, d):
    c = fx.cells(s, d).withColumn("k", F.xxhash64("sample_id", "x", "y", "z", "intensity", "diameter"))
    return _rows(stats.cap_per_class(c, 400, "channel", "k"), ["channel"])


_FILES = "p_size as folder, case when p_partkey % 5 = 0 then concat('x', cast(p_partkey as varchar(9))) when p_partkey % 5 = 1 then concat('chan', lpad(cast(p_partkey % 100 as varchar(9)), 2, '0'), '.raw') else concat('chan', lpad(cast(p_partkey % 100 as varchar(9)), 2, '0'), '_', cast(p_partkey as varchar(9)), '.tif') end as name"


@query(f"""select folder, name, place, coalesce(nullif(regexp_extract(name, '^chan[0-9]+_(.+)\\.tiff?$', 1), ''), concat('ch', cast(place as varchar))) as channel from (select *, row_number() over (partition by folder order by coalesce(try_cast(nullif(regexp_extract(name, '^chan([0-9]+)', 1), '') as int), 0), name) as place from (select {_FILES} from part))""", False)
def k9_order_channels(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    files = p.selectExpr("p_size as folder", _FILES.split(" as folder, ", 1)[1])
    return sources.order_channels(files)


@query("select sample_id, channel, x, y, z, n from (select sample_id, channel, x, y, z, count(*) as n from cells where z < 17 group by all union all select sample_id, channel, x, y, z, count(*) as n from cells where z >= 17 group by all)")
def u1_union_tiles(s, d):
    c = fx.cells(s, d)
    return _rows(tiles.union_tiles(c.where("z < 17"), c.where("z >= 17").withColumn("tile", F.lit(2))), [*BY, "x", "y", "z"])


@query("select point_id, 0.0 as ex, 0.0 as ey, round(degrees(a), 4) as ez, 1.0 as az, round(a, 4) as angle, round(-sin(-a), 4) as flat_1, 0.1 + z as flat_2 from (select point_id, z, 0.1 + (point_id % 28) / 10.0 as a from points)")
def f5_f6_f7_rotations(s, d):
    a = fx.points(s, d).select("point_id", "z", (0.1 + (F.col("point_id") % 28) / 10.0).alias("a"))
    zero, one = F.lit(0.0), F.lit(1.0)
    r = [[F.cos("a"), -F.sin("a"), zero], [F.sin("a"), F.cos("a"), zero], [zero, zero, one]]
    e, axis, flat = fn.euler_angles(r), fn.axis_angle(r), fn.rigid_3d_to_2d(r, [zero, 0.1 + F.col("z"), zero])
    out = a.select("point_id", *(c.alias(f"e{n}") for c, n in zip(e, "xyz")), axis["z"].alias("az"), axis["angle"].alias("angle"), F.get(flat, F.lit(1)).alias("flat_1"), F.get(flat, F.lit(5)).alias("flat_2"))
    return rounded(out, ["ex", "ey", "ez", "az", "angle", "flat_1"])


@query("""select slice, round(a, 6) as r0, round(b * c * (a - 1) / (b * b + c * c), 6) + 0 as r_bc, round(-c, 6) as r_c, round(b, 6) as r_b, round(a + (1 - a) * b * b / (b * b + c * c), 6) as r_end from (select slice, -x / l as a, -y / l as b, -z / l as c from (select slice, avg(x) as x, avg(y) as y, avg(z) as z, sqrt(avg(x) ** 2 + avg(y) ** 2 + avg(z) ** 2) as l from points group by 1))""")
def f8_rotation_from_mean_normal(s, d):
    mean = fx.points(s, d).groupBy("slice").agg(*(F.avg(c).alias(c) for c in "xyz"))
    m = mean.select("slice", fn.rotation_from_mean_normal("x", "y", "z").alias("m"))
    # Axes come in the order third, first, second, transposed: entry (1, 1) is the turn's (0, 0).
    at = lambda i, k: F.get("m", F.lit(3 * i + k))
    return rounded(m.select("slice", at(1, 1).alias("r0"), at(0, 2).alias("r_bc"), at(0, 1).alias("r_c"), at(1, 2).alias("r_b"), at(0, 0).alias("r_end")), ["r0", "r_bc", "r_c", "r_b", "r_end"], 6)


@query("select point_id, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from points")
def f9_compose_and_invert(s, d):
    there = geometry.apply_affine(fx.points(s, d), MATRIX)
    return rounded(geometry.apply_affine(there, lookup.invert(MATRIX)).select("point_id", "x", "y", "z"), ["x", "y", "z"])


@query("""select p_partkey, translate(lower(concat(p_name, ', A_b')), '_,', ' ') as plain, p_partkey % 40 as channel, concat('chan', lpad(cast(p_size as varchar), 2, '0'), '_counts') as file, case p_partkey % 3 when 0 then 7 when 1 then 8 end as code from part""", False)
def f10_f11_f12_f15_names(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(
        "p_partkey", fn.plain_name(F.concat("p_name", F.lit(", A_b"))).alias("plain"), fn.channel_number(F.concat(F.lit("chan_"), (F.col("p_partkey") % 40).cast("string"), F.lit("_x.tif"))).alias("channel"),
        fn.channel_file("p_size", "counts").alias("file"), fn.code_of((F.col("p_partkey") % 3).cast("string"), {"0": 7, "1": 8}).alias("code"),
    )


@query("""select vec_id, round(list_sum(list_transform(v, lambda x, i: x * (len(v) - i + 1))), 3) as running, round(v[len(v)] - v[1], 5) as steps, round(list_sum(list_transform(range(5), lambda k: 2 + k * 0.5)), 4) as line from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)""", False)
def f14_arrays(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    out = e.select("vec_id", total(fn.cumulative("v")).alias("running"), total(fn.differences("v")).alias("steps"), total(fn.linspace(2, 4, 5)).alias("line"))
    return rounded(rounded(rounded(out, ["running"], 3), ["steps"], 5), ["line"])


@query("""select point_id, round(case when a > 0.9 then -c / sqrt(c * c + a * a) else 0 end, 5) + 0 as ux, round(case when a > 0.9 then 0 else c / sqrt(c * c + b * b) end, 5) + 0 as uy, round(case when a > 0.9 then a / sqrt(c * c + a * a) else -b / sqrt(c * c + b * b) end, 5) + 0 as uz, 0.0 as dot from (select point_id, x / l as a, y / l as b, z / l as c from (select point_id, x, y, z, sqrt(x * x + y * y + z * z) as l from points))""")
def f16_plane_basis(s, d):
    p = fx.points(s, d)
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    n = p.select("point_id", *((F.col(c) / length).alias(c) for c in "xyz"))
    b = fn.plane_basis("x", "y", "z")
    dot = F.abs(b[0] * b[3] + b[1] * b[4] + b[2] * b[5]) + F.abs(b[3] * F.col("x") + b[4] * F.col("y") + b[5] * F.col("z"))
    return rounded(n.select("point_id", *(c.alias(f"u{k}") for c, k in zip(b, "xyz")), dot.alias("dot")), ["ux", "uy", "uz", "dot"], 5)


@query("""select sample_id, channel, tz, ty, tx, count(*) as voxels, tz * 16 + 1 as z0, ty * 16 + 1 as y0, tx * 16 + 1 as x0 from voxels v, (select range as tz from range(4)) a, (select range as ty from range(4)) b, (select range as tx from range(4)) c
where v.z between tz * 16 and tz * 16 + 17 and v.y between ty * 16 - 3 and ty * 16 + 20 and v.x between tx * 16 - 3 and tx * 16 + 20 group by all""")
def d1_tile_bounds(s, d):
    options = tiles.Detection(1.0, nz=16, nxy=16)
    return tiles.tile_bounds(tiles.make_tiles(fx.voxels(s, d), options), options)


@query("""select v.sample_id, v.channel, v.y, v.x, v.z, round(v.value, 4) as value from voxels v where v.value > 480 and exists (select 1 from voxels p where p.sample_id = v.sample_id and p.channel = v.channel and p.value > 600 and abs(p.y - v.y) <= 1 and abs(p.x - v.x) <= 1 and abs(p.z - v.z) <= 1
and not exists (select 1 from voxels w where w.sample_id = p.sample_id and w.channel = p.channel and w.z = p.z and abs(w.y - p.y) <= 2 and abs(w.x - p.x) <= 2 and w.value > p.value + 0.001))""")
def d6_cell_mask(s, d):
    return rounded(tiles.cell_mask(fx.voxels(s, d), 2, 600.0, cube=1).select(*BY, "y", "x", "z", "value"), ["value"])


@query()
def d6_detect_cells_sql(s, d):
    return tiles.detect_cells_sql(fx.voxels(s, d), 2, 600.0, SIZE, cube=1)


@query(_CLOUDS + """, near as (select a.point_id, b.point_id as other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as dist from sample_cloud a join sample_cloud b on a.point_id <> b.point_id),
m as (select point_id, avg(dist) as m from (select *, row_number() over (partition by point_id order by dist, other) as r from near) where r <= 3 group by 1) select point_id from m where m <= (select round(avg(m) + stddev_samp(m), 9) from m)""")
def d13_denoise_points(s, d):
    return spatial.denoise_points(_cloud(s, d, "customer", "c_custkey"), 3, 4.0).select("point_id")


@query(""", flat as (select y, x, z as slice, max(value) as value from voxels group by all), positions as (select distinct slice, slice * 3 - slice % 2 as position from flat),
planes as (select unnest(range((select min(position) from positions), (select max(position) from positions) + 1)) as z), chosen as (select z, arg_min(slice, (abs(position - z), position)) as slice from planes cross join positions group by 1)
select z, y, x, round(value, 4) as value from flat join chosen using (slice)""")
def a6_place_slices(s, d):
    flat = fx.voxels(s, d).groupBy("y", "x", F.col("z").alias("slice")).agg(F.max("value").alias("value"))
    positions = flat.select("slice", (F.col("slice") * 3 - F.col("slice") % 2).alias("position")).distinct()
    return rounded(align.place_slices(flat, positions), ["value"])


@query("select slice as probe_id, count(*) as n, round(avg(x), 4) as ox, round(avg(y), 4) as oy, round(avg(z), 4) as oz from points group by 1 having count(*) >= 2")
def g26_line_centres(s, d):
    return rounded(stats.fit_lines(fx.points(s, d).withColumnRenamed("slice", "probe_id")).select("probe_id", "n", "ox", "oy", "oz"), ["ox", "oy", "oz"])


@query("select sample_id, channel, x, y, z, round(intensity * 2, 4) as intensity, count(*) as n from cells group by sample_id, channel, x, y, z, intensity")
def x2_map_batches(s, d):
    c = fx.cells(s, d).select(*BY, "x", "y", "z", "intensity")
    doubled = udf.map_batches(c, lambda p: p.assign(intensity=p["intensity"] * 2), c.schema)
    return _rows(rounded(doubled, ["intensity"]), [*BY, "x", "y", "z", "intensity"])


@query("select slice, kind, point_id from (select slice, 'first' as kind, min(point_id) as point_id from points group by 1 union all select slice, 'last', max(point_id) from points group by 1)")
def x3_map_tiles(s, d):
    p = fx.points(s, d).select("slice", "point_id")

    def ends(pdf):
        return pdf.iloc[[0, 0]].assign(kind=["first", "last"], point_id=[pdf["point_id"].min(), pdf["point_id"].max()])[["slice", "kind", "point_id"]]

    return udf.map_tiles(p, ["slice"], ends, f"slice int, kind string, point_id {p.schema['point_id'].dataType.simpleString()}")


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * 2 + 1)), 3) as total from embeddings", False)
def x4_map_values(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = udf.map_values(e, "v", lambda x: x * 2 + 1)
    return out.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


# Fits and alignments whose result is known: the tables' points and the same under a known map


def _matrix(s, m) -> DataFrame:
    return s.createDataFrame([(i, k, round(float(v), 5) + 0.0) for i, row in enumerate(m) for k, v in enumerate(row)], "i int, k int, value double")


def _known(m, table: str = "points") -> str:
    rows = ", ".join(f"({i}, {k}, cast({v} as double))" for i, row in enumerate(m) for k, v in enumerate(row))
    return f"select i, k, value from (values {rows}) known(i, k, value) where (select count(*) from {table}) > 0"


#: A turn about z of which sine and cosine are 0.6 and 0.8, and a shift; the same with scale 2.5.
TURN = [[0.8, -0.6, 0.0, 1.5], [0.6, 0.8, 0.0, -2.0], [0.0, 0.0, 1.0, 0.25], [0.0, 0.0, 0.0, 1.0]]
SCALED = [[2.0, -1.5, 0.0, 1.5], [1.5, 2.0, 0.0, -2.0], [0.0, 0.0, 2.5, 0.25], [0.0, 0.0, 0.0, 1.0]]
SHIFT = [[1.0, 0.0, 0.0, -0.125], [0.0, 1.0, 0.0, 0.0625], [0.0, 0.0, 1.0, 0.25], [0.0, 0.0, 0.0, 1.0]]


def _pairs(s, d, m) -> DataFrame:
    p = fx.points(s, d).select("point_id", "x", "y", "z")
    moved = geometry.apply_affine(p.withColumns({"u": F.col("x"), "v": F.col("y"), "w": F.col("z")}), m, cols=("u", "v", "w"))
    return moved


@query(_known(SHIFT, "customer"))
def a1_icp(s, d):
    c = _cloud(s, d, "customer", "c_custkey")
    moved = geometry.apply_affine(c, SHIFT, inverse=True)
    return _matrix(s, align.icp(c, moved, rounds=4, width=2.0)[0])


@query("select slice, true as flipped, 0.0 as error from points group by 1 having count(*) >= 10")
def a4_flip_decision(s, d):
    p = fx.points(s, d).withColumn("x", F.col("x") + 0.03 * F.col("point_id") % 7)  # no mirror image of itself
    found = align.flip_decision(p.select("slice", (39 + 1 - F.col("x")).alias("x"), "y"), p.select("slice", "x", "y"), 39)
    return rounded(found.select("slice", "flipped", "error"), ["error"])


@query("select slice, point_id, round(2.0 * row_number() over (partition by slice order by point_id) + 1, 3) as v from points")
def w17_smooth_path(s, d):
    w = Window.partitionBy("slice").orderBy("point_id")
    p = fx.points(s, d).select("slice", "point_id", F.row_number().over(w).alias("r"))
    path = p.select("slice", "point_id", F.when(F.col("r") % 3 == 1, 2.0 * F.col("r") + 1).alias("v"))
    return rounded(series.smooth_path(path, "slice", "point_id", ["v"], 0.5), ["v"], 3)


#: The LDL' factors of the whole path's system, one row after another, down and back.
@query(""", r as (select slice, point_id, value / 1000 as y, row_number() over (partition by slice order by point_id) as r, count(*) over (partition by slice) as n from points),
a as (select slice, point_id, r, n, case when r % 3 = 1 then y end as y, case when r % 3 = 1 then 1.0 else 0.0 end + 5.0 * (case when r <= n - 2 then 1 else 0 end + case when r between 2 and n - 1 then 4 else 0 end + case when r >= 3 then 1 else 0 end) + 1e-9 as main,
  -10.0 * (case when r <= n - 2 then 1 else 0 end + case when r between 2 and n - 1 then 1 else 0 end) as one, case when r <= n - 2 then 5.0 else 0.0 end as two from r where n >= 4),
down as (
  select slice, r, n, main::double as d, (one / main)::double as l1, (two / main)::double as l2, coalesce(y, 0)::double as z, 0::double as pd, 0::double as pl, 0::double as pz from a where r = 1
  union all
  select slice, r, n, e, (one - l1 * l2 * d) / e, two / e, coalesce(y, 0) - l1 * z - pl * pz, d, l2, z from (select a.slice, a.r, a.n, one, two, y, main - l1 * l1 * d - pl * pl * pd as e, d, l1, l2, z, pl, pz from down join a on a.slice = down.slice and a.r = down.r + 1)),
up as (
  select slice, r, z / d as v, 0::double as w from down where r = n
  union all select t.slice, t.r, t.z / t.d - t.l1 * up.v - t.l2 * up.w, up.v from up join down t on t.slice = up.slice and t.r = up.r - 1)
select r.slice, point_id, round(coalesce(up.v, case when r.r % 3 = 1 then y end), 3) + 0 as v from r left join up on up.slice = r.slice and up.r = r.r""")  # fmt: skip
def w17_smooth_path_in_blocks(s, d):
    w = Window.partitionBy("slice").orderBy("point_id")
    p = fx.points(s, d).select("slice", "point_id", F.col("value") / 1000, F.row_number().over(w).alias("r")).toDF("slice", "point_id", "y", "r")
    path = p.select("slice", "point_id", F.when(F.col("r") % 3 == 1, F.col("y")).alias("v"))
    return rounded(series.smooth_path(path, "slice", "point_id", ["v"], 5.0, block=40), ["v"], 3)


_WHITE = ["concat(n_name, case when n_nationkey % 4 = 0 then ' FUNICULUS' when n_nationkey % 7 = 3 then ' fasciculus' else '' end) as name", "concat(n_nationkey, ', ,x', n_name, ', ', n_nationkey + 6) as children"]


@query(""", l as (select sample_id, channel, y, x, z, cast(floor(value) as bigint) % 25 as region_id from voxels),
wm as (select n_nationkey as region_id from nation where n_nationkey % 4 = 0 or n_nationkey % 7 = 3 union select n_nationkey + 6 from nation where n_nationkey % 4 = 0 or n_nationkey % 7 = 3),
m as (select sample_id, channel, z, y, x, case when region_id in (select region_id from wm) then 1 else 0 end as w, case when region_id > 0 then 1 else 0 end as i from l),
c as (select m.*, coalesce(u.w, m.w) as uw, coalesce(d.w, m.w) as dw, coalesce(u.i, m.i) as ui, coalesce(d.i, m.i) as di from m left join m u on u.sample_id = m.sample_id and u.channel = m.channel and u.z = m.z and u.x = m.x and u.y = m.y - 1
  left join m d on d.sample_id = m.sample_id and d.channel = m.channel and d.z = m.z and d.x = m.x and d.y = m.y + 1),
s as (select sample_id, channel, z, y, x, uw + 2 * w + dw as sw, dw - uw as gw, ui + 2 * i + di as si, di - ui as gi from c),
e as (select s.sample_id, s.channel, s.z, s.y, s.x from s left join s l on l.sample_id = s.sample_id and l.channel = s.channel and l.z = s.z and l.y = s.y and l.x = s.x - 1 left join s r on r.sample_id = s.sample_id and r.channel = s.channel and r.z = s.z and r.y = s.y and r.x = s.x + 1
  where coalesce(r.sw, s.sw) <> coalesce(l.sw, s.sw) or coalesce(l.gw, s.gw) + 2 * s.gw + coalesce(r.gw, s.gw) <> 0 or coalesce(r.si, s.si) <> coalesce(l.si, s.si) or coalesce(l.gi, s.gi) + 2 * s.gi + coalesce(r.gi, s.gi) <> 0),
t as (select *, floor((row_number() over (partition by sample_id, channel, z order by x, y) - 1) / ceil(n / ceil(sqrt(ceil(n / 6))))) as strip from (select *, count(*) over (partition by sample_id, channel, z)::double as n from e)),
b as (select *, row_number() over (partition by sample_id, channel, z, strip order by y, x) - 1 as j, count(*) over (partition by sample_id, channel, z, strip) as k from t)
select sample_id, channel, z, y, x from b where j % 6 = (least(6, k - (j // 6) * 6) - 1) // 2""")  # fmt: skip
def d12_cord_edge_points(s, d):
    labels = fx.voxels(s, d).withColumn("region_id", (F.floor("value") % 25).cast("int"))
    white = points.white_matter_ids(s.read.parquet(f"{d}/nation.parquet").selectExpr(*_WHITE))
    return points.cord_edge_points(labels, white, [*BY, "z"])


from atlasframe.plans import jobs  # noqa: E402, F401  (registers its queries)
