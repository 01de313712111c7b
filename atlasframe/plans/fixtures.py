"""Imaging tables derived from the driver's tables: every query reads these, so its
work grows with them. The same expressions serve both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the atlas grid, y, x, z.
SIZE = (40, 24, 32)

_CELLS = {
    "sample_id": "concat('S', cast(l_suppkey % 5 as varchar(9)))",
    "channel": "cast(1 + l_linenumber % 3 as int)",
    "x": "(l_partkey * 7 + l_linenumber * 3) % 26 + cast(0.25 as double)",
    "y": "(l_suppkey * 5 + l_orderkey) % 42 + cast(0.6 as double)",
    "z": "(l_orderkey * 11 + l_linenumber) % 34 + cast(0.75 as double)",
    "intensity": "cast(floor(l_extendedprice) as double) / 100",
    "diameter": "cast(l_quantity as double)",
    "elongation": "round(1 + cast(l_discount as double) * 20, 4)",
}
_POINTS = {
    "point_id": "o_orderkey",
    "slice": "cast(o_orderkey % 30 + 1 as int)",
    "x": "(o_custkey * 7 + o_orderkey) % 38 + cast(1.25 as double)",
    "y": "(o_orderkey * 5) % 22 + cast(1.5 as double)",
    "z": "(o_orderkey * 11) % 30 + cast(1.75 as double)",
    "value": "cast(cast(round(o_totalprice * 100) as bigint) as double) / 100",
}
_ANNOTATION_COLUMNS = (
    "cast(case when pow((y - 20.5) / 20, 2) + pow((x - 12.5) / 12, 2) + pow((z - 16.5) / 16, 2) > 1 then 0 "
    "else 1 + (cast(floor((y - 1) / 8) as bigint) * 5 + cast(floor((x - 1) / 5) as bigint)) % 24 end as int) as region_id"
)
_GRID = "cast(id % 40 + 1 as int) as {0}, cast(cast(floor(id / 40) as bigint) % 24 + 1 as int) as {1}, cast(cast(floor(id / 960) as bigint) % 32 + 1 as int) as {2}"
_FIELD = ["cast((i * 3 + j) % 7 as double) / 10 as dx", "cast((j * 3 + k) % 5 as double) / 10 as dy", "cast((k * 3 + i) % 3 as double) / 10 as dz"]
_VOXEL = ["cast(round(y) as int) as y", "cast(round(x) as int) as x", "cast(round(z) as int) as z"]


def _list(exprs: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in exprs.items()]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*_list(_CELLS))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_list(_POINTS))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse volume per sample and channel: mean intensity of the cells of a voxel."""
    v = cells(spark, sf_dir).selectExpr("sample_id", "channel", *_VOXEL, "cast(round(intensity * 100) as bigint) as v")
    return v.where("y between 1 and 40 and x between 1 and 24 and z between 1 and 32").groupBy("sample_id", "channel", "y", "x", "z").agg((F.floor(F.sum("v") / F.count("*")).cast("double") / 100).alias("value"))


def _grid(spark: SparkSession, a: str, b: str, c: str) -> DataFrame:
    i = F.col("id")
    return spark.range(30720).select((i % 40 + 1).cast("int").alias(a), (F.floor(i / 40) % 24 + 1).cast("int").alias(b), (F.floor(i / 960) % 32 + 1).cast("int").alias(c))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, "y", "x", "z").selectExpr(_ANNOTATION_COLUMNS, "y", "x", "z")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, "i", "j", "k").selectExpr("i", "j", "k", *_FIELD)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    sub = n.selectExpr("n_nationkey as region_id", "'substructure' as term_set", "n_name as name", "concat('N', cast(n_nationkey as varchar(9))) as acronym", "cast((n_nationkey * 10) % 256 as int) as red", "cast((n_nationkey * 20) % 256 as int) as green", "cast((n_nationkey * 30) % 256 as int) as blue")
    mid = n.selectExpr("n_nationkey as region_id", "'structure' as term_set", "concat('STRUCT_', cast(n_nationkey % 8 as varchar(9))) as name", "concat('T', cast(n_nationkey % 8 as varchar(9))) as acronym", "0 as red", "0 as green", "0 as blue")
    top = n.join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr("n_nationkey as region_id", "'division' as term_set", "r_name as name", "substring(r_name, 1, 3) as acronym", "0 as red", "0 as green", "0 as blue")
    return sub.unionByName(mid).unionByName(top)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below their nation below its region: grows with the customers."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    leaf = c.selectExpr("cast(c_custkey + 10000 as bigint) as id", "cast(c_nationkey as bigint) as parent_id", "c_name as name")
    return leaf.unionByName(n.selectExpr("cast(n_nationkey as bigint) as id", "cast(100 + n_regionkey as bigint) as parent_id", "n_name as name")).unionByName(r.selectExpr("cast(100 + r_regionkey as bigint) as id", "cast(1000 as bigint) as parent_id", "r_name as name"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(8).selectExpr("concat('C', cast(id + 1 as varchar(9))) as segment", "cast(1 + 4 * id as double) as start_z", "cast(5 + 4 * id as double) as end_z")


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.selectExpr("cast(o_custkey % 600 as int) as view_id", "o_orderkey as ordinal", "case when o_orderkey % 2 = 0 then 'sample' else 'atlas' end as side", "cast(o_orderkey % 40 as double) as y", "cast(o_orderkey % 23 as double) as x", "cast(o_orderkey % 31 as double) as z")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "concat('S', cast(user_id % 5 as varchar(9))) as sample_id", "event_type as channel", "cast(value as double) as value")


#: The same tables as common table expressions of the oracle.
WITH = f"""
with recursive cells as (select {", ".join(_list(_CELLS))} from lineitem),
points as (select {", ".join(_list(_POINTS))} from orders),
vox as (select sample_id, channel, {", ".join(_VOXEL)}, cast(round(intensity * 100) as bigint) as v from cells),
voxels as (
  select sample_id, channel, y, x, z, cast(floor(sum(v) / count(*)) as double) / 100 as value from vox
  where y between 1 and 40 and x between 1 and 24 and z between 1 and 32 group by all),
grid as (select {_GRID.format("y", "x", "z")} from (select range as id from range(30720))),
annotation as (select y, x, z, {_ANNOTATION_COLUMNS} from grid),
grid_f as (select {_GRID.format("i", "j", "k")} from (select range as id from range(30720))),
field as (select i, j, k, {", ".join(_FIELD)} from grid_f),
terms as (
  select n_nationkey as region_id, 'substructure' as term_set, n_name as name, concat('N', cast(n_nationkey as varchar)) as acronym,
    (n_nationkey * 10) % 256 as red, (n_nationkey * 20) % 256 as green, (n_nationkey * 30) % 256 as blue from nation
  union all select n_nationkey, 'structure', concat('STRUCT_', cast(n_nationkey % 8 as varchar)), concat('T', cast(n_nationkey % 8 as varchar)), 0, 0, 0 from nation
  union all select n_nationkey, 'division', r_name, substring(r_name, 1, 3), 0, 0, 0 from nation join region on r_regionkey = n_regionkey),
tree as (
  select cast(c_custkey + 10000 as bigint) as id, cast(c_nationkey as bigint) as parent_id, c_name as name from customer
  union all select n_nationkey, 100 + n_regionkey, n_name from nation
  union all select 100 + r_regionkey, 1000, r_name from region),
segments as (select concat('C', cast(range + 1 as varchar)) as segment, cast(1 + 4 * range as double) as start_z, cast(5 + 4 * range as double) as end_z from range(8)),
controls as (
  select cast(o_custkey % 600 as int) as view_id, o_orderkey as ordinal, case when o_orderkey % 2 = 0 then 'sample' else 'atlas' end as side,
    cast(o_orderkey % 40 as double) as y, cast(o_orderkey % 23 as double) as x, cast(o_orderkey % 31 as double) as z from orders),
scans as (select event_id, ts, concat('S', cast(user_id % 5 as varchar)) as sample_id, event_type as channel, cast(value as double) as value from events),
placed as (select sample_id, channel, cast(round(x) as int) as x, cast(round(y) as int) as y, cast(round(z) as int) as z, intensity, diameter, elongation from cells),
kept as (select * from placed where x between 1 and 24 and y between 1 and 40 and z between 1 and 32),
labelled as (select k.*, a.region_id, case when k.z > 16 then 'L' else 'R' end as side from kept k join annotation a using (y, x, z))
"""
