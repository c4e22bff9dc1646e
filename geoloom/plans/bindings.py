"""Geometry views of the driver's tables, each in Spark and, with the same columns, in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows stand for shapes, by key: small files, which few tasks read, with much work to a row.
SHAPES = {"part": "p_partkey", "supplier": "s_suppkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SHAPES:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), SHAPES[name])
    return rows


def points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


POINTS3D = "points3d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("g"), (F.col("user_id") % 1000).cast("double").alias("x"), F.col("value").alias("y"))


POINTS2D = "points2d AS (SELECT event_id AS id, user_id AS \"user\", event_type AS g, CAST(user_id % 1000 AS DOUBLE) AS x, value AS y FROM events)"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").cast("long").alias("ring"), F.col("c_custkey").alias("seq"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))


RINGS = "rings AS (SELECT CAST(n_regionkey AS BIGINT) AS ring, c_custkey AS seq, c_acctbal / 100 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey)"
RING_EDGES = RINGS + """, ring_edges AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq))"""


def ngons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular polygons: ring, seq, x, y, n, r."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("r"), (3 + F.col("p_partkey") % 6).cast("int").alias("n"))
    p = p.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    angle = 2 * math.pi * F.col("seq") / F.col("n")
    cx, cy = (F.col("p_partkey") % 20).cast("double"), F.floor(F.col("p_partkey") / 20).cast("double")
    return p.select(F.col("p_partkey").alias("ring"), F.col("seq").cast("long").alias("seq"), (cx + F.col("r") * F.cos(angle)).alias("x"), (cy + F.col("r") * F.sin(angle)).alias("y"), F.col("n").cast("long").alias("n"), "r")


def boxes(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    x, y = (k * 37 % 400).cast("double"), (k * 61 % 400).cast("double")
    return table(spark, sf_dir, name).select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 1 + k % 5).alias("x1"), (y + 1 + k % 3).alias("y1"))


def boxes_sql(name: str, table_name: str, key: str) -> str:
    return f"{name} AS (SELECT {key} AS id, CAST({key} * 37 % 400 AS DOUBLE) AS x0, CAST({key} * 61 % 400 AS DOUBLE) AS y0, CAST({key} * 37 % 400 AS DOUBLE) + 1 + {key} % 5 AS x1, CAST({key} * 61 % 400 AS DOUBLE) + 1 + {key} % 3 AS y1 FROM {table_name})"


GRID = 16


def surface(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Open height field: vertices (mesh, v, x, y, z) of a grid of customers and faces of its full cells."""
    t = table(spark, sf_dir, "orders")
    cell = t.select((F.col("o_custkey") % GRID).alias("i"), (F.col("o_orderkey") % GRID).alias("j"), "o_totalprice")
    v = cell.groupBy("i", "j").agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("z"))
    v = v.select(F.lit(1).cast("long").alias("mesh"), (F.col("i") * GRID + F.col("j")).alias("v"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "z")
    n = F.col("v")
    cut = v.where((n % GRID < GRID - 1) & (n < GRID * (GRID - 1)))
    for step in (1, GRID, GRID + 1):
        cut = cut.join(v.select((n - step).alias("v")), "v", "left_semi")
    two = F.array(F.struct((n * 2).alias("f"), n.alias("a"), (n + GRID).alias("b"), (n + GRID + 1).alias("c")), F.struct((n * 2 + 1).alias("f"), n.alias("a"), (n + GRID + 1).alias("b"), (n + 1).alias("c")))
    return v, cut.select("mesh", F.explode(two).alias("t")).select("mesh", "t.*")


SURFACE = f"""vertices AS (SELECT CAST(1 AS BIGINT) AS mesh, i * {GRID} + j AS v, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, round(avg(p) / 1000, 3) AS z
  FROM (SELECT o_custkey % {GRID} AS i, o_orderkey % {GRID} AS j, o_totalprice AS p FROM orders) GROUP BY i, j),
 cells AS (SELECT mesh, v FROM vertices q WHERE v % {GRID} < {GRID - 1} AND v < {GRID * (GRID - 1)} AND v + 1 IN (SELECT v FROM vertices) AND v + {GRID} IN (SELECT v FROM vertices) AND v + {GRID + 1} IN (SELECT v FROM vertices)),
 faces AS (SELECT mesh, v * 2 AS f, v AS a, v + {GRID} AS b, v + {GRID + 1} AS c FROM cells UNION ALL SELECT mesh, v * 2 + 1, v, v + {GRID + 1}, v + 1 FROM cells),
 cornered AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
  FROM faces f JOIN vertices p ON f.a = p.v JOIN vertices q ON f.b = q.v JOIN vertices r ON f.c = r.v),
 half AS (SELECT f, least(a, b) AS lo, greatest(a, b) AS hi, a < b AS forward FROM faces UNION ALL SELECT f, least(b, c), greatest(b, c), b < c FROM faces UNION ALL SELECT f, least(c, a), greatest(c, a), c < a FROM faces),
 edges AS (SELECT lo, hi, count(*) AS uses, count(*) FILTER (forward) AS forward_uses, min(CASE WHEN forward THEN f END) AS owner, min(CASE WHEN NOT forward THEN f END) AS other FROM half GROUP BY lo, hi)"""

#: Corners of the unit cube and its twelve triangles, counter-clockwise from outside.
CUBE = [((i >> 0) & 1, (i >> 1) & 1, (i >> 2) & 1) for i in range(8)]
CUBE_FACES = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]


def cuboids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed solids as triangle soup (mesh, f, ax .. cz): a cuboid per part, made by one explode."""
    sides = (F.col("p_size") / 10 + 1, (F.col("p_partkey") % 7 + 1).cast("double"), (F.col("p_partkey") % 3 + 1).cast("double"))
    base = ((F.col("p_partkey") % 20 * 10).cast("double"), F.lit(5.0), F.lit(5.0))
    triangles = F.array(*[
        F.struct(F.lit(n).cast("long").alias("f"), *[(b + s * CUBE[v][i]).alias(f"{c}{axis}") for c, v in zip("abc", face, strict=True) for i, (axis, b, s) in enumerate(zip("xyz", base, sides, strict=True))])
        for n, face in enumerate(CUBE_FACES)
    ])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh"), F.explode(triangles).alias("t")).select("mesh", "t.*")


def mesh_vertices(soup: DataFrame) -> DataFrame:
    from geoloom.operators import mesh

    return mesh.weld(soup, 6)[0]


def cells(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Voxels of the points of one return flag."""
    from geoloom.operators import voxels

    return voxels.voxelize(points3d(spark, sf_dir).where(F.col("g") == flag), 4.0)


def cells_sql(name: str, flag: str) -> str:
    return f"{name} AS (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS i, CAST(floor(y / 4) AS BIGINT) AS j, CAST(floor(z / 4) AS BIGINT) AS k FROM points3d WHERE g = '{flag}')"


NEIGHBOURS = "moves(di, dj, dk) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))"
