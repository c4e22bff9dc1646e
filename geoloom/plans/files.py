"""Queries of file formats and streams: what is written to the shared folder is read back and measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.storage import new_folder
from geoloom.operators import mesh, rings
from geoloom.plans import bindings as bd
from geoloom.plans.registry import query, rounded
from geoloom.sources import files, formats
from geoloom.streaming import bounds

#: a cuboid a supplier; sides that single precision holds
SOLIDS = "(SELECT s_suppkey AS id, s_suppkey % 5 + 1.0 AS a, s_suppkey % 7 + 1.5 AS b, s_suppkey % 3 + 0.5 AS c FROM supplier)"
VOLUMES = f"SELECT id, CAST(12 AS BIGINT) AS faces, round(CAST(a * b * c AS DOUBLE), 4) AS volume, round(CAST(2 * (a * b + b * c + c * a) AS DOUBLE), 4) AS area FROM {SOLIDS}"


def solids(spark, d):
    k = F.col("s_suppkey")
    sides = (k % 5 + 1.0, k % 7 + 1.5, k % 3 + 0.5)
    triangles = F.array(*[
        F.struct(F.lit(n).cast("long").alias("f"), *[(2.25 + s * bd.CUBE[v][i]).cast("double").alias(f"{c}{x}") for c, v in zip("abc", face, strict=True) for i, (x, s) in enumerate(zip("xyz", sides, strict=True))])
        for n, face in enumerate(bd.CUBE_FACES)
    ])
    return bd.table(spark, d, "supplier").select(k.alias("mesh"), F.explode(triangles).alias("t")).select("mesh", "t.*")


def _id(path):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


def _round_trip(spark, d, kind: str, writer=None):
    folder, extension = new_folder(spark, f"files-{kind.lower()}"), formats.extension_of(kind)
    files.save(files.encode_meshes(solids(spark, d), kind, writer), folder, extension)
    soup = files.read_meshes(spark, folder).withColumn("mesh", _id("path"))
    return rounded(mesh.solid_measures(soup).select(F.col("mesh").alias("id"), "faces", "volume", "area"))


def _register(name: str, kind: str, writer=None) -> None:
    def run(spark, d):
        return _round_trip(spark, d, kind, writer)

    run.__name__ = name
    run.__doc__ = f"Cuboids written as {kind} files and read back."
    query(VOLUMES)(run)


for _kind in formats.WRITERS:
    _register(f"files_{_kind.lower()}", _kind)
_register("files_stl_ascii", "STL", lambda m: formats.write_stl(m, binary=False))
_register("files_ply_binary", "PLY", lambda m: formats.write_ply(m, binary=True))


RECTANGLES = "SELECT s_suppkey AS ring, CAST(4 AS BIGINT) AS corners, round((s_suppkey % 5 + 1.25::DOUBLE) * (s_suppkey % 7 + 1.5::DOUBLE), 4) AS area FROM supplier"


def _ring_trip(spark, d, kind: str):
    k = F.col("s_suppkey")
    corners = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), (1.5 + (k % 5 + 1.25) * x).alias("x"), (2.5 + (k % 7 + 1.5) * y).alias("y")) for i, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    points = bd.table(spark, d, "supplier").select(k.alias("name"), F.lit(0).cast("long").alias("ring"), F.explode(corners).alias("p")).select("name", "ring", "p.*")
    folder = new_folder(spark, f"rings-{kind.lower()}")
    files.save(files.encode_rings(points, "name", kind), folder, formats.extension_of(kind))
    back = files.read_rings(spark, folder).withColumn("ring", _id("path"))
    return rounded(rings.measures(back).select("ring", F.col("n").alias("corners"), F.abs("area").alias("area")))


def _register_rings(kind: str) -> None:
    def run(spark, d):
        return _ring_trip(spark, d, kind)

    run.__name__ = f"ring_files_{kind.lower()}"
    run.__doc__ = f"Rectangles written as {kind} files and read back."
    query(RECTANGLES)(run)


for _kind in formats.RING_WRITERS:
    _register_rings(_kind)


@query("SELECT floor(user_id % 1000 / 50.0)::BIGINT AS i, floor(value / 50)::BIGINT AS j, count(*) AS n FROM events GROUP BY 1, 2")
def stream_cells(spark, d):
    """Events as a stream of points: pixels counted by time windows, run to its end, then summed over the windows."""
    table = bd.table(spark, d, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]")
    points = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 1000).cast("double").alias("x"), F.col("value").alias("y"))
    folder, state = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")

    def keep(batch, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "i", "j", "n").write.mode("overwrite").parquet(folder)

    counted = bounds.windowed_cells(points, "ts", 50.0, "1 day")
    counted.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(folder).groupBy("i", "j").agg(F.sum("n").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def stream_window_bounds(spark, d):
    """The windowed bounds over the whole table at once."""
    points = bd.table(spark, d, "events").select("ts", "event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    w = bounds.windowed_bounds(points, "ts", "event_type", "1 day")
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.col("min_y").alias("low"), F.col("max_y").alias("high"))
