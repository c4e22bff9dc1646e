"""Meshes and rings from files and to files.

Files are read by Spark's own ``binaryFile`` source, so any store that Spark reads
will do, and parsed in Arrow batches; one file is one row, parsed by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import formats

SOUP = "path string, mesh string, f long, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz")
RINGS = "path string, ring long, seq long, x double, y double"


def _contents(spark: SparkSession, path: str, wanted: dict) -> DataFrame:
    names = "|".join(k for k, v in formats.EXTENSIONS.items() if v in wanted)
    return spark.read.format("binaryFile").load(path).where(F.col("path").rlike(rf"(?i)\.({names})$")).select("path", "content")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Triangle soup (path, mesh, f, ax .. cz) of all mesh files below ``path``, by extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for i, (own, vertices, faces) in enumerate(formats.READERS[formats.format_of(name)](bytes(data))):
                    corners = vertices[faces].reshape(-1, 9)
                    frame = pd.DataFrame(corners, columns=[f"{c}{a}" for c in "abc" for a in "xyz"])
                    frame.insert(0, "f", np.arange(len(frame)))
                    frame.insert(0, "mesh", own or f"{i}")
                    frame.insert(0, "path", name)
                    yield frame

    return _contents(spark, path, formats.READERS).mapInPandas(run, SOUP)


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """Rings (path, ring, seq, x, y) of all polygon files below ``path``, by extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for i, ring in enumerate(formats.RING_READERS[formats.format_of(name)](bytes(data))):
                    yield pd.DataFrame({"path": name, "ring": i, "seq": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    return _contents(spark, path, formats.RING_READERS).mapInPandas(run, RINGS)


def encode_meshes(soup: DataFrame, kind: str, writer: Callable | None = None) -> DataFrame:
    """(mesh, content): each mesh of a soup as a file of format ``kind``, or as ``writer`` has it."""
    write = writer or formats.WRITERS[kind]
    columns = [f"{c}{a}" for c in "abc" for a in "xyz"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name = str(key[0])
        corners = frame.sort_values("f")[columns].to_numpy(dtype=float)
        vertices, at = np.unique(corners.reshape(-1, 3), axis=0, return_inverse=True)
        return pd.DataFrame({"mesh": [name], "content": [write((name, vertices, at.reshape(-1, 3)))]})

    return soup.groupBy("mesh").applyInPandas(run, "mesh string, content binary")


def encode_rings(points: DataFrame, group: str, kind: str) -> DataFrame:
    """(name, content): the rings of each group as a file of format ``kind``."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rings = [part.sort_values("seq")[["x", "y"]].to_numpy(dtype=float) for _, part in frame.groupby("ring")]
        return pd.DataFrame({"name": [str(key[0])], "content": [formats.RING_WRITERS[kind](rings)]})

    return points.groupBy(group).applyInPandas(run, "name string, content binary")


def save(files: DataFrame, folder: str, extension: str) -> int:
    """Write each (name, content) row as a file below a folder all executors reach; returns their number."""
    name = files.columns[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from geoloom.functions.storage import open_fs

        target, inner = open_fs(folder)
        target.create_dir(inner, recursive=True)
        for batch in batches:
            for own, data in zip(batch[name], batch["content"], strict=True):
                with target.open_output_stream(f"{inner}/{own}.{extension}", compression=None) as sink:
                    sink.write(bytes(data))
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select(name, "content").mapInPandas(run, "n long")
    return int(written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
