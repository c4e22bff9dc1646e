"""Mesh files as a Python data source with planned splits.

``spark.read.format("stl").load(folder)`` gives (path, f, nx, ny, nz, ax .. cz), one row a
triangle.  A file of any size is read by many tasks: a binary STL is cut into ranges of
triangles, whose records are of 50 bytes each, an ASCII one into ranges of bytes, where a
facet belongs to the range in which its keyword begins.  ``format("ply")`` gives
the vertices (path, v, x, y, z) or, with ``option("table", "faces")``, the triangles
(path, f, a, b, c) of little-endian binary files; vertices, and faces if all are triangles
without other properties, are cut into ranges of rows, other faces are one range.

Filters on ``path`` (equality, membership) drop files when the splits are planned, and
bounds on ``f`` or ``v`` drop splits of numbered rows; with a narrower ``schema`` only
those columns are decoded.  ``splitBytes`` is the size of a split (default 32 MB); where
files give more than ``SPLITS`` of them, a task reads several that follow one another, and
of a file with two or more at least two tasks.

Defined results: an empty folder or file has no rows; a file cut short or of another
format is an error; triangles of ASCII files are numbered by the byte they begin at.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from geoloom.functions.storage import materialise, open_fs

SPLIT = 32 << 20
#: Splits that are tasks of their own; of more, several go to a task.
SPLITS = 512
#: Rows of a batch that a task hands to Spark.
ROWS = 50_000
CORNERS = [f"{c}{a}" for c in "abc" for a in "xyz"]
TRIANGLE = np.dtype([("n", "<f4", 3), ("p", "<f4", 9), ("c", "<u2")])
LISTING = "_files.json"
#: Sizes of the scalar types of a PLY header in numpy's names.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


class Split(InputPartition):
    """Rows ``first`` to ``last`` of a file whose records start at ``offset``; for text, bytes."""

    def __init__(self, path: str, kind: str, first: int, last: int, offset: int = 0, record: list | None = None):
        self.path, self.kind, self.first, self.last, self.offset, self.record = path, kind, first, last, offset, record


def joined(splits: list[Split], most: int = SPLITS) -> list[Split]:
    """``splits`` as some ``most`` tasks: those of a file that follow one another are read as one range, but never all of a file's as a single one."""
    if len(splits) <= most:
        return splits
    out: list[Split] = []
    for _, own in itertools.groupby(splits, key=lambda s: s.path):
        own = list(own)
        each = max(1, min(-(-len(splits) // most), -(-len(own) // 2)))
        for at in range(0, len(own), each):
            for s in own[at : at + each]:
                if s is not own[at] and out[-1].last == s.first:
                    out[-1] = Split(s.path, s.kind, out[-1].first, s.last, s.offset, s.record)
                else:
                    out.append(s)
    return out


class _Reader(DataSourceReader):
    number = "f"
    extension = ".stl"

    def __init__(self, options: dict, schema):
        self.options, self.columns = options, [f.name for f in schema.fields]
        self.paths: set | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = values if self.paths is None else self.paths & values
            elif f.attribute == (self.number,) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
                yield f  # splits go, rows are still tested
            elif f.attribute == (self.number,) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = f.value if self.high is None else min(self.high, f.value)
                yield f
            else:
                yield f

    def _files(self) -> Iterator[tuple]:
        from pyarrow import fs

        root = self.options["path"]
        files, inner = open_fs(root)
        info = files.get_file_info(inner)
        if info.type == fs.FileType.File:
            found = {root: info}
        else:
            names = None
            if files.get_file_info(f"{inner}/{LISTING}").type == fs.FileType.File:
                with files.open_input_stream(f"{inner}/{LISTING}") as source:
                    names = set(json.loads(source.read()))
            below = files.get_file_info(fs.FileSelector(inner, recursive=True))
            found = {f"{root.rstrip('/')}/{x.path[len(inner.rstrip('/')) + 1 :]}": x for x in below if x.type == fs.FileType.File and x.path.lower().endswith(self.extension) and (names is None or x.base_name in names)}
        for path in sorted(found):
            if self.paths is None or path in self.paths:
                yield files, found[path], path

    def _ranges(self, path: str, kind: str, rows: int, size: int, offset: int, record: list | None = None) -> Iterator[Split]:
        """Splits of numbered rows of ``size`` bytes that the filters leave."""
        step = max(1, int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT))) // max(1, size))
        for first in range(0, rows, step):
            last = min(rows, first + step)
            if last > self.low and (self.high is None or first <= self.high):
                yield Split(path, kind, first, last, offset, record)

    def _batch(self, values: dict):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(values[c]()) for c in self.columns], names=self.columns)


class StlReader(_Reader):
    def partitions(self) -> list[Split]:
        out: list[Split] = []
        for files, info, path in self._files():
            with files.open_input_file(info.path) as source:
                head = source.read(84)
            if len(head) == 84 and info.size == 84 + 50 * struct.unpack_from("<I", head, 80)[0]:
                out += self._ranges(path, "binary", struct.unpack_from("<I", head, 80)[0], 50, 84)
            elif head.lstrip()[:5].lower() == b"solid":
                out += self._ranges(path, "text", info.size, 1, 0)
            elif head:
                raise ValueError(f"{path} is no STL file, or is cut short")
        return joined(out)

    def read(self, partition: Split | None) -> Iterator:
        if partition is None:  # no file at all
            return
        files, inner = open_fs(partition.path)
        with files.open_input_file(inner) as source:
            yield from (self._binary if partition.kind == "binary" else self._text)(source, partition)

    def _rows(self, path: str, numbers: np.ndarray, normals: np.ndarray, corners: np.ndarray):
        values = {"path": lambda: [path] * len(numbers), "f": lambda: numbers}
        values |= {f"n{a}": (lambda i=i: normals[:, i].astype(np.float64)) for i, a in enumerate("xyz")}
        values |= {c: (lambda i=i: corners[:, i].astype(np.float64)) for i, c in enumerate(CORNERS)}
        return self._batch(values)

    def _binary(self, source, s: Split) -> Iterator:
        source.seek(s.offset + 50 * s.first)
        for first in range(s.first, s.last, ROWS):
            n = min(ROWS, s.last - first)
            table = np.frombuffer(source.read(50 * n), TRIANGLE)
            if len(table) < n:
                raise ValueError(f"{s.path} is cut short")
            yield self._rows(s.path, np.arange(first, first + n), table["n"], table["p"])

    def _text(self, source, s: Split) -> Iterator:
        start = max(0, s.first - 1)  # a keyword at the very start must see what is before it
        source.seek(start)
        data = source.read(s.last - start)
        # the last facet may go on behind the range; keywords cut in two are found in what follows
        found = [m for m in re.finditer(rb"(?i)(?<![a-z])facet\s", data + source.read(6)) if s.first <= start + m.start() < s.last and data[: m.start()].rstrip()[-3:].lower() != b"end"]
        if not found:
            return
        source.seek(start + len(data))
        tail = b""
        while not re.search(rb"(?i)endfacet", tail):
            more = source.read(1 << 14)
            if not more:
                break
            tail += more
        data += tail
        for a in range(0, len(found), ROWS):
            part = found[a : a + ROWS]
            ends = [*(m.start() for m in found[a + 1 : a + ROWS + 1]), len(data)][: len(part)]
            rows = []
            for m, end in zip(part, ends, strict=True):
                words = re.split(rb"(?i)endfacet", data[m.start() : end])[0].split()
                numbers = [w for w in words if re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|[-+]?(nan|inf)", w)]
                if len(numbers) != 12:
                    raise ValueError(f"a facet of {s.path} at byte {start + m.start()} has {len(numbers)} numbers")
                rows.append(numbers)
            table = np.array(rows, dtype="S32").astype(np.float64)
            yield self._rows(s.path, np.array([start + m.start() for m in part]), table[:, :3], table[:, 3:])


class PlyReader(_Reader):
    extension = ".ply"

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.faces = str(options.get("table", "vertices")).lower() == "faces"
        self.number = "f" if self.faces else "v"

    @staticmethod
    def _header(source, path: str) -> tuple[int, list]:
        """Bytes of the header, and the elements (name, rows, properties)."""
        data = source.read(1 << 16)
        end = re.search(rb"end_header\r?\n", data)
        if not data.startswith(b"ply") or end is None or b"format binary_little_endian" not in data[: end.start()]:
            raise ValueError(f"{path} is no little-endian binary PLY file")
        elements: list = []
        for line in data[: end.start()].decode("ascii", "replace").splitlines():
            words = line.split()
            if words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append(words[1:])
        return end.end(), elements

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        for files, info, path in self._files():
            if not info.size:
                continue
            with files.open_input_file(info.path) as source:
                offset, elements = self._header(source, path)
            known = dict((name, (n, p)) for name, n, p in elements)
            if [name for name, _, _ in elements[:2]] != ["vertex", "face"] or any(p[0] == "list" for p in known["vertex"][1]):
                raise ValueError(f"{path} has other elements than vertices and faces first")
            rows, properties = known["vertex"]
            record = [(p[1], PLY_TYPES[p[0]]) for p in properties]
            size = np.dtype(record).itemsize
            if not self.faces:
                out += self._ranges(path, "rows", rows, size, offset, record)
                continue
            at, (count, lists) = offset + rows * size, known["face"]
            if len(lists) != 1 or lists[0][0] != "list":
                raise ValueError(f"faces of {path} have other properties than one list")
            record = [("n", PLY_TYPES[lists[0][1]]), ("v", PLY_TYPES[lists[0][2]], 3)]
            size = np.dtype(record).itemsize
            if len(elements) == 2 and info.size == at + count * size:
                out += self._ranges(path, "rows", count, size, at, record)
            elif count:
                out.append(Split(path, "lists", 0, count, at, record))
        return joined(out)

    def read(self, s: Split | None) -> Iterator:
        if s is None:
            return
        files, inner = open_fs(s.path)
        with files.open_input_file(inner) as source:
            record = np.dtype([tuple(r) for r in s.record])
            source.seek(s.offset + (record.itemsize * s.first if s.kind == "rows" else 0))
            if s.kind == "lists":
                yield from self._lists(source, s, record)
                return
            for first in range(s.first, s.last, ROWS):
                n = min(ROWS, s.last - first)
                table = np.frombuffer(source.read(record.itemsize * n), record)
                if len(table) < n:
                    raise ValueError(f"{s.path} is cut short")
                numbers = np.arange(first, first + n)
                if self.faces:
                    if (table["n"] != 3).any():
                        raise ValueError(f"{s.path} has faces that are no triangles")
                    yield self._faces(s.path, numbers, table["v"].astype(np.int64))
                else:
                    yield self._batch({"path": lambda: [s.path] * n, "v": lambda: numbers} | {a: (lambda a=a: table[a].astype(np.float64)) for a in "xyz"})

    def _faces(self, path: str, numbers: np.ndarray, corners: np.ndarray):
        return self._batch({"path": lambda: [path] * len(numbers), "f": lambda: numbers} | {c: (lambda i=i: corners[:, i]) for i, c in enumerate("abc")})

    def _lists(self, source, s: Split, record: np.dtype) -> Iterator:
        """Polygons cut into fans; triangles are numbered in order."""
        head, item, rows, number = record["n"], record["v"].base, [], 0
        for _ in range(s.last):
            size = int(np.frombuffer(source.read(head.itemsize), head)[0])
            corners = np.frombuffer(source.read(item.itemsize * size), item)
            rows += [(corners[0], corners[i], corners[i + 1]) for i in range(1, size - 1)]
            if len(rows) >= ROWS:
                yield self._faces(s.path, np.arange(number, number + len(rows)), np.array(rows, np.int64))
                number, rows = number + len(rows), []
        if rows:
            yield self._faces(s.path, np.arange(number, number + len(rows)), np.array(rows, np.int64))


class StlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return "path string, f long, nx double, ny double, nz double, " + ", ".join(f"{c} double" for c in CORNERS)

    def reader(self, schema) -> StlReader:
        return StlReader(dict(self.options), schema)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        faces = str(self.options.get("table", "vertices")).lower() == "faces"
        return "path string, f long, a long, b long, c long" if faces else "path string, v long, x double, y double, z double"

    def reader(self, schema) -> PlyReader:
        return PlyReader(dict(self.options), schema)


def register(spark) -> None:
    """Make the formats known to a session and let it push filters to them."""
    spark.dataSource.register(StlSource)
    spark.dataSource.register(PlySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_stl(soup: DataFrame, folder: str, triangles: int = 1_000_000) -> int:
    """Write a soup (ax .. cz) as binary STL files of at most so many triangles, by its tasks; returns the number of files.

    A list in the folder names the files, so what a task that failed has left is not read.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        files, inner = open_fs(folder)
        files.create_dir(inner, recursive=True)
        part, held, n, names = TaskContext.get().partitionId(), [], 0, []

        def flush() -> None:
            table = np.zeros(n, TRIANGLE)
            table["p"] = np.concatenate(held)
            p = table["p"].reshape(-1, 3, 3).astype(np.float64)
            normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
            table["n"] = normal / np.maximum(np.linalg.norm(normal, axis=1), 1e-300)[:, None]
            names.append(f"part-{part:06d}-{uuid.uuid4().hex}.stl")
            with files.open_output_stream(f"{inner}/{names[-1]}", compression=None) as sink:
                sink.write(b"binary".ljust(80, b"\0") + struct.pack("<I", n))
                sink.write(table.tobytes())

        for batch in batches:
            corners = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for a in range(0, len(corners), triangles):
                own = corners[a : a + triangles]
                if n and n + len(own) > triangles:
                    flush()
                    held, n = [], 0
                held.append(own)
                n += len(own)
        if n:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    written = materialise(soup.select(*CORNERS).mapInArrow(run, "file string"), "stl-files")
    names = sorted(r["file"] for r in written.collect())  # one row a file
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)
    with files.open_output_stream(f"{inner}/{LISTING}") as sink:
        sink.write(json.dumps(names).encode())
    return len(names)
