"""Token-id files: ids of documents, coded by an adaptive context-mixing range coder.

``range_coder`` has the model and the coder.  Blocks of 262,144 ids share nothing;
``GROUP`` of them are coded at once, which bounds what a task holds.

File: ``MAGIC``; blocks, each with count, size and CRC-32 of its ids; a table of
(document id, ids, null mark); and a footer that says where the table begins.
A block can be decoded alone; a damaged one raises ``ValueError``.

Defined results: null and empty texts are the end id alone; rows of equal document
id follow each other in the order of their text; null ids come first; very long
texts span blocks; an empty table gives no files and no rows; other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder, open_fs
from .range_coder import BLOCK, GROUP, decode_blocks, encode_blocks
from .tokens import TextEncoder, row_groups

MAGIC = b"GLTOK2\n\0"
END = 2


class FileWriter:
    """Writes documents' ids; blocks go out whenever ``GROUP`` of them are full."""

    def __init__(self, sink):
        self._sink, self._at = sink, 0
        self._pending: list[np.ndarray] = []
        self._size = self.tokens = self.docs = 0
        self._table: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self._at += len(data)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents of ``counts`` ids each, which follow each other in ``ids``."""
        self._table.append(np.stack([np.where(null, 0, doc_ids), counts, null], axis=1).astype("<i8"))
        self.docs += len(counts)
        self.tokens += len(ids)
        for a in range(0, len(ids), GROUP * BLOCK):
            self._pending.append(ids[a : a + GROUP * BLOCK])
            self._size += len(self._pending[-1])
            if self._size >= GROUP * BLOCK:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._pending) if self._pending else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // (GROUP * BLOCK) * GROUP * BLOCK
        for count, crc, part in encode_blocks(ids[:cut]):
            self._put(struct.pack("<III", count, len(part), crc) + part)
        self._pending, self._size = [ids[cut:].copy()], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        table = np.concatenate(self._table or [np.zeros((0, 3), "<i8")]).tobytes()
        at, packed = self._at, zlib.compress(table)
        self._put(packed)
        self._put(struct.pack("<QIII", at, len(packed), zlib.crc32(table), self.docs) + MAGIC)
        self._sink.close()


def read_file(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null marks, counts, ids) of runs of a file's documents; holds ``GROUP`` blocks and one document more."""
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 28)
    tail = source.read(28)
    if tail[20:] != MAGIC:
        raise ValueError("no token file")
    at, size, crc, n = struct.unpack("<QIII", tail[:20])
    source.seek(at)
    table = zlib.decompress(source.read(size))
    if zlib.crc32(table) != crc:
        raise ValueError("document table checksum")
    docs = np.frombuffer(table, "<i8").reshape(n, 3)
    source.seek(len(MAGIC))
    place = len(MAGIC)
    ends = np.cumsum(docs[:, 1])
    done = before = 0  # documents given out, ids of them
    held: list[np.ndarray] = []
    have = 0
    while done < n:
        if place < at:
            blocks = []
            while place < at and len(blocks) < GROUP:
                count, length, check = struct.unpack("<III", source.read(12))
                blocks.append((count, check, source.read(length)))
                place += 12 + length
            held.append(decode_blocks(blocks))
            have += len(held[-1])
        stop = int(np.searchsorted(ends, before + have, side="right"))
        if stop == done:
            if place >= at:
                raise ValueError("ids end before the documents do")
            continue
        whole = np.concatenate(held) if len(held) != 1 else held[0]
        cut = int(ends[stop - 1]) - before
        yield docs[done:stop, 0], docs[done:stop, 2] != 0, docs[done:stop, 1], whole[:cut]
        held, have, before, done = [whole[cut:].copy()], len(whole) - cut, before + cut, stop


def write_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """One file per range of document ids below ``folder``; returns (part, path, docs, tokens) of each.

    A retried task writes a file of its own name; the returned table names the
    files that count.
    """

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        writer = path = None
        part = TaskContext.get().partitionId()
        encoder = TextEncoder.load(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b, ids, offsets in encoder.encode_column(batch.column(1), end):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    files, inner = open_fs(path)
                    files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    writer = FileWriter(files.open_output_stream(inner))
                writer.add(doc_ids[a:b], null[a:b], np.diff(offsets), ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "docs": [writer.docs], "tokens": [writer.tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, path string, docs bigint, tokens bigint")


def read_runs(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null marks, starts, counts, ids) of runs of documents of the files in (path, ids before it) batches."""
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, inner = open_fs(path)
            with files.open_input_file(inner) as source:
                for doc_ids, null, counts, ids in read_file(source):
                    yield doc_ids, null, start + np.cumsum(counts) - counts, counts, ids
                    start += len(ids)


def _files(spark, manifest: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(manifest, "path string, start bigint").repartition(max(1, len(manifest)))


def read_files(spark, manifest: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, ids of the files (path, ids before it), read where the tasks run."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for doc_ids, null, starts, counts, ids in read_runs(batches):
            ends = np.cumsum(counts)
            for a, b in row_groups(np.concatenate([[0], ends]), 1_000_000):
                first = int(ends[a - 1]) if a else 0
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[a:b] - first]), pa.int32()), pa.array(ids[first : ends[b - 1]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64(), mask=null[a:b]), pa.array(starts[a:b], pa.int64()), own], names=["doc_id", "start", "ids"])

    return _files(spark, manifest).mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def read_digests(spark, manifest: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files, worked out where they are read so that no ids move."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for doc_ids, null, starts, counts, ids in read_runs(batches):
            raw, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(counts)
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            columns = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(spark, manifest).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_whole(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Write the documents' ids; (path, ids before it) of the files in order of document ids, one row a file."""
    spark = docs.sparkSession
    written = materialise(write_files(docs, new_folder(spark, "tokens"), tokenizer, id_col, text_col), "token-files")
    manifest, before = [], 0
    for row in sorted(written.collect(), key=lambda r: r["part"]):
        manifest.append((row["path"], before))
        before += row["tokens"]
    return manifest


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids and read them back: doc_id, start, ids."""
    return read_files(docs.sparkSession, write_whole(docs, tokenizer, id_col, text_col))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: digests of the ids that the files give back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digests(spark, write_whole(docs, public_tokenizers.path("word_bpe_49k.json")))
