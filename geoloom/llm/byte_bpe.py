"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Python only cuts texts into words and puts documents together again.  The merges
are Spark SQL: for every distinct word of the table, ``aggregate`` folds ranked
merges over the array of the word's bytes.  Ranks come from one literal: an array
of small maps, addressed by crc32 of a piece, so a lookup scans a handful of
entries instead of the vocabulary.  Decoding looks up each id's piece in a literal
array and concatenates the binary pieces.

1. A task cuts its texts in blocks of some ``BLOCK`` bytes, stores each block's
   documents as numbers of the block's distinct words in a file of the shared
   folder, and sends the distinct words on.
2. Words are dealt out by (word, tasks in groups of ``SPREAD``), so a word is folded
   once for each ``SPREAD`` tasks at most and no key has more rows than these tasks
   have blocks; the first row of a word folds, the others copy.
3. Ids and bytes return to the block, packed, and the documents are put together
   from the stored file.  A block is named by partition and place, so a task that
   runs again, whole or for some reducers only, gives the same words under the same
   names and finds its file there; words that are missing or double are an error.

In the rank map a byte is the character of the same number (U+0000 to U+00FF),
which lets the map be a JSON literal that Catalyst folds once.

Defined results: a null text is an empty text (no ids, hash of no bytes); a very
long text is a block of its own; repeated rows give repeated results; an empty
table gives no rows; columns other than the id and the text are not read.
Unpaired surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, open_fs
from .tokens import Ragged, number_chunks, row_groups, text_bytes, totals_before

BUCKETS = 8192
BLOCK = 24_000_000
SPREAD = 1024
#: words of a packed row, and of documents put together at once
PACK, AT_ONCE = 400_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file) if piece}


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class RankLiteral:
    """The vocabulary as two literals and the expressions that read them."""

    def __init__(self, ranks: dict[bytes, int]):
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            text = piece.decode("latin-1")
            buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
            pieces[rank] = base64.b64encode(piece).decode()
        self._ranks = F.from_json(F.lit(json.dumps(buckets)), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))
        self._pieces = F.from_json(F.lit(json.dumps(pieces)), T.ArrayType(T.BinaryType()))

    def rank(self, piece: Column) -> Column:
        """Rank of a piece, null if it is none."""
        slot = F.crc32(piece.cast("binary")).bitwiseAND(BUCKETS - 1).cast("int")
        return F.try_element_at(F.get(self._ranks, slot), piece)

    def encode(self, word: Column) -> Column:
        """Ids of a binary word: its own rank, or the fold of merges over its bytes."""
        rank = self.rank
        none = F.array().cast("array<int>")

        def state(parts: Column) -> Column:
            pairs = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(none)
            ranks = F.transform(pairs, lambda i: let(F.concat(F.get(parts, i - 1), F.get(parts, i)), rank))
            return F.struct(parts.alias("parts"), ranks.alias("ranks"))

        def join(old: Column, ranks: Column, at: Column, joined: Column) -> Column:
            left = F.when(at > 1, F.array(let(F.concat(F.get(old, at - 2), joined), rank))).otherwise(none)
            right = F.when(at < F.size(ranks), F.array(let(F.concat(joined, F.get(old, at + 1)), rank))).otherwise(none)
            size = F.size(old)
            return F.struct(
                F.concat(F.slice(old, 1, at - 1), F.array(joined), F.slice(old, at + 2, size)).alias("parts"),
                F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, size)).alias("ranks"),
            )

        def merge(acc: Column, _: Column) -> Column:
            old, ranks = acc["parts"], acc["ranks"]

            def at_least(least: Column) -> Column:
                # the pair (at, at + 1), counted from 1, is the leftmost of the least rank
                place = F.array_position(ranks, least).cast("int")
                merged = let(place, lambda at: let(F.concat(F.get(old, at - 1), F.get(old, at)), lambda joined: join(old, ranks, at, joined)))
                return F.when(least.isNull(), acc).otherwise(merged)

            return let(F.array_min(ranks), at_least)

        def ids(text: Column) -> Column:
            folded = let(F.split(text, ""), lambda parts: F.aggregate(parts, state(parts), merge, lambda acc: F.transform(acc["parts"], rank)))
            return let(rank(text), lambda own: F.when(own.isNotNull(), F.array(own)).when(F.length(text) == 0, none).otherwise(folded))

        return let(F.decode(word, "ISO-8859-1"), ids)

    def decode(self, ids: Column) -> Column:
        """Bytes of ids: their binary pieces concatenated."""
        return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(self._pieces, i)))


def _zstd(data: np.ndarray | bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", 3).compress(memoryview(data), asbytes=True)


def _unzstd(data: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of their bytes."""
    whole = numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    planes = [_zstd(np.ascontiguousarray(whole[:, i])) if len(numbers) and whole[:, i].any() else b"" for i in range(4)]
    return struct.pack("<Q4Q", len(numbers), *map(len, planes)) + b"".join(planes)


def unpack_numbers(data: memoryview | bytes) -> tuple[np.ndarray, int]:
    """(uint32 numbers, bytes read)."""
    n, *sizes = struct.unpack_from("<Q4Q", data)
    out, at = np.zeros((n, 4), np.uint8), 40
    for i, size in enumerate(sizes):
        if size:
            out[:, i] = np.frombuffer(_unzstd(bytes(data[at : at + size]), n), np.uint8)
        at += size
    return out.reshape(-1).view("<u4"), at


#: Chunks that are one word by any pattern of this family: letters, digits or signs after a space at most.
#: Letters are ASCII ones and U+00C0 to U+00FF without the two signs among them.
ONE_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@[-`{-~]+)")


def _cut(batches: Iterator, pattern: str, folder: str, block_bytes: int) -> Iterator:
    """Stores blocks of documents as word numbers, commoner words lower; gives (block, number, salt, word) of their distinct words."""
    import pyarrow as pa
    import regex
    from pyspark import TaskContext

    words_of, one_word = regex.compile(pattern).findall, ONE_WORD.fullmatch
    task = TaskContext.get()
    # a task run again cuts the same rows into the same blocks and names them alike
    block, salt = task.partitionId() << 20, task.partitionId() // SPREAD
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in row_groups(offsets, block_bytes):
            own = offsets[a : b + 1]
            distinct, numbers, before = number_chunks(data[own[0] : own[-1]], own - own[0])
            chunks = distinct.to_pylist()
            alone = np.fromiter((one_word(c) is not None for c in chunks), bool, len(chunks))
            single, several = np.flatnonzero(alone), np.flatnonzero(~alone)
            more: dict[bytes, int] = {}
            split = [[more.setdefault(w.encode(), len(single) + len(more)) for w in words_of(chunks[i].decode())] for i in several.tolist()]
            rows, row_of = Ragged(), np.zeros(len(chunks), np.int64)
            rows.extend(np.arange(len(single), dtype=np.uint32), np.ones(len(single), np.int64))
            rows.extend(np.array([w for words in split for w in words], np.uint32), np.array([len(words) for words in split], np.int64))
            row_of[single], row_of[several] = np.arange(len(single)), len(single) + np.arange(len(several))
            used = row_of[numbers].astype(np.int32)
            sizes = totals_before(rows.counts(used), before)
            held = rows.gather(used)
            order = np.argsort(-np.bincount(held, minlength=len(single) + len(more)), kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            _store(f"{folder}/{block}", batch.column(0).slice(a, b - a), np.diff(sizes), number[held])
            del numbers, before, used, held
            # the row of number -1 stands for the block itself, which may have no words
            words = pa.concat_arrays([distinct.take(pa.array(single)), pa.array(list(more), pa.large_binary())]).take(pa.array(order))
            for part, first in [(pa.array([b""], pa.binary()), -1), *((words.slice(c, 50_000).cast(pa.binary()), c) for c in range(0, len(words), 50_000))]:
                n = len(part)
                columns = [np.full(n, block), np.arange(first, first + n, dtype=np.int32), np.full(n, salt, np.int32), part]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["block", "number", "salt", "word"])
            block += 1


def _store(path: str, doc_ids, sizes: np.ndarray, numbers: np.ndarray) -> None:
    """Documents of a block: a batch of (doc_id, words), then their word numbers."""
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    batch = pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64())], names=["doc_id", "words"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    head = sink.getvalue()
    files, inner = open_fs(path)
    files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    own = f"{inner}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as file:
        file.write(struct.pack("<Q", head.size))
        file.write(head)
        file.write(pack_numbers(numbers))
    # readers see a whole file or none; another attempt's file is the same
    if files.get_file_info(inner).type == fs.FileType.NotFound:
        files.move(own, inner)
    else:
        files.delete_file(own)


def _load(path: str):
    """(doc_ids, words of each, word numbers) of a stored block."""
    import pyarrow as pa

    files, inner = open_fs(path)
    with files.open_input_file(inner) as file:
        data = memoryview(file.read())
    size = struct.unpack_from("<Q", data)[0]
    head = pa.ipc.open_stream(pa.py_buffer(data[8 : 8 + size])).read_all().combine_chunks()
    return head.column(0), head.column(1).to_numpy(), unpack_numbers(data[8 + size :])[0]


def _pack(batches: Iterator) -> Iterator:
    """(block, data): numbers, ids and bytes of words, some ``PACK`` rows at a time."""
    import pyarrow as pa

    def flat(lists, kind) -> tuple[np.ndarray, np.ndarray]:
        whole = lists.cast(kind)
        return np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1], whole

    def blocks(own: list) -> Iterator:
        table = pa.Table.from_batches(own).combine_chunks().sort_by([("block", "ascending")])
        block = table.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = table.slice(a, b - a).combine_chunks()
            ids, text = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (part.column(2), part.column(3)))
            counts, sizes = np.diff(flat(ids, pa.large_list(pa.int32()))[0]), np.diff(flat(text, pa.large_binary())[0])
            joined = b"".join(text.to_pylist())
            packed = [pack_numbers(x) for x in (part.column(1).to_numpy().astype(np.int64) + 1, counts, sizes, ids.flatten().to_numpy())]
            rows.append((block[a], b"".join(packed) + struct.pack("<Q", len(joined)) + _zstd(joined)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK:
            yield from blocks(held)
            held, n = [], 0
    if n:
        yield from blocks(held)


def _assemble(batches: Iterator, folder: str, keep: bool) -> Iterator:
    """Documents of blocks from the packed words, which come sorted by block."""
    import pyarrow as pa

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]

    def documents(block: int, packed: list[bytes]) -> Iterator:
        coded, plain, order = Ragged(), Ragged(np.uint8), []
        for data in packed:
            view = memoryview(data)
            found = []
            for _ in range(4):
                numbers, size = unpack_numbers(view)
                found.append(numbers)
                view = view[size:]
            order.append(found[0].astype(np.int64))
            coded.extend(found[3], found[1].astype(np.int64))
            plain.extend(np.frombuffer(_unzstd(bytes(view[8:]), struct.unpack_from("<Q", view)[0]), np.uint8), found[2].astype(np.int64))
        order = np.concatenate(order)
        doc_ids, words, numbers = _load(f"{folder}/{block}")
        expected = int(numbers.max()) + 2 if len(numbers) else 1
        if not np.array_equal(np.sort(order), np.arange(expected)):
            raise ValueError(f"words of block {block} are not complete: {len(order)} of {expected}")
        row_of = np.empty(expected, np.int64)
        row_of[order] = np.arange(expected)
        ends = np.concatenate([[0], np.cumsum(words)])
        for a, b in row_groups(ends, AT_ONCE):
            rows = row_of[numbers[ends[a] : ends[b]].astype(np.int64) + 1]
            own = ends[a : b + 1] - ends[a]
            ids, text = coded.gather(rows).astype("<u4", copy=False), plain.gather(rows)
            at, to = (totals_before(x.counts(rows), own) for x in (coded, plain))
            packed_ids, decoded = memoryview(ids).cast("B"), memoryview(text)
            out = [doc_ids.slice(a, b - a), np.diff(at)]
            out.append([hashlib.sha256(packed_ids[4 * p : 4 * q]).hexdigest() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            out.append([hashlib.sha256(decoded[p:q]).hexdigest() for p, q in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)])
            if keep:
                out.append([ids[p:q].astype(np.int32) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                out.append([bytes(decoded[p:q]) for p, q in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)])
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], names=names[: len(columns)])

    block, packed = None, []
    for batch in batches:
        for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != block and packed:
                yield from documents(block, packed)
                packed = []
            block = own
            packed.append(data)
    if packed:
        yield from documents(block, packed)


def byte_bpe(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, keep_ids: bool = True,
) -> DataFrame:
    """Encode and decode texts.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 and, with
    ``keep_ids``, the ids (array<int>) and the decoded bytes.  ``block_bytes``
    bounds the text worked on at once and the dictionary of a block.
    """
    literal, folder = RankLiteral(ranks), new_folder(docs.sparkSession, "bpe-blocks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(lambda it: _cut(it, pattern, folder, block_bytes), "block bigint, number int, salt int, word binary")
    group = Window.partitionBy("word", "salt").orderBy("block", "number")
    first = words.withColumn("place", F.row_number().over(group))
    folded = first.withColumn("ids", F.when(F.col("place") == 1, literal.encode(F.col("word"))))
    # decoding only what was coded, and again only in the first row of a word
    decoded = folded.withColumn("text", F.when(F.col("place") == 1, literal.decode(F.col("ids"))))
    run = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = decoded.select("block", "number", F.first("ids").over(run).alias("ids"), F.first("text").over(run).alias("text"))
    packed = every.mapInArrow(_pack, "block bigint, data binary")
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _assemble(it, folder, keep_ids), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the contract's digest columns over all of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, keep_ids=False)
