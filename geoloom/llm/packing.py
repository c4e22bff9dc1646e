"""Best-fit packing of token pieces into sequences by bulk-synchronous rounds.

A document's ids are cut only if they exceed a sequence; the first piece holds
the remainder, so every other piece fills a sequence and needs no search.  First
pieces and gaps (the free ends of sequences) are rows of tables.  One round:

1. *Range sort*: pieces and gaps together, by size from large to small, a gap
   before a piece of its size, ties by id.  Ties are part of the key, so a size
   that most rows have is dealt to many partitions.
2. *Successor sweep*: each partition walks down its range.  A piece takes the
   smallest free gap at or above it, which is the gap last met and not yet taken;
   this is the matching of brackets and needs no loop over rows.
3. *Conflicts by rank*: pieces that found no gap in their range and gaps that were
   left are numbered in their partition.  From those two counts a partition, the
   driver works out which ranks go together (at most two ranges of ranks for each
   partition), and a join on the number of the match carries it out.
4. *Update*: a gap shrinks by its piece; gaps below the smallest open piece are
   done.  When a round matches nothing, as many sequences are opened as the open
   pieces fill at least.

Rounds end when no piece is open.  Each gap takes a piece a round, so rounds are
about the pieces of a sequence; where these would be more than ``CROWD``, pieces of
up to 1/32 of a sequence are first joined to bundles of up to 1/16, each of which
is placed like a piece.  The state of a round is a written table; the driver sees
sums and the counts of partitions (``PARTS`` at most), no rows.

Defined results: null text and empty text are the end id alone; repeated rows and
repeated ids are packed as rows of their own; an empty table gives no rows; ties
in length go by partition and position; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialise
from .tokens import TextEncoder

CAPACITY = 1024
END = 2
CROWD = 8
#: rows of a partition of the sweep, and partitions at most (beyond that they grow)
ROWS, PARTS = 40_000, 10_000
GAP, PIECE, PLACED = 0, 1, 2
#: ``id`` is the piece's key or the gap's sequence, ``size`` its length or what is free, ``used`` what a gap holds
ITEMS = "kind int, id bigint, size int, used int"
#: a placed piece has ``seq``, ``size`` and ``used`` of its gap before it
SWEPT = "kind int, id bigint, size int, used int, seq bigint, length int, part int, rank bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end: int = END, group: int = 2_000_000) -> DataFrame:
    """key, doc_id, piece, start, length, ids_crc32 for every piece; the key is unique in one run.  ``group`` bounds the bytes encoded at once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        give_back()
        encoder = TextEncoder.load(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0)
            for a, b, ids, offsets in encoder.encode_column(batch.column(1), end, group):
                sizes = np.diff(offsets)
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = ((sizes - 1) % capacity + 1)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                raw, places = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (offsets[:-1][doc] + start)
                crcs = [zlib.crc32(raw[p:q]) for p, q in zip(places.tolist(), (places + 4 * length).tolist(), strict=True)]
                keys = np.arange(key, key + len(doc))
                key += len(doc)
                columns = [pa.array(keys), doc_ids.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def match(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Successor sweep over gaps and pieces that are sorted from large to small.

    Returns positions: gaps and the pieces that take them, then open pieces in
    order, then open gaps from the last (smallest) to the first.
    """
    depth = np.cumsum(np.where(kind == GAP, 1, -1))
    floor = np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else depth
    is_open = (kind == PIECE) & (depth < np.concatenate([[0], floor[:-1]]))
    level = depth - floor + (kind == PIECE)
    closed = np.flatnonzero(~is_open)
    order = closed[np.argsort(level[closed], kind="stable")]
    taken = np.zeros(len(order), dtype=bool)
    if len(order):
        taken[:-1] = (level[order[1:]] == level[order[:-1]]) & (kind[order[:-1]] == GAP) & (kind[order[1:]] == PIECE)
    at = np.flatnonzero(taken)
    gaps, pieces = order[at], order[at + 1]
    free = np.ones(len(kind), dtype=bool)
    free[gaps] = False
    return gaps, pieces, np.flatnonzero(is_open), np.flatnonzero(free & (kind == GAP))[::-1]


def _sweep(batches: Iterator) -> Iterator:
    """The sweep of one range: ``SWEPT`` rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, own = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
    if not own:
        return
    kind, ids, size, used = (c.to_numpy() for c in pa.Table.from_batches(own).columns)
    gaps, pieces, open_pieces, open_gaps = match(kind)
    rows = np.concatenate([pieces, open_pieces, open_gaps])
    n, m, k = len(pieces), len(open_pieces), len(open_gaps)
    state = np.repeat([PLACED, PIECE, GAP], [n, m, k])
    columns = [state, ids[rows], np.concatenate([size[gaps], size[rows[n:]]]), np.concatenate([used[gaps], used[rows[n:]]])]
    columns += [np.concatenate([ids[gaps], np.zeros(m + k, np.int64)]), np.concatenate([size[pieces], np.zeros(m + k, size.dtype)])]
    columns += [np.full(n + m + k, part), np.concatenate([np.zeros(n, np.int64), np.arange(m), np.arange(k)])]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["kind", "id", "size", "used", "seq", "length", "part", "rank"]
    for a in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000], t) for c, t in zip(columns, types, strict=True)], names=names)


def hand_over(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(kind, part, first rank, end rank, first match) from the open rows of (part, kind).

    The stack of the sweep goes on over the borders of the partitions: open pieces
    of one take the gaps last left by those before it.
    """
    stack: list[list[int]] = []  # part, gaps taken, gaps left
    out, matched = [], 0
    for part in sorted({p for p, _ in counts}):
        wanted, done = counts.get((part, PIECE), 0), 0
        while done < wanted and stack:
            top = stack[-1]
            n = min(wanted - done, top[2])
            out += [(PIECE, part, done, done + n, matched), (GAP, top[0], top[1], top[1] + n, matched)]
            matched, done, top[1], top[2] = matched + n, done + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if left := counts.get((part, GAP), 0):
            stack.append([part, 0, left])
    return out


def _round(items: DataFrame, rows: int) -> DataFrame:
    """``SWEPT`` rows of one round over ``items``; open rows have found no partner anywhere."""
    spark = items.sparkSession
    parts = int(min(max(2, -(-rows // ROWS)), PARTS))
    keys = [F.desc("size"), F.asc("kind"), F.asc("id")]
    swept = materialise(items.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_sweep, SWEPT), "swept")
    is_open = swept.where(F.col("kind") != PLACED)
    counts = {(r["part"], r["kind"]): r["count"] for r in is_open.groupBy("part", "kind").count().collect()}
    ranges = hand_over(counts)
    if not ranges:
        return swept
    # two rows for each range of ranks, two ranges for each partition at most
    table = F.broadcast(spark.createDataFrame(ranges, "kind int, part int, a bigint, b bigint, first bigint"))
    pairs = is_open.join(table, ["kind", "part"]).where("rank >= a AND rank < b").withColumn("match", F.col("first") + F.col("rank") - F.col("a"))
    ends: dict[tuple[int, int], int] = {}
    for kind, part, _, end, _ in ranges:
        ends[kind, part] = max(end, ends.get((kind, part), 0))
    borders = F.broadcast(spark.createDataFrame([(*k, end) for k, end in ends.items()], "kind int, part int, end bigint"))
    left = is_open.join(borders, ["kind", "part"], "left").where("end IS NULL OR rank >= end").select(*swept.columns)
    piece = pairs.where(F.col("kind") == PIECE).select("match", "id", F.col("size").alias("length"))
    gap = pairs.where(F.col("kind") == GAP).select("match", F.col("id").alias("seq"), "size", "used")
    across = piece.join(gap, "match").select(F.lit(PLACED).alias("kind"), "id", "size", "used", "seq", "length", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("rank"))
    return materialise(swept.where(F.col("kind") == PLACED).unionByName(across).unionByName(left), "round")


def bundle(pieces: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Items in which small pieces of a partition are joined, and (bundle, id, inside) of the joined ones.

    A bundle has the key of its first piece.
    """
    small, most = capacity // 32, capacity // 16

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head, filled = None, 0
        for batch in batches:
            rows = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size > small:
                    rows.append((key, key, 0, size))
                    continue
                if head is None or filled + size > most:
                    head, filled = key, 0
                rows.append((head, key, filled, size))
                filled += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["bundle", "id", "inside", "size"]) if rows else batch.slice(0, 0)

    joined = materialise(pieces.select("id", "size").mapInArrow(run, "bundle bigint, id bigint, inside int, size int"), "bundles")
    items = joined.groupBy("bundle").agg(F.sum("size").cast("int").alias("size"))
    return items.select(F.lit(PIECE).alias("kind"), F.col("bundle").alias("id"), "size", F.lit(0).alias("used")), joined.select("bundle", "id", "inside")


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, start: int = 0) -> tuple[DataFrame, int]:
    """(id, sequence_id, offset) of pieces (id, size), and the first sequence number not used."""

    def state_of(items: DataFrame):
        row = items.where(F.col("kind") == PIECE).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("size").alias("least")).collect()[0]
        return row["n"], row["total"] or 0, row["least"]

    items = pieces.select(F.lit(PIECE).alias("kind"), "id", F.col("size").cast("int").alias("size"), F.lit(0).alias("used"))
    n, total, least = state_of(items)
    members, placed, sequences, gaps = None, [], start, 0
    if n > CROWD * -(-total // capacity):
        items, members = bundle(items, capacity)
        items = materialise(items, "items")
        n, total, least = state_of(items)
    while n:
        if not gaps:
            gaps = -(-total // capacity)
            opened = spark.range(sequences, sequences + gaps).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).alias("size"), F.lit(0).alias("used"))
            sequences += gaps
            items = items.unionByName(opened)
        done = _round(items, n + gaps)
        new = done.where(F.col("kind") == PLACED)
        placed.append(new.select("id", F.col("seq").alias("sequence_id"), F.col("used").cast("long").alias("offset")))
        shrunk = new.select(F.lit(GAP).alias("kind"), F.col("seq").alias("id"), (F.col("size") - F.col("length")).alias("size"), (F.col("used") + F.col("length")).alias("used"))
        left = done.where(F.col("kind") != PLACED).select("kind", "id", "size", "used")
        n, total, least = state_of(left)
        items = shrunk.unionByName(left)
        if n:
            items = items.where((F.col("kind") == PIECE) | (F.col("size") >= least))
            gaps = items.where(F.col("kind") == GAP).count()
    out = placed[0] if placed else spark.createDataFrame([], "id bigint, sequence_id bigint, offset bigint")
    for more in placed[1:]:
        out = out.unionByName(more)
    if members is not None:
        out = members.join(out.withColumnRenamed("id", "bundle"), "bundle").select("id", "sequence_id", (F.col("offset") + F.col("inside")).alias("offset"))
    return out, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of written pieces (``cut_pieces``)."""
    rest = ["doc_id", "piece", "start", "length", "ids_crc32"]
    part = pieces.where(F.col("length") < capacity)
    places, sequences = place(pieces.sparkSession, part.select(F.col("key").alias("id"), F.col("length").alias("size")), capacity)
    packed = part.join(places.withColumnRenamed("id", "key"), "key").select(*rest, "sequence_id", "offset")
    # full pieces fill a sequence each: any distinct numbers do
    full = pieces.where(F.col("length") == capacity).select(*rest, (F.monotonically_increasing_id() + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack whole documents; the pieces' table is written before it is packed."""
    return pack(materialise(cut_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
