"""Removal of passages that an earlier document holds, by fixed-block anchors.

A window is ``length`` consecutive words of one document.  Wherever it lies, a window
of a reference document holds one whole block of that document's non-overlapping
blocks of ``(length + 1) // 2`` words, the *anchors*.

1. The texts are written once, dealt to blocks of about ``BLOCK`` bytes.  Each block
   hands on the distinct hashes of all its rolling windows of anchor length, marked
   where one is an anchor of its document and where it comes more than once: five
   bytes each, sorted and packed by leading bits.  A hash that any block has as an
   anchor and that comes twice in all is a hit; each block that holds it is told so.
2. Around its hits, and there only, a block takes the windows of full length by a
   fingerprint of 95 bits, hands on each once with its least document, and is told the
   least document of the whole table where that is not the only one.
3. A block goes over its texts again: windows of a smaller document join to maximal
   repeats, and their words are taken out.

A block hands on a hash or fingerprint once, however often it comes, so what a task
gets of a passage grows with the blocks, not with the copies, and no pairs are made.
What a block is told is a table partitioned by block below ``spark.checkpoint.dir``
that tasks read by path, so texts are never shuffled.  All is keyed by values, not by
places or attempts: a block split over tasks, a task run twice or a lost executor
leave the result as it is.

Words are told apart by 64-bit hashes and windows by 95 bits; a hit of step 1 that is
none (38 bits beside those of the bucket) only costs time.

Defined results: a null text is the empty one, with no words; a document of fewer
words than a window loses nothing; rows of null id lose nothing and make nobody lose;
rows that repeat an id are judged each by itself and do not count against each other;
windows are judged on the input; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressed, give_back, new_folder, open_fs
from .words import SPACES, Numbers, pieces, word_values

LENGTH = 13
#: Bytes of text in a block, and about as many that one bucket of hashes covers.
BLOCK = 1 << 25
BUCKET = 3 * BLOCK
#: Bits of a packed hash beside its bucket; two more are marks.
BITS = 38
MASK = np.uint64((1 << BITS) - 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _factors(seed: int, n: int) -> list[np.uint64]:
    return list(_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1))


def rolled(words: np.ndarray, size: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` words that start everywhere, or at ``at``."""
    total = np.zeros(max(0, len(words) - size + 1) if at is None else len(at), np.uint64)
    for j, factor in enumerate(_factors(seed, size)):
        total += (words[j : j + len(total)] if at is None else words[at + j]) * factor
    return _mixed(total)


def anchor_size(length: int) -> int:
    return (length + 1) // 2


def _numbers() -> Numbers:
    import xxhash

    return Numbers(xxhash.xxh3_64_intdigest)


class Runs:
    """Word numbers of consecutive documents, with where each begins and ends."""

    def __init__(self, counts: np.ndarray, words: np.ndarray):
        self.counts, self.words, self.ends = counts, words, np.cumsum(counts)

    def starts(self, size: int) -> np.ndarray:
        """Places where a window of ``size`` words fits into its document."""
        return np.flatnonzero(np.arange(len(self.words)) + size <= np.repeat(self.ends, self.counts))

    def offset(self, at: np.ndarray) -> np.ndarray:
        """Places within documents."""
        return at - np.repeat(self.ends - self.counts, self.counts)[at]


def _parts(batches: Iterator) -> Iterator[tuple[int, np.ndarray, list, list]]:
    """(block, ids, whether an id is null, texts) of each stretch of rows of one block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for own in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
            if len(own):
                rows = batch.slice(int(own[0]), len(own))
                ids = rows.column(1)
                yield int(blocks[own[0]]), pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), rows.column(2).cast(pa.binary()).to_pylist()


def _documents(ids: np.ndarray, unknown: np.ndarray, texts: list, numbers: Numbers) -> Iterator[tuple[int, int, Runs]]:
    """Runs of a stretch; rows of null id count as texts without words."""
    known = [None if u else t for t, u in zip(texts, unknown, strict=True)]
    for first, last, counts, words in word_values(known, SPACES, numbers):
        yield first, last, Runs(counts, words)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, doc_id, text, size) written once; blocks are numbered by partition and place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            total = filled + np.cumsum(size.to_numpy())
            number = block + (total - size.to_numpy()) // block_bytes
            filled = int(total[-1]) if len(total) else filled
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0), batch.column(1), size], names=["block", "doc_id", "text", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "block bigint, doc_id bigint, text string, size bigint")
    return compressed(rows, "blocks")


def _tell(rows: DataFrame, label: str) -> str:
    """Write rows (block, ...) so that a task can read those of one block; the folder's path."""
    path = new_folder(rows.sparkSession, label)
    rows.repartition("block").write.partitionBy("block").parquet(path)
    return path


def _told(folder: str, block: int) -> list[dict]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, inner = open_fs(folder)
    found = files.get_file_info(fs.FileSelector(f"{inner}/block={block}", allow_not_found=True))
    rows: list[dict] = []
    for info in sorted(found, key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as source:
                rows += pq.ParquetFile(source).read().to_pylist()
    return rows


class Lookup:
    """A sorted set of 64-bit keys that is asked for many values, few of them members."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << min(24, max(10, (8 * len(keys)).bit_length()))) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[keys & self.mask] = True

    def members(self, values: np.ndarray) -> np.ndarray:
        """Places in ``values`` of what is in the set."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[values & self.mask])
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == values[maybe]]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal sorted keys start."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _by_bucket(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys by their leading bits."""
    bucket = keys >> np.uint64(shift)
    starts = _groups(bucket)
    yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


# --- step 1: anchors and rolling windows -----------------------------------------


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def probes(table: DataFrame, length: int, bits: int) -> DataFrame:
    """(bucket, block, data): packed hashes of a block's rolling windows, each once, with two marks."""
    size, shift = anchor_size(length), 64 - bits - BITS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, block, held = _numbers(), None, []

        def hand_on() -> Iterator:
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            keys.sort()
            starts = _groups(keys >> np.uint64(1))
            if len(starts):
                stops = np.append(starts[1:], len(keys))
                # an anchor's mark is the lowest bit, so the last of a group has it if any has
                entry = keys[stops - 1]
                packed = (entry >> np.uint64(1) & MASK) << np.uint64(2) | (entry & np.uint64(1)) << np.uint64(1) | (stops - starts > 1)
                found = list(_by_bucket(entry, BITS + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in found], pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([_five(packed[p:q]) for _, p, q in found], pa.binary())], names=["bucket", "block", "data"]
                )

        for own, ids, unknown, texts in _parts(batches):
            if own != block:
                yield from hand_on()
                block = own
            for _, _, runs in _documents(ids, unknown, texts, numbers):
                at = runs.starts(size)
                if len(at):
                    held.append(rolled(runs.words, size, 1)[at] >> np.uint64(shift) << np.uint64(1) | (runs.offset(at) % size == 0))
        yield from hand_on()
        give_back()

    return table.select("block", "doc_id", "text").mapInArrow(run, "bucket bigint, block bigint, data binary")


def _hits(packs):
    """(block, bucket, data): hashes of one bucket that come twice and are an anchor somewhere, for each block that has them."""
    import pyarrow as pa

    data, blocks = packs.column("data").to_pylist(), packs.column("block").to_numpy()
    keys = np.concatenate([_from_five(d) << np.uint64(24) | np.uint64(i) for i, d in enumerate(data)])
    keys.sort()
    hashes = keys >> np.uint64(26)
    starts = _groups(hashes)
    stops = np.append(starts[1:], len(keys))
    anchor = np.bitwise_or.reduceat(keys >> np.uint64(25) & np.uint64(1), starts).astype(bool)
    twice = np.bitwise_or.reduceat(keys >> np.uint64(24) & np.uint64(1), starts).astype(bool) | (stops - starts > 1)
    chosen = np.repeat(anchor & twice, stops - starts)
    hashes, pack = hashes[chosen], (keys[chosen] & np.uint64((1 << 24) - 1)).astype(np.int64)
    order = np.argsort(pack, kind="stable")
    hashes, pack = hashes[order], pack[order]
    first = _groups(pack)
    parts = np.split(hashes, first[1:]) if len(first) else []
    bucket = packs.column("bucket")[0].as_py()
    return pa.Table.from_arrays([pa.array(blocks[pack[first]], pa.int64()), pa.array([bucket] * len(parts), pa.int64()), pa.array([_five(p) for p in parts], pa.binary())], names=["block", "bucket", "data"])


# --- step 2: windows around hits --------------------------------------------------


def _near(runs: Runs, hits: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that hold a hit and fit into its document."""
    n = len(runs.words)
    begin, end = np.repeat(runs.ends - runs.counts, runs.counts), np.repeat(runs.ends, runs.counts)
    low, high = np.maximum(hits - (length - anchor_size(length)), begin[hits]), np.minimum(hits, end[hits] - length)
    low, high = low[low <= high], high[low <= high]
    return np.flatnonzero(np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)[: n + 1])[:n] > 0)


def _prints(words: np.ndarray, length: int, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 31-bit hash, independent of each other, of windows."""
    return rolled(words, length, 2, at), (rolled(_mixed(words), length, 3, at) >> np.uint64(33)).astype(np.uint32)


def _packed(a: np.ndarray, b: np.ndarray, docs: np.ndarray) -> bytes:
    return a.astype("<u8").tobytes() + b.astype("<u4").tobytes() + docs.astype("<i8").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n), np.frombuffer(data, "<i8", n, 12 * n)


def windows(table: DataFrame, folder: str, length: int, bits: int) -> DataFrame:
    """(bucket, block, data): fingerprints of a block's windows around hits with the least document, marked where there are several."""
    size, shift = anchor_size(length), 64 - bits - BITS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, block, held, lookup = _numbers(), None, [], Lookup(np.zeros(0, np.uint64))

        def hand_on() -> Iterator:
            if not held:
                return
            a, b, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((docs, b, a))
            a, b, docs = a[order], b[order], docs[order]
            starts = _groups(a, b)
            several = docs[np.append(starts[1:], len(a)) - 1] != docs[starts]
            a, b, docs = a[starts], b[starts] << np.uint32(1) | several, docs[starts]
            found = list(_by_bucket(a, 64 - bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _, _ in found], pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([_packed(a[p:q], b[p:q], docs[p:q]) for _, p, q in found], pa.binary())], names=["bucket", "block", "data"]
            )

        for own, ids, unknown, texts in _parts(batches):
            if own != block:
                yield from hand_on()
                block = own
                rows = _told(folder, block)
                hits = np.concatenate([np.uint64(r["bucket"] << BITS) | _from_five(r["data"]) for r in rows]) if rows else np.zeros(0, np.uint64)
                hits.sort()
                lookup = Lookup(hits)
            for first, last, runs in _documents(ids, unknown, texts, numbers):
                at = runs.starts(size)
                hits = at[lookup.members(rolled(runs.words, size, 1)[at] >> np.uint64(shift))] if len(at) else at
                near = _near(runs, hits, length) if len(hits) else hits
                if len(near):
                    held.append((*_prints(runs.words, length, near), np.repeat(ids[first:last], runs.counts)[near]))
        yield from hand_on()
        give_back()

    return table.select("block", "doc_id", "text").mapInArrow(run, "bucket bigint, block bigint, data binary")


def _sources(packs):
    """(block, data): fingerprints of one bucket that several documents have, with the least of these, for each block with a larger one."""
    import pyarrow as pa

    blocks = packs.column("block").to_numpy()
    held = [_unpacked(d) for d in packs.column("data").to_pylist()]
    pack = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
    a, b, docs = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((docs, b >> np.uint32(1), a))
    a, b, docs, pack = a[order], b[order], docs[order], pack[order]
    starts = _groups(a, b >> np.uint32(1))
    least = np.repeat(docs[starts], np.diff(np.append(starts, len(a))))
    chosen = (docs > least) | (b & np.uint32(1)).astype(bool)
    a, b, least, pack = a[chosen], b[chosen] >> np.uint32(1), least[chosen], pack[chosen]
    order = np.argsort(pack, kind="stable")
    a, b, least, pack = a[order], b[order], least[order], pack[order]
    first = _groups(pack)
    ends = [*first[1:].tolist(), len(pack)]
    return pa.Table.from_arrays([pa.array(blocks[pack[first]], pa.int64()), pa.array([_packed(a[p:q], b[p:q], least[p:q]) for p, q in zip(first.tolist(), ends, strict=True)] if len(first) else [], pa.binary())], names=["block", "data"])


# --- step 3: repeats taken out ----------------------------------------------------


class Repeats(Lookup):
    """The fingerprints a block was told of, with the least document of each."""

    def __init__(self, rows: list[dict]):
        held = [_unpacked(r["data"]) for r in rows] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        a, b, least = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((least, b, a))
        super().__init__(a[order])
        self.b, self.least = b[order], least[order]

    def starts(self, runs: Runs, docs: np.ndarray, length: int) -> np.ndarray:
        """Starts of windows that a document smaller than their own has."""
        at = runs.starts(length)
        if not len(at) or not len(self.keys):
            return at[:0]
        a = rolled(runs.words, length, 2)[at]
        found = self.members(a)
        at, a = at[found], a[found]
        b = _prints(runs.words, length, at)[1]
        own, place, repeated = docs[at], np.searchsorted(self.keys, a), np.zeros(len(at), bool)
        # equal 64-bit hashes follow each other; the rest of the fingerprint tells them apart
        while True:
            here = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == a)
            if not here.any():
                return at[repeated]
            spot = place[here]
            repeated[here] |= (self.b[spot] == b[here]) & (self.least[spot] < own[here])
            place = place + 1


def _kept(text: bytes | None, keep: np.ndarray) -> bytes:
    """The words of a text that are kept, joined by one space."""
    found, at = [], 0
    for piece in pieces(text or b"", SPACES):
        words = piece.split()
        found.append(b" ".join(itertools.compress(words, keep[at : at + len(words)])))
        at += len(words)
    return b" ".join(f for f in found if f)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text) of every row: the words taken out, as spans [start, stop) of word numbers, and what is left, joined by one space."""
    spark = docs.sparkSession
    table = write_blocks(docs, id_col, text_col, block_bytes)
    total = table.agg(F.sum("size")).first()[0] or 0
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    bits = (buckets - 1).bit_length()
    found = probes(table, length, bits).groupBy("bucket").applyInArrow(_hits, "block bigint, bucket bigint, data binary")
    hits = _tell(found, "anchor-hits")
    found = windows(table, hits, length, bits).groupBy("bucket").applyInArrow(_sources, "block bigint, data binary")
    sources = _tell(found, "window-sources")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, block, repeats = _numbers(), None, Repeats([])
        for own, ids, unknown, texts in _parts(batches):
            if own != block:
                block, repeats = own, Repeats(_told(sources, own))
            for first, last, counts, words in word_values(texts, SPACES, numbers):
                runs = Runs(counts, words)
                docs_of = np.repeat(np.where(unknown[first:last], np.iinfo(np.int64).min, ids[first:last]), counts)
                starts = repeats.starts(runs, docs_of, length)
                n = len(words)
                taken = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)[: n + 1])[:n] > 0
                edge = np.diff(np.concatenate([[False], taken, [False]]).astype(np.int8))
                begins = runs.ends - counts
                inner = np.isin(np.arange(n), begins)  # a span ends where its document does
                opens, stops = np.flatnonzero((edge[:n] == 1) | (taken & inner)), np.flatnonzero((edge[1:] == -1) | (taken & np.append(inner[1:], True))) + 1
                which = np.searchsorted(runs.ends, opens, side="right")
                spans = [[] for _ in counts]
                for d, p, q in zip(which.tolist(), (opens - begins[which]).tolist(), (stops - begins[which]).tolist(), strict=True):
                    spans[d].append({"start": p, "stop": q})
                removed = np.bincount(np.repeat(np.arange(len(counts)), counts)[taken], minlength=len(counts))
                left = [_kept(t, ~taken[p:q]) for t, p, q in zip(texts[first:last], begins.tolist(), runs.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last], pa.int64(), mask=unknown[first:last]), pa.array(counts), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "text"],
                )
        give_back()

    return table.select("block", "doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: passages of 13 words that a smaller document holds, taken out of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
