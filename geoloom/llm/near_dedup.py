"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is the ``k`` least
hashes of its set.  Inverted lists of retained values give the overlaps, a
union-sketch estimate filters, and the Jaccard similarity of the full sets decides.

1. Documents of equal sets form a class; its least id stands for it from then on,
   so copies cost one row each.
2. Retained values that no other class of similar set size has are dropped, and each
   class keeps lists only for its rarest values: two classes that share at least
   ``need`` values meet in one of the ``shared - need + 1`` rarest (prefix filter).  A
   member whose neighbours by set size differ too much to be similar leaves a list.  A
   passage that many documents share therefore makes no candidates among documents that differ.
3. In two *star* rounds each list offers its members a few pivots; a member is
   compared with the pivot of best estimate, and links join components.
4. What is left are lists that hold several components.  Each member of a smaller
   component is compared with every member of the large components in its lists,
   and members of small components with each other, in blocks of ``BLOCK``, first
   by sketch and then in full.  Lists of mostly the same members are joined before,
   and each two blocks of a list meet once.  Of the lists that two members share, only that of
   least key compares them, and full sets go only to lists where a sketch came near.

A link between components is missed if the sketches share under ``need`` values or
the last step's estimate is under ``least``.  For a pair at a similarity of 0.8 a
binomial model gives 51 or fewer of 96 a chance of 3e-9, and an estimate under 0.45
one below 1e-12 (the model's figures; the loss itself is not measured).
``estimate`` holds for the star rounds, whose misses stay for the last step; sets of
at most ``0.8 k`` shingles are handled exactly.
No group is expanded into its pairs and nothing per document reaches the driver.
Written tables are deleted once no later step reads them.

Defined results: null and empty texts and texts without words have the empty set
and are linked with nothing, as are rows of null id; a text of fewer words than a
shingle has the one sequence of its words; rows that repeat an id are one document;
an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.graph import connected_components

from .common import discard, give_back, materialise, release

K = 96
NEED = 52
ESTIMATE = 0.57
#: Estimate from which the last step compares in full.
LEAST = 0.45
BLOCK = 256
#: Pivots that a list offers in a round.
PIVOTS = 3
#: Pivots that a member is held against in a round, by its sketch.
NEAREST = 4
#: Rows up to which a table of ids may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
CACHE = 150_000
ROWS = 500
#: Classes whose retained values are dealt at once.
MANY = 5_000
#: Classes among ``MANY`` that make a value frequent, and how many frequent values all tasks are told.
OFTEN = 128
FREQUENT = 65_536
#: Retained values that a task holds at once.
BUCKET = 500_000


class Shingler:
    """64-bit hashes of the distinct word shingles of texts."""

    def __init__(self, words: int):
        self.words, self._known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes (int64)."""
        import xxhash

        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; splits at 9-13 and 32
        if not parts:
            return np.zeros(0, np.int64)
        known = self._known
        if len(known) > CACHE:
            known.clear()
        for word in set(parts).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        one = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        n = min(self.words, len(parts))
        size = len(parts) - n + 1
        value = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            value = (value ^ one[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        return np.unique(value.view(np.int64))


def _slices(batches: Iterator, rows: int = ROWS) -> Iterator:
    """Batches in parts of ``rows`` rows, which bounds what Python holds at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    give_back()


def sketches(docs: DataFrame, words: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, print (16 bytes of the set), sketch (array<long>, ascending)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingler(words)
        for batch in _slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "print", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, print binary, sketch array<bigint>")


def pack_set(hashes: np.ndarray) -> bytes:
    """A set's hashes at six bytes each; 48 bits tell the shingles of two documents apart."""
    low = np.unique(hashes.view(np.uint64) & np.uint64(0xFFFFFFFFFFFF)).astype("<u8")
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted and found small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Unsigned columns of equal length, the first ascending, as byte planes without the planes of zeros; the first by differences."""
    first = columns[0]
    parts = [struct.pack("<IQ", len(first), int(first[0]))]
    for column in (np.diff(first, prepend=first[:1]), *columns[1:]):
        planes = (int(column.max()).bit_length() + 7) // 8
        parts += [bytes([planes]), column.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes].tobytes()]
    return b"".join(parts)


def unpack_columns(data: bytes) -> list[np.ndarray]:
    count, base = struct.unpack_from("<IQ", data)
    at, columns = 12, []
    while at < len(data):
        planes = data[at]
        wide = np.zeros((count, 8), dtype=np.uint8)
        wide[:, :planes] = np.frombuffer(data, np.uint8, planes * count, at + 1).reshape(planes, count).T
        columns.append(wide.view("<u8").ravel())
        at += 1 + planes * count
    columns[0] = np.cumsum(columns[0], dtype=np.uint64) + np.uint64(base)
    return columns


def _dealt(columns: list[np.ndarray], buckets: int):
    """Rows dealt to buckets by the first column, packed: a record batch (bucket, rows)."""
    import pyarrow as pa

    bucket = ((columns[0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((columns[0], bucket))
    names, starts = np.unique(bucket[order], return_index=True)
    packed = [pack_columns([c[rows] for c in columns]) for rows in np.split(order, starts[1:])] if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "rows"])


def _by_bucket(dealt: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on the columns of each bucket's rows."""

    def run(batches: Iterator) -> Iterator:
        now, held = None, []
        for batch in _slices(batches):
            for bucket, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield work([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                now = bucket
                held.append(unpack_columns(rows))
        if held:
            yield work([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _postings(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, rep, n) of each retained value of a batch of classes, unsigned."""
    sketch = batch.column(2)
    sizes = np.diff(sketch.offsets.to_numpy())
    reps, n = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
    return sketch.flatten().to_numpy().view(np.uint64), np.repeat(reps, sizes), np.repeat(n, sizes)


def _inverted_lists(classes: DataFrame, k: int, need: int, similarity: int, often: int, frequent: int) -> DataFrame:
    """(value, rep, n): the lists that candidates meet in, with the sizes of the members' sets.

    Retained values are dealt once by value, packed, and those that no class of similar
    size shares stay behind; the rest are dealt once by class, which keeps its rarest.
    Values with ``often`` holders among ``MANY`` classes, ``frequent`` of them at most,
    are not dealt by value, so no task gets a long list: they count as shared.
    """
    classes = classes.select("rep", "n_shingles", "sketch")
    buckets = 1 + classes.count() * k // BUCKET

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(batches, MANY):
            values, holders = np.unique(_postings(batch)[0], return_counts=True)
            many = holders >= often
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(holders[many].astype(np.int64))], names=["value", "holders"])

    counted = classes.mapInArrow(count, "value bigint, holders bigint").groupBy("value").agg(F.sum("holders").alias("holders"))
    rows = counted.orderBy(F.desc("holders"), "value").limit(frequent).collect()
    known = np.array([r.value for r in rows], np.int64).view(np.uint64)
    order = np.argsort(known)
    known, known_holders = known[order], np.array([r.holders for r in rows], np.uint64)[order]

    def told(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each value is among the frequent ones, and where."""
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        return (known[at] == values if len(known) else np.zeros(len(values), bool)), at

    def by_value(batches: Iterator) -> Iterator:
        for batch in _slices(batches, MANY):
            columns = _postings(batch)
            rest = ~told(columns[0])[0]
            yield _dealt([c[rest] for c in columns], buckets)

    def by_rep(batches: Iterator) -> Iterator:
        for batch in _slices(batches, MANY):
            value, rep, n = _postings(batch)
            hit, at = told(value)
            yield _dealt([rep[hit], value[hit], known_holders[at[hit]], n[hit]], buckets)

    def shared(columns: list[np.ndarray]):
        value, rep, n = columns
        order = np.lexsort((n, value))
        value, rep, n = value[order], rep[order], n[order]
        same = value[1:] == value[:-1]
        close = same & (n[1:] * np.uint64(similarity) <= n[:-1] * np.uint64(100))
        starts = np.flatnonzero(np.append(True, ~same))
        sizes = np.diff(np.append(starts, len(value)))
        holders = np.repeat(sizes, sizes).astype(np.uint64)
        kept = np.append(False, close) | np.append(close, False)
        return _dealt([rep[kept], value[kept], holders[kept], n[kept]], buckets)

    def rarest(columns: list[np.ndarray]):
        import pyarrow as pa

        rep, value, holders, n = columns
        order = np.lexsort((value, holders, n, rep))
        rep, value, n = rep[order], value[order], n[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (n[1:] != n[:-1])))
        sizes = np.diff(np.append(starts, len(rep)))
        wanted = np.where(n[starts] <= int(0.8 * k), np.ceil(n[starts] * 0.8), need).astype(np.int64)
        kept = np.arange(len(rep)) - np.repeat(starts, sizes) <= np.repeat(sizes - wanted, sizes)
        return pa.RecordBatch.from_arrays([pa.array(c[kept].view(np.int64)) for c in (value, rep, n)], names=["value", "rep", "n"])

    schema = "bucket int, rows binary"
    dealt = _by_bucket(classes.mapInArrow(by_value, schema), shared, schema)
    if len(known):
        dealt = dealt.unionAll(classes.mapInArrow(by_rep, schema))
    return _by_bucket(dealt, rarest, "value bigint, rep bigint, n bigint")


def _estimate(a: str, b: str, k: int):
    """Share of the union's k least values that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _groups(batches: Iterator, decode) -> Iterator:
    """(key, part, side, id, component, own values, n, own lists, index of the block) for every row of side 1 or 2, block by block.

    The index holds all values of the block's rows of side 0 or 2 in order, with their
    owners, and the owners' sizes, ids, components, values, n and lists, and their side.
    Rows of side 2 are a block that is held against itself, and against rows of side 1.
    """
    key, block, both, index = None, [], [], None

    def indexed() -> tuple:
        ids, components, sets, totals, lists = zip(*block, strict=True)
        values, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes, ids, np.array(components), sets, np.array(totals), lists, 2 if both else 0

    def held() -> Iterator:
        within = (index or indexed()) if both else None
        for doc, component, own, n, lists in both:
            yield *key, 2, doc, component, own, n, lists, within

    for batch in _slices(batches):
        for k1, k2, side, doc, component, n, raw, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != key:
                yield from held()
                key, block, both, index = (k1, k2), [], [], None
            row = (doc, component, decode(raw), n, lists)
            if side != 1:
                block.append((doc, component, row[2], n, lists))
                if side == 2:
                    both.append(row)
                continue
            if not block:
                continue
            if index is None:
                index = indexed()
            yield k1, k2, 1, *row, index
        yield None  # the batch is over
    yield from held()
    yield None


def _shared(own: np.ndarray, index: tuple) -> np.ndarray:
    """How many values each member of a block shares with a set."""
    values, owner, sizes = index[:3]
    first = np.searchsorted(values, own)
    spans = np.searchsorted(values, own, side="right") - first
    at = np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
    return np.bincount(owner[at], minlength=len(sizes))


def _ordered(work: DataFrame, payload: str) -> DataFrame:
    lists = F.col("lists") if "lists" in work.columns else F.lit(None).cast("array<bigint>").alias("lists")
    return work.select("key", "part", "side", "id", "component", "n", payload, lists).repartition("key", "part").sortWithinPartitions("key", "part", F.col("side") == 1)


def promising(work: DataFrame, k: int, estimate: float, similarity: int) -> DataFrame:
    """(id, key, part, side) of the rows whose sketch comes near that of a row they are held against, of another component.

    Sets whose sizes ``n`` are too far apart to be similar are passed over.  Two rows
    that meet under several keys, by their ``lists`` of keys, count under the least.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        block, told = None, set()
        for item in _groups(batches, lambda raw: np.array(raw, dtype=np.int64)):
            if item is None:
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "key", "part", "side"])
                out = []
                continue
            key, part, side, doc, component, own, n, lists, index = item
            if index is not block:
                block, told = index, set()
            both, found = _shared(own, index), False
            fits = 100 * np.minimum(n, index[6]) >= similarity * np.maximum(n, index[6])
            for i in np.flatnonzero(fits & (both >= estimate * np.minimum(k, index[2] + len(own) - both)) & (index[4] != component)).tolist():
                other = index[7][i]
                if found and i in told or lists and other and min(set(lists).intersection(other), default=key) != key:
                    continue
                union = np.union1d(own, index[5][i])[:k]
                common = np.intersect1d(own, index[5][i], assume_unique=True)
                if np.isin(union, common, assume_unique=True).sum() >= estimate * len(union):
                    if i not in told:
                        told.add(i)
                        out.append((index[3][i], key, part, index[8]))
                    if not found:
                        found = True
                        if side == 1:
                            out.append((doc, key, part, 1))
                        elif (mine := index[3].index(doc)) not in told:
                            told.add(mine)
                            out.append((doc, key, part, 2))

    return _ordered(work, "sketch").mapInArrow(run, "id bigint, key bigint, part int, side int")


def compare(work: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between rows of other components that are held against each other in their (key, part), if their sets are similar.

    A group holds at most a block of side 0, which side 1 streams past, or of side 2.
    One link to each component is enough.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        for item in _groups(batches, unpack_set):
            if item is None:
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
                continue
            _, _, _, doc, component, own, _, _, index = item
            both = _shared(own, index)
            hit = np.flatnonzero((100 * both >= similarity * (index[2] + len(own) - both)) & (index[4] != component))
            _, first = np.unique(index[4][hit], return_index=True)
            out += [(doc, index[3][i]) for i in hit[first]]

    return _ordered(work, "hashes").mapInArrow(run, "a bigint, b bigint")


def joined_lists(members: DataFrame, seeds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(id, key, component): lists (key, id, component) of which those of mostly the same members are one.

    Lists that have the member of least hash in common are joined where the list of all
    their members makes no more pairs than they make each by itself; members that meet
    in a list still do.
    """
    for seed in seeds:
        named = members.groupBy("key").agg(F.min(F.xxhash64("id", F.lit(seed))).alias("name"), F.count("*").cast("double").alias("n"))
        named = materialise(named, "named")
        pairs = named.groupBy("name").agg(F.count("*").alias("lists"), F.sum(F.col("n") * F.col("n")).alias("pairs")).where("lists > 1")
        together = members.join(named, "key").join(pairs, "name")
        union = together.groupBy("name").agg(F.count_distinct("id").cast("double").alias("m"), F.first("pairs").alias("pairs")).where("m * m <= pairs").select("name")
        renamed = named.join(union, "name").select("key", F.xxhash64(F.lit("lists"), F.lit(seed), "name").alias("joined"))
        members = members.join(materialise(renamed, "renamed"), "key", "left").select("id", F.coalesce("joined", "key").alias("key"), "component").distinct()
        members = materialise(members, "members")
    return members


def met_in_blocks(members: DataFrame) -> DataFrame:
    """(id, key, part, side, component): lists (key, parts, id, component) in blocks, so that each two members of a list meet in one.

    Blocks are held against themselves, and a member against those after its own.
    """
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    later = members.withColumn("own", own).where(F.col("own") + 1 < F.col("parts")).select("id", "key", F.explode(F.sequence(F.col("own") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "component")
    return members.select("id", "key", own.alias("part"), F.lit(2).alias("side"), "component").unionAll(later)


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(small(rows), "id").withColumn("n", F.lit(0).cast("long"))


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: int = 80, k: int = K, need: int = NEED, estimate: float = ESTIMATE, least: float = LEAST,
    id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    ``similarity`` is in hundredths.  ``component_id`` is the least id reachable.
    """
    spark = docs.sparkSession
    sketched = materialise(sketches(docs, words, k, id_col, text_col), "sketches")
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(
        real.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes"
    )
    documents = materialise(sketched.select("doc_id", "n_shingles", "print"), "documents")
    discard(sketched)
    release(spark)
    rarest = materialise(_inverted_lists(classes, k, need, similarity, often, frequent), "rarest")
    # sets that are similar are of similar size, so a member far from both its neighbours by size has no partner here
    by_value = Window.partitionBy("value")
    by_size = by_value.orderBy("n", "rep")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    close = (F.col("n") * similarity <= before * 100) | (after * similarity <= F.col("n") * 100)
    members = rarest.withColumn("close", close).where("close").select("value", "rep")
    # lists of the same members, as two near copies have many, are one: that of least value, which each member finds alike
    print_of = [F.bit_xor(F.xxhash64("rep", F.lit(i))).over(by_value).alias(f"x{i}") for i in range(2)]
    members = members.select("value", "rep", F.count("*").over(by_value).alias("n"), *print_of)
    alike = Window.partitionBy("rep", "n", "x0", "x1")
    lists = materialise(members.withColumn("least", F.min("value").over(alike)).where("value = least").select("value", "rep"), "lists")
    discard(rarest)

    def hash_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingles = Shingler(words)
        for batch in _slices(batches):
            packed = [pack_set(shingles(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "hashes"])

    wanted = materialise(lists.select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialise(texts.join(small(wanted), "id", "left_semi").mapInArrow(hash_sets, "id bigint, hashes binary"), "sets")
    sketch = classes.join(small(wanted.withColumnRenamed("id", "rep")), "rep", "left_semi").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    brief = materialise(sketch.select("id", "n", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("brief")), "brief")
    prints = materialise(classes.select("print", "rep"), "prints")
    discard(classes, wanted)
    release(spark)

    links: DataFrame | None = None
    labels: DataFrame | None = None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("component", F.col("rep"))
        known = labels.select(F.col("node").alias("rep"), "component")
        return rows.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        found = materialise(found, "links")
        links = found if links is None else links.unionAll(found)
        labels = connected_components(links, materialise)
        release(spark)

    for seed in (0, PIVOTS):
        placed = materialise(labelled(lists), "placed")
        offers = [F.min(F.struct(F.xxhash64("rep", F.lit(seed + i)).alias("order"), "rep", "component")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = placed.groupBy("value").agg(*offers, F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        pivots = pivots.select("value", F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.rep").alias("rep"), F.col(f"p{i}.component").alias("component")) for i in range(PIVOTS)])).alias("pivots"))
        pairs = placed.join(pivots, "value").select(F.col("rep").alias("id"), "component", F.explode(F.filter("pivots", lambda p: p["component"] != F.col("component"))).alias("pivot"))
        # of its pivots a member is held against those that it shares most lists with; what that misses stays for the last step too
        pairs = pairs.groupBy("id", F.col("pivot.rep").alias("key")).agg(F.count("*").alias("met"))
        pairs = pairs.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "key")), False), 1, NEAREST).alias("best"))
        pairs = pairs.select("id", F.explode("best.key").alias("key"))
        pairs = pairs.join(brief.select("id", F.col("brief").alias("own")), "id").join(brief.select(F.col("id").alias("key"), F.col("brief").alias("other")), "key")
        # the nearest pivot is enough for a round; what it misses stays for the last step
        pairs = pairs.withColumn("near", _estimate("own", "other", k)).where(F.col("near") >= estimate)
        pairs = materialise(pairs.groupBy("id").agg(F.max_by("key", F.struct("near", "key")).alias("key")), "pairs")
        release(spark)
        # a hot pivot's members are dealt out over parts, each with its own copy of the pivot
        parts = pairs.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        members = pairs.join(parts, "key").select("id", "key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.lit(1).cast("long").alias("component"))
        heads = parts.select(F.col("key").alias("id"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("component"))
        add(compare(_with_sets(materialise(members.unionAll(heads), "work"), sets), similarity))

    # what is left: lists of several components
    placed = materialise(labelled(lists), "placed")
    nodes = placed.select(F.col("rep").alias("id"), "component").distinct()
    sizes = materialise(nodes.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value")
    placed = materialise(placed.join(mixed, "value").join(sizes, "component"), "mixed")
    # members of smaller components against each large one that they share a list with
    large = placed.where(F.col("size") > BLOCK).select("value", F.col("component").alias("other"), F.col("size").alias("other_size")).distinct()
    rank = F.struct("size", "component") < F.struct(F.col("other_size").alias("size"), F.col("other").alias("component"))
    facing = materialise(placed.join(large, "value").where(rank).select(F.col("rep").alias("id"), "component", "other", "other_size").distinct(), "facing")
    parts_of = F.ceil(F.col("other_size") / BLOCK).cast("int")
    name = F.xxhash64(F.lit("component"), "other").alias("key")
    movers = facing.select("id", name, F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("part"), F.lit(1).alias("side"), "component")
    faced = facing.select("other", "other_size").distinct()
    stayers = nodes.join(small(faced), F.col("component") == F.col("other")).select("id", name, F.pmod(F.xxhash64("id"), parts_of).cast("int").alias("part"), F.lit(0).alias("side"), "component")
    # members of small components of a list against each other
    minor = placed.where(F.col("size") <= BLOCK).select(F.col("rep").alias("id"), F.xxhash64(F.lit("list"), "value").alias("key"), "component")
    minor = joined_lists(materialise(minor, "minor"))
    several = minor.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    minor = materialise(minor.join(several.select("key", "parts"), "key").select("id", "key", "parts", "component"), "minor")
    held = materialise(movers.unionAll(stayers).unionAll(met_in_blocks(minor)), "held")
    met = minor.groupBy("id").agg(F.collect_set("key").alias("lists"))
    sketch = brief.withColumnRenamed("brief", "sketch").join(met, "id", "left")
    near = materialise(promising(sketch.join(small(held), "id"), k, least, similarity), "near")
    release(spark)
    held = held.join(small(near.distinct()), ["id", "key", "part", "side"], "left_semi")
    add(compare(_with_sets(materialise(held, "work"), sets), similarity))
    discard(sets, brief)

    known = prints.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("print", F.coalesce("component", "rep").alias("component"))
    own = documents.withColumn("real", F.expr("n_shingles > 0 and doc_id is not null")).select("doc_id", "n_shingles", "print", "real")
    placed = own.where("real").join(known, "print").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = own.where("not real").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` without the documents whose group has one of a smaller id; of rows that repeat id and text one stays."""
    gone = materialise(near_duplicates(docs, words, similarity).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    # only rows of ids that come again are compared by text
    again = materialise(left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    single, repeated = left.join(small(again), "doc_id", "left_anti"), left.join(small(again), "doc_id", "left_semi")
    return single.select(*docs.columns).unionAll(repeated.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: two-word shingles over all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
