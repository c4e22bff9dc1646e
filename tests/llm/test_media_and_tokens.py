"""FLAC, BPE, token files, packing and WARC: exact round trips and brute force."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from tokenizers import Tokenizer

from geoloom.llm import byte_bpe, common, flac, packing, token_files, warc
from geoloom.llm.tokens import TextEncoder

HARD = [None, "", " ", "  a  b\t\n c\x1c \x1cd  ", "don't I'll 123abc!!!  x　y", "a" * 3000 + "héllo", "x\n\n\ny \x85z", "日本語テスト 😀😀 <|endoftext|> <|startoftext|>x", "é ́x ​z᠎ q", "\x00 \x1f a\x1fb \x1d\x1d", " \r\n\r\n a"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def hard(spark):
    """Hard texts with a repeated row, a null id and extra columns of clashing names."""
    rows = [(i, t, "x", 1, b"z") for i, t in enumerate(HARD)] + [(4, HARD[4], "x", 1, b"z"), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, payload binary")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_librarys(name, data):
    texts = HARD + pd.read_parquet(f"{data}/documents.parquet").text.tolist()
    one = library(name)
    for text, ids in zip(texts, TextEncoder(P.path(name)).encode(texts, 2), strict=True):
        assert ids.tolist() == [*one(text), 2]


def tik():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktokens(spark):
    ranks, own = tik()
    rows = byte_bpe.byte_bpe(hard(spark), ranks, P.PATTERN, block_bytes=40).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        text = ("no id" if r.doc_id is None else HARD[r.doc_id]) or ""
        assert list(r.ids) == own.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids)
    assert byte_bpe.byte_bpe(hard(spark).limit(0), ranks, P.PATTERN).count() == 0


def test_words_that_are_missing_or_double_are_an_error(tmp_path):
    """What a lost executor could leave: a block whose words do not all come, or come twice."""
    import pyarrow as pa

    folder = f"file://{tmp_path}"
    for _ in range(2):  # a task that runs again finds its file there
        byte_bpe._store(f"{folder}/7", pa.array([11, 12]), np.array([2, 1]), np.array([0, 2, 1], np.uint32))
    assert [p.name for p in tmp_path.iterdir()] == ["7"]

    def assembled(numbers):
        words = [b"", b"a", b"bc", b"d"]
        table = pa.table({"block": [7] * len(numbers), "number": pa.array(numbers, pa.int32()), "ids": pa.array([[i + 1] if i >= 0 else [] for i in numbers], pa.list_(pa.int32())), "text": pa.array([words[i + 1] for i in numbers], pa.binary())})
        rows = [r for b in byte_bpe._assemble(byte_bpe._pack(iter(table.to_batches())), folder, True) for r in b.to_pylist()]
        return [(r["doc_id"], r["ids"], r["decoded"]) for r in rows]

    assert assembled([2, -1, 0, 1]) == [(11, [1, 3], b"ad"), (12, [2], b"bc")]
    for numbers in ([-1, 0, 1], [-1, 0, 1, 1, 2], [0, 1, 2], [-1, 0, 2]):
        with pytest.raises(ValueError, match="not complete"):
            assembled(numbers)


def test_op6_on_whole_documents(spark, data):
    _, own = tik()
    texts = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id").text
    rows = byte_bpe.query(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts.index)
    for r in rows:
        packed = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


STREAMS = [np.zeros(0), np.array([5]), np.arange(5000), np.random.default_rng(0).integers(0, 1 << 28, 3000), np.random.default_rng(1).zipf(1.3, 9000) % 49408, np.full(9000, 7), np.array([65535, 65536, 0, 1 << 28, (1 << 29) - 1])]


@pytest.mark.parametrize("ids", STREAMS)
def test_coder_round_trip(ids):
    ids = ids.astype(np.uint32)
    blocks = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(blocks) == ids).all()
    if len(blocks) > 1:  # blocks are independent
        assert (token_files.decode_blocks(blocks[1:2]) == ids[token_files.BLOCK :][: token_files.BLOCK]).all()


def test_coder_compresses_and_detects_damage():
    ids = (np.random.default_rng(2).zipf(1.4, 8000) % 49408).astype(np.uint32)
    blocks = token_files.encode_blocks(ids)
    assert sum(len(b[2]) for b in blocks) < 1.6 * len(ids)
    count, crc, part = blocks[0]
    for at in (0, 1, 5, len(part) // 2):
        with pytest.raises(ValueError):
            token_files.decode_blocks([(count, crc, part[:at] + bytes([part[at] ^ 64]) + part[at + 1 :])])
    with pytest.raises(ValueError):
        token_files.encode_blocks(np.array([1 << 29], np.uint32))


def test_coder_beats_order_0_and_zlib(data):
    docs = pd.read_parquet(f"{data}/../sf0.01/documents.parquet")
    ids = np.concatenate(TextEncoder(P.path("word_bpe_49k.json")).encode(docs.text.tolist(), 2))
    coded = sum(len(b[2]) for b in token_files.encode_blocks(ids))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert coded < -(share * np.log2(share)).sum() * len(ids) / 8
    assert coded < sum(len(zlib.compress(ids[a : a + token_files.BLOCK].astype("<u2").tobytes())) for a in range(0, len(ids), token_files.BLOCK))


def test_op3_on_whole_documents(spark, data):
    """Every digest against the library's ids."""
    one, texts = library("word_bpe_49k.json"), pd.read_parquet(f"{data}/documents.parquet").sort_values("doc_id")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.query(spark, data).collect()}
    start, wanted = 0, {}
    for doc_id, text in zip(texts.doc_id, texts.text):
        ids = np.array([*one(text), 2], "<u4")
        wanted[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == wanted


def test_token_files_round_trip(spark):
    one = library("word_bpe_49k.json")
    rows = token_files.round_trip(hard(spark), P.path("word_bpe_49k.json")).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(len(HARD)), 4])]
    start = 0
    for r in rows:
        assert r.start == start and list(r.ids) == [*one("no id" if r.doc_id is None else HARD[r.doc_id]), 2]
        start += len(r.ids)
    assert token_files.round_trip(hard(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_is_whole_and_tight(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionAll(hard(spark).select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = library("byte_bpe_50k.json")
    for doc_id, part in got.drop_duplicates(["doc_id", "piece"]).sort_values("piece").groupby("doc_id"):
        ids = np.array([*one(texts[doc_id]), 2], "<u4")
        assert part.length.sum() == len(ids) and (part.length.iloc[1:] == 1024).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    ordered = got.sort_values(["sequence_id", "offset"])
    assert set(got.doc_id) == set(texts)
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 1024 + 1


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "word " * 5000)], "doc_id long, text string")
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), capacity=64).collect()
    assert sum(r.length for r in got) == 2 + len(library("byte_bpe_50k.json")("word " * 5000)) + 1
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("sizes", [[1024] * 5, [1] * 3000, [700, 300, 24] * 10, list(range(1, 1025))])
def test_rounds_use_every_piece_once(spark, sizes):
    pieces = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
    placed, used = packing.place(spark, pieces)
    got = placed.join(pieces, "id").toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.id) == list(range(len(sizes)))
    inside = got.groupby("sequence_id")["size"]
    assert (inside.cumsum() - got["size"] == got.offset).all() and inside.sum().max() <= 1024
    assert got.sequence_id.nunique() <= -(-sum(sizes) // 1024) + 2 and got.sequence_id.max() < used


def plain_sweep(kinds):
    """Brackets by a stack: (gap, piece) pairs, open pieces, open gaps from the last."""
    stack, pairs, left = [], [], []
    for i, kind in enumerate(kinds):
        if kind == packing.GAP:
            stack.append(i)
        elif stack:
            pairs.append((stack.pop(), i))
        else:
            left.append(i)
    return pairs, left, stack[::-1]


def test_sweep_and_hand_over_are_one_stack():
    rng = np.random.default_rng(3)
    for _ in range(300):
        kinds = rng.integers(0, 2, rng.integers(0, 60))
        cuts = [0, *sorted(rng.integers(0, len(kinds) + 1, 3).tolist()), len(kinds)]
        pairs, counts, held = set(), {}, {}
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            gaps, pieces, open_pieces, open_gaps = packing.match(kinds[a:b])
            pairs |= set(zip((gaps + a).tolist(), (pieces + a).tolist()))
            for kind, rows in ((packing.PIECE, open_pieces), (packing.GAP, open_gaps)):
                held[kind, part] = (rows + a).tolist()
                if len(rows):
                    counts[part, kind] = len(rows)
        by_match = {}
        for kind, part, a, b, first in packing.hand_over(counts):
            for rank in range(a, b):
                by_match.setdefault(first + rank - a, {})[kind] = held[kind, part][rank]
        pairs |= {(m[packing.GAP], m[packing.PIECE]) for m in by_match.values()}
        assert pairs == set(plain_sweep(kinds)[0])


PAYLOADS = [b"", b"a" * 10, bytes(range(256)) * 9, np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"hello world " * 400, bytes([0, 255] * 3000), b"\x00" * 576]


def test_flac_round_trip_both_ways():
    padded = [flac.pad(p) for p in PAYLOADS]
    media = flac.encode_many(padded)
    assert flac.decode_many(media) == padded
    for stream, payload in zip(media, padded, strict=True):
        samples = flac.decode(stream)[:, 0]
        assert (samples.astype(np.int8).view(np.uint8) ^ 128).tobytes() == payload
        assert (flac.decode(stream, 100, 700)[:, 0] == samples[100:700]).all()


def test_flac_uses_linear_predictors():
    wave = (128 + 100 * np.sin(np.arange(5760) / 9) + 20 * np.sin(np.arange(5760) / 2.3)).astype(np.uint8).tobytes()
    stream = flac.encode_many([wave])[0]
    _, points, base = flac.metadata(stream)
    kinds = {stream[base + offset + 6] >> 1 for _, offset, _ in points}
    assert 32 | flac.ORDER - 1 in kinds and len(stream) < 0.6 * len(wave)
    assert flac.decode_many([stream]) == [wave] and ((flac.decode(stream)[:, 0] + 128).astype(np.uint8)).tobytes() == wave


def test_flac_detects_damage():
    stream = bytearray(flac.encode_many([flac.pad(PAYLOADS[2])])[0])
    stream[-30] ^= 1
    for reader in (lambda: flac.decode_many([bytes(stream)]), lambda: flac.decode(bytes(stream))):
        with pytest.raises(ValueError):
            reader()


def test_flac_linear_prediction_and_stereo():
    """A stream written here by hand: LPC of order two, two partitions, mid-side stereo."""
    bits: list[str] = []

    def put(value, n):
        bits.append(format(value & ((1 << n) - 1), f"0{n}b"))

    n = 192
    t = np.arange(n)
    left, right = (1000 * np.sin(t / 9)).astype(int), (900 * np.sin(t / 9 + 0.1)).astype(int)
    for value, size in ((0x7FFC, 15), (0, 1), (1, 4), (0, 4), (10, 4), (4, 3), (0, 1), (0, 8)):
        put(value, size)
    put(flac.crc8(int("".join(bits), 2).to_bytes(5, "big")), 8)
    for samples, depth in (((left + right) >> 1, 16), (left - right, 17)):
        put(0, 1), put(33, 6), put(0, 1)
        put(int(samples[0]), depth), put(int(samples[1]), depth)
        put(5 - 1, 4), put(2, 5), put(7, 5), put(-4, 5)  # precision 5, shift 2, coefficients 7/4 and -1
        put(0, 2), put(1, 4)
        rest = [int(samples[i]) - ((7 * int(samples[i - 1]) - 4 * int(samples[i - 2])) >> 2) for i in range(2, n)]
        for part, values in enumerate((rest[: n // 2 - 2], rest[n // 2 - 2 :])):
            k = 5 + part
            put(k, 4)
            for r in values:
                z = r << 1 if r >= 0 else (-r << 1) - 1
                bits.append("0" * (z >> k) + "1")
                put(z, k)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    frame = int(text, 2).to_bytes(len(text) // 8, "big")
    frame += flac.crc16(frame).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8, "big") + bytes(16)
    out = flac.decode(b"fLaC\x80\x00\x00\x22" + info + frame)
    assert (out[:, 0] == left).all() and (out[:, 1] == right).all()


def test_flac_columns(spark):
    rows = [(i, p, "x") for i, p in enumerate([None, *PAYLOADS, PAYLOADS[1]])]
    df = spark.createDataFrame(rows, "id long, payload binary, media string")
    media = flac.encode_column(df, "id", "payload")
    got = {r.id: r for r in flac.decode_column(media).collect()}
    assert all(bytes(got[i].payload) == flac.pad(p or b"") and got[i].n_bytes == len(p or b"") for i, p, _ in rows)
    assert bytes(got[2].media) == bytes(got[len(rows) - 1].media)
    blocks = flac.pcm_blocks(media.where("id = 4"), 1000).orderBy("block").collect()
    pcm = b"".join(bytes(b.pcm) for b in blocks)
    assert (np.frombuffer(pcm, np.uint8) ^ 128).tobytes() == flac.pad(PAYLOADS[3]) and [b.first_sample for b in blocks] == list(range(0, len(pcm), 1000))
    assert flac.encode_column(df.limit(0), "id", "payload").count() == 0


def test_op9_on_whole_documents(spark, data):
    texts = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id").text
    rows = flac.query(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts.index)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = flac.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


PAGES = [(1, "u1", b"aa"), (2, "u\n2", b"aa"), (None, None, b"aa"), (3, "u", None), (4, "", b""), (1, "u1", b"aa"), (5, "z", b"\r\n\r\nx" * 50000)]


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_round_trip_and_pushdown(spark, compressed):
    folder = common.new_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(PAGES, "id long, url string, payload binary"), folder, compressed, file_bytes=100)
    back = warc.read_warc(spark, folder)
    rows = {r.record_id.rsplit(":", 1)[1]: r for r in back.collect()}
    assert back.count() == len(PAGES) and rows["2"].record_type == "revisit" and rows["2"].refers_to.endswith(":1") and rows["null"].refers_to.endswith(":1")
    assert rows["4"].refers_to.endswith(":3") and bytes(rows["5"].payload) == PAGES[-1][2] and rows["2"].payload_bytes == 2
    assert rows["1"].payload_digest == warc.base32(hashlib.sha1(b"aa").digest())
    only = back.where("record_type = 'revisit' and payload_bytes = 2")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert only.count() == 2 and "record_type = revisit" not in plan.replace("#", "").split("Filter")[-1].split("\n")[0]
    bare = warc.read_warc(spark, folder, payload=False).where("record_id in ('urn:geoloom:page:5')").first()
    assert bare.payload is None and bare.payload_bytes == len(PAGES[-1][2])


def test_warc_of_others(spark, tmp_path):
    import gzip

    plain = b"".join(warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x:{i}>", "Content-Type": "text/plain"}, b"%d" % i * 9000 * i) for i in range(4))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:y:{i}>"}, b"%d" % i * 9000 * i)) for i in range(4)))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert {(r.record_id, len(r.payload)) for r in rows} == {(f"urn:{k}:{i}", 9000 * i) for k in "xy" for i in range(4)}
    bad = warc.record({"WARC-Type": "resource", "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"zz")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.warc").write_bytes(bad)
    with pytest.raises(Exception, match="payload digest"):
        warc.read_warc(spark, f"file://{tmp_path}/c").collect()


def test_warc_of_nothing(spark):
    folder = common.new_folder(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], "id long, url string, payload binary"), folder) == 0
    assert warc.read_warc(spark, folder).count() == 0


def test_op1_equals_brute_force(spark, data):
    pages = pd.read_parquet(f"{data}/pages.parquet")
    digest = {i: warc.base32(hashlib.sha1((h or "").encode()).digest()) for i, h in zip(pages.page_id, pages.html, strict=True)}
    head: dict = {}
    for i in sorted(digest):
        head.setdefault(digest[i], i)
    sizes = {i: len((h or "").encode()) for i, h in zip(pages.page_id, pages.html, strict=True)}
    for r in warc.query(spark, data).collect():
        first = head[digest[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (sizes[r.page_id], digest[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
