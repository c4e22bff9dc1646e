"""What encoding and coding of token ids may take besides their results."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from geoloom.llm import range_coder, tokens


def test_model_works_out_its_table_in_place():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 30_000, 60_000)
    model = range_coder.Model(15)
    tracemalloc.start()
    try:
        model.learn(np.roll(ids, 2), np.roll(ids, 1), ids)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows, width = model.table.shape
    assert rows == range_coder.CLASSES and (model.table[:, 0] == 0).all() and (model.table[:, -1] == 1 << range_coder.MIXED).all()
    assert (np.diff(model.table, axis=1) > 0).all()
    assert most < 30 * rows * width


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_known_chunks_do_not_become_a_lookup_table_again(name, monkeypatch):
    """A batch looks the known chunks up among its own, which are fewer; ids are the library's, also when the cache is cut."""
    import pyarrow.compute as pc

    sizes, plain = [], pc.index_in

    def index_in(values, *args, value_set, **options):
        sizes.append(len(value_set))
        return plain(values, *args, value_set=value_set, **options)

    monkeypatch.setattr(pc, "index_in", index_in)
    monkeypatch.setattr(tokens, "CACHE", 300)
    encoder = tokens.TextEncoder(public_tokenizers.path(name))
    odd = [None, "", " Ärger×à l'été 's", "a  b", "x Ã ×y <|endoftext|>", " \x85 q", " Abc\n", "\n Abc", "中 İß \x00"]
    for k in range(8):
        texts = odd + [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40 * k, 40 * k + 60))]
        found = encoder.encode(texts, 2)
        for text, ids in zip(texts, found, strict=True):
            assert ids.tolist() == [*encoder._library.encode(text or "", add_special_tokens=False).ids, 2]
        data, offsets = tokens.text_bytes(pa.array(texts, pa.string()))
        assert sizes[-1] <= len(tokens.chunk_starts(data, offsets[:-1]))
    assert len(encoder._known) <= 300
