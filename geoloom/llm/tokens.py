"""Encoding of whole texts with the ``tokenizers`` library, chunk by chunk.

The vocabularies used here never join characters across a change from non-space
to space, or from a letter to a sign, so a text's ids are the ids of its chunks in
order.  Chunks are cut on
the bytes of an Arrow column, numbered by Arrow's dictionary encoding, and put
together again by array lookups; only chunks not met before become Python objects,
which the library encodes in groups.  A worker keeps the ids of ``CACHE`` chunks,
as Arrow and numpy arrays, and when these are full those met most often (the result
is the same with any size).
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np

from .common import give_back

CACHE = 1_000_000
JOIN = 256
GROUP = 12_000_000
AT_ONCE = 1 << 18

def _bytes_in(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars.encode("latin-1"), np.uint8)] = True
    return table


_SPACE = _bytes_in(" \t\n\v\f\r")
#: Signs that never share a match with a letter before them; no apostrophe (contractions) and none of ``<|>`` (special strings).
_SIGN = _bytes_in("!\"#$%&()*+,-./:;=?@[]^_`{}~\\")
_LETTER = _bytes_in("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: White space beyond ASCII, in UTF-8.
_WIDE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_WIDE_LAST = np.zeros(256, dtype=bool)
_WIDE_LAST[[c[-1] for c in _WIDE]] = True
_WIDE_BEFORE = np.zeros(256, dtype=bool)
_WIDE_BEFORE[[c[-2] for c in _WIDE]] = True
#: 1 for a space, 2 for a sign; ``bytes.translate`` needs no array of indices.
_CLASS = (_SPACE * np.uint8(1) + _SIGN * np.uint8(2)).tobytes()


#: A space and letters, of the same letters.
PLAIN = r"\A (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\z"


#: A normalizer that leaves of plain chunks what lower-casing does.
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def chunk_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where chunks start in UTF-8 bytes.

    At ``firsts``, at an ASCII space after a non-space, and at a sign after a
    letter (ASCII, or U+00C0 to U+00FF without the two signs among them).
    """
    start = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        classes = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
        space, sign = classes == 1, np.flatnonzero(classes[1:] == 2) + 1
        np.logical_and(space[1:], ~space[:-1], out=start[1:])
        last, before = data[sign - 1], data[np.maximum(sign - 2, 0)]
        accented = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        start[sign[_LETTER[last] | accented]] = True
        after = np.flatnonzero(start & space)
        after = after[_WIDE_LAST[data[after - 1]] & (after > 1)]
        after = after[_WIDE_BEFORE[data[after - 2]]]
        for place in after.tolist():
            if data[max(0, place - 3) : place].tobytes().endswith(_WIDE):
                start[place] = False
    start[firsts[firsts < len(data)]] = True
    return np.flatnonzero(start)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column (null: empty) and the offsets of its rows."""
    import pyarrow as pa

    flat = column.fill_null("").cast(pa.large_binary())
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = flat.buffers()
    offsets = np.frombuffer(places, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` bytes, of one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, n)
        start = stop


def number_chunks(data: np.ndarray, offsets: np.ndarray):
    """(distinct chunks as an Arrow binary array, number of each chunk, chunks before each row)."""
    import pyarrow as pa

    starts = chunk_starts(data, offsets[:-1])
    ends = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, offsets)


def totals_before(counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of the first n counts for each n of ``places``."""
    totals = np.cumsum(counts)
    return np.where(places > 0, totals[places - 1], 0) if len(totals) else np.zeros(len(places), np.int64)


class Ragged:
    """Growing rows of numbers in one array; ``gather`` concatenates chosen rows."""

    def __init__(self, dtype=np.uint32):
        self._flat, self._first, self._count = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows = self._size = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array) // 2), array.dtype)])

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        """Append rows of ``counts`` numbers each, which follow each other in ``flat``."""
        n, size = self.rows + len(counts), self._size + len(flat)
        self._flat, self._first, self._count = self._room(self._flat, size), self._room(self._first, n), self._room(self._count, n)
        self._flat[self._size : size] = flat
        self._count[self.rows : n] = counts
        self._first[self.rows : n] = self._size + np.cumsum(counts) - counts
        self.rows, self._size = n, size

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self._count[rows]

    def select(self, rows: np.ndarray) -> Ragged:
        """Another store, of these rows."""
        out = Ragged(self._flat.dtype)
        out.extend(self.gather(rows), self._count[rows])
        return out

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of ``rows``, one row after the other; index arrays are made for ``AT_ONCE`` rows at a time."""
        out = np.empty(int(self._count[rows].sum()), self._flat.dtype)
        at = 0
        for a in range(0, len(rows), AT_ONCE):
            part = rows[a : a + AT_ONCE]
            counts = self._count[part]
            ends = np.cumsum(counts)
            index = np.repeat(self._first[part] - ends + counts, counts)
            index += np.arange(len(index))
            self._flat.take(index, out=out[at : at + len(index)])
            at += len(index)
        return out


class TextEncoder:
    """Ids of texts by the tokenizer file at ``path``, special strings as ordinary text."""

    _loaded: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = self._lowered = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        rules = json.loads(self._library.to_str())
        if rules["normalizer"] == LOWERING:  # does nothing but lower the letters of plain chunks
            self._lowered = Tokenizer.from_str(json.dumps(rules | {"normalizer": None}))
            self._lowered.encode_special_tokens = True
        self._forget()

    @classmethod
    def load(cls, path: str) -> TextEncoder:
        """The one encoder of this process for ``path``."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Keep only these rows, or none."""
        import pyarrow as pa

        if keep is None:
            self._known, self._ids, self._met = pa.array([], pa.large_binary()), Ragged(), np.zeros(0, np.int32)
        else:
            self._known, self._ids, self._met = self._known.take(pa.array(keep)), self._ids.select(keep), self._met[keep]

    def _learn(self, new) -> None:
        """Ids of new chunks (an Arrow binary array).

        Words of letters after a space are one match each, so ``JOIN`` of them make
        one text and the library tells their tokens apart; it takes others as
        separate words.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(new, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        store = Ragged()
        words_alone = new.filter(plain)
        if self._lowered is not self._library:
            words_alone = pc.utf8_lower(words_alone.cast(pa.large_string()))
        for part, library, joins in ((words_alone, self._lowered, True), (new.filter(pc.invert(plain)), self._library, False)):
            for c in range(0, len(part), 64 * JOIN):
                some = part.slice(c, 64 * JOIN)
                cuts = [*range(0, len(some), JOIN), len(some)]
                if joins:  # the chunks lie joined in the array already
                    data, offsets = text_bytes(some)
                    texts = [data[a:b].tobytes().decode() for a, b in itertools.pairwise(offsets[cuts].tolist())]
                else:
                    words = [w.decode() for w in some.to_pylist()]
                    texts = [words[a:b] for a, b in itertools.pairwise(cuts)]
                found = library.encode_batch(texts, is_pretokenized=not joins, add_special_tokens=False)
                for one, n in zip(found, np.diff(cuts).tolist(), strict=True):
                    store.extend(np.array(one.ids, dtype=np.uint32), np.bincount(np.array(one.word_ids, dtype=np.int64), minlength=n))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self._ids.extend(store.gather(place), store.counts(place))
        self._known = pa.concat_arrays([self._known, new])
        self._met = np.concatenate([self._met, np.zeros(len(new), np.int32)])

    def _find(self, distinct) -> np.ndarray:
        """Rows of distinct chunks, -1 for those not known; the table that is built is of the fewer distinct chunks."""
        import pyarrow.compute as pc

        rows = np.full(len(distinct), -1, np.int64)
        at = pc.index_in(self._known, value_set=distinct)
        known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        rows[at.drop_null().to_numpy()] = known
        return rows

    def rows_of(self, distinct) -> np.ndarray:
        """Rows of the id store that hold the ids of distinct chunks (an Arrow binary array)."""
        rows = self._find(distinct)
        missing = rows < 0
        new = int(missing.sum())
        if new and len(self._known) + new > CACHE:
            self._met[rows[~missing]] += 1
            again = np.flatnonzero(self._met > 1)
            self._forget(np.sort(again[np.argsort(-self._met[again], kind="stable")[: CACHE // 2]]))
            rows = self._find(distinct)
            missing = rows < 0
            new = int(missing.sum())
        if new:
            import pyarrow as pa

            rows = np.where(missing, len(self._known) - 1 + np.cumsum(missing), rows)
            self._learn(distinct.filter(pa.array(missing)))
        self._met[rows] += 1
        return rows

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all rows, offsets of each row's ids); ``end`` follows each row if given."""
        distinct, numbers, before = number_chunks(data, offsets)
        rows = self.rows_of(distinct)[numbers] if len(numbers) else np.zeros(0, np.int64)
        sizes = totals_before(self._ids.counts(rows), before)
        ids = self._ids.gather(rows)
        if end is None:
            return ids, sizes
        inside = np.ones(len(ids) + len(offsets) - 1, dtype=bool)
        inside[sizes[1:] + np.arange(len(offsets) - 1)] = False
        out = np.full(len(inside), end, dtype=np.uint32)
        out[inside] = ids
        return out, sizes + np.arange(len(offsets))

    def encode_column(self, column, end: int | None = None, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, offsets) of groups of rows of an Arrow string column (null: empty)."""
        data, offsets = text_bytes(column)
        for a, b in row_groups(offsets, limit):
            own = offsets[a : b + 1]
            yield a, b, *self.encode_flat(data[own[0] : own[-1]], own - own[0], end)
            give_back()

    def encode(self, texts: list, end: int | None = None) -> list[np.ndarray]:
        """uint32 ids of each text (null: empty), with ``end`` appended if given."""
        import pyarrow as pa

        out: list[np.ndarray] = []
        for _, _, ids, offsets in self.encode_column(pa.array(texts, pa.string()), end):
            out += np.split(ids, offsets[1:-1])
        return out
