"""Words of texts as numbers, worked out once for each distinct word that a worker meets.

Texts are cut on bytes: a table maps every byte to itself, to another or to a blank,
and words are what blanks part.  UTF-8 keeps characters past ASCII in bytes of 128
and more, which no table here touches, so this equals cutting by characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of a text cut into Python objects at once.
PIECE = 1 << 20
#: Distinct words a worker remembers.
MEMORY = 1 << 19

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: Lower-case ASCII letters and digits and all that is not ASCII; the rest parts words.
ALNUM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(text: bytes, table: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text after ``table``, in pieces that end between words."""
    start = 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            # the byte after the piece must be a blank, or the piece grows
            while stop < len(text) and table[text[stop]] != 0x20:
                stop += 1
        yield text[start:stop].translate(table)
        start = stop


class Numbers(dict):
    """A number for each word by ``of``, remembered for at most ``MEMORY`` words."""

    def __init__(self, of: Callable[[bytes], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> int:
        value = self.of(word)
        if len(self) < MEMORY:
            self[word] = value
        return value

    def values_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_values(texts: list[bytes | None], table: bytes, numbers: Numbers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, words of each, their numbers) of runs of consecutive texts; ``last`` is excluded.

    A run is closed at about ``PIECE`` bytes; a longer text is a run of its own, of
    which only the numbers are held as a whole.
    """
    start, size, counts, held, words = 0, 0, [], [], []
    for i, text in enumerate(texts):
        n = 0
        for piece in pieces(text or b"", table):
            own = piece.split()
            n += len(own)
            words += own
            if len(piece) >= PIECE:
                held.append(numbers.values_of(words))
                words = []
        counts.append(n)
        size += len(text or b"")
        if size >= PIECE or i == len(texts) - 1:
            held.append(numbers.values_of(words))
            yield start, i + 1, np.array(counts, np.int64), np.concatenate(held)
            start, size, counts, held, words = i + 1, 0, [], [], []
