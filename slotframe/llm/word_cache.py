"""Words of a batch of texts, each distinct one once, and a bounded memory of what they encode to.

A batch is cut without copying its bytes: a unit is a text's head, up to its first cut, or what follows from one cut to
the next. Arrow finds the distinct units, so that Python sees each of them once a batch, and numpy lays the ids out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Words of one generation; a worker holds two at most, some 250 MB.
GENERATION = 600_000
#: A longer unit, as a text without cuts, isn't remembered.
LONG = 256
#: Texts are cut in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 4 << 20


class WordCache:
    """Two generations: words that are used move to the young one, and the old one is forgotten when that is full."""

    def __init__(self, generation: int = GENERATION) -> None:
        self.generation = generation
        self.known: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def encode(self, units: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """What each of the distinct units encodes to; ``learn`` is asked for those that aren't remembered."""
        if len(self.known) > self.generation:
            self._old, self.known = self.known, {}
        found: list[bytes | None] = list(map(self.known.get, units))
        gaps = [i for i, x in enumerate(found) if x is None]
        if self._old:
            for i in gaps:
                if (x := self._old.get(units[i])) is not None:
                    found[i] = self.known[units[i]] = x
            gaps = [i for i in gaps if found[i] is None]
        new = [units[i] for i in gaps]
        for i, u, x in zip(gaps, new, learn(new) if new else []):
            found[i] = x
            if len(u) < LONG:
                self.known[u] = x
        return found  # type: ignore[return-value]


def runs(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts of ``text``, about RUN_BYTES at a time; null is empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def gather(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, encode: Callable[[list[bytes]], list[bytes]], end: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and the number of ids of each text with ``end`` after it.

    ``cuts``: ascending positions in ``data`` where a text is cut. ``encode`` gives the packed ids of distinct units.
    """
    n = len(offsets) - 1
    before = np.searchsorted(cuts, offsets[:-1])
    bounds = np.append(np.insert(cuts, before, offsets[:-1]), len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    packed = [*encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
    flat, width = np.frombuffer(b"".join(packed), kind), np.dtype(kind).itemsize
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // width
    begin = np.cumsum(size) - size
    last = np.append(before[1:] + np.arange(1, n), len(units)) if n else np.zeros(0, np.int64)
    which = np.insert(coded.indices.to_numpy().astype(np.int64), last, len(packed) - 1)
    length = size[which]
    upto = np.cumsum(length)
    ids = flat[np.repeat(begin[which] - upto + length, length) + np.arange(int(upto[-1]) if n else 0)]
    return ids, np.diff(upto[last + np.arange(n)], prepend=0)
