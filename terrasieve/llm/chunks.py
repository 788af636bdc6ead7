"""Encode whole texts through a cache of their words.

Byte-level BPE patterns give a space to the word after it, so a text may be cut
before any space that has a non-space on at least one side: no match of the
pattern spans such a cut. Nor does one span the place between letters and one full
stop or comma at the end of what lies between spaces. Arrow splits a batch and
numbers its distinct words; each worker encodes a word once while it stays in its
cache; numpy puts the ids together. Texts where white space stands on both sides
of a space are encoded whole. A line end between non-spaces begins a word of its
own kind, which has no space before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Single characters that may end a word.
ENDS = (".", ",")
EMPTY, IRREGULAR = 0, -1


def gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ids[start : start + length], end to end."""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((start - (ends - length)).astype(np.int32), length)
    at += np.arange(total, dtype=np.int32)
    return ids[at]


def regular(word: str) -> bool:
    """If what follows the space, or the line end in its place, is no white space."""
    return bool(word) and (not word[0].isspace() or word[0] == "\n" and len(word) > 1 and not word[1].isspace())


class Pool:
    """Ids of words end to end; a word is the number of its entry. Entries 0 to 2 are nothing, a full stop and a comma."""

    def __init__(self, ends: list[np.ndarray]):
        self.entry: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.add([], np.concatenate(ends), np.array([0, *map(len, ends)]))

    def add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Appends entries for words whose ids lie end to end."""
        first = len(self.length)
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(length) - length).astype(np.int32)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        self.entry.update(zip(words, range(first, len(self.length))))


class ChunkCache:
    """``encode_words`` maps words, each led by a space or a line end, to their ids end to end and the length of each; ``encode_text`` any text to ids.

    Two generations of ``limit`` words are kept, and texts of ``batch_bytes`` are put through at once.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_text: Callable[[str], np.ndarray], limit: int = 150_000, batch_bytes: int = 4 << 20):
        self.encode_words, self.encode_text, self.limit, self.batch_bytes = encode_words, encode_text, limit, batch_bytes
        self.ends = [encode_text(x) for x in ENDS]
        self.new, self.old = Pool(self.ends), Pool(self.ends)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of each text of a string array; null as empty."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + self.batch_bytes)))
            yield from self._some(texts.slice(a, b - a))
            a = b

    def _some(self, texts: pa.Array) -> list[bytes]:
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        flat = pieces.flatten()
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts
        coded = flat.dictionary_encode()
        which, chunks = coded.indices.to_numpy(), coded.dictionary
        # of each distinct chunk: its word, and the full stop or comma that may end it
        word = pc.utf8_rtrim(chunks, "".join(ENDS))
        cut = pc.subtract(pc.binary_length(chunks), pc.binary_length(word)).to_numpy(zero_copy_only=False)
        plain = (cut == 1) & pc.utf8_is_alpha(pc.utf8_ltrim(word, "\n")).to_numpy(zero_copy_only=False)
        end = np.where(plain, np.where(pc.ends_with(chunks, ENDS[0]).to_numpy(zero_copy_only=False), 1, 2), EMPTY)
        words = pc.if_else(pa.array(plain), word, chunks).dictionary_encode()
        entry = self._entries(words.dictionary.to_pylist())[words.indices.to_numpy()]
        odd = entry == IRREGULAR
        pair = np.stack([np.where(odd, EMPTY, entry), end], 1).reshape(-1)
        size = self.new.length[pair]
        ids, length = gathered(self.new.ids, self.new.start[pair], size), size.reshape(-1, 2).sum(1, dtype=np.int32)
        start = (np.cumsum(length) - length).astype(np.int32)
        # of each chunk of the texts; a text's first has no space before it
        lengths = length[which]
        lengths[first] = 0
        packed = gathered(ids, start[which], lengths).astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.add.reduceat(lengths, first, dtype=np.int64))).tolist()]
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, head in enumerate(flat.take(pa.array(first)).to_pylist()):
            if head:
                out[i] = self.encode_text(head).astype("<u4").tobytes() + out[i]
        if odd.any():
            hit = odd[which]
            hit[first] = False
            for i in np.flatnonzero(np.logical_or.reduceat(hit, first)).tolist():
                out[i] = self.encode_text(texts[i].as_py()).astype("<u4").tobytes()
        if len(self.new.entry) > self.limit:
            self.old, self.new = self.new, Pool(self.ends)
        return out

    def _entries(self, words: list[str]) -> np.ndarray:
        """Entries of distinct words, encoding those that neither generation has."""
        new, old = self.new, self.old
        missing = [w for w, e in zip(words, map(new.entry.get, words)) if e is None]
        before = list(map(old.entry.get, missing))
        kept = [(w, e) for w, e in zip(missing, before) if e is not None and e != IRREGULAR]
        if kept:
            at = np.array([e for _, e in kept])
            new.add([w for w, _ in kept], gathered(old.ids, old.start[at], old.length[at]), old.length[at])
        unknown = [w for w, e in zip(missing, before) if e is None or e == IRREGULAR]
        fresh = [w for w in unknown if regular(w)]
        if fresh:
            new.add(fresh, *self.encode_words([w if w[0] == "\n" else " " + w for w in fresh]))
        if len(fresh) < len(unknown):
            new.entry.update((w, IRREGULAR) for w in unknown if not regular(w))
        return np.array(list(map(new.entry.get, words)), np.int64)
