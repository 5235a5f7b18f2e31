"""Byte-level BPE of many texts at once, through a table of known chunks.

The ids are those of the tokenizers library with ``add_special_tokens=False``
and its other defaults, so a special token's string in a text is that token.

*Why chunks may be encoded alone.* The library first cuts a text at special
tokens, then into matches of the byte-level pattern, and encodes each match on
its own. Three kinds of places start a new match in any context: one with a
non-space on its left and white space on its right (no alternative of the
pattern goes from the one to the other); one with an ASCII letter on its left
and one of ``.,;:!?`` on its right (no match holds both); and one between a lone
newline and a non-space. What follows white space decides how it is cut, and
stands in the same chunk. Places beside white space beyond ASCII are not used.
A special token's string has no such place inside (checked when the table is
made), so it lies in one chunk, and the library cuts the chunk there as it
would the text. A tokenizer for which this does not hold (another normaliser or
pre-tokenizer, special tokens that strip or need word borders) gets whole
texts, as ``encode_whole`` does for any.

Chunk borders, chunk hashes (from one prefix sum), look-ups and the gathering
of ids are array operations over spans of SPAN bytes; only chunks not in the
table go to the library. A look-up is confirmed on the chunk's bytes, so a hash
collision cannot give wrong ids. The table holds chunks of at most LONG_CHUNK
bytes, ``most`` entries and ``most_bytes`` bytes of text and ids (and what one span
adds); beyond that the entries used least are dropped. Its slots double before
they are three quarters full, so a free one is always found.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from tidemark.llm.shingles import mix, power_table

SLOTS_BITS, MOST, MOST_BYTES = 18, 1_000_000, 64 << 20
SPAN, LONG_CHUNK = 1 << 19, 64
LATIN = "ɐ"
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
MARK, LETTER = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow U+0100 in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


ALPHABET = _alphabet()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i]+1, ... of every i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def odd_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bytes of white space beyond ASCII, or of the separators 1C to 1F, may stand, and where they end."""
    ahead = lambda i, k: data[np.minimum(i + k, len(data) - 1)]
    one = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
    c2 = np.flatnonzero(data == 0xC2)
    c2 = c2[np.isin(ahead(c2, 1), (0x85, 0xA0))]
    e1 = np.flatnonzero(data == 0xE1)
    e1 = e1[ahead(e1, 1) == 0x9A]
    e2 = np.flatnonzero(data == 0xE2)
    second, third = ahead(e2, 1), ahead(e2, 2)
    e2 = e2[((second == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))) | (second == 0x81)]
    e3 = np.flatnonzero(data == 0xE3)
    e3 = e3[(ahead(e3, 1) == 0x80) & (ahead(e3, 2) == 0x80)]
    return np.concatenate((one, c2, e1, e2, e3)), np.concatenate((one + 1, c2 + 2, e1 + 3, e2 + 3, e3 + 3))


def borders(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first places of all chunks of the texts data[starts[i]:starts[i+1]], in order."""
    white = WHITE[data]
    border = white.copy()
    border[1:] &= ~white[:-1]
    border[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
    lone = np.flatnonzero(border & (data == 10))
    border[lone[(lone + 1 < len(data)) & ~white[np.minimum(lone + 1, len(data) - 1)]] + 1] = True
    for odd in odd_places(data):
        border[odd[odd < len(data)]] = False
    border[starts[:-1][starts[:-1] < len(data)]] = True
    return np.flatnonzero(border)


class ChunkTable:
    """A tokenizer of the tokenizers library behind the table."""

    def __init__(self, path: str, most: int = MOST, bits: int = SLOTS_BITS, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.by_chunks = self._cuts_hold(json.load(file))
        self.most, self.start_bits, self.most_bytes = most, bits, most_bytes
        self._clear()

    @staticmethod
    def _cuts_hold(described: dict) -> bool:
        """Whether chunks may be encoded alone with this tokenizer; see the module."""
        cut = described.get("pre_tokenizer") or {}
        byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in described.get("added_tokens", []))
        names = [np.frombuffer(t["content"].encode(), np.uint8) for t in described.get("added_tokens", [])]
        solid = all(len(n) and len(borders(n, np.array([0, len(n)]))) == 1 and not WHITE[n].any() for n in names)
        return bool(byte_level and plain and solid and not described.get("normalizer") and not described.get("truncation") and not described.get("padding"))

    def _clear(self) -> None:
        self.bits = self.start_bits
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.count = 0
        self.hits = np.zeros(1, np.int64)
        self.ids, self.id_ends = np.zeros(1, np.uint32), np.zeros(1, np.int64)
        self.text, self.text_ends = np.zeros(1, np.uint8), np.zeros(1, np.int64)

    def _room(self, name: str, size: int) -> np.ndarray:
        """The array ``name`` with room for ``size`` values; it grows by doubling."""
        held = getattr(self, name)
        if len(held) < size:
            held = np.concatenate((held, np.zeros(max(size, 2 * len(held)) - len(held), held.dtype)))
            setattr(self, name, held)
        return held

    # ---- the table ----

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(todo):
            there = self.keys[slot]
            same = there == keys[todo]
            out[todo[same]] = self.entry[slot[same]]
            go = ~same & (there != 0)
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def _place(self, keys: np.ndarray, first: int) -> None:
        """Puts new, distinct keys into free slots as entries first, first+1, ..."""
        todo, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(todo):
            free = self.keys[slot] == 0
            _, won = np.unique(slot[free], return_index=True)
            winners = np.flatnonzero(free)[won]
            self.keys[slot[winners]] = keys[todo[winners]]
            self.entry[slot[winners]] = first + todo[winners]
            rest = np.ones(len(todo), bool)
            rest[winners] = False
            todo, slot = todo[rest], slot[rest]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & mask, slot)

    def _grow(self, more: int) -> None:
        """Doubles the slots until ``more`` further keys leave a quarter of them free."""
        if 4 * (self.count + more) <= 3 << self.bits:
            return
        filled = np.flatnonzero(self.keys)
        keys = np.zeros(self.count, np.uint64)
        keys[self.entry[filled]] = self.keys[filled]
        while 4 * (self.count + more) > 3 << self.bits:
            self.bits += 1
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self._place(keys, 0)

    def add(self, keys: np.ndarray, chunks: list[bytes], ids: list[bytes]) -> None:
        self._grow(len(keys))
        first, last = self.count, self.count + len(keys)
        self._place(keys, first)
        self._room("hits", last)[first:last] = 0
        for values, ends, new, width, kind in (("ids", "id_ends", ids, 4, "<u4"), ("text", "text_ends", chunks, 1, np.uint8)):
            before = int(getattr(self, ends)[first])
            to = before + np.cumsum([len(x) // width for x in new])
            self._room(ends, last + 1)[first + 1 : last + 1] = to
            self._room(values, int(to[-1]))[before : to[-1]] = np.frombuffer(b"".join(new), kind)
        self.count = last

    def _bytes(self) -> int:
        return int(4 * self.id_ends[self.count] + self.text_ends[self.count])

    def shrink(self) -> None:
        """Keeps the entries used most (twice at least), half of the entries and bytes allowed at most."""
        used = self.hits[: self.count]
        keep = np.argsort(-used, kind="stable")[: self.most // 2]
        held = np.cumsum(4 * (self.id_ends[keep + 1] - self.id_ends[keep]) + self.text_ends[keep + 1] - self.text_ends[keep])
        keep = keep[(used[keep] >= 2) & (held <= self.most_bytes // 2)]
        filled = np.flatnonzero(self.keys)
        key_of = np.zeros(self.count, np.uint64)
        key_of[self.entry[filled]] = self.keys[filled]
        sizes, texts = (ends[keep + 1] - ends[keep] for ends in (self.id_ends, self.text_ends))
        ids, text, hits = self.ids[ragged(self.id_ends[keep], sizes)], self.text[ragged(self.text_ends[keep], texts)], used[keep] // 2
        self._clear()
        self._grow(len(keep))
        self._place(key_of[keep], 0)
        self.count, self.hits, self.ids, self.text = len(keep), hits, ids, text
        self.id_ends, self.text_ends = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(texts)))

    # ---- encoding ----

    def _match(self, mapped: str) -> bytes:
        """The ids of one match of the pattern, given in the byte-level alphabet."""
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def chunk_ids(self, chunk: bytes) -> bytes:
        """A chunk's ids. Latin letters, with a space before them or not, are one match of the pattern; other chunks take the whole encoder."""
        text = chunk.decode("utf-8", "replace")
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            head = "Ġ" if word is not text else ""
            if word.isascii():
                return self._match(head + word)
            if max(word) < LATIN:
                return self._match(head + word.encode().decode("latin-1").translate(ALPHABET))
        return self._whole(text)

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of whole texts."""
        return [list(array("I", self._whole(t))) for t in texts]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text) of the texts data[starts[i]:starts[i+1]]."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
        if not self.by_chunks:
            each = [np.frombuffer(self._whole(data[a:b].tobytes().decode("utf-8", "replace")), "<u4") for a, b in zip(starts[:-1], starts[1:], strict=True)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        low = borders(data, starts)
        parts, counts = [], np.empty(len(low), np.int64)
        first = 0
        while first < len(low):
            last = max(first + 1, int(np.searchsorted(low, low[first] + SPAN)))
            end = int(low[last]) if last < len(low) else len(data)
            ids, counts[first:last] = self._span(data[low[first] : end], low[first:last] - low[first])
            parts.append(ids)
            first = last
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(low, starts)]
        return np.concatenate(parts), np.diff(ends)

    def _span(self, data: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each chunk) of the chunks that begin at ``low``."""
        lengths = np.diff(np.append(low, len(data)))
        up, down = power_table(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        keys = mix((total[low + lengths] - total[low]) * down[low])
        keys[keys == 0] = 1
        entry = np.where(lengths > LONG_CHUNK, -2, self.find(keys))
        missing = np.flatnonzero(entry == -1)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            chunks = [data[a : a + n].tobytes() for a, n in zip(low[at].tolist(), lengths[at].tolist(), strict=True)]
            base = self.count
            self.add(new, chunks, list(map(self.chunk_ids, chunks)))
            entry[missing] = base + back
        held = np.flatnonzero(entry >= 0)
        same = lengths[held] == self.text_ends[entry[held] + 1] - self.text_ends[entry[held]]
        entry[held[~same]] = -2
        held = held[same]
        differs = self.text[ragged(self.text_ends[entry[held]], lengths[held])] != data[ragged(low[held], lengths[held])]
        if differs.any():
            entry[held[np.searchsorted(np.cumsum(lengths[held]), np.flatnonzero(differs), side="right")]] = -2
        held = np.flatnonzero(entry >= 0)
        self.hits[: self.count] += np.bincount(entry[held], minlength=self.count)
        counts = np.zeros(len(low), np.int64)
        counts[held] = self.id_ends[entry[held] + 1] - self.id_ends[entry[held]]
        alone = {i: np.frombuffer(self.chunk_ids(data[low[i] : low[i] + lengths[i]].tobytes()), "<u4") for i in np.flatnonzero(entry == -2).tolist()}
        for i, ids in alone.items():
            counts[i] = len(ids)
        out, at = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        out[ragged(at[held], counts[held])] = self.ids[ragged(self.id_ends[entry[held]], counts[held])]
        for i, ids in alone.items():
            out[at[i] : at[i] + len(ids)] = ids
        if self.count > self.most or self._bytes() > self.most_bytes:
            self.shrink()
        return out, counts


_made: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """One table for each worker."""
    if path not in _made:
        _made[path] = ChunkTable(path)
    return _made[path]
