"""Token ids by the tokenizers library, one table lookup for each word that was met before.

The byte-level pattern always ends a token at certain places, whatever stands around them: before a single
space between visible characters, on both sides of a single newline between such, and between a letter
and a full stop or comma at a word's end. A text cut there gives segments that the library encodes alike
alone and in place, so a segment's ids are kept the first time it is met. Segments are found, looked up
and joined as arrays; their bytes are the key, so a lookup is exact. Texts with the string of a special
token, or with letters beyond those the cuts were made for, go to the library whole, and so do all texts
of a vocabulary with another pre-tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .windows import MIX, mixed

#: Segments kept per Python worker. A full table is emptied and filled anew: it bounds memory only.
CACHE_ENTRIES = 2_000_000
#: Bytes of texts in one pass of arrays, and segments of one call of the library.
PASS_BYTES, CALL_WORDS = 1 << 20, 10_000
#: Bytes of a segment that fit its key; the key's last byte is the length.
KEY_BYTES = 15

_KEPT: dict[tuple, object] = {}


def kept_for_worker(kind, spec: str):
    """One ``kind(spec)`` for all tasks of a Python worker, so that its caches outlive a task."""
    key = (kind.__name__, hash(spec))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = kind(spec)
    return _KEPT[key]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes take the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def forget() -> None:
    """Drop what ``kept_for_worker`` keeps: other operators' tasks need the worker's memory."""
    _KEPT.clear()


def is_byte_level(model: dict) -> bool:
    """Whether a tokenizer file cuts words by the byte-level pattern, with nothing before or added."""
    pre = model.get("pre_tokenizer") or {}
    return model.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


class _Table:
    """Ids by segment: open addressing over exact keys of two words, in arrays."""

    def __init__(self):
        self.slots = np.full(1 << 16, -1, dtype=np.int32)
        self.keys = np.zeros((1 << 14, 2), dtype=np.uint64)
        self.ends = np.zeros((1 << 14) + 1, dtype=np.int64)  # where each segment's ids end in the pool
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.n = 0
        self.long: dict[bytes, int] = {}  # segments that don't fit a key

    def _slot(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        return (mixed(mixed(k0 * MIX[0]) + k1 * MIX[1]) >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The number of each key's segment, or -1."""
        slot = self._slot(k0, k1)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & ((self.keys[out, 0] != k0) | (self.keys[out, 1] != k1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = at = self.slots[slot[todo]]
            todo = todo[(at >= 0) & ((self.keys[at, 0] != k0[todo]) | (self.keys[at, 1] != k1[todo]))]
        return out

    def _place(self, todo: np.ndarray) -> None:
        todo = todo.astype(np.int32)
        slot = self._slot(self.keys[todo, 0], self.keys[todo, 1])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several for one slot, one stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> int:
        """New segments behind the others; returns the first one's number."""
        first, n = self.n, self.n + len(keys)
        while n > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.ends = np.concatenate([self.ends, np.zeros(len(self.keys) // 2, dtype=np.int64)])
        base = int(self.ends[first])
        while base + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.keys[first:n] = keys
        self.ends[first + 1 : n + 1] = base + np.cumsum(counts)
        self.pool[base : base + len(ids)] = ids
        self.n = n
        if n * 3 > len(self.slots) * 2:
            self.slots = np.full(len(self.slots) * 4, -1, dtype=np.int32)
            first = 0
        self._place(first + np.flatnonzero(self.keys[first:n, 1]))  # long segments have no key
        return n - len(keys)


def cut_segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments start in texts joined by zero bytes, and the bytes that no cut was made for."""
    visible = (data > 0x20) & (data != 0x7F)
    small = data | np.uint8(0x20)
    letter = ((small >= 0x61) & (small <= 0x7A)) | (data >= 0x80)
    before, behind = np.append(False, visible[:-1]), np.append(visible[1:], False)
    between = before & behind
    line = (data == 0x0A) & between
    cut = ((data == 0x20) & between) | line
    cut[1:] |= line[:-1]
    after = np.append(data[1:], np.uint8(0))
    mark = (data == 0x2E) | (data == 0x2C)
    cut |= mark & np.append(False, letter[:-1]) & ((after == 0x20) | (after == 0x0A) | (after == 0))
    # Two-byte letters from U+00C0 up to U+027F but for the signs U+00D7 and U+00F7; nothing else above ASCII.
    odd = (data >= 0xCA) | (data == 0xC2) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    return cut, odd


class CachedEncoder:
    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cuts = is_byte_level(json.loads(spec))
        vocab = self.tok.get_vocab()
        space = byte_letters()[0x20]
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that start with a space
        self.spaced[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.line = vocab.get(byte_letters()[0x0A], -1)
        self.limit = cache_entries
        self.table = _Table()

    def _library(self, held: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(held, add_special_tokens=False)]

    def _learned(self, new: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the segments, and their counts and ids in this order.

        Words go to the library many at once: those with a space start with it, others stand on lines.
        """
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, s in enumerate(new):
            spaced = s[:1] == b" "
            kinds[0 if spaced and s[1:].decode().isalpha() else 1 if not spaced and s.decode().isalpha() else 2].append(i)
        counts, ids = [], []
        for spaced, several in ((True, kinds[0]), (False, kinds[1])):
            for at in range(0, len(several), CALL_WORDS):
                part = several[at : at + CALL_WORDS]
                got = self._library([(b"" if spaced else b"\n").join([new[i] for i in part]).decode()])[0]
                if spaced:
                    starts = np.flatnonzero(self.spaced[got])
                else:
                    breaks = np.flatnonzero(got == self.line)
                    got, starts = np.delete(got, breaks), np.append(0, breaks - np.arange(len(breaks)))
                if len(starts) != len(part):
                    raise ValueError("the vocabulary doesn't start every word with its space, or every line anew")
                counts.append(np.diff(np.append(starts, len(got))))
                ids.append(got)
        rest = self._library([new[i].decode() for i in kinds[2]])
        counts.append(np.array([len(x) for x in rest], dtype=np.int64))
        return [*kinds[0], *kinds[1], *kinds[2]], np.concatenate(counts), np.concatenate([*ids, *rest])

    def _numbers(self, data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each segment in the table; unknown ones are learned first. ``data`` has spare bytes."""
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        raw = memoryview(data)
        short = size <= KEY_BYTES
        a, n = lo[short], size[short].astype(np.uint64)
        bits = np.minimum(n, 8) * np.uint64(8)
        k0 = eight[a] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        more = np.where(n > 8, n - np.minimum(n, 8), 0).astype(np.uint64) * np.uint64(8)
        k1 = np.where(n > 8, eight[a + 8] & ((np.uint64(1) << more) - np.uint64(1)), 0).astype(np.uint64) | n << np.uint64(56)
        found = self.table.find(k0, k1)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            x, y = k0[missing], k1[missing]
            order = np.lexsort((x, y))
            x, y = x[order], y[order]
            head = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            first = missing[order][head]
            turn, counts, ids = self._learned([bytes(raw[s : s + k]) for s, k in zip(a[first].tolist(), n[first].tolist(), strict=True)])
            number = np.empty(len(turn), dtype=np.int64)
            number[turn] = self.table.add(np.stack([x[head], y[head]], axis=1)[turn], counts, ids) + np.arange(len(turn))
            found[missing[order]] = number[np.cumsum(head) - 1]
        out = np.empty(len(lo), dtype=np.int64)
        out[short] = found
        rest = np.flatnonzero(~short)
        if len(rest):
            held = [bytes(raw[s : s + k]) for s, k in zip(lo[rest].tolist(), size[rest].tolist(), strict=True)]
            new = [s for s in dict.fromkeys(held) if s not in self.table.long]
            if new:
                turn, counts, ids = self._learned(new)
                at = self.table.add(np.zeros((len(new), 2), dtype=np.uint64), counts, ids)
                self.table.long.update((new[i], at + k) for k, i in enumerate(turn))
            out[rest] = [self.table.long[s] for s in held]
        return out

    def _pass(self, held: list[str]) -> list[np.ndarray]:
        if self.table.n > self.limit:
            self.table = _Table()
        joined = [t.encode() for t in held]
        ends = np.cumsum([len(t) + 1 for t in joined]) - 1  # the zero byte behind each text
        data = np.frombuffer(b"\0".join([*joined, bytes(16)]), dtype=np.uint8)
        n = int(ends[-1]) + 1
        cut, odd = cut_segments(data[:n])
        whole = np.array([any(s in t for s in self.special) for t in held])
        whole[np.searchsorted(ends, np.flatnonzero(odd))] = True
        cut[ends] = cut[np.append(0, ends[:-1] + 1)] = True
        lo = np.flatnonzero(cut)
        size = np.diff(np.append(lo, n))
        text = np.searchsorted(ends, lo)
        keep = (lo != ends[text]) & ~whole[text]
        lo, size, text = lo[keep], size[keep], text[keep]
        number = self._numbers(data, lo, size)
        table = self.table
        starts = table.ends[number]
        counts = table.ends[number + 1] - starts
        stops = np.cumsum(counts)
        ids = table.pool[np.repeat(starts - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.append(0, stops)[np.searchsorted(text, np.arange(len(held) + 1))].tolist()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        other = np.flatnonzero(whole).tolist()
        for i, own in zip(other, self._library([held[i] for i in other]), strict=True):
            out[i] = own
        return out

    def encode_all(self, held: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        if not self.cuts:
            return self._library(held)
        out, at = [], 0
        while at < len(held):
            end, size = at + 1, len(held[at])
            while end < len(held) and size + len(held[end]) <= PASS_BYTES:
                size += len(held[end])
                end += 1
            out += self._pass(held[at:end])
            at = end
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()
