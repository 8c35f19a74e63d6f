"""Encoding with a public tokenizer, chunk by chunk.

A byte-level BPE vocabulary never merges across the start of white space that follows a character which is no
white space, so a text may be cut there: each chunk (white space, then characters that are none) has the
ids it has within the text. Chunks repeat, so a bounded table of chunk -> ids spares most of the encoding; it is looked up
for all chunks of several texts at once. Its keys are the chunks' bytes themselves, so it can't confuse two of them.
Texts with white space other than blank, tab and line ends are encoded whole, and so are those that hold an added token
(as the literal <|endoftext|>), which has its own id as in the tokenizers library's plain call. An encoder made with
``plain`` takes the special ones among them as ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_WORDS = 3  # a key has so many times 8 bytes; longer chunks are kept in a plain table
_CACHED = 64  # longest chunk that is kept there
_GROUP = 1 << 18  # characters of texts, or of a part of a text, that are cut at once
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Table:
    """Open addressing with linear probing. A row is the key's words and a last one: length, number of ids, first id."""

    def __init__(self, entries: int):
        self.room = entries
        self.size = 1 << max(8, (2 * entries).bit_length())
        self.rows = np.zeros((self.size, _WORDS + 1), np.uint64)

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _FACTORS[0]
        for k in range(1, _WORDS):
            h = (h ^ (h >> np.uint64(29))) + keys[:, k] * _FACTORS[k]
        h ^= h >> np.uint64(29)
        return h * _FACTORS[1]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (self.hashed(keys) >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The last word of each key's row, 0 where there is none. A key's bytes end with its length's in the last word."""
        out = np.zeros(len(keys), np.uint64)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            rows = self.rows[slots]
            same = (rows[:, :_WORDS] == keys[todo]).all(axis=1) & (rows[:, _WORDS] != 0)
            out[todo[same]] = rows[same, _WORDS]
            go = ~same & (rows[:, _WORDS] != 0)
            todo, slots = todo[go], (slots[go] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, last: np.ndarray) -> None:
        """Adds distinct keys that aren't there, as many as there is room for."""
        keys, last = keys[: self.room], last[: self.room]
        self.room -= len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.rows[slots, _WORDS] == 0
            _, first = np.unique(slots, return_index=True)
            wins = np.zeros(len(keys), bool)
            wins[first] = True
            wins &= free
            self.rows[slots[wins], :_WORDS] = keys[wins]
            self.rows[slots[wins], _WORDS] = last[wins]
            keys, last, slots = keys[~wins], last[~wins], slots[~wins]
            taken = self.rows[slots, _WORDS] != 0
            slots = np.where(taken, (slots + 1) & (self.size - 1), slots)


class Encoder:
    """ids of texts as arrays of unsigned 32-bit integers; at most ``entries`` chunks are kept, those met first."""

    def __init__(self, path: str, entries: int = 1_000_000, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        ids = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            self.bytes_of[i] = len(token)  # byte-level: a character of a token is a byte of the text
        self.table = _Table(entries)
        self.pool = np.zeros(1 << 16, "<u4")  # ids of kept chunks, then those of the present group
        self.used = 1
        self.kept: dict[bytes, np.ndarray] = {}  # of long chunks
        self.long_room = entries // 8

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _flat(self, body: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the chunks of body from starts to stops, one after the other, and their numbers. Chunks that start with
        white space and end with none are encoded as one text and told apart by their bytes."""
        b = np.frombuffer(body, np.uint8)
        joined = _SPACE[b[starts]] & ~_SPACE[b[stops - 1]]
        parts = [body[a:z] for a, z in zip(starts[joined].tolist(), stops[joined].tolist(), strict=True)]
        if parts:
            ids = self._each([b"".join(parts).decode("utf-8", "surrogatepass")])[0]
            places, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(stops[joined] - starts[joined])
            last = np.minimum(np.searchsorted(places, ends) + 1, len(ids))
            if not np.array_equal(places[last - 1], ends):
                joined[:] = False
        if joined.all():
            return ids, np.diff(last, prepend=0)
        found: list[np.ndarray] = []
        if joined.any():
            whole = iter(np.split(ids, last[:-1]))
        alone = iter(self._each([body[a:z].decode("utf-8", "surrogatepass") for a, z in zip(starts[~joined].tolist(), stops[~joined].tolist(), strict=True)]))
        found = [next(whole) if x else next(alone) for x in joined.tolist()]
        return np.concatenate(found), np.array(list(map(len, found)), np.int64)

    def _hold(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Puts ids behind those in use; the first place of each chunk's."""
        at = self.end + np.cumsum(n) - n
        self.end += len(ids)
        while self.end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.end - len(ids) : self.end] = ids
        return at

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts that aren't empty, all chunks of all texts at once."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array(list(map(len, raw)), np.int64)
        firsts = np.cumsum(sizes) - sizes
        body = b"".join(raw)
        b = np.frombuffer(body + bytes(8 * _WORDS + 8), np.uint8)
        space = _SPACE[b[: len(body)]]
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[firsts] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(body)))
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        self.end = self.used

        short = np.flatnonzero(lengths <= 8 * _WORDS - 1)
        eight = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))  # the 8 bytes from each place on
        keys = np.empty((len(short), _WORDS), np.uint64)
        for k in range(_WORDS):
            keys[:, k] = eight[starts[short] + 8 * k] & _MASK[np.clip(lengths[short] - 8 * k, 0, 8)]
        keys[:, _WORDS - 1] |= lengths[short].astype(np.uint64) << np.uint64(56)
        last = self.table.find(keys)
        new = np.flatnonzero(last == 0)
        if len(new):
            mine = keys[new]
            _, one, of = np.unique(self.table.hashed(mine), return_index=True, return_inverse=True)
            if not np.array_equal(mine[one][of], mine):  # two keys of one hash
                _, one, of = np.unique(mine, axis=0, return_index=True, return_inverse=True)
            first = short[new[one]]
            room = self.table.room
            ids, c = self._flat(body, starts[first], starts[first] + lengths[first])
            a = self._hold(ids, c)
            value = (a.astype(np.uint64) << np.uint64(16)) | c.astype(np.uint64)
            self.table.add(mine[one], value)
            if room:
                self.used = int((a + c)[min(room, len(a)) - 1])
            last[new] = value[of.ravel()]
        at[short], n[short] = (last >> np.uint64(16)).astype(np.int64), (last & np.uint64(0xFFFF)).astype(np.int64)

        long = np.flatnonzero(lengths > 8 * _WORDS - 1)
        if len(long):
            chunks = [body[a:z] for a, z in zip(starts[long].tolist(), (starts + lengths)[long].tolist(), strict=True)]
            found = list(map(self.kept.get, chunks))
            gaps = [k for k, x in enumerate(found) if x is None]
            if gaps:
                ids, c = self._flat(body, starts[long[gaps]], starts[long[gaps]] + lengths[long[gaps]])
                for k, x in zip(gaps, np.split(ids, np.cumsum(c)[:-1]), strict=True):
                    found[k] = x
                    if len(chunks[k]) <= _CACHED and len(self.kept) < self.long_room:
                        self.kept[chunks[k]] = x.copy()
            n[long] = list(map(len, found))
            at[long] = self._hold(np.concatenate(found), n[long])

        ends = np.cumsum(n)
        ids = self.pool[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]))]
        bounds = np.append(0, ends)[np.append(np.searchsorted(starts, firsts), len(starts))].tolist()
        return [ids[a:z] for a, z in zip(bounds, bounds[1:])]

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))

    def _long(self, text: str) -> np.ndarray:
        """ids of a text that is cut into parts first, each of which begins with white space after other characters."""
        parts, at = [], 0
        for m in re.finditer(r"[^ \n\t\r](?=[ \n\t\r])", text):
            if m.end() - at >= _GROUP:
                parts += self._cut([text[at : m.end()]])
                at = m.end()
        return np.concatenate([*parts, *self._cut([text[at:]])])

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of every text, in order."""
        group: list[str | np.ndarray] = []  # texts, or ids of one that is encoded by itself
        size = 0
        for text in texts:
            if not text:
                group.append(np.empty(0, "<u4"))
            elif any(t in text for t in self.added) or not text.replace("\n", " ").isprintable() and ODD_SPACE.search(text):
                group.append(self._each([text])[0])
            elif len(text) > 2 * _GROUP:
                group.append(self._long(text))
            else:
                group.append(text)
                size += len(text)
            if size > _GROUP:
                yield from self._told(group)
                group, size = [], 0
        yield from self._told(group)

    def _told(self, group: list[str | np.ndarray]) -> Iterator[np.ndarray]:
        texts = [x for x in group if isinstance(x, str)]
        cut = iter(self._cut(texts) if texts else ())
        for x in group:
            yield next(cut) if isinstance(x, str) else x


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None = None, plain: bool = False) -> Encoder:
    """The process's encoder for a vocabulary file, byte_bpe_50k.json by default; plain: special tokens are text."""
    key = path or vocabulary(), plain
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(key[0], plain=plain)
    return _ENCODERS[key]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
