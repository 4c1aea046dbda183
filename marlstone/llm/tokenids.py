"""Token ids of whole texts by the ``tokenizers`` library, with a piece cache.

Both vocabularies split a text into pieces first and then encode each piece on its own, so
ids(text) is the concatenation of ids(piece). :class:`PieceCache` finds the pieces of a batch
with numpy, encodes only the pieces it has not seen and copies the ids of the others. It does
so for texts of ASCII and Latin-1 letters, where the split is known exactly; every other text
goes to the library as it is. A piece is told by its bytes: up to eight are the key themselves,
longer ones are kept and compared.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_U = np.uint64
#: The bits of a word of n bytes.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLAIN = re.compile("[^\n -~À-ÖØ-öø-ÿ]")
_LETTER, _DIGIT, _SYMBOL, _SPACE, _END = 1, 2, 3, 4, 5
#: Characters numbered at once.
BLOCK_CHARS = 1 << 19
#: Distinct pieces kept; beyond it the cache starts again empty.
MAX_PIECES = 1_000_000
#: Bytes of pieces kept, likewise.
MAX_KEPT = 1 << 25
#: Pieces that the library has at once: what it makes of one takes far more than its ids.
PIECES_AT_ONCE = 2048


def _classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    for code in range(256):
        char = chr(code)
        if char.isalpha():
            out[code] = _LETTER
        elif char.isdigit() and code < 128:
            out[code] = _DIGIT
    out[[32, 10]] = _SPACE
    out[0] = _END
    return out


_CLASS = _classes()


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(29))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(32))


def byte_windows(raw: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw as a number; raw ends with eight zero bytes."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def span_words(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of eight bytes that cover spans of over eight bytes, each word's
    number in its span, and the first word of each span; the last word of a span ends with it."""
    n = (ends - begins + 7) >> 3
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.minimum(np.repeat(begins, n) + 8 * number, np.repeat(ends, n) - 8), number, first


def span_keys(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each raw[begin:end], none of which is empty or holds a zero byte. Spans of
    up to eight bytes have a key of their own among such; raw ends with eight zero bytes."""
    at, size = byte_windows(raw), ends - begins
    keys = at[begins] & _BYTES[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        places, number, first = span_words(begins[long], ends[long])
        with np.errstate(over="ignore"):
            words = _mix(at[places] ^ _mix(number.astype(np.uint64) + _U(0x51)))
            keys[long] = _mix(np.add.reduceat(words, first) + size[long].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return _mix(keys)


def load_tokenizer(path: str):
    """The tokenizer of a file; strings of its special tokens are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def piece_starts(codes: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a NUL-terminated Latin-1 buffer.

    ``words_only`` is the split that drops white space and takes single digits; the other is
    the byte-level split, where a blank joins what follows it.
    """
    kind = _CLASS[codes]
    before = np.empty_like(kind)
    before[0], before[1:] = _END, kind[:-1]
    start = kind != before
    space = kind == _SPACE
    if words_only:
        start |= kind == _DIGIT
    else:
        after = np.empty_like(kind)
        after[-1], after[:-1] = _END, kind[1:]
        last = space & (after != _SPACE) & (after != _END)  # of a run with text behind it
        start |= last
        joined = np.flatnonzero(last & (codes == 32)) + 1
        start[joined] = False
    tick = np.flatnonzero((codes == 39) & start)
    if len(tick):
        padded = np.concatenate([codes, np.zeros(3, np.uint8)])
        one, two = padded[tick + 1], padded[tick + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for found, size in ((tick[short], 2), (tick[long & ~short], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            start[found + size] = True
    begins = np.flatnonzero(start)
    ends = np.empty_like(begins)
    ends[:-1], ends[-1] = begins[1:], len(codes)
    keep = kind[begins] != _END
    if words_only:
        keep &= ~space[begins]
    return begins[keep], ends[keep]


class PieceCache:
    """Encodes batches of texts; one lives in each Python worker."""

    _open: dict[str, "PieceCache"] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCache":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        import json

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.tokenizer = load_tokenizer(path)
        self.lower = bool(form["normalizer"])
        self.words_only = form["pre_tokenizer"]["type"] != "ByteLevel"
        self.known_split = self._is_known(form)
        del form
        self.max_pieces = max_pieces
        self.bits = max(10, int(max_pieces * 2).bit_length())
        self._clear()

    @staticmethod
    def _is_known(form: dict) -> bool:
        first = form["pre_tokenizer"]
        if first["type"] == "ByteLevel":
            return form["normalizer"] is None and first["use_regex"] and not first["add_prefix_space"]
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", ())]
        return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in first.get("pretokenizers", ())] == ["Split", "ByteLevel"]

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: a free slot
        self.at = np.zeros(1 << self.bits, np.int32)
        self.size = np.zeros(1 << self.bits, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.length = np.zeros(1 << self.bits, np.int32)  # bytes of the piece
        self.kept_at = np.zeros(1 << self.bits, np.int32)  # of over eight bytes: where they are kept
        self.kept = np.zeros(1 << 16, np.uint8)
        self.used = self.used_kept = self.count = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is missing."""
        mask = (1 << self.bits) - 1
        slot = (keys >> _U(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            there = self.keys[slot[todo]]
            same = there == keys[todo]
            out[todo[same]] = slot[todo[same]]
            todo = todo[~same & (there != 0)]
        return out

    def _keep_ids(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are kept from now on."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return at

    def _insert(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Distinct keys that are not there yet, with the bytes of their pieces."""
        sizes, ids = self._encode_pieces(pieces)
        at = self._keep_ids(sizes, ids)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        kept = np.where(length > 8, length, 0)
        kept_at = self.used_kept + np.cumsum(kept) - kept
        more = np.frombuffer(b"".join(x for x in pieces if len(x) > 8), np.uint8)
        if self.used_kept + len(more) + 8 > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(max(len(self.kept), len(more) + 8), np.uint8)])
        self.kept[self.used_kept : self.used_kept + len(more)] = more
        self.used_kept += len(more)
        self.count += len(keys)
        mask = (1 << self.bits) - 1
        slot, todo = (keys >> _U(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of those for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.at[slot[won]], self.size[slot[won]] = at[won], sizes[won]
            self.length[slot[won]], self.kept_at[slot[won]] = length[won], kept_at[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _other(self, slots: np.ndarray, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces whose slot holds another piece of the same key."""
        length = ends - begins
        other = self.length[slots] != length
        long = np.flatnonzero((length > 8) & ~other)
        if len(long):
            here, number, first = span_words(begins[long], ends[long])
            kept = self.kept_at[slots[long]]
            there = np.repeat(kept - begins[long], np.diff(first, append=len(here))) + here
            other[long] = np.logical_or.reduceat(byte_windows(raw)[here] != byte_windows(self.kept)[there], first)
        return np.flatnonzero(other)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)]
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            found = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode("latin-1") for x in pieces[at : at + PIECES_AT_ONCE]], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            sizes[at : at + len(found)] = n
            ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())))
        return sizes, np.concatenate(ids)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of each text's ids) of texts of the known alphabet."""
        raw = "\0".join(texts).encode("latin-1") + b"\0"
        codes = np.frombuffer(raw, np.uint8)
        begins, ends = piece_starts(codes, self.words_only)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        raw += bytes(8)
        keys = np.maximum(span_keys(raw, begins, ends), _U(1))
        if self.count > self.max_pieces or self.used_kept > MAX_KEPT:
            self._clear()
        slots = self._find(keys)
        missing = np.flatnonzero(slots < 0)
        pieces = lambda which: [raw[b:e] for b, e in zip(begins[which].tolist(), ends[which].tolist())]
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.count + len(new) > (1 << self.bits) * 3 // 4:
                self._clear()
                new, first = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            self._insert(new, pieces(missing[first]))
            slots = self._find(keys)
        sizes, at = self.size[slots].astype(np.int64), self.at[slots].astype(np.int64)
        other = self._other(slots, raw, begins, ends)
        if len(other):
            sizes[other], ids = self._encode_pieces(pieces(other))
            at[other] = self._keep_ids(sizes[other], ids)
        upto = np.cumsum(sizes)
        take = np.repeat(at - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        last = np.searchsorted(begins, text_ends, side="left")  # pieces before each text's end
        return self.ids[take], np.concatenate([[0], upto])[last]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as uint32; of null as of an empty text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        block: list[int] = []
        words: list[str] = []
        chars = 0

        def flush():
            nonlocal block, words, chars
            if block:
                ids, ends = self._block(words)
                begin = 0
                for i, end in zip(block, ends.tolist()):
                    out[i], begin = ids[begin:end], end
            block, words, chars = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
                continue
            n = len(text)
            if not self.known_split or n >= BLOCK_CHARS or _PLAIN.search(text):
                out[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if chars + n + 1 > BLOCK_CHARS:
                flush()
            block.append(i)
            words.append(text.lower() if self.lower else text)
            chars += n + 1
        flush()
        return out
