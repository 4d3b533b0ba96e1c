"""Token ids of whole texts by the ``tokenizers`` library, many texts at once.

A byte-level BPE tokenizer first cuts a text into pieces by character classes and then codes each
piece by itself. Most pieces of a corpus repeat, so the cut is made here on arrays of code points,
each distinct piece is coded by the library once for a worker, and the ids are gathered. The tests
hold the result against the library's own on whole texts.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space of the cutting pattern (Unicode White_Space), as code points and ranges.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_classes = None


def char_classes() -> np.ndarray:
    """Class of each code point."""
    global _classes
    if _classes is None:
        first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        table = np.full(0x110000, OTHER, np.uint8)
        of = np.array(first)
        table[of == "L"], table[of == "N"] = LETTER, NUMBER
        for a, b in WHITE:
            table[a : b + 1] = SPACE
        _classes = table
    return _classes


def piece_starts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end; the pieces cover every code point.

    The pattern: an apostrophe with s, t, re, ve, m, ll or d; a run of letters, of numbers or of other
    signs, each with one space before it if there is one; a run of white space, of which the last
    character is left to what follows, if something does.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    begins = np.zeros(n + 1, bool)
    ends = np.cumsum(lengths)
    begins[ends[ends < n]] = begins[0] = True
    doc_start = begins.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins[:n])
    stops = np.append(runs[1:], n)
    mark = np.zeros(n + 2, bool)
    mark[runs] = True
    white = kind[runs] == SPACE
    last_in_doc = doc_start[stops] | (stops == n)
    inner = white & ~last_in_doc
    mark[stops[inner] - 1] = True
    after = np.flatnonzero(inner & (codes[stops - 1] == 0x20))
    mark[stops[after]] = False  # joined to the space before
    quote = np.flatnonzero((codes[runs] == 0x27) & (stops - runs == 1) & ~last_in_doc)
    for r in quote:
        i, j = runs[r], stops[r]
        if not mark[i] or kind[j] != LETTER:
            continue
        stop = stops[r + 1]
        two = chr(codes[j]) + (chr(codes[j + 1]) if j + 1 < stop else "")
        take = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if take:
            mark[j] = False
            if j + take < stop:
                mark[j + take] = True
    return np.flatnonzero(mark[:n])


def byte_signs() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary: its own where it prints, else the next from 256."""
    prints = np.zeros(256, bool)
    prints[0x21:0x7F] = prints[0xA1:0xAD] = prints[0xAE:0x100] = True
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u4")


class BatchTokenizer:
    """Ids of texts, each followed by an end id. Strings of special tokens in a text are ordinary text, or with special what the library makes of them by default."""

    #: Most distinct pieces remembered at a time.
    MOST = 200_000

    def __init__(self, path: str, end_id: int, special: bool = False):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()] if special else []
        self.plain = self.coder.encode_special_tokens  # the library's default
        self.coder.encode_special_tokens = True
        self.model = self._bare_model()
        self.end_id = end_id
        base = np.uint64(0x9E3779B97F4A7C15 | 5)
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.forget()

    def _bare_model(self):
        """The library's model, where a piece reaches it as nothing but the signs of its bytes; else None."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        t = self.coder
        cut = t.pre_tokenizer
        bare = isinstance(t.model, BPE) and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        bare = bare and t.normalizer is None and t.truncation is None and t.padding is None
        return t.model if bare and all(a.special for a in t.get_added_tokens_decoder().values()) else None

    def _code(self, pieces: list[str]):
        """Ids of each piece by the library. Its model alone is asked where that suffices: all else that it does for a text costs more than the ids of a piece."""
        if self.model is None:
            return (self.coder.encode(p, add_special_tokens=False).ids for p in pieces)
        laid = np.frombuffer(b"\xff".join([p.encode() for p in pieces]), np.uint8)  # no UTF-8 has that byte
        tokenize = self.model.tokenize
        return ([t.id for t in tokenize(signs)] for signs in byte_signs()[laid].tobytes().decode("utf-32-le").split("\xff"))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.count = array("I", [self.end_id]), array("q", [0]), array("q", [1])

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            for piece, ids in zip(some, self._code(some)):
                self.known[piece] = len(self.first)
                self.first.append(len(self.flat))
                self.count.append(len(ids))
                self.flat.extend(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end (little-endian 32 bits), and how many each text has. The few texts with an added token in them are coded whole by the library."""
        whole = {i: t for i, t in enumerate(texts) if any(a in t for a in self.added)}
        ids, counts = self._encode(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        if not whole:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        self.coder.encode_special_tokens = self.plain
        try:
            found = self.coder.encode_batch(list(whole.values()), add_special_tokens=False)
        finally:
            self.coder.encode_special_tokens = True
        for i, coded in zip(whole, found):
            parts[i] = np.array([*coded.ids, self.end_id], "<u4")
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.MOST:
            self.forget()
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = piece_starts(codes, lengths)
        n = len(codes)
        stops = np.append(starts[1:], n) if n else starts
        # a hash of each piece: differences of one running polynomial, shifted back to exponent 0
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, self.base, np.uint64)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, self.inverse, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        hashes = (sums[stops] - sums[starts]) * back[starts]
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())]
        places = list(map(self.known.get, words))
        new = [w for w, p in zip(words, places) if p is None]
        if new:
            self._learn(new)
            places = [self.known[w] if p is None else p for w, p in zip(words, places)]
        index = np.array(places, np.int64)[which]
        ends = np.cumsum(lengths)
        upto = np.searchsorted(starts, ends, "left")  # pieces before each text's end
        index = np.insert(index, upto, 0)
        counts = np.frombuffer(self.count, np.int64)[index]
        total = np.cumsum(counts)
        first = np.frombuffer(self.first, np.int64)[index]
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(first - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)]
        whole = total[upto + np.arange(len(texts))] if len(texts) else total
        return ids.astype("<u4", copy=False), np.diff(whole, prepend=0)


_coders: dict[tuple, BatchTokenizer] = {}


def coder(path: str, end_id: int) -> BatchTokenizer:
    """This worker's tokenizer for a file, with the library's default settings."""
    if (path, end_id) not in _coders:
        _coders[path, end_id] = BatchTokenizer(path, end_id, special=True)
    return _coders[path, end_id]
