"""Token ids of whole batches of texts under a word-level BPE file of the `tokenizers` library.

The library spends most of its time on words it has met before. Batches are therefore cut into the tokenizer's own
pre-tokens in numpy, and only pre-tokens not seen before in this process go through the library. Pre-tokens are found by
hashes, but remembered ids are used only if all characters agree. Texts with any character for which the cut below might
differ from the library's, and texts with two pre-tokens of one hash, go through the library whole.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from terrafold.llm.textbytes import HashIndex, counted, span_hashes, span_sums, sums_by_row

_SPACE, _LETTER, _DIGIT, _OTHER, _UNSURE = range(5)
#: Characters from here on are not cut here. Below it, composition (NFC) changes nothing.
_END = 0x250
#: Pre-tokens remembered in a process; beyond it all are forgotten, so memory stays bounded.
REMEMBERED = 800_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character; the last entry stands for all others."""
    kinds, lower = np.full(_END + 1, _UNSURE, np.uint8), np.arange(_END + 1, dtype=np.uint32)
    for k in range(_END):
        c = chr(k)
        if c in " \t\n\r":
            kinds[k] = _SPACE
        elif k < 33 or 0x7F <= k <= 0xA0 or k == 0xAD or len(c.lower()) > 1:
            continue
        else:
            kinds[k] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER)
            lower[k] = ord(c.lower())
    return kinds, lower


def _byte_characters() -> dict[int, int]:
    """The character that byte-level tokenizers print for each byte: itself if it is visible, else the next free one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(hidden) if b != 10}


class WordBpe:
    """Encodes texts as the library does with add_special_tokens=False; null texts must be made empty before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: The same merges without normaliser and pre-tokenizer: takes pre-tokens whose bytes stand for themselves as characters.
        self.merges = Tokenizer(self.whole.model)
        self.bytes = str.maketrans(_byte_characters())
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex(np.zeros(0, np.uint64))
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        #: The characters of all remembered pre-tokens in a row, and where each one's begin.
        self.chars, self.begins = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, pretokens: list[str]) -> None:
        mapped = "\n".join(pretokens).encode().decode("latin-1").translate(self.bytes).split("\n")
        sizes, flat = np.zeros(len(mapped), np.int64), []
        for k in range(0, len(mapped), 5000):
            e = self.merges.encode(mapped[k : k + 5000], is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint32))
            sizes[k : k + 5000] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(mapped[k : k + 5000]))
        flat = np.concatenate(flat)
        if not self.index.add(hashes):
            old = np.empty(self.index.n, np.uint64)
            used = self.index.places >= 0
            old[self.index.places[used]] = self.index.slots[used]
            self.index = HashIndex(np.concatenate([old, hashes]), 2 * (len(old) + len(hashes)))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(pretokens).encode("utf-16-le"), np.uint16)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))])

    def _others(self, places: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans of low aren't the remembered pre-tokens at these places."""
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        same = self.begins[places + 1] - self.begins[places] == size
        step = np.arange(at[-1])
        known = np.repeat(np.where(same, self.begins[places], 0) - at[:-1], size) + step
        wrong = np.repeat(~same, size)
        known[wrong] = 0
        wrong |= self.chars[known] != low[np.repeat(starts - at[:-1], size) + step]
        return sums_by_row(wrong.astype(np.int64), at) > 0

    def _pretokens(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pre-tokens, the index of each text's first one, and lower-cased characters."""
        kinds, lower = _tables()
        chars = np.minimum(chars, _END)
        kind, low = kinds[chars], lower[chars]
        n = len(chars)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        cut = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= first[:-1] | (kind == _DIGIT)
        start = cut & (kind != _SPACE)
        # An apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it, and letters after those begin anew.
        quotes = np.flatnonzero(start & (low == 39))
        if len(quotes):
            padded, ends = np.append(low, [0, 0, 0]), np.append(first, [True, True])
            a, b = padded[quotes + 1], padded[quotes + 2]
            open1 = ~ends[quotes + 1]
            open2 = open1 & ~ends[quotes + 2]
            one = open1 & np.isin(a, [115, 116, 109, 100])
            two = open2 & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
            start[quotes[one | two] + 1] = False
            for after in (quotes[one] + 2, quotes[two & ~one] + 3):
                after = after[after < n]
                start[after] |= (kind[after] == _LETTER) & ~first[after]
        starts = np.flatnonzero(start)
        stop = np.flatnonzero(np.append((kind == _SPACE) | first[:-1], True))
        ends_ = np.minimum(np.append(starts[1:], n), stop[np.searchsorted(stop, starts, "right")])
        return starts, ends_, np.searchsorted(starts, offsets), low

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one entry more than texts)."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        kinds, _ = _tables()
        odd = (kinds[np.minimum(chars, _END)] == _UNSURE).astype(np.int64)
        if len(chars) > 1:  # special tokens begin with these two
            odd[:-1] |= (chars[:-1] == 60) & (chars[1:] == 124)
        odd = sums_by_row(odd, offsets) > 0
        if odd.any():
            return self._with_odd(texts, odd)
        starts, ends, first, low = self._pretokens(chars, offsets)
        hashes = span_hashes(span_sums(low, starts), starts, ends)
        if self.index.n > REMEMBERED:
            self.forget()
        places = self.index.find(hashes)
        if len(new := np.flatnonzero(places < 0)):
            keys, _ = counted(hashes[new])
            order = new[np.argsort(hashes[new], kind="stable")]
            at = order[np.searchsorted(hashes[order], keys)]
            lowered = low.astype("<u4").tobytes()
            self._learn(keys, [lowered[4 * s : 4 * e].decode("utf-32-le") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            places[new] = self.index.find(hashes[new])
        if len(others := np.flatnonzero(self._others(places, low, starts, ends))):
            odd[np.searchsorted(first, others, "right") - 1] = True
            return self._with_odd(texts, odd)
        sizes = self.starts[places + 1] - self.starts[places]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[places] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[first]

    def _with_odd(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, at = self.encode([t for t, o in zip(texts, odd.tolist(), strict=True) if not o])
        whole = iter(self.whole.encode_batch([t for t, o in zip(texts, odd.tolist(), strict=True) if o], add_special_tokens=False))
        parts, k = [], 0
        for o in odd.tolist():
            if o:
                parts.append(np.array(next(whole).ids, np.uint32))
            else:
                parts.append(plain[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


_open: dict[tuple[str, int], WordBpe] = {}


def word_bpe(content: str) -> WordBpe:
    """The tokenizer whose file has this content; one a process, so that it remembers across tasks."""
    import os
    import tempfile

    key = (str(hash(content)), len(content))
    if key not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            _open[key] = WordBpe(f.name)
    return _open[key]
