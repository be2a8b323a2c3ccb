"""Token ids of whole texts by a tokenizer file, piece by piece.

A byte-level BPE encodes each piece of its splitting pattern for itself, so a piece's ids are found once and kept.
Pieces are cut from code points with numpy by the pattern's rules (contractions; a blank with letters, numbers or other
marks; white space).  Texts that hold a special token's string, or characters that are unassigned or beyond the basic
plane, go to the library whole, as do all texts where the tokenizer's file isn't of this kind.  Kept pieces are found by a 64-bit
hash and compared with the text itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache

import numpy as np

from .kernel import mix, run_hashes

LETTER, NUMBER, SPACE, OTHER, ODD = range(5)
#: Pieces whose ids a worker keeps before it starts anew.
KEEP = 1 << 20


#: Byte-level models show a byte that is no printable Latin-1 character as the next free character from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


@cache
def _classes() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.uint8)
    for cp in range(0x10000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif kind in ("Cn", "Cs", "Co"):
            table[cp] = ODD
    for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE
    return table


def cut(cps: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie one after another, from at[0] on."""
    n = len(cps)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[at] = True
    new |= first[:n]
    white = kind == SPACE
    follow = np.zeros(n, bool)  # the next character is of the same text and not white
    follow[:-1] = ~white[1:] & ~first[1:n]
    last = white & follow
    new |= last  # a run's last blank begins what follows, or is a piece of its own
    blank = last & (cps == 0x20)
    new[1:] &= ~blank[:-1]
    # 's 't 'm 'd 're 've 'll, where the mark begins a piece
    mark = np.flatnonzero((cps == 0x27) & new & (np.append(kind[1:], OTHER) == LETTER) & ~first[1:])
    if len(mark):
        padded = np.append(cps, [0, 0])
        inside = ~np.append(first[:n], [True, True, True])
        a, b = padded[mark + 1], padded[mark + 2]
        two = inside[mark + 2] & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        size = np.where(one, 2, np.where(two, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        new[mark + 1] = False
        then = mark + size
        ok = then < n
        # the letters left over begin a piece; what isn't a letter begins one anyway, or is the blank rule's
        then = then[ok]
        new[then[(kind[then] == LETTER)]] = True
    return np.flatnonzero(new)


class Encoder:
    """encode(texts): the ids of all texts one after another, and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_pieces = spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lies, self.long, self.text, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, own = [], {}
        for i, t in enumerate(texts):
            if not self.by_pieces or any(s in t for s in self.special):
                own[i] = self._whole(t)
                t = ""
            plain.append(t)
        cps = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
        kind = _classes()[np.minimum(cps, 0xFFFF)]
        kind[cps > 0xFFFF] = ODD
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            for i in np.unique(np.searchsorted(at, odd, "right") - 1).tolist():
                own[i] = self._whole(plain[i])
                plain[i] = ""
            cps = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum([len(t) for t in plain])])
            kind = _classes()[cps]
        ids, count = self._pieces(cps, at, kind) if len(cps) else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        if own:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i, x in own.items():
                parts[i], count[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, count

    def _pieces(self, cps: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = cut(cps, at, kind)
        size = np.diff(np.append(start, len(cps)))
        key = run_hashes(lambda low, high: mix(cps[low:high].astype(np.uint64) + np.uint64(1)), len(cps), start, start + size)
        distinct, one, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > KEEP:
            self._clear()
        near = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        missing = np.flatnonzero(self.keys[near] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(missing):
            s = start[one[missing]]
            n, got, model = np.empty(len(missing), np.int64), [], self.tokenizer.model
            for k, (a, b) in enumerate(zip(s.tolist(), (s + size[one[missing]]).tolist(), strict=True)):
                ids = [x.id for x in model.tokenize(cps[a:b].tobytes().decode("utf-32-le").encode().decode("latin-1").translate(_SHOWN))]
                n[k] = len(ids)
                got += ids
            first = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.array(got, np.uint32)])
            long_ = size[one[missing]]
            lies = len(self.text) + np.cumsum(long_) - long_
            self.text = np.concatenate([self.text, cps[np.repeat(s - (lies - len(self.text)), long_) + np.arange(int(long_.sum()))].astype(np.uint16)])
            spot = np.searchsorted(self.keys, distinct[missing])
            self.keys, self.first, self.size, self.lies = (np.insert(old, spot, new) for old, new in ((self.keys, distinct[missing]), (self.first, first), (self.size, n), (self.lies, lies)))
            self.long = np.insert(self.long, spot, long_)
            near = np.searchsorted(self.keys, distinct)
        # every piece against the one kept under its key: where two share a key, nothing kept may be used
        kept = self.text[np.minimum(np.repeat(self.lies[near][which] - start, size) + np.arange(len(cps)), len(self.text) - 1)]
        if (kept != cps).any() or (self.long[near][which] != size).any():
            parts = [self._whole(cps[a:b].tobytes().decode("utf-32-le")) for a, b in zip(at[:-1], at[1:], strict=True)]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        first, n = self.first[near][which], self.size[near][which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))]
        ends = np.concatenate([[0], ends])
        cuts = ends[np.searchsorted(start, at)]
        return ids, np.diff(cuts)
