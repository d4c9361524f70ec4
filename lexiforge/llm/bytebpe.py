"""Byte-level BPE over whole batches.

A tokenizer file (JSON) defines vocabulary and merges. Texts are split into
pre-tokens with array operations over code points; every distinct pre-token of a
batch is hashed, and only hashes unseen by this worker are merged. The ids equal
those of the file's own library (tested), which also takes the texts that hold a
special token's string.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

from .common import point_table, powers

#: Most pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
KEPT = 1_000_000
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class Coder:
    """Encodes batches by one tokenizer file; one per worker, see coder()."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path, self.own = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        marks = [*range(33, 127), *range(161, 173), *range(174, 256)]
        glyph = {chr(b): b for b in marks}
        glyph |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in marks)}
        ranks = {bytes(glyph[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")  # no object for each
        self.kind = np.full(0x110000, 3, np.uint8)
        for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(p, points):
                a, b = ord(points[m.start()]), ord(points[m.end() - 1])
                self.kind[a : b + 1] = k
        self.kind[_SPACES] = 0
        self.table = point_table()
        self.forget()

    def forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def starts(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of the texts cp[off[i]:off[i+1]] start."""
        n = len(cp)
        kind = self.kind[cp]
        cut = np.ones(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut[off] = True
        run = np.flatnonzero(cut)  # the last is n
        a, b = run[:-1], run[1:]
        final = np.zeros(n + 1, bool)
        final[off] = True
        inner = ~final[b]
        last = b[(kind[a] == 0) & inner] - 1  # the last white space before other text
        cut[last] = True
        cut[last[cp[last] == 32] + 1] = False
        quote = np.flatnonzero((cp[a] == 39) & (b - a == 1) & inner)
        if len(quote):
            quote = quote[cut[a[quote]] & (kind[np.minimum(b[quote], n - 1)] == 1)]
            p = b[quote]
            p = p[(p - 1 == a[quote])]
            c = cp[p]
            d = np.where((p + 1 < n) & ~final[p + 1], cp[np.minimum(p + 1, n - 1)], 0)
            one = np.isin(c, [115, 116, 109, 100])
            two = ((c == 114) & (d == 101)) | ((c == 118) & (d == 101)) | ((c == 108) & (d == 108))
            for q, k in ((p[one], 1), (p[two], 2)):
                cut[q] = False
                cut[q + k] = True
        return np.flatnonzero(cut[:n])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32 arrays."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in plain], out=off[1:])
        cp = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if len(cp):
            start = self.starts(cp, off)
            end = np.append(start[1:], len(cp))
            p, q = powers(len(cp) + 1)
            s = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.table[cp] * p[: len(cp)], out=s[1:])
            h = (s[end] - s[start]) * q[start]
            uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
            slot = np.searchsorted(self.known, uniq)
            if len(self.known):
                missing = np.flatnonzero(self.known[np.minimum(slot, len(self.known) - 1)] != uniq)
            else:
                missing = np.arange(len(uniq))
            if len(missing):
                if len(self.known) > KEPT:
                    self.forget()
                    missing = np.arange(len(uniq))
                joined = "".join(plain)
                a, b = start[first[missing]], end[first[missing]]
                sizes, flat = [], array("I")  # a few lists at a time: many small objects would leave a worker's memory in pieces
                for i in range(0, len(a), 4096):
                    for x, y in zip(a[i : i + 4096].tolist(), b[i : i + 4096].tolist()):
                        got = self.merge(joined[x:y])
                        sizes.append(len(got))
                        flat.extend(got)
                size = np.array(sizes, np.int64)
                at = len(self.ids) + np.cumsum(size) - size
                self.ids = np.concatenate([self.ids, np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32)])
                known = np.concatenate([self.known, uniq[missing]])
                order = np.argsort(known, kind="stable")
                self.known, self.at = known[order], np.concatenate([self.at, at])[order]
                self.size = np.concatenate([self.size, size])[order]
                slot = np.searchsorted(self.known, uniq)
            at, size = self.at[slot][inv], self.size[slot][inv]
            ends = np.cumsum(size)
            total = int(ends[-1])
            ids = self.ids[np.repeat(at - (ends - size), size) + np.arange(total)]
            bound = np.concatenate([[0], ends])[np.searchsorted(start, off)]
            out = [ids[bound[i] : bound[i + 1]] for i in range(len(texts))]
        if odd and self.own is None:  # large, and seldom needed
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        for i in odd:
            out[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
