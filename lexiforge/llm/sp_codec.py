"""SentencePiece encoding and decoding by a batched Viterbi search.

The best segmentation of a text under the sum of piece scores is that of its
words (runs of word marks and what follows, where no piece crosses words).
Distinct words of equal length advance together: at each end, every start's substring
hash is looked up in the sorted hashes of the pieces, and the maximum over
starts is stored with its back pointer. A character that no piece covers is spelt in
byte pieces. Scores are summed exactly, so ties are ties; the longest last piece wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import KEPT
from .common import batch, point_table, powers, releasing, text_runs

MARK = "▁"
#: Words of more characters are searched one by one.
LONG = 512


class Codec:
    """Encodes and decodes batches by one model file; one per worker, see codec()."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not special[i]]
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if sp.is_unknown(int(self.byte[0])):
            raise ValueError("the model has no byte pieces")
        self.longest = max(len(pieces[i]) for i in plain)
        self.prefix = MARK if sp.encode("a", out_type=str)[0].startswith(MARK) else ""
        self.split = not any(a != MARK and b == MARK for i in plain for a, b in zip(pieces[i], pieces[i][1:]))
        self.table = point_table()
        key = np.concatenate([self.hashes([pieces[i]]) for i in plain])
        order = np.argsort(key)
        self.key, self.id = key[order], np.array(plain)[order]
        score = np.array([sp.get_score(i) for i in plain], float)
        self.score = score[order]
        self.unknown = score.min() - 10.0
        self.bytes = [b"" if special[i] else pieces[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _sums(self, cp: np.ndarray) -> np.ndarray:
        p, _ = powers(cp.shape[-1] + 1)
        s = np.zeros((*cp.shape[:-1], cp.shape[-1] + 1), np.uint64)
        np.cumsum(self.table[cp] * p[: cp.shape[-1]], axis=-1, out=s[..., 1:])
        return s

    def hashes(self, texts: list[str]) -> np.ndarray:
        return np.array([self._sums(np.array([ord(c) for c in t]))[-1] for t in texts], np.uint64)

    def viterbi(self, cp: np.ndarray) -> list[np.ndarray]:
        """The piece ids of equally long words, a row of code points each; byte pieces for unknown characters."""
        m, n = cp.shape
        s = self._sums(cp)
        _, q = powers(n + 1)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((m, n + 1), np.int64), np.zeros((m, n + 1), np.int64)
        top = len(self.key) - 1
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):  # ascending, so the longest piece wins a tie
                h = (s[:, end] - s[:, start]) * q[start]
                k = np.minimum(np.searchsorted(self.key, h), top)
                found = self.key[k] == h
                value = np.where(found, self.score[k], self.unknown if start == end - 1 else -np.inf) + best[:, start]
                better = value > best[:, end]
                best[:, end] = np.where(better, value, best[:, end])
                back[:, end] = np.where(better, start, back[:, end])
                piece[:, end] = np.where(better, np.where(found, self.id[k], -1), piece[:, end])
        row, at, path = np.arange(m), np.full(m, n), []
        while at.any():
            p = np.where(at > 0, piece[row, at], -2)
            lost = p == -1
            if lost.any():
                p[lost] = -3 - cp[lost, at[lost] - 1].astype(np.int64)
            path.append(p)
            at = np.where(at > 0, back[row, at], 0)
        ids = np.array(path[::-1]).T
        keep = ids != -2
        out = np.split(ids[keep], np.cumsum(keep.sum(1))[:-1])
        for i in np.flatnonzero((ids <= -3).any(1)):
            out[i] = np.array([x for p in out[i].tolist() for x in ([p] if p >= 0 else self.byte[list(chr(-3 - p).encode())].tolist())])
        return out

    def long_word(self, cp: np.ndarray) -> np.ndarray:
        """viterbi() of one very long word: its pieces are looked up length by length, then ends are passed once."""
        n = len(cp)
        s = self._sums(cp)
        _, q = powers(n + 1)
        hits: list[list] = [[] for _ in range(3)]
        for size in range(min(self.longest, n), 0, -1):
            start = np.arange(n - size + 1)
            h = (s[size:] - s[: n - size + 1]) * q[: n - size + 1]
            k = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            at = np.flatnonzero(self.key[k] == h)
            for c, v in zip(hits, (start[at] + size, np.full(len(at), size), k[at])):
                c.append(v)
        end, size, k = (np.concatenate(c) for c in hits)
        order = np.argsort(end, kind="stable")  # of one end, the longest piece first: it wins a tie
        end, size = end[order], size[order].tolist()
        score, ids = self.score[k[order]].tolist(), self.id[k[order]].tolist()
        edge = np.searchsorted(end, np.arange(n + 2)).tolist()
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            top, b, p = -np.inf, e - 1, -1
            for j in range(edge[e], edge[e + 1]):
                v = score[j] + best[e - size[j]]
                if v > top:
                    top, b, p = v, e - size[j], ids[j]
            single = edge[e] < edge[e + 1] and size[edge[e + 1] - 1] == 1
            if not single and self.unknown + best[e - 1] > top:
                top, b, p = self.unknown + best[e - 1], e - 1, -1
            best[e], back[e], piece[e] = top, b, p
        out, e = [], n
        while e:
            out += [piece[e]] if piece[e] >= 0 else self.byte[list(chr(int(cp[e - 1])).encode())].tolist()[::-1]
            e = back[e]
        return np.array(out[::-1], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.prefix + t.replace(" ", MARK) if t else "" for t in texts]
        off = np.zeros(len(plain) + 1, np.int64)
        np.cumsum([len(t) for t in plain], out=off[1:])
        cp = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            return [np.zeros(0, np.uint32)] * len(texts)
        cut = np.zeros(n + 1, bool)
        if self.split:
            mark = cp == ord(MARK)
            cut[1:n] = mark[1:] & ~mark[:-1]
        cut[off] = True
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n)
        s = self._sums(cp)
        _, q = powers(n + 1)
        h = (s[end] - s[start]) * q[start]
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        missing = np.arange(len(uniq))
        if len(self.known):
            slot = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            missing = np.flatnonzero(self.known[slot] != uniq)
            if len(missing) and len(self.known) > KEPT:
                self.forget()
                missing = np.arange(len(uniq))
        if len(missing):
            a, size = start[first[missing]], (end - start)[first[missing]]
            order, got = np.argsort(size, kind="stable"), [None] * len(missing)
            cuts = np.flatnonzero(np.append(True, np.diff(size[order]) != 0))
            for i, j in zip(cuts, np.append(cuts[1:], len(order))):
                length = int(size[order[i]])
                if length > LONG:
                    for w in order[i:j]:
                        got[w] = self.long_word(cp[a[w] : a[w] + length])
                    continue
                step = max(1, 400_000 // (length + 1))
                for k in range(i, j, step):
                    pick = order[k : min(k + step, j)]
                    for w, ids in zip(pick, self.viterbi(cp[a[pick][:, None] + np.arange(length)])):
                        got[w] = ids
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, *got])
            known = np.concatenate([self.known, uniq[missing]])
            order = np.argsort(known, kind="stable")
            self.known, self.at = known[order], np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, sizes])[order]
        slot = np.searchsorted(self.known, uniq)
        at, size = self.at[slot][inv], self.size[slot][inv]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))].astype(np.uint32)
        bound = np.concatenate([[0], ends])[np.searchsorted(start, off)]
        return [ids[bound[i] : bound[i + 1]] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for every row: the piece ids of its whole text (an array of ints).

    Null or empty text: no ids. Null and repeated ids: each row on its own. Empty input: no rows.
    """

    def run(batches):
        c = codec(model)
        for b in batches:
            out = []
            for _, texts in text_runs(b.column(1)):
                out += c.encode(texts)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from arrays of ids; null ids give null, none an empty text."""

    def run(batches):
        c = codec(model)
        for b in batches:
            out = [None if x is None else c.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(releasing(run), "id long, text string").withColumnRenamed("id", id_col)


_DIGEST = pa.schema([("id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("round_trip", pa.bool_())])


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``n_ids``, ``ids_crc32`` (little-endian 32-bit), ``text_crc32`` of the decoded text, and whether it is the text.

    Null or empty text: no ids, the CRC of nothing; which is its own round trip. Null and repeated ids: each row on its own. Empty input: no rows. Other columns are ignored.
    """

    def run(batches):
        c = codec(model)
        for b in batches:
            out = []
            for _, texts in text_runs(b.column(1)):
                for t, ids in zip(texts, c.encode(texts)):
                    back = c.decode(ids)
                    out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == t))
            n, x, y, z = zip(*out) if out else ((), (), (), ())
            yield batch({"id": b.column(0).cast(pa.int64()), "n_ids": n, "ids_crc32": x, "text_crc32": y, "round_trip": z}, _DIGEST)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)
