"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by
statistics of its characters and words and by the shares of its words' hash classes; the encoder, the gated attention that
weighs passages and the scorer of the weighted representation are learned
together from document labels alone (gradients by hand, Adam). Fitting takes a
bounded sample of labelled documents; scoring reads every passage of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, releasing, running, span_hash, words

PASSAGE = 64
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".", ",;:", "!?", "#$%&*@^~+=<>_", "|\\/", "'\"()[]{}-`")
#: Classes of hashed words, each with its share of a passage.
WORDS = 64
N_FEATURES = 2 * len(_GROUPS) + 14 + WORDS


def passages(column: pa.Array, size: int = PASSAGE):
    """For runs of texts: (first row, features of every passage, passage bounds of each text).

    A text without words is one passage of zeros. The last passage of a text has what is left.
    """
    for row, data, off in chunks(column):
        start, end, doc = words(data, off)
        n_docs, n = len(off) - 1, len(start)
        count = np.bincount(doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
        bags = np.maximum(1, -(-count // size))
        bound = np.concatenate([[0], np.cumsum(bags)])
        f = np.zeros((int(bound[-1]), N_FEATURES), np.float32)
        if n:
            base = np.cumsum(count) - count
            bag = bound[doc] + (np.arange(n) - base[doc]) // size
            edge = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
            filled = bag[edge]
            total = np.diff(np.append(edge, n)).astype(np.float32)
            a, z = start[edge], end[np.append(edge[1:], n) - 1]
            chars = np.maximum(z - a, 1).astype(np.float32)
            k = 0
            for g in _GROUPS:
                mark = np.zeros(256, bool)
                mark[np.frombuffer(g.encode(), np.uint8)] = True
                hit = mark[data]
                s = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                f[filled, k] = (s[z] - s[a]) / chars
                last = np.add.reduceat(hit[end - 1].astype(np.float32), edge)  # words that end so
                f[filled, k + 1] = last / total
                k += 2
            length = (end - start).astype(np.float32)
            high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
            lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
            h = span_hash(running(LOWER[data]), start, end)
            again = np.zeros(n, np.float32)
            again[1:] = (h[1:] == h[:-1]) & (bag[1:] == bag[:-1])
            mean = np.add.reduceat(length, edge) / total
            key = np.sort((bag.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
            new = np.append(True, key[1:] != key[:-1])
            distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=int(bound[-1]))[filled]
            caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)])
            upper = (caps[end] - caps[start]).astype(np.float32)
            more = [
                np.log1p(total), mean / 8, np.sqrt(np.maximum(np.add.reduceat(length**2, edge) / total - mean**2, 0)) / 8,
                (high[z] - high[a]) / chars, (lines[z] - lines[a]) / total, np.add.reduceat(again, edge) / total, distinct / total,
                np.add.reduceat((upper * 2 > length).astype(np.float32), edge) / total, np.add.reduceat((length == 1).astype(np.float32), edge) / total,
                np.add.reduceat((length <= 3).astype(np.float32), edge) / total, np.add.reduceat((length >= 14).astype(np.float32), edge) / total,
                np.add.reduceat((upper > 0).astype(np.float32), edge) / total, np.log1p(np.maximum.reduceat(length, edge)) / 4, np.ones(len(edge), np.float32)]
            for v in more:
                f[filled, k] = v
                k += 1
            which = np.bincount(bag * WORDS + (h >> np.uint64(58)).astype(np.int64), minlength=int(bound[-1]) * WORDS)
            f[:, k:] = which.reshape(-1, WORDS) / np.maximum(which.reshape(-1, WORDS).sum(1, keepdims=True), 1)
        yield row, f, bound


class Model:
    """h = tanh(x A); attention softmax((tanh(h V) * sigmoid(h U)) w); score sigmoid((attention h) c + b)."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def scores(self, f: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (f - self.mean) / self.scale, bound)[-1]


def _softmax(e: np.ndarray, bound: np.ndarray) -> np.ndarray:
    size = np.diff(bound)
    top = np.maximum.reduceat(e, bound[:-1])
    x = np.exp(e - np.repeat(top, size))
    return x / np.repeat(np.add.reduceat(x, bound[:-1]), size)


def _forward(w, x, bound):
    a0, a, v, u, g, c, b = w
    h = np.tanh(x @ a + a0)
    t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    att = _softmax((t * s * g).sum(1), bound)
    z = np.add.reduceat(att[:, None] * h, bound[:-1], axis=0)
    return h, t, s, att, z, 1 / (1 + np.exp(-np.clip((z * c).sum(1) + b[0], -30, 30)))


def _gradients(w, x, bound, y) -> list[np.ndarray]:
    """Of the mean cross entropy of bags with labels y, by each weight."""
    size = np.diff(bound)
    h, t, s, att, z, p = _forward(w, x, bound)
    _, a, v, u, g, c, _ = w
    dy = (p - y) / len(y)
    big = np.repeat(dy[:, None] * c, size, axis=0)
    datt = (big * h).sum(1)
    de = att * (datt - np.repeat(np.add.reduceat(att * datt, bound[:-1]), size))
    dt, ds = de[:, None] * g * s * (1 - t * t), de[:, None] * g * t * s * (1 - s)
    dh = (att[:, None] * big + dt @ v.T + ds @ u.T) * (1 - h * h)
    return [dh.sum(0), x.T @ dh, h.T @ dt, h.T @ ds, (de[:, None] * t * s).sum(0), (dy[:, None] * z).sum(0), np.array([dy.sum()])]


def fit(bags: list[np.ndarray], label: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 30, rate: float = 5e-3, seed: int = 3) -> Model:
    """Learn from bags of passage features and 0/1 labels; classes count by their size, so scores are probabilities."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    d = every.shape[1]
    w = [np.zeros(hidden), rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, hidden**-0.5, (hidden, gate)),
         rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, gate**-0.5, gate), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m1, m2, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            x, y = np.concatenate([bags[j] for j in pick]), label[pick]
            bound = np.concatenate([[0], np.cumsum([len(bags[j]) for j in pick])])
            grads = _gradients(w, x, bound, y)
            step += 1
            for k, q in enumerate(grads):
                q = q + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.999 * m2[k] + 0.001 * q * q
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


_BAGS = pa.schema([("label", pa.float64()), ("bags", pa.binary())])
_SCORES = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def _encoded(most: int):
    def run(batches):
        for b in batches:
            label, out = b.column(0), []
            for _, f, bound in passages(b.column(1)):
                for a, n in zip(bound, np.diff(bound)):
                    pick = a + (np.arange(n) if n <= most else np.arange(most) * n // most)  # spread over the whole text
                    out.append(f[pick].tobytes())
            yield pa.RecordBatch.from_arrays([label.cast(pa.float64()), pa.array(out, pa.binary())], schema=_BAGS)

    return run


def _fitted(batches):
    import pickle

    bags, label = [], []
    for b in batches:
        label += b.column(0).to_pylist()
        bags += [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES) for x in b.column(1)]
    order = np.argsort([(float(x.sum()) * 1e6) % 997 for x, y in zip(bags, label)], kind="stable")  # whatever order rows came in
    label = np.array(label)
    if len(set(label.tolist())) < 2:
        model = float(label.mean()) if len(label) else 0.5
    else:
        model = fit([bags[i] for i in order], label[order])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 2000, most: int = 200, id_col: str = "doc_id", text_col: str = "text"):
    """A model of ``labels[target]`` (0 or 1), from at most ``sample`` labelled documents of each class.

    The sample is the first by a hash of the id, and of a document of more than ``most`` passages so many
    enter it, spread evenly over the whole text; both bound what one task fits on. Null labels and ids don't
    count; of several labels of one id the lowest does. With one class only, or
    none, the model is that class's constant (or 0.5).
    """
    import pickle

    one = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(id_col).alias("__q_id")).agg(F.min(target).alias("__q_label"))
    order = F.xxhash64(F.col("__q_id"))
    sizes = {r["__q_label"]: r["count"] for r in one.groupBy("__q_label").count().collect()}  # two rows
    # About 2 * sample of each class by hash, then the first of them: no task sorts all labels.
    near = [one.where((F.col("__q_label") == k) & (F.pmod(order, F.lit(max(1, sizes.get(k, 0) // (2 * sample)))) == 0)) for k in (0, 1)]
    some = [x.orderBy(order, "__q_id").limit(sample) for x in near]
    rows = docs.select(F.col(id_col).alias("__q_id"), F.col(text_col).alias("__q_text")).join(F.broadcast(some[0].unionByName(some[1])), "__q_id")
    bags = rows.select("__q_label", "__q_text").mapInArrow(releasing(_encoded(most)), "label double, bags binary")
    # A bounded sample, so one task may hold it.
    return pickle.loads(bags.repartition(1).mapInArrow(releasing(_fitted), "model binary").first()["model"])


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row of ``docs``: the probability of label 1, from the whole text alone.

    Null text scores as an empty one, null and repeated ids as any other row; empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out = np.full(b.num_rows, m if isinstance(m, float) else 0.0)
            if not isinstance(m, float):
                for row, f, bound in passages(b.column(1)):
                    out[row : row + len(bound) - 1] = m.scores(f, bound)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.float64())], schema=_SCORES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "id long, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` at least; nothing is joined back.

    Null text scores as an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            score = np.full(b.num_rows, m if isinstance(m, float) else 0.0)
            if not isinstance(m, float):
                for row, f, bound in passages(b.column(at)):
                    score[row : row + len(bound) - 1] = m.scores(f, bound)
            yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(releasing(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document's label is kept from learning: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels that aren't held out and score all documents: id, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels.where(~held_out(id_col)), sample=sample, id_col=id_col, text_col=text_col)
    out = score_quality(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
