"""Quality of texts: a byte-level convolutional network in numpy.

Learned filters run over overlapping chunks that cover the whole text; each chunk keeps every filter's largest answer, and
a text the mean and the largest of its chunks'. Two layers make one probability of them, calibrated on examples apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import free_names, map_blocks, map_texts, written

#: Bytes that a filter sees, numbers that stand for a byte, filters, units of the layer that joins them.
WIDTH, DEPTH, FILTERS, HIDDEN = 8, 8, 32, 16
#: Places at which windows of a chunk begin. A chunk holds WIDTH - 1 bytes more, those of the next one's begin.
CHUNK = 512
#: Rounds over the sample and steps at least, texts a step, rate and decay of the weights.
EPOCHS, STEPS, GROUP, RATE, DECAY = 12, 500, 24, 0.01, 1e-4
#: Bounds of the fitting sample: different texts of each label, and chunks, spread over the text, of each of them.
MAX_PER_LABEL, MAX_CHUNKS = 1000, 32
#: Score from which on a text counts as good.
THRESHOLD = 0.3
#: What stands after a text's end.
PAD = 256


@dataclass
class Network:
    """``table``: numbers of each byte, zeros for ``PAD``; ``filters``: (WIDTH x DEPTH, FILTERS); ``shift``: what a filter's answer must pass;
    ``joined`` and ``level``: the layer over the chunks' means and the largest ones; ``out``: weights of its units; ``scale`` and ``prior`` calibrate."""

    table: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    joined: np.ndarray
    level: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    prior: float = 0.0

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        table = rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32)
        table[PAD] = 0
        filters = rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        return Network(table, filters, np.zeros(FILTERS, np.float32), rng.normal(0, FILTERS**-0.5, (2 * FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.25, HIDDEN).astype(np.float32), 0.0)

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Each filter's answer at each place; ``codes`` of n + WIDTH - 1 bytes give n places, n divisible by WIDTH.

        The bytes' numbers, laid out in a row, are cut at every WIDTH-th byte from each of WIDTH beginnings: every cut is a
        matrix as it lies there, and no window is copied.
        """
        n = len(codes) - WIDTH + 1
        flat = self.table[codes].reshape(-1)
        out = np.empty((n // WIDTH, WIDTH, FILTERS), np.float32)
        for r in range(WIDTH):
            np.matmul(flat[r * DEPTH : r * DEPTH + n * DEPTH].reshape(n // WIDTH, WIDTH * DEPTH), self.filters, out=out[:, r])
        return out.reshape(n, FILTERS)

    def chunk_answers(self, codes: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each chunk; ``codes`` of k CHUNK + WIDTH - 1 bytes give k chunks."""
        k = (len(codes) - WIDTH + 1) // CHUNK
        out = np.empty((k, FILTERS), np.float32)
        step = 32
        for a in range(0, k, step):
            b = min(k, a + step)
            out[a:b] = self.answers(codes[a * CHUNK : b * CHUNK + WIDTH - 1]).reshape(b - a, CHUNK, FILTERS).max(1)
        return out

    def pooled(self, best: np.ndarray) -> np.ndarray:
        """What passes of the largest answers. Windows of nothing but ``PAD`` answer 0, so a place after the end counts as that."""
        return np.tanh(np.maximum(np.maximum(best, 0) - self.shift, 0))

    def logits(self, passed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text, of its chunks' pooled answers; text i has the chunks first[i] to first[i + 1] - 1."""
        mean = np.add.reduceat(passed, first[:-1], axis=0) / np.diff(first)[:, None]
        top = np.maximum.reduceat(passed, first[:-1], axis=0)
        return np.tanh(np.concatenate([mean, top], 1) @ self.joined + self.level) @ self.out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) * self.scale + self.prior, -700, 700)))


def chunks(size: int) -> int:
    """Chunks of a text of so many bytes and what stands before it; an empty one has one."""
    return ceil((size + WIDTH - 1) / CHUNK)


def laid_out(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): texts one after the other, each in chunks of its own, with ``PAD`` before and after it.

    A text begins WIDTH - 1 places after its first chunk does, so that no window holds bytes of two texts, and what a text's
    windows hold hangs on the text alone.
    """
    sizes = np.diff(bounds)
    first = np.append(0, np.cumsum([chunks(n) for n in sizes.tolist()]))
    codes = np.full(first[-1] * CHUNK + WIDTH - 1, PAD, np.uint16)
    at = np.repeat(first[:-1] * CHUNK + WIDTH - 1 - bounds[:-1], sizes) + np.arange(len(raw))
    codes[at] = raw
    return codes, first


def scores(network: Network, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of each text, all of its bytes seen."""
    codes, first = laid_out(raw, bounds)
    return network.probabilities(network.logits(network.pooled(network.chunk_answers(codes)), first))


# Learning


class _Adam:
    def __init__(self, parts: list[np.ndarray]) -> None:
        self.m = [np.zeros_like(p) for p in parts]
        self.v = [np.zeros_like(p) for p in parts]
        self.t = 0

    def step(self, parts: list[np.ndarray], slopes: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, g, m, v in zip(parts, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) + DECAY * p)


def slopes(network: Network, codes: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean log loss, its slopes by table, filters, shift, joined, level, out and bias). Only windows that gave a chunk's largest answer have a part in it."""
    k = int(first[-1])
    answers = network.answers(codes).reshape(k, CHUNK, FILTERS)
    where = answers.argmax(1)
    best = np.take_along_axis(answers, where[:, None], 1)[:, 0]
    passed = network.pooled(best)
    n = np.diff(first)
    mean = np.add.reduceat(passed, first[:-1], axis=0) / n[:, None]
    top = np.maximum.reduceat(passed, first[:-1], axis=0)
    features = np.concatenate([mean, top], 1)
    units = np.tanh(features @ network.joined + network.level)
    z = units @ network.out + network.bias
    p = 1 / (1 + np.exp(-z))
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    dz = ((p - labels) / len(labels)).astype(np.float32)
    of = np.repeat(np.arange(len(n)), n)
    d_units = dz[:, None] * network.out * (1 - units * units)
    d_features = d_units @ network.joined.T
    is_top = passed == top[of]
    share = np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0)  # equal largest ones share
    d_passed = (d_features[:, :FILTERS] / n[:, None])[of] + is_top * (d_features[:, FILTERS:] / share)[of]
    d_in = d_passed * (1 - passed * passed) * (np.maximum(best, 0) > network.shift)
    d_best = d_in * (best > 0)
    place = where + (np.arange(k) * CHUNK)[:, None]
    seen = codes[place[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte of the window
    windows = network.table[seen].reshape(k, FILTERS, -1)
    d_filters = np.einsum("cf,cfk->kf", d_best, windows)
    d_table = np.zeros_like(network.table)
    back = d_best[:, :, None] * network.filters.T[None]
    np.add.at(d_table, seen.reshape(-1), back.reshape(-1, DEPTH))
    d_table[PAD] = 0
    return loss, [d_table, d_filters, -d_in.sum(0), features.T @ d_units, d_units.sum(0), units.T @ dz, np.float32(dz.sum())]


def fit(texts: list[bytes], labels: np.ndarray, weight: float, seed: int = 5) -> Network:
    """A network of labelled texts, in whose place a 1 stands for ``weight`` ones and a 0 for one when it's calibrated.

    A fifth of the texts serve for calibration alone. With texts of one label, or none, every text gets that label's share.
    """
    rng = np.random.default_rng(seed)
    network = Network.fresh(rng)
    if len(set(labels.tolist())) < 2 or len(labels) < 10:
        share = (weight * labels.sum() + 1) / (weight * labels.sum() + (labels == 0).sum() + 2)
        network.scale, network.prior = 0.0, float(np.log(share / (1 - share)))
        return network
    held = np.zeros(len(labels), bool)
    for value in (0, 1):
        held[(labels == value).nonzero()[0][::5]] = True
    sides = [(~held & (labels == value)).nonzero()[0] for value in (0, 1)]
    size = 2 * max(map(len, sides))
    adam, t = None, 0
    epochs = max(EPOCHS, ceil(STEPS * GROUP / size))
    steps = epochs * ceil(size / GROUP)
    for _ in range(epochs):
        # As many of either label in a group; the rarer one's texts come again and again.
        order = np.stack([np.concatenate([rng.permutation(x) for _ in range(ceil(size / 2 / len(x)))])[: size // 2] for x in sides], 1).reshape(-1)
        for a in range(0, size, GROUP):
            group = order[a : a + GROUP].tolist()
            bounds = np.append(0, np.cumsum([len(texts[i]) for i in group]))
            codes, first = laid_out(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), bounds)
            _, found = slopes(network, codes, first, labels[group].astype(np.float32))
            bias = np.array([network.bias], np.float32)
            parts = [network.table, network.filters, network.shift, network.joined, network.level, network.out, bias]
            adam = adam or _Adam(parts)
            adam.step(parts, [*found[:-1], found[-1].reshape(1)], RATE * (1 - t / steps))
            network.table[PAD] = 0
            network.bias = float(bias[0])
            t += 1
    logits = np.array([_logit(network, texts[i]) for i in held.nonzero()[0].tolist()])
    network.scale, network.prior = _calibrated(logits, labels[held], weight)
    return network


def _logit(network: Network, text: bytes) -> float:
    codes, first = laid_out(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return float(network.logits(network.pooled(network.chunk_answers(codes)), first)[0])


def _calibrated(logits: np.ndarray, labels: np.ndarray, weight: float) -> tuple[float, float]:
    """(scale, shift) of least weighted log loss, by Newton's method with a weak pull of the scale to 1."""
    w = np.where(labels == 1, weight, 1.0)
    w /= w.mean()
    x = np.array([1.0, np.log(max(weight, 1e-6))])
    rows = np.stack([logits, np.ones(len(logits))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ x, -500, 500)))
        slope = rows.T @ (w * (p - labels)) + np.array([x[0] - 1, 1e-3 * x[1]])
        bend = (rows * (w * p * (1 - p))[:, None]).T @ rows + np.diag([1.0, 1e-3])
        move = np.linalg.solve(bend, slope)
        x = x - move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
    return float(max(x[0], 0.0)), float(x[1])


def _spread_chunks():
    """Of longer texts, ``MAX_CHUNKS`` whole chunks at even distances."""

    def work(texts):
        out = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            k = chunks(len(raw))
            at = range(k) if k <= MAX_CHUNKS else np.linspace(0, k - 1, MAX_CHUNKS).astype(int).tolist()
            out.append(raw if k <= MAX_CHUNKS else b"".join(raw[c * CHUNK : (c + 1) * CHUNK] for c in at))
        return [out]

    return work


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_label: int = MAX_PER_LABEL) -> Network:
    """A network of the documents that have a label of 0 or 1 in ``labels``; others, and null labels, teach nothing.

    The fitting sample holds up to ``max_per_label`` different texts of each label, chosen by a hash of the text, so that
    copies count once, and up to ``MAX_CHUNKS`` chunks of each, spread over the whole text. It is fitted on the driver (32 MB
    at most). The labels' frequencies, for the calibration, are those of all labelled documents.
    """
    own, text = F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    marks = labels.where(F.col(label_col).isin(0, 1)).select(own, F.col(label_col).cast("int").alias("label")).distinct()
    hashed = docs.select(own, F.xxhash64(text).alias("hash")).join(marks, "id")
    distinct = written(hashed.groupBy("label", "hash").agg(F.min("id").alias("id"), F.count("*").alias("n")), "quality-labels")
    sizes = {r.label: r.n for r in distinct.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # two rows
    # Per label, those of the smallest hashes: twice what is wanted on average come in, the rest goes before the window.
    number = {r.label: r.n for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in number.items():
        share = F.when(F.col("label") == label, min(1.0, 2 * max_per_label / n + 20 / n)).otherwise(share)
    order = F.xxhash64(F.lit(7), "hash")
    near = distinct.where(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(order, F.lit(1 << 20)), "hash"))
    chosen = near.withColumn("place", place).where(F.col("place") <= max_per_label).select("id", "label", "hash")
    wanted = F.broadcast(chosen)  # max_per_label rows of each label
    rows = docs.select(own, text).join(wanted, "id").where(F.xxhash64("text") == F.col("hash"))
    sample = map_texts(rows, "text", ["id", "label", "hash"], [T.StructField("bytes", T.BinaryType())], _spread_chunks)
    sample = sample.dropDuplicates(["label", "hash"]).orderBy("hash", "label").collect()
    texts, marks = [bytes(r["bytes"]) for r in sample], np.array([r.label for r in sample], np.int64)
    ones, zeros = (max(1, int((marks == v).sum())) for v in (1, 0))
    weight = (sizes.get(1, 0) / ones) / max(1e-9, sizes.get(0, 0) / zeros) if sizes.get(0) and sizes.get(1) else 1.0
    return fit(texts, marks, weight)


def score(docs: DataFrame, network: Network, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with score, the calibrated probability of label 1 by the whole text, and predicted, 1 from
    ``threshold`` on. Null texts score as empty ones, by the network's answer to nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    def make():
        network = shared.value
        return lambda raw, bounds: (None, [scores(network, raw, bounds)])

    found = map_blocks(docs, text_col, keep, [T.StructField(free_names(keep, "score")[0], T.DoubleType())], make)
    name = found.columns[-1]
    return found.withColumn(free_names(keep, "predicted")[0], (F.col(name) >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose label is never learned: crc32(id as text) mod 5 is 0. A null id counts as learnable, but has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every document, by a network of the labelled ones that are not held out.

    Repeated rows are scored alike; an empty table gives no row; without labels every score is one half.
    """
    network = train(docs.where(~held_out(id_col)), labels, id_col, text_col, label_col)
    return score(docs.select(id_col, text_col).withColumn("held_out", held_out(id_col)), network, [id_col, "held_out"], text_col)
