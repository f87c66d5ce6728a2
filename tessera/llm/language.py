"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training texts; the weights are fitted by follow-the-regularised-leader
with an elastic net on a bounded sample of them, and a temperature makes the probabilities calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_texts, small_batches

UNDETERMINED = "und"
#: Hashed features; n-grams of these sizes.
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Bound of the fitting sample, per language; a fifth of it serves the temperature.
MAX_PER_LANGUAGE = 800
EPOCHS = 3
#: Rate, smoothing and the elastic net's L1 and L2 weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Texts are worked on in runs of about this many characters.
RUN_CHARS = 1 << 20


def _letters() -> np.ndarray:
    """Per code point: its lower case where it is a letter, else 0 (one space)."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class NGrams:
    """Bucket of every n-gram of a text; runs of other characters than letters count as one space."""

    def __init__(self) -> None:
        self.letters = _letters()

    def codes(self, text: str) -> np.ndarray:
        """Per character its letter's code, or 0."""
        return self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(buckets, counts) of the whole text, None where it has no letter.

        Worked on run by run; the last codes of a run go before the next one's, whose n-grams are those that end in it.
        """
        if not text:
            return None
        total = np.zeros(BUCKETS, np.int64)
        letters, known = False, np.zeros(0, np.uint32)
        for at in range(0, len(text), RUN_CHARS):
            code = self.codes(text[at : at + RUN_CHARS])
            letters = letters or bool(code.any())
            ends = [np.zeros(int(at == 0), np.uint32), code, np.zeros(int(at + RUN_CHARS >= len(text)), np.uint32)]
            code = np.concatenate([known, *ends])
            one = np.append(True, (code[1:] != 0) | (code[:-1] != 0))  # a row of spaces is one
            code = code[one]
            key = np.zeros(len(code), np.uint32)
            for n in range(1, max(SIZES) + 1):
                key = (key[: len(code) - n + 1] * np.uint32(0x01000193))[: max(0, len(code) - n + 1)] ^ code[n - 1 :]
                new = key[max(0, len(known) - n + 1) :]
                if n in SIZES and len(new):
                    total += np.bincount(((new + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15), minlength=BUCKETS)
            known = code[-(max(SIZES) - 1) :]
        if not letters:
            return None
        index = total.nonzero()[0]
        return index, total[index]


def tf_idf(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length weights, (1 + log count) x idf."""
    x = (1 + np.log(counts)) * idf[index]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((tf_idf(index, counts, self.idf) @ self.weights[index] + self.bias) / self.temperature)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2; weights under L1 stay exactly 0."""

    def __init__(self, features: int, classes: int) -> None:
        self.z = np.zeros((features + 1, classes))  # the last row is the bias
        self.n = np.zeros((features + 1, classes))

    def weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.append(index.astype(np.int64), len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / ALPHA
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the training texts that have it, over all of them, and their number."""
    small_batches(texts.sparkSession)

    def count(batches):
        import pyarrow as pa

        grams, df, n = NGrams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := grams.counts(text)) is not None:
                    df[found[0]] += 1
                    n += 1
        index = df.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, BUCKETS), pa.int64()), pa.array(np.append(df[index], n), pa.int64())], names=["bucket", "n"])

    total = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for row in total:  # at most one row per bucket
        df[row.bucket] = row.n
    return df[:BUCKETS], int(df[BUCKETS])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """A model of the languages in ``labelled``, whose rows without label, text or letters teach nothing.

    The fitting sample holds up to ``max_per_language`` different texts of each language, chosen by a hash of the
    text: copies count once. Of equally labelled texts the hash decides, whatever their place in the table. Without
    any labelled text the model has no language.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    df, n = _document_frequency(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    # Twice what is wanted, on average, of all texts; copies come in together or not at all and are one text then.
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 2 * max_per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(chance < F.element_at(share, F.col("label"))).withColumn("order", F.xxhash64(F.lit(7), "text"))
    counted = map_texts(chosen, "text", ["label", "order"], [T.StructField("index", T.BinaryType()), T.StructField("counts", T.BinaryType())], _count_maker)
    different = counted.where("index is not null").groupBy("label", "order").agg(F.min(F.struct("index", "counts")).alias("f")).select("label", "order", "f.*")
    place = F.row_number().over(Window.partitionBy("label").orderBy("order"))
    sample = different.withColumn("place", place).where(F.col("place") <= max_per_language).orderBy("order", "label").collect()
    known = {k: i for i, k in enumerate(languages)}
    examples = []
    while sample:  # rows go as they are turned into features
        row = sample.pop()
        index = np.frombuffer(row["index"], np.uint16)
        examples.append((index, tf_idf(index, np.frombuffer(row["counts"], np.uint32), idf).astype(np.float32), known[row["label"]]))
    examples.reverse()
    held = max(1, len(examples) // 5) if len(examples) > 4 else 0
    model = Ftrl(BUCKETS, len(languages))
    for _ in range(EPOCHS):
        for index, x, label in examples[held:]:
            model.step(index, x, label)
    weights = model.weights(np.arange(BUCKETS + 1))
    bias, weights = weights[-1], weights[:-1]
    temperature = 1.0
    if held:
        logits = np.array([x @ weights[i] + bias for i, x, _ in examples[:held]])
        temperature = _temperature(logits, np.array([k for _, _, k in examples[:held]]))
    return Model(languages, idf, weights.astype(np.float32), bias, temperature)


def _count_maker():
    grams = NGrams()

    def work(texts):
        found = [grams.counts(t) for t in texts]
        return [[None if f is None else f[i].astype(kind).tobytes() for f in found] for i, kind in enumerate((np.uint16, np.uint32))]

    return work


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred and score, the calibrated probability of that language.

    ``und`` with score 0 where the text is null or has no letter, or where the model has no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the input

    def make():
        grams, model = NGrams(), shared.value

        def work(texts):
            names, scores = [], []
            for text in texts:
                found = grams.counts(text) if model.languages else None
                if found is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    p = model.probabilities(*found)
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            return [names, scores]

        return work

    return map_texts(docs, text_col, keep, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def held_out(id_col: str = "doc_id"):
    """Documents whose language is never learned from: crc32(id as text) mod 3 is 1. A null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, by a model trained on those not held out."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, [id_col, "held_out"], text_col)
