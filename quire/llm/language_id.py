"""Language identification with a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, the last one padded. Filters of several widths run over each
window, their maxima over the window are the features of a softmax layer, and the mean of the windows' probabilities, by
their bytes, is the text's. A filter is a table of a number for each of its positions and byte values, so a
convolution is a sum of table rows.

The network is trained with numpy on the driver, on windows drawn from at most SAMPLE documents chosen by a hash of the
id; executors cut the windows, so the driver receives SAMPLE * CROPS * WINDOW characters at most. The trained network has
a fixed size and is broadcast. Texts are predicted whole, in batches of windows.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned. Rows
whose language is null are not learned from. Ties go to the language that comes first by code point. Repeated rows get
the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import hash_sample, id_bucket, ship, table

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents that windows are drawn from, at most, and windows of each.
SAMPLE = 6_000
CROPS = 4
EPOCHS = 8
#: Windows that are convolved at once.
BATCH = 256
UNKNOWN = "und"


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of whole texts, the text that each is of, and how many of its bytes are not padding."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    n = [max(1, -(-len(d) // WINDOW)) for d in data]
    flat = np.frombuffer(b"".join(d.ljust(k * WINDOW, b"\0") for d, k in zip(data, n, strict=True)), np.uint8)
    w = flat.reshape(-1, WINDOW)
    return w, np.repeat(np.arange(len(texts)), n), (w != 0).sum(axis=1)


class Network:
    """tables[i]: (width, 256, FILTERS); bias, out (features x languages) and out_bias."""

    def __init__(self, languages: list[str], tables: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
        self.languages, self.tables, self.bias, self.out, self.out_bias = languages, tables, bias, out, out_bias

    def pooled(self, w: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The filters' maxima over each window, and at which byte they are if where is set."""
        most, places = [], []
        for t in self.tables:
            k = len(t)
            x = np.take(t[0], w[:, : WINDOW - k + 1], axis=0)
            for j in range(1, k):
                x += np.take(t[j], w[:, j : WINDOW - k + 1 + j], axis=0)
            if where:
                places.append(x.argmax(axis=1))
            most.append(x.max(axis=1))
        return np.concatenate(most, axis=1) + self.bias, np.concatenate(places, axis=1) if where else None

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.pooled(w[i : i + BATCH])[0], 0) @ self.out + self.out_bias for i in range(0, len(w), BATCH)]
        z = np.concatenate(parts).astype(np.float64)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and its probability, for texts with letters."""
        if not texts:
            return [], np.zeros(0)
        w, of, size = windows(texts)
        p = self.probabilities(w) * np.maximum(size, 1)[:, None]
        total = np.stack([np.bincount(of, p[:, c], len(texts)) for c in range(len(self.languages))], axis=1)
        total /= np.bincount(of, np.maximum(size, 1), len(texts))[:, None]
        best = total.argmax(axis=1)
        return [self.languages[i] for i in best], total[np.arange(len(texts)), best]


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = 0.05, seed: int = 0) -> Network:
    """Fits the network to short texts by AdaGrad on the softmax loss. Each text gives its first window and a short one."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in langs], int)
    short = [t[: int(rng.integers(4, 40))] for t in texts]
    w = np.concatenate([windows([t.encode()[:WINDOW].decode("utf-8", "ignore")])[0][:1] for t in [*texts, *short]]) if texts else np.zeros((0, WINDOW), np.uint8)
    y = np.concatenate([y, y])
    f = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS], np.zeros(f, np.float32), rng.normal(0, 0.1, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    for t in net.tables:
        t[:, 0, :] = -1.0  # padding never wins
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (*net.tables, net.bias, net.out, net.out_bias)]

    def step(i: int, x: np.ndarray, g: np.ndarray) -> None:
        sums[i] += g * g
        x -= rate * g / np.sqrt(sums[i])

    for _ in range(epochs):
        order = rng.permutation(len(w))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            x = w[part]
            h, places = net.pooled(x, where=True)
            a = np.maximum(h, 0)
            z = a @ net.out + net.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = (p @ net.out.T) * (h > 0)
            rows = np.arange(len(part))[:, None]
            for i, t in enumerate(net.tables):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                g = np.zeros_like(t)
                filters = np.broadcast_to(np.arange(FILTERS), back[:, cols].shape)
                for j in range(len(t)):
                    np.add.at(g[j], (x[rows, places[:, cols] + j], filters), back[:, cols])
                g[:, 0, :] = 0
                step(i, t, g)
            n = len(net.tables)
            step(n, net.bias, back.sum(axis=0))
            step(n + 1, net.out, a.T @ p)
            step(n + 2, net.out_bias, p.sum(axis=0))
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """A network fitted to windows of at most sample documents of docs; None if none has a language and a letter."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    start = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    crops = F.array_distinct(F.array(*[F.substring(F.col("text"), start(i), F.lit(WINDOW)) for i in range(CROPS)]))
    # Texts are cut before the sample is drawn: no task holds whole texts of many documents.
    cut = usable.select(F.struct("id", F.length("text").alias("length")).alias("key"), "lang", crops.alias("crops"))
    chosen = hash_sample(cut, F.col("key"), sample)
    got = chosen.select("lang", F.explode("crops").alias("crop")).where(F.col("crop").rlike(r"\p{L}")).toPandas().sort_values(["lang", "crop"])
    return train(got["crop"].tolist(), got["lang"].tolist()) if len(got) else None


def identified(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names."""
    rest = docs.drop("lang_pred", "score")
    if net is None:
        return rest.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((net.languages, net.tables, net.bias, net.out, net.out_bias))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Network(*model.value)
        for texts in batches:
            langs, scores = [], [np.zeros(0)]
            for i in range(0, len(texts), 100):
                a, b = m.predict(texts.iloc[i : i + 100].tolist())
                langs += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype="object"), "score": np.concatenate(scores)})

    text = F.col(text_col)
    lettered = text.isNotNull() & text.rlike(r"\p{L}")
    out = rest.withColumn("__p", predict(F.coalesce(text, F.lit(""))))
    return out.withColumn("lang_pred", F.when(lettered, F.col("__p.lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(lettered, F.least(F.lit(1.0), F.col("__p.score"))).otherwise(0.0)).drop("__p")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.select("doc_id", "text", "lang").where(id_bucket(F.col("doc_id"), 3) != 1))
    out = identified(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op5_language_id": op5_language_id}
