"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words, and their first four and six letters (which catch compounds), hashed
into 2**BITS slots. The score is the logistic function of a bias, a weight for each term, and the inner product of the
factors of each two terms, so pairs of terms may say more than their weights add up to.

The model is fitted with numpy on the driver, on at most SAMPLE labelled documents chosen by a hash of the id. Their
terms are hashed on the executors; slot numbers and labels are all that the driver receives. The fitted model has a fixed
size and is broadcast. Texts are scored whole.

A null or empty text, or one without letters, scores as an empty set of terms does. Labels that are null are left out; of
a document's several labels the largest counts. Without any usable label every score is 0.5 minus a little, so nothing
is rejected. Repeated rows get the same score, whatever texts are scored with them; an empty table gives an empty result. A
column that has the name of the score is replaced, other columns are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import hash_sample, id_bucket, ship, table

BITS = 18
#: Factors of a term.
FACTORS = 4
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 10_000
#: Terms in fewer documents of the sample are not learned, however large it is; noise above that is left to the penalties.
LEAST_DOCS = 3
EPOCHS = 10
#: Words that a worker remembers with their slots before it starts anew.
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")

_slots: dict[str, tuple[int, ...]] = {}


def _of_word(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    found = tuple(zlib.crc32(x.encode("utf-8", "replace")) & mask for x in ("w" + word, "4" + word[:4], "6" + word[:6]))
    if len(_slots) >= CACHE:
        _slots.clear()
    if len(word) < 40:
        _slots[word] = found
    return found


def slots_of(text: str | None) -> list[int]:
    """The distinct slots of a whole text's terms, sorted."""
    found: set[int] = set()
    for word in set(LETTERS.findall((text or "").lower())):
        found.update(_slots.get(word) or _of_word(word))
    return sorted(found)


class Machine:
    """bias + sum of w[i] + sum over pairs of <v[i], v[j]>, for the slots i of a text."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logits(self, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of texts whose slots stand one after the other; ends has where each text's end."""
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        sums = lambda x: np.bincount(of, x, len(ends))  # noqa: E731  text by text, whatever its neighbours
        z = self.bias + sums(self.w[slots])
        for f in range(self.v.shape[1]):
            x = self.v[slots, f].astype(np.float64)
            z += 0.5 * (sums(x) ** 2 - sums(x * x))
        return z

    def scores(self, texts: list[str | None]) -> np.ndarray:
        slots = [slots_of(t) for t in texts]
        ends = np.cumsum([len(s) for s in slots], dtype=np.int64)
        flat = np.fromiter((i for s in slots for i in s), np.int64, int(ends[-1]) if len(ends) else 0)
        return 1 / (1 + np.exp(-np.clip(self.logits(flat, ends), -30, 30)))


def calibrated(z: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the logits z, by damped Newton steps (Platt scaling)."""
    yes, no = labels.sum(), len(labels) - labels.sum()
    wanted = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    spread = max(float(np.std(z)), 1e-9)
    x, at = np.stack([z / spread, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - wanted))
        at -= step / max(1.0, float(np.abs(step).max()))
    return float(at[0]) / spread, float(at[1])


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, seed: int = 0) -> Machine:
    """Fits a machine to sorted slot arrays and 0/1 labels by AdaGrad on the logistic loss.

    Weights have an L1 penalty that shrinks with the sample, which leaves most at 0; factors have an L2 penalty and
    smaller steps. The logits are calibrated at the end, so that 0.5 lies between the labels also if one of them is rare.
    """
    size = 1 << BITS
    w, v = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    if len(rows) == 0:
        return Machine(-0.01, w, v)
    n = len(rows)
    counts = np.zeros(size, np.int64)
    for at in range(0, n, 500):
        counts += np.bincount(np.concatenate(rows[at : at + 500]), minlength=size)
    kept = np.flatnonzero(counts >= LEAST_DOCS)
    k = len(kept)
    dense = np.full(size, -1, np.int32)
    dense[kept] = np.arange(k, dtype=np.int32)
    rows = [(d := dense[r])[d >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    l1, l2 = 0.06 / n**0.5, 0.01
    b, bg = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))), 1e-8
    lw, lv = np.zeros(k), rng.normal(0, 0.001, (k, factors))
    gw, gv = np.full(k, 1e-6), np.full((k, factors), 1e-6)

    def logits(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
        x = np.concatenate([rows[i] for i in part])
        vx = lv[x]
        total = np.stack([np.bincount(of, vx[:, f], len(part)) for f in range(factors)], axis=1)
        squares = np.bincount(of, (vx * vx).sum(axis=1), len(part))
        z = b + np.bincount(of, lw[x], len(part)) + 0.5 * ((total**2).sum(axis=1) - squares)
        return z, of, x, total[of] - vx

    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            part = order[at : at + 256]
            z, of, x, pull = logits(part)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            bg += g.sum() ** 2
            b -= rate * g.sum() / bg**0.5
            gx = g[of]
            d = np.bincount(x, gx, k)
            gw += d * d
            step = rate / np.sqrt(gw)
            lw -= step * d
            lw = np.sign(lw) * np.maximum(np.abs(lw) - step * l1, 0)
            for f in range(factors):
                d = np.bincount(x, gx * pull[:, f], k)
                gv[:, f] += d * d
                lv[:, f] -= 0.05 * rate / np.sqrt(gv[:, f]) * (d + l2 * lv[:, f])
    z = np.concatenate([logits(np.arange(at, min(n, at + 256)))[0] for at in range(0, n, 256)])
    slope, offset = calibrated(z, labels)
    # A slope times the pair term is that of factors times the slope's root; a slope that isn't positive says nothing was learned.
    slope = max(slope, 1e-6)
    w[kept], v[kept] = slope * lw, slope**0.5 * lv
    return Machine(slope * b + offset, w, v)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted to at most sample labelled documents; docs has the documents that may be learned from."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    ids = docs.select(F.col(id_col).alias("__id")).join(known, "__id").dropDuplicates(["__id"])
    chosen = hash_sample(ids, F.col("__id"), sample)  # at most sample pairs of numbers, so small enough to broadcast
    # Bytes, since a list of Python integers would take the driver ten times the memory.
    hashed = F.pandas_udf(lambda texts: pd.Series([np.asarray(slots_of(t), np.int32).tobytes() for t in texts], dtype="object"), "binary")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    got = rows.select("__id", "__label", hashed("__text").alias("slots")).toPandas().sort_values("__id", kind="stable").drop_duplicates("__id")
    return train([np.frombuffer(s, np.int32) for s in got["slots"]], got["__label"].to_numpy(np.float64))


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of scores."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Machine(*model.value)
        for texts in batches:
            parts = [m.scores(texts.iloc[i : i + 500].tolist()) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score_col, score(F.col(text_col)))


def learnable(doc_id: Column) -> Column:
    """The rows whose labels may be learned from."""
    return id_bucket(doc_id, 5) != 0


def fitted_machine(spark: SparkSession, sf_dir: str) -> Machine:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(learnable(F.col("doc_id")))
    return fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted_machine(spark, sf_dir))
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
