"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through low-rank vectors; the sum over all pairs is computed in
linear time as half the difference between the square of the sum and the sum of squares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, table

WORD_BUCKETS = 1 << 15
RANK = 6
EPOCHS = 8
BATCH = 64
RATE = 0.05
L2 = 1e-5
SEED = 7
#: Labelled rows to learn from, at most: those of the least hashes of doc_id.
SAMPLE_ROWS = 6000
#: Words whose buckets a Python worker remembers.
CACHE_WORDS = 500_000

STATS = ("bias", "log_words", "log_chars", "word_length", "upper", "digit", "symbol", "punctuation", "distinct", "top_word", "lines", "repeated_lines", "short_lines", "declared", "shouted", "marked")


class Features:
    """Feature numbers and values of a text: unit-length hashed words, then the statistics."""

    def __init__(self):
        self.bucket: dict[str, int] = {}

    def __call__(self, text: str, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        new = [w for w in counts if w not in self.bucket]
        if new:
            if len(self.bucket) + len(new) > CACHE_WORDS:
                self.bucket.clear()
                new = list(counts)
            for w in new:
                self.bucket[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS
        index = np.fromiter(map(self.bucket.__getitem__, counts), np.int64, len(counts))
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = np.sqrt((value**2).sum()) or 1.0
        return np.concatenate([index, WORD_BUCKETS + np.arange(len(STATS))]), np.concatenate([value / norm, self.stats(text, words, counts, declared)])

    @staticmethod
    def stats(text: str, words: list[str], counts: Counter, declared: int | None) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        kinds = np.bincount(data, minlength=256)
        size, n = max(1, len(data)), max(1, len(words))
        letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum()))
        lines = [x for x in text.split("\n") if x.strip()]
        symbols = int(sum(kinds[ord(c)] for c in "#*$%&|<>"))
        return np.array([
            1.0,
            np.log1p(len(words)) / 10,
            np.log1p(len(text)) / 12,
            min(len(text) / n, 30) / 15,
            kinds[65:91].sum() / letters,
            kinds[48:58].sum() / size * 5,
            min(symbols / n, 2.0),
            kinds[[33, 44, 46, 58, 59, 63]].sum() / n,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            min(len(lines) / n * 5, 2.0),
            1 - len(set(lines)) / max(1, len(lines)),
            sum(len(x) < 30 for x in lines) / max(1, len(lines)),
            np.log1p(max(0, declared if declared is not None else len(text))) / 12,
            min(kinds[33] / n, 2.0),
            min(kinds[124] / n, 2.0),
        ])


class Machine:
    """Weights of a second-order factorisation machine for a probability."""

    def __init__(self, size: int = WORD_BUCKETS + len(STATS), rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0, 0.02, (size, rank))

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows given end to end (row k begins at starts[k]; no row is empty), and their factor sums."""
        xv = self.v[index] * value[:, None]
        total = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv**2).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[index] * value, starts)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares), total

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
        return 1 / (1 + np.exp(-np.clip(self.margin(index, value, starts)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = SEED) -> Machine:
        """Adagrad on the logistic loss, both classes of equal weight in all."""
        rng, size, rank = np.random.default_rng(seed), *self.v.shape
        hw, hv, hb = np.full(size, 1e-8), np.full((size, rank), 1e-8), 1e-8
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                take = order[at : at + BATCH]
                index, value = np.concatenate([rows[k][0] for k in take]), np.concatenate([rows[k][1] for k in take])
                lengths = np.array([len(rows[k][0]) for k in take])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                margin, total = self.margin(index, value, starts)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[take]) * weight[take] / len(take)
                gx = np.repeat(g, lengths) * value
                used, slot = np.unique(index, return_inverse=True)
                gw = np.bincount(slot, gx, len(used)) + l2 * self.w[used]
                hw[used] += gw**2
                self.w[used] -= rate * gw / np.sqrt(hw[used])
                inner = gx[:, None] * (np.repeat(total, lengths, axis=0) - self.v[index] * value[:, None])
                gv = np.stack([np.bincount(slot, inner[:, f], len(used)) for f in range(rank)], axis=1) + l2 * self.v[used]
                hv[used] += gv**2
                self.v[used] -= rate * gv / np.sqrt(hv[used])
                hb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(hb)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted to labels (doc_id, quality) of docs (doc_id, text, n_chars), held-out rows left out.

    Features are made by the executors; the driver gets those of sample_rows rows at most. Without any
    label the machine scores one half everywhere; null labels and ids are left out. Of rows that repeat
    a doc_id, one is learnt from: the least text.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features(t or "", n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            cols = [batch.column("doc_id"), batch.column("quality"), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "quality", "index", "value"])

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    one = mine.join(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.struct("text", "n_chars")).alias("row"))
    ready = one.select("doc_id", "quality", "row.text", "row.n_chars")
    got = sorted(ready.mapInArrow(run, "doc_id long, quality int, index binary, value binary").collect(), key=lambda r: (r["doc_id"], bytes(r["index"])))
    rows = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in got]
    machine = Machine()
    if rows:
        machine.fit(rows, np.array([r["quality"] for r in got], dtype=np.float64))
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text, n_chars), whole texts; null texts score as empty ones."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)  # WORD_BUCKETS * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = []
            texts, declared = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for at in range(0, len(texts), 50):
                scores.append(model.value.score([features(t or "", n) for t, n in zip(texts[at : at + 50], declared[at : at + 50])]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learnt from the labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
