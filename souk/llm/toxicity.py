"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over
word presence; each later model also gets the probabilities of the earlier
categories. In training these are out-of-fold predictions, so a later model
sees earlier ones as uncertain as they are on new texts.

Categories: ``insult`` and ``contempt`` are weak labels (a row labelled toxic that
has a word of the category's list), ``toxic`` is the label itself and comes last.

Training rows are a sample of the labelled documents, bounded by
``SAMPLE_ROWS`` a class in expectation (drawn by a hash of doc_id and text) and
weighted back to the class sizes. Features are the ``FEATURES`` words with the
greatest chi-square between the classes, counted over the sample by Spark.
Every document is scored whole.

Cases: null or empty text, or a text without any feature word, gets the
intercepts' probabilities; labels that are null or conflict for one doc_id count as
their greatest value; ids may repeat; without labelled rows of both classes all
probabilities are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship, small_batches
from souk.llm.decontaminate import words_of
from souk.sources.staging import stage

# The words that name the weakly labelled categories.
CATEGORY_WORDS = {
    "insult": ("idiot", "stupid", "moron", "clown", "loser"),
    "contempt": ("trash", "pathetic", "worthless", "disgusting", "scum"),
}
CATEGORIES = (*CATEGORY_WORDS, "toxic")
SAMPLE_ROWS = 3_000
FEATURES = 1_024
FOLDS = 5
RIDGE = 2e-4
ROUNDS = 400
THRESHOLD = 0.5


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last one is the intercept) by accelerated gradient descent on the
    weighted mean loss plus a ridge (not on the intercept)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = (weight / weight.sum()).astype(x.dtype)
    top = np.ones(x.shape[1], x.dtype)
    for _ in range(20):                                  # largest curvature, by power iteration
        top = x.T @ (weight * (x @ top))
        top /= np.linalg.norm(top)
    step = 1.0 / (float(top @ (x.T @ (weight * (x @ top)))) / 4 * 1.05 + ridge)
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (weight * (p - y).astype(x.dtype))
        g[:-1] += ridge * v[:-1]
        new = v - step * g
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


def apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    words: tuple[str, ...]
    weights: list[np.ndarray] = field(default_factory=list)     # one vector per category

    def fit(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Chain:
        """``labels`` (rows, categories)."""
        earlier = np.zeros((len(x), 0), x.dtype)
        for k in range(labels.shape[1]):
            own, y = np.hstack([x, earlier]).astype(x.dtype), labels[:, k]
            outside = np.zeros(len(x))
            for f in np.unique(fold):
                rest = fold != f
                w = logistic(own[rest], y[rest], weight[rest]) if rest.any() else np.zeros(own.shape[1] + 1)
                outside[~rest] = apply(own[~rest], w)
            self.weights.append(logistic(own, y, weight))
            earlier = np.hstack([earlier, outside[:, None]])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories) probabilities, each model fed with the earlier ones."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, apply(np.hstack([x, out]), w)[:, None]])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(texts), len(CATEGORIES)))
        at = {w: k for k, w in enumerate(self.words)}
        out = []
        for a in range(0, len(texts), 512):
            part = texts[a:a + 512]
            x = np.zeros((len(part), len(self.words)), np.float32)
            for k, t in enumerate(part):
                x[k, [at[w] for w in set(words_of(t)).intersection(at)]] = 1
            out.append(self.predict(x))
        return np.concatenate(out) if out else np.zeros((0, len(CATEGORIES)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    one = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
           .agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Chain(())
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_rows / sizes[1]))).otherwise(F.lit(min(1.0, sample_rows / sizes[0])))
    drawn = one.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            words = [sorted(set(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "toxic")), pa.array(words, pa.list_(pa.string()))],
                                             names=["row", "toxic", "words"])

    rows = stage(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")      # bounded by SAMPLE_ROWS
                
                 .select(F.xxhash64("doc_id", "text").alias("row"), "toxic", "text")
                 .mapInArrow(split, "row bigint, toxic int, words array<string>").dropDuplicates(["row"]), "toxic-rows")
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return Chain(())
    n1, n0 = float(count[1]), float(count[0])
    seen = (rows.select("toxic", F.explode("words").alias("word")).groupBy("word")
            .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter("a + b >= 3"))
    a, b = F.col("a"), F.col("b")
    n = n1 + n0
    chi = n * F.pow(a * F.lit(n0) - b * F.lit(n1), 2) / ((a + b) * (F.lit(n) - a - b + 1e-9) * F.lit(n1 * n0))
    best = [r["word"] for r in seen.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(features).collect()]
    chain = Chain(tuple(best))
    at = {w: k for k, w in enumerate(best)}
    chosen = F.array_intersect("words", F.array(*[F.lit(w) for w in best])) if best else F.array().cast("array<string>")
    table = rows.select("row", "toxic", chosen.alias("words"), *[
        F.arrays_overlap("words", F.array(*map(F.lit, ws))).alias(c) for c, ws in CATEGORY_WORDS.items()]).orderBy("row").collect()
    x = np.zeros((len(table), len(best)), np.float32)
    for k, r in enumerate(table):
        x[k, [at[w] for w in r["words"]]] = 1
    y = np.array([[*(float(r["toxic"] and r[c]) for c in CATEGORY_WORDS), float(r["toxic"])] for r in table])
    weight = np.where(y[:, -1] > 0, sizes[1] / n1, sizes[0] / n0)
    fold = np.array([r["row"] % FOLDS for r in table])
    return chain.fit(x, y, weight, fold)


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, one probability per category, and the toxic decision."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)              # bounded by FEATURES
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])),
                 pa.array(p[:, -1] >= THRESHOLD, pa.bool_())], names=["doc_id", *names, "toxic"])

    fields = ", ".join(f"{c} double" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}, toxic boolean")
