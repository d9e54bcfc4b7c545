"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The last sum gives all pairwise interactions in time linear in the features of a text
(Rendle, Factorization machines, 2010). Words are hashed to WORD_BUCKETS features, with
weights by log frequency and unit length; structure features are shares and sizes; the
metadata feature is the recorded length. Labels, language, source and id are no features.

The model is fitted on at most MAX_SAMPLE labelled rows, those with the smallest hash of
their id outside the held-out fold; these rows alone come to the driver, as sparse
features. Scoring is one pass over the texts.

Cases: a null text is an empty one and gets a score from its other features. A null or
missing n_chars has a feature of its own. Labels without id or quality are ignored; of
several labels of a document the smallest counts. Without labels every score is 0.5; with labels of
one class the model learns that class. Rows that repeat a doc_id are scored one by one;
an empty table gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logtide.llm.texts import blocks

WORD_BUCKETS = 1 << 14
FACTORS = 8
MAX_SAMPLE = 6000
EPOCHS = 12
THRESHOLD = 0.7
STRUCTURE = (
    "chars", "words", "mean_word", "long_words", "upper", "digits", "symbols", "marks", "pipes", "spaces",
    "distinct_words", "repeated_lines", "line_words", "sentence_ends", "other_script", "shouted_words",
)
METADATA = ("recorded", "unrecorded")
N_FEATURES = WORD_BUCKETS + len(STRUCTURE) + len(METADATA)


def structure(text: str, words: list[str], distinct: int, recorded: int | None) -> list[float]:
    """Sizes on a log scale and shares, then the metadata."""
    from math import log1p

    n, w = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    upper = sum(map(str.isupper, words))
    count = text.count
    capitals = n - len(text.translate(_WITHOUT_CAPITALS))
    digits = n - len(text.translate(_WITHOUT_DIGITS))
    symbols = sum(count(c) for c in "#*$%&<>@^~_=+\\{}[]")
    marks = sum(count(c) for c in "!?;:")
    ends = count(". ") + count("! ") + count("? ") + count(".\n")
    return [
        log1p(len(text)), log1p(len(words)), len(text) / w, sum(len(x) > 12 for x in words) / w,
        capitals / n, digits / n, symbols / w, marks / w, count("|") / w, (count(" ") + count("\n")) / n,
        distinct / w, 1 - len(set(lines)) / max(len(lines), 1), log1p(w / max(len(lines), 1)), ends / w,
        len(text.encode("utf-8", "replace")) / n, upper / w,
        log1p(recorded) if recorded is not None and recorded >= 0 else 0.0, float(recorded is None),
    ]


_WITHOUT_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}
_WITHOUT_DIGITS = {c: None for c in range(ord("0"), ord("9") + 1)}


class Features:
    """Sparse features of texts: word buckets with weights, then dense structure and metadata."""

    def __init__(self):
        self.buckets: dict[str, int] = {}

    def __call__(self, text: str, recorded: int | None):
        from collections import Counter
        from math import log1p
        from zlib import crc32

        import numpy as np

        words = text.split()
        counts = Counter(words)
        if len(self.buckets) > 500_000:
            self.buckets.clear()
        buckets = self.buckets
        at, weights = [], []
        for word, n in counts.items():
            bucket = buckets.get(word)
            if bucket is None:
                bucket = buckets[word] = crc32(word.lower().encode("utf-8", "replace")) % WORD_BUCKETS
            at.append(bucket)
            weights.append(1.0 if n == 1 else 1 + log1p(n - 1))
        weights = np.array(weights, np.float32)
        norm = float(np.sqrt((weights * weights).sum())) or 1.0
        dense = np.array(structure(text, words, len(counts), recorded), np.float32)
        return np.array(at, np.int32), weights / norm, dense


@dataclass
class Model:
    bias: float
    linear: object  # N_FEATURES floats
    factors: object  # N_FEATURES x FACTORS floats
    mean: object  # of the dense features
    scale: object

    def scores(self, rows: list[tuple]):
        """Scores of feature rows, each in time linear in its features."""
        import numpy as np

        first = WORD_BUCKETS
        out = np.empty(len(rows))
        for i, (at, weights, dense) in enumerate(rows):
            x = np.clip((dense - self.mean) / self.scale, -5, 5)
            v = self.factors[at] * weights[:, None]
            u = self.factors[first:] * x[:, None]
            sums = v.sum(0) + u.sum(0)
            squares = (v * v).sum(0) + (u * u).sum(0)
            out[i] = self.bias + self.linear[at] @ weights + self.linear[first:] @ x + 0.5 * (sums @ sums - squares.sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list[tuple], labels: list[int], epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5) -> Model:
    """Adam on the logistic loss, in batches, from a fixed seed."""
    import numpy as np

    rng = np.random.default_rng(7)
    model = Model(
        0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.01, (N_FEATURES, FACTORS)).astype(np.float32),
        np.zeros(len(STRUCTURE) + len(METADATA), np.float32), np.ones(len(STRUCTURE) + len(METADATA), np.float32),
    )
    if not rows:
        model.factors[:] = 0
        return model
    dense = np.stack([r[2] for r in rows])
    model.mean, model.scale = dense.mean(0), np.maximum(dense.std(0), 1e-3)
    dense = np.clip((dense - model.mean) / model.scale, -5, 5)
    columns = np.arange(WORD_BUCKETS, N_FEATURES, dtype=np.int32)
    at = [np.concatenate((r[0], columns)) for r in rows]
    value = [np.concatenate((r[1], d)).astype(np.float32) for r, d in zip(rows, dense)]
    wanted = np.array(labels, np.float32)
    # One table of parameters: bias apart, then linear weight and factors of each feature.
    table = np.concatenate((model.linear[:, None], model.factors), 1)
    moment, spread = np.zeros_like(table), np.zeros_like(table)
    bias = np.zeros(3)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 128)):
            step += 1
            sizes = np.array([len(at[i]) for i in batch])
            starts = np.concatenate(([0], sizes.cumsum()[:-1]))
            features, x = np.concatenate([at[i] for i in batch]), np.concatenate([value[i] for i in batch])[:, None]
            row = np.repeat(np.arange(len(batch)), sizes)
            weights = table[features] * x
            sums = np.add.reduceat(weights, starts)
            squares = np.add.reduceat((weights[:, 1:] ** 2).sum(1), starts)
            raw = bias[0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - wanted[batch]) / len(batch)
            slope = np.empty_like(weights)
            slope[:, :1] = x
            slope[:, 1:] = x * (sums[row, 1:] - weights[:, 1:])
            slope *= error[row, None]
            used, where = np.unique(features, return_inverse=True)
            gradient = np.zeros((len(used), table.shape[1]), np.float32)
            np.add.at(gradient, where, slope)
            gradient += decay * table[used]
            moment[used] = 0.9 * moment[used] + 0.1 * gradient
            spread[used] = 0.999 * spread[used] + 0.001 * gradient**2
            table[used] -= rate * (moment[used] / (1 - 0.9**step)) / (np.sqrt(spread[used] / (1 - 0.999**step)) + 1e-8)
            g = float(error.sum())
            bias[1], bias[2] = 0.9 * bias[1] + 0.1 * g, 0.999 * bias[2] + 0.001 * g * g
            bias[0] -= rate * (bias[1] / (1 - 0.9**step)) / (np.sqrt(bias[2] / (1 - 0.999**step)) + 1e-8)
    model.bias, model.linear, model.factors = float(bias[0]), table[:, 0].copy(), table[:, 1:].copy()
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's decimal text, remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    recorded = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        recorded.alias("recorded"),
    )


def fitted(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """The model learned from at most ``max_sample`` labelled rows outside the held-out fold."""
    import numpy as np

    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id"
    ).limit(max_sample)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in blocks(batches):
            rows = [features(t.as_py(), r.as_py()) for t, r in zip(batch["text"], batch["recorded"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["quality"], *[
                    pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(3)
                ]],
                ["doc_id", "quality", "at", "weights", "dense"],
            )

    # The sample has at most max_sample rows of two numbers. A doc_id that repeats gives its first text.
    texts = _inputs(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text", "recorded")
    rows = texts.mapInArrow(sparse, "doc_id long, quality int, at binary, weights binary, dense binary")
    best = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "at", "weights", "dense")).alias("r")).select("r.*", "doc_id")
    found = best.orderBy("doc_id").collect()
    return train(
        [tuple(np.frombuffer(r[c], t) for c, t in (("at", np.int32), ("weights", np.float32), ("dense", np.float32))) for r in found],
        [int(r["quality"] > 0) for r in found],
    )


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row held_out, score and predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in blocks(batches):
            rows = [features(t.as_py(), r.as_py()) for t, r in zip(batch["text"], batch["recorded"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(model.scores(rows), pa.float64())], ["doc_id", "score"]
            )

    return _inputs(docs).mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    return scored(docs, fitted(docs, labels, max_sample))
