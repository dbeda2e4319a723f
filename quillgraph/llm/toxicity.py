"""Operator 1, toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded, hash-ordered sample of labelled rows in one task: per-coordinate rates
come from the summed squared gradients, and the L1 term leaves most weights exactly zero.  The few
others are collected (at most ``2 ** bits`` by construction, in practice some thousands), broadcast,
and applied to every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from .common import id_and_text, map_texts, slices, table

#: (offset of the second word, of the third) of each feature: words, bigrams, trigrams, skip-grams over one and two words.
GRAMS = ((), (1,), (1, 2), (2,), (3,))


def features(data, offsets, bits: int):
    """(row, index) of every n-gram and skip-gram of each row, repeats included.

    Words are runs of ASCII letters and digits and of non-ASCII bytes, with A-Z lower-cased.
    """
    import numpy as np

    from .text import LOWER, mix, rows_of, word_hash

    solid = np.zeros(256, bool)
    solid[48:58] = solid[65:91] = solid[97:123] = solid[128:] = True
    low = LOWER[data]
    inside = solid[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    word, row = word_hash(low, starts, ends), rows_of(starts, offsets)
    rows, out = [], []
    for k, gram in enumerate(GRAMS):
        n = len(word) - (gram[-1] if gram else 0)
        if n <= 0:
            continue
        h = word[:n] + np.uint64(k + 1)
        for step in gram:
            h = mix(h) + word[step : step + n]
        keep = row[:n] == row[len(row) - n :]
        rows.append(row[:n][keep])
        out.append((mix(h[keep]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.int64)


class Ftrl:
    """FTRL-proximal: w is the closed-form minimiser given z (adjusted gradients) and n (squared gradients)."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        import numpy as np

        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, index):
        import numpy as np

        z = self.z[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, index, label: int) -> None:
        import numpy as np

        w, b = self.weights(index), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_rows: int = 16_000, bits: int = 21, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> tuple:
    """(indices, weights, bias) learned from labelled documents; bias None if there are none.

    At most ``max_train_rows`` labelled ids are used, those with the smallest hash of the id;
    a label given twice counts as its larger value, null ids and null labels are left out.
    The caller filters ``labels`` to what may be learned from.
    """
    import numpy as np

    spark = documents.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    # the ids are bounded by max_train_rows, so they can be broadcast; repeated ids count once
    rows = id_and_text(documents, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).repartition(1)

    def work(batches):
        import pyarrow as pa

        from .text import utf8

        held = []
        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            row, index = features(data, offsets, bits)
            order = np.lexsort((index, row))
            row, index = row[order], index[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (index[1:] != index[:-1])
            row, index = row[new], index[new].astype(np.int32)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, (d, y) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist(), strict=True)):
                held.append((d * 0x9E3779B97F4A7C15 % (1 << 64), y, index[at[i] : at[i + 1]].copy()))
        model = Ftrl(1 << bits, alpha, beta, l1, l2)
        held.sort(key=lambda x: x[0])
        for _ in range(epochs):
            for _, y, index in held:
                model.learn(index, int(y > 0))
        if held:
            every = np.flatnonzero(np.abs(model.z) > l1)
            w = model.weights(every)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, every]), pa.array(np.r_[model.bias(), w])], names=["index", "weight"])

    scratch.ship(spark)
    with scratch.small_batches(spark):
        got = map_texts(rows, work, "index long, weight double").toArrow()
    index, weight = got.column("index").to_numpy(), got.column("weight").to_numpy()
    return index[1:], weight[1:], float(weight[0]) if len(index) else None


def _scorer(sent, bits: int):
    """Arrow batch -> scores, from a broadcast model."""
    import numpy as np

    from .text import utf8

    index, weight, bias = sent.value
    known = np.zeros(1 << bits, bool)
    known[index] = True

    def scores(text):
        n = len(text)
        if bias is None:
            return np.zeros(n)
        data, offsets = utf8(text)
        row, at = features(data, offsets, bits)
        hit = known[at]
        both = np.unique(row[hit] << bits | at[hit])
        total = np.bincount(both >> bits, weights=weight[np.searchsorted(index, both & ((1 << bits) - 1))], minlength=n) + bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return scores


def drop_toxic(documents: DataFrame, model: tuple, text_col: str = "text", bits: int = 21) -> DataFrame:
    """The rows of ``documents``, all columns, that score below 0.5; one pass, no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        scores = _scorer(sent, bits)
        for part in slices(batches, text_col, 1 << 20):
            yield part.filter(pa.array(scores(part.column(text_col)) < 0.5))

    return map_texts(documents, work, documents.schema)


def score(documents: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", bits: int = 21) -> DataFrame:
    """(doc_id, score, predicted) for each row; without a model every score is 0.

    A null text scores as an empty one (the bias alone); null ids stay null; repeated rows give
    repeated rows; other columns are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        scores = _scorer(sent, bits)
        for part in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text")))], names=["doc_id", "score"])

    scored = map_texts(id_and_text(documents, id_col, text_col), work, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fold(column: str = "doc_id"):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(fold() % 5 != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, fit(documents, learnable(labels)))
    return scored.select("doc_id", F.coalesce(fold() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
