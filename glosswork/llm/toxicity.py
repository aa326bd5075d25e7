"""Toxicity by a convolutional text classifier in numpy.

Hashed embeddings of words and of their first bytes (stems of inflected insults), filters over one, two and three words, max pooling over the whole text and a
logistic layer. Training reads at most `max_positive` + `max_negative` labelled rows (those of the
smallest hashes of their doc_id; rows of more than `max_words` words are left out of training), so
it fits the driver at any corpus size. Scoring reads every whole text. All labelled rows but those held
out and the four fifths of the sample that the fit reads calibrate, by histograms of their logits: one
logit shift for all, so that 0.5 is the global threshold, and a threshold for each language that has at
least `min_positive` positive rows among them, and negative ones enough for the share `most_false` to be
one row. The language chooses the threshold only; it is no input of a score.

Defined results: null text is the empty text and is scored; null or unknown languages take the
global threshold; labels other than 0 and 1 are ignored; without labels of both kinds the score is
the smoothed share of label 1. Repeated rows get the same score. An empty table gives no rows. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import U64, documents, frugal, released, slices, stable
from glosswork.llm.words import lowered, word_hashes

WIDTHS = (1, 2, 3)
# Of the histograms of logits: bins a unit, and the largest logit told from larger ones.
BINS, MOST_LOGIT = 512, 128
INDEX_BITS = 18


@dataclass(frozen=True)
class Settings:
    bits: int = 24  # of the hash that names a word
    dim: int = 8
    filters: int = 8  # of each width
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    prefix: int = 4  # bytes
    min_docs: int = 3  # training rows that a word occurs in, to have an embedding of its own
    max_positive: int = 2_000
    max_negative: int = 4_000
    max_words: int = 20_000
    min_positive: int = 20
    most_false: float = 0.01  # share of calibration rows of label 0 that may be above a threshold
    seed: int = 7


@dataclass
class Model:
    """Words (sorted hashes) with embeddings in rows 1 and up; row 0, all zero, is any other word."""

    words: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    shift: float
    scale: float = 1.0
    bits: int = 24
    prefix: int = 4
    prior: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def prepare(self) -> None:
        # Words by their top bits: a name is looked for among the few words that share them.
        self.coarse = max(0, self.bits - INDEX_BITS)
        self.starts = np.searchsorted(self.words >> self.coarse, np.arange((1 << (self.bits - self.coarse)) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max())
        self.products = _products(self.embedding, self.filters)

    def rows(self, names: np.ndarray) -> np.ndarray:
        """The row of the embedding of each name, 0 for names that are no words of the model."""
        flat = names.ravel()
        at = flat >> self.coarse
        low, high = self.starts[at], self.starts[at + 1]
        out = np.zeros(len(flat), np.int32)
        left = np.flatnonzero(low < high)
        for k in range(self.deepest):
            place = low[left] + k
            hit = self.words[place] == flat[left]
            out[left[hit]] = place[hit] + 1
            left = left[~hit & (place + 1 < high[left])]
        return out.reshape(names.shape)

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts given as rows of the embedding, one after another, each followed by two zero rows."""
        pooled = _pool(rows, bounds, self.products)[0]
        return np.maximum(pooled + self.bias, 0) @ self.dense[:-1] + self.dense[-1]

    def raw(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for i, j in slices(offsets, 1 << 19):
            names, bounds = named(body[offsets[i] : offsets[j]], offsets[i : j + 1], self.bits, self.prefix)
            rows, padded = _padded(self.rows(names), bounds)
            out.append(self.logits(rows, padded))
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(body, offsets) - self.shift), -500, 500)))


def named(body: np.ndarray, offsets: np.ndarray, bits: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names for each word, the top bits of the hashes of the word and of its first bytes; the rows' offsets."""
    hashes, bounds, stems = word_hashes(body, offsets, prefix)
    return (np.stack([hashes, stems], 1) >> U64(64 - bits)).astype(np.int64), bounds


def _padded(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two zero rows after each text, so that no filter window reaches into the next one."""
    gap = len(WIDTHS) - 1
    n = len(bounds) - 1
    out = np.zeros((len(rows) + gap * n, 2), np.int32)
    out[np.arange(len(rows)) + gap * np.repeat(np.arange(n), np.diff(bounds))] = rows
    return out, bounds + gap * np.arange(n + 1)


def _products(embedding: np.ndarray, filters: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Each word's share in each filter, by place in the window: a convolution is then a sum of look-ups."""
    return [[embedding @ f[k] for k in range(len(f))] for f in filters]


def _pool(rows: np.ndarray, bounds: np.ndarray, products: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest answer of each filter in each text, and the answers."""
    pooled, answers = [], []
    for parts in products:
        x = parts[0][rows[:, 0]]
        x += parts[0][rows[:, 1]]
        for k, part in enumerate(parts[1:], 1):
            x[:-k] += part[rows[k:, 0]]
            x[:-k] += part[rows[k:, 1]]
        pooled.append(np.maximum.reduceat(x, bounds[:-1], axis=0))
        answers.append(x)
    return np.concatenate(pooled, axis=1), answers


def fit(texts: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> tuple[Model, np.ndarray]:
    """A model of texts given as rows of two names, as named() gives them, and labels 0 and 1; the places of the texts it is fitted on."""
    positives = int(labels.sum())
    if not 0 < positives < len(labels):
        return Model(np.empty(0, np.int64), np.zeros((1, settings.dim), np.float32), [], np.empty(0), np.zeros(1), 0.0, prior=(positives + 1) / (len(labels) + 2) if len(labels) else 0.0), np.arange(len(texts))
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(texts))
    held = np.zeros(len(texts), bool)
    for label in (0, 1):
        of = order[labels[order] == label]
        held[of[: len(of) // 5]] = True
    train = np.flatnonzero(~held)
    unique = [np.unique(texts[i]) for i in train]
    names, docs = np.unique(np.concatenate([*unique, np.empty(0, texts[0].dtype)]), return_counts=True)
    names = names[docs >= settings.min_docs]
    n, d, k = len(names), settings.dim, settings.filters

    def rows_of(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, x)
        return np.where((at < n) & (names[np.minimum(at, max(n - 1, 0))] == x), at + 1, 0).astype(np.int32) if n else np.zeros(x.shape, np.int32)

    coded = [rows_of(x) for x in texts]
    # The first dimension starts from how surely a word goes with label 1 (a z-score, so rare words start near 0); half of
    # the filters start by reading it. With few labels training hardly moves far from there, with many it does.
    E = rng.normal(0, 0.02, (n + 1, d)).astype(np.float32)
    E[1:, 0] = _association(names, unique, labels[train]) / 4
    E[0] = 0
    W = [rng.normal(0, 0.1 / np.sqrt(w), (w, d, k)).astype(np.float32) for w in WIDTHS]
    out = np.zeros(k * len(WIDTHS) + 1)
    for f, w in enumerate(WIDTHS):
        W[f][:, 0, : k // 2] = 1 / w
        out[f * k : f * k + k // 2] = 1 / (w * k)
    params = [E, *W, np.zeros(k * len(WIDTHS), np.float32), (out + rng.normal(0, 0.02, len(out))).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(labels == 1, 0.5 / positives, 0.5 / (len(labels) - positives)) * len(labels)
    step = 0
    for _ in range(settings.epochs):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // settings.batch)):
            step += 1
            E, W, bias, dense = params[0], params[1:-2], params[-2], params[-1]
            rows, bounds = _padded(np.concatenate([coded[i] for i in some]), np.concatenate([[0], np.cumsum([len(coded[i]) for i in some])]))
            used, local = np.unique(rows, return_inverse=True)
            local = local.reshape(rows.shape).astype(np.int32)
            Eu = E[used]
            pooled, answers = _pool(local, bounds, _products(Eu, W))
            hidden = np.maximum(pooled + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ dense[:-1] + dense[-1], -30, 30)))
            error = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            g_dense = np.append(hidden.T @ error, error.sum()) + 1e-4 * dense
            g_hidden = np.outer(error, dense[:-1]) * (hidden > 0)
            gE, gW = np.zeros_like(Eu), [np.zeros_like(w) for w in W]
            texts_at = np.repeat(np.arange(len(some)), np.diff(bounds))
            for f, x in enumerate(answers):
                top = pooled[:, f * k : (f + 1) * k]
                for c in range(k):
                    hit = np.flatnonzero(x[:, c] == top[texts_at, c])
                    t, first = np.unique(texts_at[hit], return_index=True)
                    at, g = hit[first], g_hidden[t, f * k + c]
                    for j in range(f + 1):
                        inside = at + j < len(local)
                        r = local[at[inside] + j]
                        back = np.outer(g[inside], W[f][j, :, c])
                        for half in (r[:, 0], r[:, 1]):
                            gW[f][j, :, c] += g[inside] @ Eu[half]
                            np.add.at(gE, half, back)
            gE[used == 0] = 0
            for q, g, (m1, m2) in zip(params[1:], [*gW, g_hidden.sum(0), g_dense], moments[1:], strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= settings.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            m1, m2 = moments[0]
            gE += 1e-5 * Eu
            m1[used] += 0.1 * (gE - m1[used])
            m2[used] += 0.001 * (gE * gE - m2[used])
            E[used] -= settings.rate * m1[used] / (1 - 0.9**step) / (np.sqrt(m2[used] / (1 - 0.999**step)) + 1e-8)
            E[0] = 0
    return Model(names, params[0], params[1:-2], params[-2], params[-1], 0.0, bits=settings.bits, prefix=settings.prefix), train


def _association(names: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """z-scores of the difference of the shares of texts of either label that hold a word; texts are sets of names."""
    counts = np.zeros((2, len(names)))
    for x, y in zip(texts, labels, strict=True):
        at = np.searchsorted(names, x)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == x)] if len(names) else at[:0]
        counts[y, at] += 1
    n = np.bincount(labels, minlength=2)
    pooled = (counts.sum(0) + 0.5) / (n.sum() + 1)
    return (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))


def _cut(bins: np.ndarray, positive: np.ndarray, negative: np.ndarray, most_false: float) -> float:
    """The middle of the cuts of the largest F1, but not so low that more than a share of label 0 is above it. Cuts part bins."""
    order = np.argsort(-bins)
    bins, hits, false = bins[order], np.cumsum(positive[order]), np.cumsum(negative[order])
    at = int(np.argmax(2 * hits / (hits + false + hits[-1])))
    lower = bins[at + 1] + 1 if at + 1 < len(bins) else bins[at] - 2 * BINS
    many = np.flatnonzero(false > int(most_false * (false[-1] - 1)))
    floor = bins[many[0]] + 1 if len(many) else -np.inf
    return float(max(floor, (bins[at] + lower) / 2) / BINS)


def calibrate(model: Model, docs: DataFrame, known: DataFrame, fitted: np.ndarray, settings: Settings, doc_id: str, text: str, lang: str) -> None:
    """Sets the model's shift and thresholds from all rows of known (__id, toxic) that it is not fitted on."""
    sent = docs.sparkSession.sparkContext.broadcast((model, fitted))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = sent.value
        if not hasattr(own, "starts"):
            own.prepare()
        for b in batches:
            logits = np.clip(own.raw(*lowered(b.column(2))), -MOST_LOGIT, MOST_LOGIT)
            seen = np.isin(b.column(0).to_numpy(zero_copy_only=False), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.floor(logits * BINS).astype(np.int32)), pa.array(seen)], ["id", "lang", "bin", "fitted"])

    rows = docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).cast("long").alias("__id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(frugal(bins), "id long, lang string, bin int, fitted boolean").join(known, F.col("id") == F.col("__id"))
    one, zero = F.sum("toxic").alias("positive"), F.sum(1 - F.col("toxic")).alias("negative")
    cells = stable(scored.groupBy("lang", "bin", "fitted").agg(one, zero))
    sums = F.sum("positive").alias("positive"), F.sum("negative").alias("negative")
    rest = cells.filter("not fitted")
    every = rest.groupBy("bin").agg(*sums).toPandas()
    if not (len(every) and every["positive"].sum() and every["negative"].sum()):
        rest = cells
        every = rest.groupBy("bin").agg(*sums).toPandas()

    def cut(x: pd.DataFrame) -> float:
        return _cut(*(x[c].to_numpy(np.int64) for c in ("bin", "positive", "negative")), settings.most_false)

    model.shift = cut(every)
    least = max(settings.min_positive, int(np.ceil(1 / settings.most_false)) + 1)
    enough = rest.filter("lang <> ''").groupBy("lang").agg(*sums).filter((F.col("positive") >= settings.min_positive) & (F.col("negative") >= least)).select("lang")
    for name, own in rest.join(enough, "lang").groupBy("lang", "bin").agg(*sums).toPandas().groupby("lang"):
        model.thresholds[name] = float(1 / (1 + np.exp(-np.clip(cut(own) - model.shift, -500, 500))))
    sent.unpersist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits and calibrates on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("double").alias("toxic")).filter(F.col("__id").isNotNull() & F.col("toxic").isin(0.0, 1.0))
    known = marks.groupBy("__id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("__id")))
    order = F.xxhash64("__id"), F.col("__id")
    chosen = known.filter("toxic = 1").orderBy(*order).limit(settings.max_positive).union(known.filter("toxic = 0").orderBy(*order).limit(settings.max_negative))
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "__id")  # at most max_positive + max_negative ids
    bits, prefix, most = settings.bits, settings.prefix, settings.max_words

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = lowered(b.column(1))
            coded: list[bytes | None] = []
            for i, j in slices(offsets, 1 << 20):
                names, bounds = named(body[offsets[i] : offsets[j]], offsets[i : j + 1], bits, prefix)
                names = names.astype("<u4")
                coded += [names[m:n].tobytes() if n - m <= most else None for m, n in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(coded, pa.binary())], ["id", "toxic", "words"])

    pdf = rows.mapInArrow(frugal(code), "id long, toxic int, words binary").filter("words is not null").toPandas()
    pdf = pdf.sort_values(["id", "words"]).drop_duplicates(["id"])
    model, fitted = fit([np.frombuffer(x, "<u4").reshape(-1, 2) for x in pdf["words"]], pdf["toxic"].to_numpy(np.int64), settings)
    if model.prior is None:
        calibrate(model, docs, known, pdf["id"].to_numpy(np.int64)[fitted], settings, doc_id, text, lang)
    return model


def scorer(spark: SparkSession, model: Model):
    """A vectorised function from a text column to scores. The model is bounded by the training sample."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        if own.prior is None and not hasattr(own, "starts"):
            own.prepare()
        try:
            for texts in batches:
                yield pa.array(own.score(*lowered(texts)))
        finally:
            released()

    return score


def threshold(model: Model, lang: Column) -> Column:
    out = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, value).otherwise(out)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, rejected for each row of docs."""
    model = train(docs, labels, settings, doc_id, text, lang)
    score = scorer(docs.sparkSession, model)
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"), threshold(model, F.col(lang)).alias("lang_threshold"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the classifier lets pass, with their columns."""
    model = train(docs, labels, settings, text=text, lang=lang)
    score = scorer(docs.sparkSession, model)
    name = "__toxicity"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score(F.coalesce(F.col(text), F.lit("")))).filter(F.col(name) < threshold(model, F.col(lang))).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
