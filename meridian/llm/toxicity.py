"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models over words, one of toxic and one of
ordinary texts, share what they back off to: the continuation counts (distinct
words before a word) of both classes together. What is discounted from a
class's own count is not a constant but all that tells nothing: (1 + ``over``)
times the count that the other class's rate explains, and ``z`` standard errors
of the count that the shared rate does; of a few values of z, texts that gave no
counts choose. An
expression too rare or too evenly used to tell the classes apart therefore gets
the same probability from both, and neither language nor subject moves a score.
A text's evidence is the mean over its words of the two log-likelihoods'
difference; a logistic curve over it and the length turns it into a score, and
is fitted to labelled texts that gave no counts. Counts of pairs are of texts,
so repetition within a text doesn't count.

Fitting uses a bounded sample of labelled rows (parameters below, chosen by a
hash of the id, as many of either class), so the model that the executors get
is bounded too: at most ``max_words`` words and ``max_pairs`` pairs, the most
frequent. Scoring covers every row and whole texts and shuffles nothing.

Null and empty texts have no words and get the score of no evidence. Without
labelled rows of both classes every score is 0.5. An id with several labels
counts as toxic if one says so; null labels don't count. Repeated rows are
scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import PUNCTUATED, HashIndex, fold, hash_words, mix, most_frequent, slices, text_bytes

#: Bounds of the fitted sample and of the model.
MAX_DOCS, MAX_CALIBRATION, MAX_WORDS, MAX_PAIRS = 5_000, 6_000, 1 << 18, 1 << 18
_TURN = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _TURN + word)


@dataclass
class Model:
    """Arrays of a fitted pair of models; toxic first in every pair of columns."""

    words: np.ndarray  # sorted hashes
    lower: np.ndarray  # [word, class] backed-off probability
    context: np.ndarray  # [word, class] occurrences as a context
    weight: np.ndarray  # [word, class] mass left to backing off
    pairs: np.ndarray  # sorted hashes
    counts: np.ndarray  # [pair, class] discounted counts
    unseen: np.ndarray  # [class]
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self):
        self.word_index, self.pair_index = HashIndex(self.words), HashIndex(self.pairs)

    def __reduce__(self):
        return Model, (self.words, self.lower, self.context, self.weight, self.pairs, self.counts, self.unseen, self.curve)

    def evidence(self, content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean difference of the log-likelihoods a word, and number of words."""
        hashes, first = hash_words(content, bounds, gap=PUNCTUATED)
        n = np.diff(first)
        if not len(hashes):
            return np.zeros(len(n)), n
        at = self.word_index.find(hashes)
        known = at >= 0
        p = np.tile(self.unseen, (len(at), 1))
        p[known] = self.lower[at[known]]
        opens = np.zeros(len(hashes), bool)
        opens[first[:-1][n > 0]] = True
        before = np.concatenate(([-1], at[:-1]))
        before[opens] = -1
        both = np.flatnonzero(known & (before >= 0))
        if len(both):
            seen = np.zeros((len(both), 2))
            if len(self.pairs):
                hit = self.pair_index.find(pair_hash(hashes[both - 1], hashes[both]))
                seen[hit >= 0] = self.counts[hit[hit >= 0]]
            context = self.context[before[both]]
            joint = (seen + self.weight[before[both]] * p[both]) / np.maximum(context, 1)
            p[both] = np.where(context > 0, joint, p[both])
        llr = np.concatenate(([0.0], np.cumsum(np.log(p[:, 0]) - np.log(p[:, 1]))))
        return (llr[first[1:]] - llr[first[:-1]]) / np.maximum(n, 1), n

    def score(self, content: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x, n = self.evidence(content, bounds)
        return 1 / (1 + np.exp(-np.clip(features(x, n) @ self.curve, -40, 40)))


def features(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.log1p(n)
    return np.stack([np.ones(len(x)), x, x * size, size], 1)


def fit_curve(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 2e-5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    z = features(x, n)
    scale = np.maximum(z.std(0), 1e-9)
    scale[0] = 1
    z, w = z / scale, np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(4) * [1e-6, 1, 1, 1], z.T @ (y - p) - ridge * len(y) * w * [1e-6, 1, 1, 1])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (word before, word) by class; 0 stands before a text's first word."""
    for batch in batches:
        for part in slices(batch):
            content, bounds = text_bytes(part.column(0))
            toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            words, first = hash_words(content, bounds, gap=PUNCTUATED)
            if not len(words):
                continue
            before = np.concatenate((np.zeros(1, np.uint64), words[:-1]))
            before[first[:-1][np.diff(first) > 0]] = 0
            row = np.repeat(np.arange(len(toxic)), np.diff(first))
            order = np.lexsort((row, words, before))
            words, before, row = words[order], before[order], row[order]
            once = np.concatenate(([True], (words[1:] != words[:-1]) | (before[1:] != before[:-1]) | (row[1:] != row[:-1])))
            words, before, mine = words[once], before[once], toxic[row[once]]
            new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (before[1:] != before[:-1]))))
            total, bad = np.diff(np.append(new, len(words))), np.add.reduceat(mine.astype(np.int64), new)
            yield pa.RecordBatch.from_arrays([pa.array(before[new].view(np.int64)), pa.array(words[new].view(np.int64)), pa.array(bad), pa.array(total - bad)], ["h", "w", "bad", "good"])


def _excess(counts: np.ndarray, total: np.ndarray, over: float, z: float) -> np.ndarray:
    """[expression, class] what is left of a class's counts when all that the other class and chance explain is discounted.

    total: [class] or [expression, class], out of how many the counts are.
    """
    total = np.broadcast_to(total, counts.shape)
    rate = counts / np.maximum(total, 1)
    pooled = total * (counts.sum(1) / np.maximum(total.sum(1), 1))[:, None]
    return np.maximum(counts - np.maximum(0.75, (1 + over) * total * rate[:, ::-1] + z * np.sqrt(pooled)), 0)


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int, max_calibration: int, id_column: str, text_column: str) -> DataFrame:
    """text, toxic, calibrate of the sample. It is chosen among the labels, then sent to the documents."""
    rows = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    rows = rows.where(learn).groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("id"))
    rows = rows.withColumn("calibrate", F.pmod(F.hash("id"), F.lit(4)) == 0)
    least = rows.where("not calibrate").groupBy("toxic").count().agg(F.min("count")).first()[0] or 0
    even = min(max_docs, least)
    bad, good = rows.where("toxic = 1 and not calibrate"), rows.where("toxic = 0 and not calibrate")
    picked = bad.orderBy("order").limit(even).unionByName(good.orderBy("order").limit(even)).unionByName(rows.where("calibrate").orderBy("order").limit(max_calibration))
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.join(F.broadcast(picked), "id").select("text", "toxic", "calibrate")  # at most 2 * max_docs + max_calibration ids


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_docs: int = MAX_DOCS, max_calibration: int = MAX_CALIBRATION, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS, over: float = 4.0, z: tuple[float, ...] = (4.0, 6.0, 8.0), id_column: str = "doc_id", text_column: str = "text") -> Model | None:
    """Fit on rows of labels (id, toxic) for which learn, a condition on "id", holds."""
    sample = _labelled(docs, labels, F.lit(True) if learn is None else learn, max_docs, max_calibration, id_column, text_column)
    table = sample.where("not calibrate").select("text", "toxic").mapInArrow(_pairs, "h long, w long, bad long, good long")
    table = table.groupBy("h", "w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    ends = table.groupBy(F.col("w").alias("word")).agg(seen("bad").alias("kb"), seen("good").alias("kg"))
    begins = table.groupBy(F.col("h").alias("word")).agg(F.sum("bad").alias("nb"), F.sum("good").alias("ng"))
    words = ends.join(begins, "word", "left").na.fill(0)
    types, k_bad, k_good = words.agg(F.count("*"), F.sum("kb"), F.sum("kg")).first()
    if not k_bad or not k_good:
        table.unpersist()
        return None
    often = F.col("kb") + F.col("kg")
    w = most_frequent(words.withColumn("often", often).where("often > 1"), "often", max_words).toArrow()
    b = most_frequent(table.withColumn("often", F.col("bad") + F.col("good")).where("often > 1"), "often", max_pairs).toArrow()
    table.unpersist()

    def columns(rows: pa.Table, *names: str) -> np.ndarray:
        return np.stack([rows[n].to_numpy() for n in names], 1).astype(np.float64)

    hashes = w["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    total = np.array([k_bad, k_good], float)
    every = total.sum() + types + 1
    k = columns(w, "kb", "kg")[order]
    shared = (k.sum(1) + 1) / every
    context = columns(w, "nb", "ng")[order]
    before = b["h"].to_numpy().view(np.uint64)
    at = HashIndex(hashes).find(before)
    c = columns(b, "bad", "good")
    opened = np.where((at >= 0)[:, None], context[at] if len(context) else 0.0, 0.0)
    pairs = pair_hash(before, b["w"].to_numpy().view(np.uint64))

    def discounted(z: float) -> Model:
        own = _excess(k, total, over, z)
        left = 1 - own.sum(0) / total
        extra = np.where((at >= 0)[:, None], _excess(c, opened, over, z), 0)
        weight = context.copy()
        np.subtract.at(weight, at[at >= 0], extra[at >= 0])
        tells = np.flatnonzero(extra.sum(1) > 0)
        by = tells[np.argsort(pairs[tells])]
        return Model(hashes, own / total + left * shared[:, None], context, weight, pairs[by], extra[by], left / every)

    models = [discounted(x) for x in z]
    held = docs.sparkSession.sparkContext.broadcast(models)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                content, bounds = text_bytes(part.column(0))
                seen = [m.evidence(content, bounds) for m in held.value]
                lists = pa.array(list(np.stack([x for x, _ in seen], 1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(seen[0][1]), part.column(1)], ["x", "n", "toxic"])

    def looked(rows: DataFrame) -> pa.Table:
        return rows.select("text", "toxic").mapInArrow(look, "x array<double>, n long, toxic int").toArrow()

    seen_rows = looked(sample.where("calibrate"))
    if len(set(seen_rows["toxic"].to_pylist())) < 2:  # too few rows to set some aside
        seen_rows = looked(sample)
    held.unpersist()
    x, n, y = np.array(seen_rows["x"].to_pylist()), seen_rows["n"].to_numpy(), seen_rows["toxic"].to_numpy().astype(float)
    best = None
    for i, model in enumerate(models):
        model.curve = fit_curve(x[:, i], n, y)
        p = 1 / (1 + np.exp(-np.clip(features(x[:, i], n) @ model.curve, -30, 30)))
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def score(docs: DataFrame, model: Model | None, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A struct "row" of the columns to keep (all, if None) and the score, for each row of docs."""
    names = docs.columns if keep is None else keep
    kept = F.struct(*(docs[c] for c in names))
    if model is None:
        return docs.select(kept.alias("row"), F.lit(0.5).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    inside = text_column in names
    rows = docs.select(kept.alias("row"), *([] if inside else [docs[text_column].alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            text = row.field(text_column) if inside else batch.column(1)
            for part in slices(pa.RecordBatch.from_arrays([text, row], ["text", "row"])):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(held.value.score(*text_bytes(part.column(0))))], ["row", "score"])

    return rows.mapInArrow(run, rows.select("row").schema.add("score", "double"))


def held_out(column: str | Column) -> Column:
    return fold(column, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; learns from labels that aren't held out."""
    model = fit(docs, labels, ~held_out("id"), id_column=id_column)
    slim = docs.select(F.col(id_column).alias("doc_id"), "text")
    scored = score(slim, model, keep=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
