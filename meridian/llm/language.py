"""Language of texts by hierarchical discrimination: the family first, then the language within it.

Features are hashed character n-grams of one to four bytes of each lower-cased
word with its surrounding blanks, damped by square roots and scaled to length
one, so that a text's length doesn't decide. Families are told apart by linear
support vector machines, one family against another, and close languages within
a family by machines of one language against one other that learn from texts of
these two only. Within a stage the class with most votes wins, the sum of the
margins decides ties, and then the smaller name.

The machines (squared hinge loss, ridge) are fitted on a bounded sample: at most
``max_docs`` texts or so in all, as many of each language as there are or its
even share, those of the smallest hashes; of each, features are counted over the
whole text. Where one class has fewer texts, its errors weigh
more. Models are bounded by the number of languages (at most ``max_langs``, the
most frequent) and ``DIMS``. Prediction reads every text whole, in pieces of
bounded size, and shuffles nothing.

Families come from a table of language codes; a code that isn't in it is a
family of its own. Null texts and texts without a letter are ``und`` with score
0, as is every text if nothing could be learned; with one language learned, all
others are that, with score 1. The score is the product of both stages' smallest
logistic margins of the winner. Repeated rows are learned from once and predicted
alike; null ids are ids like others. Other columns aren't read, and an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold, mix, slices, text_bytes

#: Fixed: families of ISO 639-1 codes whose languages are often taken for each other.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa ur",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
UNKNOWN = "und"
#: Bounds: texts that are learned from, languages, features.
MAX_DOCS, MAX_LANGS, DIMS = 6_000, 64, 1 << 12
ORDERS = (1, 2, 3, 4)
_PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space, digits and ASCII punctuation count as one blank.
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"={code}")


def features(content: np.ndarray, bounds: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """[text, feature] of UTF-8 texts; every byte counts, however long a text is."""
    rows = len(bounds) - 1
    out = np.zeros(rows * dims, np.float32)
    text = _LOWER[content]
    # of a run of blanks one stays
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[bounds[:-1][bounds[:-1] < len(text)]] = True
    owner_start = np.concatenate(([0], np.cumsum(keep)))[bounds]
    text = text[keep]
    for at in range(0, len(text), _PIECE):
        to = min(len(text), at + _PIECE)
        reach = min(len(text), to + max(ORDERS) - 1)
        part = text[at:reach].astype(np.uint32)
        row = np.searchsorted(owner_start, np.arange(at, reach), "right") - 1
        code = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            m = len(part) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            m = min(m, to - at)
            whole = row[:m] == row[n - 1 : n - 1 + m]
            if n > 1:  # a blank alone, or between two words, says nothing
                whole &= part[:m] + part[n - 1 : n - 1 + m] != 64
            slot = mix(code[:m].astype(np.uint64) + (np.uint64(n) << np.uint64(40))) % np.uint64(dims)
            np.add.at(out, row[:m][whole] * dims + slot[whole].astype(np.int64), np.float32(1))
    out = np.sqrt(out.reshape(rows, dims))
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and a bias (last) of a linear machine, y of 1 and -1: squared hinge loss by Newton steps with conjugate gradients."""
    n, d = x.shape
    cost = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))).astype(np.float32)
    w = np.zeros(d + 1, np.float32)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.maximum(1 - y * (x @ w[:-1] + w[-1]), 0)
        return 0.5 * ridge * float(w[:-1] @ w[:-1]) + float((cost * gap * gap).sum()), gap

    loss, gap = value(w)
    for _ in range(rounds):
        on = gap > 0
        own, c = x[on], 2 * cost[on]
        slope = -c * y[on] * gap[on]
        grad = np.append(own.T @ slope + ridge * w[:-1], slope.sum())

        def times(v: np.ndarray, own=own, c=c) -> np.ndarray:
            u = c * (own @ v[:-1] + v[-1])
            return np.append(own.T @ u + ridge * v[:-1], u.sum())

        step, rest = np.zeros_like(w), -grad
        way, size = rest.copy(), float(rest @ rest)
        first = size
        for _ in range(40):
            if size <= 1e-4 * first or size == 0:
                break
            turned = times(way)
            a = size / max(float(way @ turned), 1e-12)
            step += a * way
            rest -= a * turned
            size, old = float(rest @ rest), size
            way = rest + (size / old) * way
        length = 1.0
        while length > 1e-3:
            new, gap_new = value(w + length * step)
            if new < loss:
                break
            length /= 2
        else:
            break
        done = loss - new < 1e-5 * loss
        w, loss, gap = w + length * step, new, gap_new
        if done:
            break
    return w


@dataclass
class Duel:
    """Machines of all pairs of classes."""

    classes: list[str]
    weights: np.ndarray  # [feature, pair]
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, classes: list[str]) -> Duel:
        out = []
        for i, j in cls.pairs(len(classes)):
            own = (labels == classes[i]) | (labels == classes[j])
            out.append(fit_svm(x[own], np.where(labels[own] == classes[i], 1, -1).astype(np.float32)))
        w = np.stack(out, 1) if out else np.zeros((x.shape[1] + 1, 0), np.float32)
        return cls(classes, w[:-1], w[-1])

    @staticmethod
    def pairs(n: int) -> list[tuple[int, int]]:
        return [(i, j) for i in range(n) for j in range(i + 1, n)]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the winner, and its least logistic margin against another."""
        n = len(self.classes)
        margin = x @ self.weights + self.bias
        votes, total, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (i, j) in enumerate(self.pairs(n)):
            m = margin[:, k]
            for c, own in ((i, m), (j, -m)):
                votes[:, c] += own > 0
                total[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        best = np.lexsort((-np.arange(n)[None] + 0 * total, total, votes), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(x)), best], -30, 30)))


@dataclass
class Model:
    families: Duel
    languages: list[Duel]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, score = np.empty(len(x), object), np.zeros(len(x))
        family, sure = self.families.predict(x)
        for f, duel in enumerate(self.languages):
            own = np.flatnonzero(family == f)
            if len(own):
                lang, certain = duel.predict(x[own])
                names[own] = np.array(duel.classes, object)[lang]
                score[own] = sure[own] * certain
        return names, score


def fit(rows: DataFrame, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS, dims: int = DIMS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    """Learn from the texts and languages of rows; null ones don't count."""
    rows = rows.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), F.col(id_column).alias("id")).where(r"lang is not null and text rlike '\\p{L}'")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not sizes:
        return None
    # an even share of the bound, and what others leave of theirs
    left, share = max_docs, {}
    for k, (lang, n) in enumerate(sorted(sizes, key=lambda r: r["n"])):
        share[lang] = min(n, left // (len(sizes) - k))
        left -= share[lang]
    rows = rows.withColumn("key", F.xxhash64("id", "text", "lang"))
    order = F.pmod("key", F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in sizes:
        wanted = wanted | ((F.col("lang") == lang) & (order < int((1 << 30) * share[lang] / n)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_rows=512):
                x = features(*text_bytes(part.column(0)), dims).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # rows whose hash falls below the share; equal ones once, so that their number doesn't matter
    seen = rows.where(wanted).dropDuplicates(["key"]).select("text", "lang").mapInArrow(look, "lang string, x binary").toArrow()
    labels = np.array(seen["lang"].to_pylist(), object)
    if not len(labels):
        return None
    x = np.frombuffer(b"".join(seen["x"].to_pylist()), np.float16).reshape(len(labels), dims).astype(np.float32)
    of = {lang: family_of(lang) for lang in set(labels)}
    family = np.array([of[lang] for lang in labels], object)
    names = sorted(set(of.values()))
    inner = [Duel.fit(x[family == f], labels[family == f], sorted(lang for lang in of if of[lang] == f)) for f in names]
    return Model(Duel.fit(x, family, names), inner)


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", dims: int = DIMS) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    rows = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("known"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_rows=512):
                lang, score = held.value.predict(features(*text_bytes(part.column(0)), dims))
                known = part.column(2).to_numpy(zero_copy_only=False)
                lang[~known], score[~known] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learns from rows that aren't held out."""
    model = fit(docs.where(fold(id_column, 3) != 1), id_column=id_column, text_column=text_column, lang_column=lang_column)
    found = predict(docs, model, id_column, text_column)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
