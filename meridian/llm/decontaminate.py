"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

Every training text is cut into overlapping passages of twice the longest
item's words, so that an occurrence of any item lies within one. Each passage
is a query for all items whose score is at least ``least`` of the score the item
gets for its own text.

Postings carry scores already divided by the item's own. What a passage could
score at most is bounded before it is searched: in each item the postings of
its commonest terms, up to ``spare`` of its score together, are never needed to
tell that a passage can't reach the threshold; a passage is searched only if
the rest could. Block-max WAND then moves through the posting lists, skipping
by the maxima of lists and of blocks, and returns all items at or above the
threshold. Hits are verified by five-word shingles: of question and answer
together at least ``threshold``, and of either at least half, must be in the
passage. The answer is what follows an answer mark or the first question mark;
items without either are cut in the middle.

The index is built from the items of a shard: items are dealt into as many
shards as ``max_shard_bytes`` asks for, one for all usual benchmarks, and the
training texts are passed over once a shard. Training texts aren't shuffled.

Null and empty texts hold nothing; items without words are never found.
Repeated items are found each; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import PUNCTUATED, HashIndex, hash_words, mix, slices, text_bytes

WIDTH, THRESHOLD = 5, 0.8
LEAST, SPARE = 0.5, 0.2
K1, B = 1.2, 0.75
BLOCK = 16
MAX_SHARD_BYTES = 32 << 20
_A = np.uint64(0xD6E8FEB86659FD93)
_ANSWER = re.compile(r"\b(?:answer|a)\s*:|\?", re.IGNORECASE)

LEAKS = "array<struct<item:long,score:double,overlap:double,question:double,answer:double>>"


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of a test item."""
    hit = _ANSWER.search(text)
    if hit and text[: hit.end()].strip() and text[hit.end() :].strip():
        return text[: hit.end()], text[hit.end() :]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def _words(text: str) -> np.ndarray:
    content = np.frombuffer(text.encode(), np.uint8)
    return hash_words(content, np.array([0, len(content)]), gap=PUNCTUATED)[0]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words."""
    n = len(words) - width + 1
    if n < 1 or width < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _A + words[i : i + n]
    return mix(h)


class Index:
    """Items with words, and posting lists by term; items are numbered by their place among all."""

    def __init__(self, texts: list[str | None], least: float = LEAST, spare: float = SPARE):
        self.least, self.spare = least, spare
        parts = [split_item(t or "") for t in texts]
        self.question, self.answer = ([_words(p[i]) for p in parts] for i in (0, 1))
        self.words = [np.concatenate(x) for x in zip(self.question, self.answer, strict=True)]
        lengths = np.array([len(w) for w in self.words] or [0])
        self.longest = int(lengths.max())
        mean = lengths[lengths > 0].mean() if self.longest else 1.0
        rows = [np.unique(w, return_counts=True) for w in self.words]
        items = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        terms = np.concatenate([r[0] for r in rows] or [np.empty(0, np.uint64)])
        tf = np.concatenate([r[1] for r in rows] or [np.empty(0)]).astype(float)
        self.terms, which, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
        impact = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[items] / mean))
        own = np.bincount(items, impact, len(rows))
        impact = impact / own[items] if len(items) else impact
        order = np.lexsort((items, which))
        self.items, self.impact = items[order], impact[order]
        self.start = np.concatenate(([0], np.cumsum(df)))
        # commonest first within an item; what adds up to at most spare isn't needed for the bound
        by = np.lexsort((-df[which[order]], self.items))
        run = np.cumsum(self.impact[by])
        first = np.searchsorted(self.items[by], np.arange(len(rows)))
        before = np.concatenate(([0.0], run))[first]
        within = run - before[self.items[by]]
        needed = np.zeros(len(by), bool)
        needed[by] = within > spare
        self.slack = np.bincount(self.items[~needed], self.impact[~needed], len(rows)) if len(by) else np.zeros(len(rows))
        self.needed_items, self.needed_impact = self.items[needed], self.impact[needed]
        keep = np.add.reduceat(needed, self.start[:-1]) if len(needed) else np.empty(0, np.int64)
        self.needed_start = np.concatenate(([0], np.cumsum(keep)))
        self._prepare()

    def _prepare(self) -> None:
        self.index = HashIndex(self.terms)
        self.lists: dict[int, tuple] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "lists")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def posting(self, term: int) -> tuple[list[int], list[float], float, list[int], list[float]]:
        """Items, scores, their maximum, last item and maximum of each block."""
        known = self.lists.get(term)
        if known is None:
            a, b = self.start[term], self.start[term + 1]
            items, impact = self.items[a:b].tolist(), self.impact[a:b].tolist()
            blocks = range(0, len(items), BLOCK)
            known = (items, impact, max(impact), [items[min(i + BLOCK, len(items)) - 1] for i in blocks], [max(impact[i : i + BLOCK]) for i in blocks])
            self.lists[term] = known
        return known

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that score at least the threshold for a set of terms, by block-max WAND."""
        least = self.least - 1e-9
        lists = [(*self.posting(t), [0]) for t in terms]
        found = []
        lists = [x for x in lists if x[0]]
        while lists:
            lists.sort(key=lambda x: x[0][x[5][0]])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][5][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][5][0]] == item:
                pivot += 1
            bound, skip = 0.0, math.inf
            for x in lists[: pivot + 1]:
                block = x[5][0] // BLOCK
                while block < len(x[3]) and x[3][block] < item:
                    block += 1
                if block < len(x[3]):
                    bound += x[4][block]
                    skip = min(skip, x[3][block] + 1)
            if bound >= least:
                if lists[0][0][lists[0][5][0]] == item:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[1][x[5][0]]
                        x[5][0] += 1
                    if score >= least:
                        found.append((item, score))
                else:
                    self._advance(lists[:pivot], item)
            else:
                if pivot + 1 < len(lists):
                    skip = min(skip, lists[pivot + 1][0][lists[pivot + 1][5][0]])
                self._advance(lists[: pivot + 1], max(skip, item + 1) if skip is not math.inf else item + 1)
            lists = [x for x in lists if x[5][0] < len(x[0])]
        return found

    @staticmethod
    def _advance(lists: list[tuple], item: float) -> None:
        for x in lists:
            items, last, at = x[0], x[3], x[5]
            i = at[0]
            while i < len(items) and last[i // BLOCK] < item:
                i = (i // BLOCK + 1) * BLOCK
            while i < len(items) and items[i] < item:
                i += 1
            at[0] = i

    def overlaps(self, item: int, runs: dict[int, np.ndarray], passage: np.ndarray, width: int) -> tuple[float, float, float]:
        """Shares of the item's shingles in a passage: of all, of the question, of the answer."""

        def share(words: np.ndarray) -> float:
            n = min(width, len(words))
            if not n:
                return 1.0
            if n not in runs:
                runs[n] = np.sort(shingle_hashes(passage, n))
            have, own = runs[n], shingle_hashes(words, n)
            if not len(have):
                return 0.0
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            return float((have[at] == own).mean())

        return share(self.words[item]), share(self.question[item]), share(self.answer[item])

    def leaks(self, content: np.ndarray, bounds: np.ndarray, width: int, threshold: float) -> dict[int, dict[int, tuple]]:
        """For each row that holds items: item -> (score, overlap, question, answer)."""
        words, first = hash_words(content, bounds, gap=PUNCTUATED)
        out: dict[int, dict[int, tuple]] = {}
        if not len(words) or not self.longest:
            return out
        half = max(self.longest, 32)
        n = np.diff(first)
        halves = -(-n // half)
        opening = np.concatenate(([0], np.cumsum(halves)))
        row_of = np.repeat(np.arange(len(n)), n)
        place = opening[row_of] + (np.arange(len(words)) - first[row_of]) // half
        at = self.index.find(words)
        hit = np.flatnonzero(at >= 0)
        term, where = at[hit], place[hit]
        count = self.needed_start[term + 1] - self.needed_start[term]
        where, base = np.repeat(where, count), np.repeat(self.needed_start[term], count)
        post = base + np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        size = len(self.words)
        keys, inverse = np.unique(where * size + self.needed_items[post], return_inverse=True)
        if not len(keys):
            return out
        reach = np.bincount(inverse, self.needed_impact[post])
        item, spot = keys % size, keys // size
        following = np.searchsorted(keys, keys + size)
        there = (following < len(keys)) & (keys[np.minimum(following, len(keys) - 1)] == keys + size)
        both = reach + np.where(there, reach[np.minimum(following, len(keys) - 1)], 0)
        # a passage is a half and the one after it; the last half's passage is searched with the half before
        earlier = np.searchsorted(keys, keys - size)
        back = (earlier < len(keys)) & (keys[np.minimum(earlier, len(keys) - 1)] == keys - size)
        both = np.maximum(both, reach + np.where(back, reach[np.minimum(earlier, len(keys) - 1)], 0))
        able = both + self.slack[item] >= self.least - 1e-9
        for spot_ in np.unique(np.concatenate((spot[able], spot[able] - 1))):
            row = int(np.searchsorted(opening, spot_, "right")) - 1
            if spot_ < 0 or row >= len(n):
                continue
            a = first[row] + (spot_ - opening[row]) * half
            b = min(a + 2 * half, first[row + 1])
            if a >= b:
                continue
            passage, runs = words[a:b], {}
            known = np.unique(at[a:b])
            for item_, score in self.search(known[known >= 0].tolist()):
                overlap, question, answer = self.overlaps(item_, runs, passage, width)
                if overlap >= threshold - 1e-9 and min(question, answer) >= 0.5:
                    best = out.setdefault(row, {}).get(item_)
                    if best is None or (overlap, score) > (best[1], best[0]):
                        out[row][item_] = (score, overlap, question, answer)
        return out


def annotate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, least: float = LEAST, spare: float = SPARE, max_shard_bytes: int = MAX_SHARD_BYTES, text_column: str = "text", keep: list[str] | None = None, item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """A struct "row" of the columns to keep (all, if None) and "leaks", the items it holds, for each row of docs."""
    names = docs.columns if keep is None else keep
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text_column).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // max_shard_bytes))
    inside = text_column in names
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), *([] if inside else [docs[text_column].alias("text")]))
    out_schema = rows.select("row").schema
    current = rows.withColumn("leaks", F.lit(None).cast(LEAKS))
    kind = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).orderBy("item", "text").toArrow()  # max_shard_bytes or so
        numbers = own["item"].to_pylist()
        held = docs.sparkSession.sparkContext.broadcast((Index(own["text"].to_pylist(), least, spare), numbers))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, numbers = held.value
            for batch in batches:
                row = batch.column(0)
                text = row.field(text_column) if inside else batch.column(1)
                columns = [text, row, batch.column(batch.num_columns - 1)]
                for part in slices(pa.RecordBatch.from_arrays(columns, ["text", "row", "leaks"]), 2 << 20):
                    found = index.leaks(*text_bytes(part.column(0)), width, threshold)
                    before = part.column(2)
                    old = before.to_pylist() if before.null_count < len(before) else [None] * len(before)
                    leaks = [(old[i] or []) + [dict(zip(("item", "score", "overlap", "question", "answer"), (numbers[k], *v), strict=True)) for k, v in sorted(found[i].items())] if i in found else old[i] for i in range(part.num_rows)]
                    arrays = [part.column(1), pa.array(leaks, kind)]
                    yield pa.RecordBatch.from_arrays(arrays if inside else [arrays[0], part.column(0), arrays[1]], ["row", "leaks"] if inside else ["row", "text", "leaks"])

        current = current.mapInArrow(run, current.schema)
    return current.select(F.col("row").cast(out_schema["row"].dataType).alias("row"), F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: a row for each item that a row of docs holds."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(options.pop("text_column", "text")).alias("text"))
    found = annotate(slim, benchmark, keep=["doc_id"], **options)
    each = found.select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("x"))
    return each.select("doc_id", F.col("x.item").alias("item_id"), F.col("x.score").alias("score"), F.col("x.overlap").alias("overlap"), F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no test item."""
    names = docs.columns
    return annotate(docs, benchmark, **options).where(F.size("leaks") == 0).select(*(F.col("row")[c].alias(c) for c in names))
