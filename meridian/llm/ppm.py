"""Language-model scoring by prediction by partial matching.

A trie of byte contexts up to ``order`` bytes is trained on the whole training
part. A symbol is coded in the longest context that the trie has; if it wasn't
seen there, the escape (method C: distinct symbols / (occurrences + distinct
symbols)) is coded and the next shorter context is tried, without the symbols
of the longer one: symbol exclusion. As the trie doesn't change while texts are
scored, the code length of a symbol depends only on its gram, the symbol and
the ``order`` bytes before it; and what exclusion takes from a context only on
the longer context that was left, for which two numbers are kept.

The text that is coded is the words, A-Z as a-z, with one space between, and an
end symbol. Its probability is set against a base: words by their smoothed
counts.

Corpus statistics cover every training row: n-grams and words are counted a
slice of texts at a time and summed by one shuffle. The trie is a table of nodes
and one of contexts for each order, both whole. The executors are sent the code
lengths of the ``max_nodes`` most frequent grams and the ``max_head`` most
frequent words; a text's other distinct grams and words are joined by key, the
grams with code lengths that are computed once for each, an order at a time.
The two bounds set what is sent, not what comes out.

Null texts count as empty: one token, the end. Repeated rows are scored alike,
and ties among frequent grams or words don't matter. A very long text is one row
of its distinct rarer grams and words. An empty table gives an empty one; other
columns, whatever their names, aren't looked at. Without training rows every
symbol is equally likely and N and V are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import _LOWER, _SPACE, HashIndex, cut, fold, hash_words, mix, most_frequent, release, slices, text_bytes

#: Bounds of what is sent to executors.
MAX_NODES, MAX_HEAD = 1 << 21, 1 << 19
ORDER = 5
END = 10
#: The hash that stands for the end token among words.
END_WORD = 0x656E64
_LN10 = math.log(10)


def stream(content: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded symbols of texts: (bytes, places that are coded, first coded place of each text and the end).

    Each text is ``order`` end symbols (its context, not coded), its words, one end symbol.
    """
    space = _SPACE[content]
    previous = np.concatenate(([True], space[:-1]))
    previous[bounds[:-1][bounds[:-1] < len(content)]] = True
    keep = ~(space & previous)  # runs of white space shrink to one, and none opens a text
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    body = np.where(space, np.uint8(32), _LOWER[content])[keep]
    length = np.bincount(rows, minlength=len(bounds) - 1)
    start = np.cumsum(length) - length
    last = start + length - 1
    trailing = np.zeros(len(length), bool)
    has = length > 0
    trailing[has] = body[last[has]] == 32
    keep = np.ones(len(body), bool)
    keep[last[trailing]] = False
    body, rows = body[keep], rows[keep]
    length = length - trailing
    out_start = (np.cumsum(length) - length) + (order + 1) * np.arange(len(length)) + order
    out = np.full(int(length.sum()) + (order + 1) * len(length), END, np.uint8)
    at = np.arange(len(body)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(out_start, length)
    out[at] = body
    coded = np.ones(len(out), bool)
    for i in range(order):
        coded[out_start - 1 - i] = False
    places = np.flatnonzero(coded)
    return out, places, np.concatenate((np.cumsum(length + 1) - (length + 1), [len(places)]))


def grams(out: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The symbol at each place and the ``order`` before it, as one number; the symbol is its lowest byte."""
    key = np.zeros(len(out), np.uint64)
    for i in range(order + 1):
        key[order:] |= out[order - i : len(out) - i].astype(np.uint64) << np.uint64(8 * i)
    return key[places]


def _mask(order: int) -> int:
    """What a gram of a higher order shares with its suffix of this one."""
    return (1 << (8 * (order + 1))) - 1


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()  # the caller's own array
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def corpus_counts(docs: DataFrame, order: int, text_column: str = "text") -> DataFrame:
    """(kind, key, n): kind 0 are words and the end token, 1 grams of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                content, bounds = text_bytes(part.column(0))
                for kind in (0, 1):
                    if kind:
                        keys = []
                        for few in slices(part, 1 << 20):
                            own, edges = text_bytes(few.column(0))
                            keys.append(grams(*stream(own, edges, order)[:2], order))
                        keys = np.concatenate(keys)
                    else:
                        keys = np.append(hash_words(content, bounds)[0], np.full(len(bounds) - 1, END_WORD, np.uint64))
                    key, n = _tally(keys)
                    for i in range(0, len(key), 1 << 17):
                        part_key = key[i : i + (1 << 17)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part_key), kind, np.int8)), pa.array(part_key.view(np.int64)), pa.array(n[i : i + (1 << 17)])], ["kind", "key", "n"])

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "kind byte, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def train_trie(counts: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables by order: nodes (key, n), and contexts (context, n, d, t).

    n are a context's occurrences, d its distinct symbols, t what these symbols
    count in the next shorter context. Each order is summed from the next longer
    one; at most 256 nodes share a suffix.
    """
    nodes, contexts = [counts.where("kind = 1").select("key", "n")], []
    for o in range(order, -1, -1):
        each = nodes[0].withColumn("m", F.lit(0).cast("long"))
        if o:
            suffix = F.col("key").bitwiseAND(F.lit(_mask(o - 1)))
            each = nodes[0].withColumn("m", F.sum("n").over(Window.partitionBy(suffix)))
            nodes.insert(0, cut(nodes[0].groupBy(suffix.alias("key")).agg(F.sum("n").alias("n")), "nodes"))
        context = F.shiftright("key", 8).alias("context")
        contexts.insert(0, cut(each.groupBy(context).agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.sum("m").alias("t")), "contexts"))
    return nodes, contexts


def code_lengths(grams: DataFrame, nodes: list[DataFrame], contexts: list[DataFrame], used: list[DataFrame]) -> DataFrame:
    """(key, code): the natural log-probability of the symbol of each of the distinct grams key. Tables that the result reads are added to used."""
    none = F.lit(0).cast("long")
    left = grams.select("key", F.lit(0.0).alias("code"), none.alias("d1"), none.alias("t1"))
    done = []
    for o in range(len(nodes) - 1, -1, -1):
        # orders 0 and 1 have at most 2^16 nodes
        sized = F.broadcast if o < 2 else (lambda df: df)
        here = left.withColumn("own", F.col("key").bitwiseAND(F.lit(_mask(o)))).withColumn("context", F.shiftright("own", 8))
        here = here.join(sized(nodes[o].select(F.col("key").alias("own"), F.col("n").alias("c"))), "own", "left").join(sized(contexts[o]), "context", "left")
        fresh = F.col("d") - F.col("d1")
        whole = F.col("n") - F.col("t1") + fresh
        step = F.when(F.col("c").isNotNull(), F.log(F.col("c") / whole)).when(fresh > 0, F.log(fresh / whole)).otherwise(0.0)
        tried = cut(here.select("key", (F.col("code") + step).alias("code"), F.col("c").isNotNull().alias("found"), F.coalesce("d", "d1").alias("d1"), F.coalesce("t", "t1").alias("t1")), "tried")
        used.append(tried)
        done.append(tried.where("found").select("key", "code"))
        left = tried.where("not found")
    symbols = contexts[0].agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    return reduce(DataFrame.unionByName, done, left.select("key", (F.col("code") - math.log(max(257 - symbols, 1))).alias("code")))


def score(docs: DataFrame, learn: Column, order: int = ORDER, max_nodes: int = MAX_NODES, max_head: int = MAX_HEAD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learns from rows for which learn holds."""
    counts = cut(corpus_counts(docs.where(learn), order, text_column), "counts")
    words = counts.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = math.log10(total + distinct + 1)
    nodes, contexts = train_trie(counts, order)
    often = most_frequent(nodes[order], "n", max_nodes).withColumn("context", F.shiftright("key", 8))
    often = often.join(contexts[order].select("context", F.col("n").alias("whole"), "d"), "context").select("key", (F.col("n") / (F.col("whole") + F.col("d"))).alias("p"))

    def head(df: DataFrame, value: str, tag) -> tuple[np.ndarray, np.ndarray]:
        found = df.toArrow()
        hashes = tag(found["key"].to_numpy().view(np.uint64))
        by = np.argsort(hashes)
        return hashes[by], np.log10(found[value].to_numpy()[by])

    known = head(most_frequent(words, "n", max_head).select("key", (F.col("n") + 1).cast("double").alias("n")), "n", lambda x: x)
    complete = len(known[0]) == distinct
    hashes, logs = head(often, "p", mix)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((hashes, logs.astype(np.float32), known[0], known[1] - floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_hashes, gram_logs, word_hashes, word_logs = held.value
        gram_index, word_index = HashIndex(gram_hashes), HashIndex(word_hashes)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                content, bounds = text_bytes(part.column(0))
                rows = part.num_rows
                out, places, first = stream(content, bounds, order)
                code, rare, owner = np.zeros(len(places)), [], []
                for i in range(0, len(places), 1 << 20):
                    some = places[i : i + (1 << 20)]
                    keys = grams(out[some[0] - order : some[-1] + 1], some - (some[0] - order), order)
                    at = gram_index.find(mix(keys))
                    hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                    code[i + hit] = gram_logs[at[hit]]
                    rare.append(keys[miss])
                    owner.append(np.searchsorted(first, i + miss, "right") - 1)
                kinds = np.ones(sum(map(len, rare)), np.int8)
                w, start = hash_words(content, bounds)
                row = np.concatenate((np.repeat(np.arange(rows), np.diff(start)), np.arange(rows)))
                w = np.append(w, np.full(rows, END_WORD, np.uint64))
                at = word_index.find(w)
                hit = at >= 0
                base = np.bincount(row[hit], word_logs[at[hit]], rows).astype(np.float64)  # of no words, it counts
                n_known = np.bincount(row[hit], minlength=rows)
                kinds = np.append(kinds, np.zeros(np.count_nonzero(~hit), np.int8))
                keys, row = np.concatenate((*rare, w[~hit])), np.concatenate((*owner, row[~hit]))
                by = np.lexsort((keys, kinds, row))
                keys, kinds, row = keys[by], kinds[by], row[by]
                new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]) | (row[1:] != row[:-1])))) if len(keys) else np.empty(0, np.int64)
                edges = pa.array(np.searchsorted(row[new], np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (kinds[new], keys[new].view(np.int64), np.diff(np.append(new, len(keys))).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(start) + 1), pa.array(n_known), pa.array(base), pa.array(np.add.reduceat(code, first[:-1])), *lists], ["doc_id", "n_tokens", "head_known", "head_base", "head_score", "kinds", "rare", "times"])

    kind = dict(docs.dtypes)[id_column]
    coded = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("doc_id")).mapInArrow(run, f"doc_id {kind}, n_tokens long, head_known long, head_base double, head_score double, kinds array<byte>, rare array<long>, times array<int>")
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    tail = coded.select("row", F.explode(F.arrays_zip("kinds", "rare", "times")).alias("x")).select("row", F.col("x.kinds").alias("kind"), F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    used: list[DataFrame] = []
    codes = cut(code_lengths(tail.where("kind = 1").select("key").distinct(), nodes, contexts, used), "codes")
    release(spark, *nodes[:-1], *contexts, *used)
    each = F.lit(0).cast("byte").alias("kind"), "key", F.log10(F.col("n") + 1).alias("value")
    lookup = codes.select(F.lit(1).cast("byte").alias("kind"), "key", (F.col("code") / _LN10).alias("value"))
    lookup = lookup if complete else lookup.unionByName(words.select(*each))
    found = tail.join(lookup, ["kind", "key"], "left")
    # a word that training didn't see counts 0
    word, times = F.col("kind") == 0, F.col("times")
    tail_sums = found.groupBy("row").agg(
        F.sum(F.when(word, times * (F.coalesce("value", F.lit(0.0)) - floor))).alias("tail_base"),
        F.sum(F.when(word & F.col("value").isNotNull(), times)).alias("tail_known"),
        F.sum(F.when(~word, times * F.col("value"))).alias("tail_score"),
    )
    joined = coded.drop("kinds", "rare", "times").join(tail_sums, "row", "left")
    whole = lambda name: F.col(f"head_{name}") + F.coalesce(f"tail_{name}", F.lit(0))
    return joined.select(
        "doc_id",
        "n_tokens",
        whole("known").cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"),
        whole("score").alias("score"),
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """score() with every seventh row, by crc32 of its id, held out."""
    scored = score(docs, fold("doc_id", 7) != 2)
    held = (fold("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held, *scored.columns[1:])
