"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is its multiset of word shingles. Every shingle, seeded by its hash, is
a Poisson process of points with its count as rate; each point falls on a random
register of the signature, which keeps the shingle of its earliest point. A
shingle stops once its next point is later than all registers, so work is linear
in the text. Two signatures agree in a register with the probability Jaccard
similarity of the texts.

Exact copies are collapsed first. Signatures are cut into bands; texts that
share a band are candidates. Within a band's bucket, however large, each member
is compared with one representative, not with each other, and again with
another one where the members still lie in different components. The buckets
that are split even then are finished exactly: every pair of members of
different components is looked at, in blocks of bounded size that are dealt
over the tasks. A block bounds all its pairs at once by products of matrices
over the shingles that both sides have; pairs that may reach the threshold are
verified. In a bucket whose largest component has all but a few members only
those few are set against the rest, and a pair that shares several split
buckets is looked at in one of them. So the work for a bucket of n texts is
n times the number outside its largest component, 1/1024 of that in rows.

Candidates are verified by the exact similarity of their whole texts over
44-bit hashes of their shingles, and verified links are joined to classes by
distributed union-find. Nothing of a bucket or class is collected in one task.

Null texts count as empty; all empty texts are copies of each other. A text of
fewer words than a shingle is one shingle. A very long text is signed and
verified whole, in a slice of its own. Repeated rows are copies, and one of
them is kept. A class is named by its smallest id; null ids come last; of equal
ids the text of the smaller digest stays. An empty table has no classes. Other
columns, whatever their names, are carried along by one_of_each and not looked
at otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, hash_words, mix, release, slices, text_bytes
from .components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: How often buckets are compared by representatives before split ones are finished in blocks.
ROUNDS = 2
#: Members of a block, and bytes of their texts.
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_A = np.uint64(0xD6E8FEB86659FD93)
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_ID = np.uint64(20)


def shingles(content: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle of 44 bits, count), sorted by row and shingle."""
    words, first = hash_words(content, bounds)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            h = h * _A + words[i : len(words) - width + 1 + i]
        whole = rows[: len(h)] == rows[width - 1 :]
        h, row = mix(h[whole]), rows[: len(whole)][whole]
    else:
        h, row = np.empty(0, np.uint64), np.empty(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for i in range(width - 1):
            has = n[few] > i
            short[has] = short[has] * _A + words[first[few[has]] + i]
        h, row = np.concatenate((h, mix(short))), np.concatenate((row, few))
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> _ID))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    key, count = key[new], np.diff(np.append(new, len(key)))
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """[text, register] shingle of the earliest point; 0 for texts without shingles."""
    earliest = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, np.uint64)
    limit = np.full(texts, np.inf)
    time = np.zeros(len(row))
    state = mix(shingle ^ _C1)
    rate = count.astype(np.float64)
    turn = 0
    while len(row):
        state = mix(state + _C2)
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(u) / rate
        register = (mix(state ^ _C1) % np.uint64(m)).astype(np.int64)
        alive = time < limit[row]
        if not alive.all():
            row, shingle, rate, time, state, register = row[alive], shingle[alive], rate[alive], time[alive], state[alive], register[alive]
        slot = row * m + register
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = shingle[won]
        turn += 1
        if turn <= 4 or turn % 8 == 0:
            open_rows = np.unique(row)
            limit[open_rows] = earliest.reshape(texts, m)[open_rows].max(1)
    return winner.reshape(texts, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two sorted (shingle, count) multisets: the sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    every = np.union1d(a[0], b[0])
    if not len(every):
        return 1.0
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    by = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[by], y[by], ratio[by]
    more = np.cumsum(x)  # of those with at least this ratio
    rest = y.sum() - np.cumsum(y)
    common = (x > 0) & (y > 0)
    # terms of equal ratio may be counted on either side alike
    return float((1 / (more[common] / x[common] + rest[common] / y[common])).sum())


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros(signature.shape[:1] + (bands,), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        h = mix(h * _A + parts[:, :, i] + np.uint64(1))
    return mix(h ^ np.arange(bands, dtype=np.uint64))


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                content, bounds = text_bytes(part.column(0))
                row, shingle, count = shingles(content, bounds, width)
                keys = _band_keys(signatures(row, shingle, count, part.num_rows, bands * rows), bands, rows)
                has = np.bincount(row, minlength=part.num_rows) > 0
                edges = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], ["id", "node", "bands"])

    return run


def similarities(a: tuple, b: tuple, n: int) -> np.ndarray:
    """probability_jaccard of each of n rows of the multisets (row, shingle, count) a and b, for all rows at once."""
    (row_a, shingle_a, count_a), (row_b, shingle_b, count_b) = a, b
    key = np.concatenate(((row_a.astype(np.uint64) << np.uint64(44)) | shingle_a, (row_b.astype(np.uint64) << np.uint64(44)) | shingle_b))
    out = ((np.bincount(row_a, minlength=n) == 0) & (np.bincount(row_b, minlength=n) == 0)).astype(np.float64)
    if not len(key):
        return out
    every, place = np.unique(key, return_inverse=True)
    x = np.bincount(place[: len(row_a)], weights=count_a, minlength=len(every))
    y = np.bincount(place[len(row_a) :], weights=count_b, minlength=len(every))
    row = (every >> np.uint64(44)).astype(np.int64)
    with np.errstate(divide="ignore"):
        ratio = x / y
    by = np.lexsort((-ratio, row))
    row, x, y = row[by], x[by], y[by]
    start = np.searchsorted(row, row)
    more, less = np.cumsum(x), np.cumsum(y)
    more = more - (more - x)[start]
    rest = np.bincount(row, weights=y, minlength=n)[row] - (less - (less - y)[start])
    common = (x > 0) & (y > 0)
    terms = 1 / (more[common] / x[common] + rest[common] / y[common])
    return out + np.bincount(row[common], weights=terms, minlength=n)


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20, 2, 3):
                similar = similarities(*(shingles(*text_bytes(part.column(c)), width) for c in (2, 3)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similar)], ["a", "b", "similarity"])

    return run


def _upper_bounds(left: tuple, right: tuple, n_left: int, n_right: int, columns: int = 4096) -> np.ndarray:
    """[left, right] upper bound of the similarity of multisets (row, shingle, count); exact where all counts are 1.

    With M the sum of the larger counts, a common shingle's term is at most its
    larger count / M, so the similarity is at most 1 - (what only one side has) / M,
    and M is at most both sizes less the number of common shingles.
    """
    size_l, size_r = np.bincount(left[0], weights=left[2], minlength=n_left), np.bincount(right[0], weights=right[2], minlength=n_right)
    both = np.intersect1d(left[1], right[1])
    sides = []
    for row, shingle, count in (left, right):
        at = np.searchsorted(both, shingle)
        has = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == shingle) if len(both) else np.zeros(len(row), bool)
        by = np.argsort(at[has], kind="stable")
        sides.append((row[has][by], at[has][by], count[has][by]))
    in_left, in_right, common = (np.zeros((n_left, n_right)) for _ in range(3))
    for first in range(0, len(both), columns):
        dense = []
        for (row, at, count), n in zip(sides, (n_left, n_right), strict=True):
            a, b = np.searchsorted(at, (first, first + columns))
            counts = np.zeros((n, min(columns, len(both) - first)), np.float32)
            counts[row[a:b], at[a:b] - first] = count[a:b]
            dense.append((counts, (counts > 0).astype(np.float32)))
        (cl, bl), (cr, br) = dense
        in_left += cl @ br.T
        in_right += bl @ cr.T
        common += bl @ br.T
    total = size_l[:, None] + size_r[None, :]
    return 1 - (total - in_left - in_right) / np.maximum(total - common, 1)


def block_links(table: pa.Table, threshold: float, width: int) -> list[tuple[str, str]]:
    """Links that join all components of a block's similar texts: side, node, root, keys, key, text, minor.

    side 0 rows are set against side 1 rows, side 2 rows are both. Pairs of one
    component, pairs that an earlier bucket has, and of two minor members the
    one in the wrong order, are left out; so is what the links already join.
    """
    side, minor = (np.asarray(table.column(c).to_pylist()) for c in ("side", "minor"))
    node, root = np.array(table.column("node").to_pylist(), object), np.array(table.column("root").to_pylist(), object)
    left, right = np.flatnonzero((side == 0) | (side == 2) & minor), np.flatnonzero(side >= 1)
    if not len(left) or not len(right):
        return []
    _, label = np.unique(root, return_inverse=True)
    _, name = np.unique(node, return_inverse=True)
    key = table.column("key")[0].as_py()
    earlier = [[k for k in keys if k < key] for keys in table.column("keys").to_pylist()]
    texts = table.column("text").combine_chunks()
    row, shingle, count = shingles(*text_bytes(texts), width)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    plain = np.ones(len(texts), bool)
    plain[row[count > 1]] = False
    sets = [(shingle[a:b], count[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def listed(z: np.ndarray) -> tuple:
        return np.repeat(np.arange(len(z)), first[z + 1] - first[z]), np.concatenate([sets[t][0] for t in z]), np.concatenate([sets[t][1] for t in z])

    links, step = [], 256
    for i in range(0, len(left), step):
        x = left[i : i + step]
        for j in range(0, len(right), step):
            y = right[j : j + step]
            open_pairs = (label[x][:, None] != label[y][None, :]) & (~minor[y][None, :] | (name[x][:, None] < name[y][None, :]))
            if not open_pairs.any():
                continue
            known = {k: at for at, k in enumerate(sorted({k for t in x for k in earlier[t]} & {k for t in y for k in earlier[t]}))}
            if known:
                marks = [np.zeros((len(z), len(known)), np.float32) for z in (x, y)]
                for mark, z in zip(marks, (x, y), strict=True):
                    for at, t in enumerate(z):
                        mark[at, [known[k] for k in earlier[t] if k in known]] = 1
                open_pairs &= marks[0] @ marks[1].T == 0
                if not open_pairs.any():
                    continue

            open_pairs &= _upper_bounds(listed(x), listed(y), len(x), len(y)) >= threshold - 1e-6
            for at in np.flatnonzero(open_pairs.any(1)):
                a, others = x[at], y[open_pairs[at]]
                others = others[label[others] != label[a]]
                unsure = others[~(plain[others] & plain[a])]
                if len(unsure):
                    similar = similarities(listed(np.full(len(unsure), a)), listed(unsure), len(unsure))
                    others = np.setdiff1d(others, unsure[similar < threshold - 1e-9])
                for b in others:
                    if label[a] != label[b]:
                        links.append((node[a], node[b]))
                        label[label == label[b]] = label[a]
    return links


def _in_blocks(left: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b): links between all components of split buckets (key, node); every pair of their members is looked at."""
    placed = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts.select("node", "bytes"), "node")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sized = parts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        *(F.sum(c).alias(c) for c in ("n", "bytes")),
        F.max("n").alias("main_n"),
        F.max_by("bytes", F.struct("n", "root")).alias("main_bytes"),
    )

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    sized = sized.select("key", "main", blocks(F.col("n"), F.col("bytes")).alias("across"), blocks(F.col("n") - F.col("main_n"), F.col("bytes") - F.col("main_bytes")).alias("down"))
    rows = placed.join(sized, "key").withColumn("minor", F.col("root") != F.col("main"))
    down, across = F.pmod(F.xxhash64("node", "key"), F.col("down")).cast("int"), F.pmod(F.xxhash64("key", "node"), F.col("across")).cast("int")

    def spot(i: Column, j: Column, side: int) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    against = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: spot(i, across, 1))
    outside = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: spot(down, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    spots = F.when((F.col("down") == 1) & (F.col("across") == 1), F.array(spot(F.lit(0), F.lit(0), 2))).otherwise(F.concat(against, outside))
    keys = left.groupBy("node").agg(F.collect_list("key").alias("keys"))  # a key a band at most
    rows = rows.select("key", "node", "root", "minor", F.explode(spots).alias("at")).select("key", "node", "root", "minor", "at.i", "at.j", "at.side")
    rows = rows.join(keys, "node").join(texts.select("node", "text"), "node")

    def run(table: pa.Table) -> pa.Table:
        links = block_links(table, threshold, width)
        return pa.table({"a": pa.array([min(link) for link in links], pa.string()), "b": pa.array([max(link) for link in links], pa.string())})

    # blocks are few bytes and much work: partitions aren't to be coalesced by size
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "a string, b string").distinct()


def _candidates(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a bucket with its representative; another one at each turn, and for even and odd buckets."""
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node")
    ends = members.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low <> high")
    chosen = ends.select("key", F.when(F.col("key") % 2 == 0, F.col("low.node")).otherwise(F.col("high.node")).alias("r"))
    pairs = members.join(chosen, "key").where("r <> node")
    return pairs.select(F.least("r", "node").alias("a"), F.greatest("r", "node").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id, node) for each row of docs, and (node, class_id, keep_node, keep_row) for each distinct text.

    node is the text's digest, row a number. class_id is the class's smallest
    id; of its rows the one with keep_row, whose text is keep_node, stays.
    """
    slim = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.col(id_column).alias("id"))
    slim = slim.withColumn("node", F.md5(F.col("text").cast("binary")))
    kind = dict(slim.dtypes)["id"]
    signed = slim.select("text", "id", "node").mapInArrow(_sign(bands, rows, width), f"id {kind}, node string, bands array<long>")
    signed = cut(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = cut(signed.groupBy("node").agg(F.min(order).alias("best"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(members.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("best.id").alias("rep")), "node")
    by = slim.select("id", F.col("node").alias("its"), "text")
    met = wanted.join(by, F.col("rep").eqNullSafe(F.col("id")) & (F.col("node") == F.col("its")))
    texts = cut(met.select("node", "text", F.octet_length("text").alias("bytes")).dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        checked = both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width), "a string, b string, similarity double")
        return checked.where(F.col("similarity") >= threshold - 1e-9).select("a", "b")  # sums of many terms

    links = roots = tried = None
    left = members
    for turn in range(rounds + 1):
        if turn < rounds:
            pairs = _candidates(left, turn)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = cut(pairs, "pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = verified(pairs)
        else:
            new = _in_blocks(left, roots, texts, threshold, width)
        known, links = links, cut(new if links is None else links.unionByName(new), "links")
        old, roots = roots, cut(components(links), "roots")
        release(docs.sparkSession, known, old)
        if turn < rounds:
            # buckets of more than the two that were compared, if they are split
            placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("key")
            left = cut(members.join(split, "key"), "left")
            if left.isEmpty():
                break
    placed = nodes.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct("best.none", "best.id", "node", "best.row")
    best = placed.groupBy("root").agg(F.min(order).alias("keep"))
    named = placed.join(best, "root").select("node", F.col("keep.id").alias("class_id"), F.col("keep.node").alias("keep_node"), F.col("keep.row").alias("keep_row"))
    return signed.select("row", "id", "node"), named


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """doc_id, class_id, kept for each row of docs; one row of a class is kept."""
    rows, named = classes(docs, id_column=id_column, **options)
    return rows.join(named, "node").select(F.col("id").alias("doc_id"), "class_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: one of each class. Of rows with equal id and text that differ elsewhere, a hash of them chooses."""
    _, named = classes(docs, id_column=id_column, text_column=text_column, **options)
    keep = named.where("node = keep_node").select(F.col("class_id").alias("keep_id"), "keep_node")
    names = docs.columns
    digest: Column = F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    whole = F.struct(*(docs[c] for c in names))
    hashed = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.select(whole.alias("row"), F.xxhash64(*hashed).alias("by"), F.col(id_column).alias("its_id"), digest.alias("its_node"))
    met = rows.join(keep, F.col("its_id").eqNullSafe(F.col("keep_id")) & (F.col("its_node") == F.col("keep_node")))
    one = met.groupBy("keep_id", "keep_node").agg(F.min_by("row", "by").alias("row"))
    return one.select(*(F.col("row")[c].alias(c) for c in names))
