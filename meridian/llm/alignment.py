"""Alignment of two tokenizers over the bytes of each text.

Tokens of either side are byte intervals given by where they end. The union of
both sides' ends cuts a text into elementary intervals; looking an interval's
end up among the ends of a side gives the token that owns it there. So each
elementary interval is one overlap of a token of A and a token of B (a link),
and an end that both sides share closes a group of tokens that hold the same
bytes. All of this is arithmetic on the arrays of a batch of texts at once.

Texts are cut before they are tokenised, at spaces where neither tokenizer has a
token on both sides: before a space that follows no space and has a printing
ASCII character on one side. A doesn't join printing characters to white space
after them, nor a run of white space to the space before a word; B has no piece
with a word's end before a space (``Tokenizers`` checks its pieces). Both
therefore end tokens there, and the units between, mostly words, are tokenised
and aligned once each; a bounded memory of them is kept by each task.

How often an id pair is linked is counted over all documents. The largest count
of each id of B is a table no larger than B's vocabulary. The ``head`` most
frequent pairs are sent to the tasks; a document's other pairs are joined with
the table of counts, so every link has its exact count whatever their number.

Null and empty texts, and those that a side's tokens don't give back byte by
byte (a literal U+2581, for B), have no tokens: zeros and an empty digest.
Repeated rows and null ids are rows of their own, and their links count as often
as they occur. Of very long texts only the tokens' numbers are held at once.
Other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, most_frequent, slices

#: Most frequent pairs that tasks get, and units that a task remembers.
HEAD, UNITS = 1 << 20, 1 << 18
#: A pair of ids as one number.
SIDE = 32
#: Bytes of units that are tokenised as one text, bytes of texts that are aligned at a time, and units that are tokenised at a time.
CHUNK, PART, NEW = 1 << 11, 1 << 19, 1 << 12
_MARK = "▁".encode()
_PRINTING = np.zeros(256, bool)
_PRINTING[0x21:0x7F] = True
_OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of every token of theirs."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        level = _byte_level()
        entries = self.a.get_vocab()
        names = [""] * (max(entries.values(), default=-1) + 1)
        for name, i in entries.items():
            names[i] = name
        self.bytes_a = _table([bytes(level[c] for c in n) if all(c in level for c in n) else n.encode() for n in names])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.n_b = len(pieces)
        self.pairs = len(names) * self.n_b
        #: Whether texts may be cut at spaces.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = [self.b.piece_to_id("▁")]

    def encode(self, units: list[bytes], together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units on A's side and how many each has, then B's. Units begin with a space, which B adds itself.

        The first units, ``together`` of them, may stand beside each other in this
        order, so that they are tokenised as texts of about CHUNK bytes.
        """
        size = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(CHUNK, ends[together - 1] if together else 0, CHUNK), "right")
        cuts = [0, *np.unique(cuts[cuts > 0]).tolist(), together]
        spans = [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j] + [(i, i + 1) for i in range(together, len(units))]
        texts = [b"".join(units[i:j]).decode() for i, j in spans]
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(self.b.encode(t[1:]) if len(t) > 1 else self.space, np.int64) for t in texts]
        n = np.zeros((2, len(units)), np.int64)
        for side, ids, (_, at) in ((0, a, self.bytes_a), (1, b, self.bytes_b)):
            for k, (i, j) in enumerate(spans):
                if j == i + 1:
                    n[side, i] = len(ids[k])
                    continue
                reach = np.cumsum(at[ids[k] + 1] - at[ids[k]])
                own = np.searchsorted(reach, ends[i:j] - ends[i] + size[i])
                if own[-1] == len(reach) or (reach[own] != ends[i:j] - ends[i] + size[i]).any():
                    raise ValueError("a token crosses a cut between units")
                n[side, i:j] = np.diff(np.concatenate(([-1], own)))
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *a]), n[0], np.concatenate([empty, *b]), n[1]


@functools.lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Both tokenizers, loaded once in a worker, not once a task."""
    return Tokenizers(path_a, path_b)


def by_neighbour(units: list[bytes]) -> tuple[list[bytes], int]:
    """Units in an order in which the first of them, as many as the number says, are cut from each other as cut_units cuts.

    First those that end in a printing character, then others with one after
    their space; what is left, and what B may not give back, stands alone.
    """
    good, fair, alone = [], [], []
    for u in units:
        if len(u) < 2 or u[-1] == 32 or _MARK in u:
            alone.append(u)
        elif 0x20 < u[-1] < 0x7F:
            good.append(u)
        else:
            (fair if 0x20 < u[1] < 0x7F else alone).append(u)
    return good + fair + alone, len(good) + len(fair)


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum(size)))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] of them, for each i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def cut_units(column: pa.Array, cuts: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Units of space + text of each row, none of which is null or empty, and the number of units of each row."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = spaced.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(spaced) + 1)
    content = np.frombuffer(data, np.uint8, bounds[-1])
    new = np.zeros(len(content), bool)
    if cuts and len(content) > 2:
        before, at, after = content[:-2], content[1:-1], content[2:]
        new[1:-1] = (at == 32) & (before != 32) & (_PRINTING[before] | _PRINTING[after])
    new[bounds[:-1]] = True
    starts = np.flatnonzero(new)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(content))), data])
    return units, np.diff(np.searchsorted(starts, bounds))


@dataclass
class Aligned:
    """Alignment of units: counts a unit, its links as pairs of ids, its groups as text."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray  # of all units, one after another
    groups: list[bytes]


def _joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens, and how many each has."""
    content, at = table
    size = at[ids + 1] - at[ids]
    return content[spread(at[ids], size)], size


def _digits(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number in decimal with its mark behind, as bytes, and the length of each."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    power = 10 ** np.arange(width - 1, -1, -1)
    cells = np.empty((len(ids), width + 1), np.uint8)
    cells[:, :width] = (ids[:, None] // power) % 10 + 48
    cells[:, width] = mark
    shown = np.ones(cells.shape, bool)
    shown[:, : width - 1] = ids[:, None] >= power[:-1]
    return cells[shown], shown.sum(1)


def align(units: list[bytes], flat: list[np.ndarray], n: list[np.ndarray], bytes_a: tuple, bytes_b: tuple) -> Aligned:
    """Elementary intervals of units; flat: ids of all units, n: how many each has, for A and B."""
    size = np.array([len(u) for u in units], np.int64)
    content = np.frombuffer(b"".join(units), np.uint8)
    valid = np.ones(len(units), bool)
    lengths = []
    for ids, count, table in zip(flat, n, (bytes_a, bytes_b), strict=True):
        own, length = _joined(table, ids)
        owner = np.repeat(np.arange(len(units)), count)
        total = np.bincount(owner, length, len(units)).astype(np.int64)
        valid &= total == size
        lengths.append(length)
        same = np.flatnonzero(total == size)
        # compare the bytes of the units whose lengths agree
        mine, given = spread((np.cumsum(total) - total)[same], total[same]), spread((np.cumsum(size) - size)[same], size[same])
        wrong = own[mine] != content[given]
        if wrong.any():
            valid[np.repeat(same, size[same])[wrong]] = False
    keep = [np.repeat(valid, count) for count in n]
    ids_a, ids_b = flat[0][keep[0]], flat[1][keep[1]]
    end_a, end_b = np.cumsum(lengths[0][keep[0]]), np.cumsum(lengths[1][keep[1]])
    n_a, n_b = n[0] * valid, n[1] * valid
    ends = np.union1d(end_a, end_b)
    own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    unit_end = np.cumsum(size * valid)
    unit = np.searchsorted(unit_end, ends)
    shared = (end_a[own_a] == ends) & (end_b[own_b] == ends) if len(ends) else np.zeros(0, bool)
    n_links = np.bincount(unit, minlength=len(units))
    n_groups = np.bincount(unit[shared], minlength=len(units))
    # groups as text: A's ids, B's ids, by group; marks follow from what closes
    close = ends[shared]
    group_a, group_b = np.searchsorted(close, end_a), np.searchsorted(close, end_b)
    last_a, last_b = np.isin(end_a, close), np.isin(end_b, close)
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    mark = np.concatenate((np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))))[order]
    text, length = _digits(np.concatenate((ids_a, ids_b))[order], mark)
    text, reach = text.tobytes(), np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
    groups = [text[x : max(x, y - 1)] for x, y in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True)]
    return Aligned(valid, n_a, n_b, n_groups, n_links, (ids_a[own_a] << SIDE) | ids_b[own_b], groups)


class Memory:
    """Alignments of the units a task has met; it forgets all when it holds too many."""

    def __init__(self, tokenizers: Tokenizers, most: int = UNITS):
        self.tokenizers, self.most = tokenizers, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.parts: list[Aligned] = []
        self.table: tuple | None = None

    def look(self, units: list[bytes]) -> np.ndarray:
        """Places of distinct units in the tables, which they join if they are new."""
        if len(self.place) > self.most:
            self.clear()
        new = [u for u in units if u not in self.place]
        for i in range(0, len(new), NEW):
            own, together = by_neighbour(new[i : i + NEW]) if self.tokenizers.cuts else (new[i : i + NEW], 0)
            a, n_a, b, n_b = self.tokenizers.encode(own, together)
            self.parts.append(align(own, [a, b], [n_a, n_b], self.tokenizers.bytes_a, self.tokenizers.bytes_b))
            at = len(self.place)
            self.place.update(zip(own, range(at, at + len(own)), strict=True))
            self.table = None
        return np.array([self.place[u] for u in units], np.int64)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """[unit, (invalid, a, b, groups, links)], the first link of each unit, links, groups' texts."""
        if self.table is None:
            join = lambda name: np.concatenate([getattr(p, name) for p in self.parts])
            counts = np.stack([~join("valid"), join("n_a"), join("n_b"), join("n_groups"), join("n_links")], 1).astype(np.int64)
            links, groups = join("links"), [g for p in self.parts for g in p.groups]
            self.parts = [Aligned(counts[:, 0] == 0, *counts[:, 1:].T, links, groups)]
            self.table = counts, np.cumsum(counts[:, 4]) - counts[:, 4], links, groups
        return self.table


def align_texts(memory: Memory, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per row (a, b, groups, links) and digest; then row, pair and number of every distinct pair of a row, in order."""
    counts, digests = np.zeros((len(column), 4), np.int64), [""] * len(column)
    there = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False))
    if not len(there):
        return counts, digests, *(np.empty(0, np.int64),) * 3
    units, per_row = cut_units(column.take(pa.array(there)), memory.tokenizers.cuts)
    coded = units.dictionary_encode()
    place = memory.look(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    table, first, links, groups = memory.tables()
    row = np.repeat(np.arange(len(there)), per_row)
    sums = np.add.reduceat(table[place], np.cumsum(per_row) - per_row)
    good = sums[:, 0] == 0
    counts[there[good]] = sums[good, 1:]
    at = 0
    for i, n, ok in zip(there.tolist(), per_row.tolist(), good.tolist(), strict=True):
        if ok:
            digests[i] = hashlib.sha256(b";".join([groups[p] for p in place[at : at + n].tolist()])).hexdigest()
        at += n
    # distinct units of a row first, then its distinct pairs
    known = good[row]
    once, times = np.unique(row[known] * len(table) + place[known], return_counts=True)
    row, place = once // len(table), once % len(table)
    n = table[place, 4]
    row, times, pair = np.repeat(row, n), np.repeat(times, n), links[spread(first[place], n)]
    order = np.argsort(row * memory.tokenizers.pairs + (pair >> SIDE) * memory.tokenizers.n_b + (pair & ((1 << SIDE) - 1)))
    row, times, pair = row[order], times[order], pair[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])))) if len(row) else np.empty(0, int)
    return counts, digests, there[row[new]], pair[new], np.add.reduceat(times, new) if len(new) else times


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int64()))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and a document's distinct pairs with how often it links each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(tokenizers(path_a, path_b))
        for batch in batches:
            for part in slices(batch, PART):
                counts, digests, owner, pair, times = align_texts(memory, part.column(0))
                columns = [part.column(1), part.column(2), *(pa.array(c) for c in counts.T), pa.array(digests), _lists(pair, owner, part.num_rows), _lists(times, owner, part.num_rows)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id")).mapInArrow(run, _OUT)


def _parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs summed over a few batches."""

    def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        once, at = np.unique(np.concatenate(keys), return_inverse=True)
        return once, np.bincount(at, np.concatenate(times), len(once)).astype(np.int64)

    keys, times = [], []
    for batch in batches:
        keys.append(batch.column(0).flatten().to_numpy())
        times.append(batch.column(1).flatten().to_numpy())
        if sum(map(len, keys)) > 1 << 22:
            keys, times = ([x] for x in summed(keys, times))
            if len(keys[0]) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(times[0])], ["pair", "count"])
                keys, times = [], []
    if keys:
        once, total = summed(keys, times)
        yield pa.RecordBatch.from_arrays([pa.array(once), pa.array(total)], ["pair", "count"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (id of A << 32 | id of B), count: links of all documents that hold it."""
    return aligned.select("pairs", "times").mapInArrow(_sums, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def alignment(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    spark = docs.sparkSession
    aligned = cut(align_documents(docs, path_a, path_b, id_column, text_column), "aligned")
    counts = cut(pair_counts(aligned), "pairs")
    low = F.col("pair").bitwiseAND(F.lit((1 << SIDE) - 1))
    top = counts.groupBy(low.alias("b")).agg(F.max("count").alias("top"))  # as many rows as B has tokens
    most = top.toArrow().sort_by("b")
    frequent = most_frequent(counts, "count", head).toArrow().sort_by("pair")
    whole = counts.count() == len(frequent)
    held = spark.sparkContext.broadcast(tuple(t[c].to_numpy() for t, c in ((frequent, "pair"), (frequent, "count"), (most, "b"), (most, "top"))))

    def look(batch: pa.RecordBatch) -> tuple:
        """Row, pair, times, count and whether it is among the frequent ones, of every pair of a batch."""
        pair, count, b, best = held.value
        lists = batch.column("pairs")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        mine, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
        known = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
        return row, mine, times, at, known

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, b, best = held.value
        for batch in (part for whole in batches for part in _parts(whole)):
            row, mine, times, at, hit = look(batch)
            row, times, n = row[hit], times[hit], count[at[hit]]
            first = n == best[np.searchsorted(b, mine[hit] & ((1 << SIDE) - 1))]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * n)
            np.add.at(sums[1], row[first], times[first])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sums[1]), pa.array(sums[0])], [*batch.schema.names[:7], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            row, mine, times, _, hit = look(batch)
            ids = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[~hit]]), pa.array(mine[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

    out = aligned.mapInArrow(known, _OUT.split(", pairs")[0] + ", n_best long, count_sum long")
    if not whole:
        rare = aligned.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long").join(counts, "pair")
        best = F.when(F.col("count") == F.col("top"), F.col("times")).otherwise(0)
        rare = rare.join(F.broadcast(top), low == F.col("b")).groupBy("row").agg(F.sum(best).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
        add = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        out = out.join(rare, "row", "left").withColumns({"n_best": add("n_best", "more_best"), "count_sum": add("count_sum", "more_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
