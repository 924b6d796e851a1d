"""Repair of the turns of conversations by cost layers.

A conversation must read as an optional system turn, then pairs of a user's and
an assistant's. Its turns are kept, given to the user or the assistant, deleted,
and empty ones inserted, at the least total cost. The search keeps, for each
turn and each increasing cost, a bitset of the grammar's states from which the
end can be reached at that cost (Wu and Manber's layers of errors): a turn's
layers follow from the next turn's by shifts. No state's cost is more than seven
above the least of its turn, whatever follows (an inserted pair, or a deleted
system turn, brings any state to any other's plan), so eight layers above the
least, 32 bits a turn, hold all of them. The first layer that has the start's
state gives the cost, and a walk along the bits the least audit.

Rows are counted by value, so repeated rows are one; then they are range-sorted
by conversation and turn. A conversation that lies in several sorted blocks is
searched in each for every end state; what each block costs from state to state,
two small matrices a block at most, is composed on the driver, and each block is
then walked with its own first and last states. Only a conversation's own digest
goes through its blocks in order, as a stream.

Rows of one conversation are ordered by turn (null first), role and the text's
MD5. Null roles and texts count as one space; a role without a first character
can't be kept. Ids may be null: they are one conversation. An empty table gives
no rows; other columns aren't read. Long texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut

DELETE, INSERT, KEEP, REROLE = "DIKR"
#: Cost of each edit; an undeleted truncated turn costs one more.
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. What a turn by each initial leads to.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The only turn that can be inserted, or made of another, from each state.
GIVEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATES, LAYERS, NEVER = 4, 8, 1 << 60
#: States in which a conversation may end.
END = (0, NEVER, NEVER, 0)
_PLANE = sum(1 << (STATES * c) for c in range(2 * LAYERS))
_ALL = (1 << (STATES * LAYERS)) - 1
_SPACE = " \t\n\x0b\x0c\r"
#: What rows of one value are worth in a join: a group's rows go to as many tasks.
SALT = 32


def shifted(word: int, moves: dict[int, int], cost: int) -> int:
    """States from which a move leads into the word's, at a cost."""
    out = 0
    for s, t in moves.items():
        out |= ((word >> t) & _PLANE) << s
    return out << (STATES * cost)


_ANY = {0: 2, 1: 2, 2: 3, 3: 2}


def closed(word: int) -> int:
    """With inserted turns, and what a layer reaches in all later ones."""
    for _ in range(3):
        word |= shifted(word, _ANY, COST[INSERT])
    for c in (1, 2, 4, 8):
        word |= word << (STATES * c)
    return word


@dataclass
class Layers:
    """A bitset of (layer, state) and the cost of layer 0."""

    base: int
    word: int

    @classmethod
    def of(cls, base: int, word: int) -> Layers:
        word = closed(word)
        low = ((word & -word).bit_length() - 1) // STATES
        return cls(base + low, (word >> (STATES * low)) & _ALL)

    @classmethod
    def ending(cls, costs: tuple[int, ...]) -> Layers:
        base = min(costs)
        return cls.of(base, sum(1 << (STATES * (c - base) + s) for s, c in enumerate(costs) if c - base < 2 * LAYERS))

    def reaches(self, state: int, cost: int) -> bool:
        layer = cost - self.base
        return layer >= 0 and bool(self.word >> (STATES * min(layer, LAYERS - 1) + state) & 1)

    def costs(self) -> tuple[int, ...]:
        return tuple(next((self.base + c for c in range(LAYERS) if self.word >> (STATES * c + s) & 1), NEVER) for s in range(STATES))


@dataclass
class Turn:
    role: str
    text: str
    copies: int  # rows of this value
    first: bool  # whether no earlier turn says the same
    blank: bool = field(init=False)
    truncated: bool = field(init=False)

    def __post_init__(self):
        seen = self.text.rstrip(_SPACE)
        self.blank = not seen
        self.truncated = bool(seen) and seen[-1] not in ".!?"

    @property
    def gone(self) -> int:
        """How many of the rows must be deleted; the others, one at most, come first."""
        return self.copies if self.blank or not self.first else self.copies - 1

    @property
    def extra(self) -> int:
        return int(self.truncated)


def search(turns: list[Turn], end: tuple[int, ...] = END) -> list[Layers]:
    """The layers before each turn, and behind the last."""
    out = [Layers.ending(end)]
    for turn in reversed(turns):
        after = out[-1]
        base = after.base + COST[DELETE] * turn.gone
        if turn.gone == turn.copies:
            out.append(Layers(base, after.word))
            continue
        word = after.word << (STATES * COST[DELETE])
        if (moves := MOVES.get(turn.role[:1])) is not None:
            word |= shifted(after.word, moves, COST[KEEP] + turn.extra)
        out.append(Layers.of(base, word | shifted(after.word, _ANY, COST[REROLE] + turn.extra)))
    return out[::-1]


def walk(turns: list[Turn], layers: list[Layers], state: int = 0, end: tuple[int, ...] = END) -> tuple[str, int, int, list[tuple[str, str]]]:
    """Least audit, its cost within these turns, the state behind them, and the turns that it leaves."""
    left = total = layers[0].costs()[state]
    audit, said = [], []
    for i in range(len(turns) + 1):
        before = layers[i]
        turn = turns[i] if i < len(turns) else None
        while True:
            if turn is None:
                if left == end[state]:  # what follows costs the rest
                    return "".join(audit), total - left, state, said
            else:
                after, deleted = layers[i + 1], COST[DELETE] * turn.gone
                if after.reaches(state, left - deleted - COST[DELETE] * (turn.copies - turn.gone)):
                    audit.append(DELETE * turn.copies)
                    left -= COST[DELETE] * turn.copies
                    break
            if before.reaches(_ANY[state], left - COST[INSERT]):
                audit.append(INSERT)
                said.append((GIVEN[state], ""))
                state, left = _ANY[state], left - COST[INSERT]
                continue
            left -= turn.extra + deleted
            to = MOVES.get(turn.role[:1], {}).get(state)
            if to is not None and after.reaches(to, left - COST[KEEP]):
                audit.append(KEEP)
                said.append((turn.role, turn.text))
                state, left = to, left - COST[KEEP]
            else:
                audit.append(REROLE)
                said.append((GIVEN[state], turn.text))
                state, left = _ANY[state], left - COST[REROLE]
            audit.append(DELETE * turn.gone)
            break


def between(turns: list[Turn]) -> list[int]:
    """Least cost from each state before to each state behind, a row a first state."""
    own = [search(turns, tuple(0 if t == s else NEVER for t in range(STATES)))[0].costs() for s in range(STATES)]
    return [own[t][s] for s in range(STATES) for t in range(STATES)]


# ---------------------------------------------------------------------------
# Conversations as sorted blocks

_BLOCK = "conv_id long, block int, edge boolean, between array<long>, turns array<struct<turn:long,role:string,text:string,copies:long,first:boolean>>"
_PART = "conv_id long, block int, edge boolean, rows long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, opens string, closes string, cost long, audit string, repaired array<struct<role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("first", pa.bool_())]))


def _turns(rows: list[dict]) -> list[Turn]:
    return [Turn(r["role"], r["text"], r["copies"], r["first"]) for r in rows if r["copies"]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in a sorted partition; the first and the last may go on in others."""
    block = TaskContext.get().partitionId()

    def emit(runs: list[tuple], edge: bool) -> pa.RecordBatch:
        rows = [own for _, own in runs]
        cost = [between(_turns(own)) if edge else None for own in rows]
        columns = [pa.array([c for c, _ in runs], pa.int64()), pa.array([block] * len(runs), pa.int32()), pa.array([edge] * len(runs)), pa.array(cost, pa.list_(pa.int64())), pa.array(rows, _TURNS)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "edge", "between", "turns"])

    last, first, ready, size = None, True, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            conv = row.pop("conv_id")
            if last is None:
                last = (conv, [])
            elif last[0] != conv:
                if first:
                    yield emit([last], True)
                    first = False
                else:
                    ready.append(last)
                    if size > 4 << 20:
                        yield emit(ready, False)
                        ready, size = [], 0
                last = (conv, [])
            last[1].append(row)
            size += len(row["text"])
    if ready:
        yield emit(ready, False)
    if last is not None:
        yield emit([last], True)


def _key(conv: int | None, block: int) -> tuple:
    return (conv is not None, conv or 0, block)


def _described(conv: int | None, block: int, edge: bool, rows: list[dict], state: int, end: tuple[int, ...]) -> dict:
    rows = [r for r in rows if r["copies"]]
    turns = _turns(rows)
    audit, cost, _, said = walk(turns, search(turns, end), state, end)
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [t.role[:1] for t in turns]
    pairs = list(zip(initials[:-1], initials[1:], strict=True))
    return {
        "conv_id": conv,
        "block": block,
        "edge": edge,
        "rows": sum(t.copies for t in turns),
        "low": min(numbers, default=None),
        "high": max(numbers, default=None),
        "turns": len(set(numbers)),
        "blank": sum(t.copies for t in turns if t.blank),
        "duplicate": sum(t.gone for t in turns if not t.blank),
        "truncated": sum(1 for t in turns if t.truncated and t.first),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs) + sum(t.copies - 1 for t in turns),
        "opens": initials[0] if turns else None,
        "closes": initials[-1] if turns else None,
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": r, "text": t} for r, t in said],
    }


def _schema(parts: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(parts.schema)


def counted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, first: rows by value, and whether no earlier one of the conversation has its role and text."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", F.md5("text"))
    many = same.where("copies > 0").groupBy("conv_id", "role", "said").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("at")).where("n > 1")
    many = many.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "at", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt_"))
    same = same.withColumn("salt", F.pmod(F.hash("turn"), F.lit(SALT)))
    joined = same.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")) & (F.col("salt") == F.col("salt_")), "left")
    return joined.select("conv_id", "turn", "role", "text", "copies", "said", (F.col("at").isNull() | F.struct("turn").eqNullSafe(F.col("at"))).alias("first"))


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Parts of conversations, in order of block: counts of faults, audit, its cost, and the repaired turns.

    rows: conv_id, turn, role, text, copies. An edge part's conversation may have
    other parts. A row with 0 copies only says that there is such a conversation.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.col("copies").cast("long").alias("copies"))
    order = ["conv_id", "turn", "role", "said"]
    dealt = counted(plain)
    dealt = dealt.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    blocks = cut(dealt.select("conv_id", "turn", "role", "text", "copies", "first").mapInArrow(_blocks, _BLOCK), "turns")
    # two rows a block at most
    edges = sorted((_key(r.conv_id, r.block), r.between) for r in blocks.where("edge").select("conv_id", "block", "between").collect())
    ends: dict[tuple, tuple[int, ...]] = {}
    for i in range(len(edges) - 1, -1, -1):
        key, end = edges[i][0], END
        if i + 1 < len(edges) and edges[i + 1][0][:2] == key[:2]:
            following, cost = ends[edges[i + 1][0]], np.array(edges[i + 1][1]).reshape(STATES, STATES)
            end = tuple(min(int(cost[s, t]) + following[t] for t in range(STATES)) for s in range(STATES))
        ends[key] = end
    starts: dict[tuple, int] = {}
    if len({k[:2] for k in ends}) < len(ends):

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The state behind a block, for each state before it."""
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    own, end = _turns(row["turns"]), ends[_key(row["conv_id"], row["block"])]
                    layers = search(own, end)
                    known = [c < NEVER for c in layers[0].costs()]
                    out.append([walk(own, layers, s, end)[2] if known[s] else -1 for s in range(STATES)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "block", "to"])

        leads = {_key(r.conv_id, r.block): r.to for r in blocks.where("edge").select("conv_id", "block", "turns").mapInArrow(through, "conv_id long, block int, to array<long>").collect()}
        before = None
        for key in sorted(leads):
            starts[key] = leads[before][starts[before]] if before is not None and before[:2] == key[:2] else 0
            before = key
    shape = spark.createDataFrame([], _PART)
    schema = _schema(shape)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                out = []
                for row in batch.slice(i, 1024).to_pylist():
                    key = _key(row["conv_id"], row["block"])
                    state, end = (starts.get(key, 0), ends[key]) if row["edge"] else (0, END)
                    out.append(_described(row["conv_id"], row["block"], row["edge"], row["turns"], state, end))
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.select("conv_id", "block", "edge", "turns").mapInArrow(finish, shape.schema)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its parts, which come in order: a stream, whatever their number."""
    out: list[dict] = []
    now: dict | None = None

    def close() -> None:
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        out.append({k: now[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (x.split()[0] for x in _AUDIT.split(", "))]))
        out.clear()
        return rows

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    close()
                now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"conv_id": row["conv_id"], "low": None, "high": None, "closes": None, "audit": [], "hash": hashlib.sha256(), "said": False}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += row[c]
            if row["rows"]:
                if now["closes"] is not None and now["closes"] + row["opens"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["closes"] = row["closes"]
            if row["low"] is not None:
                now["turns"] += row["turns"] - (now["high"] == row["low"])
                now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
            now["audit"].append(row["audit"])
            for turn in row["repaired"]:
                now["hash"].update(("\n" * now["said"] + f"{turn['role']}:{turn['text']}").encode())
                now["said"] = True
        if len(out) > 4096:
            yield flush()
    if now is not None:
        close()
    yield flush()


def audits(parts: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation of repair()."""
    whole = parts.where("not edge").mapInArrow(_audits, _AUDIT)
    split = parts.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_audits, _AUDIT)
    return whole.unionByName(split)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns lost, emptied, cut short, repeated or misattributed by a checksum of their place; a lost one has 0 copies."""
    place: Column = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(place) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    lost = kind == 0
    return rows.select(
        "conv_id",
        F.when(~lost, F.col("turn")).alias("turn"),
        F.when(lost, F.lit(" ")).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(lost | (kind == 1), F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(lost, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
