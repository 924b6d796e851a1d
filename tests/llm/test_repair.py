"""Repair of conversations against a search over all edits, in one block and in many."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from meridian.llm import registry
from meridian.llm.repair import audits, damaged, repair
from meridian.shipping import ship

SCHEMA = "conv_id long, turn long, role string, text string, copies long, block int, said string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text, own = show(role), show(text), out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Least (cost, audit) by a search over (row, what was said by whom so far)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, at, said = heapq.heappop(heap)
        if i == len(rows) and at in ("", "a"):
            break
        if (i, at) in done:
            continue
        done.add((i, at))
        for role in ("user", "assistant"):
            if (at, role[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*said, f"{role}:")))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, said))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (at, own[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[at, own[:1]], (*said, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if (at, role[0]) in step:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role[0], (*said, f"{role}:{text}")))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
    }


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", " \n", "", None, "Yes. ", "A longer answer.\nIn two lines.", "x" * 70_000 + "."]
    rows = []
    for conv in [*range(n), None]:
        role = rng.choice(["user", "assistant", "system"])
        for turn in range(rng.choice([0, 1, 2, 3, 6, 12])):
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {rng.randrange(99)}."
            own = rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.25 else role
            rows.append((conv, None if rng.random() < 0.1 else rng.choice([turn, turn, turn + 2]), own, text))
            role = {"user": "assistant", "assistant": "user", "system": "user"}[role]
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_audits_equal_brute_force(spark, partitions):
    rows = conversations(5, 70)
    hot = [(500, i, ("user", "assistant")[i % 2] if i % 7 else "system", f"{i % 50} said{'.' * (i % 3)}") for i in range(300)]
    rows += hot
    table = spark.createDataFrame([(*r, 9, 8, "x") for r in rows], SCHEMA)
    expected = damage(rows)
    got = {r.conv_id: r.asDict() for r in audits(repair(damaged(table), partitions)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == {"conv_id": conv, **brute(expected[conv])}, conv


def test_repeated_rows_are_counted(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", 5), (1, 1, "assistant", "Yes.", 1), (2, 0, "system", " ", 3)], "conv_id long, turn long, role string, text string, copies long")
    got = {r.conv_id: r for r in audits(repair(table)).collect()}
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].illegal) == ("KDDDDK", 12, 4, 4)
    assert (got[2].audit, got[2].cost, got[2].blank, got[2].repaired_sha256) == ("DDD", 9, 3, hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert registry.QUERIES["op11_repair"](spark, str(tmp_path)).count() == 0
