"""Token alignment against a walk along both sides' tokens, text by text."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest

from meridian.llm import alignment
from meridian.shipping import ship

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdefghiethesing'''srtedlvm      \n\n\t\x0b\x1c\x85\xa0　 ABCDE0123½²éÉßİ中文かな😀👍🏽́̀\x00\x07-_!?<|>«»ºªٓⅷ№ﬁ가힣"
ODD = ["<|endoftext|> <s> </s> a", "▁ab c", "a ", "a  ", " a", "  a", "\n", " ", "é é", "x" * 5000, None, "", "a▁b", "a ▁ b", "<0x0A> <unk>", "the same words " * 400_000]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*PATHS)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice(ALPHABET[:30]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    random_ones = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return random_ones + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n // 4)]


def brute(t, text):
    """(n_a, n_b, n_groups, n_links), groups, links."""
    if not text:
        return (0, 0, 0, 0), "", collections.Counter()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    sides = []
    for ids, (content, at) in ((a, t.bytes_a), (b, t.bytes_b)):
        parts = [content[at[i] : at[i + 1]].tobytes() for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return (0, 0, 0, 0), "", collections.Counter()
        sides.append(parts)
    links, groups, i, j, x, y = collections.Counter(), [], 0, 0, len(sides[0][0]), len(sides[1][0])
    group = ([a[0]], [b[0]])
    while True:
        links[a[i], b[j]] += 1
        step = (x <= y, y <= x)
        if all(step):
            groups.append("|".join(",".join(map(str, g)) for g in group))
            group = ([], [])
        i, j = i + step[0], j + step[1]
        if i == len(a):
            break
        if step[0]:
            x += len(sides[0][i])
            group[0].append(a[i])
        if step[1]:
            y += len(sides[1][j])
            group[1].append(b[j])
    return (len(a), len(b), len(groups), links.total()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_units_equal_whole_texts(tokenizers):
    rows = texts(1, 4000) + ODD
    assert tokenizers.cuts
    memory = alignment.Memory(tokenizers, 1000)
    for at in range(0, len(rows), 1500):
        part = rows[at : at + 1500]
        counts, digests, row, pair, times = alignment.align_texts(memory, pa.array(part, pa.string()))
        links = collections.defaultdict(dict)
        for r, p, n in zip(row.tolist(), pair.tolist(), times.tolist(), strict=True):
            links[r][p >> 32, p & 0xFFFFFFFF] = n
        for i, text in enumerate(part):
            assert (tuple(counts[i].tolist()), digests[i], links.get(i, {})) == brute(tokenizers, text), text


def test_units_without_cuts(tokenizers, monkeypatch):
    rows = texts(2, 100) + ODD[:-1]
    whole = alignment.align_texts(alignment.Memory(tokenizers), pa.array(rows))
    monkeypatch.setattr(tokenizers, "cuts", False)
    for x, y in zip(whole, alignment.align_texts(alignment.Memory(tokenizers), pa.array(rows)), strict=True):
        assert list(x) == list(y) if isinstance(x, list) else (x == y).all()


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_counts_of_the_corpus(spark, tokenizers, head):
    ship(spark)
    rows = texts(3, 60) + ODD[:-1]
    rows += rows[-20:]
    table = [(i if i % 9 else None, t, 5, 6, [7]) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(table, "doc_id long, text string, row long, n_a long, pairs array<long>").repartition(3)
    own = [brute(tokenizers, t) for t in rows]
    count = sum((links for _, _, links in own), collections.Counter())
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    expected = collections.Counter()
    for (i, *_), (numbers, digest, links) in zip(table, own, strict=True):
        best = sum(n for p, n in links.items() if count[p] == top[p[1]])
        expected[i, *numbers, best, sum(n * count[p] for p, n in links.items()), digest] += 1
    got = alignment.alignment(docs, *PATHS, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == expected


def test_few_units_and_pairs_are_held_at_a_time(tokenizers, monkeypatch):
    sizes, encode = [], tokenizers.encode
    monkeypatch.setattr(tokenizers, "encode", lambda units, together: sizes.append(len(units)) or encode(units, together))
    places = alignment.Memory(tokenizers).look([b" %d" % i for i in range(10_000)])
    assert sorted(places.tolist()) == list(range(10_000)) and max(sizes) <= 4096
    assert alignment.PART <= 1 << 19
    assert [p.num_rows for p in alignment._parts(pa.record_batch({"x": pa.array(range(2500))}))] == [1024, 1024, 452]
    assert alignment.tokenizers(*PATHS) is alignment.tokenizers(*PATHS)
