"""The training-data operators against brute-force versions, and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.llm import decontaminate, imatch, linededup, mixing, neardup, ppm, registry, tokens, toxicity, urls, warc
from meridian.llm._shared import fold, hash_words, text_bytes
from meridian.llm.components import components
from meridian.shipping import ship

LONG = "word and more " * 8_000
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row string, id long, node string, h long, taken long, level int, finish double"
#: Nulls in every column, empty and blank texts, repeated rows, ties, a long text.
TEXTS = [None, "", "   \n\t ", "a", LONG, "Same text.\nTwice here.", "Same text.\nTwice here.", "ünï čödé 中文字 <|endoftext|> it's", "\n\n", "x" * 3000, "one two three four five six seven eight nine ten"]


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def table_dir(spark, path, rows, labels=(), pages=(), benchmark=(), turns=()):
    spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string, copies long, edge string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string, host string, digest string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def doc(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), 0.1, 5, "r", 7, "n", 3, 4, 1, 0.5)


TURNS = [(1, 0, "user", LONG, None, "e"), (1, 0, "user", LONG, None, "e"), (1, None, None, None, 3, None), (None,) * 6, (None,) * 6, (2, 5, "", "", 0, "")]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rows = [doc(i, t, random.Random(i).choice(["a", "b", None])) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None,) * 14, (None, "no id", None, None, None, *(None,) * 9)]
    pages = [(1, "http://A.example.com/en/7", "h" * 1200, "x", "y"), (2, "nothing", "h" * 1200, None, None), (3, None, None, None, None), (4, "https://x.net?q", "", None, None), (5, "a://b.org/es/1/2/3/4/5/6#f", "h" * 999, None, None), (6, "a://b.org/es/", "h" * 999, None, None)]
    labels = [(0, 1, 0), (3, None, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)]
    return table_dir(spark, tmp_path_factory.mktemp("awkward"), rows, labels, pages, [(1, None), (2, ""), (None, "some item text that nobody has ever seen before"), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten")], TURNS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return table_dir(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_awkward_rows(spark, awkward, name):
    rows = registry.QUERIES[name](spark, awkward).collect()
    if name in ("op3_urls", "op4_warc"):
        assert len(rows) == 6
    elif name == "op11_repair":
        assert {r.conv_id for r in rows} == {1, 2, None} and len(rows) == 3
    elif name == "op5_decontaminate":
        assert {(r.doc_id, r.item_id) for r in rows} == {(10, 3)}
    else:
        assert len(rows) == len(TEXTS) + 4


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).count() == 0


# -- 1 -----------------------------------------------------------------------


def test_toxicity_learns_held_out_texts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "nastier", "rotten"]) + rng.choice([".", "", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels_).collect()}
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert toxicity.fit(docs, labels_.where("toxic = 0")) is None


# -- 2 -----------------------------------------------------------------------


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        own = tokens.Tokenizer(f.read())
    library, rng = Tokenizer.from_file(path), random.Random(3)
    alphabet = "abcdefghiethesing'''srtedlvm  \n\t\x0b\x1c\x1d\x85\xa0\u3000ABCDE0123½²éÉßİΣσ中文かな😀👍🏽\u0301\u0300\x00\x07-_!?<|>«»ºª٣ⅷ№ﬁ가힣"
    for i in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        if i % 4 == 0:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "it's we'll 'S"])
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert own.count(text) == expected
        own.chunk_chars = rng.randint(1, 9)
        assert own.count(text) == expected
        own.chunk_chars = 1 << 18


def test_chunk_maps_compose_associatively():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        own = tokens.Tokenizer(f.read())
    maps = [own.chunk_map(c) for c in ("the cat", "s on", "", " ", "mats", " it'", "s")]
    left = maps[0]
    for m in maps[1:]:
        left = own.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = own.compose(m, right)
    assert left == right == own.scan(maps)[-1]


# -- 3 -----------------------------------------------------------------------


def test_url_rules(spark):
    rng = random.Random(5)
    hosts = ["example.com", "www.Example.com", "notexample.com", "a.net", "b.example.net", "x.org", "com"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}{rng.choice(['', '/', '?q=/en/', '#x', '.html'])}") for i in range(3000)]
    rules = [*registry.BLOCK, *registry.ALLOW]
    for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), registry.BLOCK, registry.ALLOW).collect():
        rest = rows[r.page_id][1].split("://", 1)[1]
        end = min((rest + c).index(c) for c in "/?#")
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        best = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == ("block" if best in registry.BLOCK else "allow"))


def test_templates_follow_their_examples(spark):
    rows = [(i, f"http://h.com/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), ["h.com/bad/1"], ["h.com/good/1"]).where("rule is null").collect()
    assert got and all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in got)


# -- 4 -----------------------------------------------------------------------


def test_archives(spark, tmp_path):
    big = "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    rows = [(i, f"http://h/{i}\r\nX: y", html) for i, html in enumerate([big, big, "small", "small", None, "ü" * 700, "ü" * 700, "ü" * 700])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = {int(r.page_id): r for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {0: "1", 5: "7", 6: "7"}
    import gzip

    files = [f"{tmp_path}/w/{f}" for f in os.listdir(f"{tmp_path}/w") if f.startswith("part-")]
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)


def test_damaged_records():
    content = warc.record("1", "u", b"payload" * 300, hashlib.sha1(b"payload" * 300).digest(), None)
    whole = warc.member(content)
    assert [r["error"] for r in warc.read_archive(whole + b"\0" + whole)] == [None, None]
    for bad in (content.replace(b"payloadpayload", b"payloadPAYLOAD", 1), content.replace(b"Content-Length: 2", b"Content-Length: 3", 1), b"GARBAGE" + content, content[:-2]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(warc.member(bad)))
        assert [r["error"] is not None for r in warc.read_archive(warc.member(bad), strict=False)] == [True]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(whole[:-30]))


# -- 5 -----------------------------------------------------------------------


def test_search_returns_all_above_the_threshold():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(150)]
    index = decontaminate.Index(items, 0.5)
    dense = np.zeros((len(items), len(index.terms)))
    for t in range(len(index.terms)):
        dense[index.items[index.start[t] : index.start[t + 1]], t] = index.impact[index.start[t] : index.start[t + 1]]
    for _ in range(200):
        terms = rng.sample(range(len(index.terms)), rng.randint(1, 40))
        expected = dense[:, terms].sum(1)
        assert {i: pytest.approx(s) for i, s in index.search(terms)} == {i: expected[i] for i in np.flatnonzero(expected >= 0.5 - 1e-9)}


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_leaks(spark, shard_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 50)))) for i in range(30)]
    rows, expected = [], set()
    for i in range(200):
        text = [word() for _ in range(rng.randint(5, 400))]
        if i % 3 == 0:
            item = rng.choice(items)
            piece = item[1].split()
            if i % 2:
                piece[len(piece) // 2] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = piece
            own = {tuple(item[1].split()[j : j + 5]) for j in range(len(item[1].split()) - 4)}
            have = {tuple(text[j : j + 5]) for j in range(len(text) - 4)}
            if len(own & have) >= 0.8 * len(own):
                expected.add((i, item[0]))
        rows.append((i, " ".join(text)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, max_shard_bytes=shard_bytes).collect()}
    assert got == expected
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(200)) - {d for d, _ in expected}


# -- 6 -----------------------------------------------------------------------


def brute_similarity(x, y):
    cut = lambda t: collections.Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4)))
    a, b = cut(x), cut(y)
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a if i in b)


def near_copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(8, 120))] for _ in range(n)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(rng.choice([0, 0, 1, 6])):
            c = list(b)
            for _ in range(rng.randint(0, 1 + len(c) // 30)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(c)
    rng.shuffle(out)
    return out


def test_signatures_estimate_the_similarity():
    rng = random.Random(6)
    x = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(150)]
    y = list(x)
    for _ in range(5):
        y[rng.randrange(150)] = "new"
    row, shingle, count = neardup.shingles(*text_bytes(pa.array([" ".join(x), " ".join(y)])))
    s = neardup.signatures(row, shingle, count, 2, 4000)
    exact = neardup.probability_jaccard((shingle[row == 0], count[row == 0]), (shingle[row == 1], count[row == 1]))
    assert exact == pytest.approx(brute_similarity(x, y))
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def test_classes_equal_brute_force(spark):
    texts = near_copies(random.Random(8), 60)
    rows = [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if brute_similarity(texts[i], texts[j]) >= 0.8 - 1e-9:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    expected = {d: min(g) for g in groups.values() for d in g}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == expected
    assert {r.doc_id for r in got if r.kept} == set(expected.values()) == {r.doc_id for r in neardup.one_of_each(docs).collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# -- 7 -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "é", None, "Z"] if seed > 1 else ["a"])) for i in range(300)]
    rows.append((7, None, "only null"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.fair_queue(docs, [5, 2, 1], 1.5, 2.0).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            free.discard(s)
    source = {i: s for i, _, s in rows}
    source[7] = None
    taken, by_source = collections.Counter(), collections.defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (source_size, goal), words in taken.items():
        assert goal in {round(target[s], 6) for s in names if size[s] == source_size}
        same = sum(1 for s in names if size[s] == source_size and round(target[s], 6) == goal)
        assert abs(words - goal * same) <= same
    again = mixing.fair_queue(docs.repartition(7), [5, 2, 1], 1.5, 2.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and not by_source


@pytest.mark.parametrize("sources", [[(5, 900), (2, 40), (1, 300)], [(5, 3), (2, 3), (1, 100000)], [(1, 1)], [(5, 700), (2, 0), (1, 2)], [(3, 50)] * 40])
def test_mix_is_cut_where_words_in_their_order_are(spark, sources):
    """Packets and the last words against a sort of all words, at budgets before, at and after queues' ends."""
    rng = random.Random(len(sources))
    caps = [2 * n for _, n in sources]
    packets = []
    for s, (weight, n) in enumerate(sources):
        at = 0
        while at < 2 * n:
            words = min(rng.choice([1, 7, mixing.PACKET]), 2 * n - at)
            packets.append((f"{s:02}", at, words, (at + words) / weight))
            at += words
    order = sorted(((p / weight, f"{s:02}") for s, (weight, n) in enumerate(sources) for p in range(1, 2 * n + 1)))
    queue = spark.createDataFrame(packets, "source_key string, begin long, words long, finish double")
    for budget in {1, sum(caps) // 3, sum(caps) - 1, sum(caps)}:
        left, goals = budget, []
        for s, (weight, n) in enumerate(sources):
            share = min(left, caps[s])
            left -= share
            goals.append((f"{s:02}", weight, float(share), caps[s]))
        goal = spark.createDataFrame(goals, "source_key string, weight int, target double, cap long")
        want = collections.Counter(s for _, s in order[:budget])
        assert {r.source_key: r.end for r in mixing.cut_sources(queue, goal).collect()} == {f"{s:02}": want[f"{s:02}"] for s in range(len(sources))}


def test_mix_of_awkward_rows(spark):
    """A text of many packets, nulls everywhere, repeated rows, names that clash, no rows, no words."""
    rows = [(1, "w " * 5000, "a", 0), (None, "x y z", "a", 1), (None, "x y z", "a", 2), (3, None, None, 3), (4, "", "b", 4), (5, "q " * 700, None, 5), (5, "q " * 700, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int").withColumn("finish", F.lit("-")).withColumn("end", F.lit(1))
    got = mixing.fair_queue(docs, [5, 2, 1], 1.5, 2.0, keep={"mine": F.col("words"), "end_": F.col("end")}).collect()
    assert sorted(r.mine for r in got) == list(range(7)) and all(0 <= r.taken <= 2 * r.size and r.end_ == 1 for r in got)
    by = collections.Counter()
    for r in got:
        by[r.source_size] += r.taken
    assert by[0] == 0 and all(abs(by[r.source_size] - r.target) <= 1 for r in got) and sum(by.values()) == sum(int(t) for t in {r.source_size: r.target for r in got}.values())
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert mixing.fair_queue(docs.limit(0), [5, 2, 1], 1.5, 2.0).collect() == []
    assert [r.taken for r in mixing.fair_queue(docs.where("words in (3, 4)"), [5, 2, 1], 1.5, 2.0).collect()] == [0, 0]


# -- 8 -----------------------------------------------------------------------


def brute_ppm(train, text, order):
    counts = collections.defaultdict(collections.Counter)
    coded = lambda t: b"\n" * order + b" ".join(t.encode().lower().split()) + b"\n"
    for t in train:
        s = coded(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                counts[o, s[i - o : i]][s[i]] += 1
    s, total = coded(text), 0.0
    for i in range(order, len(s)):
        gone = set()
        for o in range(order, -1, -1):
            m = {x: n for x, n in counts.get((o, s[i - o : i]), {}).items() if x not in gone}
            if not m:
                continue
            n, d = sum(m.values()), len(m)
            if s[i] in m:
                total += math.log10(m[s[i]] / (n + d))
                break
            total += math.log10(d / (n + d))
            gone |= set(m)
        else:
            total -= math.log10(257 - len(counts[0, b""]))
    return total


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "of", "That", "ing", "ab", "xyz", "q", "thé"]
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(200, None), (201, "never seen words zzz"), (202, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = collections.Counter(w for t in train for w in [*(x.decode() for x in t.encode().lower().split()), None])
    total, distinct = sum(seen.values()), len(seen)
    for order, nodes, head in ((3, 1 << 21, 1 << 19), (5, 40, 4)):
        got = {r.doc_id: r for r in ppm.score(docs, fold("doc_id", 7) != 2, order, nodes, head).collect()}
        for i, t in rows:
            own = [*(x.decode() for x in (t or "").encode().lower().split()), None]
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in seen for w in own), total)
            assert got[i].base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in own))
            assert got[i].score == pytest.approx(brute_ppm(train, t or "", order), abs=1e-3)


# -- 9 -----------------------------------------------------------------------


def brute_lines(rows):
    shingles = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                first.setdefault(x, i)
    lines, parent = list(first), {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    keeper, seen, out = {}, set(), {}
    for x in lines:
        keeper[find(x)] = min(first[x], keeper.get(find(x), first[x]))
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            if not x.strip(" "):
                kept.append(x)
            elif keeper[find(x)] == i and find(x) not in seen:
                seen.add(find(x))
                kept.append(x)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["", "  ", "x", "ab"]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.3 and line.count(" ") > 12:
                parts = line.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(words)
                line = " ".join(parts)
            own.append(line)
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.line_dedup(docs).collect()}
    assert got == brute_lines(rows)


def test_bitmaps(spark):
    marks = linededup.bitmap(spark.createDataFrame([(5,), (-7,), (1 << 40,)], "h long"), "h")
    rows = spark.createDataFrame([(5,), (6,), (-7,), (1 << 40,), ((1 << 40) + 8,)], "h long")
    assert [r.hit for r in linededup.maybe_in(rows, "h", marks, "hit").collect()] == [True, False, True, True, False]


# -- 10 ----------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(800)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 400))) for _ in range(300)]
    texts[40] = texts[41] = texts[200]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), high=0.5, group_rows=1).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        n, following = len(texts[i]), texts[(i + 1) % 300]
        edited = texts[i][: n - n // 4] + following[: n // 4]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (3 * i, n, hashlib.sha256(edited.encode()).hexdigest())
    assert got[40].fingerprint == got[41].fingerprint == got[200].fingerprint and got[40].near_next == 1
    near, far = (np.mean([r[c] for i, r in enumerate(got) if i != 40]) for c in ("near_edited", "near_next"))
    assert near > 0.25 and far < 0.1


# -- shared ------------------------------------------------------------------


def test_word_hashes():
    texts = ["The  cat\tSAT", "", "the cat sat", None, " x\n", "é" * 50]
    hashes, first = hash_words(*text_bytes(pa.array(texts)))
    assert np.diff(first).tolist() == [3, 0, 3, 0, 1, 1]
    assert hashes[:3].tolist() == hashes[3:6].tolist()
    long = "ab " * 800_000
    hashes, first = hash_words(*text_bytes(pa.array(["q", long, "ab"])))
    assert np.diff(first).tolist() == [1, 800_000, 1] and len(set(hashes[1:].tolist())) == 1


# -- SQL ---------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    expected = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(expected.columns)
    names = sorted(df.columns)
    left = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    right = sorted((tuple(r[expected.columns.index(c)] for c in names) for r in expected.fetchall()), key=str)
    assert left == right
