"""Whole results where a bound, a turn or a cut used to leave something out."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.llm import linededup, neardup
from meridian.llm._shared import text_bytes
from meridian.shipping import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def edited(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return word[:at] + rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != word[at]]) + word[at + 1 :]


def line_jaccard(a, b):
    x, y = ({s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in (a, b))
    return len(x & y) / len(x | y)


def linked(spark, pairs):
    """How many pairs of lines, each line in a document of its own, lose their second line."""
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return sum(got[2 * i + 1] == "" for i in range(len(pairs)))


def test_template_lines_find_their_copies(spark):
    """200 families of one template: a bucket holds far more lines than there are turns."""
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 200:
        name = letters(rng, 10)
        pair = tuple(f"This comment was posted by {n} and belongs to its author" for n in (name, edited(rng, name)))
        if line_jaccard(*pair) >= 0.8:
            pairs.append(pair)
    signed = linededup.signed_lines(linededup.line_rows(spark.createDataFrame([(i, x) for i, x in enumerate(sum(pairs, ()))], "id long, text string"), "text", "id"), 8, 3)
    keys = {}
    for r in signed.collect():
        keys.setdefault(r.h, set()).update(r["keys"])
    hashes = [r.h for r in linededup.line_rows(spark.createDataFrame([(x,) for x in sum(pairs, ())], "text string"), "text").select("h", "line").collect()]
    met = sum(bool(keys[hashes[2 * i]] & keys[hashes[2 * i + 1]]) for i in range(200))
    assert linked(spark, pairs) >= met  # all that share a band, or that their neighbours lead to


@pytest.mark.parametrize("slices", [1, 5])
def test_prefix_pairs_hold_every_similar_pair(spark, monkeypatch, slices):
    if slices > 1:
        monkeypatch.setattr(linededup, "_slices", lambda spots: slices)
    rng = random.Random(6)
    lines = [f"{letters(rng, 3)} written by {letters(rng, rng.randrange(2, 9))} in {letters(rng, 4)}" for _ in range(60)]
    lines += [edited(rng, x) for x in lines] + [x + "!" for x in lines] + ["abc", "abcd", "aaaaaaaaaaaa"]
    for threshold in (0.5, 0.8):
        rows = spark.createDataFrame([(i, i // 2, x) for i, x in enumerate(lines)], "h long, root long, line string")
        got = {(r.a, r.b) for r in linededup._prefix_pairs(rows, threshold, []).collect()}
        want = {(i, j) for j in range(len(lines)) for i in range(j) if i // 2 != j // 2 and line_jaccard(lines[i], lines[j]) >= threshold}
        assert want <= got


def test_slices_follow_the_rows_that_meet(spark, monkeypatch):
    spots = spark.createDataFrame([(t, h % 7, h) for t in range(3) for h in range(40)], "t long, root long, h long")
    met = 3 * sum(1 for a in range(40) for b in range(a) if a % 7 != b % 7)
    for least, share in ((100, 0), (1, 2), (1 << 20, 4)):
        monkeypatch.setattr(linededup, "SLICE", least)
        monkeypatch.setattr(linededup, "SHARE", share)
        assert linededup._slices(spots) == -(-met // max(least, share * 120))
    assert linededup._slices(spots.limit(0)) == 1


@pytest.mark.parametrize(("words", "lengths", "least"), [(1, (12, 15), 0.97), (2, (9, 12), 0.97), (3, (9, 12), 0.97), (5, (5, 9), 0.97), (7, (4, 8), 0.97), (9, (4, 8), 0.97), (12, (4, 8), 0.9), (1, (50, 60), 0.97)])
def test_similar_lines_share_a_band(spark, words, lengths, least):
    """Lines with a letter changed, and with a mark appended, by length; the figures are in the README."""
    rng = random.Random(words)
    lines, pairs = [], []
    while len(pairs) < 400:
        line = " ".join(letters(rng, rng.randint(*lengths)) for _ in range(words))
        other = line + rng.choice("!.") if rng.random() < 0.5 else edited(rng, line)
        if line_jaccard(line, other) >= 0.8 and "  " not in other:
            pairs.append((len(lines), len(lines) + 1))
            lines += [line, other]
    rows = linededup.line_rows(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), "text", "id")
    keys = {}
    for r in linededup.signed_lines(rows, linededup.BANDS, linededup.ROWS).collect():
        keys.setdefault(r.first, set()).update(r["keys"])
    recall = sum(bool(keys[i] & keys[j]) for i, j in pairs) / len(pairs)
    print(f"recall {words} words of {lengths}: {recall:.3f}")
    assert recall >= least


def test_short_lines_find_their_copies(spark):
    assert linked(spark, [("Leave comment", "Leave comment!"), ("Subscribetoday", "Subscribetoday.")]) == 2


def test_large_buckets_are_finished_exactly(spark, monkeypatch):
    """Split buckets of templates whose members differ by words: links join what brute force joins, in one block and in many."""
    rng = random.Random(3)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words + words[:5] if rng.random() < 0.3 else words))
    nodes = [f"{i:03d}" for i in range(len(texts))]
    multisets = [neardup.shingles(*text_bytes(pa.array([t])))[1:] for t in texts]
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if neardup.probability_jaccard(multisets[i], multisets[j]) >= 0.8 - 1e-9}
    want = grouped(len(texts), similar)
    assert 3 < len(set(want)) < len(texts)
    left = spark.createDataFrame([(n, k) for n in nodes for k in (1, 2)], "node string, key long")
    roots = spark.createDataFrame([("001", "000")] if (0, 1) in similar else [], "node string, root string")
    rows = spark.createDataFrame([(n, t, len(t)) for n, t in zip(nodes, texts, strict=True)], "node string, text string, bytes int")
    for block in (1024, 16):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = {(int(r.a), int(r.b)) for r in neardup._in_blocks(left, roots, rows, 0.8, 5).collect()}
        assert found <= similar
        assert grouped(len(texts), found | (similar & {(0, 1)})) == want


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_similarities_of_many_pairs_at_once():
    rng = random.Random(5)
    pairs = [["", ""], ["", "a b"]] + [[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2)] for _ in range(200)]
    sides = [neardup.shingles(*text_bytes(pa.array([p[k] for p in pairs])), 2) for k in (0, 1)]
    got = neardup.similarities(*sides, len(pairs))
    bound = neardup._upper_bounds(*sides, len(pairs), len(pairs), columns=7)
    for i in range(len(pairs)):
        x, y = ((s[1][s[0] == i], s[2][s[0] == i]) for s in sides)
        exact = neardup.probability_jaccard(x, y)
        assert abs(got[i] - exact) < 1e-12
        assert bound[i, i] >= exact - 1e-6 or not len(x[0])


def test_lines_of_repeated_letters_are_compared(spark):
    """Equal sets of shingles, but no common word."""
    assert linked(spark, [("aaaaaaa aaaaaaaa aaaaaaaaa", "aaaaaaaaaa aaaaaaaaaaa aaaaaaaaaaaa")]) == 1


def test_lines_of_white_space_stay(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\nb\r\n\r\nc\r"), (2, "\t\nx\n\t\n  \n  ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.line_dedup(docs).collect()} == {1: "a\r\n\r\nb\r\n\r\nc\r", 2: "\t\nx\n\t\n  \n  "}


def test_recall_of_long_lines(spark):
    """Pairs of 13 to 60 words with scattered letters changed, of similarity 0.80 to 0.85: links found, verification included."""
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 300:
        line = " ".join(letters(rng, rng.randint(2, 9)) for _ in range(rng.randint(13, 60)))
        other = line
        for _ in range(max(1, round(len(line) / 55))):
            other = edited(rng, other)
        if 0.80 <= line_jaccard(line, other) <= 0.85:
            pairs.append((line, other))
    found = linked(spark, pairs) / len(pairs)
    print(f"recall of long lines at 0.80 to 0.85: {found:.3f}")
    assert found >= 0.9


def test_long_lines_are_signed_by_all_shingles(spark):
    """Pairs of similarity 0.80 to 0.85 whose words nearly all differ: pairs of words wouldn't meet."""
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 100:
        line = " ".join(letters(rng, rng.randint(20, 30)) for _ in range(rng.randint(13, 30)))
        other = " ".join(edited(rng, w) if rng.random() < 0.6 else w for w in line.split(" "))
        if 0.80 <= line_jaccard(line, other) <= 0.85:
            pairs.append((line, other))
    assert linked(spark, pairs) >= 98


def test_split_buckets_are_finished_by_pairs(spark, monkeypatch):
    """Lines outside a bucket's largest component meet all others, by pairs and by prefixes alike."""
    rng = random.Random(13)
    lines = [f"{letters(rng, 30)} {letters(rng, 30)}" for _ in range(12)]
    lines += [edited(rng, x) for x in lines]
    rows = spark.createDataFrame([(1, i, 0, 0 if i < 6 else i) for i in range(24)], "key int, h long, sketch long, root long")
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    want = {(i, i + 12) for i in range(12)}
    for work in (linededup.WORK, 0):
        monkeypatch.setattr(linededup, "WORK", work)
        got = {(r.a, r.b) for r in linededup._remaining(rows, texts, 0.5, []).collect()}
        assert want <= got
        assert not any(a < 6 and b < 6 for a, b in got)


def test_pairs_of_large_buckets_are_few_and_whole(spark):
    """Copies below and above the threshold in one bucket, and in two that share most lines: little but similar pairs is left, each once, and no similar one is missing."""
    rng = random.Random(14)
    base = [letters(rng, 6) for _ in range(50)]
    lines = sorted({" ".join(letters(rng, 6) if rng.random() < 0.03 else w for w in base) for _ in range(70)})
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    rows = spark.createDataFrame([(key, i, i) for key in (1, 2) for i in range(len(lines)) if key == 1 or i % 5], "key int, h long, root long")
    similarity = {(i, j): line_jaccard(lines[i], lines[j]) for j in range(len(lines)) for i in range(j)}
    want = {p for p, s in similarity.items() if s >= 0.8}
    fine = linededup._fine_marks(texts).withColumn("sketch", F.lit(0).cast("long"))
    got = [(r.a, r.b) for r in linededup._remaining(rows, texts, 0.8, [], fine).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert all(similarity[p] >= 0.75 for p in got) and len(want) < len(got) + 1 < len(similarity)


def test_marks_lose_no_similar_pair(spark):
    """Lines of all lengths, with repeats: what the bitmaps of signed lines say apart is below the threshold."""
    rng = random.Random(15)
    lines = ["abc", "abcd", "a" * 40, "ab " * 300, "x" * 3]
    while len(lines) < 120:
        line = " ".join(letters(rng, rng.randint(2, 9)) for _ in range(rng.choice([1, 3, 10, 60, 300])))
        lines += [line, edited(rng, line), line + " " + line[: len(line) // 8]]
    rows = linededup.line_rows(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), "text", F.col("id"))
    marks = linededup.signed_lines(rows, linededup.BANDS, linededup.ROWS).where("main").withColumn("sketch", F.lit(0).cast("long"))
    x, y = (marks.select(F.col("first").alias(s), *linededup._named(marks, s)) for s in "ab")
    kept = {(r.a, r.b) for r in x.join(y, F.expr("a < b")).where(linededup._likely(marks, 0.8)).select("a", "b").collect()}
    first = {x: i for i, x in reversed(list(enumerate(lines)))}
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and line_jaccard(x, y) >= 0.8}
    assert len(want) > 20 and want <= kept
