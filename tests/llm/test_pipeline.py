"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    make = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(15)) for _ in range(n))
    rows = {i: make(rng.randint(2, 9)) for i in range(500)}
    toxic = set(range(0, 500, 5))
    for i in toxic:
        parts = rows[i].split(" ")
        for _ in range(3):
            parts.insert(rng.randrange(len(parts)), rng.choice(["vilest", "nastier"]))
        rows[i] = " ".join(parts)
    item = " ".join(rng.choice(words) for _ in range(30))
    rows[501] = make(3) + "\n" + item + " " + make(1)
    passage = make(1)
    rows[502], rows[503] = make(4) + "\n" + passage, make(4) + "\n" + passage
    rows[504] = rows[504 - 1]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s" + str(i % 3), len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(450)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, toxic, passage


def test_stages(spark, corpus, tmp_path):
    path, rows, toxic, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert out.columns[: len(columns)] == columns and (len(out.columns) == len(columns) or name == "mixing")
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = set(kept["toxicity"])
    assert len(toxic - first) >= 0.95 * len(toxic) and len(set(rows) - toxic - first) <= 5
    lines = kept["line dedup"]
    assert set(lines) == first and passage in lines[502].text and passage not in lines[503].text and lines[504].text == ""
    assert set(kept["near-duplicates"]) == first - ({504} if any(r.text == "" and i < 504 for i, r in lines.items()) else set())
    assert set(kept["near-duplicates"]) - set(kept["benchmark decontamination"]) == {501}
    mixed = kept["mixing"]
    assert set(mixed) <= set(kept["benchmark decontamination"]) and all(0 < r.mix_taken <= 2 * r.mix_size for r in mixed.values())


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 100
