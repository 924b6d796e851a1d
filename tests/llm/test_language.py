"""Held-out accuracy of language identification, and awkward rows."""

import random
import zlib

import numpy as np
import pytest

from meridian.llm import language, registry
from meridian.llm._shared import text_bytes
from meridian.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, known boolean, key long"
WORDS = {
    "en": "the of and that with which this from have were their would there been over when more than people house water",
    "de": "der die und das nicht sich mit dem eine auch nach wird sind über haben werden schon zwischen haus wasser straße",
    "nl": "het een van niet zich met voor ook naar wordt zijn hebben worden tussen huis water straat deze geen maar",
    "es": "los las que una por con para del como pero sus más este cuando también hasta desde casa agua calle años",
    "fr": "les des que une par avec pour dans comme mais ses plus cette quand aussi jusque depuis maison eau rue années",
}


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        yield (i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.choice([2, 6, 60]))).capitalize() + rng.choice([".", "! 12", "\n"]), lang, lang[::-1], True, 0)


def test_held_out_accuracy(spark, tmp_path):
    rows = list(texts(4, 900))
    odd = [(2000, None, "en"), (2001, "", "fr"), (2002, " 12 ?! \n", None), (2003, "the people of that house", None), (None, "die straße und das wasser", "de"), (2004, "中文字", None), (2005, "les maisons des rues " * 60_000, None)]
    spark.createDataFrame(rows + [rows[3]] * 5 + [(*r, None, None, None) for r in odd], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 5 + len(odd)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if by[r[0]].held_out]
    assert sum(by[i].lang_pred == lang for i, _, lang, *_ in held) / len(held) > 0.97
    assert [(by[i].lang_pred, by[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert (by[2003].lang_pred, by[None].lang_pred, by[2005].lang_pred) == ("en", "de", "fr")
    assert by[2004].lang_pred in WORDS


def test_nothing_or_one_language_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "some text", None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    (row,) = registry.QUERIES["op12_language"](spark, f"{tmp_path}/a").collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    spark.createDataFrame([(i, "some text", "xx", None, None, None) for i in range(9)] + [(9, "other", None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.lang_pred for r in registry.QUERIES["op12_language"](spark, f"{tmp_path}/b").collect()} == {"xx"}


def test_features_of_pieces_equal_those_of_the_whole(monkeypatch):
    import pyarrow as pa

    rows = ["One text,  with 2 gaps. ", "", "ünï " * 50, "x", " ", "end"]
    whole = language.features(*text_bytes(pa.array(rows)))
    one = np.concatenate([language.features(*text_bytes(pa.array([r]))) for r in rows])
    assert np.allclose(whole, one)
    monkeypatch.setattr(language, "_PIECE", 7)
    assert np.allclose(whole, language.features(*text_bytes(pa.array(rows))))


def test_close_languages_are_told_apart_in_their_family():
    assert language.family_of("DE-at") == language.family_of("nl") != language.family_of("es") == language.family_of("fr")
    assert language.family_of("qq") != language.family_of("qx")


def test_machine_finds_the_widest_gap():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    y = np.where(x @ [1, -2, 0.5, 0, 0, 0] + 0.3 > 0, 1, -1).astype(np.float32)
    w = language.fit_svm(x, y, 1e-3)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98
