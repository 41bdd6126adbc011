"""The stages of the corpus pipeline on a small corpus, against plain Python."""

import re

import pytest

import corpus_pipeline
from spotlattice.llm.util import stored


@pytest.fixture
def folder(spark, tmp_path):
    base = ["The quick brown fox jumps over the lazy dog and then runs home again today " + w for w in ("one", "two", "three")]
    rows = [(i, f"document {i} says " + " ".join(f"word{i}x{j}" for j in range(12)), "en", "ab"[i % 2]) for i in range(20)]
    rows += [(100 + i, base[0] + " tail end words here" * 3 + f" v{i}", "en", "a") for i in range(3)]
    rows += [(200, "1234 5678 !!", "en", "a"), (201, None, "en", "b"), (202, "reach me at jane.doe@mail3.example.com or 97.51.17.173 soon", "en", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("language_id") == {*range(20), 100, 101, 102, 202}
    assert ids("near_duplicates") == {*range(20), 100, 202} and len(seen["near_duplicates"]) == 22
    text = {r["doc_id"]: r for r in seen["pii"]}
    assert "jane" not in text[202]["text"] and "97.51" not in text[202]["text"] and text[202]["n_chars"] == len(text[202]["text"])
    assert all(text[i]["text"] == r["text"] for r in seen["near_duplicates"] if (i := r["doc_id"]) != 202)
    words = lambda name: sum(len(re.findall(r"\S+", r["text"])) for r in seen[name])
    assert abs(words("mixing") - words("pii")) < 60
    assert sum(r["n_words"] for r in seen["packing"]) == words("mixing")
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])


def stages(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    return seen


def test_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = str(tmp_path / "none")
    assert all(rows == [] for rows in stages(spark, docs.limit(0), path).values())
    assert corpus_pipeline.run(spark, path).count() == 0


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, ties, very long texts, and columns named as the operators name theirs."""
    long = " ".join(f"wort{i}" for i in range(30_000))
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(None, words + " null id", "en", "a"), (1, words, "en", "a"), (1, words, "en", "a"), (2, words, "de", "b"), (3, None, None, None), (4, "", "en", "b"), (5, "short text", None, None), (6, long, "de", "a"), (7, long + " and more", "de", "b"), (8, "other words entirely here", "en", None), (8, "und noch ein text dazu", "de", "c"), (9, "12 34", "en", "a"), (10, "same size four words", "en", "a"), (11, "same four words size", "en", "a")]
    extra = "score double, mix_size string, mix_source int, lang_pred string, n_words long, bin_id string, __src string, id long, cls long, n long"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", 3, "p", 7, "b", "c", 1, 2, 3) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    seen = stages(spark, docs, str(tmp_path))
    ids = lambda name: sorted(str(r["doc_id"]) for r in seen[name])
    assert ids("language_id") == sorted(map(str, [None, 1, 1, 2, 5, 6, 7, 8, 8, 10, 11]))
    assert ids("near_duplicates") == sorted(map(str, [None, 1, 5, 6, 8, 8, 10, 11]))
    assert ids("pii") == ids("near_duplicates")
    size = lambda name: sum(len((r["text"] or "").split()) for r in seen[name])
    assert set(ids("mixing")) <= set(ids("pii")) and 0.5 * size("pii") < size("mixing") < 1.5 * size("pii")
    assert sum(r["n_words"] for r in seen["packing"]) == size("mixing")
    kept = seen["near_duplicates"][0]
    assert (kept["mix_size"], kept["mix_source"], kept["score"], kept["bin_id"]) == ("s", 3, 0.5, "b")
    assert seen["mixing"][0]["mix_size"] == "s" and seen["mixing"][0]["mix_source"] == 3
