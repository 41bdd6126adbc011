"""The registered queries themselves: columns and types, hold-outs, and results against plain Python on a small folder."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spotlattice.llm import packing, queries, util

WORDS = {"en": "the house and shell of water with many small things".split(), "de": "das haus und die schule von wasser mit vielen kleinen dingen".split(), "fr": "la maison et la coquille de notre eau avec petites choses".split()}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = ". ".join(" ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 12))).capitalize() + f" x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))
        if i % 5 == 0:
            text = text.replace(" ", " %% ", 6)
        out.append((i, "\n".join(text.split(". ")) if i % 2 else text, lang, rng.choice("aabc") if i % 17 else None))
    out += [(n, out[3][1], "en", "a"), (n + 1, out[3][1], "de", "b"), (n + 2, None, "en", "a"), (n + 3, "", None, "c"), (n + 4, "12 ½ ² Ⅷ !!", "en", "a"), (n + 5, out[8][1] + " tail", "en", "c"), (n + 6, "Mr. John Oak met Oak; mail j@x.org", None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("tables")), corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("%%" not in (t or "")), 0) for i, t, *_ in rows if i % 3]
    spark.createDataFrame([*labels, *labels[:5], (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    big = "<p>" + "é" * 600
    pages = [(1, "u", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def rows():
    return corpus()


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_types_and_rows(spark, folder, rows):
    want = {
        "op1_pii_surrogates": "doc_id bigint, text string, n_mentions int",
        "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op6_transport_stream": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
        "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, by_shard string",
        "op8_iblt_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op10_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    }
    for name, types in want.items():
        got = queries.QUERIES[name](spark, folder)
        assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == types, name
        if name != "op4_warc":
            assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == [r[0] for r in rows], name


def test_language_query_holds_out_and_knows_letters(spark, folder, rows):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, folder).collect()}
    for i, t, lang, _ in rows:
        r = got[i]
        assert r["held_out"] == (remainder(i, 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
    held = [(got[i]["lang_pred"], lang) for i, t, lang, _ in rows[:240] if got[i]["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95


def test_language_query_does_not_learn_from_what_it_holds_out(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lie = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("zz")).otherwise(F.col("lang"))
    docs.withColumn("lang", lie).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda path: sorted(map(tuple, queries.op2_language_id(spark, str(path)).collect()))
    assert key(tmp_path) == key(folder)


def test_quality_query_does_not_learn_from_what_it_holds_out(spark, folder, tmp_path):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lie = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", lie).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    got, again = ({r["doc_id"]: r for r in queries.op5_quality(spark, str(p)).collect()} for p in (folder, tmp_path))
    assert got == again
    known = {r["doc_id"]: r["quality"] for r in labels.where("doc_id is not null and quality is not null").collect()}
    held = [(got[i]["predicted"], q) for i, q in known.items() if got[i]["held_out"] and i < 240]
    assert len(held) > 15 and sum(a == b for a, b in held) / len(held) > 0.9
    assert all(r["held_out"] == (remainder(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())


def test_media_query(spark, folder, rows):
    got = {r["doc_id"]: r for r in queries.op6_transport_stream(spark, folder).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_bytes"] % 188 == 0


def test_mixing_query_is_what_the_tree_dealt(spark, folder, rows):
    got = queries.op7_mixing(spark, folder).collect()
    sums, targets = defaultdict(int), {}
    source = {i: s for i, _, _, s in rows}
    for r in got:
        by = [tuple(map(int, x.split(":"))) for x in r["by_shard"].split(",") if x]
        assert sum(w for _, w in by) == r["taken"] <= 3 * r["size"] and sorted(by) == by and all(0 <= s < 16 for s, _ in by)
        sums[source[r["doc_id"]]] += r["taken"]
        targets[source[r["doc_id"]]] = r["target"]
    assert all(abs(sums[s] - t) <= 0.5 for s, t in targets.items())
    again = sorted(map(tuple, queries.op7_mixing(spark, folder).collect()))
    assert again == sorted(map(tuple, got))


def test_mixing_query_stores_its_words_once(spark, folder):
    before = len(util._WRITTEN)
    queries.op7_mixing(spark, folder)
    assert [path.rpartition("/")[2].partition("-")[0] for path in util._WRITTEN[before:]] == ["words", "targets"]


def test_words_are_counted_without_an_object_for_each(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "\n\ta\n\t", "a\n\tb", " " * 3000, "a " * 3000, "\r\n" * 9 + "w" * 9 + "\t" * 3000]
    texts += ["".join(rng.choices(" \t\n\x0b\x0c\rab\x00\x1c\x1f\x85\xa0\u2003é漢😀", k=rng.randrange(1, 14))) for _ in range(2000)]
    counted = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", util.n_words(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in counted.collect()} == {i: len(re.findall(util.WORD, t or "")) for i, t in enumerate(texts)}
    assert "regexp" not in counted._jdf.queryExecution().optimizedPlan().toString().lower()
    cut = [b"\xe2 a", b"a\xff b\xc3", b"\xf0\x9f a b", b" \x80\t\xe2\n", b" \n"]
    got = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(cut)], "i long, b binary").select("i", util.n_words(F.col("b").cast("string")))
    assert sorted(map(tuple, got.collect())) == [(0, 2), (1, 2), (2, 3), (3, 2), (4, 0)]


def test_warc_query(spark, folder):
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op4_warc(spark, folder).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    big = "<p>" + "é" * 600
    assert got == {1: (1203, sha(big), "revisit", 2), 2: (1203, sha(big), "response", None), 3: (5, sha("small"), "response", None), 4: (5, sha("small"), "response", None), 5: (0, sha(""), "response", None), 6: (0, sha(""), "response", None)}


def test_packing_query_against_a_plain_best_fit(spark, folder, rows):
    """One group holds all pieces here, so a plain loop over the same order must find the same bins."""
    got = queries.op3_best_fit_packing(spark, folder).toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    text, source = {i: t for i, t, *_ in rows}, {i: s for i, _, _, s in rows}
    assert got.groupby("doc_id").n_words.sum().to_dict() == size
    packed = got[got.n_words > 0].copy()
    seeds = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.lit(0)).alias("h")).collect()}
    packed["h"] = packed.doc_id.map(seeds)
    bins: list = []
    want = {}
    for r in packed.sort_values(["n_words", "h"], ascending=[False, True]).itertuples():
        able = [b for b in bins if b["left"] >= r.n_words and text[r.doc_id] not in b["texts"] and source[r.doc_id] not in b["sources"]]
        b = min(able, key=lambda b: b["left"]) if able else {"left": 2048, "texts": set(), "sources": set(), "docs": set()}
        if not able:
            bins.append(b)
        b["left"] -= r.n_words
        b["texts"].add(text[r.doc_id]), b["sources"].add(source[r.doc_id]), b["docs"].add(r.doc_id)
        want[r.doc_id] = b
    found = packed.groupby("bin_id").doc_id.apply(frozenset)
    assert len(found) == len(bins) and sorted(packed.groupby("bin_id").n_words.sum()) == sorted(2048 - b["left"] for b in bins)


def test_groups_over_the_size_are_cut_and_nothing_is_lost(spark, monkeypatch):
    """Equal ids fall into one group, however many there are."""
    monkeypatch.setattr(packing, "GROUP", 8)
    docs = spark.createDataFrame([(1, f"w{i % 3} " * (i % 7 + 1), f"s{i % 5}") for i in range(60)], "doc_id long, text string, source string")
    got = packing.pack(docs, capacity=10).toPandas()
    assert len(got) == 60 and got.n_words.sum() == sum(i % 7 + 1 for i in range(60)) and got.groupby("bin_id").n_words.sum().max() <= 10
    same = packing.pack(spark.createDataFrame([(i, "a b", "s") for i in range(30)], docs.schema), capacity=10).toPandas()
    assert same.bin_id.nunique() == 30  # ties of length, equal texts: a bin each


def test_shares_of_very_large_tables(spark):
    """A bound of 500 documents still draws about 500 of a thousand million."""
    n = spark.range(10**9).where(util.share_of_hash(7, "id") < 500 / 10**9).count()
    assert 380 < n < 620


def test_intermediates_can_be_discarded(spark, folder):
    queries.op9_sharding(spark, folder).count()
    assert util.discard(spark) > 0 and util.discard(spark) == 0
