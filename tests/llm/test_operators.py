"""Each operator against brute force or a round trip, and on nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.llm import iblt, jaccard, langid, mixing, order, packing, pii, quality, sharding, tsmedia, warc
from spotlattice.llm.components import components
from spotlattice.llm.shingles import set_id, shingle_sets
from spotlattice.llm.util import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, n long, id string, k string"
KEY = "a key"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Été", "größe", "x1"]


def texts(n, seed=0, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(1, most))) for _ in range(n)]


def awkward(spark, more=()):
    """Nulls in every column, empty and very long texts, equal rows, equal ids with different texts."""
    rows = [(1, "alpha beta gamma delta", "en", "a"), (1, "alpha beta gamma delta", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "  \n\t ", "de", "a"), (5, "alpha", None, None), (6, "\n\n".join(texts(40, 3, 400)), "en", "a"), (7, "12 34 !!", "en", "c"), (None, "alpha beta gamma delta eps", "en", "a"), (8, "alpha beta gamma delta", "en", "b"), *more]
    return spark.createDataFrame([(*r, None, "s", "t", 5, "i", "k") for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- language ------------------------------------------------------------------------------------------------------
def test_language_backoff():
    import pandas as pd

    rows = [("en", w, 5) for w in ["the", "and", "house", "shell"]] + [("de", w, 5) for w in ["der", "und", "haus", "schule"]]
    model = langid.fit(pd.DataFrame(rows, columns=["lang", "word", "n"]))
    s = langid.Scorer(model)
    assert s.score("the house")[0] == "en" and s.score("und haus")[0] == "de"
    assert s.score("SCHULEN schul")[0] == "de"  # unseen words, by their n-grams
    assert s.score("") == s.score(None) == s.score("12 !") == ("und", 0.0)
    assert s.score("the der")[0] in ("en", "de") and 0 < s.score("the")[1] <= 1
    assert langid.Scorer(langid.fit(pd.DataFrame({"lang": [], "word": [], "n": []}))).score("the") == ("und", 0.0)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    model = langid.train_model(docs)
    got = langid.identify(docs, model, pred="p", score="s")
    assert set(docs.columns) < set(got.columns) and got.count() == docs.count()
    assert {r["p"] for r in got.where("doc_id in (2, 3, 4, 7)").collect()} == {"und"}
    assert langid.identify(nothing(spark), langid.train_model(nothing(spark))).count() == 0


# ---- similarity join -----------------------------------------------------------------------------------------------
def brute_groups(rows, width, num, den):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_names_of_few_bits_and_frequent_keys(spark, monkeypatch):
    """Sets that share a short name stay apart, and links are found when most keys are given up."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{t} {passage}") for i, t in near_copies(150, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 3, 9, 10)
    assert len({v[1] for v in want.values()}) < 150
    for bits in (64, 3):
        got = {r[0]: (r[1], r[2]) for r in jaccard.link_groups(docs, width=3, num=9, den=10, bits=bits).collect()}
        assert got == want
    with pytest.raises(RuntimeError):
        jaccard._classes(docs.withColumnRenamed("doc_id", "id"), 3, 5, most=3)


def near_copies(n, seed):
    rng, base, out = random.Random(seed), texts(max(2, n // 8), seed), []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("width, num, den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_groups_against_brute_force(spark, width, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 7)  # so that cells have several chunks
    rows = near_copies(120, width)
    got = {r[0]: (r[1], r[2]) for r in jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, num=num, den=den).collect()}
    assert got == brute_groups(rows, width, num, den)


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_share_a_key_that_neither_gives_up(num, den):
    rng = np.random.default_rng(num)

    def left(s):
        keys, code = jaccard.keys_of(s, num, den)
        return np.concatenate([np.sort(keys[code == c])[: max(0, (code == c).sum() - (int(c) >> 2))] for c in np.unique(code)]) if len(keys) else keys

    for n in [2, 3, 5, 9, 10, 12, 17, 40, 61, 200, 480]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(a) == both == len(b) or den * both < num * (len(a) + len(b) - both):
                continue
            assert len(np.intersect1d(left(a), left(b)))  # also after each has given up all that it may


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_share_a_key_in_any_order(num, den):
    """The ranks of elements decide what is a key, not whether linked sets share one, also when both give up their last ones."""
    rng = np.random.default_rng(den)
    for n in [2, 3, 9, 10, 11, 13, 40, 61, 200, 480]:
        for trial in range(30):
            rank = rng.integers(0, 3 if trial % 2 else 256, 64).astype(np.uint8)
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, n // 5 + 1)) :], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(a) == both == len(b) or den * both < num * (len(a) + len(b) - both):
                continue
            (ka, ca), (kb, cb) = jaccard.first_keys(a, num, den, rank), jaccard.first_keys(b, num, den, rank)
            spare = max(int(ca[0]) >> 2, int(cb[0]) >> 2)
            assert len(np.intersect1d(ka, kb)) > spare
            assert len(np.intersect1d(np.sort(ka)[: len(ka) - (int(ca[0]) >> 2)], np.sort(kb)[: len(kb) - (int(cb[0]) >> 2)]))


def test_common_passages_make_no_cells(spark, monkeypatch):
    """Texts that share passages with hundreds of others, but are not alike, are not searched; the near copies among them are."""
    rng = random.Random(5)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(5)]
    own = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(600)]
    rows = [(d, " ".join([*(three := rng.sample(lines, 3))[:2], own[d], three[2]])) for d in range(600)]
    rows += [(1000 + d, rows[d][1].rsplit(" ", 1)[0]) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    searched, search = [], jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda r, *a: (searched.append(r.count()), search(r, *a))[1])
    got = {r[0]: r[2] for r in jaccard.link_groups(docs, width=5, num=4, den=5).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert searched == [40]


def test_a_full_chunk_is_searched_in_seconds():
    """A chunk whose sets are alike in three quarters of their elements and do not link, but for one pair."""
    rng = np.random.default_rng(8)
    both = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(both)[:370], rng.integers(0, 1 << 62, 30).astype(np.uint64)])) for _ in range(jaccard.CHUNK_SETS)]
    sets[-1] = np.unique(np.concatenate([sets[3][5:], both[:1]]))
    began = time.process_time()
    assert jaccard.chunk_edges(list(range(len(sets))), sets, [False] * len(sets), 9, 10, 0) == [(len(sets) - 1, 3)]
    assert time.process_time() - began < 6


def test_groups_of_awkward_rows(spark):
    got = defaultdict(set)
    for r in jaccard.link_groups(awkward(spark), width=3, num=9, den=10).collect():
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(2, 1)} and got[8] == {(2, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)} and got[4] == {(0, 4)} and got[5] == {(1, 5)} and got[None] == {(3, None)}
    assert jaccard.link_groups(nothing(spark)).count() == 0
    kept = jaccard.keep_one(awkward(spark), width=3, num=9, den=10)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_groups_of_equal_ids_with_different_texts(spark):
    a, b, c, d, e = texts(5, 9)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, d), (8, d), (8, ""), (9, e), (9, None), (10, e), (2, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.link_groups(docs).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 9), (10, 9), (2, 2)}
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.link_groups(docs.unionByName(spark.createDataFrame([(1, e)], docs.schema))).collect()} == {*got - {(9, 9), (10, 9)}, (9, 1), (10, 1), (1, 1)}
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (8, c), (8, d), (8, ""), (9, e), (9, None), (2, " ")], key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = {i: i for e in edges for i in e}
    for _ in range(60):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: got.get(k, k) for k in up} == up


def test_shingle_hashes():
    a, b, c, d = shingle_sets(["The CAT  sat\ton É", "the cat sat on é", "the cat sat on É", None], 3)
    assert (a == c).all() and set_id(a) != set_id(b) and len(a) == 3 and len(d) == 0


# ---- personal data -------------------------------------------------------------------------------------------------
def test_surrogates(spark):
    rows = [(1, "Ann.B@mail7.example.com, ANN.B@MAIL7.EXAMPLE.COM +1 (017) 555-7713 or +10175557713"), (2, "4337166598464399 4337-1665-9846-4399 97.51.17.173"), (3, "Mr. John Smith, Mrs. Smith, госпожа Иванова"), (4, None), (5, ""), (6, "plain 12 text"), (6, "plain 12 text"), (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"!!')]
    got = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), count="c", secret=KEY).orderBy("doc_id").collect()
    a, b = got[0]["text"].split(" ")[0].rstrip(","), got[0]["text"].split(" ")[1]
    assert a == b.lower() and "ann" not in a and got[0]["c"] == 4
    left = got[0]["text"].split(" or ")[0]
    phone = re.sub(r"\D", "", left[left.index("+") :])
    assert phone[0] == "1" and got[0]["text"].endswith("+" + phone)
    x, y, ip = got[1]["text"].split(" ")
    assert y.replace("-", "") == x != "4337166598464399" and x[0] == "4" and ip.startswith("2")
    digits = [int(c) for c in reversed(x)]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    name = re.fullmatch(r"Mr\. (\w+) (\w+), Mrs\. (\w+), госпожа (\w+)", got[2]["text"])
    assert name[2] == name[3] != "Smith" and name[1] in pii._GIVEN["m"] and name[4].endswith("ова")
    assert [r["text"] for r in got[3:7]] == [None, "", "plain 12 text", "plain 12 text"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"!!', got[7]["text"])
    assert pii.replace(nothing(spark), secret=KEY).count() == 0 and pii.replace(awkward(spark), secret=KEY).count() == awkward(spark).count()


def test_surrogates_of_whole_mentions(spark):
    """No part of a mention stays: last groups of IBANs, long secrets, phones in pairs, names of several words."""
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "NL91ABNA0417164300", "NO9386011117947", "AT61 1904 3002 3457 3201", "ZZ68 5390 0754 7034 1"]
    long, longer = "04dbebab91ab8568" * 9, "0123456789abcdef" * 4000
    forms = [*ibans, long, longer, "+33 1 23 45 67 89", "+1 (017) 555-7713", "+44 (0)20 7946 0958", "+4930123456"]
    names = ["Mr. John Paul Smith", "Mrs. Anna P. Smith", "Mr. O'Brien", "Herr Karl Otto Emil Schmidt-Lang", "Mr. " + " ".join(["Smith"] * 6000)]
    rows = [(i, f"is {m} 12 so") for i, m in enumerate(forms)] + [(100 + i, f"saw {m}'s dog. The end") for i, m in enumerate(names)]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), count="c", secret=KEY).collect()}
    for i, m in enumerate(forms[:-4]):
        new = got[i]["text"].removeprefix("is ").removesuffix(" 12 so")
        same = [a == b for a, b in zip(m, new)]
        assert got[i]["c"] == 1 and len(new) == len(m) and sum(same) < 0.5 * len(m) and [c == " " for c in m] == [c == " " for c in new], m
    assert got[0]["text"].replace(" ", "") == got[1]["text"].replace(" ", "")
    new = got[len(ibans) + 1]["text"][3:-6]
    assert re.fullmatch("[0-9a-f]{64000}", new) and len({new[i : i + 64] for i in range(0, 64000, 64)}) == 1000
    for i, m in list(enumerate(forms))[-4:]:
        shape = lambda t: re.sub(r"\d", "0", t)
        assert got[i]["c"] == 1 and shape(got[i]["text"]) == shape(rows[i][1]) and m[-6:] not in got[i]["text"], m
    for i, m in enumerate(names):
        t = got[100 + i]["text"]
        assert got[100 + i]["c"] == 1 and t.startswith(f"saw {m.split(' ')[0]} ") and t.endswith("'s dog. The end"), m
        assert not set(re.findall(r"\w+", m)[1:]) & set(re.findall(r"\w+", t.removesuffix("'s dog. The end"))) and len(t.split(" ")) == len(f"saw {m}'s dog. The end".split(" ")), m


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With few surrogates to choose from, collisions are settled and mentions still agree."""
    monkeypatch.setattr(pii, "_SYLLABLES", ("ba", "do"))
    people = [f"{a}{b}son" for a in ("Al", "Be", "Ce", "Di", "Ed", "Fo") for b in ("ber", "lin", "mar")]
    rows = [(i, f"Mr. {p} and Mr. {p}") for i, p in enumerate(people)]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), secret=KEY).collect()]
    pairs = [re.fullmatch(r"Mr\. (\S+) and Mr\. (\S+)", t).groups() for t in got]
    assert all(a == b for a, b in pairs) and len({a for a, _ in pairs}) == len(people)


def test_names_without_a_title_in_a_document_that_names_them(spark):
    rows = [(1, "Mr. John Smith came. Later Smith and John Smith left; SMITH's dog, Smithson and john stayed."), (2, "Smith and John are not named here."), (3, "Frau Anna B. Lang-Meyer: Lang-Meyer, Anna, Lang."), (4, "Mr. Smith saw John Smith.")]
    got = {r[0]: r[1] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), secret=KEY).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Later (\w+) and (\w+) (\w+) left; (\w+)'s dog, Smithson and john stayed\.", got[1])
    assert m and m[1] == m[4] != "John" and m[2] == m[3] == m[5] != "Smith" and m[6] == m[2].upper()
    assert got[2] == rows[1][1]
    f = re.fullmatch(r"Frau (\S+) (\S+) (\S+): (\S+), (\S+), Lang\.", got[3])
    assert f and f[1] == f[5] != "Anna" and f[3] == f[4] != "Lang-Meyer"
    assert got[4] == f"Mr. {m[2]} saw John {m[2]}."


def test_surrogates_of_many_made_up_texts(spark):
    """Known entities between known words: a plain loop tells what is left, what agrees, what is distinct, what keeps its form."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
        c = body + str(-total % 10)
        return rng.choice([c, " ".join(c[i : i + 4] for i in (0, 4, 8, 12)), "-".join(c[i : i + 4] for i in (0, 4, 8, 12))])

    def iban():
        account = digits(18)
        return f"DE{98 - int(account + '131400') % 97:02d}{account}"

    makers = {
        "email": lambda: f"{rng.choice(['ann', 'Bob', 'c.d', 'eve+x'])}{rng.randrange(9)}@{rng.choice(['Example.com', 'mail.test.org', 'site7.net'])}",
        "ip": lambda: ".".join(str(rng.randrange(1, 224)) for _ in range(4)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64, 200]))),
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"+49{digits(9)}", f"({digits(3)}) {digits(3)}-{digits(4)}"]),
        "iban": iban,
        "name": lambda: f"{rng.choice(['Mr.', 'Mrs.', 'Herr', 'госпожа'])} {rng.choice(['Ada', 'Bo', 'Cy', 'Dee'])} {rng.choice(['Oak', 'Pine', 'Elm', 'Fir', 'Yew'])}{rng.choice(['ton', 'by', 'man'])}",
    }
    normal = lambda t, x: re.sub(r"\D", "", x) if t in ("phone", "card", "ssn") else x.replace(" ", "") if t == "iban" else x if t == "name" else x.lower()
    pool = [(t, make()) for t, make in makers.items() for _ in range(40)]
    rows, truth = [], []
    for i in range(500):
        found = [rng.choice(pool) for _ in range(rng.randrange(4))]
        words = [" ".join(rng.choice(WORDS[:12]) for _ in range(rng.randrange(1, 6))) for _ in range(len(found) + 1)]
        rows.append((i, "".join(f"{w} \u2016 {e} \u2016 " for w, (_, e) in zip(words, found)) + words[-1]))
        truth.append((words, found))
    got = dict(pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), secret=KEY, count="n").drop("n").collect())
    shape = lambda x: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", x)))
    seen: dict = {}
    words_seen: dict = {}
    for i, (words, found) in enumerate(truth):
        pieces = got[i].split(" \u2016 ")
        assert pieces[::2] == words and len(pieces) == 2 * len(found) + 1
        for (t, e), new in zip(found, pieces[1::2]):
            if t == "name":
                old, made = e.split(" "), new.split(" ")
                assert old[0] == made[0] and len(made) == 3
                woman = old[0] in ("Mrs.", "госпожа")
                for role, a, b in ((f"given {woman}", old[1], made[1]), ("surname", old[2], made[2])):
                    assert a != b and words_seen.setdefault((role, a.lower()), b) == b
                continue
            assert new != e and seen.setdefault((t, normal(t, e)), normal(t, new)) == normal(t, new)
            if t in ("ssn", "card", "phone", "iban"):
                assert [c.isdigit() for c in e] == [c.isdigit() for c in new] and shape(e) == shape(new)
            if t == "iban":
                assert int(new[4:] + "1314" + new[2:4]) % 97 == 1
            if t == "card":
                assert sum(d if j % 2 == 0 else d * 2 - 9 * (d > 4) for j, d in enumerate(map(int, reversed(re.sub(r"\D", "", new))))) % 10 == 0
            if t == "secret":
                assert len(new) == len(e) and re.fullmatch("[0-9a-f]+", new)
    for table in (seen, words_seen):
        assert len(set((k[0], v.lower()) for k, v in table.items())) == len(table)
        assert not {(k[0], v.lower()) for k, v in table.items()} & set(table)


def test_texts_without_a_mention_are_passed_by(spark):
    """Every alternative of the pattern needs something that the cheap look asks for."""
    possible = ["a@b.co", "Miss Oak", "Señora Oak", "x deadbeefdeadbeefdeadbeefdeadbeef", "1.2.3.4", "+12345678", *(f"{t} Oak" for ts in pii._TITLES.values() for t in ts)]
    rows = [(t,) for t in [*possible, "plain words only", "", "mr oak"]]
    df = spark.createDataFrame(rows, "t string").select("t", pii._possible(F.col("t")).alias("p"), (F.regexp_count("t", F.lit(pii.PATTERN)) > 0).alias("m"))
    assert {r["t"]: r["p"] for r in df.collect()} == {t: t in possible for t, in rows} and df.where("m and not p").isEmpty() and df.where("m").count() >= len(possible) - 1


# ---- packing, mixing, sharding ---------------------------------------------------------------------------------------
def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    for seed in range(5):
        n = 150
        lengths = np.sort(rng.integers(1, 100, n))[::-1]
        conflicts = [rng.integers(0, 40, n), rng.choice([0, 0, 0, 1, 2, 3, 4, 5], n)]
        bins, offsets, left = packing.best_fit(lengths, conflicts, 100)
        used = Counter()
        for b, o, size in zip(bins, offsets, lengths):
            assert o == used[b]
            used[b] += size
        assert all(100 - used[b] == left[b] for b in used)
        for c in conflicts:
            assert len(set(zip(bins.tolist(), c.tolist()))) == n
        # what each bin had left when it was chosen is the least possible
        state = {}
        for i, (b, size) in enumerate(zip(bins, lengths)):
            able = [free for k, (free, has) in state.items() if free >= size and not any((j, c[i]) in has for j, c in enumerate(conflicts))]
            free, has = state.get(b, (100, set()))
            assert free == min(able) if able else b not in state
            state[b] = (free - size, has | {(j, c[i]) for j, c in enumerate(conflicts)})


def test_packing_of_awkward_rows(spark):
    got = packing.pack(awkward(spark), capacity=50).toPandas()
    assert got.loc[got.doc_id.isin([2, 3, 4]), "bin_id"].isna().all()
    packed = got[got.n_words > 0]
    assert packed.groupby("bin_id").n_words.sum().max() <= 50 and packed[packed.doc_id == 6].n_words.sum() > 50
    assert packing.pack(nothing(spark)).count() == 0


def test_packing_groups_are_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = [(i, " ".join(["w"] * (35 + 7 * i % 60)) + f" {i}", f"s{i}") for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=10).toPandas()
    assert got.n_words.sum() == sum(len(t.split()) for _, t, _ in rows) and len(got) > 400
    assert got.groupby(got.bin_id.astype("int64") // 2**40).size().max() <= 2 * 64


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, t, rng.choice(["a", "a", "a", "b", "c", None])) for i, t in enumerate(texts(300, 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shards=6, blocks_per_shard=8).toPandas()
    size = {i: len(t.split()) for i, t, _ in rows}
    by = got.groupby("mix_source")
    assert ((by.mix_words.sum() - by.mix_target.first()).abs() <= 0.5).all()
    assert abs(by.mix_target.first().sum() - sum(size.values())) < 1e-6 and (by.mix_target.first() <= 3 * by.mix_source_size.first() + 1e-9).all()
    taken = got.groupby("doc_id").mix_words.sum()
    assert all(taken[i] <= 3 * n for i, n in size.items())
    assert got[got.mix_words > 0].mix_shard.notna().all()
    again = mixing.mix(docs.repartition(7), shards=6, blocks_per_shard=8).toPandas()
    key = ["doc_id", "mix_words", "mix_shard", "mix_slot"]
    assert got[key].sort_values(key).fillna(-1).values.tolist() == again[key].sort_values(key).fillna(-1).values.tolist()
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mix(awkward(spark)).count() >= awkward(spark).count()
    whole = mixing.mixed_documents(docs, shards=4)
    assert whole.columns == docs.columns and all(r["text"] == rows[r["doc_id"]][1] for r in whole.collect())


def test_splitting_tree_quotas(spark):
    blocks = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(13)], "mix_source string, mix_block long")
    quotas = mixing.split_quotas(blocks, 5, 1)
    per = {r["mix_shard"]: r["q"] for r in quotas.groupBy("mix_shard").agg(F.sum("quota").alias("q")).collect()}
    assert sum(per.values()) == 63 and max(per.values()) - min(per.values()) <= 2
    dealt = mixing.deal_blocks(blocks, quotas, 1)
    assert dealt.count() == 63 and dealt.select("mix_source", "mix_block").distinct().count() == 63


def test_sharding(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(40), rng.choice("aaaab")) for i in range(1003)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=40, keep=("source",)).toPandas()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 40
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    share = got.source.eq("a").groupby(got["shard"]).mean()
    assert (share - (got.source == "a").mean()).abs().max() < 0.06
    assert all(zlib.crc32(rows[r.doc_id][1].encode()) == r.text_crc32 and len(rows[r.doc_id][1]) + 16 == r.size for r in got.itertuples())
    few = sharding.interleave(awkward(spark), shards=40)
    assert few.count() == awkward(spark).count() and few.select("shard", "slot").distinct().count() == few.count()
    assert sharding.interleave(nothing(spark), shards=3).count() == 0


# ---- media and archives ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 63, 64, 160, 163, 164, 170, 182, 2047, 2048, 2049, 70_000])
def test_transport_stream_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    stream = tsmedia.mux(data)
    got, stamps, points = tsmedia.demux(stream)
    assert got == data and len(stream) % 188 == 0
    assert stamps == [i * tsmedia.PES_TICKS for i in range(max(1, -(-n // tsmedia.PES_BYTES)))] and points == [i * tsmedia.PES_BYTES for i in range(0, len(stamps), tsmedia.ACCESS_EVERY)]


def test_transport_stream_finds_damage():
    stream = tsmedia.mux(b"abc" * 3000)
    with pytest.raises(ValueError, match="continuity"):
        tsmedia.demux(stream[: 188 * 5] + stream[188 * 6 :])
    with pytest.raises(ValueError, match="synchronisation"):
        tsmedia.demux(b"x" + stream[1:])
    with pytest.raises(ValueError, match="program table"):
        tsmedia.demux(stream[:8] + b"\xff" + stream[9:])
    long = tsmedia.mux(bytes(40_000))
    second = long.index(b"\x47\x40\x00\x11")  # the PAT's next packet
    with pytest.raises(ValueError, match="program table"):
        tsmedia.demux(long[: second + 10] + b"\xff" + long[second + 11 :])
    network = tsmedia._table_packet(0, tsmedia._section(0, 1, bytes([0, 0, 0xE0, 0x10, 0, 1, 0xF0, 0])))
    assert tsmedia.demux(network[:3] + stream[3:4] + network[4:] + stream[188:])[0] == b"abc" * 3000
    twice = stream[: 188 * 5] + stream[188 * 4 : 188 * 5] + stream[188 * 5 :]
    assert tsmedia.demux(twice)[0] == b"abc" * 3000


def test_media_of_awkward_rows(spark):
    docs = awkward(spark)
    for r in tsmedia.media_features(tsmedia.with_media(docs)).collect():
        want = tsmedia.pad((r["text"] or "").encode())
        assert r["media_info"]["payload_sha256"] == hashlib.sha256(want).hexdigest() and len(want) % 64 == 0 and want
    assert tsmedia.media_features(tsmedia.with_media(nothing(spark))).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600
    rows = [(i, f"http://h/{i} x", big if i % 4 == 0 else f"<p>{i}" * (i % 300)) for i in range(200)] + [(500, None, None), (501, "u", "tiny"), (502, "u", "tiny"), (None, "u", big), (196, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    roots, sums = [fresh_path(spark, "warc") for _ in range(2)], []
    for root, df in zip(roots, (pages, pages.repartition(5))):
        manifest = warc.write(df, root, shard_bytes=40_000, roll_bytes=3_000)
        sums.append([(m["name"], m["sha256"]) for m in manifest])
        assert len(manifest) > 5 and json.dumps(manifest)
    assert sums[0] == sums[1]  # whatever the partitions, the same bytes
    got = sorted(warc.read(spark, roots[0]).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] % 4 == 0 and r["page_id"] < 196:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 196, None) and r["payload_bytes"] == len(big.encode())
        else:
            assert r["record_type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    empty = fresh_path(spark, "warc")
    assert warc.write(pages.limit(0), empty) == [] and warc.read(spark, empty).count() == 0


# ---- quality and fingerprints ------------------------------------------------------------------------------------------
def test_quality_rules(spark):
    good, bad = texts(150, 8), [t.replace(" ", "%%% ") for t in texts(150, 9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert sum((got[i] >= 0.3) == (i < 150) for i in range(1, 300, 2)) > 140
    x = np.array([tuple(r["s"]) for r in docs.orderBy("doc_id").select(quality.statistics(F.col("text")).alias("s")).collect()])
    np.testing.assert_allclose(model.score(x), [got[i] for i in range(300)], rtol=1e-9)
    assert len(model.rules) < 60
    edge = quality.score(awkward(spark), model, out="q")
    assert edge.where("q between 0 and 1").count() == awkward(spark).count() and "score" in edge.columns
    none = quality.train(nothing(spark), labels.limit(0))
    assert quality.score(nothing(spark), none).count() == 0 and none.rules == ()


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(10)
    lines = [f"line {i}" for i in range(300)]
    rows = [(i * 7, "\n".join(rng.choices(lines, k=rng.choice([0, 1, 3, 8, 30, 200])))) for i in range(60)]
    got = {r["doc_id"]: r for r in iblt.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    of = lambda t: {x for x in t.split("\n") if x}
    for i, (d, t) in enumerate(rows):
        after, h = rows[(i + 1) % len(rows)][1], len(t) // 2
        e = t[: len(t) - h] + after[:h]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(of(t), of(e))) and r["near_next"] == pytest.approx(like(of(t), of(after)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (of(t) == of(e))


def test_peeling_recovers_the_digests(spark):
    a, b = list(range(100, 140)), list(range(125, 160))
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], [])], "pair int, a array<long>, b array<long>")
    got = {r["pair"]: {(x["k"], x["n"]) for x in r["found"]} for r in iblt.differences(pairs).collect()}
    assert got == {1: {(k, 1) for k in range(100, 125)} | {(k, -1) for k in range(140, 160)}, 2: set(), 3: set()}


def test_fingerprints_of_awkward_rows(spark):
    got = iblt.compare_with_edited(awkward(spark)).collect()
    assert len(got) == awkward(spark).count() and len({r["fingerprint"] for r in got if r["doc_id"] in (1, 8)}) == 1
    assert iblt.compare_with_edited(nothing(spark)).count() == 0


# ---- ranges ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("far", [[], [10**15], [-(2**63), 2**63 - 1], [10**12 + i for i in range(500)] + [10**18]])
def test_steps_are_even_whatever_the_keys(spark, far):
    keys = [*range(7, 4007), *far, *[50] * 200]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    every = order.steps(df, "k", 40)
    got = every.of(df).withColumn("c", every.bucket(256)).toPandas().sort_values("k", na_position="first")
    assert got["__b"].is_monotonic_increasing and got["c"].is_monotonic_increasing and got["c"].between(0, 255).all() and got["__b"].iloc[0] < 0
    per = got.groupby("__b").k.agg(["size", "nunique"])
    assert per[per["nunique"] > 1]["size"].max() <= 4 * 40 + 200 and len(per) > 40
    again = order.steps(df.repartition(5), "k", 40).of(df).select("k", "__b").toPandas()
    assert sorted(map(tuple, again.fillna(-1).values.tolist())) == sorted(map(tuple, got[["k", "__b"]].fillna(-1).values.tolist()))


def test_one_far_id_does_not_gather_the_archive(spark):
    pages = spark.createDataFrame([(i, "http://x/", f"{i:04d}" * 250) for i in [*range(2000), 10**15]], "page_id long, url string, html string")
    root = fresh_path(spark, "warc")
    manifest = warc.write(pages, root, shard_bytes=100_000)
    per: dict = defaultdict(int)
    for m in manifest:
        per[m["shard"]] += m["records"]
    assert sum(per.values()) == 2001 and max(per.values()) <= 160 and len(per) >= 18
    assert sorted(r["page_id"] for r in warc.read(spark, root, payload=False).collect()) == [*range(2000), 10**15]


def test_successors_of_skewed_ids(spark):
    ids = [*range(0, 3000, 3), 10**15, 10**15 + 2, -5, 7, 7]
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)] + [(None, "none")], "doc_id long, text string")
    got = iblt.with_successor(docs).toPandas()
    rows = sorted(docs.withColumn("x", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["x"]))
    want = {r["text"]: rows[(i + 1) % len(rows)]["text"] for i, r in enumerate(rows)}
    assert dict(zip(got.text, got.next_text)) == want
