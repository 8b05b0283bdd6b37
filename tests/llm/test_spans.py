import random
from collections import defaultdict

import pytest

from graphloom.llm import spans as S

DOCS = "doc_id long, text string, doc string"


def brute(docs, n=200):
    seen = defaultdict(set)
    for d, t, _ in docs:
        for i in range(len(t or "") - n + 1):
            seen[t[i : i + n]].add(d)
    found, cover = set(), defaultdict(set)
    for d, t, _ in docs:
        for i in range(len(t or "") - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                found.add(d)
                cover[d].update(range(i, i + n))
    return found, {d: len(c) for d, c in cover.items()}


def data(seed=0):
    rng = random.Random(seed)
    letters = "abcdefg \n.é日😀"
    text = lambda n: "".join(rng.choices(letters, k=n))
    docs = [text(rng.randrange(0, 900)) for _ in range(40)]
    for n in (199, 200, 201, 210, 230, 260, 320, 500):  # just too short, just enough, and more
        for _ in range(3):
            s = text(n)
            for _ in range(2):
                k = rng.randrange(len(docs))
                at = rng.randrange(len(docs[k]) + 1)
                docs[k] = docs[k][:at] + s + docs[k][at:]
    head = text(240)
    docs += [head + text(150) for _ in range(12)]  # a hot span
    docs += ["x" * 300, "x" * 450, "ab" * 200, "y" * 700, text(250) * 1]
    own = text(200)
    docs += [own + "|" + own, text(3000), docs[3]]
    return [(i, t, "z") for i, t in enumerate(docs)] + [(1000, None, "z"), (1001, "", "z")]


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    docs = data(seed)
    found, cover = brute(docs)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert {r["doc"] for r in S.sharing_documents(df).collect()} == found
    got = S.shared_coverage(df).collect()
    assert {r["doc"]: r["shared_chars"] for r in got} == cover
    assert all(0 <= r["removable_chars"] <= r["shared_chars"] <= r["n_chars"] for r in got)


def test_a_full_sieve_keeps_all(spark, monkeypatch):
    monkeypatch.setattr(S, "SIEVE_WORDS", 1)
    docs = data(4)
    assert {r["doc"] for r in S.sharing_documents(spark.createDataFrame(docs, DOCS)).collect()} == brute(docs)[0]


def test_sieve(spark):
    ids = spark.range(0, 1000, 7).selectExpr("id as doc")
    got = {r["doc"] for r in S._sieved(spark.range(1000).selectExpr("id as doc"), ids).collect()}
    assert {r["doc"] for r in ids.collect()} <= got and len(got) < 200


def test_first_copy_is_kept(spark):
    docs = data(5)
    first = min(r["doc"] for r in S.shared_coverage(spark.createDataFrame(docs, DOCS)).collect())
    got = {r["doc"]: r["removable_chars"] for r in S.shared_coverage(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[first] == 0 and any(got.values())


def test_deduplicated(spark):
    docs = data(6)
    df = spark.createDataFrame(docs, DOCS)
    gone = {r["doc"]: r["removable_chars"] for r in S.shared_coverage(df).collect()}
    got = {r["doc"]: r["text"] for r in S.deduplicated(df).collect()}
    assert {d: len(t) - gone.get(d, 0) for d, t, _ in docs if t is not None} == {d: len(t) for d, t in got.items()}
    assert got[0] == docs[0][1] or 0 in gone


def test_long_text_is_segmented(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 256)
    texts = S.Texts([t for _, t, _ in data(3) if t and len(t) >= 200])
    small = texts.borders()[0].tolist()
    monkeypatch.setattr(S, "SEGMENT", 1 << 22)
    assert texts.borders()[0].tolist() == small


def test_empty_and_limits(spark):
    assert S.sharing_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert S.sharing_documents(spark.createDataFrame([(1, "short", ""), (2, "short", ""), (3, None, "")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        S.sharing_documents(spark.createDataFrame([], DOCS), min_chars=100)
