import random
import re

from graphloom.llm import leakage as L

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, suite string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n=13):
    out = set()
    for d, t, _ in docs:
        w = words(t)
        for i, q, _ in items:
            v = words(q)
            k = min(n, len(v))
            if k and any(w[a : a + k] == v[b : b + k] for a in range(len(w) - k + 1) for b in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def data(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "naïve", "İx", "under_score", "a-b", "straße"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 5, 12, 13, 14, 30])), "s") for i in range(30)] + [(100, None, "s"), (101, "", "s"), (102, "...", "s")]
    docs = []
    for d in range(80):
        t = text(60)
        if rng.random() < 0.6:
            q = rng.choice(items[:30])[1].split(" ")
            k = rng.choice([len(q), 12, 13, max(1, len(q) - 2)])
            t += "\n" + rng.choice([",  ", " -- ", "\t"]).join(q[:k]).upper() + "!\n" + text(20)
        docs.append((d, t, "x"))
    return docs + [(900, None, "x"), (901, "", "x"), (902, "  ", "x"), (0, docs[0][1], "x")], items


def test_matches_brute_force(spark):
    docs, items = data()
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert {tuple(r) for r in L.leaks(df, it).collect()} == want and want
    assert {tuple(r) for r in L.leaks(df, it, block_windows=20).collect()} == want
    spans = L.passages(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in spans} == want
    text, item = {d: t for d, t, _ in docs}, {i: q for i, q, _ in items}
    for r in spans:
        v, got = words(item[r["item_id"]]), words(text[r["doc_id"]][r["start"] : r["end"]])
        assert len(got) == r["words"] >= min(13, len(v))
        n = min(13, len(v))
        assert got[:n] in [v[k : k + n] for k in range(len(v))]


def test_offsets_where_lower_case_is_longer():
    t = "İİ one two"
    assert [t[a:b] for a, b in L.word_offsets(t)][-2:] == ["one", "two"]


def windows_joined(text, item, n=13):
    """All occurrences of the item's windows in the text's words, overlapping ones joined."""
    w, v = words(text), words(item)
    k = min(n, len(v))
    have = {tuple(v[b : b + k]) for b in range(len(v) - k + 1)} if k else set()
    out = []
    for a in range(len(w) - k + 1):
        if tuple(w[a : a + k]) in have:
            if out and a < out[-1][1]:
                out[-1][1] = a + k
            else:
                out.append([a, a + k])
    return [tuple(x) for x in out]


def test_passages_are_whole():
    rng = random.Random(5)
    for _ in range(300):
        vocab = [f"v{i}" for i in range(rng.choice([1, 2, 3, 20]))]
        items = tuple((i, " ".join(rng.choices(vocab, k=rng.choice([3, 13, 14, 25, 60])))) for i in range(3))
        text = " ".join(rng.choices(vocab, k=30)) + " " + " ".join(items[0][1].split()[2:40]) + " " + " ".join(rng.choices(vocab, k=10))
        machine, at = L.Items(items), L.word_offsets(text)
        got = {(i, a, b) for i, a, b, _ in machine.passages(text)}
        assert got == {(i, at[a][0], at[b - 1][1]) for i, q in items for a, b in windows_joined(text, q)}


def test_empty_tables(spark):
    docs, items = data()
    none = spark.createDataFrame([], DOCS)
    assert L.leaks(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
