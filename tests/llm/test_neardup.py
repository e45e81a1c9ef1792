"""Near-duplicates against exact comparison of all pairs."""

import random

import numpy as np

from lodestone.llm import neardup as N


def jaccard(a, b):
    x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_golay_decodes_every_word():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    k = N.golay_keys(words)
    n = np.array([len(set(r)) for r in k])
    assert set(n) == {1, 6}
    flip = words ^ (1 << np.random.default_rng(1).integers(0, 23, 5000)) ^ (1 << np.random.default_rng(2).integers(0, 23, 5000))
    assert all(set(a) & set(b) for a, b in zip(k, N.golay_keys(flip)))  # two errors always meet


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    out = []
    for g in range(40):
        base = [word() for _ in range(r.choice([16, 40, 150]))]
        out.append((f"g{g}a", " ".join(base)))
        for v in "bcd":
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = word()
            if v == "d":
                cut = r.randrange(len(w))
                w = w[cut:] + w[:cut]
            out.append((f"g{g}{v}", "  ".join(w).upper() if v == "c" else " ".join(w)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = texts() + [("n1", None), ("e", ""), ("s", "too short"), (None, "x" * 200)]
    df = spark.createDataFrame([(i, t, 0.1, 1) for i, t in rows + rows[:5]], "id string, text string, sim double, uid int")
    links, members = N.near_duplicates(df)
    uid = {r["id"]: r["uid"] for r in members.collect()}
    norm = {i: "".join(c for c in t.lower() if c.isalnum()) for i, t in rows if i and t}
    part = sorted(i for i, t in norm.items() if len(t) >= 80)
    assert sorted(uid) == part
    got = {(r["uid_a"], r["uid_b"]): r["sim"] for r in links.collect()}
    want = {}
    for a in part:
        for b in part:
            if uid[a] < uid[b] and (j := jaccard(norm[a], norm[b])) >= 0.6:
                want[uid[a], uid[b]] = j
    clear = {k for k, j in want.items() if j >= 0.64}
    assert clear <= set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_copies_cost_nothing(spark):
    t = "one text that is long enough to take part in the comparison of texts with each other, surely it is and will be"
    df = spark.createDataFrame([(f"i{k}", t if k % 2 else t.upper() + "!") for k in range(300)], "id string, text string")
    links, members = N.near_duplicates(df)
    assert links.count() == 0 and members.select("uid").distinct().count() == 1 and members.count() == 300


def test_empty(spark):
    links, members = N.near_duplicates(spark.createDataFrame([], "id string, text string"))
    assert links.count() == members.count() == 0


def test_blocks_of_hot_keys_and_no_sketch_change_nothing(spark):
    r = random.Random(3)
    rows = texts()[:40]
    base = rows[0][1].split()
    for k in range(40):  # variants of one text: they share most keys
        w = base[:]
        w[r.randrange(len(w))] = f"variant{k}number"
        rows.append((f"v{k}", " ".join(w)))
    df = spark.createDataFrame(rows, "id string, text string")
    pairs = lambda **kw: {(r["uid_a"], r["uid_b"]) for r in N.near_duplicates(df, **kw)[0].collect()}
    whole = pairs()
    assert whole == pairs(block=4) == pairs(block=4, sigmas=None) and len(whole) > 300


def test_groups_are_components(spark):
    rows = texts() + [("n", None), ("copy", texts()[0][1].upper()), ("lone", "y" * 40 + "some other letters that nobody else has in a text of eighty characters at least")]
    df = spark.createDataFrame(rows + rows[:3], "id string, text string")
    links, members = N.near_duplicates(df)
    of, root = {}, {}
    for r in members.collect():
        of.setdefault(r["uid"], []).append(r["id"])
        root[r["uid"]] = r["uid"]

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    edges = [(r["uid_a"], r["uid_b"]) for r in links.collect()]
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    least = {}
    for u, ids in of.items():
        least[find(u)] = min([*ids, least.get(find(u), min(ids))])
    want = {(i, least[find(u)], sum(u in e for e in edges)) for u, ids in of.items() for i in ids}
    assert {tuple(r) for r in N.groups(df).collect()} == want
    assert N.groups(df.limit(0)).count() == 0


def test_long_chain_settles(spark):
    n = 60
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)], "uid_a string, uid_b string")
    assert {tuple(r) for r in N.components(chain).collect()} == {(f"{i:03}", "000") for i in range(n + 1)}
