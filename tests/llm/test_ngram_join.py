import random
from collections import defaultdict

import numpy as np

from tribune.llm import ngram_join as nj
from tribune.llm.common import Words


def plain(rows, threshold=0.8):
    """n_links and group of every document, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, up = defaultdict(int), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], top(i)) for i in ids}


def plain_rows(rows):
    """n_links and the rows of its group, for each row."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    found = plain(numbered)
    groups = defaultdict(list)
    for k, (_, g) in found.items():
        groups[g].append(k)
    return {k: (n, groups[g]) for k, (n, g) in found.items()}


def test_repeated_rows_and_ids(spark):
    t, u, v = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    for rows in (
        [(1, t), (1, t), (2, t + " zz")],
        [(1, t), (1, u), (2, t + " zz"), (3, u)],
        [(5, t), (5, t + " zz"), (5, t + " yy"), (5, None), (5, None), (6, "")],
        [(9, u), (9, u), (9, u), (8, v), (8, t), (7, v), (7, v + " q"), (9, t)],
        [(i % 7, x) for i, (_, x) in enumerate(made(random.Random(4), 80))] + [(1, t)] * 40,
    ):
        docs = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, node int").repartition(3)
        expect = plain_rows(rows)
        got = nj.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.n_links, r.group_id) for r in got) == sorted((i, expect[k][0], min(rows[m][0] for m in expect[k][1])) for k, (i, _) in enumerate(rows))
        # of each group with words one text stays, once
        left = nj.filter_first(docs)
        assert left.columns == docs.columns
        stay = {r.node for r in left.collect()}
        for k, (_, group) in expect.items():
            if not (rows[k][1] or "").split():
                assert k in stay
            else:
                assert len(stay & set(group)) == 1 and all(rows[m][0] == min(rows[g][0] for g in group) for m in stay & set(group))


def made(rng, n=240):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.randrange(3, 200))] for _ in range(30)]
    rows = []
    for k in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = word()
        rows.append((k, " ".join(own) if rng.random() < 0.8 else "  ".join(own).upper()))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = made(random.Random(1)) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "w " * 60_000), (906, "w " * 60_001)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(5)
    expect = plain(rows)
    for small in (False, True):
        if small:  # many blocks: the same result
            monkeypatch.setattr(nj, "BUCKET_ROWS", 3)
            monkeypatch.setattr(nj, "GROUP_ROWS", 4)
        got = {r.doc_id: (r.n_links, r.group_id) for r in nj.near_duplicates(docs).collect()}
        assert got == expect
    kept = nj.filter_first(docs.unionByName(spark.createDataFrame([(None, "n", "y")], docs.schema)))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(i for i, (_, g) in expect.items() if i == g)
    assert kept.where("doc_id is null").count() == 1
    assert nj.near_duplicates(docs.limit(0)).count() == 0


def test_bayesian_pruning():
    steps = nj.least_equal()
    assert [n for n, _ in steps] == list(range(8, 65, 8)) and all(a[1] <= b[1] for a, b in zip(steps, steps[1:]))
    # the tail is that of the Beta distribution
    draw = np.random.default_rng(1).beta(5 + 1, 8 - 5 + 1, 400_000)
    assert abs(nj._beta_tail(5, 8, 0.8) - (draw >= 0.8).mean()) < 0.003
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 2**31, (300, 64)).astype(np.uint32)
    near = sketch.copy()
    near[:, rng.permutation(64)[:10]] = 0  # 54 of 64 equal
    both = np.concatenate([sketch, near])
    a = np.arange(300)
    assert len(nj.survivors(both, a, a + 300, steps)[0]) == 300
    assert len(nj.survivors(both, a, np.roll(a, 1), steps)[0]) == 0


def test_minhash_estimates():
    words = Words()
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(400)]
    other = base[:360] + [str(rng.random()) for _ in range(40)]
    values, counts = nj.shingles([" ".join(base), " ".join(other), ""], words)
    a, b = set(values[: counts[0]].tolist()), set(values[counts[0] : counts[0] + counts[1]].tolist())
    assert counts.tolist() == [396, 396, 0]
    signs = nj.minhash(values, counts)
    assert abs((signs[0] == signs[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_recall_at_the_threshold():
    # MinHash values of pairs at a similarity are independent coins
    rng = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.9995), (0.85, 0.99995)):
        equal = rng.random((200_000, 64)) < similarity
        met = equal.reshape(-1, nj.BANDS, nj.BAND_ROWS).all(axis=2).any(axis=1)
        stays = np.ones(len(equal), dtype=bool)
        for n, m in nj.least_equal():
            stays &= equal[:, :n].sum(axis=1) >= m
        assert (met & stays).mean() >= least


def test_a_chain_costs_its_pairs(spark, monkeypatch):
    # each document is similar to its neighbours only
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.group_id) for r in nj.near_duplicates(docs).collect()}
    expect = plain(rows)
    assert got == expect and {g for _, g in got.values()} == {0}
