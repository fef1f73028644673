import numpy as np
import pytest

from tribune.llm import lattice as la


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(2000, 8)) * 2
    own = la.decode(x)
    assert np.all((2 * own) % 2 == (2 * own[:, :1]) % 2) and np.all(own.sum(axis=1) % 2 == 0)
    far = ((x - own) ** 2).sum(axis=1)
    assert len(la.neighbours()) == 240 and np.allclose((la.neighbours() ** 2).sum(axis=1), 2)
    for v in la.neighbours():
        assert np.all(((x - own - v) ** 2).sum(axis=1) >= far - 1e-9)
    assert far.max() <= 1 + 1e-9  # covering radius


@pytest.mark.parametrize(("cosine", "least"), [(0.9, 0.95), (0.95, 0.999)])
@pytest.mark.parametrize("n", [5_000, 20_000, 1_000_000, 5_000_000, 50_000_000])
def test_recall_of_pairs(cosine, least, n):
    setting = la.setting_for(n)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000 if n < 100_000 else 800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    x, y = (la.cells(v, setting) for v in (a, b))
    met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any(axis=(1, 2))
    signs = ((a @ la._signs(64) > 0) != (b @ la._signs(64) > 0)).sum(axis=1) <= la.MOST_DIFFERENT
    assert (met & signs).mean() >= least


def test_meetings_stay_few(capsys):
    """How many others a random vector meets by chance does not grow with their number."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(80_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    meetings = {}
    for n in (5_000, 20_000, 80_000):
        setting = la.setting_for(n)
        own = np.concatenate([la.cells(vectors[k : k + 5000], setting._replace(probes=1))[:, :, 0] for k in range(0, n, 5000)])
        some = la.cells(vectors[:400], setting)
        found = 0
        for t in range(setting.tables):
            cells = np.sort(own[:, t])
            found += (np.searchsorted(cells, some[:, t], "right") - np.searchsorted(cells, some[:, t], "left")).sum() - len(some)
        meetings[n] = 2 * found / len(some)  # it is probed as often as it probes
    print("meetings a vector:", meetings)
    assert max(meetings.values()) <= 60, meetings


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    vectors = [c + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.25]) for c in centres for _ in range(rng.integers(1, 9))]
    vectors += [vectors[0]] * 3 + [v * 1000 for v in vectors[5:8]]
    rows = [(k, v.tolist(), "l") for k, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 0.0], [2.0, 0.1]]
    rows += [(n + k, v, None) for k, v in enumerate(odd)] + [(None, vectors[0].tolist(), "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string").repartition(4)
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    near = unit @ unit.T >= la.THRESHOLD
    np.fill_diagonal(near, False)
    reach = np.eye(n, dtype=bool) | near
    for _ in range(8):
        reach = reach @ reach
    expect = {k: (int(near[k].sum()), int(np.flatnonzero(reach[k])[0])) for k in range(n)} | {n + k: (0, n + k) for k in range(len(odd) - 2)} | {n + 6: (1, n + 6), n + 7: (1, n + 6), None: (0, None)}
    for small in (False, True):
        if small:
            monkeypatch.setattr(la, "CELL_ROWS", 5)
            monkeypatch.setattr(la, "GROUP_ROWS", 3)
        got = la.near_duplicates(df).collect()
        assert {r.vec_id: (r.n_links, r.group_id) for r in got} == expect
        assert len(got) == len(rows) and all(r.kept == (r.vec_id is not None and r.vec_id == r.group_id) for r in got)
    assert la.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(5)
    near = lambda v: (v + rng.normal(size=len(v)) * 0.02).tolist()
    short, long = rng.normal(size=8), rng.normal(size=12)
    rows = [(1, short.tolist()), (1, long.tolist()), (2, near(short)), (3, near(long)), (4, long.tolist())]
    got = la.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.group_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_a_chain_costs_its_pairs(spark):
    # each vector is near the next few only, all the way round a circle
    n = 2000
    angle = 2 * np.pi * np.arange(n) / n * 20
    x = np.stack([f(angle * k) for k in (1, 2, 3, 5) for f in (np.cos, np.sin)], axis=1) + 0.0
    got = {r.vec_id: (r.n_links, r.group_id) for r in la.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= la.THRESHOLD
    np.fill_diagonal(near, False)
    assert sum(g for g, _ in got.values()) >= 0.97 * near.sum()
    assert all(got[k][0] <= near[k].sum() for k in range(n))


def test_a_pair_has_one_first_cell():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + 0.2 * rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = la.cells(x)
    # the same cells whatever other vectors are there
    assert all((la.cells(x[k : k + n]) == keys[k : k + n]).all() for k, n in ((0, 1), (7, 30), (100, 300)))
    a, b = np.arange(200), np.arange(200, 400)
    first = la.first_cells(keys, a, b)
    assert (first == la.first_cells(keys, b, a)).all() and (first > 0).mean() > 0.9
    for k in range(200):
        met = [c for t in range(keys.shape[1]) for c in sorted(({keys[k, t, 0]} & set(keys[200 + k, t])) | ({keys[200 + k, t, 0]} & set(keys[k, t])))]
        assert first[k] == (met[0] if met else 0)
