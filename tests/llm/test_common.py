import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tribune.llm import common


def test_any_two_rows_of_a_key_meet_once(spark):
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 2).alias("key"))
    dealt = common.deal_blocks(rows, ["key"], F.col("id"), F.when(F.col("key") == 0, 5).otherwise(1)).collect()
    cells = {}
    for r in dealt:
        cells.setdefault((r.key, r.cell_i, r.cell_j), []).append(r)
    met = {}
    for (_, i, j), own in cells.items():
        for a in own:
            for b in own:
                if a.id < b.id and (i == j or a.block != b.block):
                    met[a.id, b.id] = met.get((a.id, b.id), 0) + 1
    assert met == {(a, b): 1 for a in range(60) for b in range(a + 1, 60) if (a - b) % 2 == 0}


def test_whole_groups_and_pairs():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 7]), pa.array(np.arange(500)[k : k + 7])], names=["k", "v"]) for k in range(0, 500, 7)]
    for rows in (1, 20, 10_000):
        seen, pairs = [], set()
        for table, offsets in common.whole_groups(iter(batches), ["k"], rows):
            k, v = table.column("k").to_numpy(), table.column("v").to_numpy()
            assert offsets[0] == 0 and offsets[-1] == len(k)
            for a, b in common.pairs_within(offsets, most=13):
                assert np.all(k[a] == k[b])
                pairs |= set(zip(v[a].tolist(), v[b].tolist()))
            seen += v.tolist()
        assert seen == list(range(500))
        assert pairs == {(a, b) for a in range(500) for b in range(a + 1, 500) if key[a] == key[b]}


def test_forest_and_bits():
    assert common.forest(6, np.array([0, 1, 4]), np.array([1, 2, 5])).tolist() == [0, 0, 0, 3, 4, 4]
    x, y = np.array([-1, 0, 5]), np.array([0, -(2**63), 5])
    assert common.differing_bits(x, y).tolist() == [64, 1, 0]


def test_connect_asks_only_what_is_open():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 60
        link = np.triu(rng.random((n, n)) < 0.03, 1)
        asked = []

        def linked(p, rows):
            asked.append(len(rows))
            return rows[link[p - 5, rows - 5]]

        label = common.connect(5, 5 + n, linked)
        assert (label == 5 + common.forest(n, *np.nonzero(link))).all()
    asked.clear()
    assert (common.connect(0, 500, lambda p, rows: (asked.append(len(rows)), rows)[1]) == 0).all() and sum(asked) == 499
