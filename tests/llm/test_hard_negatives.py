import math

import duckdb
import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    clean = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        clean.append((i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    anchors = {}
    for i, v, label in clean:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for a, (al, av) in anchors.items():
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(av, v)))), i, label) for i, v, label in clean if i != a)
        for p, pid, _ in [x for x in scored if x[2] == al][:5]:
            far = [(-n, nid) for n, nid, label in scored if label != al and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(a, pid, k + 1, nid, -p, n) for k, (n, nid) in enumerate(far)]
    return sorted(out)


def listed(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clusters(n, dims, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    of = rng.integers(0, 6, n)
    x = (centres[of] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, [float(c) for c in x[i]], int(of[i] if rng.random() < 0.5 else rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("tree, at_once, spread", [(1024, 8, 1.0), (4, 2, 0.05), (3, 1, 0.3)])
def test_as_brute_force(spark, tree, at_once, spread):
    rows = clusters(1500, 12, spread) + [(20_000 + i, [0.5] * 12, i % 3) for i in range(200)] + [(30_000, [0.0] * 12, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert listed(hn.mined(df, tree_anchors=tree, trees_at_once=at_once)) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, -2.0, 0.5]
    rows = [(0, v, 1), (0, [9.0, 0.0, 0.0], 2), (100, v, None), (200, None, 1), (300, [1.0, None, 2.0], 1), (400, [1.0, float("nan"), 0.0], 1), (500, [float("inf"), 0.0, 0.0], 1), (None, v, 1)]
    rows += [(600, [], 1), (601, [1.0], 1), (700, v, 3), (701, v, 3), (701, v, 3), (702, [0.4, -1.0, 0.1, 5.0], 4), (703, [0.5, -1.0, 0.1], 4), (704, [3.0e38, 0.0, 0.0], 3), (705, [1.0e38, 1.0, 0.0], 9), (14, [0.6, -1.2, 0.2], 2), (7, v, 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS rank", "1 AS slot", "2 AS corner")
    got = listed(hn.mined(df))
    assert got == brute(rows) and got
    assert hn.mined(df.limit(0)).count() == 0


def test_bounds_spare_scores(spark):
    rows = clusters(3000, 16, 0.02, 1)
    batch = hn.pa.RecordBatch.from_pydict({"vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "embedding": [r[1] for r in rows]})
    part = hn.rows_of(batch)
    some = part.ids % 100 == 0
    tree = hn.Tree.of(hn.Rows(part.ids[some], part.labels[some], part.x[some], part.norms[some]))
    best, met = [hn.Best(5) for _ in tree.ids], hn.Met()
    hn.positives_in(tree, best, part, met)
    windows = [hn.windows_of(list(zip(b.ids.tolist(), b.score.tolist()))) for b in best]
    hn.negatives_in(tree, windows, [[hn.Best(10) for _ in w] for w in windows], part, met)
    assert met.scored < 0.6 * met.bounded


def test_tree_spans_with_few_open_nodes():
    x = np.random.default_rng(4).normal(size=(300, 5)) * 256
    order, parent = hn.spanning_tree(np.floor(x))
    assert sorted(order.tolist()) == list(range(300)) and (parent == -1).sum() == 1
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    seen, total = {0}, 0.0
    while len(seen) < 300:
        i, j = min(((i, j) for i in seen for j in range(300) if j not in seen), key=lambda p: d[p])
        seen.add(j)
        total += d[i, j]
    assert math.isclose(sum(d[k, parent[k]] for k in range(300) if parent[k] >= 0), total, rel_tol=1e-3)


@pytest.mark.parametrize("name", ["op11_bloom_exact_dedup", "op13_anchor_tree_negatives"])
def test_whole_table_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
