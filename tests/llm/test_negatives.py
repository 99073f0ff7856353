"""Hard negatives against a brute-force search."""

import math
import random

import numpy as np
import pytest

from visitlens.llm import negatives
from visitlens.llm.negatives import Block, Rows, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, every=100, low=30, high=90):
    rows = []
    for i, v, label in data:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, tuple(math.floor(float(np.float32(x)) * 256) for x in v), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for anchor in sorted({r for r in rows if r[0] is not None and r[0] % every == 0}):
        i, a, label = anchor
        others = list(rows)
        others.remove(anchor)
        scored = [(sum(x * y for x, y in zip(a, v, strict=True)), j, m) for j, v, m in others if len(v) == len(a)]
        for ps, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            window = sorted((x for x in scored if x[2] != label and low * ps <= 100 * x[0] <= high * ps), key=order)[:10]
            out += [(i, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, data, parts=3, **how):
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in mine_negatives(df, **how).collect()), key=repr)


def vectors(seed, n=600, dim=8, tight=0.3):
    """Clusters, ties, copies, gaps, and labels of which one holds a third."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        v = [x + r.gauss(0, tight) for x in r.choice(centres)]
        if out and r.random() < 0.2:
            v = r.choice(out)[1]
        out.append((i, v, r.choice([1, 1, 1, 2, 3, 4, 5, 9])))
    return out


@pytest.mark.parametrize(("seed", "how"), [(1, {"every": 10}), (2, {"every": 4, "block": 20}), (3, {"every": 50, "low": -20, "high": 110})])
def test_equals_a_brute_force_search(spark, seed, how):
    data = vectors(seed)
    want = brute(data, **{k: v for k, v in how.items() if k != "block"})
    assert mined(spark, data, **how) == want and len(want) > 100


def test_bounds_spare_scores(monkeypatch):
    """In tight clusters most rows aren't scored again, and those that count are."""
    data = vectors(5, 4000, 16, 0.02)
    rows = Rows(np.array([d[0] for d in data]), np.array([d[2] for d in data]), np.floor(np.array([d[1] for d in data]) * 256))
    anchors = Rows(*(x[::40] for x in (rows.ids, rows.labels, rows.vectors)))
    block = Block.of(anchors)
    assert sorted(e[0] for e in block.edges) == list(range(100)) and {e[1] for e in block.edges} <= {-1, *range(100)}
    scored, scores = [], Rows.scores
    monkeypatch.setattr(Rows, "scores", lambda self, at, v: scored.append(len(self.vectors[at])) or scores(self, at, v))
    windows = [[(int(0.97 * (v**2).sum()), int(0.99 * (v**2).sum()))] for v in anchors.vectors]
    best = negatives.Best(block, windows, 10, same=False)
    best.meet(rows)
    assert sum(scored) < 0.5 * 100 * 4000
    for node in range(100):
        s = (rows.vectors @ anchors.vectors[node]).astype(int)
        low, high = windows[node][0]
        want = sorted((-x, i) for x, i, label in zip(s.tolist(), rows.ids.tolist(), rows.labels.tolist(), strict=True) if low <= x <= high and label != anchors.labels[node])[:10]
        assert list(zip((-best.held[node][0][0]).tolist(), best.held[node][0][1].tolist(), strict=True)) == want


def test_edges(spark):
    assert mined(spark, []) == []
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 1.0], 2), (None, [0.5, 0.5], 3), (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (1, [0.8, 0.8], 1), (2, [0.5, 0.5], None), (3, [], 2), (500, [], 3), (4, [1.0, 1.0, 1.0], 2), (1, [0.8, 0.8], 1)]
    want = brute(odd)
    assert mined(spark, odd) == want and any(r[1] is None for r in want) and any(r[3] is None for r in want)
    large = [(i, [3e9 * (i % 5 + 1), -2e9, 1.0], i % 3) for i in range(0, 300, 5)]
    assert mined(spark, large, every=25) == brute(large, every=25)
    alone = [(0, [1.0], 1), (100, [1.0], 2)]
    assert mined(spark, alone) == brute(alone) == []
    clash = spark.createDataFrame([(i, [1.0, float(i % 3)], i % 4, i, i, i) for i in range(120)], f"{SCHEMA}, node int, score long, id long")
    assert sorted((tuple(r) for r in mine_negatives(clash).collect()), key=repr) == brute([(i, [1.0, float(i % 3)], i % 4) for i in range(120)])
