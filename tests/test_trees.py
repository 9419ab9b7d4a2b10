import numpy as np
import pytest
from test_models import random_calls, standardised

from genospark.operators import cluster, nearest


def points(n, doubled=()):
    x = np.random.default_rng(n).random((n, 12))
    for i, j in doubled:
        x[i] = x[j]
    return x


@pytest.mark.parametrize(("linkage", "doubled"), [("complete", ((90, 3), (91, 3), (300, 3), (301, 8))), ("complete", ()), ("average", ()), ("single", ((90, 3), (91, 3)))])
def test_trees_from_lists_equal_those_of_a_whole_matrix(spark, monkeypatch, linkage, doubled):
    x = points(400, doubled)
    monkeypatch.setattr(nearest, "LAST", 30)
    found = nearest.merges_of(spark, x, linkage)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if linkage == "single":
        at, low, expected = np.zeros(400, bool), d[0].copy(), []
        at[0] = True
        for _ in range(399):
            j = np.where(at, np.inf, low).argmin()
            expected.append(low[j])
            at[j], low = True, np.minimum(low, d[j])
        assert found[4] == pytest.approx(np.sort(expected), abs=1e-9)
        return
    expected = nearest._numbered(400, *(np.array(c) for c in nearest.last_merges(d, np.ones(400), linkage)))
    for a, b in zip(found, expected, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_sixty_thousand_individuals_are_no_error():
    assert cluster._checked(60_000) == 60_000


def brute(x, merges):
    """By step: the pairs that it joins with their mean and largest distance, and the least linkages before it."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    live = {i: [i] for i in range(len(x))}
    for row in merges:
        apart = d[np.ix_(live[row["left_id"]], live[row["right_id"]])]
        ids = list(live)
        blocks = [d[np.ix_(live[a], live[b])] for k, a in enumerate(ids) for b in ids[:k]]
        yield apart.size, apart.mean(), apart.max(), min(b.mean() for b in blocks), min(b.max() for b in blocks)
        live[row["new_id"]] = live.pop(row["left_id"]) + live.pop(row["right_id"])


@pytest.mark.parametrize(("linkage", "subtree"), [("average", 256), ("complete", 256), ("average", 4), ("complete", 4)])
def test_checks_of_trees_equal_brute_force(spark, monkeypatch, linkage, subtree):
    monkeypatch.setattr(cluster, "_SUBTREE", subtree)
    x, calls = random_calls(spark, 24, 9, 5)
    z = standardised(x)
    merges = cluster.dendrogram(calls, linkage)
    matrix, _, n = cluster.matrix(calls)
    assert n == 24 and np.abs(np.sort(matrix.sum(1)) - np.sort(z.sum(1))).max() < 1e-9
    expected = list(brute(matrix, merges.orderBy("step").collect()))
    joined = cluster.joined_distances(merges, matrix).orderBy("step").collect()
    assert [tuple(r)[1:] for r in joined] == [pytest.approx(e[:3]) for e in expected]
    least = cluster.least_linkages(merges, matrix, linkage).orderBy("step").collect()
    assert [r["least"] for r in least] == pytest.approx([e[3 if linkage == "average" else 4] for e in expected])
    assert [r["distance"] for r in merges.orderBy("step").collect()] == pytest.approx([r["least"] for r in least])


def test_names_and_pairs_come_whole_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(cluster, "_TASK_ROWS", 20)
    _, calls = random_calls(spark, 24, 9, 6)
    merges = cluster.dendrogram(calls, "single")
    named = cluster.named_merges(merges, calls).coalesce(1).collect()
    assert [r["step"] for r in named] == list(range(23))
    last = ";".join(sorted(f"{named[-1]['left']};{named[-1]['right']}".split(";")))
    assert last == ";".join(sorted(r[0] for r in calls.select("individual").distinct().collect()))
    pairs = {(r["a"], r["b"]): r["distance"] for r in cluster.pairwise_distances(calls).collect()}
    assert set(pairs) == {(a, b) for a in range(24) for b in range(a + 1, 24)}
    heights = {(r["a"], r["b"]): r["height"] for r in cluster.cophenetic(merges, 24).collect()}
    assert set(heights) == set(pairs) and all(heights[p] <= pairs[p] + 1e-9 for p in pairs)
    size = {r["new_id"]: r["size"] for r in merges.collect()} | {i: 1 for i in range(24)}
    found = [tuple(r) for r in cluster.members(merges, 24).collect()]
    assert len(found) == len(set(found)) == sum(size.values())
