import numpy as np
import pytest

from genospark.functions.tails import t_two_tailed
from genospark.operators import admixture, cluster, gblup, linalg, pca, plotdata
from genospark.operators.gwas import dropped_individuals, gwas


def by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize(("t", "df", "p"), [(3.7148351242, 3, 0.0339279381), (4.6615618338, 1, 0.1345290149), (3.007, 20, 0.0069652), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert t_two_tailed(np.array([t]), np.array([df]))[0] == pytest.approx(p, abs=5e-8)


def test_t_tail_at_many_degrees_of_freedom():
    assert t_two_tailed(np.array([1.959963985]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-6)


GWAS = {
    (False, True): {"M1": (1.15, 0.3095695937, 3.7148351242, 0.0339279381, 5), "M2": (-0.8, 0.7334848328, -1.0906837663, 0.3551776675, 5),
                    "M3": (-1.25, 0.4801041554, -2.6036017102, 0.0801261519, 5), "M4": (0.1857142857, 0.7246861859, 0.2562685606, 0.8143118942, 5)},
    (False, False): {"M2": (-0.8, 0.6652067348, -1.2026336448, 0.3521789359, 4)},
    (True, True): {"M1": (1.20625, 0.5787580993, 2.0842040940, 0.2847962957, 5), "M2": (-2.575, 0.7275816105, -3.5391218836, 0.1753106166, 5),
                   "M3": (-1.85, 0.3968626967, -4.6615618338, 0.1345290149, 5), "M4": (0.1625, 1.8850978091, 0.0862024237, 0.9452571604, 5)},
}


@pytest.mark.parametrize(("cov", "impute"), GWAS)
def test_gwas_golden(calls, phenotypes, covariates, cov, impute):
    found = by(gwas(calls, phenotypes, covariates if cov else None, 0.0, impute), "marker")
    for marker, values in GWAS[cov, impute].items():
        assert tuple(found[marker][1:6]) == pytest.approx(values, abs=1e-8)
        assert found[marker]["status"] == "ok"


def test_gwas_statuses(spark, calls, phenotypes, covariates):
    found = by(gwas(calls, phenotypes, covariates, 0.0, impute=False), "marker")
    assert found["M2"]["status"] == "insufficient" and found["M2"]["pvalue"] is None
    flat = spark.createDataFrame([(f"I{i}", "flat", 1.0) for i in range(1, 6)], "individual string, marker string, dosage double")
    assert by(gwas(flat, phenotypes), "marker")["flat"]["status"] == "singular"
    assert set(by(gwas(calls, phenotypes, min_call_rate=0.9), "marker")) == {"M1", "M3", "M4"}
    assert dropped_individuals(calls, phenotypes, covariates.where("individual != 'I2'")).collect()[0][0] == "I2"


def test_gwas_perfect_fit_has_p_one(spark):
    rows = [(f"I{i}", "m", float(i % 3)) for i in range(6)]
    calls = spark.createDataFrame(rows, "individual string, marker string, dosage double")
    y = spark.createDataFrame([(i, 2.0 * d + 1) for i, _, d in rows], "individual string, value double")
    r = by(gwas(calls, y), "marker")["m"]
    assert (r["effect"], r["se"], r["t"], r["pvalue"]) == pytest.approx((2.0, 0.0, 0.0, 1.0))


def test_pca_golden(spark, calls):
    model, points = pca.fit_transform(spark, calls, 2)
    values = [r["eigenvalue"] for r in model.components.orderBy("component").collect()]
    assert values == pytest.approx([1.9366990764, 1.4080521267])
    ratio = [r["ratio"] for r in pca.explained_variance(model.components).orderBy("component").collect()]
    assert ratio == pytest.approx([0.5790263487, 0.4209736513])
    found = by(points, "individual")
    assert found["I1"]["scores"] == pytest.approx([-1.8273188045, -0.6797558281])
    assert found["I4"]["scores"] == pytest.approx([-0.5158614074, 2.0503594868])
    label = by(plotdata.pca_points(points), "individual")["I1"]["label"]
    assert label == "I1<br>PC1: -1.827<br>PC2: -0.680"


def random_calls(spark, n, m, seed, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, m)).astype(float)
    x[rng.random((n, m)) < missing] = np.nan
    rows = [(f"I{i:03}", f"M{j:03}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(n) for j in range(m)]
    return x, spark.createDataFrame(rows, "individual string, marker string, dosage double")


def standardised(x):
    mean, std = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    return np.nan_to_num((x - mean) / np.where(std > 0, std, 1))


@pytest.mark.parametrize(("n", "m"), [(20, 6), (6, 20)])
def test_pca_of_either_side_equals_numpy(spark, n, m):
    x, calls = random_calls(spark, n, m, n)
    model, points = pca.fit_transform(spark, calls, 3)
    z = standardised(x)
    values, vectors = np.linalg.eigh(z.T @ z / (n - 1))
    assert [r["eigenvalue"] for r in model.components.orderBy("component").collect()] == pytest.approx(values[::-1][:3])
    v = vectors[:, ::-1][:, :3]
    expected = z @ (v * np.where(v.sum(0) < 0, -1, 1))
    found = np.array([r["scores"] for r in points.orderBy("individual").collect()])
    assert found == pytest.approx(expected, abs=1e-8)


def test_block_gram_equals_join(spark):
    x, calls = random_calls(spark, 30, 7, 5)
    z = standardised(x)
    entries = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(30) for j in range(7)], "r long, m int, z double")
    joined = {(r["mi"], r["mj"]): r["v"] for r in linalg.covariance(entries.withColumnRenamed("r", "individual"), 30).collect()}
    block = linalg.collect_gram(linalg.gram(linalg.sparse_rows(entries, "r", "m", "z"), 7), 7) / 29
    for (i, j), v in joined.items():
        assert block[i, j] == pytest.approx(v)


def test_gblup_golden(calls, phenotypes):
    for scale, expected in ((True, [10.6974095448, 11.8708874131, 13.1469805604, 11.1611138884, 12.7236085933]),
                            (False, [22.9201844736, 23.1096982450, 25.3748982946, 23.0483790192, 24.2007750392])):
        model = gblup.fit_gblup(calls, phenotypes, 0.1, scale)
        found = [r["prediction"] for r in gblup.predict(calls, model.markers, model.intercept).orderBy("individual").collect()]
        assert found == pytest.approx(expected)


def test_gblup_cross_validation_golden(spark, calls, phenotypes):
    folds = spark.createDataFrame([("I1", 0), ("I2", 0), ("I3", 1), ("I4", 1), ("I5", 2)], "individual string, fold int")
    metrics, predictions = gblup.cross_validate(calls, phenotypes, 3, 0.1, folds=folds)
    found = [r["prediction"] for r in predictions.orderBy("individual").collect()]
    assert found == pytest.approx([12.54139512, 13.07579049, 13.99672131, 11.65714286, 11.34735704], abs=1e-7)
    rows = metrics.orderBy("fold").collect()
    assert [r["rmse"] for r in rows] == pytest.approx([1.5999157998, 0.7753815076, 1.4526429647])
    assert [r["correlation"] for r in rows] == [pytest.approx(1), pytest.approx(1), None]


def test_dual_ridge_equals_primal(spark):
    x, calls = random_calls(spark, 6, 12, 8)
    y = spark.createDataFrame([(f"I{i:03}", float(i * i % 5)) for i in range(6)], "individual string, value double")
    model = gblup.fit_gblup(calls, y, 0.5)
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)
    std = filled.std(0, ddof=1)
    z = (filled - filled.mean(0)) / np.where(std > 0, std, 1)
    beta = np.linalg.solve(z.T @ z + 0.5 * np.eye(12), z.T @ np.array([i * i % 5 for i in range(6)], float))
    assert [r["effect"] for r in model.markers.orderBy("marker").collect()] == pytest.approx(beta)


def random_pheno(spark, n):
    return spark.createDataFrame([(f"I{i:03}", float(i * i % 7)) for i in range(n)], "individual string, value double")


@pytest.mark.parametrize(("n", "m"), [(9, 6), (6, 9)])
@pytest.mark.parametrize("scale", [True, False])
def test_cross_validation_equals_refits(spark, monkeypatch, n, m, scale):
    """By markers, by individuals and by conjugate gradients."""
    x, calls = random_calls(spark, n, m, 31)
    y = np.array([i * i % 7 for i in range(n)], float)
    folds = spark.createDataFrame([(f"I{i:03}", i % 3) for i in range(n)], "individual string, fold int")
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)
    expected = np.zeros(n)
    for f in range(3):
        train = np.arange(n) % 3 != f
        mean, std = (filled[train].mean(0), filled[train].std(0, ddof=1)) if scale else (np.zeros(m), np.ones(m))
        z = (filled - mean) / np.where(std > 0, std, 1)
        beta = np.linalg.solve(z[train].T @ z[train] + 0.5 * np.eye(m), z[train].T @ y[train])
        expected[~train] = y[train].mean() + z[~train] @ beta
    for side in (linalg.MAX_SIDE, 2):
        monkeypatch.setattr(linalg, "MAX_SIDE", side)
        _, predictions = gblup.cross_validate(calls, random_pheno(spark, n), 3, 0.5, scale, folds=folds)
        found = [r["prediction"] for r in predictions.orderBy("individual").collect()]
        assert found == pytest.approx(expected, abs=1e-6), side


@pytest.mark.parametrize(("n", "m"), [(12, 7), (7, 12)])
def test_large_sides_give_what_small_ones_do(spark, monkeypatch, n, m):
    _, calls = random_calls(spark, n, m, 17)
    small, points = pca.fit_transform(spark, calls, 3)
    ridge = gblup.fit_gblup(calls, random_pheno(spark, n), 0.5)
    monkeypatch.setattr(linalg, "MAX_SIDE", 4)
    large, again = pca.fit_transform(spark, calls, 3)
    values = lambda model: [r["eigenvalue"] for r in model.components.orderBy("component").collect()]
    assert values(large) == pytest.approx(values(small))
    scores = lambda df: np.array([r["scores"] for r in df.orderBy("individual").collect()])
    assert scores(again) == pytest.approx(scores(points), abs=1e-4)
    effects = lambda model: [r["effect"] for r in model.markers.orderBy("marker").collect()]
    assert effects(gblup.fit_gblup(calls, random_pheno(spark, n), 0.5)) == pytest.approx(effects(ridge), abs=1e-7)
    with pytest.raises(ValueError, match="over 4"):
        linalg.collect_gram(spark.createDataFrame([], "block int, v array<double>"), 5)


def test_too_many_individuals_for_a_tree_are_an_error(calls, monkeypatch):
    monkeypatch.setattr(cluster, "MAX_INDIVIDUALS", 4)
    with pytest.raises(ValueError, match="over 4"):
        cluster.dendrogram(calls)


def test_cophenetic_heights_are_minimax_paths(spark):
    x, calls = random_calls(spark, 9, 6, 4)
    d = np.sqrt(((standardised(x)[:, None] - standardised(x)[None]) ** 2).sum(2))
    for _ in range(4):
        d = np.minimum(d, np.maximum(d[:, :, None], d[None]).min(1))
    found = {(r["a"], r["b"]): r["height"] for r in cluster.cophenetic(cluster.dendrogram(calls, "single"), 9).collect()}
    assert len(found) == 36 and all(h == pytest.approx(d[a, b]) for (a, b), h in found.items())


MERGES = {
    "average": [("I2", "I5", 1.71130694), ("I1", "I2;I5", 2.18648886), ("I1;I2;I5", "I3", 2.77177123), ("I1;I2;I3;I5", "I4", 3.05345308)],
    "single": [("I2", "I5", 1.71130694), ("I1", "I2;I5", 1.85164020), ("I1;I2;I5", "I3", 2.20389266), ("I1;I2;I3;I5", "I4", 2.93987366)],
    "complete": [("I2", "I5", 1.71130694), ("I2;I5", "I3", 2.22003861), ("I1", "I4", 3.03550419), ("I1;I4", "I2;I3;I5", 3.89138242)],
}


@pytest.mark.parametrize("linkage", MERGES)
def test_dendrogram_golden(calls, linkage):
    found = cluster.named_merges(cluster.dendrogram(calls, linkage), calls).orderBy("step").collect()
    for row, (left, right, distance) in zip(found, MERGES[linkage], strict=True):
        assert {row["left"], row["right"]} == {left, right} and row["distance"] == pytest.approx(distance)


def test_unknown_linkage_is_an_error(calls):
    with pytest.raises(ValueError, match="linkage"):
        cluster.dendrogram(calls, "ward")


def test_tree_equals_brute_force(spark):
    x, calls = random_calls(spark, 14, 9, 21)
    z = standardised(x)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    groups, heights = [[i] for i in range(14)], []
    while len(groups) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(best[0])
        groups = [g for k, g in enumerate(groups) if k not in best[1:]] + [groups[best[1]] + groups[best[2]]]
    found = [r["distance"] for r in cluster.dendrogram(calls).orderBy("step").collect()]
    assert found == pytest.approx(heights)


def test_admixture_golden(calls):
    q, p, errors = admixture.fit_admixture(calls, 2, max_iter=1)
    assert errors == pytest.approx([13.5637946700])
    alleles = [r["p"] for r in p.orderBy("marker").collect()]
    assert np.array(alleles).T == pytest.approx(np.array([[0.03761772, 1.29897746, 0.78983431, 0.58633389], [0.54907872, 0.65803621, 0.40001827, 0.91838407]]), abs=1e-7)
    rows = np.array([r["q"] for r in q.orderBy("individual").collect()])
    assert rows[:, 0] == pytest.approx([0.00422836, 0.74347488, 0.85327573, 0.33023284, 0.15251959], abs=1e-7)
    moved = np.array([r["q"] for r in admixture.transform(calls, p, 2).orderBy("individual").collect()])
    assert moved[:, 0] == pytest.approx([0.60950989, 0.51125817, 0.36690440, 0.50367949, 0.37442696], abs=1e-7)


def test_admixture_rows_add_up_and_error_falls(calls):
    q, _, errors = admixture.fit_admixture(calls, 2, max_iter=23)
    assert all(sum(r["q"]) == pytest.approx(1) and min(r["q"]) >= 0 for r in q.collect())
    assert errors[-1] < errors[0]
    with pytest.raises(ValueError, match="at least 1"):
        admixture.fit_admixture(calls, 0)


def test_manhattan(spark):
    df = spark.createDataFrame([("M1", 0.05), ("M2", 1e-4), ("M3", 0.0)], "marker string, pvalue double")
    found = [tuple(r) for r in plotdata.manhattan(df).orderBy("position").collect()]
    assert [(a, b, pytest.approx(c)) for a, b, c in found] == [(0, "M1", 1.3010299957), (1, "M2", 4.0), (2, "M3", 0.0)]


def chain(spark, n):
    """The merges of a chain: each step adds the next leaf."""
    rows = [(k, k + 1 if k else 0, n + k - 1 if k else 1, n + k, float(k + 1), k + 2) for k in range(n - 1)]
    return spark.createDataFrame(rows, "step long, left_id long, right_id long, new_id long, distance double, size long")


def test_long_chain_is_walked_by_doubling(spark):
    n = 5000
    merges = chain(spark, n)
    found = {r["leaf"]: r["position"] for r in cluster.leaf_order(merges, n).collect()}
    # The last leaf to join stands first; the two of the first merge stand last.
    assert found == {0: n - 2, 1: n - 1} | {leaf: n - 1 - leaf for leaf in range(2, n)}
    inside = cluster.members(merges, n)
    assert inside.count() == n + sum(range(2, n + 1))
    top = cluster.segments(merges, n).where(f"step = {n - 2}").orderBy("segment").collect()
    assert tuple(top[1])[2:] == (1.0, n - 2.0, n - 1.0, n - 2.0) and tuple(top[2])[2:] == (0.0, n - 1.0, n / 2, n - 1.0)


@pytest.mark.parametrize(("linkage", "finish"), [("average", 256), ("average", 9), ("single", 256), ("complete", 256), ("complete", 9)])
@pytest.mark.parametrize("shape", ["line", "stars"])
def test_merges_equal_one_by_one_merging(spark, monkeypatch, linkage, finish, shape):
    monkeypatch.setattr(cluster, "FINISH", finish)
    rng = np.random.default_rng(len(shape))
    n = 30
    x = {
        "random": rng.random((n, 3)), "line": np.cumsum(1 + np.arange(n) ** 1.5 / 9)[:, None] if linkage == "single" else np.cumsum(rng.random(n))[:, None],
        "stars": np.repeat(rng.random((6, 2)) * 9, 5, 0) + rng.random((n, 2)) / 9,
    }[shape]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "a long, b long, distance double")
    value = {"average": np.mean, "single": np.min, "complete": np.max}[linkage]
    live, expected = {i: [i] for i in range(n)}, []
    for step in range(n - 1):
        height, a, b = min((value(d[np.ix_(live[a], live[b])]), a, b) for a in live for b in live if a < b)
        live[n + step] = live.pop(a) + live.pop(b)
        expected.append((step, a, b, n + step, pytest.approx(height), len(live[n + step])))
    assert [tuple(r) for r in cluster.merge_tree(pairs, n, linkage).orderBy("step").collect()] == expected


def test_trees_of_one_and_two(spark):
    none = spark.createDataFrame([], "a long, b long, distance double")
    for linkage in cluster.LINKAGES:
        assert cluster.merge_tree(none, 1, linkage).count() == 0
        two = spark.createDataFrame([(0, 1, 0.0)], "a long, b long, distance double")
        assert [tuple(r) for r in cluster.merge_tree(two, 2, linkage).collect()] == [(0, 0, 1, 2, 0.0, 2)]
    assert [tuple(r) for r in cluster.leaf_order(cluster.merge_tree(none, 1), 1).collect()] == [(0, 0)]


def test_ties_give_a_whole_tree(spark):
    n = 12
    pairs = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(n) for j in range(i + 1, n)], "a long, b long, distance double")
    for linkage in ("single", "complete"):
        merges = cluster.merge_tree(pairs, n, linkage)
        assert sorted(r["position"] for r in cluster.leaf_order(merges, n).collect()) == list(range(n))
        assert merges.where("size = 12").count() == 1 and merges.where("left_id >= new_id or right_id >= new_id").count() == 0


def test_pair_blocks_equal_numpy(spark):
    rng = np.random.default_rng(4)
    n, m = 300, 700  # two blocks of rows, three tiles of columns; some rows and blocks of columns are empty
    x = rng.random((n, m)) * (rng.random((n, m)) < 0.02)
    x[260:, :256] = 0
    i, j = np.nonzero(x)
    entries = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, v double")
    for kind, expected in (("product", x @ x.T), ("distance", ((x[:, None] - x[None]) ** 2).sum(2))):
        found = linalg.pairs_of(linalg.pair_blocks(entries, n, kind), n).toArrow()
        assert found.num_rows == n * (n + 1) // 2
        assert np.allclose(found["v"].to_numpy(), expected[found["a"].to_numpy(), found["b"].to_numpy()])
    assert linalg.pairs_of(linalg.pair_blocks(entries.where("false"), 3, "distance"), 3).count() == 6


def test_covariance_of_many_markers_by_tiles(spark):
    """20,000 markers of 12 individuals: the squares of all covariances add up to those of the individuals' products."""
    n, m = 12, 20_000
    z = spark.range(n * m).selectExpr(f"id div {m} as individual", f"id % {m} as m", f"cast((id * 7919) % 101 - 50 as double) / 50 as z")
    blocks = linalg.covariance_blocks(z, n, m)
    own = "aggregate(v, 0D, (s, x) -> s + x * x)"
    found = blocks.selectExpr(f"if(p = q, 1, 2) * {own} as s", "p").agg({"s": "sum", "p": "count"}).first()
    x = ((np.arange(n * m) * 7919) % 101 - 50).reshape(n, m) / 50
    assert found["count(p)"] == 79 * 80 // 2 and found["sum(s)"] == pytest.approx((((x @ x.T) / (n - 1)) ** 2).sum())


def test_heavy_inner_index_is_dealt_out(spark):
    rng = np.random.default_rng(2)
    a = {(int(i), 0): 1.0 + i % 3 for i in range(400)} | {(int(i), int(j)): 2.0 for i, j in rng.integers(1, 300, (400, 2))}
    b = {(0, int(j)): 1.0 + j % 5 for j in range(400)} | {(int(i), int(j)): 3.0 for i, j in rng.integers(1, 300, (400, 2))}
    table = lambda t: spark.createDataFrame([(*k, v) for k, v in t.items()], "i long, j long, v double")
    x, y = np.zeros((400, 300)), np.zeros((300, 400))
    for t, into in ((a, x), (b, y)):
        for k, v in t.items():
            into[k] = v
    found = {(r["i"], r["j"]): r["v"] for r in linalg.matmul(table(a), table(b)).collect()}
    whole = x @ y
    assert found == {(int(i), int(j)): pytest.approx(whole[i, j]) for i, j in zip(*np.nonzero(whole), strict=True)}
    # The index of half of both tables makes 160,000 products; no key of the join has over a thirty-second of them, twice the mean.
    keys = linalg.dealt_products(table(a), table(b)).groupBy("j", "x", "y").count().where("j = 0").toPandas()["count"]
    assert keys.sum() == 160_000 and keys.max() < 160_000 / 32


def test_admixture_equals_plain_iterations_to_the_end(spark, monkeypatch):
    x, calls = random_calls(spark, 25, 12, 6, missing=0.3)
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    i, k = np.meshgrid(np.arange(25), np.arange(3), indexing="ij")
    q = admixture.start_value(i, k, 0)
    q, h, errors = q / q.sum(1, keepdims=True), admixture.start_value(*np.meshgrid(np.arange(12), np.arange(3)), 1), []
    while len(errors) < 2 or abs(errors[-2] - errors[-1]) >= 0.3:
        h = np.maximum(1e-9, h * (q.T @ x) / np.maximum(q.T @ q @ h, 1e-9))
        q = np.maximum(1e-9, q * (x @ h.T) / np.maximum(q @ (h @ h.T), 1e-9))
        q /= q.sum(1, keepdims=True)
        errors.append(((x - q @ h) ** 2).sum())
    for few, pending in ((16 << 20, 64 << 20), (0, 1)):  # sums by the driver; by Spark, Q written at each iteration
        monkeypatch.setattr(admixture, "FEW_BYTES", few)
        monkeypatch.setattr(admixture, "PENDING_BYTES", pending)
        found, p, told = admixture.fit_admixture(calls, 3, tol=0.3)
        assert told == pytest.approx(errors)
        assert np.array([r["q"] for r in found.orderBy("individual").collect()]) == pytest.approx(q, abs=1e-9)
        assert np.array([r["p"] for r in p.orderBy("marker").collect()]).T == pytest.approx(h, abs=1e-9)
    monkeypatch.setattr(admixture, "MAX_BROADCAST", 200)
    with pytest.raises(ValueError, match="over 200 bytes"):
        admixture.fit_admixture(calls, 3)


def test_solvers_raise_when_they_run_out_of_passes():
    rng = np.random.default_rng(1)
    a = rng.random((40, 40))
    g = a @ a.T
    right = rng.random((40, 3))
    assert linalg.solve_ridge(lambda p: g @ p, right, 0.5) == pytest.approx(np.linalg.solve(g + 0.5 * np.eye(40), right), abs=1e-6)
    with pytest.raises(linalg.NotConverged, match="ridge"):
        linalg.solve_ridge(lambda p: g @ p, right, 1e-9, most=3)


def test_krylov_space_of_a_large_side(spark, monkeypatch):
    """A slowly falling spectrum, where plain iterations take hundreds of passes."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 90)) * np.linspace(1, 2, 90)
    rows = spark.createDataFrame([(0, list(range(90)), r.tolist(), 0.0) for r in x], "key int, idx array<int>, v array<double>, fill double").cache()
    values, vectors = np.linalg.eigh(x.T @ x)
    monkeypatch.setattr(linalg, "MAX_SIDE", 8)
    passes = []
    times = linalg.gram_times
    monkeypatch.setattr(linalg, "gram_times", lambda *a: passes.append(1) or times(*a))
    found, turned, gap = linalg.top_eigenpairs(rows, 90, 3)
    assert found == pytest.approx(values[::-1][:3]) and gap.max() <= 1e-8 and len(passes) <= 25
    assert np.abs((turned * vectors[:, ::-1][:, :3]).sum(0)) == pytest.approx(np.ones(3), abs=1e-6)
    with pytest.raises(linalg.NotConverged, match="eigenvectors"):
        linalg.top_eigenpairs(rows, 90, 3, most=2)


def test_passes_of_cross_validation_do_not_grow_with_folds(spark, monkeypatch):
    _, calls = random_calls(spark, 12, 7, 3)
    monkeypatch.setattr(linalg, "MAX_SIDE", 2)
    passes, times = [], gblup.gram_times
    monkeypatch.setattr(gblup, "gram_times", lambda *a, **k: passes.append(1) or times(*a, **k))
    counts = []
    for folds in (2, 6):
        passes.clear()
        gblup.cross_validate(calls, random_pheno(spark, 12), folds, 0.5)
        counts.append(len(passes))
    assert max(counts) <= 12
