"""Registered queries of sources, sinks and fitted models, each with SQL that says the same of the tables.

Files are written to the shared folder and read back.  What SQL cannot fit, it checks: power sums of eigenvalues,
residuals of normal equations, and single linkage by minimax paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parsing import parse_value
from .operators import calls as C, cluster, gblup, linalg, pca, pheno
from .plans import jobs
from .queries import E, L, MIDX, RIDX, SQL, STATS, _FLAGS, _GWAS_OUT, _IMPUTED, _METRICS, _ROUNDED_METRICS, _Z, _r, nearest_decimal, numeric_order, register
from .sources import files
from .sources.tables import calls_e, calls_l, cov_l, pheno_e, pheno_l
from .storage import shared_dir, stored


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, path: str, doubles: tuple[str, ...] = ()) -> DataFrame:
    table = spark.read.csv(path, header=True)
    return table.select(*[F.col(c).cast("double").alias(c) if c in doubles else F.col(c) for c in table.columns])


# Sources -------------------------------------------------------------------------------------------------------------


def _matrix(s: SparkSession, d: str, wide: int) -> DataFrame:
    calls, path = stored(calls_l(s, d), "matrix-calls"), _place(s)
    names = [r["marker"] for r in calls.select("marker").distinct().orderBy("marker").collect()]  # 200 of them
    files.write_csv(files.genotype_matrix(calls, names), path)
    return files.read_genotypes(s, path, "id", wide=wide).drop("row_idx", "marker_idx")


_GRID = f"with {L}, {STATS} select individual, marker, dosage from grid"
register("source_genotypes", _GRID)(lambda s, d: _matrix(s, d, files.WIDE))
register("source_genotypes_wide", _GRID)(lambda s, d: _matrix(s, d, 10))


def _pheno_file(s: SparkSession, d: str) -> str:
    path = _place(s)
    table = pheno_l(s, d).select("individual", F.lit("x").alias("other"), F.when(F.col("value") > 0, F.col("value")).alias("value"))
    files.write_csv(table, path)
    return path


register("source_phenotypes", f"with {L} select individual, {_r('value')} as value from pheno where value > 0")(
    lambda s, d: files.read_phenotypes(s, _pheno_file(s, d), "value").select("individual", "value")
)
register("sink_csv", f"with {L} select individual, 'x' as other, case when value > 0 then {_r('value')} end as value from pheno")(
    lambda s, d: _csv(s, _pheno_file(s, d), ("value",))
)


def _cov_file(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    files.write_csv(cov_l(s, d), path)
    return files.read_covariates(s, path)


register("source_covariates", f"with {L} select individual, c1, c2 from cov")(_cov_file)


def _calls_file(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    files.write_parquet(calls_e(s, d), path)
    return files.read_calls(s, path)


register("source_calls", f"with {E} select individual, marker, dosage from calls")(_calls_file)


def _cells(s: SparkSession, d: str) -> DataFrame:
    key, text = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    cell = F.when(key % 5 == 0, F.lit(" \t")).when(key % 5 == 1, F.lit("NaN")).when(key % 5 == 2, F.concat(F.lit(" "), text, F.lit("\t"))).when(key % 5 == 3, text)
    return s.read.parquet(f"{d}/customer.parquet").select(key.alias("c_custkey"), parse_value(cell).alias("value"))


register("source_cells", f"select c_custkey, case when c_custkey % 5 in (2, 3) then {_r('cast(c_acctbal as double)')} end as value from customer")(_cells)
register("pheno_align", f"with {L} select individual, {_r('value')} as value from pheno where individual in (select individual from calls where dosage = 2 and marker = 'M7')")(
    lambda s, d: pheno.align(pheno_l(s, d).withColumn("row_idx", F.lit(0)), calls_l(s, d).where("dosage = 2 and marker = 'M7'"))
)

# Sinks ---------------------------------------------------------------------------------------------------------------

_METRIC_COLUMNS = ("call_rate", "maf", "heterozygosity", "hwe_pvalue")


def _qc(s: SparkSession, d: str) -> str:
    path = _place(s)
    jobs.run_qc(calls_l(s, d), path, maf=0.05, hwe_p=1e-3)
    return path


register("sink_qc", f"with {L}, {_METRICS} select marker, {_ROUNDED_METRICS} from metrics")(lambda s, d: _csv(s, f"{_qc(s, d)}/metrics", _METRIC_COLUMNS))


def _sink_matrix(s: SparkSession, d: str) -> DataFrame:
    """The kept genotypes as written and read back, with the places of individuals and markers in the file."""
    path = _place(s)
    jobs.run_qc(numeric_order(calls_l(s, d)), path, maf=0.05, hwe_p=1e-3)
    back = stored(files.read_genotypes(s, f"{path}/matrix", "id"), "matrix-back")
    return C.cells(back).join(C.individual_index(back), "individual").join(C.marker_index(back), "marker")


register("sink_matrix", f"""with {L}, {STATS}, {_METRICS}, {_FLAGS},
  ip as (select individual, row_number() over (order by cast(substr(individual, 2) as bigint)) - 1 row_idx from (select distinct individual from calls)),
  mp as (select marker, row_number() over (order by cast(substr(marker, 2) as bigint)) - 1 marker_idx from flags where not (fail_call_rate or fail_maf or fail_hwe))
  select individual, marker, dosage, row_idx, marker_idx from grid join ip using (individual) join mp using (marker)""")(_sink_matrix)  # fmt: skip


def _gwas(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    jobs.run_gwas(calls_l(s, d), pheno_l(s, d), path, min_call_rate=0.8)
    return _csv(s, f"{path}/gwas", ("effect", "se", "t", "pvalue", "n"))


register("sink_gwas", f"with {L}, {_IMPUTED} {_GWAS_OUT}")(_gwas)


def _pca(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    jobs.run_pca(s, calls_e(s, d), path, 10)
    points, shares = _csv(s, f"{path}/scores"), _csv(s, f"{path}/variance", ("explained_variance_ratio",))
    names = F.lit(",".join(points.columns)).alias("heading")
    return shares.agg(F.count("component").alias("components"), F.sum("explained_variance_ratio").alias("total")).select("*", F.lit(points.count()).cast("long").alias("individuals"), names)


register("sink_pca", f"with {E} select count(*) components, 1.0::double total, (select n from ni) individuals, 'individual,' || string_agg('PC' || k, ',' order by k) heading from range(1, 11) r(k)")(_pca)


def _pca_norms(s: SparkSession, d: str) -> DataFrame:
    """With all components, each individual's written scores have the length of its standardised calls."""
    path = _place(s)
    jobs.run_pca(s, calls_e(s, d), path, 1000)
    points, shares = _csv(s, f"{path}/scores"), _csv(s, f"{path}/variance", ("explained_variance_ratio",))
    names = [F.col(c).cast("double") for c in points.columns if c != "individual"]
    share = lambda k: F.round(F.sum(F.pow("explained_variance_ratio", F.lit(k))), 6).alias(f"share_{k}")
    told = points.select("individual", sum((c * c for c in names[1:]), names[0] * names[0]).alias("square"))
    return told.crossJoin(F.broadcast(shares.agg(share(1), share(2))))  # one row


def _gblup(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    jobs.run_gblup(calls_e(s, d), pheno_e(s, d), path, alpha=0.1, n_splits=5, seed=3)
    predictions = _csv(s, f"{path}/predictions", ("prediction",))
    folds = _csv(s, f"{path}/cross_validation").select(F.col("fold").cast("long"), F.col("n_test").cast("long").alias("n_test"))
    return folds.withColumn("predictions", predictions.agg(F.count("prediction").alias("n")).scalar())


register("sink_gblup", f"""with {E}, f as (select ntile(5) over (order by md5('3:' || individual), individual) - 1 fold from pheno)
  select fold, count(*) n_test, (select n from ni) predictions from f group by 1""")(_gblup)  # fmt: skip


def _gblup_values(s: SparkSession, d: str) -> DataFrame:
    """Of written predictions f + mean(y): (X X' (y - f) - alpha f) / n, which is 0 for ridge effects."""
    path, calls, y = _place(s), stored(calls_e(s, d), "gblup-calls"), pheno_e(s, d)
    jobs.run_gblup(calls, y, path, alpha=0.1, n_splits=2, seed=3)
    n = C.individuals(calls).count()
    f = _csv(s, f"{path}/predictions", ("prediction",)).join(y, "individual").withColumn("f", F.col("prediction") - y.agg(F.avg("value").alias("m")).scalar())
    std = F.sqrt(F.var_pop("dosage") * F.count("dosage") / (n - 1))
    stats = calls.groupBy("marker").agg(F.avg("dosage").alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("scale"))
    z = stored(calls.where("dosage is not null").join(stats, "marker").select("individual", "marker", ((F.col("dosage") - F.col("mean")) / F.col("scale")).alias("z")), "gblup-z")
    moved = z.join(f, "individual").groupBy("marker").agg(F.sum(F.col("z") * (F.col("value") - F.col("f"))).alias("t"))
    back = z.join(moved, "marker").groupBy("individual").agg(F.sum(F.col("z") * F.col("t")).alias("b"))
    return f.join(back, "individual").select("individual", F.round((F.col("b") - 0.1 * F.col("f")) / n, 5).alias("residual"))


register("sink_gblup_values", f"with {E} select distinct individual, 0.0::double residual from calls")(_gblup_values)


def _merge_lines(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    jobs.run_dendrogram(calls_l(s, d), path, "single")
    return _csv(s, f"{path}/merges", ("distance",)).withColumn("step", F.col("step").cast("long"))


def _merges(s: SparkSession, d: str) -> DataFrame:
    path = _place(s)
    jobs.run_dendrogram(calls_l(s, d), path, "single")
    found = _csv(s, f"{path}/merges", ("distance",)).withColumn("step", F.col("step").cast("long"))
    last = found.agg(F.count(F.lit(1)).alias("merges"), F.max_by(F.concat_ws(";", "left", "right"), "step").alias("last"))
    return last.select("merges", F.array_join(F.array_sort(F.split("last", ";")), ";").alias("members"))


register("sink_merges", f"with {L} select count(*) - 1 merges, string_agg(individual, ';' order by individual) members from (select distinct individual from calls)")(_merges)


def _admixture(s: SparkSession, d: str) -> str:
    path = _place(s)
    jobs.run_admixture(calls_e(s, d), path, 3, max_iter=1)
    return path


_PARTS = tuple(f"cluster_{i}" for i in (1, 2, 3))


def _proportions(s: SparkSession, d: str) -> DataFrame:
    table = _csv(s, f"{_admixture(s, d)}/proportions", _PARTS)
    return table.unpivot("individual", list(_PARTS), "cluster", "proportion").withColumn("cluster", F.replace(F.initcap("cluster"), F.lit("_"), F.lit(" ")))


register("sink_admixture", SQL["admixture_step"])(_proportions)
register("sink_alleles", SQL["admixture_alleles_step"])(lambda s, d: _csv(s, f"{_admixture(s, d)}/alleles", _PARTS))

# Components ----------------------------------------------------------------------------------------------------------


def _covariance(s: SparkSession, calls: DataFrame) -> DataFrame:
    """Both triangles of the covariance of standardised calls: (i, j, v)."""
    entries = C.standardized_entries(calls).join(C.marker_index(calls), "marker").select("individual", F.col("marker_idx").alias("m"), "z")
    upper = stored(linalg.covariance(entries, C.individuals(calls).count()), "residual-covariance")
    return upper.select(F.col("mi").alias("i"), F.col("mj").alias("j"), "v").union(upper.where("mi < mj").select("mj", "mi", "v"))


_BOTH = f"""{STATS}, {MIDX}, {_Z}, up as (select a.m i, b.m j, sum(a.z * b.z) / ((select n from ni) - 1) v from z a join z b on a.individual = b.individual and a.m <= b.m group by 1, 2),
cv as (select i, j, v from up union all select j, i, v from up where i < j)"""


register("sink_pca_values", f"""with {E}, {_BOTH}, tr as (select sum(v) t from cv where i = j)
  select individual, {_r('sum(coalesce(z, 0.0) ** 2)')} square, 1.0::double share_1, (select round(sum(v * v) / max(tr.t) ** 2, 6) from cv, tr) share_2
  from (select distinct individual from calls) left join z using (individual) group by 1""")(_pca_norms)  # fmt: skip


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    model = pca.fit_pca(calls_e(s, d), 1000)
    power = lambda k: F.round(F.sum(F.pow("eigenvalue", F.lit(k))), 4).alias(f"power_{k}")
    return model.components.agg(F.count("component").alias("components"), power(1), power(2), power(3))


register("pca_spectrum", f"""with {E}, {_BOTH} select (select count(*) from mi) components, round((select sum(v) from cv where i = j), 4) power_1, round((select sum(v * v) from cv), 4) power_2,
  round((select sum(a.v * b.v * c.v) from cv a join cv b on b.i = a.j join cv c on c.i = b.j and c.j = a.i), 4) power_3""")(_spectrum)  # fmt: skip


def _pca_residual(s: SparkSession, d: str) -> DataFrame:
    """|C v - l v|, |v| and the variance of the scores by l, of each component."""
    calls = calls_e(s, d)
    model, points = pca.fit_transform(s, calls, 10)
    at = lambda name: F.posexplode("loadings").alias("c", name)
    v = model.markers.select(F.col("marker_idx").alias("i"), at("v"))
    moved = _covariance(s, calls).join(v.select(F.col("i").alias("j"), "c", F.col("v").alias("w")), "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("cv"))
    size = model.components.select((F.col("component") - 1).alias("c"), "eigenvalue")
    gap = F.col("cv") - F.col("eigenvalue") * F.col("v")
    found = moved.join(v, ["i", "c"]).join(size, "c").groupBy("c").agg(F.sqrt(F.sum(gap * gap)).alias("residual"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    spread = points.select(F.posexplode("scores").alias("c", "score")).groupBy("c").agg(F.var_samp("score").alias("var")).join(size, "c")
    return found.join(spread, "c").select((F.col("c") + 1).cast("long").alias("component"), "residual", "norm", (F.col("var") / F.col("eigenvalue")).alias("score_variance"))


register("pca_residual", "select k as component, 0.0::double residual, 1.0::double norm, 1.0::double score_variance from range(1, 11) r(k)")(_pca_residual)

# Prediction ----------------------------------------------------------------------------------------------------------


def _ridge_residual(s: SparkSession, d: str) -> DataFrame:
    """(X'X + alpha I) b - X'y of each marker, and the intercept."""
    calls, y = stored(calls_e(s, d), "residual-calls"), pheno_e(s, d)
    model = gblup.fit_gblup(calls, y, alpha=0.1)
    upper, right = gblup.normal_equations(calls, y)
    upper = stored(upper, "residual-xtx")
    both = upper.select("mi", "mj", "v").union(upper.where("mi < mj").select("mj", "mi", "v"))
    beta = model.markers.select(F.col("marker_idx").alias("mj"), "effect")
    moved = both.join(beta, "mj").groupBy(F.col("mi").alias("m")).agg(F.sum(F.col("v") * F.col("effect")).alias("xb"))
    told = moved.join(right, "m").join(model.markers.select(F.col("marker_idx").alias("m"), "marker", "effect"), "m")
    return told.select("marker", (F.col("xb") + 0.1 * F.col("effect") - F.col("v")).alias("residual"), F.lit(model.intercept).alias("intercept"))


register("gblup_residual", f"with {E} select distinct marker, 0.0::double residual, (select {_r('avg(value)')} from pheno where individual in (select individual from calls)) intercept from calls")(_ridge_residual)


def _refits(s: SparkSession, d: str) -> DataFrame:
    """The largest difference between cross-validation's predictions and those of a fit without the fold."""
    calls, y = stored(calls_e(s, d), "refit-calls"), pheno_e(s, d)
    _, predictions = gblup.cross_validate(calls, y, n_splits=2, alpha=0.1, seed=7)
    grid = stored(C.imputed_calls(calls), "refit-grid")
    out = []
    for fold in (0, 1):
        own = predictions.where(F.col("fold") == fold)
        model = gblup.fit_gblup(grid.join(own.select("individual"), "individual", "left_anti"), y, alpha=0.1)
        again = gblup.predict(grid.join(own.select("individual"), "individual", "left_semi"), model.markers, model.intercept)
        both = own.join(again.withColumnRenamed("prediction", "again"), "individual")
        out.append(both.agg(F.lit(fold).cast("long").alias("fold"), F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("prediction") - F.col("again"))).alias("difference")))
    return out[0].union(out[1])


register("gblup_cv_refits", f"""with {E}, f as (select ntile(2) over (order by md5('7:' || individual), individual) - 1 fold from pheno)
  select fold, count(*) n, 0.0::double difference from f group by 1""")(_refits)  # fmt: skip

# Trees ---------------------------------------------------------------------------------------------------------------

#: Single linkage in SQL: heights are minimax path lengths, found by doubling paths up to 128 steps (sf0.01 has 100
#: individuals); a cluster is what lies within a height of a leaf.
_DOUBLED = ",\n".join(
    f"d{k + 1} as (select x.a, y.b, min(greatest(x.d, y.d)) d from d{k} x join d{k} y on x.b = y.a group by 1, 2)" for k in range(7)
)
_SINGLE = f"""with {L}, {STATS}, {RIDX}, zz as (select r, marker, (coalesce(dosage, mean) - mean) / std z from grid join ri using (individual)),
pd as (select a.r a, b.r b, sqrt(sum((a.z - b.z) ** 2)) d from zz a join zz b on a.marker = b.marker and a.r < b.r group by 1, 2),
d0 as (select a, b, d from pd union all select b, a, d from pd union all select r, r, 0.0 from ri),
{_DOUBLED},
nn as (select count(*) n from ri), mm as (select a, b, d from d7 where a != b),
hs as (select d h, row_number() over (order by d) - 1 step from (select distinct d from mm)),
mem as (select distinct p.d h, m.b leaf from mm p join d7 m on m.a = p.a and m.d <= p.d),
kid as (select mem.h, leaf, coalesce((select n from nn) + max(hs.step), leaf) id from mem left join mm on mm.a = leaf and mm.d < mem.h left join hs on hs.h = mm.d group by 1, 2),
side as (select h, id, count(*) size, row_number() over (partition by h order by id) - 1 k from kid group by 1, 2),
pos as (select leaf, cast(coalesce(sum(l.size), 0) as bigint) pos from ri left join kid on kid.leaf = ri.r
  left join side s on s.h = kid.h and s.id = kid.id and s.k = 1 left join side l on l.h = s.h and l.k = 0 where leaf is not null group by 1),
sp as (select id, min(pos) lo, max(pos) hi, avg(pos) mid from (select distinct id, leaf from kid) join pos using (leaf) group by 1),
ht as (select (select n from nn) + step id, h from hs union all select r, 0.0 from ri),
b as (select hs.step, hs.h dd, l.lo ll, l.hi lh, l.mid lm, lt.h ld, r.lo rl, r.hi rh, r.mid rm, rt.h rd from hs
  join side s0 on s0.h = hs.h and s0.k = 0 join side s1 on s1.h = hs.h and s1.k = 1
  join sp l on l.id = s0.id join sp r on r.id = s1.id join ht lt on lt.id = s0.id join ht rt on rt.id = s1.id)"""


def _tree(s: SparkSession, d: str, linkage: str = "single") -> tuple[DataFrame, int]:
    calls = stored(calls_l(s, d), "tree-calls")
    n = C.individuals(calls).count()
    return stored(cluster.dendrogram(calls, linkage), "tree-merges"), n


register("dendrogram_single", f"{_SINGLE} select a, b, {_r('d')} height from mm where a < b", exact=True)(
    lambda s, d: cluster.cophenetic(*_tree(s, d)).select("a", "b", nearest_decimal("height"))
)


def _members(s: SparkSession, d: str) -> DataFrame:
    merges, n = _tree(s, d)
    told = F.broadcast(merges.select("new_id", "step", nearest_decimal("distance")))
    return cluster.members(merges, n).join(told, F.col("id") == F.col("new_id")).select("step", "leaf", "distance")


register("dendrogram_members", f"{_SINGLE} select step, leaf, {_r('mem.h')} distance from mem join hs on hs.h = mem.h", exact=True)(_members)
register("dendrogram_leaf_order", f"{_SINGLE} select leaf, pos as position from pos")(lambda s, d: cluster.leaf_order(*_tree(s, d)))
_SEGMENTS = [("ll", "ld", "lh", "ld"), ("rl", "rd", "rh", "rd"), ("lm", "dd", "rm", "dd"), ("lm", "ld", "lm", "dd"), ("rm", "rd", "rm", "dd")]
_LINES = " union all ".join(
    f"select step, cast({k} as int) segment, {', '.join(f'{_r(f"cast({c} as double)")} {name}' for c, name in zip(line, ('x1', 'y1', 'x2', 'y2'), strict=True))} from b" for k, line in enumerate(_SEGMENTS)
)
register("sink_merges_values", f"""{_SINGLE}, nm as (select h, id, string_agg(individual, ';' order by individual) names from kid join ri on ri.r = kid.leaf group by 1, 2)
  select hs.step, l.names as left, r.names as right, {_r('hs.h')} distance from hs join side s0 on s0.h = hs.h and s0.k = 0 join side s1 on s1.h = hs.h and s1.k = 1
  join nm l on l.h = hs.h and l.id = s0.id join nm r on r.h = hs.h and r.id = s1.id""")(_merge_lines)  # fmt: skip
register("dendrogram_segments", f"{_SINGLE} {_LINES}")(lambda s, d: cluster.segments(*_tree(s, d)))


def _heights(s: SparkSession, d: str, linkage: str, of) -> DataFrame:
    """Of each merge: the pairs it joins, and its height less what the linkage makes of their distances."""
    merges, n = _tree(s, d, linkage)
    x = cluster.matrix(calls_l(s, d))[0]
    if x is not None:
        told = cluster.joined_distances(merges, x).join(F.broadcast(merges.select("step", "distance")), "step")
        joined = told.select("pairs", (F.col("distance") - F.col({"average": "mean", "complete": "high"}[linkage])).alias("difference"))
    else:
        pairs = cluster.pairwise_distances(calls_l(s, d))
        joined = cluster.cophenetic(merges, n).join(pairs, ["a", "b"]).groupBy("step").agg(F.count(F.lit(1)).alias("pairs"), (F.max("height") - of("distance")).alias("difference"))
    both = joined.agg(F.count(F.lit(1)).alias("merges"), F.sum("pairs").alias("pairs"), F.max(F.abs("difference")).alias("difference"))
    falls = merges.select("step", "distance").join(merges.select((F.col("step") + 1).alias("step"), F.col("distance").alias("before")), "step").where("distance < before")
    return both.withColumn("falls", falls.agg(F.count(F.lit(1)).alias("n")).scalar())


for _name, _of in (("average", F.avg), ("complete", F.max)):
    register(f"dendrogram_{_name}_heights", f"with {L}, {RIDX} select count(*) - 1 merges, cast(count(*) * (count(*) - 1) / 2 as bigint) pairs, 0.0::double difference, 0::bigint falls from ri")(
        lambda s, d, name=_name, of=_of: _heights(s, d, name, of)
    )


def _least_by_pairs(merges: DataFrame, n: int, pairs: DataFrame, of) -> DataFrame:
    """(step, least) as ``cluster.least_linkages``, from a table of pairs."""
    ends = merges.select(F.col("left_id").alias("id"), "step").union(merges.select(F.col("right_id").alias("id"), "step"))
    inside = cluster.members(merges, n).join(ends, "id")  # the root never ends
    alive = inside.select("leaf", "id", F.explode(F.sequence(F.greatest(F.col("id") - n + 1, F.lit(0)), "step")).alias("step"))
    alive = stored(alive, "tree-alive")
    x, y = (alive.select(F.col("leaf").alias(c), F.col("id").alias(f"{c}_id"), "step") for c in "ab")
    apart = pairs.join(x, "a").join(y, ["b", "step"]).where("a_id != b_id")
    linked = apart.groupBy("step", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).agg(of("distance").alias("d"))
    return linked.groupBy("step").agg(F.min("d").alias("least"))


def _nearest(s: SparkSession, d: str, linkage: str, of) -> DataFrame:
    """The steps, and the most by which a merge's height differs from the least linkage of all clusters then alive."""
    merges, n = _tree(s, d, linkage)
    x = cluster.matrix(calls_l(s, d))[0]
    if x is not None:
        least = cluster.least_linkages(merges, x, linkage).join(F.broadcast(merges.select("step", "distance")), "step")
    else:
        least = _least_by_pairs(merges, n, cluster.pairwise_distances(calls_l(s, d)), of).join(merges.select("step", "distance"), "step")
    return least.agg(F.count(F.lit(1)).alias("merges"), F.max(F.abs(F.col("least") - F.col("distance"))).alias("difference"))


for _name, _of in (("average", F.avg), ("complete", F.max)):
    register(f"dendrogram_{_name}_nearest", f"with {L}, {RIDX} select count(*) - 1 merges, 0.0::double difference from ri")(
        lambda s, d, name=_name, of=_of: _nearest(s, d, name, of)
    )
