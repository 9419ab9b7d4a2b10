"""The registered queries of the core library and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import admixture, calls as C, cluster, gblup, linalg, pca, pheno, plotdata, qc
from .operators.gwas import gwas
from .sources.tables import calls_e, calls_l, cov_l, pheno_e, pheno_l

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The same tables as ``sources.tables`` makes.
L = """
cell as (select l_suppkey ind, l_partkey % 200 m, sum(cast(l_quantity as bigint) * (l_linenumber + l_orderkey % 97)) s
         from lineitem group by 1, 2),
calls as (select 'I' || ind individual, 'M' || m marker,
  cast(case when (s*7+m)%101 < 5+(m*13)%90 then 1 else 0 end
     + case when ((s//101)*11+m*3)%101 < 5+(m*13)%90 then 1 else 0 end as double) dosage from cell),
ni as (select count(distinct individual) n from calls),
pheno as (select 'I' || s_suppkey individual, cast(s_acctbal as double) as value from supplier),
cov as (select 'I' || s_suppkey individual, cast(s_nationkey % 2 as double) c1, cast(s_nationkey % 5 as double) c2 from supplier)"""
E = """
ex as (select vec_id, label, embedding, unnest(embedding)::double x, unnest(range(len(embedding))) i from embeddings),
calls as (select 'V' || vec_id individual, 'E' || i marker,
  cast(case when abs(x) < 0.004 then null when x < -0.05 then 0 when x < 0.06 then 1 else 2 end as double) dosage from ex),
ni as (select count(distinct individual) n from calls),
pheno as (select 'V' || vec_id individual, 3.0 * embedding[1]::double - 2.0 * embedding[6]::double + 0.1 * label as value from embeddings)"""
STATS = """
st as (select marker, coalesce(avg(dosage), 0.0) mean,
  case when count(dosage) > 1 and stddev_samp(dosage) > 0 then stddev_samp(dosage) else 1.0 end std from calls group by marker),
grid as (select i.individual, st.marker, c.dosage, st.mean, st.std from (select distinct individual from calls) i
  cross join st left join calls c on c.individual = i.individual and c.marker = st.marker)"""
MIDX = "mi as (select marker, row_number() over (order by marker) - 1 idx from (select distinct marker from calls))"
RIDX = "ri as (select individual, row_number() over (order by individual) - 1 r from (select distinct individual from calls))"
#: erfc(sqrt(x / 2)) as a series.
ERFC = """case when {x} is null then null when {x} <= 0 then 1.0 else
  1 - list_sum(list_transform(range(0, 300), lambda k: exp(-({x})/2 + (2*k+1)*ln(sqrt(({x})/2)) - lgamma(k+1.5)))) end"""
#: Two-tailed t by the finite sums for odd and even degrees of freedom.
TTAIL = """case when {t} is null then null when cast({df} as bigint) % 2 = 1 then
  1 - 2/pi()*(atan(abs({t})/sqrt({df})) + case when {df} > 1 then sin(atan(abs({t})/sqrt({df}))) *
    coalesce(list_sum(list_transform(range(0, cast(({df}-1)/2 as bigint)), lambda k: exp((2*k+1)*ln(cos(atan(abs({t})/sqrt({df})))) + k*ln(4.0) + 2*lgamma(k+1.0) - lgamma(2*k+2.0)))), 0) else 0 end)
  else 1 - sin(atan(abs({t})/sqrt({df}))) *
    list_sum(list_transform(range(0, cast({df}/2 as bigint)), lambda k: exp(2*k*ln(cos(atan(abs({t})/sqrt({df})))) + lgamma(2*k+1.0) - k*ln(4.0) - 2*lgamma(k+1.0)))) end"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Computed doubles at ``digits`` places, without negative zeros."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def nearest_decimal(c: str, digits: int = 6):
    """A double of moderate size at ``digits`` places, half up: for tables of very many rows, as round() goes by decimals."""
    return (F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits).alias(c)


def register(name: str, sql: str | None = None, exact: bool = False):
    """Registers a query, whose doubles are rounded here unless it does so itself (``exact``)."""

    def add(query):
        QUERIES[name] = query if exact else lambda spark, d: rounded(query(spark, d))
        if sql:
            SQL[name] = sql
        return query

    return add


def _r(c: str) -> str:
    return f"round({c}, 6) + 0.0"


def numeric_order(calls: DataFrame) -> DataFrame:
    """Calls with places by the numbers in their names, which is not the order of the names: M2 comes before M10."""
    place = lambda c: F.substring(c, 2, 9).cast("long")
    return calls.withColumns({"row_idx": place("individual"), "marker_idx": place("marker")})


# Quality control -----------------------------------------------------------------------------------------------------

register("qc_allele_freq", f"with {L} select marker, {_r('sum(dosage) / (2.0 * count(dosage))')} frequency from calls group by 1")(
    lambda s, d: C.allele_frequencies(calls_l(s, d))
)
register("qc_maf", f"with {L} select marker, {_r('least(sum(dosage) / (2.0 * count(dosage)), 1 - sum(dosage) / (2.0 * count(dosage)))')} maf from calls group by 1")(
    lambda s, d: C.minor_allele_frequencies(calls_l(s, d))
)
register("qc_call_rate", f"with {L} select marker, {_r('count(dosage) / (select n from ni)')} call_rate from calls group by 1")(lambda s, d: C.call_rates(calls_l(s, d)))
register("qc_heterozygosity", f"with {L} select marker, {_r('count(*) filter (where dosage = 1) / count(dosage)')} heterozygosity from calls group by 1")(
    lambda s, d: C.heterozygosities(calls_l(s, d))
)
_METRICS = f"""
hw as (select marker, count(dosage) c, sum(dosage) / (2.0 * count(dosage)) f, count(*) filter (where dosage = 1) / count(dosage) het,
  count(*) filter (where round_even(dosage, 0) = 0) n0, count(*) filter (where round_even(dosage, 0) = 1) n1,
  count(*) filter (where round_even(dosage, 0) = 2) n2 from calls group by marker),
hx as (select *, n0 + n1 + n2 nn, (2.0 * n2 + n1) / (2.0 * (n0 + n1 + n2)) p from hw),
hy as (select *, case when (1-p)*(1-p)*nn = 0 then 0 else (n0 - (1-p)*(1-p)*nn)**2 / ((1-p)*(1-p)*nn) end
  + case when 2*p*(1-p)*nn = 0 then 0 else (n1 - 2*p*(1-p)*nn)**2 / (2*p*(1-p)*nn) end
  + case when p*p*nn = 0 then 0 else (n2 - p*p*nn)**2 / (p*p*nn) end chi2 from hx),
metrics as (select marker, c / (select n from ni) call_rate, least(f, 1 - f) maf, het heterozygosity, {ERFC.format(x='chi2')} hwe_pvalue from hy)"""
register("qc_hwe", f"with {L}, {_METRICS} select marker, {_r('hwe_pvalue')} hwe_pvalue from metrics")(lambda s, d: qc.compute_metrics(calls_l(s, d)).select("marker", "hwe_pvalue"))
_ROUNDED_METRICS = ", ".join(f"{_r(c)} {c}" for c in ("call_rate", "maf", "heterozygosity", "hwe_pvalue"))
register("qc_metrics", f"with {L}, {_METRICS} select marker, {_ROUNDED_METRICS} from metrics")(lambda s, d: qc.compute_metrics(calls_l(s, d)))
_FLAGS = """
flags as (select *, coalesce(call_rate < 0.95, false) fail_call_rate, coalesce(maf < 0.05, false) fail_maf, coalesce(hwe_pvalue < 0.001, false) fail_hwe from metrics)"""


def _recoded(s: SparkSession, d: str) -> DataFrame:
    """calls_l with the heterozygotes of odd markers recoded to 0, so that the Hardy-Weinberg filter has work."""
    odd = F.substring("marker", 2, 9).cast("int") % 2 == 1
    return calls_l(s, d).withColumn("dosage", F.when(odd & (F.col("dosage") == 1), 0.0).otherwise(F.col("dosage")))


_RECODE = L.replace("calls as (", "raw as (", 1).replace(
    "\nni as", "\ncalls as (select individual, marker, case when cast(substr(marker, 2) as int) % 2 = 1 and dosage = 1 then 0.0 else dosage end dosage from raw),\nni as"
)
register("qc_filter", f"with {_RECODE}, {_METRICS}, {_FLAGS} select marker, {_ROUNDED_METRICS}, fail_call_rate, fail_maf, fail_hwe, not (fail_call_rate or fail_maf or fail_hwe) keep from flags")(
    lambda s, d: qc.filter_markers(_recoded(s, d), maf=0.05, hwe_p=1e-3)
)
register("qc_failing", f"""with {_RECODE}, {_METRICS}, {_FLAGS} select marker, 'call_rate' test from flags where fail_call_rate
  union all select marker, 'maf' from flags where fail_maf union all select marker, 'hwe' from flags where fail_hwe""")(
    lambda s, d: qc.failing_markers(qc.filter_markers(_recoded(s, d), maf=0.05, hwe_p=1e-3))
)
register("qc_apply", f"""with {_RECODE}, {_METRICS}, {_FLAGS} select individual, marker, dosage from calls
  where marker in (select marker from flags where not (fail_call_rate or fail_maf or fail_hwe))""")(
    lambda s, d: qc.apply_filter(_recoded(s, d), qc.filter_markers(_recoded(s, d), maf=0.05, hwe_p=1e-3))
)

# Reshaping and joins -------------------------------------------------------------------------------------------------

register("column_stats", f"with {E}, {STATS} select marker, {_r('mean')} mean, {_r('std')} std from st")(lambda s, d: C.column_statistics(calls_e(s, d)))
register("imputed_calls", f"with {L}, {STATS} select individual, marker, {_r('coalesce(dosage, mean)')} dosage from grid")(lambda s, d: C.imputed_calls(calls_l(s, d)))
register("unimputed_grid", f"with {L}, {STATS} select individual, marker, dosage from grid")(lambda s, d: C.imputed_calls(calls_l(s, d), impute=False))
register("standardized_calls", f"with {L}, {STATS} select individual, marker, {_r('(coalesce(dosage, mean) - mean) / std')} z from grid")(lambda s, d: C.standardized_calls(calls_l(s, d)))
register("standardized_raw", f"with {L}, {STATS} select individual, marker, {_r('(coalesce(dosage, 0.0) - mean) / std')} z from grid")(
    lambda s, d: C.standardized_calls(calls_l(s, d), impute=False)
)
_ORDER = "wanted as (select 'M' || (x * 7 % 230) marker, x marker_idx from (select unnest(range(60)) x))"


def _wanted(s: SparkSession) -> DataFrame:
    return s.range(60).select(F.concat(F.lit("M"), (F.col("id") * 7 % 230).cast("string")).alias("marker"), F.col("id").alias("marker_idx"))


register("reorder_markers", f"""with {L}, {_ORDER} select i.individual, w.marker_idx, w.marker, c.dosage from (select distinct individual from calls) i
  cross join wanted w left join calls c on c.individual = i.individual and c.marker = w.marker""")(lambda s, d: C.reorder_markers(calls_l(s, d), _wanted(s)))  # fmt: skip
register("align_individuals", f"with {L} select c.* from calls c where individual in (select individual from pheno where value > 0)")(
    lambda s, d: C.align(calls_l(s, d), pheno_l(s, d).where("value > 0"))
)


def _repeated_pheno(s: SparkSession, d: str) -> DataFrame:
    """A value per order, several to a customer: duplicates by design."""
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("individual"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("row_idx"))


_REP = "rep as (select 'C' || o_custkey individual, cast(o_totalprice as double) as value, o_orderkey row_idx from orders), lastv as (select individual, arg_max(value, row_idx) as value from rep group by 1)"
register("pheno_last_wins", f"with {_REP} select individual, {_r('value')} as value from lastv")(lambda s, d: pheno.last_values(_repeated_pheno(s, d)))
register("pheno_subset", f"with {_REP}, wanted as (select 'C' || c_custkey individual from customer where c_acctbal > 0) select w.individual, {_r('value')} as value from wanted w join lastv using (individual)")(
    lambda s, d: pheno.subset(_repeated_pheno(s, d), s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("individual")))
)

# Phenotypes ----------------------------------------------------------------------------------------------------------

register("pheno_summary", f"""with {_REP}, o as (select value, row_number() over (order by value) - 1 pos, count(*) over () n from lastv)
  select count(*) as count, {_r('avg(value)')} mean, {_r('stddev_samp(value)')} std, {_r('min(value)')} min, {_r('max(value) filter (where pos = n // 4)')} q25,
  {_r('quantile_cont(value, 0.5)')} q50, {_r('max(value) filter (where pos = (3 * n) // 4)')} q75, {_r('max(value)')} max from o""")(
    lambda s, d: pheno.summary(pheno.last_values(_repeated_pheno(s, d)))
)
register("pheno_normalize", f"with {_REP} select individual, {_r('(value - (select avg(value) from lastv)) / (select stddev_samp(value) from lastv)')} z from lastv")(
    lambda s, d: pheno.normalize(pheno.last_values(_repeated_pheno(s, d)))
)
register("pheno_moments", f"with {_REP} select {_r('avg(value)')} mean, round(var_samp(value), 2) + 0.0 variance, {_r('stddev_samp(value)')} std from lastv")(
    lambda s, d: pheno.moments(pheno.last_values(_repeated_pheno(s, d)), "value").withColumn("variance", F.round("variance", 2))  # about 1e10: a double's last places
)
register("marker_pheno_corr", f"with {L} select marker, {_r('case when var_pop(dosage) > 0 and count(dosage) > 1 then corr(dosage, value) end')} r from calls join pheno using (individual) group by marker")(
    lambda s, d: pheno.marker_correlations(calls_l(s, d), pheno_l(s, d))
)
register("fold_assign", f"with {L} select individual, ntile(5) over (order by md5('3:' || individual), individual) - 1 fold from pheno")(
    lambda s, d: pheno.assign_folds(pheno_l(s, d).select("individual"), 5, seed=3)
)

# Association ---------------------------------------------------------------------------------------------------------

_SIMPLE = """
al as (select marker, dosage g, value y from calls join pheno using (individual)), tot as (select count(*) n, avg(value) my, sum(value) sy from pheno
  where individual in (select individual from calls)),
ty as (select sum((value - my) ** 2) syy from pheno, tot where individual in (select individual from calls)),
ob as (select marker, count(g) k, avg(g) mg, sum(g * (y - my)) gy, sum(y - my) oy, sum((y - my) ** 2) oyy, var_pop(g) * count(g) sxx from al, tot group by marker),
"""
_FINISH = """
fin as (select *, n - 2 df, case when sxx > 1e-10 * gg then b end eff, greatest(yy - b * b * sxx, 0) rss from fit),
res as (select marker, n, eff effect, sqrt(rss / df / sxx) se, eff / sqrt(rss / df / sxx) t, df from fin)"""
_IMPUTED = _SIMPLE + """
fit as (select marker, cast(n as double) n, sxx, sxx + n * mg * mg gg, (gy - mg * oy) / nullif(sxx, 0) b, syy yy from ob, tot, ty where k / n >= 0.8),""" + _FINISH
_OBSERVED = _SIMPLE + """
fit as (select marker, cast(k as double) n, sxx, sxx + k * mg * mg gg, (gy - mg * oy) / nullif(sxx, 0) b, oyy - oy * oy / k yy from ob, tot where k / n >= 0.8),""" + _FINISH
_GWAS_OUT = f"select marker, {_r('effect')} effect, {_r('se')} se, {_r('t')} t, {_r(TTAIL.format(t='t', df='df'))} pvalue, n, case when effect is null then 'singular' else 'ok' end status from res"
register("gwas_simple", f"with {L}, {_IMPUTED} {_GWAS_OUT}")(lambda s, d: gwas(calls_l(s, d), pheno_l(s, d), min_call_rate=0.8))
register("gwas_simple_noimpute", f"with {L}, {_OBSERVED} {_GWAS_OUT}")(lambda s, d: gwas(calls_l(s, d), pheno_l(s, d), min_call_rate=0.8, impute=False))
# With two covariates: residuals of y and g after the covariates, by a 2 x 2 solve.
_COV = """
sam as (select individual, value y, c1, c2 from pheno join cov using (individual) where individual in (select individual from calls)),
mk as (select marker, avg(dosage) mu, count(dosage) k from calls join sam using (individual) group by marker having count(dosage) / (select count(*) from sam) >= 0.8),
"""
_COV_FULL = _COV + "de as (select mk.marker, coalesce(c.dosage, mk.mu) g, y, c1, c2 from mk cross join sam left join calls c on c.marker = mk.marker and c.individual = sam.individual),"
_COV_SEEN = _COV + "de as (select marker, dosage g, y, c1, c2 from calls join mk using (marker) join sam using (individual) where dosage is not null),"
_COV_FIT = """
m1 as (select marker, count(*) n, covar_pop(c1, c1) * count(*) s11, covar_pop(c1, c2) * count(*) s12, covar_pop(c2, c2) * count(*) s22,
  covar_pop(g, c1) * count(*) g1, covar_pop(g, c2) * count(*) g2, covar_pop(y, c1) * count(*) y1, covar_pop(y, c2) * count(*) y2,
  covar_pop(g, y) * count(*) gy, var_pop(g) * count(*) gg, var_pop(y) * count(*) yy, sum(g * g) raw from de group by marker),
m2 as (select *, s11 * s22 - s12 * s12 det from m1),
m3 as (select *, (s22 * g1 - s12 * g2) / nullif(det, 0) a1, (s11 * g2 - s12 * g1) / nullif(det, 0) a2, (s22 * y1 - s12 * y2) / nullif(det, 0) b1, (s11 * y2 - s12 * y1) / nullif(det, 0) b2 from m2),
m4 as (select *, gg - a1 * g1 - a2 * g2 sxx, gy - a1 * y1 - a2 * y2 sxy, yy - b1 * y1 - b2 * y2 syy, n - 4 df from m3),
fin as (select marker, cast(n as double) n, df, n <= 4 few, det <= 1e-12 * s11 * s22 or sxx <= 1e-10 * raw flat, sxx, sxy / nullif(sxx, 0) eff, greatest(syy - sxy * sxy / nullif(sxx, 0), 0) rss from m4),
res as (select marker, n, df, case when few then 'insufficient' when flat then 'singular' else 'ok' end status,
  case when not few and not flat then eff end effect, case when not few and not flat then sqrt(rss / df / sxx) end se from fin),
out as (select *, effect / se t from res)"""
_COV_OUT = f"select marker, {_r('effect')} effect, {_r('se')} se, {_r('t')} t, {_r(TTAIL.format(t='t', df='df'))} pvalue, n, status from out"
register("gwas_cov", f"with {L}, {_COV_FULL} {_COV_FIT} {_COV_OUT}")(lambda s, d: gwas(calls_l(s, d), pheno_l(s, d), cov_l(s, d), min_call_rate=0.8))
register("gwas_cov_noimpute", f"with {L}, {_COV_SEEN} {_COV_FIT} {_COV_OUT}")(lambda s, d: gwas(calls_l(s, d), pheno_l(s, d), cov_l(s, d), min_call_rate=0.8, impute=False))
register("manhattan", f"""with {L}, {_IMPUTED}, pv as (select marker, {TTAIL.format(t='t', df='df')} p from res where effect is not null)
  select row_number() over (order by cast(substr(marker, 2) as bigint)) - 1 as position, marker, {_r('case when p <= 0 then 0 else -log10(p) end')} neg_log10 from pv""")(
    lambda s, d: plotdata.manhattan(gwas(calls_l(s, d), pheno_l(s, d), min_call_rate=0.8).where("status = 'ok'"), C.marker_index(numeric_order(calls_l(s, d))))
)

# Matrices ------------------------------------------------------------------------------------------------------------


def _indexed(calls: DataFrame) -> DataFrame:
    return C.standardized_entries(calls).join(C.marker_index(calls), "marker").select("individual", F.col("marker_idx").alias("m"), "z")


_Z = "z as (select individual, mi.idx m, (dosage - mean) / std z from calls join st using (marker) join mi using (marker) where dosage is not null)"
register("covariance", f"with {E}, {STATS}, {MIDX}, {_Z} select a.m mi, b.m mj, {_r('sum(a.z * b.z) / ((select n from ni) - 1)')} v from z a join z b on a.individual = b.individual and a.m <= b.m group by 1, 2")(
    lambda s, d: linalg.covariance(_indexed(calls_e(s, d)), s.read.parquet(f"{d}/embeddings.parquet").count())
)


def _coordinates(s: SparkSession, d: str) -> DataFrame:
    """All calls as a matrix (individual, marker, dosage)."""
    c = calls_e(s, d).where("dosage is not null")
    return c.select(F.substring("individual", 2, 9).cast("long").alias("i"), F.substring("marker", 2, 9).cast("long").alias("j"), F.col("dosage").alias("v"))


_CO = f"with {E}, a as (select cast(substr(individual, 2) as bigint) i, cast(substr(marker, 2) as bigint) j, dosage v from calls where dosage is not null)"
register("matmul", f"{_CO} select b.j i, a.j, {_r('sum(a.v * b.v)')} v from a join a b on a.i = b.i where a.v != 0 and b.v != 0 group by 1, 2")(
    lambda s, d: linalg.matmul(linalg.transpose(_coordinates(s, d)), _coordinates(s, d))
)
register("transpose", f"{_CO} select j i, i j, v from a")(lambda s, d: linalg.transpose(_coordinates(s, d)))
register("matvec", f"{_CO} select a.i, {_r('sum(a.v * (a.j + 1) / 7.0)')} v from a group by 1")(
    lambda s, d: linalg.matvec(_coordinates(s, d), s.range(64).select(F.col("id").alias("j"), ((F.col("id") + 1) / 7.0).alias("v")))
)

# Components, prediction ----------------------------------------------------------------------------------------------


def _loadings(s: SparkSession, d: str) -> DataFrame:
    calls = calls_e(s, d)
    at = F.col("marker_idx")
    return C.column_statistics(calls).join(C.marker_index(calls), "marker").withColumn("loadings", F.array((at % 7 - 3) / 10.0, (at % 5 - 2) / 10.0))


_LOAD = "ld as (select marker, (idx % 7 - 3) / 10.0 w1, (idx % 5 - 2) / 10.0 w2 from mi)"
register("pca_scores_given_loadings", f"with {E}, {STATS}, {MIDX}, {_LOAD} select individual, {_r('sum((dosage - mean) / std * w1)')} pc1, {_r('sum((dosage - mean) / std * w2)')} pc2 from calls join st using (marker) join ld using (marker) group by 1")(
    lambda s, d: pca.scores(calls_e(s, d), _loadings(s, d), 2).select("individual", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))
)
register("pca_points", f"""with {E}, {STATS}, {MIDX}, {_LOAD}, sc as (select individual, sum((dosage - mean) / std * w1) a, sum((dosage - mean) / std * w2) b
  from calls join st using (marker) join ld using (marker) group by 1)
  select individual, {_r('a')} pc1, {_r('b')} pc2, printf('%s<br>PC1: %.3f<br>PC2: %.3f', individual, a, b) as label from sc""")(
    lambda s, d: plotdata.pca_points(pca.scores(calls_e(s, d), _loadings(s, d), 2))
)
register("pca_variance")(lambda s, d: pca.explained_variance(pca.fit_pca(calls_e(s, d), 10).components))
register("pca_scores")(lambda s, d: plotdata.pca_points(pca.fit_transform(s, calls_e(s, d), 2)[1]))
_GST = """gs as (select marker, avg(dosage) mean, case when var_pop(dosage) * count(dosage) > 0 then sqrt(var_pop(dosage) * count(dosage) / ((select n from ni) - 1)) else 1.0 end sc from calls group by 1),
gz as (select individual, mi.idx m, (dosage - mean) / sc z, value y from calls join gs using (marker) join mi using (marker) join pheno using (individual) where dosage is not null)"""
register("gblup_normal_eq", f"with {E}, {MIDX}, {_GST} select a.m mi, b.m mj, {_r('sum(a.z * b.z)')} v from gz a join gz b on a.individual = b.individual and a.m <= b.m group by 1, 2")(
    lambda s, d: gblup.normal_equations(calls_e(s, d), pheno_e(s, d))[0]
)
register("gblup_normal_rhs", f"with {E}, {MIDX}, {_GST} select m, {_r('sum(z * y)')} v from gz group by 1")(lambda s, d: gblup.normal_equations(calls_e(s, d), pheno_e(s, d))[1])


def _effects(s: SparkSession, d: str) -> DataFrame:
    calls = calls_e(s, d)
    return C.marker_index(calls).select("marker", F.lit(0.9).alias("mean"), F.lit(0.8).alias("scale"), ((F.col("marker_idx") % 9 - 4) / 20.0).alias("effect"))


register("gblup_predict_given_effects", f"""with {E}, {STATS}, {MIDX} select individual, {_r('11.5 + sum((idx % 9 - 4) / 20.0 * (coalesce(dosage, mean) - 0.9) / 0.8)')} prediction
  from grid join mi using (marker) group by 1""")(lambda s, d: gblup.predict(calls_e(s, d), _effects(s, d), 11.5))  # fmt: skip


def _gblup(s: SparkSession, d: str) -> DataFrame:
    model = gblup.fit_gblup(calls_e(s, d), pheno_e(s, d), alpha=0.1)
    return gblup.predict(calls_e(s, d), model.markers, model.intercept)


register("gblup_fit_predict")(_gblup)
register("gblup_cv")(lambda s, d: gblup.cross_validate(calls_e(s, d), pheno_e(s, d), n_splits=5, alpha=0.1, seed=3)[0])
_FM = f"""with {E}, pr as (select individual, value y, ntile(4) over (order by md5('5:' || individual), individual) - 1 fold, value * 0.5 + length(individual) prediction from pheno)
  select fold, {_r('sqrt(avg((y - prediction) ** 2))')} rmse, {_r('corr(y, prediction)')} correlation, count(*) n_test from pr group by 1"""
register("fold_metrics", _FM)(
    lambda s, d: gblup.fold_metrics(pheno.assign_folds(pheno_e(s, d), 4, seed=5).withColumn("y", F.col("value")).withColumn("prediction", F.col("value") * 0.5 + F.length("individual")))
)

# Clustering ----------------------------------------------------------------------------------------------------------

register("pairwise_distance", f"""with {L}, {STATS}, {RIDX}, zz as (select r, marker, (coalesce(dosage, mean) - mean) / std z from grid join ri using (individual))
  select a.r a, b.r b, {_r('sqrt(sum((a.z - b.z) ** 2))')} distance from zz a join zz b on a.marker = b.marker and a.r < b.r group by 1, 2""", exact=True)(
    lambda s, d: cluster.pairwise_distances(calls_l(s, d)).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), nearest_decimal("distance"))
)
register("dendrogram_merges")(lambda s, d: cluster.named_merges(cluster.dendrogram(calls_l(s, d)), calls_l(s, d)))
register("dendrogram_complete")(lambda s, d: cluster.dendrogram(calls_l(s, d), "complete"))


# Admixture -----------------------------------------------------------------------------------------------------------

_U = "(({i} * 7919 + {j} * 104729 + {s} * 31) % 10007) / 10007.0 + 1e-3"
_NMF = f"""with {E}, {STATS}, {MIDX}, {RIDX}, x as (select r, idx c, coalesce(dosage, mean) v from grid join ri using (individual) join mi using (marker)),
ks as (select unnest(range(3)) k),
q0 as (select r, k, ({_U.format(i='r', j='k', s=0)}) / sum({_U.format(i='r', j='k', s=0)}) over (partition by r) q from ri, ks),
h0 as (select k, idx c, {_U.format(i='idx', j='k', s=1)} h from mi, ks),
qtx as (select k, c, sum(q * v) v from q0 join x using (r) group by 1, 2), qtq as (select a.k, b.k l, sum(a.q * b.q) v from q0 a join q0 b using (r) group by 1, 2),
den as (select qtq.k, c, sum(qtq.v * h) v from qtq join h0 on h0.k = qtq.l group by 1, 2),
h1 as (select k, c, greatest(1e-9, h * qtx.v / greatest(den.v, 1e-9)) h from h0 join qtx using (k, c) join den using (k, c))"""
register("admixture_step", f"""{_NMF}, xh as (select r, k, sum(v * h) v from x join h1 using (c) group by 1, 2), hh as (select a.k, b.k l, sum(a.h * b.h) v from h1 a join h1 b using (c) group by 1, 2),
  dq as (select q0.r, hh.l k, sum(q * v) v from q0 join hh on hh.k = q0.k group by 1, 2),
  q1 as (select r, k, greatest(1e-9, q * xh.v / greatest(dq.v, 1e-9)) q from q0 join xh using (r, k) join dq using (r, k))
  select individual, 'Cluster ' || (k + 1) as cluster, {_r('q / sum(q) over (partition by r)')} proportion from q1 join ri using (r)""")(
    lambda s, d: plotdata.admixture_bars(admixture.fit_admixture(calls_e(s, d), 3, max_iter=1)[0])
)
register("admixture_alleles_step", f"{_NMF} select marker, {_r('max(h) filter (where k = 0)')} cluster_1, {_r('max(h) filter (where k = 1)')} cluster_2, {_r('max(h) filter (where k = 2)')} cluster_3 from h1 join mi on mi.idx = c group by 1")(
    lambda s, d: admixture.fit_admixture(calls_e(s, d), 3, max_iter=1)[1].select("marker", *[F.col("p")[i].alias(f"cluster_{i + 1}") for i in range(3)])
)


def _given_p(s: SparkSession, d: str) -> DataFrame:
    at = F.col("marker_idx")
    return C.marker_index(calls_e(s, d)).select("marker", F.array((at % 7 + 1) / 8.0, (at % 5 + 1) / 4.0).alias("p"))


_TRANSFORM = f"""with {E}, {STATS}, {MIDX}, p as (select marker, (idx % 7 + 1) / 8.0 a, (idx % 5 + 1) / 4.0 b from mi),
  g as (select sum(a * (a + b)) da, sum(b * (a + b)) db from p),
  t as (select individual, greatest(1e-9, sum(coalesce(dosage, mean) * a) / greatest(max(da), 1e-9)) qa, greatest(1e-9, sum(coalesce(dosage, mean) * b) / greatest(max(db), 1e-9)) qb
    from grid join p using (marker), g group by 1)"""
register("admixture_transform", f"{_TRANSFORM} select individual, {_r('qa / (qa + qb)')} q1, {_r('qb / (qa + qb)')} q2 from t")(
    lambda s, d: admixture.transform(calls_e(s, d), _given_p(s, d), 2).select("individual", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))
)
register("admixture_bars", f"""{_TRANSFORM} select individual, 'Cluster 1' as cluster, {_r('qa / (qa + qb)')} proportion from t
  union all select individual, 'Cluster 2', {_r('qb / (qa + qb)')} from t""")(lambda s, d: plotdata.admixture_bars(admixture.transform(calls_e(s, d), _given_p(s, d), 2)))  # fmt: skip
register("admixture_fit")(lambda s, d: plotdata.admixture_bars(admixture.fit_admixture(calls_e(s, d), 3)[0]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import result_queries  # noqa: F401  (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import result_queries  # noqa: F401

    return dict(SQL)
