"""Queries: filter, CLR, screens, heterogeneity, stability and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import log_p, normal_two_sided_sql, rounded
from ..operators import composition, meta, moments, stability, sweeps
from .oracle import CTE, bh, lp, ols, r
from .registry import analysis, register


def _r(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


def _lp(name: str, alias: str | None = None):
    return log_p(F.col(name)).alias(alias or f"log_{name}")


@register("feature_landscape", f"""
SELECT feature, regexp_extract(feature,'g__([^|]*)',1) AS genus,
  replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ') AS species, {r('prevalence')} AS prevalence,
  {r('mean_abundance')} AS mean_abundance, {r('max_abundance')} AS max_abundance, cohorts_present,
  prevalence>=0.20 AND cohorts_present>=3 AS retained FROM landscape""")
def feature_landscape(spark, folder):
    return analysis(spark, folder).landscape.select(
        "feature", "genus", "species", _r("prevalence"), _r("mean_abundance"), _r("max_abundance"),
        "cohorts_present", "retained")


@register("retained_summary", f"""
SELECT prevalence>=0.20 AND cohorts_present>=3 AS retained, count(*) AS n_features,
  {r('median(prevalence)')} AS median_prevalence, {r('median(mean_abundance)')} AS median_mean_abundance
FROM landscape GROUP BY 1""")
def retained_summary(spark, folder):
    return composition.landscape_summary(analysis(spark, folder).landscape).select(
        "retained", "n_features", _r("median_prevalence"), _r("median_mean_abundance"))


@register("pseudocount", f"""
SELECT {r('min(value) FILTER (WHERE value>0)/2', 9)} AS pseudocount FROM grid""")
def pseudocount(spark, folder):
    a = analysis(spark, folder)
    return composition.pseudocount(composition.keep_features(a.abundance, a.features)).select(_r("pseudocount", 9))


@register("clr_profile", f"""
SELECT sample_id, count(*) AS n_features, {r('sum(clr)')} AS clr_sum, {r('min(clr)')} AS clr_min,
  {r('max(clr)')} AS clr_max, {r('sum(clr*clr)')} AS clr_square_sum FROM clr_grid GROUP BY 1""")
def clr_profile(spark, folder):
    """Row profile of the CLR; the implicit zeros enter as a count times ``-s``."""
    a = analysis(spark, folder)
    kept = composition.keep_features(a.abundance, a.features)
    logs = composition.shifted_logs(kept, composition.pseudocount(kept).scalar())
    centres = composition.sample_centres(a.samples, logs, a.feature_count)
    size = a.feature_count
    sums = logs.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("u").alias("_u"), F.sum(F.col("u") * F.col("u")).alias("_uu"),
        F.max("u").alias("_top"), F.min("u").alias("_low"))
    return centres.join(sums, "sample_id", "left").select(
        "sample_id", size.cast("bigint").alias("n_features"),
        rounded(F.coalesce("_u", F.lit(0.0)) - size * F.col("s")).alias("clr_sum"),
        rounded(F.when(F.coalesce("_k", F.lit(0)) < size, F.lit(0.0)).otherwise(F.col("_low")) - F.col("s")).alias("clr_min"),
        rounded(F.coalesce("_top", F.lit(0.0)) - F.col("s")).alias("clr_max"),
        rounded(F.coalesce("_uu", F.lit(0.0)) - size * F.col("s") * F.col("s")).alias("clr_square_sum"))


@register("association_screen", f"""
SELECT feature, n1, n0, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue,
  {lp('qvalue')} AS log_qvalue,
  CASE WHEN coef>0 THEN 'CRC_higher' WHEN coef<0 THEN 'control_higher' WHEN coef=0 THEN 'zero' END AS direction
FROM assoc""")
def association_screen(spark, folder):
    return analysis(spark, folder).association.select(
        "feature", "n1", "n0", _r("coef"), _r("se"), _lp("pvalue"), _lp("qvalue"), "direction")


CTE["association_null"] = bh(ols("""SELECT 'ALL' AS design_id, sample_id, feature, cohort,
  CASE WHEN platform IN ('BUILDING','MACHINERY') THEN 1 ELSE 0 END AS condition, clr FROM clr_grid"""))


@register("association_null", f"""
SELECT feature, n1, n0, {r('coef')} AS coef, {r('se')} AS se, {lp('qvalue')} AS log_qvalue FROM association_null""")
def association_null(spark, folder):
    """The screen on a condition that carries no signal."""
    a = analysis(spark, folder)
    samples = a.samples.withColumn(
        "condition", F.col("platform").isin("BUILDING", "MACHINERY").cast("int"))
    fitted = moments.association_screen(
        moments.clr_moments(samples, a.abundance, a.features), moments.cohort_counts(samples))
    return fitted.select("feature", "n1", "n0", _r("coef"), _r("se"), _lp("qvalue"))


CTE["cond_medians"] = """SELECT feature, count(*) FILTER (WHERE condition=1) AS n_case,
  count(*) FILTER (WHERE condition=0) AS n_control,
  avg(CASE WHEN value>0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE condition=1) AS prevalence_case,
  avg(CASE WHEN value>0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE condition=0) AS prevalence_control,
  median(value) FILTER (WHERE condition=1) AS median_case,
  median(value) FILTER (WHERE condition=0) AS median_control FROM grid GROUP BY 1"""


@register("condition_medians", f"""
SELECT feature, n_case, n_control, {r('prevalence_case')} AS prevalence_case,
  {r('prevalence_control')} AS prevalence_control, {r('median_case')} AS median_case,
  {r('median_control')} AS median_control, {r('median_case-median_control')} AS median_diff FROM cond_medians""")
def condition_medians(spark, folder):
    a = analysis(spark, folder)
    return stability.condition_medians(a.samples, a.abundance, a.features).select(
        "feature", "n_case", "n_control", _r("prevalence_case"), _r("prevalence_control"),
        _r("median_case"), _r("median_control"), _r("median_diff"))


CTE["mann_whitney"] = f"""SELECT feature, u, CASE WHEN z<=0 THEN 1.0 ELSE {normal_two_sided_sql('z')} END AS pvalue FROM (
  SELECT feature, u, (greatest(u,n1*n0-u)-n1*n0/2-0.5)/sqrt(n1*n0/12*((n+1)-ties/(n*(n-1)))) AS z FROM (
   SELECT feature, sum(CASE WHEN condition=1 THEN rk END)-max(n1)*(max(n1)+1)/2 AS u, max(n1) AS n1, max(n0) AS n0,
     max(n1)+max(n0) AS n, sum(k*k-1) AS ties FROM (
    SELECT feature, condition, CAST(rank() OVER (PARTITION BY feature ORDER BY value) AS DOUBLE)
      +(count(*) OVER (PARTITION BY feature, value)-1)/2.0 AS rk,
      CAST(count(*) OVER (PARTITION BY feature, value) AS DOUBLE) AS k,
      CAST(sum(condition) OVER (PARTITION BY feature) AS DOUBLE) AS n1,
      CAST(sum(1-condition) OVER (PARTITION BY feature) AS DOUBLE) AS n0 FROM grid) GROUP BY feature))"""
CTE["mann_whitney_q"] = bh("SELECT * FROM mann_whitney")


@register("mannwhitney_screen", f"""
SELECT feature, {r('u', 2)} AS mannwhitney_u, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue
FROM mann_whitney_q""")
def mannwhitney_screen(spark, folder):
    a = analysis(spark, folder)
    tested = stability.mann_whitney_screen(a.samples, a.abundance, a.features)
    return moments.bh_adjust(tested, "pvalue", "qvalue").select(
        "feature", _r("mannwhitney_u", 2), _lp("pvalue"), _lp("qvalue"))


CTE["cells"] = """SELECT feature, cohort, count(*) FILTER (WHERE condition=1) AS n1,
  count(*) FILTER (WHERE condition=0) AS n0, avg(clr) FILTER (WHERE condition=1) AS mean1,
  avg(clr) FILTER (WHERE condition=0) AS mean0, var_samp(clr) FILTER (WHERE condition=1) AS v1,
  var_samp(clr) FILTER (WHERE condition=0) AS v0 FROM clr_grid GROUP BY 1,2"""
CTE["welch"] = f"""SELECT *, {normal_two_sided_sql('z')} AS pvalue FROM (
  SELECT *, effect/se AS z FROM (SELECT feature, cohort, n1, n0, mean1-mean0 AS effect, sqrt(v1/n1+v0/n0) AS se FROM cells))"""


@register("percohort_welch", f"""
SELECT feature, cohort, n1 AS n_case, n0 AS n_control, {r('effect')} AS effect, {r('se')} AS se,
  {lp('pvalue')} AS log_pvalue, 'COMPUTED' AS status FROM welch""")
def percohort_welch(spark, folder):
    return analysis(spark, folder).welch.select(
        "feature", "cohort", "n_case", "n_control", _r("effect"), _r("se"), _lp("pvalue"), "status")


CTE["hedges"] = """SELECT feature, cohort, n1, n0, g AS effect, sqrt((n1+n0)/(n1*n0*1.0)+g*g/(2.0*(n1+n0-2))) AS se FROM (
  SELECT feature, cohort, n1, n0, (mean1-mean0)/sqrt(((n1-1)*v1+(n0-1)*v0)/(n1+n0-2))*(1-3.0/(4*(n1+n0)-9)) AS g FROM cells)"""


@register("percohort_hedges", f"""
SELECT feature, cohort, n1 AS n_case, n0 AS n_control, {r('effect')} AS effect, {r('se')} AS se FROM hedges""")
def percohort_hedges(spark, folder):
    return meta.hedges_effects(analysis(spark, folder).moments).select(
        "feature", "cohort", "n_case", "n_control", _r("effect"), _r("se"))


def chi2_small(q: str, df: str) -> str:
    """Upper chi-square tail for one to four degrees of freedom."""
    odd = normal_two_sided_sql("chi_root")
    return (f"(SELECT CASE {df} WHEN 1 THEN {odd} WHEN 2 THEN exp(-{q}/2) "
            f"WHEN 3 THEN {odd}+exp(-{q}/2)*sqrt(2*{q}/pi()) WHEN 4 THEN exp(-{q}/2)*(1+{q}/2) END "
            f"FROM (SELECT sqrt({q}) AS chi_root))")


def dl(source: str, key: str, min_k: int) -> str:
    """DerSimonian-Laird over ``source``(key, effect, se)."""
    return f"""SELECT *, random_effect/random_se AS z, {normal_two_sided_sql('(random_effect/random_se)')} AS pvalue,
      CASE WHEN qstat>0 THEN greatest(0.0,(qstat-(k-1))/qstat)*100 ELSE 0.0 END AS i2 FROM (
     SELECT {key}, max(k) AS k, max(fixed) AS fixed_effect, max(qstat) AS qstat, max(tau2) AS tau2,
      sum(effect/(se*se+tau2))/sum(1/(se*se+tau2)) AS random_effect, sqrt(1/sum(1/(se*se+tau2))) AS random_se FROM (
      SELECT *, CASE WHEN c>0 THEN greatest(0.0,(qstat-(k-1))/c) ELSE 0.0 END AS tau2 FROM (
       SELECT *, sum((effect-fixed)*(effect-fixed)/(se*se)) OVER p AS qstat FROM (
        SELECT {key}, effect, se, count(*) OVER p AS k, sum(effect/(se*se)) OVER p/sum(1/(se*se)) OVER p AS fixed,
          sum(1/(se*se)) OVER p-sum(1/(se*se*se*se)) OVER p/sum(1/(se*se)) OVER p AS c
        FROM ({source}) WHERE effect IS NOT NULL AND se>0 WINDOW p AS (PARTITION BY {key}))
       WINDOW p AS (PARTITION BY {key}))) WHERE k>={min_k} GROUP BY {key})"""


CTE["dl_feature"] = dl("SELECT * FROM welch", "feature", 3)
CTE["meta_all"] = bh("""SELECT d.*, pos, neg, same, CAST(same AS DOUBLE)/k AS same_fraction FROM dl_feature d JOIN (
  SELECT w.feature, count(*) FILTER (WHERE effect>0) AS pos, count(*) FILTER (WHERE effect<0) AS neg,
   count(*) FILTER (WHERE sign(effect)=sign(random_effect) AND random_effect<>0) AS same
  FROM welch w JOIN dl_feature d ON d.feature=w.feature GROUP BY 1) c ON c.feature=d.feature""")


@register("dl_random_effects", f"""
SELECT feature, k AS k_cohorts, {r('fixed_effect')} AS fixed_effect, {r('random_effect')} AS random_effect,
  {r('random_se')} AS random_se, {r('random_effect-1.96*random_se')} AS random_ci_low,
  {r('random_effect+1.96*random_se')} AS random_ci_high, {r('qstat')} AS q_statistic, k-1 AS q_df,
  {lp(chi2_small('qstat', '(k-1)'))} AS log_q_pvalue, {r('tau2')} AS tau2, {r('i2')} AS i2_percent,
  {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue, pos AS cohorts_positive, neg AS cohorts_negative,
  same AS cohorts_same_direction, {r('same_fraction')} AS same_direction_fraction FROM meta_all""")
def dl_random_effects(spark, folder):
    return analysis(spark, folder).meta.select(
        "feature", "k_cohorts", _r("fixed_effect"), _r("random_effect"), _r("random_se"), _r("random_ci_low"),
        _r("random_ci_high"), _r("q_statistic"), "q_df", _lp("q_pvalue"), _r("tau2"), _r("i2_percent"),
        _lp("pvalue"), _lp("qvalue"), "cohorts_positive", "cohorts_negative", "cohorts_same_direction",
        _r("same_direction_fraction"))


CTE["single_fit"] = ols("SELECT cohort AS design_id, sample_id, feature, cohort, condition, clr FROM clr_grid")


@register("single_cohort_screen", f"""
SELECT design_id AS cohort, feature, n1, n0, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue
FROM single_fit""")
def single_cohort_screen(spark, folder):
    a = analysis(spark, folder)
    return moments.single_cohort_screen(a.moments, a.counts).select(
        "cohort", "feature", "n1", "n0", _r("coef"), _r("se"), _lp("pvalue"))


CTE["fine_fit"] = ols("SELECT 'ALL' AS design_id, sample_id, feature, fine_cohort AS cohort, condition, clr FROM clr_grid")


@register("fine_cohort_screen", f"""
SELECT feature, n1, n0, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue FROM fine_fit""")
def fine_cohort_screen(spark, folder):
    """The pooled screen adjusted for many small cohorts, some with one class."""
    a = analysis(spark, folder)
    samples = a.samples.drop("cohort").withColumnRenamed("fine_cohort", "cohort")
    table = moments.clr_moments(samples, a.abundance, a.features)
    fitted = moments.screen(table, moments.design_weights(moments.pooled_design(moments.cohort_counts(samples))))
    return fitted.select("feature", "n1", "n0", _r("coef"), _r("se"), _lp("pvalue"))


CTE["loco_top"] = """SELECT feature FROM assoc ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature LIMIT 50"""


@register("loco_screen", f"""
SELECT feature, design_id AS left_out, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue,
  'COMPUTED' AS status FROM loco_fit WHERE feature IN (SELECT feature FROM loco_top)""")
def loco_screen(spark, folder):
    """Leave-one-cohort-out refit of the fifty leading features on the pooled CLR."""
    a = analysis(spark, folder)
    top = a.association.orderBy(F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature").limit(50)
    enough = (F.col("n1") + F.col("n0") >= 20) & (F.col("n1") > 0) & (F.col("n0") > 0)
    return a.leave_one_out.join(top.select("feature"), "feature", "left_semi").select(
        "feature", "left_out", F.when(enough, rounded(F.col("coef"))).alias("coef"),
        F.when(enough, rounded(F.col("se"))).alias("se"), F.when(enough, log_p(F.col("pvalue"))).alias("log_pvalue"),
        F.when(enough, "COMPUTED").otherwise("UNAVAILABLE").alias("status"))


@register("bh_within_group", f"""
SELECT design_id AS left_out, feature, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue FROM loco_fit""")
def bh_within_group(spark, folder):
    return analysis(spark, folder).leave_one_out.select("left_out", "feature", _lp("pvalue"), _lp("qvalue"))


CTE["gaps"] = """SELECT feature, cohort, median(value) FILTER (WHERE condition=1)-median(value) FILTER (WHERE condition=0) AS diff
  FROM grid GROUP BY 1,2 HAVING count(DISTINCT condition)=2"""
CTE["stab"] = """SELECT a.feature, max(a.coef) AS coef, max(a.pvalue) AS pvalue, max(a.qvalue) AS qvalue, count(diff) AS tested,
  count(*) FILTER (WHERE sign(coef)<>0 AND sign(diff)=sign(coef)) AS same,
  string_agg(cohort||':'||printf('%.6f',diff+0.0),';' ORDER BY cohort) AS detail
  FROM assoc a LEFT JOIN gaps g ON g.feature=a.feature GROUP BY 1"""
CTE["stable"] = "SELECT * FROM stab WHERE qvalue<0.10 AND CAST(same AS DOUBLE)/tested>=0.60"


@register("stability_median", f"""
SELECT feature, {r('coef')} AS coef, {lp('qvalue')} AS log_qvalue, tested AS cohorts_tested,
  same AS cohorts_same_direction, {r('CAST(same AS DOUBLE)/tested')} AS stability_fraction, detail FROM stab""", "coarse")
def stability_median(spark, folder):
    return analysis(spark, folder, "coarse").stability.select(
        "feature", _r("coef"), _lp("qvalue"), "cohorts_tested", "cohorts_same_direction",
        _r("stability_fraction"), "detail")


CTE["support"] = """SELECT f.design_id, f.feature, max(f.coef) AS coef, max(f.pvalue) AS pvalue, max(f.qvalue) AS qvalue,
  count(*) FILTER (WHERE sign(mean1-mean0)<>0) AS eligible,
  count(*) FILTER (WHERE sign(mean1-mean0)<>0 AND sign(mean1-mean0)=sign(coef)) AS same
  FROM loco_fit f JOIN cells c ON c.feature=f.feature AND c.cohort<>f.design_id GROUP BY 1,2"""


@register("same_direction_support", f"""
SELECT design_id AS left_out, feature, eligible AS eligible_cohorts, same AS same_direction_cohorts,
  {r('CAST(same AS DOUBLE)/nullif(eligible,0)')} AS same_direction_fraction FROM support""")
def same_direction_support(spark, folder):
    a = analysis(spark, folder)
    designs = moments.leave_one_out_designs(a.counts)
    fits = a.leave_one_out.withColumnRenamed("left_out", "design_id")
    return stability.mean_direction_support(a.moments, designs, fits).select(
        F.col("design_id").alias("left_out"), "feature", "eligible_cohorts", "same_direction_cohorts",
        _r("same_direction_fraction"))


CTE["re_clr"] = """SELECT *, ln(value+pc)-avg(ln(value+pc)) OVER (PARTITION BY design_id, sample_id) AS clr FROM (
  SELECT fold AS design_id, sample_id, feature, cohort, condition, value,
   min(CASE WHEN value>0 THEN value END) OVER (PARTITION BY fold)/2 AS pc FROM grid JOIN folds ON cohort<>fold)"""
CTE["re_fit"] = bh(ols("SELECT design_id, sample_id, feature, cohort, condition, clr FROM re_clr"), family="design_id")
CTE["re_flags"] = """SELECT f.design_id, f.feature, f.coef, f.pvalue, f.qvalue, sign(f.coef)=sign(a.coef) AS same_direction,
  f.qvalue<0.10 AS fdr_hit FROM re_fit f JOIN assoc a ON a.feature=f.feature
  WHERE f.feature IN (SELECT feature FROM stable)"""
CTE["re_summary"] = """SELECT feature, count(*) AS models, count(*) FILTER (WHERE same_direction) AS same_direction_models,
  avg(CAST(same_direction AS DOUBLE)) AS same_fraction, count(*) FILTER (WHERE fdr_hit) AS fdr_models,
  avg(CAST(fdr_hit AS DOUBLE)) AS fdr_fraction, min(qvalue) AS min_q, max(qvalue) AS max_q,
  avg(CAST(same_direction AS DOUBLE))>=0.90 AND avg(CAST(fdr_hit AS DOUBLE))>=0.80 AS robust FROM re_flags GROUP BY 1"""


@register("loco_rescreen", f"""
SELECT design_id AS left_out, feature, {r('coef')} AS coef, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue
FROM re_fit""", "coarse")
def loco_rescreen(spark, folder):
    return analysis(spark, folder, "coarse").rescreen.select("left_out", "feature", _r("coef"), _lp("pvalue"), _lp("qvalue"))


@register("loco_rescreen_summary", f"""
SELECT feature, models, same_direction_models, {r('same_fraction')} AS same_direction_fraction, fdr_models,
  {r('fdr_fraction')} AS fdr_fraction, {lp('min_q')} AS log_min_qvalue, {lp('max_q')} AS log_max_qvalue, robust
FROM re_summary""", "coarse")
def loco_rescreen_summary(spark, folder):
    return analysis(spark, folder, "coarse").rescreen_summary.select(
        "feature", "models", "same_direction_models", _r("same_direction_fraction"), "fdr_models",
        _r("fdr_fraction"), _lp("min_qvalue"), _lp("max_qvalue"), "robust")


SWEEP_PREVALENCE = (0.10, 0.20, 0.30)
SWEEP_COHORTS = (2, 3, 4)


def sweep_rows(configs: str) -> str:
    """Screens of configurations (config_id, feature, pc) against the baseline."""
    clr = f"""SELECT config_id, sample_id, c.feature, cohort, condition,
      ln(value+pc)-avg(ln(value+pc)) OVER (PARTITION BY config_id, sample_id) AS clr
      FROM full_grid g JOIN ({configs}) c ON c.feature=g.feature"""
    fit = ols(f"SELECT config_id AS design_id, sample_id, feature, cohort, condition, clr FROM ({clr})")
    return bh(fit, family="design_id")


def sweep_summary(name: str) -> str:
    return f"""SELECT s.design_id, count(*) AS retained_features, count(*) FILTER (WHERE s.qvalue<0.10) AS fdr_lt_0_10,
      count(*) FILTER (WHERE s.qvalue<0.05) AS fdr_lt_0_05,
      count(*) FILTER (WHERE s.rk<=100 AND b.rk<=100) AS top_overlap,
      count(b.feature) AS common_features,
      {r('avg(CASE WHEN b.feature IS NOT NULL THEN CAST(sign(s.coef)=sign(b.coef) AS DOUBLE) END)')} AS direction_concordance,
      count(*) FILTER (WHERE s.qvalue<0.10 AND same>=0.60) AS stable_candidates FROM (
       SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS rk
       FROM {name}) s
      LEFT JOIN (SELECT *, row_number() OVER (ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS rk FROM assoc) b
       ON b.feature=s.feature
      LEFT JOIN (SELECT w.design_id, w.feature, avg(CAST(sign(diff)=sign(coef) AND sign(coef)<>0 AS DOUBLE)) AS same
       FROM {name} w JOIN full_gaps g ON g.feature=w.feature GROUP BY 1,2) st
       ON st.design_id=s.design_id AND st.feature=s.feature GROUP BY 1"""


CTE["full_gaps"] = """SELECT feature, cohort, median(value) FILTER (WHERE condition=1)-median(value) FILTER (WHERE condition=0) AS diff
  FROM full_grid GROUP BY 1,2 HAVING count(DISTINCT condition)=2"""
CTE["filter_config"] = f"""SELECT p AS prevalence_threshold, c AS min_cohorts_present, printf('p%g_c%d',p,c) AS config_id, feature,
  min(smallest) OVER (PARTITION BY p,c)/2 AS pc FROM (
   SELECT l.*, (SELECT min(value) FROM abund a WHERE a.feature=l.feature) AS smallest FROM landscape l) l,
  (SELECT unnest([{','.join(f'{p:g}' for p in SWEEP_PREVALENCE)}])::DOUBLE AS p),
  (SELECT unnest([{','.join(str(c) for c in SWEEP_COHORTS)}]) AS c) WHERE prevalence>=p AND cohorts_present>=c"""
CTE["filter_screens"] = sweep_rows("SELECT config_id, feature, pc FROM filter_config")


@register("filter_sweep", f"""
SELECT prevalence_threshold, min_cohorts_present, {r('pc', 9)} AS pseudocount, w.* EXCLUDE (design_id)
FROM ({sweep_summary('filter_screens')}) w
JOIN (SELECT DISTINCT prevalence_threshold, min_cohorts_present, config_id, pc FROM filter_config) ON config_id=design_id""")
def filter_sweep(spark, folder):
    a = analysis(spark, folder)
    every = a.landscape.select("feature")
    gaps = stability.cohort_median_gaps(a.samples, a.abundance, every)
    return sweeps.filter_sweep(a.samples, a.abundance, a.landscape, a.association, gaps,
                               SWEEP_PREVALENCE, SWEEP_COHORTS).select(
        "prevalence_threshold", "min_cohorts_present", _r("pseudocount", 9), "retained_features", "fdr_lt_0_10",
        "fdr_lt_0_05", "top_overlap", "common_features", _r("direction_concordance"), "stable_candidates")


CTE["pc_config"] = """SELECT printf('minimum_positive_x_%g',m) AS config_id, feature,
  (SELECT min(value) FROM grid WHERE value>0)*m AS pc FROM retained, (SELECT unnest([0.25,0.5,1.0])::DOUBLE AS m)"""
CTE["pc_screens"] = sweep_rows("SELECT * FROM pc_config")


@register("pseudocount_sweep", f"""
SELECT design_id AS pseudocount_rule, {r('pc', 9)} AS pseudocount, w.* EXCLUDE (design_id)
FROM ({sweep_summary('pc_screens')}) w
JOIN (SELECT DISTINCT config_id, pc FROM pc_config) ON config_id=design_id""", "coarse")
def pseudocount_sweep(spark, folder):
    a = analysis(spark, folder, "coarse")
    return sweeps.pseudocount_sweep(a.samples, a.abundance, a.features, a.association, a.median_gaps).select(
        "pseudocount_rule", _r("pseudocount", 9), "retained_features", "fdr_lt_0_10", "fdr_lt_0_05", "top_overlap",
        "common_features", _r("direction_concordance"), "stable_candidates")


@register("stability_threshold_sweep", """
SELECT c AS fdr_cutoff, t AS same_direction_threshold,
  count(*) FILTER (WHERE qvalue<c AND CAST(same AS DOUBLE)/tested>=t) AS candidate_count,
  count(*) FILTER (WHERE qvalue<c AND CAST(same AS DOUBLE)/tested>=t AND coef>0) AS case_higher,
  count(*) FILTER (WHERE qvalue<c AND CAST(same AS DOUBLE)/tested>=t AND coef<0) AS control_higher
FROM stab, (SELECT unnest([0.05,0.10])::DOUBLE AS c), (SELECT unnest([0.5,0.6,0.7,0.8])::DOUBLE AS t) GROUP BY 1,2""", "coarse")
def stability_threshold_sweep(spark, folder):
    return sweeps.stability_threshold_sweep(analysis(spark, folder, "coarse").stability)


@register("screen_vs_baseline", f"""
SELECT count(*) AS retained_features, count(*) FILTER (WHERE n.qvalue<0.10) AS fdr_lt_0_10,
  count(*) FILTER (WHERE n.qvalue<0.05) AS fdr_lt_0_05,
  count(*) FILTER (WHERE nrk<=100 AND brk<=100) AS top_overlap, count(b.feature) AS common_features,
  {r('avg(CAST(sign(n.coef)=sign(b.coef) AS DOUBLE))')} AS direction_concordance,
  count(*) FILTER (WHERE n.qvalue<0.10 AND same>=0.60) AS stable_candidates
FROM (SELECT *, row_number() OVER (ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS nrk FROM association_null) n
LEFT JOIN (SELECT *, row_number() OVER (ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS brk FROM assoc) b
  ON b.feature=n.feature
LEFT JOIN (SELECT w.feature, avg(CAST(sign(diff)=sign(coef) AND sign(coef)<>0 AS DOUBLE)) AS same
  FROM association_null w JOIN gaps g ON g.feature=w.feature GROUP BY 1) st ON st.feature=n.feature""", "coarse")
def screen_vs_baseline(spark, folder):
    """Another condition's screen summarised against the baseline screen."""
    a = analysis(spark, folder, "coarse")
    samples = a.samples.withColumn("condition", F.col("platform").isin("BUILDING", "MACHINERY").cast("int"))
    other = moments.association_screen(
        moments.clr_moments(samples, a.abundance, a.features), moments.cohort_counts(samples))
    return sweeps.against_baseline(sweeps.settle(other.withColumn("config_id", F.lit("other"))),
                                   a.association, a.median_gaps).select(
        "retained_features", "fdr_lt_0_10", "fdr_lt_0_05", "top_overlap", "common_features",
        _r("direction_concordance"), "stable_candidates")
