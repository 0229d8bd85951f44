"""Queries: rank metrics, guild scores, panels and model transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.stats import log_p, rounded
from ..operators import composition, elasticnet, guilds, linear, meta, moments, panels, resample, stability, transfer
from ..operators.ranking import bh_adjust, class_rank_metrics, grouped_quantiles
from ..session import settle
from .oracle import CTE, bh, lp, ols, r
from .queries_linear import covariate_fit, orthogonal, AGE, BMI, CASE, COMPLETE, GENDER
from .queries_screen import dl
from .registry import analysis, register
from .vectors import vector_profiles

SEED = 20240501
MATCHED_REPEATS = 500


def _r(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


def _lp(name: str):
    return log_p(F.col(name)).alias(f"log_{name}")


def auroc_sql(source: str, keys: str) -> str:
    """AUROC by pair counting on midranks and average precision by its definition."""
    return f"""SELECT {keys}, max(n1) AS n_pos, max(n0) AS n_neg,
      CASE WHEN max(n1)>0 AND max(n0)>0 THEN (sum(CASE WHEN condition=1 THEN rk END)-max(n1)*(max(n1)+1)/2.0)/(max(n1)*max(n0)) END AS auroc,
      CASE WHEN max(n1)>0 AND max(n0)>0 THEN sum(CASE WHEN condition=1 THEN tp/np END)/max(n1) END AS average_precision
     FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)+(count(*) OVER (PARTITION BY {keys}, score)-1)/2.0 AS rk,
      CAST(sum(condition) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
      CAST(count(*) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS np,
      sum(condition) OVER (PARTITION BY {keys}) AS n1, sum(1-condition) OVER (PARTITION BY {keys}) AS n0
      FROM ({source})) GROUP BY {keys}"""


@register("auroc_by_cohort", f"""
SELECT cohort, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, {r('auroc')} AS auroc
FROM ({auroc_sql('SELECT cohort, condition, score FROM samples', 'cohort')})""")
def auroc_by_cohort(spark, folder):
    return class_rank_metrics(analysis(spark, folder).samples, ["cohort"], "score", "condition").select(
        "cohort", "n_pos", "n_neg", _r("auroc"))


@register("average_precision_by_cohort", f"""
SELECT fine_cohort, {r('auroc')} AS auroc, {r('average_precision')} AS average_precision
FROM ({auroc_sql('SELECT fine_cohort, condition, round(score/500) AS score FROM samples', 'fine_cohort')})""")
def average_precision_by_cohort(spark, folder):
    """Tied scores in many small cohorts, some with one class."""
    scored = analysis(spark, folder).samples.withColumn("score", F.round(F.col("score") / 500))
    return class_rank_metrics(scored, ["fine_cohort"], "score", "condition").select(
        "fine_cohort", _r("auroc"), _r("average_precision"))


BOOT = 2000
CTE["boot_rows"] = f"""SELECT cohort, sample_id, score, condition, row_number() OVER (PARTITION BY cohort
  ORDER BY {draw_sql(SEED, 'order', 'sample_id')}, sample_id) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM samples"""
CTE["boot_draws"] = f"""SELECT d.cohort, d.replicate, b.score, b.condition FROM (
  SELECT cohort, replicate, 1+{draw_sql(SEED, 'bootstrap', 'cohort', 'replicate', 'i')}%n AS i
  FROM boot_rows, range(1,{BOOT + 1}) t(replicate)) d JOIN boot_rows b ON b.cohort=d.cohort AND b.i=d.i"""


@register("bootstrap_auroc_ci", f"""
SELECT cohort, {r('quantile_cont(auroc,0.025)')} AS ci_low, {r('quantile_cont(auroc,0.975)')} AS ci_high,
  count(auroc) AS replicates_used FROM ({auroc_sql('SELECT * FROM boot_draws', 'cohort, replicate')}) GROUP BY cohort""")
def bootstrap_auroc_ci(spark, folder):
    return resample.bootstrap_auroc(analysis(spark, folder).samples, ["cohort"], "score", "condition", BOOT, SEED).select(
        "cohort", _r("ci_low"), _r("ci_high"), "replicates_used")


@register("stratified_folds", f"""
SELECT sample_id, cohort, condition, n_folds, CAST((k-1)%n_folds AS INTEGER) AS fold FROM (
 SELECT s.*, CAST(greatest(3,least(5,min(c) OVER (PARTITION BY cohort))) AS INTEGER) AS n_folds FROM (
  SELECT sample_id, cohort, condition, count(*) OVER (PARTITION BY cohort, condition) AS c,
   row_number() OVER (PARTITION BY cohort, condition ORDER BY {draw_sql(SEED, 'fold', 'sample_id')}, sample_id) AS k FROM samples) s)""")
def stratified_folds(spark, folder):
    return resample.stratified_folds(analysis(spark, folder).samples, SEED)


RULES = (("promo_large", "g", "PROMO"), ("promo_large", "g", "LARGE"), ("small_kind", "g", "SMALL"),
         ("economy_bolt", "s", "ECONOMY bolt"), ("economy_bolt", "f", "STANDARD"), ("lone_gear", "s", "MEDIUM gear"))
CTE["guild_rules"] = "SELECT * FROM (VALUES " + ",".join(f"('{g}','{k}','{n}')" for g, k, n in RULES) + ") t(guild, rk, name)"
CTE["guild_members"] = """SELECT *, count(*) OVER (PARTITION BY guild) AS n_features FROM (
  SELECT DISTINCT guild, feature FROM retained JOIN guild_rules ON
   (rk='g' AND regexp_extract(feature,'g__([^|]*)',1)=name) OR (rk='f' AND regexp_extract(feature,'f__([^|]*)',1)=name)
   OR (rk='s' AND replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ')=name))"""
CTE["guild_score"] = """SELECT c.sample_id, max(c.cohort) AS cohort, max(c.condition) AS condition, guild,
  max(n_features) AS n_features, avg(clr) AS score
  FROM clr_grid c JOIN guild_members g ON g.feature=c.feature WHERE n_features>=2 GROUP BY c.sample_id, guild"""
CTE["guild_pooled"] = bh(ols("SELECT 'ALL' AS design_id, * FROM guild_score", "guild", "score"))
CTE["guild_loco"] = bh(ols("SELECT fold AS design_id, g.* FROM guild_score g JOIN folds ON cohort<>fold", "guild", "score"),
                       family="design_id")


def _rules(spark):
    return guilds.rule_table(spark, RULES)


def guild_screens(spark, folder):
    a = analysis(spark, folder, "coarse")
    if not hasattr(a, "guilds"):
        members = settle(guilds.guild_membership(a.features, _rules(spark)))
        a.guild_members = members
        a.guilds = guilds.GuildScreens(a.samples, guilds.guild_scores(a.samples, a.abundance, a.features, members))
        a.guild_association, a.guild_loco = settle(a.guilds.association()), settle(a.guilds.leave_one_out())
    return a, a.guilds


@register("panel_membership", """
SELECT guild, m.feature, regexp_extract(m.feature,'g__([^|]*)',1) AS genus,
  replace(regexp_extract(m.feature,'s__([^|]*)',1),'_',' ') AS species, n_features, n_features<3 AS small,
  CASE WHEN coef>0 THEN 'CRC_higher' WHEN coef<0 THEN 'control_higher' ELSE '' END AS direction,
  CASE WHEN m.feature IN (SELECT feature FROM stable) THEN 'yes' ELSE 'no' END AS stable
FROM guild_members m LEFT JOIN assoc a ON a.feature=m.feature""", "coarse")
def panel_membership(spark, folder):
    a, _ = guild_screens(spark, folder)
    return guilds.describe_members(a.guild_members, a.association, a.stable)


@register("guild_scores", f"""
SELECT s.sample_id, s.guild, {r('s.score')} AS score, {r('s.score*CASE WHEN coef>=0 THEN 1 ELSE -1 END')} AS oriented_score
FROM guild_score s JOIN guild_pooled p ON p.guild=s.guild""", "coarse")
def guild_scores(spark, folder):
    a, g = guild_screens(spark, folder)
    return g.oriented(a.guild_association).select("sample_id", "guild", _r("score"), _r("oriented_score"))


_gcov = orthogonal("gcov", [AGE, BMI, *GENDER, CASE], "cohort", COMPLETE)
CTE["guild_cov"] = bh(covariate_fit("gcov", _gcov).replace("clr_grid c", "guild_score c").replace("c.clr", "c.score")
                      .replace("feature", "guild"))


@register("guild_association", f"""
SELECT p.guild, n1, n0, {r('p.coef')} AS coef, {r('p.coef-1.96*p.se')} AS ci_low, {r('p.coef+1.96*p.se')} AS ci_high,
  {lp('p.pvalue')} AS log_pvalue, {lp('p.qvalue')} AS log_qvalue,
  CASE WHEN p.coef>0 THEN 'CRC_higher' ELSE 'control_higher' END AS direction
FROM guild_pooled p""", "coarse")
def guild_association(spark, folder):
    a, _ = guild_screens(spark, folder)
    return a.guild_association.select("guild", "n1", "n0", _r("coef"), _r("ci_low"), _r("ci_high"), _lp("pvalue"),
                                      _lp("qvalue"), "direction")


@register("guild_covariate_association", f"""
SELECT guild, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue
FROM guild_cov""", "coarse")
def guild_covariate_association(spark, folder):
    """Guild scores under the covariate design: scores enter as a feature table."""
    a, g = guild_screens(spark, folder)
    design = linear.build_design(a.samples, ["age", "bmi"], ["gender", "cohort"], ddof=0, scale_on_all=False)
    fitted = linear.score_screen(design, guilds.as_feature(g.scores))
    return bh_adjust(fitted, "pvalue", "qvalue").select(
        F.col("feature").alias("guild"), _r("coef"), _r("se"), _lp("pvalue"), _lp("qvalue"))


CTE["guild_cells"] = """SELECT guild AS feature, cohort, count(*) FILTER (WHERE condition=1) AS n1,
  count(*) FILTER (WHERE condition=0) AS n0, avg(score) FILTER (WHERE condition=1) AS mean1,
  avg(score) FILTER (WHERE condition=0) AS mean0, var_samp(score) FILTER (WHERE condition=1) AS v1,
  var_samp(score) FILTER (WHERE condition=0) AS v0 FROM guild_score GROUP BY 1,2"""


def hedges_of(cells: str) -> str:
    return CTE["hedges"].replace("FROM cells", f"FROM {cells}")


@register("guild_random_effects", f"""
SELECT feature AS guild, k AS k_cohorts, {r('random_effect')} AS random_effect, {r('random_se')} AS random_se,
  {r('tau2')} AS tau2, {r('i2')} AS i2_percent, {r('qstat')} AS q_statistic, {lp('pvalue')} AS log_pvalue,
  {lp('qvalue')} AS log_qvalue FROM ({bh(dl(hedges_of('guild_cells'), 'feature', 2))})""", "coarse")
def guild_random_effects(spark, folder):
    _, g = guild_screens(spark, folder)
    pooled = meta.random_effects(settle(meta.hedges_effects(g.moments)), ["feature"], 2)
    return bh_adjust(pooled, "pvalue", "qvalue").select(
        F.col("feature").alias("guild"), "k_cohorts", _r("random_effect"), _r("random_se"), _r("tau2"),
        _r("i2_percent"), _r("q_statistic"), _lp("pvalue"), _lp("qvalue"))


@register("guild_per_cohort", f"""
SELECT design_id AS cohort, guild, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue
FROM ({ols("SELECT cohort AS design_id, * FROM guild_score", "guild", "score")})""", "coarse")
def guild_per_cohort(spark, folder):
    _, g = guild_screens(spark, folder)
    return g.per_cohort().select("cohort", "guild", _r("coef"), _r("se"), _lp("pvalue"))


@register("guild_loco", f"""
SELECT guild, design_id AS left_out, n1+n0 AS n_samples, {r('coef')} AS coef, {lp('pvalue')} AS log_pvalue,
  {lp('qvalue')} AS log_qvalue, CASE WHEN coef>0 THEN 'CRC_higher' ELSE 'control_higher' END AS direction
FROM guild_loco""", "coarse")
def guild_loco(spark, folder):
    a, _ = guild_screens(spark, folder)
    return a.guild_loco.select("guild", "left_out", (F.col("n1") + F.col("n0")).alias("n_samples"), _r("coef"),
                               _lp("pvalue"), _lp("qvalue"), "direction")


@register("guild_loco_summary", f"""
SELECT l.guild, count(*) AS models, {r('avg(CAST(sign(l.coef)=sign(p.coef) AS DOUBLE))')} AS same_direction_fraction,
  {r('avg(CAST(l.qvalue<0.10 AS DOUBLE))')} AS fdr_fraction,
  avg(CAST(sign(l.coef)=sign(p.coef) AS DOUBLE))>=0.9 AND avg(CAST(l.qvalue<0.10 AS DOUBLE))>=0.8 AS robust
FROM guild_loco l JOIN guild_pooled p ON p.guild=l.guild GROUP BY 1""", "coarse")
def guild_loco_summary(spark, folder):
    _, g = guild_screens(spark, folder)
    return stability.leave_one_out_summary(g.leave_one_out_flags()).select(
        F.col("feature").alias("guild"), "models", _r("same_direction_fraction"), _r("fdr_fraction"), "robust")


@register("score_only_loso", f"""
SELECT guild, cohort AS held_out, n_features, training_orientation, {r('auroc')} AS auroc,
  {r('average_precision')} AS average_precision, CAST(n_pos+n_neg AS BIGINT) AS n_test,
  printf('CRC=%d;control=%d', CAST(n_pos AS BIGINT), CAST(n_neg AS BIGINT)) AS classes_in_test
FROM ({auroc_sql('''SELECT s.guild, s.cohort, s.n_features, s.condition, s.score*CASE WHEN coef>=0 THEN 1 ELSE -1 END AS score,
  CASE WHEN coef>=0 THEN 'CRC_higher' ELSE 'control_higher' END AS training_orientation
  FROM guild_score s JOIN guild_loco l ON l.guild=s.guild AND l.design_id=s.cohort''', 'guild, cohort, n_features, training_orientation')})""",
          "coarse")
def score_only_loso(spark, folder):
    a, g = guild_screens(spark, folder)
    return g.score_only_transfer(a.guild_loco).select(
        "guild", "held_out", "n_features", "training_orientation", _r("auroc"), _r("average_precision"), "n_test",
        "classes_in_test")


@register("prior_panel", f"""
SELECT feature, regexp_extract(feature,'g__([^|]*)',1) AS genus, {r('prevalence')} AS prevalence,
  {r('mean_abundance')} AS mean_abundance FROM landscape
WHERE regexp_extract(feature,'g__([^|]*)',1) IN ('PROMO','ECONOMY')""")
def prior_panel(spark, folder):
    a = analysis(spark, folder)
    genera = spark.createDataFrame([("PROMO",), ("ECONOMY",)], "genus string")
    return guilds.prior_panel(a.samples, a.abundance, a.landscape.select("feature"), genera).select(
        "feature", "genus", _r("prevalence"), _r("mean_abundance"))


CTE["eco"] = """SELECT sample_id, max(cohort) AS cohort, max(condition) AS condition,
  -sum(CASE WHEN value>0 THEN value/100*ln(value/100) ELSE 0 END) AS shannon,
  count(*) FILTER (WHERE value>0) AS richness,
  sum(CASE WHEN feature LIKE '%|g__PROMO|%' THEN value ELSE 0 END) AS panel_abundance,
  log10(sum(CASE WHEN feature LIKE '%|g__PROMO|%' THEN value ELSE 0 END)+1e-5) AS log10_panel_abundance,
  count(*) FILTER (WHERE value>0 AND feature LIKE '%|g__PROMO|%') AS panel_richness FROM full_grid GROUP BY 1"""


def ecology(spark, folder):
    a = analysis(spark, folder)
    panel = a.landscape.filter("genus = 'PROMO'").select("feature")
    return a, composition.ecology_scores(a.samples.select("sample_id", "cohort", "condition"), a.abundance, panel)


@register("closure_shannon_richness", f"""
SELECT sample_id, cohort, condition, {r('shannon')} AS shannon, richness, {r('panel_abundance')} AS panel_abundance,
  {r('log10_panel_abundance')} AS log10_panel_abundance, panel_richness FROM eco""")
def closure_shannon_richness(spark, folder):
    _, scores = ecology(spark, folder)
    return scores.select("sample_id", "cohort", "condition", _r("shannon"), "richness", _r("panel_abundance"),
                         _r("log10_panel_abundance"), "panel_richness")


@register("closure", f"""
SELECT sample_id, {r('sum(p)')} AS total, {r('max(p)')} AS largest, {r('sum(p*p)')} AS concentration FROM (
 SELECT sample_id, value/sum(value) OVER (PARTITION BY sample_id) AS p FROM full_grid) GROUP BY 1""")
def closure(spark, folder):
    p = F.col("proportion")
    return composition.closure(analysis(spark, folder).abundance).groupBy("sample_id").agg(
        rounded(F.sum(p)).alias("total"), rounded(F.max(p)).alias("largest"), rounded(F.sum(p * p)).alias("concentration"))


CTE["eco_long"] = """SELECT sample_id, cohort, condition, unnest(['shannon','richness','log10_panel_abundance','panel_richness']) AS feature,
  unnest([shannon, CAST(richness AS DOUBLE), log10_panel_abundance, CAST(panel_richness AS DOUBLE)]) AS score FROM eco"""
CTE["eco_cells"] = """SELECT feature, cohort, count(*) FILTER (WHERE condition=1) AS n1, count(*) FILTER (WHERE condition=0) AS n0,
  avg(score) FILTER (WHERE condition=1) AS mean1, avg(score) FILTER (WHERE condition=0) AS mean0,
  var_samp(score) FILTER (WHERE condition=1) AS v1, var_samp(score) FILTER (WHERE condition=0) AS v0 FROM eco_long GROUP BY 1,2"""


@register("metric_meta", f"""
SELECT feature AS metric, k AS k_cohorts, {r('random_effect')} AS random_effect, {r('random_se')} AS random_se,
  {r('tau2')} AS tau2, {r('i2')} AS i2_percent, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue
FROM ({bh(dl(hedges_of('eco_cells'), 'feature', 2))})""")
def metric_meta(spark, folder):
    a, scores = ecology(spark, folder)
    wide = scores.select("sample_id", "shannon", F.col("richness").cast("double").alias("richness"),
                         "log10_panel_abundance", F.col("panel_richness").cast("double").alias("panel_richness"))
    long = wide.unpivot(["sample_id"], ["shannon", "richness", "log10_panel_abundance", "panel_richness"], "feature", "score")
    return meta.metric_meta(moments.score_moments(a.samples, long)).select(
        "metric", "k_cohorts", _r("random_effect"), _r("random_se"), _r("tau2"), _r("i2_percent"), _lp("pvalue"), _lp("qvalue"))


CTE["global_panel"] = """SELECT 'global_top' AS panel, feature FROM (SELECT * FROM assoc ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature LIMIT 29)
  UNION ALL SELECT 'all_features', feature FROM assoc
  UNION ALL SELECT 'global_stable', feature FROM stable
  UNION ALL SELECT 'global_high_consistency', s.feature FROM stable s JOIN re_summary r ON r.feature=s.feature WHERE robust"""
CTE["training_panel"] = """SELECT *, 'training_only_top' AS panel FROM (SELECT *, row_number() OVER (PARTITION BY design_id
   ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS rk FROM support) WHERE rk<=29
  UNION ALL SELECT *, 'training_only_stability' FROM (SELECT *, row_number() OVER (PARTITION BY design_id
   ORDER BY qvalue, pvalue, feature) AS rk FROM support WHERE qvalue<0.10 AND CAST(same AS DOUBLE)/eligible>=0.60) WHERE rk<=29
  UNION ALL SELECT *, 'training_only_high_consistency' FROM (SELECT *, row_number() OVER (PARTITION BY design_id
   ORDER BY qvalue, pvalue, feature) AS rk FROM support WHERE qvalue<0.10 AND CAST(same AS DOUBLE)/eligible>=0.80) WHERE rk<=18"""


def training_fits(a):
    designs = moments.leave_one_out_designs(a.counts)
    fits = a.leave_one_out.withColumnRenamed("left_out", "design_id")
    support = stability.mean_direction_support(a.moments, designs, fits)
    return fits.join(support, ["design_id", "feature"])


def panel_tables(spark, folder):
    a = analysis(spark, folder, "coarse")
    if not hasattr(a, "global_panels"):
        high = a.rescreen_summary.filter("robust").select("feature")
        a.global_panels = settle(panels.global_panels(a.association, a.stable, high))
        a.training_panels = settle(panels.training_panels(training_fits(a)))
    return a


@register("global_panels", "SELECT panel, feature FROM global_panel", "coarse")
def global_panels(spark, folder):
    return panel_tables(spark, folder).global_panels.select("panel", "feature")


@register("training_only_panels", f"""
SELECT design_id AS held_out, panel, CAST(rk AS INTEGER) AS rank, feature, {r('coef')} AS coef, {lp('qvalue')} AS log_qvalue,
  {r('CAST(same AS DOUBLE)/eligible')} AS same_direction_fraction FROM training_panel""", "coarse")
def training_only_panels(spark, folder):
    return panel_tables(spark, folder).training_panels.select(
        F.col("design_id").alias("held_out"), "panel", "rank", "feature", _r("coef"), _lp("qvalue"),
        _r("same_direction_fraction"))


@register("panel_overlap", """
SELECT t.design_id AS held_out, t.panel, t.panel_size, g.panel AS reference,
  (SELECT count(*) FROM training_panel x JOIN global_panel y ON y.feature=x.feature
   WHERE x.design_id=t.design_id AND x.panel=t.panel AND y.panel=g.panel) AS overlap
FROM (SELECT design_id, panel, count(*) AS panel_size FROM training_panel GROUP BY 1,2) t,
  (SELECT DISTINCT panel FROM global_panel) g""", "coarse")
def panel_overlap(spark, folder):
    a = panel_tables(spark, folder)
    return panels.panel_overlap(a.training_panels, a.global_panels, ["design_id", "panel"]).withColumnRenamed(
        "design_id", "held_out")


@register("random_panels", f"""
SELECT CAST(repeat_id AS INTEGER) AS repeat_id, CAST(k AS INTEGER) AS rank, feature FROM (
 SELECT repeat_id, feature, row_number() OVER (PARTITION BY repeat_id ORDER BY
  {draw_sql(SEED, 'random_panel', 'repeat_id', 'feature')}, feature) AS k FROM retained, range(1,501) t(repeat_id)) WHERE k<=29""")
def random_panels(spark, folder):
    return panels.random_panels(analysis(spark, folder).features, MATCHED_REPEATS, SEED).select("repeat_id", "rank", "feature")


CTE["train_prev"] = """SELECT fold AS design_id, feature, avg(CASE WHEN value>0 THEN 1.0 ELSE 0.0 END) AS prevalence
  FROM grid JOIN folds ON cohort<>fold GROUP BY 1,2"""
CTE["prev_edges"] = """SELECT design_id, list_sort(list_distinct([quantile_cont(prevalence,0.0),quantile_cont(prevalence,0.2),
  quantile_cont(prevalence,0.4),quantile_cont(prevalence,0.6),quantile_cont(prevalence,0.8),quantile_cont(prevalence,1.0)])) AS edges
  FROM train_prev GROUP BY 1"""
CTE["prev_bins"] = """SELECT p.design_id, feature, prevalence, CASE WHEN len(edges)<3 THEN 0 ELSE
  len(list_filter(edges[2:len(edges)-1], lambda e: e<prevalence)) END AS bin FROM train_prev p JOIN prev_edges e ON e.design_id=p.design_id"""
CTE["targets"] = "SELECT feature FROM assoc ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature LIMIT 29"
CTE["match_rows"] = f"""SELECT *, CASE WHEN is_target=0 AND k<=coalesce(quota,0) THEN 1 ELSE 0 END AS from_bin FROM (
  SELECT b.*, repeat_id, is_target, {draw_sql(SEED, 'matched_panel', 'b.design_id', 'repeat_id', 'b.feature')} AS d,
   row_number() OVER (PARTITION BY b.design_id, repeat_id, is_target, b.bin
    ORDER BY {draw_sql(SEED, 'matched_panel', 'b.design_id', 'repeat_id', 'b.feature')}, b.feature) AS k, quota
  FROM (SELECT *, CASE WHEN feature IN (SELECT feature FROM targets) THEN 1 ELSE 0 END AS is_target FROM prev_bins) b
  CROSS JOIN range(1,{MATCHED_REPEATS + 1}) t(repeat_id)
  LEFT JOIN (SELECT design_id, bin, count(*) AS quota FROM prev_bins WHERE feature IN (SELECT feature FROM targets) GROUP BY 1,2) q
   ON q.design_id=b.design_id AND q.bin=b.bin)"""


@register("prevalence_bins", f"""
SELECT design_id AS held_out, feature, {r('prevalence')} AS prevalence, CAST(bin AS INTEGER) AS bin FROM prev_bins""")
def prevalence_bins(spark, folder):
    a = analysis(spark, folder)
    bins = panels.prevalence_bins(settle(panels.training_prevalence(a.samples, a.abundance, a.features)))
    return bins.select(F.col("design_id").alias("held_out"), "feature", _r("prevalence"), "bin")


@register("prevalence_matched_panels", """
SELECT design_id AS held_out, CAST(repeat_id AS INTEGER) AS repeat_id, CAST(rk AS INTEGER) AS rank, feature, from_bin FROM (
 SELECT *, row_number() OVER (PARTITION BY design_id, repeat_id ORDER BY from_bin DESC, is_target, d, feature) AS rk
 FROM match_rows) WHERE rk<=29""")
def prevalence_matched_panels(spark, folder):
    a = analysis(spark, folder)
    bins = settle(panels.prevalence_bins(settle(panels.training_prevalence(a.samples, a.abundance, a.features))))
    targets = settle(panels.capped_panel(a.association, "targets", 29).select("feature"))
    return panels.matched_random_panels(bins, targets, MATCHED_REPEATS, SEED).select(
        F.col("design_id").alias("held_out"), "repeat_id", "rank", "feature", "from_bin")


def study(spark, folder):
    """The transfer study on the coarse baskets."""
    a = panel_tables(spark, folder)
    if not hasattr(a, "study"):
        folded = a.samples.select("sample_id", "cohort", "condition").join(
            resample.stratified_folds(a.samples, SEED).select("sample_id", "fold"), "sample_id")
        profiles = composition.dense_clr(folded, a.abundance, a.features)
        names = [row["feature"] for row in a.features.orderBy("feature").collect()]
        a.study = transfer.TransferStudy(profiles, names, SEED)
    return a, a.study


def loso_results(spark, folder):
    a, s = study(spark, folder)
    if not hasattr(a, "loso"):
        fixed = a.global_panels.select("panel", "feature")
        a.loso = settle(s.leave_one_out(fixed))
        a.loso_predictions = s.held_out_predictions()
        a.weights = settle(elasticnet.feature_weights(s.coefficients().filter("panel = 'all_features'")))
    return a


@register("loso_elastic_net")
def loso_elastic_net(spark, folder):
    """Leave-one-cohort-out models on the full-data panels (no SQL: iterative fits)."""
    return loso_results(spark, folder).loso.select(
        "panel", "panel_size", "held_out", "n_train", "n_test", "n_test_case", "n_test_control", "status",
        _r("auroc", 4), _r("average_precision", 4))


@register("loso_summary")
def loso_summary(spark, folder):
    out = transfer.leave_one_out_summary(loso_results(spark, folder).loso)
    return out.select("panel", "panel_size", "folds", *[_r(c, 4) for c in (
        "median_auroc", "minimum_auroc", "maximum_auroc", "auroc_iqr", "median_average_precision", "weighted_auroc")])


@register("elastic_net_weights")
def elastic_net_weights(spark, folder):
    return loso_results(spark, folder).weights.select(
        "feature", _r("mean_weight", 4), _r("mean_abs_weight", 4), _r("selected_fraction", 4))


def pair_results(spark, folder):
    a, s = study(spark, folder)
    if not hasattr(a, "pairs"):
        a.pairs = settle(s.pairwise(a.global_panels.select("panel", "feature"), "insample"))
    return a


@register("panel_benchmark")
def panel_benchmark(spark, folder):
    """Full-data panels: train on one cohort, test on every cohort, with transferability loss."""
    out = transfer.pairwise_summary(pair_results(spark, folder).pairs)
    return out.select("panel", "panel_size", "pairs", "off_diagonal_above_half", *[_r(c, 4) for c in (
        "off_diagonal_median_auroc", "off_diagonal_minimum_auroc", "off_diagonal_maximum_auroc", "off_diagonal_auroc_iqr",
        "off_diagonal_median_average_precision", "within_cohort_median_auroc", "transferability_loss")])


@register("pairwise_transfer")
def pairwise_transfer(spark, folder):
    """Cohort by cohort transfer of all features, diagonal by stratified folds."""
    a, s = study(spark, folder)
    if not hasattr(a, "cv_pairs"):
        every = a.features.select(F.lit("all_features").alias("panel"), "feature")
        a.cv_pairs = settle(s.pairwise(every, "cv"))
    return a.cv_pairs.select("train_cohort", "test_cohort", "is_diagonal", "n_train", "n_test", "status",
                             _r("auroc", 4), _r("average_precision", 4))


@register("transfer_matrix")
def transfer_matrix(spark, folder):
    """Train x test AUROC on the embeddings."""
    profiles = vector_profiles(spark, folder)
    names = [f"d{i:02d}" for i in range(1, 65)]
    s = transfer.TransferStudy(profiles, names, SEED)
    every = spark.range(1, 65).select(F.lit("all").alias("panel"), F.format_string("d%02d", "id").alias("feature"))
    pairs = settle(s.pairwise(every, "insample").withColumn("auroc", rounded(F.col("auroc"), 4)))
    return transfer.transfer_matrix(pairs, [f"c{i}" for i in range(5)])


def training_results(spark, folder):
    a, s = study(spark, folder)
    if not hasattr(a, "training_loso"):
        own = a.training_panels.select(F.col("design_id").alias("held_out"), "panel", "feature")
        a.training_loso = settle(s.leave_one_out(own))
    return a


@register("training_panel_benchmark")
def training_panel_benchmark(spark, folder):
    """Leakage-aware panels: chosen, scaled and fitted on the training cohorts only."""
    return training_results(spark, folder).training_loso.select(
        "panel", "panel_size", "held_out", "status", _r("auroc", 4), _r("average_precision", 4))


@register("random_panel_benchmark")
def random_panel_benchmark(spark, folder):
    """Unmatched and prevalence-matched random panels per fold against the chosen panels."""
    a, s = study(spark, folder)
    loso_results(spark, folder)
    training_results(spark, folder)
    bins = settle(panels.prevalence_bins(settle(panels.training_prevalence(a.samples, a.abundance, a.features))))
    unmatched = panels.random_panels(bins, MATCHED_REPEATS, SEED, keys=["design_id"]).select(
        F.lit("random_unmatched").alias("panel"), F.col("repeat_id").alias("repeat"), "feature",
        F.col("design_id").alias("held_out"))
    matched = panels.matched_random_panels(bins, a.stable, MATCHED_REPEATS, SEED).select(
        F.lit("random_prevalence_matched").alias("panel"), F.col("repeat_id").alias("repeat"), "feature",
        F.col("design_id").alias("held_out"))
    both = settle(s.leave_one_out(settle(matched.unionByName(unmatched)), keep_scores=False))
    observed = a.loso.filter("panel = 'global_stable'").select("held_out", F.col("panel").alias("observed"), "auroc").unionByName(
        a.training_loso.filter("panel = 'training_only_stability'").select("held_out", F.col("panel").alias("observed"), "auroc"))
    return transfer.random_panel_summary(both, observed).select(
        "held_out", "panel", "observed", "n_random_panels", *[_r(c, 4) for c in (
            "median_auroc", "mean_auroc", "auroc_iqr", "auroc_025", "auroc_975", "median_average_precision",
            "observed_auroc", "empirical_p")])


def comparison(spark, folder):
    a = training_results(spark, folder)
    loso_results(spark, folder)
    pair_results(spark, folder)
    folds = a.training_loso.unionByName(a.loso.filter("panel = 'all_features'"))
    gaps = transfer.panel_differences(folds, (
        ("training_only_top", "training_only_stability"), ("training_only_top", "training_only_high_consistency"),
        ("training_only_stability", "training_only_high_consistency"), ("all_features", "training_only_top")), ["held_out"])
    pairs = transfer.panel_differences(a.pairs.filter("NOT is_diagonal"), (
        ("global_top", "global_stable"), ("global_top", "global_high_consistency"),
        ("global_stable", "global_high_consistency")), ["train_cohort", "test_cohort"])
    rows = settle(gaps.select("comparison", F.lit("held-out AUROC").alias("metric"), F.col("held_out").alias("row_key"), "difference")
                  .unionByName(pairs.select("comparison", F.lit("off-diagonal AUROC").alias("metric"),
                                            F.concat_ws(">", "train_cohort", "test_cohort").alias("row_key"), "difference")))
    keys = ["comparison", "metric"]
    centre = rows.groupBy(*keys).agg(F.median("difference").alias("median_difference"), F.avg("difference").alias("mean_difference"))
    interval = resample.bootstrap_median(rows, keys, "difference", "row_key", 5000, SEED)
    test = resample.signed_rank(rows.filter("metric = 'held-out AUROC'"), keys, "difference").select(*keys, "pvalue")
    return centre.join(interval, keys).join(test, keys, "left")


@register("panel_comparison")
def panel_comparison(spark, folder):
    """Paired panel differences with bootstrap intervals and the signed-rank test."""
    return comparison(spark, folder).select(
        "comparison", "metric", *[_r(c, 4) for c in (
            "median_difference", "mean_difference", "bootstrap_ci_low", "bootstrap_ci_high", "pvalue")])


@register("claim_decisions")
def claim_decisions(spark, folder):
    a = analysis(spark, folder, "coarse")
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    design = linear.build_design(a.samples, ["age", "bmi"], ["gender", "cohort"], ddof=0, scale_on_all=False)
    variance = linear.sequential_partition(screens.shares(design), ["cohort", "condition", "age", "bmi", "gender"])
    return transfer.decision_rules(comparison(spark, folder), variance)


@register("guild_transfer")
def guild_transfer(spark, folder):
    """One-score models per guild: leave-one-out and pairwise summaries."""
    _, g = guild_screens(spark, folder)
    named = g.scores.groupBy("sample_id", "cohort", "condition").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("guild", "score"))), lambda p: p["score"]).alias("x"))
    names = [row["guild"] for row in g.scores.select("guild").distinct().orderBy("guild").collect()]
    s = transfer.TransferStudy(named, names, SEED)
    single = spark.createDataFrame([(n, n) for n in names], "panel string, feature string")
    folds = transfer.leave_one_out_summary(s.leave_one_out(single)).select("panel", _r("median_auroc", 4), _r("minimum_auroc", 4))
    pairs = transfer.pairwise_summary(s.pairwise(single)).select(
        "panel", _r("off_diagonal_median_auroc", 4), _r("within_cohort_median_auroc", 4), _r("transferability_loss", 4))
    return folds.join(pairs, "panel")


CTE["signed_rows"] = """SELECT fine_cohort, cohort, CAST(median(score) FILTER (WHERE condition=1)-median(score) FILTER (WHERE condition=0) AS DOUBLE) AS diff
  FROM samples GROUP BY 1,2"""
CTE["signed_ranked"] = """SELECT *, CAST(row_number() OVER (PARTITION BY cohort ORDER BY abs(diff)) AS INTEGER) AS rk,
  count(*) OVER (PARTITION BY cohort) AS n FROM signed_rows WHERE diff IS NOT NULL AND diff<>0"""


@register("signed_rank", f"""
SELECT s.cohort, CAST(s.n AS INTEGER) AS n_used, {r('s.w', 1)} AS rank_sum,
  {r('least(1.0,2*least(avg(CAST(c.total<=s.w AS DOUBLE)),avg(CAST(c.total>=s.w AS DOUBLE))))')} AS pvalue
FROM (SELECT cohort, max(n) AS n, CAST(coalesce(sum(rk) FILTER (WHERE diff>0),0) AS DOUBLE) AS w FROM signed_ranked GROUP BY 1) s
JOIN (SELECT cohort, pattern, sum(CASE WHEN (pattern>>(rk-1))&1=1 THEN rk ELSE 0 END) AS total
  FROM signed_ranked, range(0,4096) t(pattern) WHERE pattern < (1<<n) GROUP BY 1,2) c ON c.cohort=s.cohort GROUP BY 1,2,3""")
def signed_rank(spark, folder):
    """Signed-rank test over the small cohorts of each region; the SQL lists all sign patterns."""
    a = analysis(spark, folder)
    medians = grouped_quantiles(a.samples, ["cohort", "fine_cohort", "condition"], "score", [0.5])
    gaps = medians.groupBy("cohort", "fine_cohort").agg(
        (F.max(F.when(F.col("condition") == 1, F.col("q0"))) - F.max(F.when(F.col("condition") == 0, F.col("q0")))).alias("diff"))
    return resample.signed_rank(settle(gaps), ["cohort"], "diff").select(
        "cohort", "n_used", _r("rank_sum", 1), _r("pvalue"))
