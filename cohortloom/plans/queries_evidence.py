"""Queries: evidence joins, table upkeep, input checks and report data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lineage, text
from ..functions.draws import draw_sql
from ..functions.stats import clip_unit, log_p, neg_log10, rounded
from ..operators import evidence, panels, relational, reports, resample, stability, sweeps, transfer
from ..operators.ranking import grouped_quantiles
from ..session import settle, shared_folder
from ..sources import tables
from .basket import table
from .oracle import CTE, bh, lp, ols, r
from .queries_linear import COMPLETE, covariate_table, permutation_null
from .queries_screen import SWEEP_COHORTS, SWEEP_PREVALENCE, sweep_summary
from .queries_transfer import BOOT, SEED, loso_results, pair_results, panel_membership, panel_tables
from .registry import analysis, document_analysis, register


def _r(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


def _lp(name: str):
    return log_p(F.col(name)).alias(f"log_{name}")


CTE["compared"] = """SELECT a.feature, a.coef, a.pvalue, a.qvalue, c.coef AS other_coef, c.pvalue AS other_pvalue,
  c.qvalue AS other_qvalue, coalesce(sign(a.coef)=sign(c.coef),false) AS concordant
  FROM assoc a LEFT JOIN covariate_q c ON c.feature=a.feature"""


def compared(spark, folder):
    a = analysis(spark, folder, "coarse")
    if not hasattr(a, "compared"):
        a.compared = settle(evidence.compare_screens(a.association, covariate_table(spark, folder, "coarse")))
    return a


@register("screen_comparison", f"""
SELECT feature, {r('coef')} AS coef, {r('other_coef')} AS other_coef, {lp('qvalue')} AS log_qvalue,
  {lp('other_qvalue')} AS log_other_qvalue, CAST(sign(coef) AS INTEGER) AS baseline_sign,
  CAST(sign(other_coef) AS INTEGER) AS other_sign, concordant AS direction_concordant FROM compared""", "coarse")
def screen_comparison(spark, folder):
    return compared(spark, folder).compared.select(
        "feature", _r("coef"), _r("other_coef"), _lp("qvalue"), _lp("other_qvalue"), "baseline_sign", "other_sign",
        "direction_concordant")


@register("screen_comparison_summary", f"""
SELECT count(*) FILTER (WHERE qvalue<0.10) AS baseline_fdr, count(*) FILTER (WHERE other_qvalue<0.10) AS other_fdr,
  count(*) FILTER (WHERE qvalue<0.10 AND other_qvalue<0.10 AND concordant) AS baseline_preserved,
  count(*) FILTER (WHERE feature IN (SELECT feature FROM stable) AND other_qvalue<0.10 AND concordant) AS stable_preserved,
  {r('avg(CAST(concordant AS DOUBLE))')} AS concordance_rate,
  (SELECT count(*) FROM (SELECT feature FROM assoc ORDER BY qvalue, pvalue, feature LIMIT 100) x JOIN
   (SELECT feature FROM covariate_q ORDER BY qvalue, pvalue, feature LIMIT 100) y ON y.feature=x.feature) AS top_overlap
FROM compared""", "coarse")
def screen_comparison_summary(spark, folder):
    a = compared(spark, folder)
    return evidence.comparison_summary(a.compared, a.association, covariate_table(spark, folder, "coarse"), a.stable).select(
        "baseline_fdr", "other_fdr", "baseline_preserved", "stable_preserved", _r("concordance_rate"), "top_overlap")


#: Types that the outside table names as the baskets do; it names the others by its own scheme, which matches no genus.
SAME_NAMES = ("PROMO", "LARGE")
CTE["external"] = f"""SELECT 'k__part|p__all|g__'||genus||'|s__'||genus||'_'||split_part(p_name,' ',1) AS feature, avg(p_retailprice) AS effect
  FROM (SELECT *, CASE WHEN p_type IN {SAME_NAMES} THEN p_type ELSE 'X_'||p_type END AS genus FROM part) GROUP BY 1"""


def external_table(spark, folder):
    """A genus-level outside table: mean price per type and first word, over all parts."""
    kind = F.when(F.col("p_type").isin(*SAME_NAMES), F.col("p_type")).otherwise(F.concat(F.lit("X_"), "p_type"))
    return table(spark, folder, "part").groupBy(
        F.concat(F.lit("k__part|p__all|g__"), kind, F.lit("|s__"), kind, F.lit("_"),
                 F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))).alias("feature")).agg(
        F.avg("p_retailprice").alias("effect"))


CTE["overlap_rows"] = """SELECT a.feature, rk, same_fraction, e.feature AS external_feature, effect FROM (
   SELECT feature, row_number() OVER (ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature) AS rk FROM assoc) a
  LEFT JOIN (SELECT feature, CAST(same AS DOUBLE)/tested AS same_fraction FROM stab) s ON s.feature=a.feature
  LEFT JOIN external e ON regexp_extract(e.feature,'g__([^|]*)',1)=regexp_extract(a.feature,'g__([^|]*)',1) WHERE rk<=100"""


def overlap_table(spark, folder):
    a = analysis(spark, folder, "coarse")
    if not hasattr(a, "external"):
        a.external = settle(evidence.external_overlap(a.association, a.stability, external_table(spark, folder)))
    return a


@register("external_overlap", f"""
SELECT feature, CAST(rk AS INTEGER) AS rank, {r('same_fraction')} AS stability_fraction, external_feature, {r('effect', 4)} AS effect,
  CASE WHEN external_feature IS NULL THEN 'NO_GENUS_MATCH' ELSE 'GENUS_MATCH' END AS match_status FROM overlap_rows""", "coarse")
def external_overlap(spark, folder):
    return overlap_table(spark, folder).external.select(
        "feature", "rank", _r("stability_fraction"), "external_feature", _r("effect", 4), "match_status")


CTE["composite"] = f"""SELECT *, CAST(row_number() OVER (ORDER BY score DESC, tie) AS BIGINT) AS score_rank FROM (
  SELECT c.feature, c.qvalue, -log10(greatest(c.qvalue,1e-300)) AS nlq, CAST(same AS DOUBLE)/tested AS same_fraction,
   coalesce(other_qvalue<0.10 AND concordant,false) AS supported,
   coalesce(-log10(greatest(c.qvalue,1e-300)),0)*coalesce(CAST(same AS DOUBLE)/tested,0)
    *CASE WHEN coalesce(other_qvalue<0.10 AND concordant,false) THEN 1.0 ELSE 0.5 END AS score,
   {draw_sql(0, 'composite', 'c.feature')} AS tie
  FROM compared c LEFT JOIN stab s ON s.feature=c.feature)"""


def no_weights(spark):
    return spark.createDataFrame([], "feature string, mean_abs_weight double, selected_fraction double")


def scored(spark, folder):
    a = compared(spark, folder)
    if not hasattr(a, "scored"):
        a.scored = settle(evidence.composite_score(a.association, a.stability, a.compared, no_weights(spark)))
    return a


@register("composite_score", f"""
SELECT feature, {r('nlq', 4)} AS neglog10_q, {r('same_fraction')} AS stability_fraction, supported AS covariate_supported,
  {r('score', 4)} AS score, score_rank FROM composite""", "coarse")
def composite_score(spark, folder):
    """The composite without model weights (an empty weight table counts as zero)."""
    return scored(spark, folder).scored.select(
        "feature", _r("neglog10_q", 4), _r("stability_fraction"), "covariate_supported", _r("score", 4), "score_rank")


@register("composite_score_weighted")
def composite_score_weighted(spark, folder):
    """The composite with elastic-net weights (no SQL: iterative fits)."""
    loso_results(spark, folder)
    a = compared(spark, folder)
    return evidence.composite_score(a.association, a.stability, a.compared, a.weights).select(
        "feature", _r("score", 3), "score_rank", _r("selected_fraction", 3))


@register("meta_candidates", f"""
SELECT m.feature, {r('m.random_effect')} AS random_effect, {lp('m.qvalue')} AS log_meta_qvalue, {r('m.i2')} AS i2_percent,
  {r('m.same_fraction')} AS same_direction_fraction, score_rank,
  coalesce(m.qvalue<0.10 AND m.same_fraction>=0.60 AND m.i2<75,false) AS meta_stable_candidate,
  coalesce(sign(m.random_effect)=sign(c.coef),false) AS pooled_direction_concordant
FROM meta_all m LEFT JOIN compared c ON c.feature=m.feature LEFT JOIN composite s ON s.feature=m.feature""", "coarse")
def meta_candidates(spark, folder):
    a = scored(spark, folder)
    out = evidence.meta_candidates(a.meta, a.association, a.stability, a.compared, a.scored)
    return out.select("feature", _r("random_effect"), _lp("meta_qvalue"), _r("i2_percent"), _r("same_direction_fraction"),
                      "score_rank", "meta_stable_candidate", "pooled_direction_concordant")


@register("meta_summary", f"""
SELECT metric, value FROM (SELECT CAST(count(*) AS VARCHAR) AS features_tested,
  CAST(count(*) FILTER (WHERE qvalue<0.10) AS VARCHAR) AS meta_fdr_lt_0_10,
  CAST(count(*) FILTER (WHERE qvalue<0.10 AND same_fraction>=0.60 AND i2<75) AS VARCHAR) AS meta_stable_candidates,
  CAST(count(*) FILTER (WHERE i2>=75) AS VARCHAR) AS high_heterogeneity,
  printf('%.4f',median(i2)) AS median_i2_percent FROM meta_all)
UNPIVOT (value FOR metric IN (features_tested, meta_fdr_lt_0_10, meta_stable_candidates, high_heterogeneity, median_i2_percent))""", "coarse")
def meta_summary(spark, folder):
    """A metric ledger: one row of scalars as (metric, value) text."""
    a = scored(spark, folder)
    rows = evidence.meta_candidates(a.meta, a.association, a.stability, a.compared, a.scored)
    middle = grouped_quantiles(a.meta.withColumn("_g", F.lit(0)), ["_g"], "i2_percent", [0.5]).select("q0")
    one = evidence.meta_summary(rows, middle)
    return evidence.metric_ledger(one.withColumn("median_i2_percent", F.format_string("%.4f", "median_i2_percent")))


CTE["emap"] = """SELECT *, CASE WHEN loco_robust AND meta_supported AND NOT high_heterogeneity THEN 'high_consistency_candidate'
   WHEN high_heterogeneity THEN 'heterogeneous_candidate'
   WHEN in_context_panel AND direction='CRC_higher' THEN 'oral_associated_context_candidate' ELSE 'bounded_candidate' END AS interpretation_group,
   CAST(covariate_supported AS INTEGER)+CAST(meta_supported AS INTEGER)+CAST(loco_robust AS INTEGER)+CAST(in_context_panel AS INTEGER) AS support_layers
  FROM (SELECT s.feature, s.same, s.tested, CASE WHEN s.coef>0 THEN 'CRC_higher' ELSE 'control_higher' END AS direction,
   coalesce(c.other_qvalue<0.10,false) AS covariate_supported, coalesce(m.qvalue<0.10,false) AS meta_supported,
   coalesce(r.robust,false) AS loco_robust, s.feature LIKE '%|g__PROMO|%' OR s.feature LIKE '%|g__SMALL|%' AS in_context_panel,
   coalesce(m.i2>=75,false) AS high_heterogeneity, m.i2 AS i2, r.same_fraction, r.fdr_fraction,
   coalesce((SELECT max(CASE WHEN external_feature IS NULL THEN 'NO_GENUS_MATCH' ELSE 'GENUS_MATCH' END)
     FROM overlap_rows o WHERE o.feature=s.feature),'NOT_IN_TOP100_CONTEXT') AS external_status, x.score_rank
  FROM stable s LEFT JOIN compared c ON c.feature=s.feature LEFT JOIN meta_all m ON m.feature=s.feature
  LEFT JOIN re_summary r ON r.feature=s.feature LEFT JOIN composite x ON x.feature=s.feature)"""


def evidence_rows(spark, folder):
    a = scored(spark, folder)
    overlap_table(spark, folder)
    if not hasattr(a, "evidence"):
        context = a.landscape.filter(F.col("genus").isin("PROMO", "SMALL")).select("feature")
        a.evidence = settle(evidence.evidence_map(
            a.stable, a.compared, a.scored, a.meta, context, a.external, a.rescreen_summary))
    return a


@register("evidence_map", f"""
SELECT feature, direction, covariate_supported, meta_supported, loco_robust, in_context_panel, high_heterogeneity,
  external_status, support_layers, interpretation_group, score_rank FROM emap""", "coarse")
def evidence_map(spark, folder):
    return evidence_rows(spark, folder).evidence.select(
        "feature", "direction", "covariate_supported", "meta_supported", "loco_robust", "in_context_panel",
        "high_heterogeneity", "external_status", "support_layers", "interpretation_group", "score_rank")


@register("evidence_table", f"""
SELECT replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ') AS taxon, replace(direction,'_','-') AS direction,
  coalesce(printf('%.1f%%',i2),'') AS i2, same||'/'||tested AS same_direction,
  coalesce(printf('%.3f',same_fraction),'NA') AS loco_direction_fraction, coalesce(printf('%.3f',fdr_fraction),'NA') AS loco_fdr_fraction,
  CASE WHEN loco_robust THEN 'yes' ELSE 'no' END AS loco_robust,
  CASE WHEN external_status='GENUS_MATCH' THEN 'yes' ELSE 'no' END AS external_match,
  CASE WHEN in_context_panel THEN 'yes' ELSE 'no' END AS in_context_panel,
  CASE WHEN interpretation_group='high_consistency_candidate' THEN 'yes' ELSE 'no' END AS high_consistency,
  replace(interpretation_group,'_',' ') AS notes FROM emap""", "coarse")
def evidence_table(spark, folder):
    a = evidence_rows(spark, folder)
    return reports.evidence_table(a.evidence, a.stability)


@register("support_matrix", """
SELECT feature, CAST(covariate_supported AS INTEGER) AS covariate_supported, CAST(meta_supported AS INTEGER) AS meta_supported,
  CAST(loco_robust AS INTEGER) AS loco_robust, 0 AS model_supported, CAST(in_context_panel AS INTEGER) AS in_context_panel,
  CAST(external_status='GENUS_MATCH' AS INTEGER) AS external_match FROM emap""", "coarse")
def support_matrix(spark, folder):
    return reports.support_matrix(evidence_rows(spark, folder).evidence)


@register("genus_table", """
SELECT regexp_extract(f.feature,'g__([^|]*)',1) AS genus,
  string_agg(DISTINCT replace(regexp_extract(f.feature,'s__([^|]*)',1),'_',' '), '; ' ORDER BY replace(regexp_extract(f.feature,'s__([^|]*)',1),'_',' ')) AS species,
  CASE WHEN count(s.feature)>0 THEN 'yes' ELSE 'no' END AS among_stable
FROM retained f LEFT JOIN stable s ON s.feature=f.feature GROUP BY 1""", "coarse")
def genus_table(spark, folder):
    a = analysis(spark, folder, "coarse")
    return reports.genus_table(a.features.select("feature", lineage.genus(F.col("feature")).alias("genus")), a.stable)


@register("candidate_table", """
SELECT replace(regexp_extract(a.feature,'s__([^|]*)',1),'_',' ') AS taxon,
  CASE WHEN a.coef>0 THEN 'CRC-higher' WHEN a.coef<0 THEN 'control-higher' ELSE 'zero' END AS direction,
  printf('%.3f (%.3f, %.3f)',a.coef,a.coef-1.96*a.se,a.coef+1.96*a.se) AS coefficient_ci,
  CASE WHEN a.pvalue<0.001 THEN printf('%.2e',a.pvalue) ELSE printf('%.3f',a.pvalue) END AS p_value,
  CASE WHEN a.qvalue<0.001 THEN printf('%.2e',a.qvalue) ELSE printf('%.3f',a.qvalue) END AS q_value,
  printf('%.1f%%',100*prevalence_case) AS case_prevalence, printf('%.1f%%',100*prevalence_control) AS control_prevalence,
  s.same||'/'||s.tested AS same_direction,
  CASE WHEN other_qvalue<0.001 THEN printf('%.2e',other_qvalue) ELSE printf('%.3f',other_qvalue) END AS covariate_q_value,
  'NA' AS selected_folds, score_rank
FROM stable s JOIN assoc a ON a.feature=s.feature JOIN cond_medians d ON d.feature=s.feature
JOIN compared c ON c.feature=s.feature JOIN composite x ON x.feature=s.feature""", "coarse")
def candidate_table(spark, folder):
    a = scored(spark, folder)
    rows = (a.stable.select("feature", "cohorts_same_direction", "cohorts_tested")
            .join(a.association.select("feature", "direction", "coef", "se", "pvalue", "qvalue"), "feature")
            .join(stability.condition_medians(a.samples, a.abundance, a.features).select(
                "feature", "prevalence_case", "prevalence_control"), "feature", "left")
            .join(a.scored.select("feature", "other_qvalue", "selected_fraction", "score_rank"), "feature", "left"))
    return reports.candidate_table(rows)


def performance_rows(folds, predictions):
    """The report's counts with AUROC, its bootstrap interval and average precision as numbers."""
    intervals = settle(resample.bootstrap_auroc(predictions, ["held_out"], "probability", "condition", BOOT, SEED))
    numbers = folds.select("held_out", "auroc", "average_precision").join(
        intervals.select("held_out", "ci_low", "ci_high"), "held_out", "left")
    return reports.performance_table(folds, intervals).drop("average_precision").join(numbers, "held_out").select(
        "held_out", "n_train", "n_test", "classes_in_test", *[_r(c, 4) for c in ("auroc", "ci_low", "ci_high", "average_precision")],
        "replicates_used", "status")


@register("performance_table")
def performance_table(spark, folder):
    """Held-out results with bootstrap intervals (no SQL: iterative fits)."""
    a = loso_results(spark, folder)
    scored_rows = settle(a.loso_predictions.filter("panel = 'all_features'").select(
        F.col("cohort").alias("held_out"), "sample_id", "condition", F.round("probability", 6).alias("probability")))
    return performance_rows(a.loso.filter("panel = 'all_features'"), scored_rows)


CTE["claims"] = "SELECT 'C'||CAST(n_nationkey AS VARCHAR) AS claim_id, n_name AS claim_text FROM nation"
CTE["claim_values"] = """SELECT 'C'||CAST(c_nationkey+5 AS VARCHAR) AS claim_id,
  CASE WHEN c_acctbal<0 THEN 'UNAVAILABLE: negative' ELSE c_name END AS value, c_custkey AS position FROM customer"""


@register("ledger_fill", """
SELECT c.claim_id, claim_text, coalesce(value,'UNAVAILABLE: claim not executed') AS actual_value,
  CASE WHEN coalesce(value,'UNAVAILABLE') LIKE 'UNAVAILABLE%' THEN 'limitation' ELSE 'computed_result' END AS evidence_class
FROM claims c LEFT JOIN (SELECT claim_id, max_by(value, position) AS value FROM claim_values GROUP BY 1) v ON v.claim_id=c.claim_id""")
def ledger_fill(spark, folder):
    """Ledger keys filled with their latest value; keys are shifted, so some of each side find no match."""
    claims = table(spark, folder, "nation").select(
        F.concat(F.lit("C"), F.col("n_nationkey")).alias("claim_id"), F.col("n_name").alias("claim_text"))
    values = table(spark, folder, "customer").select(
        F.concat(F.lit("C"), F.col("c_nationkey") + 5).alias("claim_id"),
        F.when(F.col("c_acctbal") < 0, "UNAVAILABLE: negative").otherwise(F.col("c_name")).alias("value"),
        F.col("c_custkey").alias("position"))
    return evidence.fill_ledger(claims, values)


@register("registry_upsert", """
SELECT p_partkey AS module_id, p_type AS status, 'old' AS origin FROM part WHERE p_partkey NOT IN (SELECT l_partkey*2 FROM lineitem)
UNION ALL SELECT l_partkey*2, 'COMPLETED', 'new' FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def registry_upsert(spark, folder):
    old = table(spark, folder, "part").select(
        F.col("p_partkey").alias("module_id"), F.col("p_type").alias("status"), F.lit("old").alias("origin"))
    new = table(spark, folder, "lineitem").select(
        (F.col("l_partkey") * 2).alias("module_id")).distinct().select(
        "module_id", F.lit("COMPLETED").alias("status"), F.lit("new").alias("origin"))
    return relational.upsert(old, new, "module_id")


@register("republish", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'promotion' ELSE replace(p_type,'AND','and') END AS kind,
  CASE p_name WHEN 'PROMO' THEN 'promotion' ELSE replace(p_name,'AND','and') END AS p_name
FROM part WHERE p_brand NOT LIKE 'Brand#1%'""")
def republish(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    return relational.republish(parts, {"p_type": "kind"}, {"PROMO": "promotion"}, [("AND", "and")],
                                ("p_brand", "Brand#1")).drop("p_brand")


@register("long_text_marker", """
SELECT doc_id, CASE WHEN length(text)>30000 THEN 'SEE FULL TABLE' ELSE md5(text) END AS cell FROM documents""")
def long_text_marker(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = relational.mark_long_text(docs, "text", "SEE FULL TABLE")
    return marked.select("doc_id", F.when(F.col("text") == "SEE FULL TABLE", F.col("text")).otherwise(F.md5("text")).alias("cell"))


@register("lookup_default", """
SELECT n_name, coalesce(v,'none') AS latest_customer FROM nation LEFT JOIN
 (SELECT c_nationkey, max_by(c_name, c_custkey) AS v FROM customer GROUP BY 1) ON c_nationkey+5=n_nationkey""")
def lookup_default(spark, folder):
    pairs = table(spark, folder, "customer").select(
        (F.col("c_nationkey") + 5).alias("n_nationkey"), F.col("c_name").alias("latest_customer"), "c_custkey")
    lookup = relational.latest_per_key(pairs, "n_nationkey", "latest_customer", "c_custkey")
    return relational.look_up(table(spark, folder, "nation"), lookup, "n_nationkey", "latest_customer", "none").select(
        "n_name", "latest_customer")


@register("first_per_key", """
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
  ORDER BY o_orderkey) AS k FROM orders) WHERE k=1""")
def first_per_key(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.first_per_key(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@register("key_match", """
SELECT coalesce(p.p_partkey, c.c_custkey) AS sample_id, CASE WHEN p.p_partkey IS NULL THEN 'left' ELSE 'right' END AS missing_in
FROM part p FULL JOIN customer c ON c.c_custkey=p.p_partkey WHERE p.p_partkey IS NULL OR c.c_custkey IS NULL""")
def key_match(spark, folder):
    """Keys of two tables that lack a partner."""
    left = table(spark, folder, "part").select(F.col("p_partkey").alias("sample_id"))
    right = table(spark, folder, "customer").select(F.col("c_custkey").alias("sample_id"))
    return relational.unmatched_keys(left, right, "sample_id")


@register("foreign_labels", """
SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')""")
def foreign_labels(spark, folder):
    return relational.foreign_labels(table(spark, folder, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("safe_cast", """
SELECT event_type, count(*) AS n, count(TRY_CAST(regexp_extract(props,'"k": ([^}]*)',1) AS DOUBLE)) AS numeric_n,
  round(sum(TRY_CAST(regexp_extract(props,'"k": ([^}]*)',1) AS DOUBLE)),4)+0.0 AS total FROM events GROUP BY 1""")
def safe_cast(spark, folder):
    value = text.safe_number(F.regexp_extract("props", '"k": ([^}]*)', 1))
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("numeric_n"), rounded(F.sum(value), 4).alias("total"))


@register("clip_and_scale", f"""
SELECT c_custkey, {r('least(greatest(c_acctbal/10000,0.0),1.0)')} AS clipped, {r('-log10(greatest(abs(c_acctbal)/1e6,1e-300))')} AS neglog,
  CAST(sign(c_acctbal) AS INTEGER) AS sign FROM customer""")
def clip_and_scale(spark, folder):
    balance = F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        "c_custkey", rounded(clip_unit(balance / 10000)).alias("clipped"),
        rounded(neg_log10(F.abs(balance) / 1e6)).alias("neglog"), F.signum(balance).cast("int").alias("sign"))


@register("column_checks", """
SELECT 'varying' AS check_name, 'c_acctbal,c_mktsegment' AS columns FROM customer GROUP BY 1 HAVING count(DISTINCT c_acctbal)>1 AND count(DISTINCT c_mktsegment)>1""")
def column_checks(spark, folder):
    """Columns that vary, among one constant and two varying ones."""
    rows = table(spark, folder, "customer").withColumn("fixed", F.lit("x"))
    kept = relational.varying_columns(rows, ["fixed", "c_acctbal", "c_mktsegment"])
    return rows.agg(F.lit("varying").alias("check_name"), F.lit(",".join(kept)).alias("columns"))


@register("filled_columns", f"""
SELECT 'filled' AS check_name, CASE WHEN count(*)=count(age) THEN 'age,' ELSE '' END||'bmi,gender' AS columns FROM samples""")
def filled_columns(spark, folder):
    samples = analysis(spark, folder).samples
    kept = relational.filled_columns(samples, ["age", "bmi", "gender"])
    return samples.agg(F.lit("filled").alias("check_name"), F.lit(",".join(kept)).alias("columns"))


@register("complete_cases", f"SELECT cohort, count(*) AS n, sum(condition) AS cases FROM samples WHERE {COMPLETE} GROUP BY 1")
def complete_cases(spark, folder):
    return analysis(spark, folder).samples.na.drop(subset=["age", "bmi", "gender"]).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.sum("condition").alias("cases"))


@register("value_counts", "SELECT condition, count(*) AS n FROM samples GROUP BY 1")
def value_counts(spark, folder):
    return relational.count_by_value(analysis(spark, folder).samples, "condition")


@register("cohort_counts_pivot", """
SELECT cohort, count(*) FILTER (WHERE condition=0) AS control, count(*) FILTER (WHERE condition=1) AS "case" FROM samples GROUP BY 1""")
def cohort_counts_pivot(spark, folder):
    return relational.cohort_condition_pivot(analysis(spark, folder).samples)


@register("ordered_categories", """
SELECT o_orderpriority, list_position(['5-LOW','1-URGENT','3-MEDIUM'],o_orderpriority)::BIGINT AS place, count(*) AS n FROM orders
WHERE o_orderpriority IN ('5-LOW','1-URGENT','3-MEDIUM') GROUP BY 1,2""")
def ordered_categories(spark, folder):
    return relational.by_order_list(table(spark, folder, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"]).groupBy(
        "o_orderpriority", "place").agg(F.count(F.lit(1)).alias("n"))


@register("plot_sample", f"""
SELECT sample_id, cohort FROM samples ORDER BY {draw_sql(SEED, 'sample', 'sample_id')}, sample_id LIMIT 500""")
def plot_sample(spark, folder):
    """The fixed row sample laid over a violin plot."""
    return relational.keyed_sample(analysis(spark, folder).samples, 500, SEED, "sample_id").select("sample_id", "cohort")


@register("covariate_completeness", " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, count({c}) AS non_missing, count(*) AS total, {r(f'count({c})/count(*)')} AS non_missing_fraction, "
    f"count(DISTINCT {c}) AS distinct_values FROM samples" for c in ("age", "gender", "country", "platform")))
def covariate_completeness(spark, folder):
    return tables.completeness(analysis(spark, folder).samples, ["age", "gender", "country", "platform"]).select(
        "covariate", "non_missing", "total", _r("non_missing_fraction"), "distinct_values")


@register("qc_ledger", """
SELECT check_name, CASE WHEN check_name IN ('foreign_labels','negative_values','samples_without_metadata') AND value<>'0' THEN 'FAIL' ELSE 'PASS' END AS status, value
FROM (SELECT CAST(count(*) AS VARCHAR) AS metadata_rows, CAST(count(DISTINCT sample_id) AS VARCHAR) AS metadata_samples,
  CAST(sum(condition) AS VARCHAR) AS case_rows, CAST(sum(1-condition) AS VARCHAR) AS control_rows,
  CAST(count(*) FILTER (WHERE condition NOT IN (0,1)) AS VARCHAR) AS foreign_labels, CAST(count(DISTINCT cohort) AS VARCHAR) AS cohorts,
  (SELECT CAST(count(DISTINCT feature) AS VARCHAR) FROM abund) AS matrix_features,
  (SELECT CAST(count(DISTINCT sample_id) AS VARCHAR) FROM abund) AS matrix_samples,
  (SELECT CAST(count(*) FILTER (WHERE value<0) AS VARCHAR) FROM abund) AS negative_values,
  (SELECT CAST(count(DISTINCT sample_id) AS VARCHAR) FROM abund WHERE sample_id NOT IN (SELECT sample_id FROM samples)) AS samples_without_metadata
 FROM samples) UNPIVOT (value FOR check_name IN (metadata_rows, metadata_samples, case_rows, control_rows, foreign_labels, cohorts,
  matrix_features, matrix_samples, negative_values, samples_without_metadata))""")
def qc_ledger(spark, folder):
    a = analysis(spark, folder)
    return tables.qc_ledger(a.samples, a.abundance)


@register("table_manifest", """
SELECT 'samples' AS table_name, count(*) AS row_count, 'READY' AS status FROM samples
UNION ALL SELECT 'abundance', count(*), 'READY' FROM abund UNION ALL SELECT 'association', count(*), 'READY' FROM assoc""")
def table_manifest(spark, folder):
    a = analysis(spark, folder)
    return tables.table_manifest({"samples": a.samples, "abundance": a.abundance, "association": a.association})


def scratch(spark, name):
    """A path of its own for every call: results are read lazily."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}-{name}"


@register("tsv_roundtrip", f"SELECT sample_id, cohort, condition, {r('age', 2)} AS age FROM samples")
def tsv_roundtrip(spark, folder):
    """Sample metadata written as gzip TSV and read back with its schema."""
    path = tables.write_tsv(analysis(spark, folder).samples.select("sample_id", "cohort", "condition", "age"),
                            scratch(spark, "metadata.tsv"), gzip=True)
    return tables.read_tsv(spark, path, "sample_id bigint, cohort string, condition int, age double", partitions=8).select(
        "sample_id", "cohort", "condition", _r("age", 2))


@register("csv_roundtrip", f"SELECT feature, {r('prevalence')} AS prevalence, cohorts_present FROM landscape")
def csv_roundtrip(spark, folder):
    path = tables.write_csv(analysis(spark, folder).landscape.select("feature", "prevalence", "cohorts_present"),
                            scratch(spark, "landscape.csv"))
    return tables.read_csv(spark, path, "feature string, prevalence double, cohorts_present bigint").select(
        "feature", _r("prevalence"), "cohorts_present")


@register("wide_matrix_scan", f"""
SELECT fine_cohort AS sample_id, p_type AS feature, {r('sum(quantity)', 2)} AS value
FROM lines l JOIN samples s ON s.sample_id=l.sample_id GROUP BY 1,2""")
def wide_matrix_scan(spark, folder):
    """A features x samples TSV (part kind x nation), unpivoted as it is read."""
    a = analysis(spark, folder)
    nations = [row[0] for row in table(spark, folder, "nation").select("n_name").orderBy("n_name").collect()]
    quantity = (table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
                .join(a.samples.select("sample_id", "fine_cohort"), F.col("o_custkey") == F.col("sample_id")))
    wide = quantity.groupBy(F.col("p_type").alias("taxon")).pivot("fine_cohort", nations).agg(F.sum("l_quantity")).na.fill(0.0)
    path = tables.write_tsv(wide, scratch(spark, "matrix.tsv"))
    return tables.read_wide_matrix(spark, path, "taxon").select("sample_id", "feature", _r("value", 2))


@register("bundle_roundtrip", f"""
SELECT 'association' AS source, count(*) AS row_count, {r('sum(coef)')} AS total FROM assoc
UNION ALL SELECT 'landscape', count(*), {r('sum(prevalence)')} FROM landscape""")
def bundle_roundtrip(spark, folder):
    a = analysis(spark, folder)
    paths = tables.write_bundle({"association": a.association, "landscape": a.landscape}, scratch(spark, "bundle"))
    first = tables.required(paths["association"], spark).agg(F.count(F.lit(1)).alias("row_count"), rounded(F.sum("coef")).alias("total"))
    second = tables.required(paths["landscape"], spark).agg(F.count(F.lit(1)).alias("row_count"), rounded(F.sum("prevalence")).alias("total"))
    return first.select(F.lit("association").alias("source"), "*").unionByName(second.select(F.lit("landscape").alias("source"), "*"))


@register("json_manifest", """
SELECT key, value FROM (SELECT CAST(count(*) AS VARCHAR) AS samples, CAST(sum(condition) AS VARCHAR) AS cases FROM samples)
UNPIVOT (value FOR key IN (samples, cases))""")
def json_manifest(spark, folder):
    facts = analysis(spark, folder).samples.agg(F.count(F.lit(1)).alias("n"), F.sum("condition").alias("c")).first()
    path = tables.write_manifest({"samples": facts["n"], "cases": facts["c"]}, spark, scratch(spark, "manifest.json"))
    return spark.read.json(path).select("key", "value")


@register("lineage_ranks", """
SELECT feature, regexp_extract(feature,'g__([^|]*)',1) AS genus, replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ') AS species,
  regexp_extract(feature,'f__([^|]*)',1) AS family, replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ') AS species_tail,
  regexp_extract(feature,'g__([^|]*)',1) AS genus_tail, regexp_extract(feature,'k__([^|]*)',1) AS kingdom FROM landscape""")
def lineage_ranks(spark, folder):
    f = F.col("feature")
    return analysis(spark, folder).landscape.select(
        "feature", lineage.genus(f).alias("genus"), lineage.species(f).alias("species"), lineage.mapped_rank(f, "f").alias("family"),
        lineage.species_tail(f).alias("species_tail"), lineage.genus_or_first_word(f).alias("genus_tail"),
        F.try_element_at(lineage.rank_map(f), F.lit("k")).alias("kingdom"))


@register("cohort_characteristics", """
SELECT s.cohort, sum(condition) AS cases, sum(1-condition) AS controls, count(*) AS total, count(age) AS age_non_missing,
  printf('%.1f (%.1f-%.1f)',median(age),quantile_cont(age,0.25),quantile_cont(age,0.75)) AS age_median_iqr,
  max(g.t) AS gender, max(c.t) AS country FROM samples s
JOIN (SELECT cohort, string_agg(gender||'='||n,'; ' ORDER BY gender) AS t FROM (SELECT cohort, gender, count(*) AS n FROM samples GROUP BY 1,2) GROUP BY 1) g ON g.cohort=s.cohort
JOIN (SELECT cohort, string_agg(country,'; ' ORDER BY country) AS t FROM (SELECT DISTINCT cohort, country FROM samples) GROUP BY 1) c ON c.cohort=s.cohort
GROUP BY 1""")
def cohort_characteristics(spark, folder):
    return reports.cohort_characteristics(analysis(spark, folder).samples, ["age"], ["gender"], ["country"])


@register("volcano", f"""
SELECT feature, {r('coef')} AS coef, {r('-log10(greatest(qvalue,1e-300))', 4)} AS neglog10_q,
  CASE WHEN qvalue<0.10 THEN 'FDR<0.10' ELSE 'not significant' END AS label FROM assoc""")
def volcano(spark, folder):
    return reports.volcano(analysis(spark, folder).association).select("feature", _r("coef"), _r("neglog10_q", 4), "label")


@register("forest", f"""
SELECT feature, replace(regexp_extract(feature,'s__([^|]*)',1),'_',' ') AS label, {r('coef')} AS coef, {r('coef-1.96*se')} AS ci_low,
  {r('coef+1.96*se')} AS ci_high FROM (SELECT * FROM assoc ORDER BY qvalue NULLS LAST, pvalue NULLS LAST, feature LIMIT 14)""")
def forest(spark, folder):
    return reports.forest(analysis(spark, folder).association).select("feature", "label", _r("coef"), _r("ci_low"), _r("ci_high"))


@register("null_histogram", """
SELECT CAST(CASE WHEN hi>lo THEN least(floor((pseudo_f-lo)/((hi-lo)/24))+1,24) ELSE 1 END AS INTEGER) AS bin, count(*) AS n
FROM null_f, (SELECT min(pseudo_f) AS lo, max(pseudo_f) AS hi FROM null_f WHERE perm>0) WHERE perm>0 GROUP BY 1""")
def null_histogram(spark, folder):
    return reports.histogram(permutation_null(spark, folder).filter("perm > 0"), "pseudo_f")


@register("box_quartiles", f"""
SELECT cohort, condition, {r('quantile_cont(bmi,0.25)', 2)} AS first_quartile, {r('median(bmi)', 2)} AS median,
  {r('quantile_cont(bmi,0.75)', 2)} AS third_quartile, count(bmi) AS n, {r('min(bmi)', 2)} AS low, {r('max(bmi)', 2)} AS high
FROM samples GROUP BY 1,2""")
def box_quartiles(spark, folder):
    return reports.quartiles(analysis(spark, folder).samples, ["cohort", "condition"], "bmi").select(
        "cohort", "condition", _r("first_quartile", 2), _r("median", 2), _r("third_quartile", 2), "n", _r("low", 2), _r("high", 2))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register("effect_heatmap", "SELECT feature, " + ", ".join(
    f"""{r(f"avg(effect) FILTER (WHERE cohort='{c}')")} AS "{c}" """ for c in REGIONS)
    + "FROM welch WHERE feature IN (SELECT feature FROM dl_feature ORDER BY pvalue, feature LIMIT 12) GROUP BY 1")
def effect_heatmap(spark, folder):
    """Cohort effects of the twelve features with the smallest random-effect p."""
    a = analysis(spark, folder)
    leading = a.meta.orderBy(F.col("pvalue").asc_nulls_last(), "feature").limit(12)
    out = reports.effect_heatmap(a.welch, leading, REGIONS)
    return out.select("feature", *[_r(c) for c in REGIONS])


@register("filter_lines", """
SELECT prevalence_threshold*100 AS prevalence_percent, retained_features, fdr_lt_0_10, stable_candidates
FROM (""" + sweep_summary("filter_screens") + """) w
JOIN (SELECT DISTINCT prevalence_threshold, min_cohorts_present, config_id FROM filter_config) ON config_id=design_id
WHERE min_cohorts_present=3""", "coarse")
def filter_lines(spark, folder):
    a = analysis(spark, folder, "coarse")
    gaps = stability.cohort_median_gaps(a.samples, a.abundance, a.landscape.select("feature"))
    return reports.filter_lines(sweeps.filter_sweep(a.samples, a.abundance, a.landscape, a.association, gaps,
                                                    SWEEP_PREVALENCE, SWEEP_COHORTS))


@register("pseudocount_lines", """
SELECT TRY_CAST(regexp_extract(design_id,'x_([0-9.]+)',1) AS DOUBLE) AS multiplier, direction_concordance, top_overlap
FROM (""" + sweep_summary("pc_screens") + ")", "coarse")
def pseudocount_lines(spark, folder):
    a = analysis(spark, folder, "coarse")
    out = sweeps.pseudocount_sweep(a.samples, a.abundance, a.features, a.association, a.median_gaps)
    return reports.pseudocount_lines(out).select("multiplier", _r("direction_concordance"), "top_overlap")


@register("overlap_bars", f"""
SELECT panel, reference, median(overlap) AS median_overlap, list_position(['training_only_top','training_only_stability'],panel)::BIGINT AS place FROM (
 SELECT t.design_id, t.panel, g.panel AS reference, (SELECT count(*) FROM training_panel x JOIN global_panel y ON y.feature=x.feature
   WHERE x.design_id=t.design_id AND x.panel=t.panel AND y.panel=g.panel) AS overlap
 FROM (SELECT DISTINCT design_id, panel FROM training_panel) t, (SELECT DISTINCT panel FROM global_panel) g)
WHERE panel IN ('training_only_top','training_only_stability') GROUP BY 1,2""", "coarse")
def overlap_bars(spark, folder):
    a = panel_tables(spark, folder)
    overlap = panels.panel_overlap(a.training_panels, a.global_panels, ["design_id", "panel"])
    return reports.overlap_bars(overlap, ["training_only_top", "training_only_stability"])


@register("combined_panels")
def combined_panels(spark, folder):
    """Leave-one-out and pairwise panel summaries side by side (no SQL: iterative fits)."""
    pair_results(spark, folder)
    a = loso_results(spark, folder)
    out = reports.combined_panels(transfer.leave_one_out_summary(a.loso), transfer.pairwise_summary(a.pairs))
    doubles = [c for c, kind in out.dtypes if kind == "double"]
    return out.select(*[rounded(F.col(c), 4).alias(c) if c in doubles else F.col(c) for c in out.columns])


@register("per_train_cohort")
def per_train_cohort(spark, folder):
    """Range of the off-diagonal AUROC per training cohort (no SQL: iterative fits)."""
    a = pair_results(spark, folder)
    return reports.per_train_cohort(a.pairs.filter("panel = 'all_features'")).select(
        "train_cohort", _r("median", 4), _r("low", 4), _r("high", 4))


@register("member_counts", """
SELECT guild, count(*) AS members, count(*) FILTER (WHERE feature IN (SELECT feature FROM stable)) AS stable_members
FROM guild_members GROUP BY 1""", "coarse")
def member_counts(spark, folder):
    return reports.member_counts(panel_membership(spark, folder))


CTE["doc_rows"] = """SELECT d.doc_id AS sample_id, lang AS cohort, quality AS condition, token FROM (
  SELECT doc_id, lang, unnest(string_split_regex(text,'[ \\n\\t\\r]+')) AS token FROM documents) d
  JOIN labels l ON l.doc_id=d.doc_id WHERE token<>''"""
CTE["doc_values"] = """SELECT sample_id, token AS feature, 100.0*count(*)/sum(count(*)) OVER (PARTITION BY sample_id) AS value FROM doc_rows GROUP BY 1,2"""
CTE["doc_samples"] = "SELECT DISTINCT sample_id, cohort, condition FROM doc_rows"
CTE["doc_kept"] = """SELECT feature FROM doc_values v JOIN doc_samples s ON s.sample_id=v.sample_id GROUP BY 1
  HAVING count(*)*1.0/(SELECT count(*) FROM doc_samples)>=0.05 AND count(DISTINCT cohort)>=1"""
CTE["doc_grid"] = """SELECT s.*, feature, coalesce(value,0.0) AS value, (SELECT min(value)/2 FROM doc_values WHERE feature IN (SELECT feature FROM doc_kept)) AS pc
  FROM doc_samples s CROSS JOIN doc_kept k LEFT JOIN doc_values v USING (sample_id, feature)"""
CTE["doc_clr"] = "SELECT *, ln(value+pc)-avg(ln(value+pc)) OVER (PARTITION BY sample_id) AS clr FROM doc_grid"
CTE["doc_fit"] = bh(ols("SELECT 'ALL' AS design_id, sample_id, feature, cohort, condition, clr FROM doc_clr"))


@register("document_token_screen", f"""
SELECT feature, n1, n0, {r('coef')} AS coef, {r('se')} AS se, {lp('pvalue')} AS log_pvalue, {lp('qvalue')} AS log_qvalue FROM doc_fit""")
def document_token_screen(spark, folder):
    """Tokens of whole documents against the quality label, adjusted for language."""
    a = document_analysis(spark, folder)
    return a.association.select("feature", "n1", "n0", _r("coef"), _r("se"), _lp("pvalue"), _lp("qvalue"))
