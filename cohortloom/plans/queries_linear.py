"""Queries: covariate screens, variance shares, ordination and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.stats import log_p, normal_two_sided_sql, rounded
from ..operators import composition, linear, moments, permutation, resample
from ..operators.ranking import bh_adjust
from ..session import settle
from .oracle import CTE, bh, lp, r
from .registry import analysis, register
from .vectors import vector_scores

SEED = 20240501
PERMUTATIONS, TERM_PERMUTATIONS = 4999, 999


def _r(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


COMPLETE = "age IS NOT NULL AND bmi IS NOT NULL AND gender IS NOT NULL"
GENDER_LEVELS = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PLATFORM_LEVELS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
COHORT_LEVELS = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def dummies(column: str, levels) -> list[tuple[str, str]]:
    return [(f"{column}{i}", f"CAST({column}='{level}' AS DOUBLE)") for i, level in enumerate(levels)]


AGE, BMI, CASE = ("age", "age"), ("bmi", "bmi/1000"), ("cond", "CAST(condition AS DOUBLE)")
GENDER, PLATFORM, COHORT = (dummies("gender", GENDER_LEVELS), dummies("platform", PLATFORM_LEVELS),
                            dummies("cohort", COHORT_LEVELS))


def orthogonal(prefix: str, columns: list[tuple[str, str]], group: str, where: str) -> list[str]:
    """CTEs that centre the columns in ``group`` and orthogonalise them in order."""
    names = [c for c, _ in columns]
    CTE[f"{prefix}_0"] = "SELECT sample_id, {g} AS g, {cols}, count(*) OVER (PARTITION BY {g}) AS n_g FROM samples WHERE {w}".format(
        g=group, w=where, cols=", ".join(f"({e})-avg({e}) OVER (PARTITION BY {group}) AS q_{c}" for c, e in columns))
    for i, c in enumerate(names[:-1]):
        rest = ", ".join(
            f"q_{k}-q_{c}*sum(q_{k}*q_{c}) OVER ()/sum(q_{c}*q_{c}) OVER () AS q_{k}" for k in names[i + 1:])
        done = ", ".join(f"q_{k}" for k in names[:i + 1])
        CTE[f"{prefix}_{i + 1}"] = f"SELECT sample_id, g, n_g, {done}, {rest} FROM {prefix}_{i}"
    squares = "+".join(f"q_{c}*q_{c}/sum(q_{c}*q_{c}) OVER ()" for c in names)
    CTE[f"{prefix}_basis"] = (f"SELECT *, 1.0/n_g+{squares} AS h, "
                              + ", ".join(f"sum(q_{c}*q_{c}) OVER () AS s_{c}" for c in names)
                              + f" FROM {prefix}_{len(names) - 1}")
    return names


def covariate_fit(prefix: str, names: list[str]) -> str:
    """Condition (last column) with HC3 errors on an orthogonal basis."""
    fitted = "+".join(f"q_{c}*sum(q_{c}*yc) OVER f/s_{c}" for c in names)
    return f"""SELECT feature, coef, se, {normal_two_sided_sql('(coef/se)')} AS pvalue FROM (
      SELECT feature, max(beta) AS coef, sqrt(sum((q_cond/s_cond)*(q_cond/s_cond)*e*e/((1-h)*(1-h)))) AS se FROM (
       SELECT *, yc-({fitted}) AS e, sum(q_cond*yc) OVER f/s_cond AS beta FROM (
        SELECT c.feature, b.*, c.clr-avg(c.clr) OVER (PARTITION BY c.feature, b.g) AS yc
        FROM clr_grid c JOIN {prefix}_basis b ON b.sample_id=c.sample_id)
       WINDOW f AS (PARTITION BY feature)) GROUP BY feature)"""


_cov = orthogonal("cov", [AGE, BMI, *GENDER, CASE], "cohort", COMPLETE)
CTE["covariate_q"] = bh(covariate_fit("cov", _cov))
_ctx = orthogonal("ctx", [AGE, BMI, *GENDER, *PLATFORM, CASE], "country", COMPLETE)
CTE["context_q"] = bh(covariate_fit("ctx", _ctx))

SCREEN_SQL = """SELECT feature, {coef} AS coef, {se} AS se, {p} AS log_pvalue, {q} AS log_qvalue FROM {source}"""


def screen_sql(source: str) -> str:
    return SCREEN_SQL.format(coef=r("coef"), se=r("se"), p=lp("pvalue"), q=lp("qvalue"), source=source)


def covariate_table(spark, folder, data="fine"):
    """The covariate screen of the baskets, kept with the analysis."""
    a = analysis(spark, folder, data)
    if not hasattr(a, "covariate"):
        screens = linear.LinearScreens(a.samples, a.abundance, a.features)
        design = linear.build_design(a.samples, ["age", "bmi"], ["gender", "cohort"])
        a.covariate = settle(bh_adjust(screens.covariate_screen(design), "pvalue", "qvalue"))
    return a.covariate


def _screen_columns(df):
    return df.select("feature", _r("coef"), _r("se"), log_p(F.col("pvalue")).alias("log_pvalue"),
                     log_p(F.col("qvalue")).alias("log_qvalue"))


@register("covariate_screen", screen_sql("covariate_q"))
def covariate_screen(spark, folder):
    return _screen_columns(covariate_table(spark, folder))


@register("context_screen", screen_sql("context_q"))
def context_screen(spark, folder):
    """Country and platform instead of the cohort."""
    a = analysis(spark, folder)
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    design = linear.build_design(a.samples, ["age", "bmi"], ["gender", "country", "platform"])
    return _screen_columns(bh_adjust(screens.covariate_screen(design), "pvalue", "qvalue"))


@register("model_feasibility", """
SELECT 'cohort_adjusted' AS model_id, 'COMPUTED' AS status, count(*) AS samples, count(DISTINCT cohort)+1 AS design_rank,
  count(DISTINCT cohort)+1 AS design_columns FROM samples
UNION ALL SELECT 'cohort_age_bmi_gender', 'COMPUTED', count(*), count(DISTINCT cohort)+count(DISTINCT gender)+2,
  count(DISTINCT cohort)+count(DISTINCT gender)+2 FROM samples WHERE """ + COMPLETE + """
UNION ALL SELECT 'country_platform_no_cohort', 'COMPUTED_CONTEXT_ONLY', count(*),
  count(DISTINCT country)+count(DISTINCT gender)+count(DISTINCT platform)+1,
  count(DISTINCT country)+count(DISTINCT gender)+count(DISTINCT platform)+1 FROM samples WHERE """ + COMPLETE)
def model_feasibility(spark, folder):
    """Samples, rank and columns of every design."""
    a = analysis(spark, folder)
    designs = (("cohort_adjusted", "COMPUTED", [], ["cohort"]),
               ("cohort_age_bmi_gender", "COMPUTED", ["age", "bmi"], ["gender", "cohort"]),
               ("country_platform_no_cohort", "COMPUTED_CONTEXT_ONLY", ["age", "bmi"], ["gender", "country", "platform"]))
    parts = []
    for model, status, numeric, categorical in designs:
        design = linear.build_design(a.samples, numeric, categorical)
        rank = linear.cross_rank(linear.gram(design.rows))
        parts.append(design.rows.agg(F.count(F.lit(1)).alias("samples")).select(
            F.lit(model).alias("model_id"), F.lit(status).alias("status"), "samples",
            F.lit(rank).cast("bigint").alias("design_rank"), F.lit(len(design.names)).cast("bigint").alias("design_columns")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shares_of(prefix: str, names: list[str]) -> str:
    """Sum over features of the squares each orthogonal column explains, and the total."""
    per_feature = ", ".join(f"sum(q_{c}*clr) AS p_{c}, max(s_{c}) AS s_{c}" for c in names)
    return (f"SELECT {', '.join(f'sum(p_{c}*p_{c}/s_{c}) AS ss_{c}' for c in names)}, sum(tss) AS tss, sum(cohort_ss) AS cohort_ss, "
            f"max(n) AS n FROM (SELECT feature, {per_feature}, var_pop(clr)*count(*) AS tss, count(*) AS n, "
            f"(SELECT 0.0) AS cohort_ss FROM clr_grid c JOIN {prefix}_basis b ON b.sample_id=c.sample_id GROUP BY feature)")


def cohort_ss(where: str) -> str:
    return f"""SELECT sum(n*(m-g)*(m-g)) AS ss, sum(within+n*(m-g)*(m-g)) AS tss FROM (
      SELECT feature, cohort, count(*) AS n, avg(clr) AS m, var_pop(clr)*count(*) AS within,
       max(g) AS g FROM (SELECT *, avg(clr) OVER (PARTITION BY feature) AS g FROM clr_grid WHERE {where})
      GROUP BY feature, cohort)"""


_all = orthogonal("vall", [CASE], "cohort", "true")
CTE["vall_ss"] = shares_of("vall", _all)
CTE["vall_cohort"] = cohort_ss("true")
CTE["vcc_cohort"] = cohort_ss(COMPLETE)
ORDERS = {
    "vage": ([CASE, BMI, *GENDER, AGE], "cohort"), "vbmi": ([CASE, AGE, *GENDER, BMI], "cohort"),
    "vgen": ([CASE, AGE, BMI, *GENDER], "cohort"), "vcas": ([AGE, BMI, *GENDER, CASE], "cohort"),
    "vcoh": ([CASE, AGE, BMI, *GENDER, *COHORT], "1"), "vseq": ([CASE, AGE, BMI, *GENDER], "cohort")}
for _prefix, (_columns, _group) in ORDERS.items():
    CTE[f"{_prefix}_ss"] = shares_of(_prefix, orthogonal(_prefix, _columns, _group, COMPLETE))


def total_of(names) -> str:
    return "+".join(f"ss_{c}" for c, _ in names)


def share_row(term: str, gain: str, full: str, df: int, rank: int, source: str, extra: str) -> str:
    return (f"SELECT '{term}' AS term, {extra}, {df} AS df_term, CAST(n-{rank} AS INTEGER) AS df_residual, "
            f"{gain}/tss AS share, (({gain})/{df})/((tss-({full}))/(n-{rank})) AS pseudo_f FROM {source}")


_with_cohort = "(SELECT a.* EXCLUDE (tss), c.ss AS base, c.tss FROM {p}_ss a, {c} c)"
_scope = "'complete_case_covariates' AS model_scope, CAST(n AS INTEGER) AS n_samples"
_allscope = "'all_samples' AS model_scope, CAST(n AS INTEGER) AS n_samples"
_parts = [
    share_row("cohort", "base", "base", 4, 5, _with_cohort.format(p="vall", c="vall_cohort"), _allscope),
    share_row("condition", "ss_cond", "base+ss_cond", 1, 6, _with_cohort.format(p="vall", c="vall_cohort"), _allscope),
    share_row("age", "ss_age", "base+" + total_of(ORDERS["vage"][0]), 1, 12, _with_cohort.format(p="vage", c="vcc_cohort"), _scope),
    share_row("bmi", "ss_bmi", "base+" + total_of(ORDERS["vbmi"][0]), 1, 12, _with_cohort.format(p="vbmi", c="vcc_cohort"), _scope),
    share_row("gender", "(" + total_of(GENDER) + ")", "base+" + total_of(ORDERS["vgen"][0]), 4, 12,
              _with_cohort.format(p="vgen", c="vcc_cohort"), _scope)]


def share_objects(spark, folder):
    a = analysis(spark, folder)
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    complete = linear.build_design(a.samples, ["age", "bmi"], ["gender", "cohort"], ddof=0, scale_on_all=False)
    return a, screens, complete


@register("variance_partition_marginal", f"""
SELECT term, model_scope, n_samples, df_term, df_residual, {r('100*share')} AS partial_r2_percent, {r('pseudo_f')} AS pseudo_f
FROM ({' UNION ALL '.join(_parts)})""")
def variance_partition_marginal(spark, folder):
    a, screens, complete = share_objects(spark, folder)
    whole = linear.build_design(a.samples, [], ["cohort"])
    table = linear.marginal_partition(screens.shares(whole), screens.shares(complete), ["age", "bmi", "gender"])
    return table.select("term", "model_scope", "n_samples", "df_term", "df_residual", _r("partial_r2_percent"), _r("pseudo_f"))


def seq_row(term: str, first: str, last: str, full: str, df: int, source: str) -> str:
    return (f"SELECT '{term}' AS term, {first}/tss AS r2, ({last})/tss AS deletion, "
            f"(({last})/{df})/((tss-({full}))/(n-12)) AS pseudo_f, {df} AS df_term, CAST(n-12 AS INTEGER) AS df_residual, "
            f"CAST(n AS INTEGER) AS sample_n FROM {source}")


def _pair(p: str) -> str:
    return f"(SELECT a.* EXCLUDE (tss), c.ss AS base, c.tss, {', '.join(f's.ss_{c} AS first_{c}' for c, _ in ORDERS['vseq'][0])} FROM {p}_ss a, vcc_cohort c, vseq_ss s)"


_seq = [
    seq_row("cohort", "base", total_of(COHORT), total_of(ORDERS["vcoh"][0]), 4, _pair("vcoh")),
    seq_row("condition", "first_cond", "ss_cond", "base+" + total_of(ORDERS["vcas"][0]), 1, _pair("vcas")),
    seq_row("age", "first_age", "ss_age", "base+" + total_of(ORDERS["vage"][0]), 1, _pair("vage")),
    seq_row("bmi", "first_bmi", "ss_bmi", "base+" + total_of(ORDERS["vbmi"][0]), 1, _pair("vbmi")),
    seq_row("gender", "(" + "+".join(f"first_{c}" for c, _ in GENDER) + ")", total_of(GENDER),
            "base+" + total_of(ORDERS["vgen"][0]), 4, _pair("vgen")),
    "SELECT 'residual', (tss-(base+" + total_of(ORDERS["vseq"][0]) + "))/tss, NULL, NULL, NULL, CAST(n-12 AS INTEGER), "
    "CAST(n AS INTEGER) FROM " + _with_cohort.format(p="vseq", c="vcc_cohort")]


@register("variance_partition_sequential", f"""
SELECT term, {r('r2', 7)} AS r2, {r('deletion', 7)} AS term_deletion_r2, {r('pseudo_f')} AS pseudo_f, df_term, df_residual,
  sample_n FROM ({' UNION ALL '.join(_seq)})""")
def variance_partition_sequential(spark, folder):
    _, screens, complete = share_objects(spark, folder)
    table = linear.sequential_partition(screens.shares(complete), ["cohort", "condition", "age", "bmi", "gender"])
    return table.select("term", _r("r2", 7), _r("term_deletion_r2", 7), _r("pseudo_f"), "df_term", "df_residual", "sample_n")


@register("variance_partition_permutation")
def variance_partition_permutation(spark, folder):
    """Permutation p of every term given the others (no SQL: one model per draw)."""
    a, screens, complete = share_objects(spark, folder)
    shares = screens.shares(complete)
    ordered = settle(linear.ordered_rows(complete, SEED)).select("sample_id", "z", "_k")
    study = linear.PermutationStudy(shares, composition.dense_clr(ordered, a.abundance, a.features))
    terms = ["cohort", "condition", "age", "bmi", "gender"]
    others = {term: [t for t in terms if t != term] for term in terms}
    null = study.nulls([(term, others[term], term == "condition") for term in terms], TERM_PERMUTATIONS, SEED)
    observed = spark.createDataFrame([(term, shares.term(term, others[term])["pseudo_f"]) for term in terms], "term string, observed double")
    return resample.empirical_p(settle(null).join(observed, "term"), F.col("observed"), "pseudo_f", ["term", "observed"]).select(
        "term", rounded(F.col("observed")).alias("pseudo_f"), "replicates", _r("empirical_p"))


@register("pca_scores")
def pca_scores(spark, folder):
    """First two components of the CLR (no SQL: an eigenproblem)."""
    a = analysis(spark, folder)
    profiles = composition.dense_clr(a.samples, a.abundance, a.features).select("sample_id", "cohort", "condition", "x")
    return linear.principal_components(profiles).select(
        "sample_id", "cohort", "condition", _r("PC1", 4), _r("PC2", 4), _r("PC1_ratio", 4), _r("PC2_ratio", 4))


CTE["vec"] = """SELECT vec_id AS sample_id, 'c'||CAST(vec_id%5 AS VARCHAR) AS cohort, CASE WHEN label>=5 THEN 1 ELSE 0 END AS condition,
  unnest(range(1,65)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""


@register("pseudo_f_vectors", f"""
SELECT n1, n0, {r('ssb/((sst-ssb)/(n1+n0-2))')} AS pseudo_f FROM (
 SELECT max(n1) AS n1, max(n0) AS n0, sum(n1*(m1-m)*(m1-m)+n0*(m0-m)*(m0-m)) AS ssb, sum(sst) AS sst FROM (
  SELECT dim, count(*) FILTER (WHERE condition=1) AS n1, count(*) FILTER (WHERE condition=0) AS n0,
   avg(v) FILTER (WHERE condition=1) AS m1, avg(v) FILTER (WHERE condition=0) AS m0, avg(v) AS m,
   var_pop(v)*count(*) AS sst FROM vec GROUP BY dim))""")
def pseudo_f_vectors(spark, folder):
    """Two-group pseudo-F on the dense embedding vectors."""
    samples, scores = vector_scores(spark, folder)
    return linear.two_group_pseudo_f(moments.score_moments(samples, scores)).select("n1", "n0", _r("pseudo_f"))


CTE["label_draws"] = f"""SELECT perm, sample_id, cohort, condition,
  CASE WHEN row_number() OVER (PARTITION BY perm, cohort ORDER BY {draw_sql(SEED, 'label', 'perm', 'sample_id')}, sample_id)
   <= sum(condition) OVER (PARTITION BY perm, cohort) THEN 1 ELSE 0 END AS label
  FROM samples, range(1,{PERMUTATIONS + 1}) t(perm)"""
CTE["residual"] = "SELECT sample_id, feature, condition, clr-avg(clr) OVER (PARTITION BY feature, cohort) AS e FROM clr_grid"
CTE["null_f"] = f"""SELECT perm, ssb/((sst-ssb)/(n-2)) AS pseudo_f FROM (
  SELECT perm, sum(s1*s1*(1.0/n1+1.0/(n-n1))) AS ssb, max(n) AS n FROM (
   SELECT perm, feature, sum(e) AS s1, count(*) AS n1, (SELECT count(*) FROM samples) AS n
   FROM (SELECT perm, sample_id FROM label_draws WHERE label=1 UNION ALL SELECT 0, sample_id FROM samples WHERE condition=1) l
   JOIN residual r ON r.sample_id=l.sample_id GROUP BY 1,2) GROUP BY 1), (SELECT sum(e*e) AS sst FROM residual)"""


def permutation_null(spark, folder):
    a = analysis(spark, folder)
    if not hasattr(a, "permutation_null"):
        logs, size = linear.LinearScreens(a.samples, a.abundance, a.features).logs, a.features.count()
        centres = composition.sample_centres(a.samples.select("sample_id"), logs, F.lit(size))
        a.permutation_null = settle(permutation.label_permutation_test(a.samples, settle(logs), settle(centres), size, PERMUTATIONS, SEED))
    return a.permutation_null


@register("permutation_pseudo_f", f"SELECT CAST(perm AS INTEGER) AS perm, {r('pseudo_f')} AS pseudo_f FROM null_f")
def permutation_pseudo_f(spark, folder):
    """Observed (perm 0) and permuted pseudo-F on cohort-centred profiles."""
    return permutation_null(spark, folder).select("perm", _r("pseudo_f"))


@register("empirical_p", f"""
SELECT count(*) FILTER (WHERE perm>0) AS replicates,
  {r('(1.0+count(*) FILTER (WHERE perm>0 AND pseudo_f>=obs))/(count(*) FILTER (WHERE perm>0)+1)')} AS empirical_p
FROM null_f, (SELECT pseudo_f AS obs FROM null_f WHERE perm=0)""")
def empirical_p(spark, folder):
    null = permutation_null(spark, folder)
    observed = null.filter("perm = 0").select("pseudo_f").scalar()
    return resample.empirical_p(null.filter("perm > 0"), observed, "pseudo_f").select("replicates", _r("empirical_p"))


@register("permuted_labels", """
SELECT perm, cohort, count(*) AS n, sum(label) AS n_case, sum(CASE WHEN label=condition THEN 1 ELSE 0 END) AS unchanged,
  sum(CASE WHEN label=1 THEN sample_id ELSE 0 END) AS case_key_sum FROM label_draws GROUP BY 1,2""")
def permuted_labels(spark, folder):
    a = analysis(spark, folder)
    return permutation.label_totals(a.samples, PERMUTATIONS, SEED)


CTE["free_draws"] = f"""SELECT p.perm, p.sample_id, v.age FROM (
  SELECT perm, sample_id, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql(SEED, 'permute_age', 'perm', 'sample_id')}, sample_id) AS k
  FROM samples, range(1,{TERM_PERMUTATIONS + 1}) t(perm)) p JOIN (
  SELECT age, row_number() OVER (ORDER BY {draw_sql(SEED, 'order', 'sample_id')}, sample_id) AS k FROM samples) v ON v.k=p.k"""


@register("permuted_column", f"""
SELECT perm, cohort, count(d.age) AS n, {r('sum(d.age)', 2)} AS total, {r('max(d.age)', 2)} AS top
FROM free_draws d JOIN samples s ON s.sample_id=d.sample_id GROUP BY 1,2""")
def permuted_column(spark, folder):
    """A covariate shuffled over all samples, summarised by the cohort it lands in."""
    a = analysis(spark, folder)
    return resample.permuted_column(a.samples, "age", TERM_PERMUTATIONS, SEED, ["cohort"]).groupBy("perm", "cohort").agg(
        F.count("value").alias("n"), rounded(F.sum("value"), 2).alias("total"), rounded(F.max("value"), 2).alias("top"))


@register("design_moments", f"""
SELECT 'age' AS covariate, count(age) AS n, {r('avg(age)', 4)} AS mean, {r('stddev_samp(age)', 4)} AS sd_sample,
  {r('stddev_pop(age)', 4)} AS sd_population FROM samples
UNION ALL SELECT 'bmi', count(bmi), {r('avg(bmi)', 4)}, {r('stddev_samp(bmi)', 4)}, {r('stddev_pop(bmi)', 4)} FROM samples""")
def design_moments(spark, folder):
    """Mean and both standard deviations behind the z-scores."""
    a = analysis(spark, folder)
    parts = [a.samples.agg(F.count(c).alias("n"), rounded(F.avg(c), 4).alias("mean"),
                           rounded(F.stddev_samp(c), 4).alias("sd_sample"),
                           rounded(F.stddev_pop(c), 4).alias("sd_population")).withColumn("covariate", F.lit(c))
             for c in ("age", "bmi")]
    return parts[0].unionByName(parts[1])
