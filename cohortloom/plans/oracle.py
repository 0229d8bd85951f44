"""Plain SQL counterparts of the registered queries.

A small catalogue of named CTEs; ``sql`` pulls in what a query needs.  The SQL
works on the dense samples x features rows and by direct formulas, so it checks
the sparse and moment-based plans rather than repeating them.
"""

from __future__ import annotations

import re

from ..functions.stats import normal_two_sided_sql

FINE_NAME = "replace(p_brand,'#','_')"
COARSE_NAME = "split_part(p_name,' ',2)"
CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def sql(body: str, data: str = "fine") -> str:
    """Prefix ``body`` with every catalogued CTE it refers to, in dependency order.

    ``data`` picks the feature granularity of the baskets.
    """
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTE[name].replace(name, ""))
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    chosen = {**CTE, "lines": CTE["lines"].replace(FINE_NAME, COARSE_NAME)} if data == "coarse" else CTE
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({chosen[n]})" for n in order) + "\n" + body


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression},{digits})+0.0"


def lp(expression: str) -> str:
    return f"round(log10(greatest({expression},1e-300)),4)+0.0"


def bh(source: str, p: str = "pvalue", family: str = "", q: str = "qvalue") -> str:
    """Benjamini-Hochberg over ``source`` as a subquery body."""
    part = f"PARTITION BY {family}" if family else ""
    part_null = f"PARTITION BY {family + ',' if family else ''}({p} IS NULL)"
    return (f"SELECT * EXCLUDE (bh_ratio), CASE WHEN {p} IS NULL THEN NULL ELSE least(1.0, min(bh_ratio) OVER "
            f"({part} ORDER BY {p} DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {q} "
            f"FROM (SELECT *, CASE WHEN {p} IS NOT NULL THEN {p}*count({p}) OVER ({part})/"
            f"count(*) OVER ({part_null} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS bh_ratio "
            f"FROM ({source}))")


def ols(source: str, key: str = "feature", score: str = "clr") -> str:
    """Row-level OLS of score on condition + cohort with HC3 errors.

    ``source`` has (design_id, sample_id, <key>, cohort, condition, <score>).
    """
    return f"""SELECT design_id, {key}, count(*) FILTER (WHERE condition=1) AS n1,
      count(*) FILTER (WHERE condition=0) AS n0, max(beta) AS coef,
      sqrt(sum(CASE WHEN d=0 THEN 0 ELSE (d/dd)*(d/dd)*e*e/nullif((1-h)*(1-h),0) END)) AS se,
      {normal_two_sided_sql("z")} AS pvalue
    FROM (SELECT *, beta/nullif(sqrt(sum(CASE WHEN d=0 THEN 0 ELSE (d/dd)*(d/dd)*e*e/nullif((1-h)*(1-h),0) END)
            OVER (PARTITION BY design_id, {key})),0) AS z
     FROM (SELECT *, yc-beta*d AS e, 1.0/n+d*d/dd AS h FROM (
      SELECT *, sum(d*d) OVER w AS dd, sum(d*yc) OVER w/nullif(sum(d*d) OVER w,0) AS beta FROM (
       SELECT *, condition-avg(condition) OVER g AS d, {score}-avg({score}) OVER g AS yc, count(*) OVER g AS n
       FROM ({source}) WINDOW g AS (PARTITION BY design_id, {key}, cohort))
      WINDOW w AS (PARTITION BY design_id, {key}))))
    GROUP BY design_id, {key}, z"""


CTE["lines"] = """SELECT o_custkey AS sample_id, p_type,
  'k__part|p__all|f__'||p_type||'|g__'||p_type||'|s__'||p_type||'_'||replace(p_brand,'#','_') AS feature,
  sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3"""
CTE["line_totals"] = """SELECT sample_id, sum(quantity) AS total,
  sum(CASE WHEN p_type='PROMO' THEN quantity ELSE 0 END) AS promo FROM lines GROUP BY 1"""
CTE["samples"] = """SELECT t.sample_id, r_name AS cohort, n_name AS fine_cohort,
  CASE WHEN promo*6>=total THEN 1 ELSE 0 END AS condition,
  CASE WHEN c_acctbal>=0 THEN c_acctbal END AS age, o.bmi, o.gender, n_name AS country,
  c_mktsegment AS platform, c_acctbal AS score
  FROM line_totals t JOIN customer ON c_custkey=t.sample_id JOIN nation ON c_nationkey=n_nationkey
  JOIN region ON n_regionkey=r_regionkey
  JOIN (SELECT o_custkey, avg(o_totalprice) AS bmi, min_by(o_orderpriority,o_orderkey) AS gender
        FROM orders GROUP BY 1) o ON o.o_custkey=t.sample_id"""
CTE["abund"] = """SELECT l.sample_id, feature, 100*quantity/total AS value
  FROM lines l JOIN line_totals t ON l.sample_id=t.sample_id"""
CTE["full_grid"] = """SELECT s.*, f.feature, coalesce(a.value,0.0) AS value
  FROM samples s CROSS JOIN (SELECT DISTINCT feature FROM abund) f
  LEFT JOIN abund a ON a.sample_id=s.sample_id AND a.feature=f.feature"""
CTE["landscape"] = """SELECT feature, avg(CASE WHEN value>0 THEN 1.0 ELSE 0.0 END) AS prevalence,
  avg(value) AS mean_abundance, max(value) AS max_abundance,
  count(DISTINCT CASE WHEN value>0 THEN cohort END) AS cohorts_present FROM full_grid GROUP BY 1"""
CTE["retained"] = "SELECT feature FROM landscape WHERE prevalence>=0.20 AND cohorts_present>=3"
CTE["grid"] = "SELECT * FROM full_grid WHERE feature IN (SELECT feature FROM retained)"
CTE["clr_grid"] = """SELECT *, ln(value+pc)-avg(ln(value+pc)) OVER (PARTITION BY sample_id) AS clr
  FROM grid CROSS JOIN (SELECT min(value) FILTER (WHERE value>0)/2 AS pc FROM grid)"""
CTE["folds"] = "SELECT DISTINCT cohort AS fold FROM samples"
CTE["pooled_fit"] = ols("SELECT 'ALL' AS design_id, sample_id, feature, cohort, condition, clr FROM clr_grid")
CTE["assoc"] = bh("SELECT * FROM pooled_fit")
CTE["loco_fit"] = bh(ols("SELECT fold AS design_id, sample_id, feature, cohort, condition, clr "
                         "FROM clr_grid JOIN folds ON cohort<>fold"), family="design_id")
