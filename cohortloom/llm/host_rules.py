"""Host-level quality rules.

Every document is measured by itself; rule failures are counted per host, the
hosts' failure rates are shrunk towards a beta prior fitted to all hosts, and a
host whose shrunk rate reaches the limit takes all its documents with it.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .rows import WORD, map_rows

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
SALTS = 32
POOLED = 1e6  # prior weight where the hosts' rates do not differ

MEASURES = "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _measure() -> object:
    words_of, symbols_of = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall
    has_word = re.compile(WORD).search

    def repeated(words: list[str]) -> int:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        covered, upto = 0, 0  # words before ``upto`` are already counted
        for at, window in enumerate(windows):
            if counts[window] > 1:
                covered += at + 3 - max(at, upto)
                upto = at + 3
        return covered

    def work(columns: list[list]) -> list[tuple]:
        out = []
        for key, host, text in zip(*columns):
            text = text or ""
            words = words_of(text)
            lines = [x for x in text.split("\n") if has_word(x)]
            out.append((key, host, len(words), sum(map(len, words)), len(symbols_of(text)), len(lines) - len(set(lines)), repeated(words)))
        return out

    return work


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row of counts per document (see MEASURES); a NULL text counts as empty."""
    return map_rows(df, {"doc_id": F.col(key), "host": F.col(host), "text": F.col(text)}, MEASURES, _measure)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate): failure rates under an empirical beta prior.

    The prior has the mean m of all documents and the weight m(1-m)/v - 1, v the
    spread of the hosts' rates around m, hosts counted by their documents (method
    of moments).  Where the rates do not differ, the weight is POOLED.
    """
    hosts = settle(measured.filter(F.col("host").isNotNull()).groupBy("host")
                   .agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")))
    mean = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m")).first()["m"]
    if mean is None:
        return hosts.withColumn("shrunk_rate", F.lit(None).cast("double"))
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg((F.sum(F.col("n_docs") * (rate - F.lit(mean)) * (rate - F.lit(mean))) / F.sum("n_docs")).alias("v")).first()["v"]
    weight = min(POOLED, max(0.0, mean * (1 - mean) / spread - 1)) if spread > 0 else POOLED
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base_failed, host_rate and kept for every row.

    * NULL or empty text: all counts 0, base_failed true.
    * NULL host: no host verdict; the document stands by itself (host_rate NULL).
    * NULL key and repeated rows: every row is judged and returned.
    * No rows: no rows.  Other columns are not read.

    The join back is salted, so a host with a large share of all rows is spread
    over SALTS keys; only the counts move, never the texts.
    """
    measured = settle(measure(df, key, text, host).withColumn("base_failed", base_failed()))
    rates = host_rates(measured).select("host", "shrunk_rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    bad_host = F.coalesce(F.col("shrunk_rate") >= limit, F.lit(False))
    return (salted.join(rates, ["host", "salt"], "left")
            .withColumn("kept", ~F.col("base_failed") & ~bad_host)
            .withColumnRenamed("shrunk_rate", "host_rate").drop("salt"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text,'') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*)-count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY r),
windows AS (SELECT r, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws)-1)) AS i FROM w)),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM found WHERE n > 1) GROUP BY r),
counts AS (SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100*n_repeat_words > {REPEAT_PERCENT}*n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
mean AS (SELECT sum(f)/sum(n) AS m FROM hosts),
spread AS (SELECT m, sum(n*(f/n-m)*(f/n-m))/sum(n) AS v FROM hosts, mean GROUP BY m),
prior AS (SELECT m, CASE WHEN v > 0 THEN least({POOLED}, greatest(0, m*(1-m)/v-1)) ELSE {POOLED} END AS weight FROM spread),
rates AS (SELECT source, (f+m*weight)/(n+weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(rate >= {HOST_LIMIT}, false) AS kept
FROM judged LEFT JOIN rates USING (source)
"""
