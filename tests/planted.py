"""A small planted data set and direct numpy formulas to compare with."""

import numpy as np
import pandas as pd

COHORTS = {"a": 40, "b": 30, "c": 25, "d": 1}


def planted(seed: int = 7, n_features: int = 12):
    """Samples in four cohorts (one with a single sample) and a sparse matrix with
    two raised features, one absent from cohort b and one all-zero."""
    rng = np.random.default_rng(seed)
    rows = []
    for cohort, n in COHORTS.items():
        for _ in range(n):
            rows.append((len(rows), cohort, int(rng.random() < 0.5)))
    meta = pd.DataFrame(rows, columns=["sample_id", "cohort", "condition"])
    meta["age"] = np.where(rng.random(len(meta)) < 0.1, np.nan, rng.normal(60, 9, len(meta)).round(2))
    meta["bmi"] = rng.normal(25, 3, len(meta)).round(2)
    meta["gender"] = rng.choice(["f", "m"], len(meta))
    x = rng.gamma(1.0, 2.0, (len(meta), n_features)).round(3)
    x[rng.random(x.shape) < 0.35] = 0.0
    x[meta.condition == 1, 0] *= 6
    x[meta.condition == 0, 1] *= 5
    x[meta.cohort == "b", 2] = 0.0
    x[:, n_features - 1] = 0.0
    names = [f"k__x|f__F{i % 3}|g__G{i % 4}|s__G{i % 4}_s{i:02d}" for i in range(n_features)]
    return meta, pd.DataFrame(x, columns=names)


def tables(spark, meta: pd.DataFrame, x: pd.DataFrame):
    samples = spark.createDataFrame(
        [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in row) for row in meta.itertuples(index=False)],
        "sample_id long, cohort string, condition int, age double, bmi double, gender string")
    long = [(int(s), f, float(x.loc[i, f])) for i, s in enumerate(meta.sample_id) for f in x.columns if x.loc[i, f] > 0]
    return samples, spark.createDataFrame(long, "sample_id long, feature string, value double")


def dense_clr(x: pd.DataFrame, features: list[str]) -> np.ndarray:
    kept = x[features].to_numpy()
    logs = np.log(kept + kept[kept > 0].min() / 2)
    return logs - logs.mean(axis=1, keepdims=True)


def dummies(values) -> np.ndarray:
    levels = sorted(set(values))[1:]
    return np.array([[float(v == level) for level in levels] for v in values]).reshape(len(values), len(levels))


def ols_hc3(y: np.ndarray, design: np.ndarray, column: int) -> tuple[float, float]:
    inverse = np.linalg.pinv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    h = np.einsum("ij,jk,ik->i", design, inverse, design)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(np.abs(1 - h) < 1e-10, 0.0, (e / (1 - h)) ** 2)
    return float(beta[column]), float(np.sqrt((inverse @ (design.T * w) @ design @ inverse)[column, column]))


def auroc(label: np.ndarray, score: np.ndarray) -> float:
    pos, neg = score[label == 1], score[label == 0]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))


def average_precision(label: np.ndarray, score: np.ndarray) -> float:
    total, last = 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        chosen = score >= cut
        recall = label[chosen].sum() / label.sum()
        total += (recall - last) * label[chosen].mean()
        last = recall
    return total


def bh(p: np.ndarray) -> np.ndarray:
    n, order = len(p), np.argsort(p)
    q = np.empty(n)
    running = 1.0
    for place in range(n - 1, -1, -1):
        running = min(running, p[order[place]] * n / (place + 1))
        q[order[place]] = running
    return q
