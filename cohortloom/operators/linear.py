"""Multivariate linear models on the CLR through cross-product sums.

A design has few columns (p), so Z'Z is p x p.  One pass over the non-zero rows
gives Z'y for every feature as an array of p sums, because absent pairs enter as
``-s`` of their sample.  Coefficients, HC3 errors, residual sums of squares and
variance shares follow from these sums; no residual matrix is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import by_length, draw
from ..functions.stats import normal_two_sided
from ..session import settle, spread
from .composition import keep_features, pseudocount, shifted_logs
from .ranking import row_numbers
from .resample import DRAWS_TOGETHER, PIECE, by_permutations, draws_in_turn, order_of, packed_pieces, unpacked


@dataclass(frozen=True)
class Design:
    """Rows (sample_id, cohort, z) and the term every column of ``z`` belongs to."""

    rows: DataFrame
    names: tuple[str, ...]
    terms: tuple[str, ...]

    def columns_of(self, terms: Sequence[str]) -> list[int]:
        return [i for i, t in enumerate(self.terms) if t == "const" or t in terms]


def vector_sum(array: Column) -> Column:
    """Element-wise sum of an array column as an aggregate with map-side combining."""
    return vector_to_array(Summarizer.sum(array_to_vector(array)))


def build_design(samples: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                 ddof: int = 1, scale_on_all: bool = True) -> Design:
    """Constant, condition, z-scored numerics and dummies (first level dropped).

    Only complete rows enter.  z-scores use all samples or the complete ones, with
    divisor n - ddof; a constant column is dropped, as is a numeric without spread.
    """
    names = [*numeric, *categorical]
    complete = samples.na.drop(subset=names) if names else samples
    base = samples if scale_on_all else complete
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    facts = [spread(c).alias(f"sd_{c}") for c in numeric] + [F.avg(c).alias(f"mean_{c}") for c in numeric]
    scale = base.agg(*facts).first() if facts else None
    found = complete.agg(F.min("condition").alias("lo"), F.max("condition").alias("hi"), *[
        F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in categorical]).first()
    columns, labels, terms = [F.lit(1.0)], ["const"], ["const"]
    if found["lo"] != found["hi"]:
        columns.append(F.col("condition").cast("double"))
        labels.append("condition")
        terms.append("condition")
    for c in numeric:
        if scale[f"sd_{c}"]:
            columns.append((F.col(c) - scale[f"mean_{c}"]) / scale[f"sd_{c}"])
            labels.append(f"{c}_z")
            terms.append(c)
    for c in categorical:
        for level in found[c][1:]:
            columns.append((F.col(c).cast("string") == level).cast("double"))
            labels.append(f"{c}_{level}")
            terms.append(c)
    return Design(complete.select("sample_id", "cohort", "condition", F.array(*columns).alias("z")),
                  tuple(labels), tuple(terms))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _per_task(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of an array made from each; a task sends one row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    return np.asarray(rows.mapInArrow(partial, "v array<double>").agg(vector_sum(F.col("v")).alias("v")).first()["v"])


def gram(rows: DataFrame, array: str = "z") -> np.ndarray:
    """Cross products of an array column, p x p."""
    def cross(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch.column(0))
        return (z.T @ z).ravel()

    values = _per_task(rows.select(array), cross)
    size = int(round(len(values) ** 0.5))
    return values.reshape(size, size)


def cross_rank(cross: np.ndarray) -> int:
    """Rank of a design from its cross products, columns scaled to unit length."""
    scale = np.sqrt(np.where(np.diag(cross) > 0, np.diag(cross), 1.0))
    return int(np.linalg.matrix_rank(cross / np.outer(scale, scale), tol=1e-10, hermitian=True))


def _inverse(cross: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cross, rcond=1e-12, hermitian=True)


def _products(design_rows: DataFrame, logs: DataFrame, features: DataFrame, weighted: bool) -> DataFrame:
    """(feature, v): [Z'y, y'y] and, weighted, [Z'Wy, y'Wy] behind it.

    ``design_rows`` carries sample_id, z and, weighted, w.  The non-zero rows of a
    sample meet its design row once, so no row carries a design of its own; a task
    sends one row per feature it holds, and one (place -1) for the absent pairs.
    """
    names = features.agg(F.array_sort(F.collect_list("feature")).alias("_names"))
    places = names.select(F.posexplode("_names").alias("_i", "feature"))
    width = features.count()
    entries = logs.join(places, "feature").groupBy("sample_id").agg(F.collect_list(F.struct("_i", "u")).alias("_e"))
    rows = design_rows.withColumn("_w", F.col("w") if weighted else F.lit(1.0)).join(entries, "sample_id", "left").select(
        "z", "_w", F.coalesce(F.col("_e._i"), F.array().cast("array<int>")).alias("_at"),
        F.coalesce(F.col("_e.u"), F.array().cast("array<double>")).alias("_u"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            z, w, at, u = matrix(batch["z"]), batch["_w"].to_numpy(), batch["_at"].flatten().to_numpy(), batch["_u"].flatten().to_numpy()
            line = np.repeat(np.arange(n), np.diff(batch["_at"].offsets.to_numpy()))
            s = np.bincount(line, u, n) / max(width, 1)
            square, own = u * u - 2 * u * s[line], np.column_stack([z * s[:, None], -s * s])
            if found is None:
                p = z.shape[1]
                found, base = np.zeros((width, (p + 1) * (1 + weighted))), np.zeros((p + 1) * (1 + weighted))
            for j in range(p):
                found[:, j] += np.bincount(at, u * z[line, j], width)
            found[:, p] += np.bincount(at, square, width)
            base[:p + 1] += own.sum(0)
            if weighted:
                heavy = u * w[line]
                for j in range(p):
                    found[:, p + 1 + j] += np.bincount(at, heavy * z[line, j], width)
                found[:, 2 * p + 1] += np.bincount(at, square * w[line], width)
                base[p + 1:] += w @ own
        if found is not None:
            held = np.flatnonzero(found.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()),
                                              pa.array([base, *found[held]], pa.list_(pa.float64()))], ["_i", "_f"])

    sums = settle(rows.mapInArrow(partial, "_i int, _f array<double>").groupBy("_i").agg(vector_sum(F.col("_f")).alias("_f")))
    joined = places.join(sums, "_i", "left").withColumn("_b", sums.filter("_i = -1").select("_f").scalar())
    empty = F.transform("_b", lambda v: F.lit(0.0))
    return joined.select("feature", F.zip_with(F.coalesce("_f", empty), F.col("_b"), lambda a, b: a - b).alias("v"))


def score_screen(design: Design, scores: DataFrame) -> DataFrame:
    """The covariate screen for dense scores ``(sample_id, feature, score)``."""
    rows = settle(design.rows)
    inverse = _inverse(gram(rows))
    weights = settle(_with_weights(rows, inverse, design))
    meat, unknown, n = _meat(weights, inverse)
    y, w = F.col("score"), F.nanvl("w", F.lit(0.0))
    stacked = F.concat(F.transform("z", lambda v: v * y), F.array(y * y),
                       F.transform("z", lambda v: v * y * w), F.array(y * y * w))
    products = weights.join(scores, "sample_id").groupBy("feature").agg(vector_sum(stacked).alias("v"))
    return _fit(products, design, inverse, meat, n, unknown)


def _with_weights(rows: DataFrame, inverse: np.ndarray, design: Design) -> DataFrame:
    kind = rows.schema["sample_id"].dataType.simpleString()
    return rows.mapInPandas(_leverage_weights(inverse, design.names.index("condition")),
                            f"sample_id {kind}, z array<double>, w double")


def _meat(weights: DataFrame, inverse: np.ndarray) -> tuple[np.ndarray, bool, int]:
    """Weighted cross products of the design, whether an error is unknown, and n."""
    def cross(batch: pa.RecordBatch) -> np.ndarray:
        z, w = matrix(batch.column(0)), batch.column(1).to_numpy()
        return np.concatenate([((z * np.nan_to_num(w)[:, None]).T @ z).ravel(), [np.isnan(w).sum(), len(w)]])

    got = _per_task(weights.select("z", "w"), cross)
    return got[:-2].reshape(inverse.shape), got[-2] > 0, int(got[-1])


def _fit(products: DataFrame, design: Design, inverse: np.ndarray, meat: np.ndarray, n: int, unknown: bool) -> DataFrame:
    fitted = products.mapInPandas(_coefficients(inverse, meat, design.names.index("condition"), n, unknown),
                                  "feature string, coef double, se double")
    out = fitted.select("feature", F.nanvl("coef", F.lit(None)).alias("coef"), F.nanvl("se", F.lit(None)).alias("se"))
    return (out.withColumn("_z", F.col("coef") / F.nullif("se", F.lit(0.0)))
            .withColumn("pvalue", normal_two_sided("_z")).drop("_z"))


class LinearScreens:
    """Screens and variance shares of one data set for chosen designs."""

    def __init__(self, samples: DataFrame, abundance: DataFrame, features: DataFrame):
        kept = keep_features(abundance, features)
        self.samples, self.features = samples, features
        self.logs = shifted_logs(kept, pseudocount(kept).scalar())

    def covariate_screen(self, design: Design) -> DataFrame:
        """Condition coefficient with HC3 error for every feature under the design."""
        rows = settle(design.rows)
        inverse = _inverse(gram(rows))
        weights = settle(_with_weights(rows, inverse, design))
        meat, unknown, n = _meat(weights, inverse)
        products = _products(weights.withColumn("w", F.nanvl("w", F.lit(0.0))), self.logs, self.features, True)
        return _fit(products, design, inverse, meat, n, unknown)

    def shares(self, design: Design) -> "VarianceShares":
        rows = settle(design.rows)
        products = _products(rows, self.logs, self.features, False)
        v = F.slice("v", 1, len(design.names))
        outer = F.flatten(F.transform(v, lambda a: F.transform(v, lambda b: a * b)))
        got = products.agg(vector_sum(outer).alias("m"), F.sum(F.element_at("v", -1)).alias("t")).first()
        p = len(design.names)
        n = rows.agg(F.count(F.lit(1))).first()[0]
        return VarianceShares(design, gram(rows), np.asarray(got["m"]).reshape(p, p), float(got["t"]), n)


def _leverage_weights(inverse: np.ndarray, target: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            z = np.stack(batch["z"].to_numpy())
            solved = z @ inverse
            slack = 1.0 - np.einsum("ij,ij->i", solved, z)
            effect = solved[:, target]
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(np.abs(effect) < 1e-14, 0.0, np.where(slack > 1e-12, (effect / slack) ** 2, np.nan))
            yield pd.DataFrame({"sample_id": batch["sample_id"], "z": batch["z"], "w": w})
    return run


def _coefficients(inverse: np.ndarray, meat: np.ndarray, target: int, n: int, unknown: bool):
    p = inverse.shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch["v"].to_numpy())
            xy, yy, wxy, wyy = v[:, :p], v[:, p], v[:, p + 1:2 * p + 1], v[:, 2 * p + 1]
            beta = xy @ inverse
            variance = wyy - 2 * np.einsum("ij,ij->i", beta, wxy) + np.einsum("ij,jk,ik->i", beta, meat, beta)
            constant = yy - xy[:, 0] ** 2 / n <= 1e-12 * np.maximum(yy, 1e-300)
            se = np.full(len(v), np.nan) if unknown else np.sqrt(np.maximum(variance, 0.0))
            yield pd.DataFrame({"feature": batch["feature"], "coef": np.where(constant, np.nan, beta[:, target]),
                                "se": np.where(constant, np.nan, se)})
    return run


@dataclass(frozen=True)
class VarianceShares:
    """Residual sums of squares of sub-models from p x p sums."""

    design: Design
    zz: np.ndarray
    zyyz: np.ndarray
    yy: float
    n: int

    def rss_rank(self, terms: Sequence[str]) -> tuple[float, int]:
        keep = self.design.columns_of(terms)
        zz, m = self.zz[np.ix_(keep, keep)], self.zyyz[np.ix_(keep, keep)]
        return self.yy - float(np.sum(_inverse(zz) * m)), cross_rank(zz)

    @property
    def total(self) -> float:
        return self.rss_rank([])[0]

    def term(self, term: str, given: Sequence[str]) -> dict[str, float]:
        """Share of the *total* sum of squares a term adds to the given terms."""
        reduced, rank_reduced = self.rss_rank(given)
        full, rank_full = self.rss_rank([*given, term])
        df_term, df_residual = rank_full - rank_reduced, self.n - rank_full
        usable = df_term > 0 and df_residual > 0
        return {"df_term": df_term, "df_residual": df_residual,
                "r2": (reduced - full) / self.total if usable else None,
                "pseudo_f": ((reduced - full) / df_term) / (full / df_residual) if usable else None}


def sequential_partition(shares: VarianceShares, order: Sequence[str]) -> DataFrame:
    """Sequential and term-deletion shares in the given order, with the residual row."""
    rows = []
    for i, term in enumerate(order):
        first = shares.term(term, order[:i])
        last = shares.term(term, [t for t in order if t != term])
        rows.append((term, first["r2"], last["r2"], last["pseudo_f"], last["df_term"], last["df_residual"], shares.n))
    rss, rank = shares.rss_rank(order)
    rows.append(("residual", rss / shares.total, None, None, None, shares.n - rank, shares.n))
    return shares.design.rows.sparkSession.createDataFrame(
        rows, "term string, r2 double, term_deletion_r2 double, pseudo_f double, df_term int, df_residual int, sample_n int")


def marginal_partition(all_samples: VarianceShares, complete: VarianceShares, covariates: Sequence[str]) -> DataFrame:
    """Cohort alone, condition after cohort, each covariate after all other terms."""
    steps = [("cohort", all_samples, []), ("condition", all_samples, ["cohort"])]
    steps += [(c, complete, ["cohort", "condition", *[o for o in covariates if o != c]]) for c in covariates]
    rows = []
    for term, shares, given in steps:
        got = shares.term(term, given)
        rows.append((term, "all_samples" if shares is all_samples else "complete_case_covariates", shares.n,
                     got["df_term"], got["df_residual"], None if got["r2"] is None else 100 * got["r2"], got["pseudo_f"]))
    return all_samples.design.rows.sparkSession.createDataFrame(
        rows, "term string, model_scope string, n_samples int, df_term int, df_residual int, "
              "partial_r2_percent double, pseudo_f double")


def ordered_rows(design: Design, seed: int) -> DataFrame:
    """(sample_id, cohort, z, _k): the design's rows numbered in the order whose k-th row a permutation hands to the k-th draw."""
    rows = design.rows.select("sample_id", "cohort", "z", F.lit(0).alias("_g")).withColumn("_d", draw(seed, "order", F.col("sample_id")))
    return row_numbers(rows, ["_g"], "_d", "sample_id", "_k").drop("_g", "_d")


def piece_size(rows: DataFrame, n: int) -> int:
    """Rows of a piece: at most PIECE, and as many pieces as cores."""
    return max(1, min(PIECE, -(-n // rows.sparkSession.sparkContext.defaultParallelism)))


CODED = "_piece int, _first int, _term int, _count int, _width int, _data binary"


def coded_permutations(design: Design, ordered: DataFrame, terms: Sequence[tuple[str, bool]], permutations: int, seed: int, size: int) -> DataFrame:
    """The terms' columns under every permutation, by piece of ``size`` samples in the order of ``_k``.

    A permutation sends the k-th smallest draw the columns of the k-th sample; within a cohort where the term's flag
    says so, over all samples otherwise.  A row with ``_first`` > 0 holds codes of ``_width`` bytes for ``_count`` permutations from
    ``_first`` on; one with ``_first`` = 0 the columns that a code stands for.
    """
    columns = [[i for i, t in enumerate(design.terms) if t == term] for term, _ in terms]
    own = [F.element_at("z", i + 1).alias(f"_z{i}") for i in sorted({i for c in columns for i in c})]
    packed = settle(packed_pieces(ordered.select("_k", "sample_id", F.col("sample_id").cast("string").alias("_key"), "cohort", *own), size))

    def run(first: int, last: int, held: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        keys = by_length(*unpacked(held, "_key"))
        ids, cohort = unpacked(held, "sample_id", "cohort")
        cohort, n = cohort.dictionary_encode().indices.fill_null(-1).to_numpy(), len(ids)
        for at, ((term, within), mine) in enumerate(zip(terms, columns)):
            book, code = _coded([z.to_numpy() for z in unpacked(held, *[f"_z{i}" for i in mine])])
            if first == 1:
                yield from (_coded_row(piece, 0, at, len(book), 8, book) for piece in range(len(held)))
            groups, made = [np.flatnonzero(cohort == c) for c in np.unique(cohort)] if within else [slice(None)], {}
            for perm, draws in draws_in_turn(seed, f"permute_{term}", first, last, keys, n):
                made[perm] = np.empty_like(code)
                for g in groups:
                    placed = np.empty_like(code[g])
                    placed[order_of(draws[g], ids.take(pa.array(g)) if within else ids)] = code[g]
                    made[perm][g] = placed
                del draws
                if perm == last or len(made) * n >= DRAWS_TOGETHER:
                    for piece, i in enumerate(range(0, n, size)):
                        yield _coded_row(piece, min(made), at, len(made), code.itemsize, np.stack([m[i:i + size] for m in made.values()]))
                    made = {}

    return by_permutations(packed, permutations, run, CODED)


def _coded(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix given by its columns, and which of them each row is, in as few bytes as hold it."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        values, at = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + at, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return np.column_stack([c[first] for c in columns]), code.astype(np.min_scalar_type(max(len(first) - 1, 0)))


def _coded_row(piece: int, first: int, term: int, count: int, width: int, data: np.ndarray) -> pa.RecordBatch:
    """A row of CODED; the bytes lie by their place in a number, so that those with little in them compress."""
    planes = np.ascontiguousarray(np.ascontiguousarray(data).view(np.uint8).reshape(-1, width).T)
    packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (piece, first, term, count, width)), pa.array([packed], pa.binary())],
                                      ["_piece", "_first", "_term", "_count", "_width", "_data"])


def _decoded(packed: pa.BinaryScalar, count: int, width: int, n: int, kind: str) -> np.ndarray:
    """The count x n numbers of a row of CODED."""
    planes = np.frombuffer(pa.decompress(packed.as_buffer(), count * n * width, codec="zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"{kind}{width}").reshape(count, n)


def permuted_terms(design: Design, term: str, permutations: int, seed: int, within_cohort: bool) -> DataFrame:
    """(sample_id, zp): the term's columns under every permutation, one after another; a long row a sample, for small tables."""
    ordered, k = settle(ordered_rows(design, seed)), sum(t == term for t in design.terms)
    size = piece_size(ordered, ordered.count())
    coded = coded_permutations(design, ordered, [(term, within_cohort)], permutations, seed, size)
    kind = design.rows.schema["sample_id"].dataType.simpleString()
    rows = ordered.groupBy(F.floor((F.col("_k") - 1) / size).cast("int").alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct("_k", "sample_id")))["sample_id"].alias("_ids")).join(
        coded.groupBy("_piece").agg(F.array_sort(F.collect_list(F.struct("_first", "_count", "_width", "_data"))).alias("_c")), "_piece")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts in zip(batch["_ids"], batch["_c"]):
                n, (book, *rest) = len(ids.values), list(parts.values)
                book = _decoded(book["_data"], book["_count"].as_py(), 8, k, "f")
                codes = np.vstack([_decoded(r["_data"], r["_count"].as_py(), r["_width"].as_py(), n, "u") for r in rest])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(list(book[codes.T].reshape(n, -1)), pa.list_(pa.float64()))], ["sample_id", "zp"])

    return rows.mapInArrow(spell, f"sample_id {kind}, zp array<double>")


class PermutationStudy:
    """Permutation nulls of the terms of one design; ``profiles`` has (sample_id, x), and ``z`` and ``_k`` if they were
    made from ``ordered_rows``: then the arrays are not moved to meet these."""

    def __init__(self, shares: VarianceShares, profiles: DataFrame):
        self.shares = shares
        if "z" not in profiles.columns:
            profiles = spread(shares.design.rows.select("sample_id", "z").join(profiles.select("sample_id", "x"), "sample_id"), "sample_id")
        self.rows = settle(profiles)
        p = len(shares.design.names)

        def cross(batch: pa.RecordBatch) -> np.ndarray:
            return (matrix(batch["z"]).T @ matrix(batch["x"])).ravel()

        self.zy = _per_task(self.rows.select("z", "x"), cross).reshape(p, -1)

    def pseudo_f(self, term: str, given: Sequence[str], permutations: int, seed: int, within_cohort: bool) -> DataFrame:
        """(perm, pseudo_f) with only the term's columns permuted."""
        return self.nulls([(term, given, within_cohort)], permutations, seed).drop("term")

    def nulls(self, terms: Sequence[tuple[str, Sequence[str], bool]], permutations: int, seed: int) -> DataFrame:
        """(term, perm, pseudo_f) for terms (name, given terms, within cohorts), each with only its own columns permuted.

        The profiles of a piece of samples meet the codes of their permuted columns in one task, which multiplies
        them; the sums over pieces are added per term and permutation.
        """
        shares, design = self.shares, self.shares.design
        ordered = self.rows if "_k" in self.rows.columns else settle(ordered_rows(design, seed))
        if "_k" in self.rows.columns:
            ordered = ordered.join(design.rows.select("sample_id", "cohort"), "sample_id")
        size = piece_size(ordered, shares.n)
        used = [(term, within) for term, _, within in terms if term in design.terms]
        places = {term: [i for i, t in enumerate(design.terms) if t == term] for term, _ in used}
        coded = coded_permutations(design, ordered, used, permutations, seed, size)
        numbered = self.rows if "_k" in self.rows.columns else self.rows.join(ordered.select("sample_id", "_k"), "sample_id")
        wide = numbered.select(F.floor((F.col("_k") - 1) / size).cast("int").alias("_piece"), F.lit(-1).alias("_first"), F.pmod(F.col("_k") - 1, F.lit(size)).cast("int").alias("_term"),
                               *[F.lit(None).cast(t).alias(c) for c, t in (("_count", "int"), ("_width", "int"), ("_data", "binary"))], F.concat("z", "x").alias("_wide"))
        n_all, pieces = shares.n, -(-shares.n // size)
        met = (wide.unionByName(coded.withColumn("_wide", F.lit(None).cast("array<double>")))
               .repartitionById(pieces, F.col("_piece")).sortWithinPartitions("_piece", "_first", "_term"))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, lines, books, held = None, [], {}, None
            for batch in batches:
                piece, first = batch["_piece"].to_numpy(), batch["_first"].to_numpy()
                i = 0
                while i < len(piece):
                    if piece[i] != at:
                        at, lines, books, held = piece[i], [], {}, None
                    if first[i] < 0:
                        j = i + int(np.argmin(np.append((first[i:] < 0) & (piece[i:] == at), False)))
                        lines.append((batch["_term"].slice(i, j - i).to_numpy(), matrix(batch["_wide"].slice(i, j - i))))
                        i = j
                        continue
                    term, count, width = (batch[c][i].as_py() for c in ("_term", "_count", "_width"))
                    if first[i] == 0:
                        books[term] = _decoded(batch["_data"][i], count, 8, len(places[used[term][0]]), "f")
                    elif lines or held is not None:
                        if held is None:
                            n = min(size, n_all - int(at) * size)
                            held, seen = np.zeros((n, lines[0][1].shape[1])), np.zeros(n, bool)
                            while lines:
                                place, part = lines.pop()
                                held[place], seen[place] = part, True
                        codes = _decoded(batch["_data"][i], count, width, len(held), "u")
                        moved = np.stack([column[codes] for column in books[term].T], axis=1)  # permutations x columns x samples
                        if not seen.all():
                            moved[:, :, ~seen] = 0.0
                        cross = (moved.reshape(-1, len(held)) @ held).reshape(count, -1)
                        inner = (moved @ moved.transpose(0, 2, 1)).reshape(count, -1)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(count, term, np.int32)), pa.array(np.arange(first[i], first[i] + count, dtype=np.int32)),
                            pa.array(list(np.hstack([cross, inner])), pa.list_(pa.float64()))], ["term", "perm", "v"])
                    i += 1

        known = [(places[term], design.columns_of(given), *shares.rss_rank(given)) for term, given, _ in terms if term in places]
        p, zz_all, zy_all, yy, names = len(design.names), shares.zz, self.zy, shares.yy, [term for term, _ in used]

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for term, v in zip(batch["term"].to_pylist(), batch["v"]):
                    own, keep, reduced, rank_reduced = known[term]
                    v, k = v.values.to_numpy(), len(own)
                    cross, inner = v[:-k * k].reshape(k, -1), v[-k * k:].reshape(k, k)
                    full = np.block([[zz_all[np.ix_(keep, keep)], cross[:, keep].T], [cross[:, keep], inner]])
                    stacked = np.vstack([zy_all[keep], cross[:, p:]])
                    rss = yy - float(np.sum(_inverse(full) * (stacked @ stacked.T)))
                    rank = cross_rank(full)
                    df_term, df_residual = rank - rank_reduced, n_all - rank
                    usable = df_term > 0 and df_residual > 0
                    out.append(((reduced - rss) / df_term) / (rss / df_residual) if usable else None)
                yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in batch["term"].to_pylist()], pa.string()), batch["perm"],
                                                  pa.array(out, pa.float64())], ["term", "perm", "pseudo_f"])

        sums = met.mapInArrow(partial, "term int, perm int, v array<double>").groupBy("term", "perm").agg(vector_sum(F.col("v")).alias("v"))
        fitted = sums.mapInArrow(finish, "term string, perm int, pseudo_f double").withColumn("pseudo_f", F.nanvl("pseudo_f", F.lit(None)))
        absent = [term for term, _, _ in terms if term not in places]
        none = self.rows.sparkSession.range(1, permutations + 1).select(
            F.explode(F.array(*map(F.lit, absent)).cast("array<string>")).alias("term"), F.col("id").cast("int").alias("perm"), F.lit(None).cast("double").alias("pseudo_f"))
        return fitted.unionByName(none) if absent else fitted


def principal_components(profiles: DataFrame, k: int = 2) -> DataFrame:
    """Scores of the first components and their variance ratios.

    The sign of a component is set by its largest absolute loading.
    """
    rows = settle(profiles.withColumn("_v", array_to_vector("x")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    loadings = model.pc.toArray()
    flip = np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    scored = settle(model.transform(rows).withColumn("_pc", vector_to_array("_pc")))
    centre = scored.agg(*[F.avg(F.element_at("_pc", i + 1)).alias(f"c{i}") for i in range(k)]).first()
    out = scored
    for i in range(k):
        out = (out.withColumn(f"PC{i + 1}", (F.element_at("_pc", i + 1) - F.lit(centre[i])) * float(flip[i]))
               .withColumn(f"PC{i + 1}_ratio", F.lit(float(model.explainedVariance[i]))))
    return out.drop("_v", "_pc", "x")


def two_group_pseudo_f(moments: DataFrame) -> DataFrame:
    """Pseudo-F of condition on Euclidean distances from (feature, cohort) moments.

    Between-group sum of squares is n1 n0 / n times the squared centroid gap.
    """
    def total(g: int) -> Column:
        return F.sum(F.coalesce(F.col(f"mean{g}"), F.lit(0.0)) * F.col(f"n{g}"))

    def squares(g: int) -> Column:
        return F.sum(F.coalesce(F.col(f"var{g}") + F.col(f"mean{g}") * F.col(f"mean{g}"), F.lit(0.0)) * F.col(f"n{g}"))

    per_feature = moments.groupBy("feature").agg(
        F.sum("n1").cast("double").alias("n1"), F.sum("n0").cast("double").alias("n0"),
        total(1).alias("t1"), total(0).alias("t0"), (squares(1) + squares(0)).alias("q"))
    sums = per_feature.agg(
        F.max("n1").alias("n1"), F.max("n0").alias("n0"),
        F.sum(F.pow(F.col("t1") / F.col("n1") - F.col("t0") / F.col("n0"), 2)).alias("gap"),
        F.sum(F.col("q") - F.pow(F.col("t1") + F.col("t0"), 2) / (F.col("n1") + F.col("n0"))).alias("sst"))
    between = F.col("gap") * F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    df = F.col("n1") + F.col("n0") - 2
    within = F.col("sst") - between
    return sums.select(F.col("n1").cast("bigint").alias("n1"), F.col("n0").cast("bigint").alias("n0"),
                       F.when((within > 0) & (df > 0), between / (within / df)).alias("pseudo_f"))
