"""Rank names out of lineage strings such as ``k__A|p__B|g__C|s__C_d``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lineage_token(lineage: Column, rank: str) -> Column:
    """First token of a rank; ``;`` and ``|`` both separate; '' if absent."""
    return F.regexp_extract(F.coalesce(lineage, F.lit("")), rf"(?:^|[;|]){rank}__([^;|]*)", 1)


def genus(lineage: Column) -> Column:
    return lineage_token(lineage, "g")


def species(lineage: Column, fallback: str = "empty") -> Column:
    """Species with spaces; without one either '' or the whole lineage."""
    found = F.replace(lineage_token(lineage, "s"), F.lit("_"), F.lit(" "))
    if fallback == "empty":
        return found
    if fallback != "lineage":
        raise ValueError(f"unknown fallback: {fallback}")
    has_rank = F.coalesce(lineage, F.lit("")).rlike(r"(?:^|[;|])s__")
    return F.when(has_rank, found).otherwise(lineage)


def species_tail(lineage: Column) -> Column:
    """Text after the last ``|s__``, else the whole lineage."""
    has = F.contains(lineage, F.lit("|s__"))
    return F.when(has, F.replace(F.substring_index(lineage, "|s__", -1), F.lit("_"), F.lit(" "))).otherwise(lineage)


def genus_or_first_word(lineage: Column) -> Column:
    """Text of the last ``|g__`` token, else the first word of the species."""
    has = F.contains(lineage, F.lit("|g__"))
    token = F.substring_index(F.substring_index(lineage, "|g__", -1), "|", 1)
    words = F.split(F.trim(F.regexp_replace(species_tail(lineage), r"\s+", " ")), " ")
    return F.when(has, token).otherwise(F.coalesce(words[0], F.lit("")))


def rank_map(lineage: Column) -> Column:
    """Every rank of a lineage as MAP<rank, name>; each token is split once on ``__``."""
    tokens = F.filter(F.split(lineage, r"\|"), lambda t: F.contains(t, F.lit("__")))
    pairs = F.transform(tokens, lambda t: F.struct(
        F.substring_index(t, "__", 1).alias("rank"),
        F.regexp_extract(t, r"(?s)^.*?__(.*)$", 1).alias("name")))
    # a repeated rank keeps its last name, as a dictionary would
    last = F.filter(pairs, lambda p, i: F.forall(
        F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["rank"] != p["rank"]))
    return F.map_from_entries(last)


def mapped_rank(lineage: Column, rank: str, fallback_to_lineage: bool = False) -> Column:
    value = F.try_element_at(rank_map(lineage), F.lit(rank))
    filled = F.coalesce(value, lineage if fallback_to_lineage else F.lit(""))
    return F.replace(filled, F.lit("_"), F.lit(" ")) if rank == "s" else filled
