"""Preparation of training samples from species sets and environment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.operators import environment, presence, sampling


def multi_hot(sets: DataFrame, vocab: DataFrame, keys: list[str], species: str = "species") -> DataFrame:
    """Each row's indices in the vocabulary, sorted, and the vocabulary's size: the rows of the 0/1 matrix.

    Codes outside the vocabulary go; rows without any index keep an empty
    list.  Dense columns would be as many as species, so the matrix stays
    sparse; ``dense_row`` spreads a row where a model needs it.
    """
    hits = sets.select(*keys, F.explode(species).alias(species)).join(vocab, species)
    found = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("idx")).alias("indices"))
    size = vocab.agg(F.count("*").alias("size"))
    rows = sets.select(*keys).join(found, keys, "left").crossJoin(F.broadcast(size))
    return rows.select(*keys, F.coalesce("indices", F.array().cast("array<int>")).alias("indices"), "size")


def dense_row(indices: str = "indices", size: str = "size"):
    """The 0/1 list of a sparse row."""
    return F.expr(f"transform(sequence(0, cast({size} as int) - 1), i -> if(array_contains({indices}, i), 1, 0))")


def prepare(sets: DataFrame, cells: DataFrame, continuous: list[str], fractions: list[str], categorical: str, categories: list, least: int = 0, most: int = 0, max_species: int = 0, seed: int = 42) -> DataFrame:
    """Samples for training: cell, week, the model's environment features, ``indices``, ``size`` and ``obs_density``.

    The vocabulary is fixed first: species of at least ``least`` samples,
    at most ``max_species`` of them (0: no limit).  Then each species keeps
    ``most`` samples at most (0: all), drawn by hash.  Labels are encoded
    with the vocabulary, while density counts all labels that were kept,
    over a cell's weeks.  Samples that lose every label stay.
    """
    labels = sets.select("cell", "week", F.explode("species").alias("species"))
    known = presence.frequent(labels, max(1, least)).select("species")
    if max_species:
        known = sampling.exact_sample(known, ["species"], count=max_species, seed=seed)
    vocab = presence.vocabulary(known)
    kept = sampling.cap_observations(labels, most, ["cell", "week"], seed=seed) if most else labels
    lists = kept.groupBy("cell", "week").agg(F.collect_list("species").alias("species"))
    samples = sets.select("cell", "week").join(lists, ["cell", "week"], "left").withColumn("species", F.coalesce("species", F.array().cast("array<string>")))
    encoded = multi_hot(samples, vocab, ["cell", "week"])
    density = presence.observation_density(samples).select("cell", "week", "obs_density")
    features = environment.normalise(cells, continuous, fractions, categorical, categories)
    return encoded.join(density, ["cell", "week"]).join(features, "cell")
