"""Exact k nearest rows in a few coordinates, shard by shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from phenogrid.operators.stored import stored
from phenogrid.operators.totals import even_cuts

SHARD_ROWS = 8192
MOST_SHARDS = 1024  # of a group along each of two coordinates
ASKED_ROWS = 65_536
CHUNK = 1 << 20  # distances held at once
SLACK = 1e-8  # how far rounding may carry a distance


def _search(asked: np.ndarray, seen: np.ndarray, names: np.ndarray, bound: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Asked row, seen row and distance of the ``k`` nearest within each asked row's bound."""
    rows, near, dist = [], [], []
    step = max(1, CHUNK // len(seen))
    for low in range(0, len(asked), step):
        part = asked[low : low + step]
        square = np.zeros((len(part), len(seen)))
        for j in range(asked.shape[1]):
            square += (part[:, j : j + 1] - seen[:, j]) ** 2
        d = np.sqrt(square)
        limit = bound[low : low + step]
        if len(seen) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        q, s = np.nonzero(d <= limit[:, None] + SLACK)
        d = d[q, s]
        order = np.lexsort((names[s], np.round(d, digits), q))
        q, s, d = q[order], s[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        rows.append(q[keep] + low), near.append(s[keep]), dist.append(d[keep])
    return np.concatenate(rows), np.concatenate(near), np.concatenate(dist)


def k_nearest(asked: DataFrame, seen: DataFrame, by: list[str], key: list[str], coords: list[str], near: str, k: int, digits: int = 9) -> DataFrame:
    """For each row of ``asked`` the ``k`` rows of ``seen`` with equal ``by``, nearest by straight distance.

    ``coords`` are in both, ``key`` names a row of ``asked``, ``near`` one of
    ``seen``; other columns of either come along and must not share names.
    Adds ``dist`` and the rank ``rn``; distances that agree to ``digits``
    decimals are ties, which go to the smaller ``near``.  Rows with a null
    coordinate take no part.

    A group's seen rows are cut into slabs along the first coordinate, and
    each slab into shards of bounded size along the second (with one
    coordinate, slabs are shards), equal values being spread by hash.  Each
    asked row searches the shard it lies in; its k-th distance there decides
    which other slabs, and which of their shards, can hold anything nearer,
    and only those are searched.  So pairs do not grow with the square of
    the input where the coordinates tell rows apart, and no task holds more
    than a shard and a block of asked rows.

    Of seen rows at one place only the first ``k`` by ``near`` can be among
    the nearest, and rows that ask at one place find the same: copies are
    neither searched nor searched for.
    """
    known = lambda df: df.where(" and ".join(f"{c} is not null" for c in coords))
    asked, seen = known(asked), known(seen)
    first = F.row_number().over(Window.partitionBy(*by, *coords).orderBy(near))
    seen = stored(seen.withColumn("_first", first).where(F.col("_first") <= k).drop("_first"))
    found = _nearest_to_places(stored(asked.select(*by, *coords).distinct()), seen, by, coords, near, k, digits)
    return asked.join(found, [*by, *coords])


def _nearest_to_places(asked: DataFrame, seen: DataFrame, by: list[str], coords: list[str], near: str, k: int, digits: int) -> DataFrame:
    """``k_nearest`` of places, each asked for once."""
    key, sides = coords, coords[:2]

    def spread(df: DataFrame, name: list[str]) -> DataFrame:
        """Coordinates to be cut, of which equal ones differ a little."""
        return df.withColumns({f"_u{i}": F.col(c) + F.pmod(F.xxhash64(F.lit(i), *name), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 1e-9 for i, c in enumerate(sides)})

    def cuts(rows: DataFrame, keys: list[str], column: str, pieces: Column) -> DataFrame:
        """For each group of ``keys`` its number of rows and the places that cut it into so many pieces."""
        found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), even_cuts(column, MOST_SHARDS).alias("_c")).withColumn("_s", F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), pieces)).cast("int"))
        return found.select(*keys, "_n", F.expr(f"if(_s > 1, transform(sequence(1, _s - 1), j -> get(_c, cast(j * {MOST_SHARDS} div _s as int) - 1)), cast(array() as array<double>))").alias("_cuts"))

    def piece(column: str, among: str, sign: str = "") -> Column:
        return F.expr(f"size(filter({among}, c -> c <= {column} {sign}))")

    counts = seen.groupBy(*by).agg(F.count("*").alias("s"), F.lit(0).alias("a")).select("s", "a").union(asked.groupBy(*by).agg(F.lit(0).alias("s"), F.count("*").alias("a")).select("s", "a"))
    held = counts.agg(F.max("s"), F.max("a")).first()
    several = (held[0] or 0) > SHARD_ROWS or (held[1] or 0) > ASKED_ROWS
    if not several:  # every group is one shard and one block
        one = {c: F.lit(0) for c in ("_slab", "_shard", "_block")}
        asked, seen = asked.withColumns(one | {"_slabs": F.lit(0)}), seen.withColumns(one)
    else:
        asked, seen = spread(asked, key), spread(seen, [near])
        shards = F.ceil(F.col("_n") / SHARD_ROWS)
        slabs = stored(cuts(seen, by, "_u0", F.ceil(F.sqrt(shards)) if len(sides) > 1 else shards).drop("_n").withColumnRenamed("_cuts", "_slabs"))  # a row for each group
        asked = asked.join(slabs, by).withColumn("_slab", piece("_u0", "_slabs"))
        seen = seen.join(slabs, by).withColumn("_slab", piece("_u0", "_slabs")).drop("_slabs")
        cells = cuts(seen, [*by, "_slab"], "_u1" if len(sides) > 1 else "_u0", shards if len(sides) > 1 else F.lit(1)).withColumnRenamed("_cuts", "_cells")
        cells = stored(cells.drop("_n"))  # a row for each slab
        last = "_u1" if len(sides) > 1 else "_u0"
        # a slab without seen rows has no shards: its rows look elsewhere
        asked = asked.join(cells, [*by, "_slab"], "left").withColumn("_shard", F.coalesce(piece(last, "_cells"), F.lit(0)))
        seen = seen.join(cells, [*by, "_slab"]).withColumn("_shard", piece(last, "_cells")).drop("_cells", *[f"_u{i}" for i in range(len(sides))])
        blocks = asked.groupBy(*by, "_slab").agg(F.count("*").alias("_a")).join(cells, [*by, "_slab"], "left")
        most = blocks.select(*by, F.greatest(F.lit(1), F.ceil(F.col("_a") / (F.coalesce(F.size("_cells"), F.lit(0)) + 1) / ASKED_ROWS)).cast("int").alias("_b")).groupBy(*by).agg(F.max("_b").alias("_blocks"))
        most = stored(most)
        asked = asked.join(most, by).withColumn("_block", F.pmod(F.xxhash64(*key), F.col("_blocks")).cast("int")).drop("_blocks", "_cells", *[f"_u{i}" for i in range(len(sides))])
        seen = seen.join(most, by).withColumn("_block", F.explode(F.expr("sequence(0, _blocks - 1)"))).drop("_blocks")
    where = [*by, "_slab", "_shard", "_block"]
    names = {c: f"s_{c}" for c in [*where, *coords]}
    seen = seen.withColumnsRenamed(names)
    group, other = where, [names[c] for c in where]
    carried = [c for c in seen.columns if c not in names.values()]
    kept = [c for c in asked.columns if c not in ("_slabs", "_slab", "_shard", "_block", *coords)]
    schema = StructType([asked.schema[c] for c in [*kept, *coords]] + [seen.schema[c] for c in carried] + [StructField("dist", DoubleType())])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            left, right, found = left.iloc[:0], right.iloc[:0], (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        else:
            found = _search(left[coords].to_numpy(float), right[[names[c] for c in coords]].to_numpy(float), right[near].to_numpy(), left["_bound"].to_numpy(float), k, digits)
        rows, hits, dist = found
        return pd.concat([left[[*kept, *coords]].iloc[rows].reset_index(drop=True), right[carried].iloc[hits].reset_index(drop=True), pd.Series(dist, name="dist")], axis=1)

    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*group).cogroup(seen.groupBy(*other)).applyInPandas(search, schema)

    home = run(asked.drop("_slabs").withColumn("_bound", F.lit(float("inf"))))
    rank = F.row_number().over(Window.partitionBy(*by, *key).orderBy(F.round("dist", digits), near))
    if not several:  # every group is one shard, which its rows have searched
        return home.withColumn("rn", rank).where(F.col("rn") <= k)
    reach = home.groupBy(*by, *key).agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("_bound"))
    away = asked.join(reach, [*by, *key], "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))

    def ends(coord: str, among: str) -> Column:
        return F.sequence(*[piece(coord, among, f"{sign} (_bound + {SLACK})") for sign in "-+"])

    away = away.withColumns({"_own_slab": F.col("_slab"), "_own_shard": F.col("_shard")}).withColumn("_slab", F.explode(ends(coords[0], "_slabs"))).drop("_slabs")
    away = away.join(cells, [*by, "_slab"]).withColumn("_shard", F.explode(ends(coords[1], "_cells") if len(sides) > 1 else F.array(F.lit(0)))).drop("_cells")
    away = away.where("_slab != _own_slab or _shard != _own_shard").drop("_own_slab", "_own_shard")
    found = home.unionByName(run(away))
    return found.withColumn("rn", rank).where(F.col("rn") <= k)
