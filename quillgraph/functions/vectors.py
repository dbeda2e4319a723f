"""Array expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def rbf(a, b, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * squared_distance(a, b))


def gather(a, positions: list[int]) -> Column:
    """The elements at these positions (from 0), always as an array."""
    return F.array(*[F.get(a, F.lit(i)) for i in positions])


def argmax(a) -> Column:
    """Position (from 0) of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def one_hot(index, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def columns_long(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value) of each element."""
    return df.select(key, F.posexplode(vector).alias("pos", "value"))


def back_to_arrays(long: DataFrame, key: str, name: str = "features") -> DataFrame:
    """(key, array in order of pos); a key holds as many rows as the vector is wide."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))


#: Elements of a vector that are summed side by side as columns.
BLOCK = 64


def width_of(df: DataFrame, vector: str = "features") -> int:
    """Length of the longest vector; 0 for no rows."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def vector_sums(rows: DataFrame, key: list[str], vector: str, width: int, weight=None, mean: bool = False) -> DataFrame:
    """(key.., vector): for each key the sum (or mean) of the vectors, element by element, each times ``weight``.

    Elements are columns of one aggregation, ``BLOCK`` at a time, so sums are partial in each task and one vector for each
    key and task is shuffled, not one row for each element.  Vectors may differ in length and have nulls, which
    count as zero; the result is as long as the longest vector of its key, ``width`` at most.  Means are of vectors of equal length.
    """
    w = F.lit(1.0) if weight is None else weight
    narrow = width <= BLOCK
    base = rows.select(*key, w.alias("_w"), F.col(vector).alias("_v"))
    if narrow:
        parts = base.withColumn("_b", F.lit(0))
    else:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("_v"), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice("_v", b * BLOCK + 1, BLOCK))
        parts = base.select(*key, "_w", F.posexplode(cut).alias("_b", "_v"))
    size = max(1, min(width, BLOCK))
    sums = [F.expr(f"sum(_w * get(_v, {i})) AS _{i}") for i in range(size)]
    by = key if narrow else [*key, "_b"]
    added = parts.groupBy(*by).agg(F.max(F.size("_v")).alias("_size"), F.count("*").alias("_n"), *sums)
    over = " / _n" if mean else ""
    block = F.expr(f"slice(array({', '.join(f'coalesce(_{i}, 0.0D){over}' for i in range(size))}), 1, greatest(_size, 0))")
    if narrow:
        return added.select(*key, block.alias(vector))
    # as many rows for each key as the vector has blocks
    return added.select(*key, "_b", block.alias("_v")).groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_v"))), lambda x: x["_v"])).alias(vector))


def scaled(vector, by) -> Column:
    """Each element times a number."""
    return F.transform(vector, lambda x: x * by)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """The column scaled to [0, 1] over all rows; a constant column gives 0."""
    edge = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    # the one-row side has a proven size
    return df.crossJoin(F.broadcast(edge)).withColumn(column, F.when(F.col(column).isNotNull(), scaled)).drop("_lo", "_hi")


def z_scores(long: DataFrame) -> DataFrame:
    """(.., pos, value) with each position's values less their mean over their population deviation; a constant position gives 0."""
    at = long.groupBy("pos").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    # a row for each position of a vector
    scaled = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return long.join(F.broadcast(at), "pos").withColumn("value", scaled).drop("_m", "_s")


def principal_components(df: DataFrame, k: int) -> DataFrame:
    """(node_id, components): the vectors of (node_id, features), less their mean, on the k axes of greatest variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select("node_id", array_to_vector("features").alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.select("node_id", vector_to_array("_p").alias("components"))


def primes(n: int) -> list[int]:
    """The first n primes, by a sieve."""
    import numpy as np

    if n < 1:
        return []
    top = max(15, int(n * (np.log(n + 1) + np.log(np.log(n + 2) + 1))) + 1)
    prime = np.ones(top + 1, bool)
    prime[:2] = False
    for p in range(2, int(top**0.5) + 1):
        if prime[p]:
            prime[p * p :: p] = False
    return np.flatnonzero(prime)[:n].tolist()


def averaged_rank(partition: list[str], order: Column, by: Column) -> Column:
    """Rank with ties averaged; ``by``: what ties share."""
    ties = Window.partitionBy(*partition, by)
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count("*").over(ties) - 1) / F.lit(2.0)
