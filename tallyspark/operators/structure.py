"""How labels lie in the vectors of each layer (QRY28, CLU07-10, VEC09-10): all from sums by label, without a pair of rows.

Rows are long: layer, id, label, vec (unit vectors of one length in a layer). A layer may have labels of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long(rows: DataFrame, vecs: Sequence[str], *carry: str) -> DataFrame:
    """layer (the column's name), ``carry`` and vec, a row for each of ``vecs``."""
    return rows.select(*carry, F.explode(F.array(*[F.struct(F.lit(v).alias("layer"), F.col(v).alias("vec")) for v in vecs])).alias("x")).select("x.layer", *carry, "x.vec")


def _coordinates(x: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by coordinate, the labels' sums by coordinate, and their sizes."""
    flat = x.select("layer", "id", "label", F.posexplode("vec").alias("p", "v"))
    sums = flat.groupBy("layer", F.col("label").alias("other"), "p").agg(F.sum("v").alias("s"))
    return flat, sums, x.groupBy("layer", F.col("label").alias("other")).agg(F.count("*").cast("double").alias("k"))


def silhouettes(x: DataFrame) -> DataFrame:
    """layer, silhouette: the exact cosine silhouette; the only row of a label counts 0, and so does every row of a layer with one label."""
    flat, sums, sizes = _coordinates(x)
    own = F.col("label") == F.col("other")
    dots = flat.join(sums, ["layer", "p"]).groupBy("layer", "id", "label", "other").agg(F.sum(F.col("v") * F.col("s")).alias("dp")).join(sizes, ["layer", "other"])
    far = dots.withColumn("m", (F.col("k") - F.col("dp")) / F.when(own, F.nullif(F.col("k") - 1, F.lit(0.0))).otherwise(F.col("k")))
    each = far.groupBy("layer", "id").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return each.groupBy("layer").agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))).alias("silhouette"))


def spreads(x: DataFrame) -> DataFrame:
    """layer, n_labels, n_rows, calinski_harabasz and davies_bouldin (Euclidean; null with one label or without spread)."""
    flat, sums, sizes = _coordinates(x)
    centre = sums.join(sizes, ["layer", "other"]).select("layer", F.col("other").alias("label"), "p", (F.col("s") / F.col("k")).alias("c"), "k")
    mean = sums.groupBy("layer", "p").agg(F.sum("s").alias("s")).join(sizes.groupBy("layer").agg(F.sum("k").alias("n")), "layer").select("layer", "p", (F.col("s") / F.col("n")).alias("m"))
    gap = F.col("c") - F.col("m")
    between = centre.join(mean, ["layer", "p"]).groupBy("layer").agg(F.sum(F.col("k") * gap * gap).alias("b"))
    off = F.col("v") - F.col("c")
    each = flat.join(centre, ["layer", "label", "p"]).groupBy("layer", "id", "label").agg(F.sum(off * off).alias("d"))
    inside = each.groupBy("layer").agg(F.sum("d").alias("w"))
    spread = each.groupBy("layer", "label").agg(F.avg(F.sqrt("d")).alias("s"))
    one, two = centre.select("layer", F.col("label").alias("i"), "p", F.col("c").alias("a")), centre.select("layer", F.col("label").alias("j"), "p", F.col("c").alias("b"))
    step = F.col("a") - F.col("b")
    apart = one.join(two, ["layer", "p"]).where("i <> j").groupBy("layer", "i", "j").agg(F.sqrt(F.sum(step * step)).alias("m"))
    worst = apart.join(spread.toDF("layer", "i", "si"), ["layer", "i"]).join(spread.toDF("layer", "j", "sj"), ["layer", "j"]).groupBy("layer", "i").agg(F.max((F.col("si") + F.col("sj")) / F.nullif(F.col("m"), F.lit(0.0))).alias("worst"))
    n = sizes.groupBy("layer").agg(F.count("*").alias("n_labels"), F.sum("k").cast("long").alias("n_rows"))
    out = n.join(between, "layer").join(inside, "layer").join(worst.groupBy("layer").agg(F.avg("worst").alias("davies_bouldin")), "layer", "left")
    ratio = (F.col("b") / F.nullif(F.col("n_labels") - 1, F.lit(0))) / F.nullif(F.col("w") / F.nullif(F.col("n_rows") - F.col("n_labels"), F.lit(0)), F.lit(0.0))
    return out.select("layer", "n_labels", "n_rows", ratio.alias("calinski_harabasz"), "davies_bouldin")


def shapes(x: DataFrame) -> DataFrame:
    """layer, mean_cos (of all pairs of rows) and eff_rank ((sum of variances)^2 / sum of squared covariances; null without variance).

    A task adds its rows into one matrix of dimension by dimension a layer; what is shuffled depends on tasks and dimensions only.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column("layer").to_pylist(), object)
            for name in dict.fromkeys(names):
                v = b.column("vec").filter(pa.array(names == name))
                v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                v = np.hstack([np.ones((len(v), 1)), v])
                grams[name] = grams.get(name, 0) + v.T @ v
        for name, g in grams.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_pydict({"layer": pa.array([name] * g.size), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "g": g.ravel()})

    cells = x.select("layer", "vec").mapInArrow(added, "layer string, i int, j int, g double").groupBy("layer", "i", "j").agg(F.sum("g").alias("g"))
    n = cells.where("i = 0 AND j = 0").select("layer", F.col("g").alias("n"))
    mean = cells.where("i = 0 AND j > 0").select("layer", "j", F.col("g").alias("s"))
    cov = cells.where("i > 0 AND j > 0").join(mean, ["layer", "j"]).join(mean.toDF("layer", "i", "t"), ["layer", "i"]).join(n, "layer").withColumn("c", F.col("g") - F.col("s") * F.col("t") / F.col("n"))
    diagonal = F.col("i") == F.col("j")
    out = cov.groupBy("layer").agg(F.max("n").alias("n"), F.sum(F.when(diagonal, F.col("c"))).alias("trace"), F.sum(F.col("c") * F.col("c")).alias("square"), F.sum(F.when(diagonal, F.col("s") * F.col("s"))).alias("whole"))
    return out.select("layer", ((F.col("whole") - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0))).alias("mean_cos"), (F.col("trace") * F.col("trace") / F.nullif(F.col("square"), F.lit(0.0))).alias("eff_rank"))
