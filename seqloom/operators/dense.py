"""Frame features: quantisation to tokens, and pooling to one vector.

Frames are (utt_id, frame_no, embedding array).  Centroids are (cluster, center);
their number is the vocabulary's, so they are a side of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 6
MAX_CENTROIDS = 100_000


def kmeans_fit(frames: DataFrame, k: int = 100, seed: int = 42, max_frames: int = 500_000, iterations: int = 20) -> DataFrame:
    """Centroids of frames: k-means|| of Spark's library, on at most about max_frames of them (a documented sample)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = frames.count()
    some = frames if n <= max_frames else frames.filter(F.pmod(F.xxhash64("utt_id", "frame_no"), F.lit(1 << 20)) < F.lit(int(max_frames / n * (1 << 20))))
    model = KMeans(k=min(k, max(1, n)), seed=seed, maxIter=iterations).fit(some.select(array_to_vector("embedding").alias("features")))
    return frames.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")


def label_centroids(frames: DataFrame, label: str = "label") -> DataFrame:
    """Centroids as the mean of each label's frames, to 9 places."""
    each = frames.select(label, F.posexplode("embedding").alias("dim", "v"))
    means = each.groupBy(label, "dim").agg(F.round(F.avg("v"), 9).alias("v"))
    items = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return means.groupBy(F.col(label).alias("cluster")).agg(F.transform(items, lambda x: x["v"]).alias("center"))


def kmeans_assign(frames: DataFrame, centroids: DataFrame) -> DataFrame:
    """frames with tok, the nearest centroid (ties of rounded distances: the lowest cluster).

    The centroids become one array in every row's reach, so each frame finds
    its nearest without a row for every pair.
    """
    n = centroids.limit(MAX_CENTROIDS + 1).count()
    if n > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    one = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("centroids"))
    x = frames.join(F.broadcast(one))
    square = lambda c: F.aggregate(F.zip_with("embedding", c, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, y: s + y)
    near = F.array_min(F.transform("centroids", lambda c: F.struct(F.round(F.sqrt(square(c["center"])), PLACES).alias("dist"), c["cluster"].alias("cluster"))))
    return x.withColumn("near", near).select(*frames.columns, F.col("near.cluster").alias("tok"), F.col("near.dist").alias("dist"))


def write_centroids(centroids: DataFrame, path: str, model: str, layer: int) -> None:
    centroids.withColumns({"model": F.lit(model), "layer": F.lit(layer)}).write.parquet(path)


def read_centroids(spark: SparkSession, path: str, model: str, layer: int) -> DataFrame:
    """(cluster, center); raises if they were made of another model or layer."""
    rows = spark.read.parquet(path)
    other = rows.filter((F.col("model") != model) | (F.col("layer") != layer))
    if not other.isEmpty():
        raise ValueError(f"centroids in {path} are not those of {model}, layer {layer}")
    return rows.select("cluster", "center")


def pool(frames: DataFrame, how: str = "mean") -> DataFrame:
    """(id, vector): mean, max, or attn (weights softmax of norm + 1e-8) of an utterance's frames."""
    if how == "attn":
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y)) + 1e-8
        x = frames.withColumn("norm", norm)
        x = x.withColumn("e", F.exp(F.col("norm") - F.expr("max(norm) over (partition by utt_id)")))
        x = x.withColumn("weight", F.col("e") / F.expr("sum(e) over (partition by utt_id)"))
        each = x.select("utt_id", "weight", F.posexplode("embedding").alias("dim", "v"))
        value = F.sum(F.col("weight") * F.col("v"))
    else:
        each = frames.select("utt_id", F.posexplode("embedding").alias("dim", "v"))
        value = F.avg("v") if how == "mean" else F.max("v").cast("double")
    dims = each.groupBy("utt_id", "dim").agg(F.round(value, PLACES).alias("v"))
    items = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return dims.groupBy(F.col("utt_id").alias("id")).agg(F.transform(items, lambda x: x["v"]).alias("vector"))


def tokenise(frames: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, tokens) of all utterances."""
    items = F.array_sort(F.collect_list(F.struct("frame_no", "tok")))
    return kmeans_assign(frames, centroids).groupBy(F.col("utt_id").alias("id")).agg(F.transform(items, lambda x: x["tok"].cast("bigint")).alias("tokens"))


def extract(files: DataFrame, encoder: Callable[[], Callable[[bytes], list[list[float]]]]) -> DataFrame:
    """(utt_id, frame_no, embedding, error) of (path, content): the place for an acoustic encoder.

    encoder() is called once for each task and gives a function from a file's
    bytes to its frames.  A file that fails gives one row with its error and no
    frame; it does not end the job.
    """

    def run(frames):
        of = encoder()
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows += [(name, i, [float(x) for x in v], None) for i, v in enumerate(of(content))]
                except Exception as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["utt_id", "frame_no", "embedding", "error"]).astype({"frame_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "utt_id string, frame_no int, embedding array<double>, error string")
