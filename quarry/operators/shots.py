"""Examples for prompts: records by paragraph, clusters of embeddings, random, diverse and similar choices."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import relevant_sentences
from quarry.operators.ordered import sample_by_hash

CLUSTERS = 10


def records_by_paragraph(curated: DataFrame, least: int = 1) -> DataFrame:
    """(para_id, records, keywords): each paragraph's records, in order, and the set of their names."""
    record = F.struct("material", F.col("property_name").alias("property"), F.col("property_value").alias("value"))
    rows = curated.groupBy("para_id").agg(F.array_sort(F.collect_list(record)).alias("records"), F.array_sort(F.collect_set("property_name")).alias("keywords"))
    return rows.where(F.size("records") >= least)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def centroids(rows: DataFrame, vector: str = "embedding", k: int = CLUSTERS, seed: int = 1) -> DataFrame:
    """(cluster, centroid): k-means centres; k rows."""
    made = rows.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(made)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centres, "cluster int, centroid array<double>")


def label_means(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(cluster, centroid): the mean vector of each label, component by component, summed map-side."""
    flat = rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return flat.groupBy(F.col(label).alias("cluster")).agg(mean.alias("centroid"))


def nearest_centroid(rows: DataFrame, centres: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance): each row's nearest centre; the centres are few and held as one array."""
    held = F.broadcast(centres.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("__c")))
    best = F.array_min(F.transform("__c", lambda c: F.struct(F.round(squared_distance(F.col(vector), c["centroid"]), 9).alias("distance"), c["cluster"].alias("cluster"))))
    return rows.join(held).select(id_, best.alias("__b")).select(id_, F.col("__b.cluster").alias("cluster"), F.col("__b.distance").alias("distance"))


def representatives(rows: DataFrame, centres: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cluster, id, distance): of each centre the row nearest to it among all rows."""
    held = F.broadcast(centres.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("__c")))
    pairs = rows.join(held).select(F.col(id_).alias("id"), F.explode(F.transform("__c", lambda c: F.struct(c["cluster"].alias("cluster"), F.round(squared_distance(F.col(vector), c["centroid"]), 9).alias("distance")))).alias("p"))
    return pairs.groupBy("p.cluster").agg(F.min_by(F.struct("id", "p.distance"), F.struct("p.distance", "id")).alias("b")).select("cluster", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))


def random_shots(examples: DataFrame, n: int, key: str = "para_id", seed: int = 0) -> DataFrame:
    return sample_by_hash(examples, n, key, seed)


def diverse_shots(rows: DataFrame, centres: DataFrame, n: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The representatives of the first n clusters."""
    return representatives(rows, centres, id_, vector).orderBy("cluster").limit(n)


def similar_shots(rows: DataFrame, centres: DataFrame, queries: DataFrame, n: int, id_: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_id, rank, id): for each query the representatives of the n clusters nearest to it."""
    reps = representatives(rows, centres, id_, vector).select("cluster", "id").join(centres, "cluster")
    held = F.broadcast(reps.groupBy().agg(F.collect_list(F.struct("cluster", "id", "centroid")).alias("__c")))
    near = F.slice(F.array_sort(F.transform("__c", lambda c: F.struct(F.round(squared_distance(F.col(query_vector), c["centroid"]), 9).alias("d"), c["cluster"].alias("cluster"), c["id"].alias("id")))), 1, n)
    return queries.join(held).select(query_id, F.posexplode(near).alias("at", "s")).select(query_id, (F.col("at") + 1).alias("rank"), F.col("s.id").alias("id"))


def selector(kind: str, **settings):
    """The choice of examples by name: random, diverse or similar, with its settings bound."""
    kinds = {"random": random_shots, "diverse": diverse_shots, "similar": similar_shots}
    if kind not in kinds:
        raise ValueError(f"{kind!r} is none of {sorted(kinds)}")
    return lambda *tables, **more: kinds[kind](*tables, **(settings | more))


def shot_text(text, keywords) -> Column:
    """A shot's relevant sentences only."""
    return F.array_join(relevant_sentences(text, keywords), " ")


def cached(spark: SparkSession, path: str, make, rebuild: bool = False) -> DataFrame:
    """The table at a path, made and written first if it isn't there or is to be rebuilt."""
    from pyspark.errors import AnalysisException

    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
