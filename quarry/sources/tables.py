"""Readers and writers of tables, files and settings.

Tables are Parquet folders under a root. Keys are unique by how rows are inserted:
an insert takes only rows whose natural key is new, in one anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas

FORMATS = ("parquet", "json", "csv", "orc")


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create_all(self) -> None:
        schemas.create_all(self.spark, self.root)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.table(name).schema).parquet(self.path(name))

    def get_all(self, name: str, **criteria) -> DataFrame:
        """Rows that meet all equalities; None meets null."""
        rows = self.read(name)
        for k, v in criteria.items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        return rows

    def get_n(self, name: str, n: int, **criteria) -> DataFrame:
        """The first n of them by id."""
        return self.get_all(name, **criteria).orderBy("id").limit(n)

    def get_one(self, name: str, **criteria):
        return self.get_n(name, 1, **criteria).first()

    def get_id(self, name: str, **criteria) -> int | None:
        row = self.get_n(name, 1, **criteria).select("id").first()
        return row.id if row else None

    def exists(self, name: str, **criteria) -> bool:
        return not self.get_all(name, **criteria).isEmpty()

    def query(self, sql: str, **parameters) -> DataFrame:
        """SQL with named ``:parameters`` over the tables as views."""
        for name in schemas.names():
            if name in sql:
                self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(sql.rstrip().rstrip(";"), args=parameters)

    def append(self, name: str, rows: DataFrame) -> None:
        _fitted(rows, name).write.mode("append").parquet(self.path(name))

    def insert_new(self, name: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Append the rows whose natural key isn't there; of repeats the first by ``order``. Returns what was appended."""
        fresh = _fitted(new_rows(rows, self.read(name), list(schemas.table(name).key), order), name)
        path = f"{self.path(name)}__new"
        fresh.write.mode("overwrite").parquet(path)
        added = self.spark.read.schema(schemas.table(name).schema).parquet(path)
        added.write.mode("append").parquet(self.path(name))
        return added

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a table by rows that may come from itself: written beside it first."""
        path = f"{self.path(name)}__next"
        _fitted(rows, name).write.mode("overwrite").parquet(path)
        self.spark.read.schema(schemas.table(name).schema).parquet(path).write.mode("overwrite").parquet(self.path(name))

    def delete(self, name: str, condition) -> None:
        """Rows for which the condition is true go."""
        self.overwrite(name, self.read(name).where(~F.coalesce(condition, F.lit(False))))

    def delete_matching(self, name: str, other: DataFrame, on: list[str]) -> None:
        """Rows that have a partner in another table go."""
        self.overwrite(name, without(self.read(name), other, on))

    def update(self, name: str, condition, **values) -> None:
        """New values where the condition is true, in one pass."""
        self.overwrite(name, updated(self.read(name), condition, **values))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """New rows replace those of their key."""
        key = list(schemas.table(name).key)
        self.overwrite(name, upserted(self.read(name), _fitted(rows, name), key))

    def export(self, path: str, names: list[str] | None = None, form: str = "parquet") -> None:
        """Each table into its own folder, written in parallel."""
        if form not in FORMATS:
            raise ValueError(f"{form!r} is none of {FORMATS}")
        for name in names or schemas.names():
            rows = self.read(name)
            if form == "csv":
                rows = rows.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map") else F.col(f"`{f.name}`") for f in rows.schema])
            rows.write.mode("overwrite").options(header=True).format(form).save(f"{path}/{name}")


def _fitted(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns; missing ones are null, but for an id from the natural key."""
    t = schemas.table(name)
    key = [k for k in t.key if k in rows.columns] or [c for c in rows.columns if c != "id"]
    own = {c.lower() for c in rows.columns}
    made = []
    for f in t.schema:
        c = F.col(f"`{f.name}`") if f.name.lower() in own else F.lit(None)
        if f.name == "id":
            hashed = F.xxhash64(*[F.col(f"`{k}`") for k in key if rows.schema[k].dataType.typeName() != "map"])
            c = F.coalesce(c, hashed) if "id" in own else hashed
        made.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*made)


def new_rows(rows: DataFrame, existing: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """rows whose key isn't in ``existing``, one for each key. Null keys equal each other."""
    if not key:
        return rows
    w = Window.partitionBy(*key).orderBy(*(order or key))
    first = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").alias("a")
    there = existing.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key]).distinct().alias("b")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`__{k}`")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return first.join(there, cond, "left_anti")


def without(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows that have no partner in another table."""
    return rows.join(other.select(*on), on, "left_anti")


def updated(rows: DataFrame, condition, **values) -> DataFrame:
    """rows with new values where the condition is true, in one pass."""
    return rows.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows by their values of ``by``: partitions that they have are replaced, others stay untouched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_partition(spark: SparkSession, path: str, **values: str) -> bool:
    """Remove one partition, as by property and method, without reading any other; false if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in values.items())]))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upserted(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """existing with new rows in place of those of their key."""
    return existing.join(rows.select(*key), key, "left_anti").select(*existing.columns).unionByName(rows.select(*existing.columns))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(doi, relpath, directory, filename, doctype, filebytes, filemtime); contents are not read."""
    from quarry.functions.text import filename_to_doi

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    base = path.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    parts = F.split(F.col("path"), "/")
    name = F.element_at(parts, -1)
    rel = F.substring_index(F.col("path"), f"{base}/", -1)
    return files.select(
        filename_to_doi(name).alias("doi"), rel.alias("relpath"), F.get(parts, F.size(parts) - 2).alias("directory"), name.alias("filename"),
        F.element_at(F.split(name, r"\."), -1).alias("doctype"), F.col("length").alias("filebytes"), F.col("modificationTime").alias("filemtime"),
    )


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Every line has every key; absent values are null."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_dictionary(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """A JSON object of objects as (ord, name, ...): keys in file order, values by the given struct type."""
    text = spark.read.option("wholetext", True).text(path)
    entry = F.posexplode(F.map_entries(F.from_json("value", f"map<string,{value_type}>")))
    return text.select(entry.alias("ord", "e")).select("ord", F.col("e.key").alias("name"), "e.value.*")


def read_property_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_dictionary(spark, path, "struct<property_list:array<string>,unit_list:array<string>>")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def push_names(metadata: DataFrame, names: DataFrame, property_: str) -> DataFrame:
    """metadata whose property has the names added that it lacks, in order."""
    listed = names.groupBy().agg(F.array_sort(F.collect_set("name")).alias("__n"))
    own = F.coalesce("other_names", F.array().cast("array<string>"))
    new = F.when(F.col("name") == property_, F.array_union(own, F.coalesce("__n", F.array().cast("array<string>")))).otherwise(F.col("other_names"))
    return metadata.join(F.broadcast(listed)).withColumn("other_names", new).drop("__n")


def pull_names(metadata: DataFrame, property_: str) -> DataFrame:
    return metadata.where(F.col("name") == property_).select(F.explode("other_names").alias("name"))


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def by_directory(rows: DataFrame, mapping: dict[str, str], name: str = "publisher", to: str = "directory") -> DataFrame:
    """rows with a column looked up by another; unknown names keep what they had."""
    dim = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(to, F.coalesce(F.element_at(dim, F.col(name)), F.col(to)))


def annotated(curated: DataFrame, notes: DataFrame) -> DataFrame:
    """curated rows without conditions get those of an annotation table (id, conditions)."""
    return curated.join(notes.select("id", F.col("conditions").alias("__c")), "id", "left").withColumn("conditions", F.coalesce("conditions", "__c")).drop("__c")


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """An external table read in parallel by ranges of a key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()
