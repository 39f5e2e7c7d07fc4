"""Sources and sinks: first rows, binary objects, nested JSON, optional tables, staged publication, text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_row(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of a total order, or none."""
    return df.orderBy(*order).limit(1)


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Objects under a prefix: path, modificationTime, length, content. Spark's source passes over empty objects."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def nested_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one array of nested rows each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalogue table, or no rows of its schema where it has not been created yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def evolved(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The frame under a newer schema: columns that it lacks get their default or null; nulls it has stay."""
    defaults = defaults or {}
    of = lambda f: F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
    return df.select(*[of(f).cast(f.dataType).alias(f.name) for f in schema])


def publish(parts: dict[str, DataFrame], row: DataFrame, root: str, name: str) -> None:
    """All or nothing: the objects go to a place of their own, then the row that names it (``objects``) is added to ``rows``. Where a step
    fails the place is cleared and no row shows it; what was published before is not touched. A name is used once."""
    spark, place = row.sparkSession, f"{root}/objects/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(place)
    try:
        for part, df in parts.items():
            df.write.parquet(f"{place}/{part}")
        row.withColumn("objects", F.lit(place)).write.mode("append").parquet(f"{root}/rows")
    except Exception:
        fs.delete(path, True)
        raise


def commit(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Several tables at once, or none: all are written to a place of their own, then one small file names it. The file comes into being by a
    rename, after which readers see all tables as they are there; where a step fails no reader sees any. A name is used once."""
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, said = f"{root}/batches/{name}", f"{root}/commits/{name}"
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop.Path(said)) or fs.exists(hadoop.Path(place)):
        raise FileExistsError(name)
    try:
        for table, df in tables.items():
            df.write.parquet(f"{place}/{table}")
        fs.mkdirs(hadoop.Path(f"{root}/commits"))
        fs.create(hadoop.Path(f"{place}/_committed")).close()
        if not fs.rename(hadoop.Path(f"{place}/_committed"), hadoop.Path(said)):
            raise OSError(f"{said} could not be written")
    except Exception:
        fs.delete(hadoop.Path(place), True)
        raise


def committed(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table as the last commit by name left it; none before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{root}/commits")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
    return spark.read.parquet(f"{root}/batches/{names[-1]}/{table}") if names else None


def text_sink(df: DataFrame, line: Column, path: str) -> None:
    """One line of text per row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def sitemap_sink(df: DataFrame, path: str, most: int = 50_000) -> None:
    """Site maps: XML documents of ``most`` addresses at most, one a file, in the order of the addresses; ``lastmod`` may be null.

    Rows are cut by ranges of loc into parts of their own; a part of more is cut again by number, so that no document is too long.
    """
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    url = F.concat(F.lit("  <url><loc>"), safe(F.col("loc")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "lastmod", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    n = df.count()
    parts = df.repartitionByRange(max(1, -(-n // most)), "loc").withColumn("part", F.spark_partition_id())
    row = F.row_number().over(Window.partitionBy("part").orderBy("loc")) - 1
    docs = parts.select("part", F.floor(row / most).alias("k"), "loc", url.alias("url")).groupBy("part", "k").agg(F.array_sort(F.collect_list(F.struct("loc", "url"))).alias("u"))
    head, foot = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n</urlset>"
    docs = docs.select("part", "k", F.concat(F.lit(head), F.array_join(F.transform("u", lambda x: x["url"]), "\n"), F.lit(foot)).alias("value"))
    docs.withColumn("document", F.concat_ws("-", "part", "k")).select("value", "document").repartition("document").write.mode("overwrite").partitionBy("document").text(path)


def manifest(files: DataFrame, path: str) -> None:
    """Names and sizes of files as JSON lines."""
    files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length").write.mode("overwrite").json(path)
