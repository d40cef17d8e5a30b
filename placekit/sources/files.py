"""File sources and sinks: GeoJSON layers, static lists, snapshots with a last good copy, pruned JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.sources.remote import Kept

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_layers(spark: SparkSession, glob: str) -> DataFrame:
    """layer (the file's name), type, coordinates (JSON text), properties of GeoJSON feature collections."""
    raw = spark.read.schema(FEATURES).option("multiLine", True).json(glob)
    layer = F.regexp_extract(F.input_file_name(), r"(?:ep-)?([^/]+?)\.geojson$", 1)
    return raw.select(layer.alias("layer"), F.explode("features").alias("f")).select("layer", "f.geometry.type", "f.geometry.coordinates", "f.properties")


def clean_properties(c: Column, most: int = 120) -> Column:
    """Properties that aren't blank, trimmed and cut to ``most`` characters."""
    return F.map_filter(F.transform_values(c, lambda _, v: F.substring(F.trim(v), 1, most)), lambda _, v: v.isNotNull() & (v != ""))


def read_or_last(spark: SparkSession, read, snapshot: str) -> DataFrame:
    """``read()`` written as a new version; if it fails or is empty, the last whole version, marked stale. No version is ever overwritten."""
    rows, stale = Kept(spark, snapshot, 0).get_or_last("good", read)
    return rows.withColumn("stale", F.lit(stale))


def write_places(places: DataFrame, path: str) -> None:
    """Closed places left out, empty texts and false flags as null, one JSON object a line without nulls."""
    cols = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.when(F.col(c), F.col(c)).alias(c) if t == "boolean" else F.col(c) for c, t in places.dtypes]
    open_ = places.where(F.coalesce(F.col("access"), F.lit("")) != "closed") if "access" in places.columns else places
    open_.select(*cols).write.mode("overwrite").option("ignoreNullFields", True).json(path)
