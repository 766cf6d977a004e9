"""GeoJSON as text: a feature a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<array<double>>>"


def to_geojson(features: DataFrame, path: str, *, geometry: str = "geometry") -> None:
    """Write ``features`` to the folder ``path``, a feature a line (GeoJSONSeq without separators): ``geometry`` (GeoJSON text) is the
    shape, all other columns are properties; nulls are kept. Lines are written in parallel."""
    others = [c for c in features.columns if c != geometry]
    properties = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    line = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}"))
    features.select(line.alias("value")).write.mode("errorifexists").text(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a folder or file with a feature a line: the columns of ``properties`` (a schema text) and ``geometry`` (text)."""
    line = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json(F.get_json_object("value", "$.properties"), properties)
    return line.select(read.alias("p"), F.get_json_object("value", "$.geometry").alias("geometry")).select("p.*", "geometry")


def rings(geometry: str = "geometry"):
    """The rings (arrays of x, y structs) of a GeoJSON Polygon or MultiPolygon as a column, for rasterize."""
    at = F.get_json_object(geometry, "$.coordinates")
    many = F.get_json_object(geometry, "$.type") == "MultiPolygon"
    found = F.when(many, F.flatten(F.from_json(at, f"array<{POINTS}>"))).otherwise(F.from_json(at, POINTS))
    return F.transform(found, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
