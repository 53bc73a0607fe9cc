"""Readers and writers of detection data: CSV with a byte order mark, JSON cells, box labels, split lists, image headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("confidence", T.DoubleType())])
BOXES = T.ArrayType(T.ArrayType(T.DoubleType()))
PREDICTIONS = T.ArrayType(BOX)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A headed CSV with doubled quotes; blank cells and NaN are null."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)
    return clean(df)


def clean(df: DataFrame) -> DataFrame:
    """Blank strings and non-finite numbers to null."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(F.trim(c), F.lit(""))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def json_boxes(cell: Column, schema: T.DataType = BOXES) -> Column:
    """A JSON list in a cell; null, blank and what isn't a list is empty."""
    return F.coalesce(F.when(F.trim(cell).startswith("["), F.from_json(cell, schema)), F.array().cast(schema.simpleString()))


def to_json_cell(value: Column) -> Column:
    return F.to_json(value)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Text files of `class cx cy w h` lines, normalised: stem, object_id, the five numbers and flags of what is wrong."""
    lines = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("stem"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("object_id", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    out = lines.withColumn("parts", parts)
    names = ["class_id", "cx", "cy", "w", "h"]
    out = out.select("stem", "object_id", F.size("parts").alias("fields"), *[F.get("parts", k).try_cast("double").alias(n) for k, n in enumerate(names)])
    finite = F.lit(True)
    for n in names:
        finite = finite & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    ranges = F.coalesce(F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("w") > 0) & (F.col("w") <= 1) & (F.col("h") > 0) & (F.col("h") <= 1), F.lit(False))
    inside = F.coalesce((F.col("cx") - F.col("w") / 2 >= -1e-6) & (F.col("cx") + F.col("w") / 2 <= 1 + 1e-6) & (F.col("cy") - F.col("h") / 2 >= -1e-6) & (F.col("cy") + F.col("h") / 2 <= 1 + 1e-6), F.lit(False))
    return out.withColumn("five_fields", F.col("fields") == 5).withColumn("finite", finite).withColumn("class_ok", F.coalesce(F.col("class_id") == 0, F.lit(False))).withColumn("ranges", ranges).withColumn("inside", inside).drop("fields")


def label_status(labels: DataFrame) -> DataFrame:
    """One row for each label file with lines: how many, its classes, whether any line is invalid or out of the image, and OK or REVIEW."""
    valid = F.col("five_fields") & F.col("finite") & F.col("ranges")
    per = labels.groupBy("stem").agg(F.count("*").alias("objects"), F.array_join(F.array_sort(F.collect_set(F.when(valid, F.col("class_id").cast("int").cast("string")))), ";").alias("classes"), F.max(~valid).alias("invalid"), F.max(valid & ~F.col("inside")).alias("out_of_bounds"))
    return per.withColumn("status", F.when(F.col("invalid") | F.col("out_of_bounds"), "REVIEW").otherwise("OK"))


def date_conflict(path: Column) -> Column:
    """Whether the date in a folder's name (serial_date_...) differs from the one in the file's name; false where either lacks one."""
    folder = F.nullif(F.regexp_extract(path, r"(?:^|/)SN[^_/]+_([0-9]{8})_[^/]*/", 1), F.lit(""))
    own = file_name_parts(F.regexp_extract(path, r"([^/]*)$", 1))["date"]
    return F.coalesce(folder != own, F.lit(False))


def corners(labels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Normalised centres to absolute corners."""
    return labels.select("stem", "object_id", ((F.col("cx") - F.col("w") / 2) * width).alias("x0"), ((F.col("cy") - F.col("h") / 2) * height).alias("y0"), ((F.col("cx") + F.col("w") / 2) * width).alias("x1"), ((F.col("cy") + F.col("h") / 2) * height).alias("y1"))


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    """partition (the file's name), position and stem of text files with one image path a line."""
    rows = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("partition"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("position", "image"))
    return rows.withColumn("stem", F.regexp_extract("image", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Objects of PASCAL VOC annotations."""
    schema = "name string, bndbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    return spark.read.format("xml").option("rowTag", "object").schema(schema).load(path).select("name", "bndbox.*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.xml$", 1).alias("stem"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder with its length and SHA-256."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def _number(content: Column, at: int, size: int, big: bool) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size) if big else _reversed(content, at, size)), 16, 10).cast("long")


def _reversed(content: Column, at: int, size: int) -> Column:
    return F.concat(*[F.substring(content, at + k + 1, 1) for k in reversed(range(size))])


def image_size(content: Column) -> tuple[Column, Column]:
    """Width and height from the header of a BMP or PNG."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    w = F.when(png, _number(content, 16, 4, True)).otherwise(_number(content, 18, 4, False))
    h = F.when(png, _number(content, 20, 4, True)).otherwise(_number(content, 22, 4, False))
    h = F.when(h > 2147483647, 4294967296 - h).otherwise(h)  # a BMP stored from the top has a negative height
    return w, h


def file_name_parts(name: Column) -> dict[str, Column]:
    """Date, time and timestamp in a name such as M1_0042_20240131_101530(7): null where they aren't there."""
    day, clock = F.nullif(F.regexp_extract(name, r"(?<![0-9])([0-9]{8})(?![0-9])", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(?<![0-9])([0-9]{6})(?![0-9])", 1), F.lit(""))
    return {"prefix": F.regexp_extract(name, r"^([^_]*)", 1), "date": day, "time": clock, "timestamp": F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")), "opaque": F.nullif(F.regexp_extract(name, r"\(([0-9]+)\)$", 1), F.lit(""))}


def export_predictions(images: DataFrame, floor: float) -> DataFrame:
    """(image, prediction_id, corners, confidence) with ids numbered after the filter."""
    rows = images.select("stem", F.posexplode(F.filter("predictions", lambda p: p["confidence"] >= floor)).alias("prediction_id", "p"))
    return rows.select("stem", "prediction_id", *[F.col("p.bbox")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("p.confidence").alias("confidence"))


def append_manifest(df: DataFrame, path: str) -> None:
    """One JSON row of a run's facts."""
    df.write.mode("append").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document over several lines: one row for it, or one for each element if it is a list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON object a line; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def write_fold_lists(lists: DataFrame, path: str) -> None:
    """(fold, partition, name): a text file with a name a line in fold=.../partition=..., names in order; refuses to overwrite."""
    lists.select("fold", "partition", F.col("name").cast("string")).repartitionByRange("fold", "partition", "name").sortWithinPartitions("fold", "partition", "name").write.mode("errorifexists").partitionBy("fold", "partition").text(path)


def fold_documents(folds: DataFrame, names: list[str]) -> DataFrame:
    """One row for each fold with its dataset description as YAML: paths of the lists and the names of the classes."""
    classes = "".join(f"\n  {k}: {n}" for k, n in enumerate(names))
    text = F.format_string("train: fold=%s/partition=train\nval: fold=%s/partition=test\nnames:" + classes.replace("%", "%%"), "fold", "fold")
    return folds.select("fold").distinct().withColumn("document", text)


def write_manifest(df: DataFrame, path: str, key: str) -> None:
    """A manifest of tiles or processed images: its key must be unique; refuses to overwrite."""
    if df.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"{key} repeats in the manifest")
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
