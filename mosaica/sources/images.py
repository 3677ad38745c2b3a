"""Image files, split folders, case folders, and the tables that jobs hand on."""

from __future__ import annotations

import csv
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp"]
VECTORS = "marker string, vectors string, domain string, stain1 array<double>, stain2 array<double>, separation_deg double"
SCORE_KEYS = ["marker", "vectors", "control", "stage"]
#: What tells runs apart whose scores lie in one table.
RUN_SETTINGS = ["offset", "limit", "seed", "shuffles", "sample", "slide_regex", "image_size", "invert", "field_combine"]


@F.pandas_udf(BinaryType())
def _rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(x: bytes, n: int) -> bytes:
        if n not in (1, 3, 4):
            return b""
        a = np.frombuffer(x, np.uint8).reshape(-1, n)
        return (np.repeat(a, 3, 1) if n == 1 else a[:, 2::-1]).tobytes()

    return pd.Series([one(x, n) for x, n in zip(data, channels, strict=True)])


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, name, h, w, rgb (row by row; R, G, B), valid: files under path with a known extension in any case.

    A file that can't be decoded stays as a row with valid = false and no pixels.
    """
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    known = raw.where(F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1)).isin(EXTENSIONS))
    valid = F.col("height") > 0
    return known.select("origin", F.regexp_extract("origin", r"([^/]+)$", 1).alias("name"), F.col("height").alias("h"), F.col("width").alias("w"), F.when(valid, _rgb("data", "nChannels")).alias("rgb"), valid.alias("valid"))


def tiling_counts(crops: DataFrame, images_: DataFrame, kept: str) -> DataFrame:
    """For each image how many crops were written and skipped; an image that can't be decoded counts 0 and 0."""
    by = crops.groupBy("origin").agg(F.count_if(F.col(kept)).alias("written"), F.count_if(~F.col(kept)).alias("skipped"))
    zero = F.lit(0).cast("long")
    return images_.select("origin").join(by, "origin", "left").select("origin", F.coalesce("written", zero).alias("written"), F.coalesce("skipped", zero).alias("skipped"))


def with_split(rows: DataFrame, root: str, subdirs: list[str], origin: str | Column = "origin") -> DataFrame:
    """rows with `split`: each of subdirs is SRC or SRC:DST; files directly in root/SRC get DST, all others go.

    A folder that is missing or empty gives no rows.
    """
    names = [(s, d or s) for s, _, d in (x.partition(":") for x in subdirs)]
    table = rows.sparkSession.createDataFrame(names, "_src string, split string")
    # Spark names local files file:/... or file:///..., so only the path after the scheme counts
    path = F.regexp_replace(origin, "^[a-z]+:/*", "/")
    prefix = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
    inside = rows.withColumn("_path", path).where(F.col("_path").startswith(prefix))
    inside = inside.withColumn("_src", F.regexp_extract(F.substr("_path", F.length(prefix) + 1), "^(.*)/[^/]+$", 1))
    return inside.join(F.broadcast(table), "_src").drop("_src", "_path")  # as many rows as arguments


def case_index(rows: DataFrame, origin: str = "origin") -> DataFrame:
    """case_id, id, origin of files root/CASE/images/ID.ext; of one id with several extensions the last file by name stays."""
    found = rows.select(F.regexp_extract(origin, r"([^/]+)/images/[^/]+$", 1).alias("case_id"), F.regexp_extract(origin, r"/images/([^/]+)\.[^./]+$", 1).alias("id"), F.col(origin).alias("origin"))
    return found.where("case_id <> '' AND id <> ''").groupBy("case_id", "id").agg(F.max("origin").alias("origin"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written to a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stain vectors as written; a row without one of the two vectors is left out."""
    return spark.read.schema(VECTORS).json(path).where("size(stain1) = 3 AND size(stain2) = 3")


def append_scores(scores: DataFrame, path: str, settings: list[str] | None = None) -> None:
    """One row for each combination, with every setting that made it, in folders by marker, vectors, control, stage and run.

    `run` names the other settings of the run (the columns `settings` that scores has). Writing a run again replaces its rows, and other runs stay as they are.
    """
    named = [c for c in settings or RUN_SETTINGS if c in scores.columns]
    run = F.concat(F.lit("r"), F.md5(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}))) if named else F.lit("all")
    scores.withColumn("run", run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCORE_KEYS, "run").parquet(path)


def write_diagrams(rows: DataFrame, path: str, by: list[str]) -> None:
    """The points of diagrams (diagram_rows()) with their lifetime, values at 6 decimals, in folders by the columns `by`; writing a folder again replaces it."""
    values = {"birth": F.col("birth"), "death": F.col("death"), "lifetime": F.col("death") - F.col("birth")}
    rows.withColumns({n: F.round(v, 6) for n, v in values.items()}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def case_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """case_id, id, x, y, tile_size, line: the tiles that the files root/CASE/tiles_metadata.csv place on their slide, in the order of each file.

    Columns (tile_name, x, y, tile_size) may stand in any order and beside others; a tile that is named again moves to its last place but keeps its line. A file
    with a row that lacks one of them, or holds no whole number, says nothing: its case has no rows. A file is read as one row, as it lists the tiles of a single case.
    """
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "tiles_metadata.csv").load(root)
    return coordinates(files.select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("csv")))


PLACED = "array<struct<id: string, x: long, y: long, tile_size: long>>"


def coordinates(files: DataFrame) -> DataFrame:
    """case_coordinates() of rows (origin: .../CASE/tiles_metadata.csv, csv: what the file holds)."""

    def placed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found: dict[str, tuple] = {}
            try:
                for row in csv.DictReader(io.StringIO(t.as_py() or "", newline="")):
                    found[row["tile_name"]] = (int(row["x"]), int(row["y"]), int(row["tile_size"]))
            except (KeyError, TypeError, ValueError):
                found = {}
            out.append([{"id": k, "x": x, "y": y, "tile_size": n} for k, (x, y, n) in found.items() if k is not None])
        return pa.array(out, pa.list_(pa.struct([("id", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("tile_size", pa.int64())])))

    case = F.regexp_extract("origin", r"([^/]+)/tiles_metadata\.csv$", 1).alias("case_id")
    rows = files.select(case, F.posexplode(F.arrow_udf(placed, PLACED).asNondeterministic()(F.col("csv"))).alias("line", "t"))
    return rows.select("case_id", "t.*", "line")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """case_id, id, origin of the images root/CASE/images/ID.ext with a known extension; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("origin"))
    return case_index(files.where(F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1)).isin(EXTENSIONS)))
