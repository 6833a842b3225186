"""Files as tables: PDF and image collections, JSON records and their migration to Parquet, exports."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import upserted


def pdfs(spark: SparkSession, paths: list[str], content: bool = False) -> DataFrame:
    """PDFs among the given files and in the given folders, not below them: (path, length[, content]).

    Without content no file is opened, only listed. Upper-case endings count. A missing path is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(paths)
    return found.select("path", "length", *["content"] * content)


def images(spark: SparkSession, doc: str, folder: str) -> DataFrame:
    """Images of a folder as rows of a blob table: (doc, name, length, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select(F.lit(doc).alias("doc"), name.alias("name"), "length", "content")


def with_images(old: DataFrame, spark: SparkSession, doc: str, folder: str) -> DataFrame:
    """A blob table with a document's images put or replaced by name."""
    return upserted(old, images(spark, doc, folder), ["doc", "name"])


def _turned(block: bytes) -> bool:
    """Whether an APP1 block's EXIF orientation (tag 274) lays the image on its side: 6 or 8."""
    if not block.startswith(b"Exif\0\0"):
        return False
    tiff = block[6:]
    end = "<" if tiff[:2] == b"II" else ">"
    try:
        (at,) = struct.unpack_from(f"{end}I", tiff, 4)
        (n,) = struct.unpack_from(f"{end}H", tiff, at)
        tags = (struct.unpack_from(f"{end}HHIH", tiff, at + 2 + 12 * i) for i in range(n))
        return any(tag == 274 and value in (6, 8) for tag, _, _, value in tags)
    except struct.error:
        return False


def image_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height by the header of a PNG, GIF, BMP or JPEG (as its EXIF turns it); None of others and broken ones."""
    try:
        if content.startswith(b"\x89PNG"):
            return struct.unpack_from(">II", content, 16)
        if content.startswith(b"GIF8"):
            return struct.unpack_from("<HH", content, 6)
        if content.startswith(b"BM"):
            width, height = struct.unpack_from("<ii", content, 18)
            return width, abs(height)
        at, turned = 2, False
        while content.startswith(b"\xff\xd8"):
            mark, kind, length = struct.unpack_from(">BBH", content, at)
            if mark != 0xFF:
                break
            if kind == 0xFF:  # filling
                at += 1
                continue
            if kind == 0xE1 and _turned(content[at + 4 : at + 2 + length]):
                turned = True
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame, not tables
                height, width = struct.unpack_from(">HH", content, at + 5)
                return (height, width) if turned else (width, height)
            at += 2 + length
    except struct.error:
        pass
    return None, None


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer"))
def _sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(c) for c in content], columns=["width", "height"]).astype("Int32")


def labelled(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Images of <root>/images/<split> with the number rows of the text file of the same name in <root>/labels/<split>: (path, width, height, label).

    Blank lines count for nothing; an image without a file of labels has none (null). Images of one name but for the ending share their labels.
    """
    if split not in ("train", "val"):
        raise ValueError(f"split must be train or val, not {split}")
    name = lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.][^.]*$", "")
    found = spark.read.format("binaryFile").load(f"{root}/images/{split}").select("path", name("path").alias("_name"), _sizes("content").alias("_size"))
    texts = spark.read.text(f"{root}/labels/{split}", wholetext=True, pathGlobFilter="*.txt").select(name(F.col("_metadata.file_path")).alias("_name"), "value")
    rows = F.filter(F.split(F.trim("value"), r"\r?\n"), lambda line: F.trim(line) != "")
    label = F.transform(rows, lambda line: F.split(F.trim(line), r"\s+").cast("array<float>"))
    return found.join(texts.select("_name", label.alias("label")), "_name", "left").select("path", "_size.width", "_size.height", "label")


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a whole-file JSON array or of JSON lines; a file that can't be read so gives no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def migrated(spark: SparkSession, tables: dict[str, DataFrame], folder: str, dry: bool = False) -> DataFrame:
    """Each table written as Parquet under its name; rows counted from what was written, or would be: (name, rows)."""
    if not dry:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    kept = tables if dry else {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    out = spark.createDataFrame([], "name string, rows long")
    for name, df in kept.items():
        out = out.unionByName(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")))
    return out


def exported(df: DataFrame, folder: str, form: str) -> None:
    """A result as CSV with a header, JSON lines or XML rows; nested columns only where the format has them."""
    options = {"csv": {"header": True}, "json": {"ignoreNullFields": False}, "xml": {"rowTag": "row", "rootTag": "rows"}}
    df.write.mode("overwrite").format(form).options(**options[form]).save(folder)
