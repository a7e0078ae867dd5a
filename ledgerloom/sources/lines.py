"""Files and text lines: the input side of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.scan import ordered_scan


def discover(spark: SparkSession, root: str, extension: str = "txt") -> DataFrame:
    """Files under a folder, recursively: ``(path, name, size)`` in path order.

    The extension is matched in any case; files and folders whose name starts with a dot are left
    out.  File contents are not read.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", F.col("length").alias("size")))
    # only the part below the root decides: the root itself may lie under a dot folder
    marker = root.rstrip("/").removeprefix("file:").lstrip("/") + "/"
    below = F.substring_index(F.col("path"), marker, -1)
    return (found.withColumn("name", F.element_at(F.split("path", "/"), -1))
            .where(F.lower("name").endswith("." + extension.lower()) & ~F.concat(F.lit("/"), below).rlike(r"/\."))
            .select("path", "name", "size").orderBy("path"))


def read_pages(spark: SparkSession, root: str, page_break: str = "\f") -> DataFrame:
    """Text files as pages: ``(stmt_id, page_no, text)``, pages separated by a form feed."""
    text = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("stmt_id"), "value")
    return split_pages(text, page_break)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def split_pages(texts: DataFrame, page_break: str = "\f") -> DataFrame:
    """Whole texts ``(stmt_id, value)`` as pages; ``offset`` counts the lines of the pages before.

    A row holds a whole document, so the offsets need no other row.
    """
    parts = texts.select("stmt_id", F.split("value", page_break).alias("parts"))
    before = F.aggregate(F.transform("parts", line_count), F.array(F.lit(0)),
                         lambda upto, n: F.concat(upto, F.array(F.element_at(upto, -1) + n)))
    return parts.withColumn("before", before).select(
        "stmt_id", "before", F.posexplode("parts").alias("page_no", "text")).select(
        "stmt_id", (F.col("page_no") + 1).alias("page_no"), "text", F.get("before", F.col("page_no")).alias("offset"))


def explode_lines(pages: DataFrame, doc: str = "stmt_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Pages to numbered lines: blank lines count but are not emitted; runs of blanks become one space.

    Pages with an ``offset`` (see ``split_pages``) are exploded where they are; for others the offsets
    come from the line counts of the pages before, and the text is shuffled once to meet them.
    """
    if "offset" not in pages.columns:
        sizes = pages.select(doc, page, line_count(F.col(text)).alias("n")).withColumn("block", F.floor(F.col(page) / 1000))
        offsets = ordered_scan(sizes, [doc], ["block"], [page], sums={"upto": F.col("n")}).select(
            doc, page, (F.col("upto") - F.col("n")).alias("offset"))
        pages = pages.select(doc, page, text).join(offsets, [doc, page])
    lines = pages.select(doc, page, "offset", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace("raw", r"[ \t\x{00A0}]+", " "), r"^\s+|\s+$", ""))
    return lines.select(doc, F.col(page).cast("int").alias(page),
                        (F.col("offset") + F.col("pos") + 1).cast("int").alias("line_no"),
                        cleaned.alias("text")).where("text <> ''")
