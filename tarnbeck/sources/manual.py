"""Hand-made Markdown packages: texts with a map from their lines to the pages of the original."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): lines of text files, numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"^\x{FEFF}|(?:\r\n|\n|\r)\z", "").alias("t"))
    return whole.select("path", F.posexplode(F.split("t", r"\r\n|\n|\r")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def page_map_errors(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, code, page): page maps that overlap, leave lines out, or point beyond the text.

    pages: path, page, first_line, last_line.
    """
    n = lines.groupBy("path").agg(F.max("line").alias("n"))
    w = Window.partitionBy("path").orderBy("first_line", "page")
    p = pages.join(n, "path", "left").withColumn("before", F.lag("last_line").over(w)).withColumn("is_last", F.lead("page").over(w).isNull())
    code = (
        F.when(F.col("n").isNull() | (F.col("last_line") > F.col("n")), "BEYOND_TEXT")
        .when(F.col("last_line") < F.col("first_line"), "REVERSED")
        .when(F.col("first_line") <= F.col("before"), "OVERLAP")
        .when(F.col("first_line") > F.coalesce("before", F.lit(0)) + 1, "GAP")
        .when(F.col("is_last") & (F.col("last_line") < F.col("n")), "UNMAPPED_END")
    )
    return p.select("path", code.alias("code"), "page").where("code is not null")


def lines_with_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, line, text, page): each line with the page it is on, null outside the map.

    An equi join on the path with the range tested in it; a path's map is as long as its pages.
    """
    p = pages.select(F.col("path").alias("__p"), "page", "first_line", "last_line")
    on = (F.col("path") == F.col("__p")) & (F.col("line") >= F.col("first_line")) & (F.col("line") <= F.col("last_line"))
    return lines.join(p, on, "left").select("path", "line", "text", "page")
