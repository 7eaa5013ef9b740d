"""Sources and sinks: JSON registries and their adapters, files by content, Word documents, append-only tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.scalars import media_of, named_id
from tarnbeck.operators.registry import insert_absent

RECORD = "source string, pointer string, key string, kind string, raw string, unknown_fields array<string>"
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw): whole files as text, a byte order mark removed, in name order."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("raw"))
    return df


def has_null_character(column: str):
    """Whether a text holds U+0000, stored or escaped."""
    return (F.instr(F.col(column), "\x00") > 0) | F.col(column).rlike(r"(?<!\\)(?:\\\\)*\\u0000")


def array_records(df: DataFrame, pointer: str, kind: str, key: str | None, known: list[str]) -> DataFrame:
    """Records (RECORD) of the array at a JSON pointer: one for each element, with its own pointer.

    df: source, raw. Elements keep their raw JSON; fields beyond ``known`` are named in
    unknown_fields. A file without that array, or that is no JSON, gives no record.
    """
    path = "$" + "".join(f".{p}" for p in pointer.strip("/").split("/") if p)
    items = df.select("source", F.posexplode(F.from_json(F.get_json_object("raw", path), T.ArrayType(T.StringType()))).alias("i", "x"))
    names = F.json_object_keys("x")
    return items.select(
        "source",
        F.concat(F.lit(pointer.rstrip("/") + "/"), F.col("i").cast("string")).alias("pointer"),
        (F.get_json_object("x", f"$.{key}") if key else F.col("i").cast("string")).alias("key"),
        F.lit(kind).alias("kind"),
        F.col("x").alias("raw"),
        F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*map(F.lit, known)).cast("array<string>")).alias("unknown_fields"),
    )


def adapter(name: str) -> Callable:
    """Register an adapter: a function from (source, raw) files to RECORD rows."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        ADAPTERS[name] = f
        return f

    return put


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, asset_id, size_bytes, media_type, storage_key): files by content, one row for each path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    sha = F.sha2("content", 256)
    return files.select("path", sha.alias("asset_id"), F.col("length").alias("size_bytes"), media_of("content").alias("media_type"), F.concat(F.lit("objects/"), F.substring(sha, 1, 2), F.lit("/"), sha).alias("storage_key"))


def inventory(found: DataFrame, registered: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(path, asset_id, status, change): each file against the registrations and the run before.

    status: registered, changed (another asset at the path), unregistered or missing. change: added, removed, changed, same, or null without a run before.
    """
    reg = registered.groupBy("path").agg(F.max_by("asset_id", "asset_id").alias("__want"))
    both = found.select("path", "asset_id").join(reg, "path", "full_outer")
    status = F.when(F.col("asset_id").isNull(), "missing").when(F.col("__want").isNull(), "unregistered").when(F.col("__want") == F.col("asset_id"), "registered").otherwise("changed")
    out = both.select("path", "asset_id", status.alias("status"))
    if previous is None:
        return out.withColumn("change", F.lit(None).cast("string"))
    old = previous.select("path", F.col("asset_id").alias("__old")).where("__old is not null")
    joined = out.join(old, "path", "full_outer")
    change = F.when(F.col("__old").isNull() & F.col("asset_id").isNull(), F.lit(None)).when(F.col("__old").isNull(), "added").when(F.col("asset_id").isNull(), "removed").when(F.col("__old") == F.col("asset_id"), "same").otherwise("changed")
    return joined.select("path", "asset_id", "status", change.alias("change"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, kind, xml_path, row_index, column, text): paragraphs and table cells of Word files, in order.

    Files that are no Word documents give one row of kind ``unreadable``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def blocks(content: bytes) -> Iterator[tuple]:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
        for i, e in enumerate(body if body is not None else ()):
            where = f"/body/{e.tag.replace(_W, '')}[{i + 1}]"
            if e.tag == f"{_W}p":
                yield "paragraph", where, None, None, text(e)
            elif e.tag == f"{_W}tbl":
                for r, row in enumerate(e.findall(f"{_W}tr")):
                    col = 0
                    for c, cell in enumerate(row.findall(f"{_W}tc")):
                        yield "cell", f"{where}/tr[{r + 1}]/tc[{c + 1}]", r, col, "\n".join(text(p) for p in cell.findall(f"{_W}p"))
                        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                        col += int(span.get(f"{_W}val", "1")) if span is not None else 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "ordinal", "kind", "xml_path", "row_index", "column", "text"]
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    out += [(p, n, *b) for n, b in enumerate(blocks(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((p, 0, "unreadable", None, None, None, None))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"row_index": "Int32", "column": "Int32", "ordinal": "int32"})

    return files.mapInPandas(read, "path string, ordinal int, kind string, xml_path string, row_index int, column int, text string")


def append_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table at ``path`` does not have; what is there is never rewritten."""
    spark = df.sparkSession
    exists = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    fresh = insert_absent(spark.read.parquet(path), df, keys) if exists else df.dropna(subset=keys).dropDuplicates(keys)
    fresh.write.mode("append").parquet(path)


def write_report(df: DataFrame, folder: str, kind: str) -> str:
    """Write rows as JSON under a name made from their content; the same content is written once. Returns the path."""
    digest = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).agg(F.sha2(F.concat_ws(",", F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")), F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)")), F.count("*")), 256)).first()[0]
    path = f"{folder.rstrip('/')}/{kind}/{digest}"
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").json(path)
    return path


def register(df: DataFrame, namespace: str, *parts: str, out: str = "registration_id") -> DataFrame:
    """``df`` with a deterministic id from its identity columns."""
    return df.withColumn(out, named_id(namespace, *parts))


def read_page_caches(spark: SparkSession, path: str, originals: DataFrame) -> DataFrame:
    """(source, asset_id, page, text, status, issue): the pages of page caches, bound to their originals by hash.

    A cache is JSON: ``sha256`` of its original and ``pages``, an array of ``pdf_page`` and ``text``. originals: asset_id, page_count.
    A cache that is no JSON, names no hash or one that no original has, or whose pages are no array, gives one row with status ``refused``; a page beyond the
    original or met twice is ``refused``, a page without text ``failed``, one with undecoded glyphs ``needs_ocr``, any other ``partial`` (text without
    places). Pages that a cache lacks are ``failed``.
    """
    raw = read_json_text(spark, path).select("source", F.lower(F.get_json_object("raw", "$.sha256")).alias("asset_id"), F.get_json_object("raw", "$.pages").alias("pages"), F.get_json_object("raw", "$").isNotNull().alias("valid"))
    known = originals.select(F.col("asset_id"), F.col("page_count").cast("int").alias("page_count")).dropDuplicates(["asset_id"])
    met = raw.join(known, "asset_id", "left")
    refused = F.when(~F.col("valid"), "CACHE_INVALID").when(F.col("asset_id").isNull(), "CACHE_UNBOUND").when(F.col("page_count").isNull(), "CACHE_HASH_MISMATCH").when(~F.coalesce(F.col("pages").startswith("["), F.lit(False)), "CACHE_INVALID")
    met = met.withColumn("issue", refused)
    whole = met.where("issue is not null").select("source", "asset_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.lit("refused").alias("status"), "issue")
    good = met.where("issue is null")
    page = "array<struct<pdf_page:int,text:string>>"
    cells = good.select("source", "asset_id", "page_count", F.explode(F.from_json("pages", page)).alias("x")).select("source", "asset_id", "page_count", F.col("x.pdf_page").alias("page"), "x.text")
    lone = cells.groupBy("source", "asset_id", "page_count", "page").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    every = good.select("source", "asset_id", "page_count", F.explode(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))).alias("page"))
    pages = every.join(lone, ["source", "asset_id", "page_count", "page"], "full")
    glyphs = (F.size(F.regexp_extract_all("text", F.lit("/G[0-9A-Fa-f]{2,}"), F.lit(0))) >= 3) | F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")
    bad = F.col("page").isNull() | (F.col("page") < 1) | (F.col("page") > F.col("page_count")) | (F.coalesce("n", F.lit(1)) > 1)
    status = F.when(bad, "refused").when(F.col("text").isNull(), "failed").when(glyphs, "needs_ocr").otherwise("partial")
    issue = F.when(bad, "CACHE_PAGE_INDEX_INVALID").when(F.col("n").isNull(), "cache_page_missing").when(F.col("text").isNull(), "cache_text_invalid").when(glyphs, "suspect_text_encoding")
    return whole.unionByName(pages.select("source", "asset_id", "page", "text", status.alias("status"), issue.alias("issue")))


def bundle_selection(files: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The files of a bundle: of those with the same content (hash, else id) the first in ``order``; rows without any are left out."""
    return files.where(F.col(content).isNotNull() & (F.col(content) != "")).groupBy(content).agg(F.min_by(F.struct(*(c for c in files.columns if c != content)), F.struct(*order)).alias("__f")).select(content, "__f.*")


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV files with a header; arrays and structs as JSON, nulls as ``\\N``, so that empty texts stay apart from them."""
    plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
