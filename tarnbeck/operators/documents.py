"""Structure of documents: line ranges, sections, tables, rows of requirements, context."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.operators.graph import greedy_fit

CELL = "table_no int, row_index int, column int, value string, inherited boolean, source_row int, source_column int"
#: A span beyond this is taken as damage and ignored.
MAX_SPAN = 1000
# A Markdown separator row, a heading's number, a caption.
SEPARATOR = r"^\s*\|?\s*:?-{1,}:?\s*(?:\|\s*:?-{1,}:?\s*)*\|?\s*$"
HEADING = r"^\s{0,3}(?:#{1,6}\s+.*|(?:[A-Z]\.)?\d+(?:\.\d+)*[ \t\x{3000}]+\S.*)$"
CAPTION = r"^\s*(?:表|Table)\s*([A-Z]?\.?\d+)\s*((?:[（(]续[)）])?)\s*(.*)$"


def line_ranges(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, first, last): consecutive line numbers as ranges; repeated numbers count once."""
    one = lines.select(*by, F.col(line).cast("long").alias("n")).where("n is not null").distinct()
    island = F.col("n") - F.row_number().over(Window.partitionBy(*by).orderBy("n"))
    return one.withColumn("__i", island).groupBy(*by, "__i").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("__i")


def merge_ranges(ranges: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """(by, first, last): overlapping and touching ranges merged, without spelling out their lines."""
    r = ranges.select(*by, F.col(first).alias("first"), F.col(last).alias("last")).where("first is not null and last >= first").distinct()
    w = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = r.withColumn("__new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    marked = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__i").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__i")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): the lines of each text, numbered from 1."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("__p", "text")).select(key, (F.col("__p") + 1).alias("line"), "text")


def sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, heading, first, last, n_chars): stretches of lines from one heading to the next; those before the first have none."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("text").rlike(HEADING)
    at = lines.withColumn("__s", F.sum(F.when(head, 1).otherwise(0)).over(w)).withColumn("__h", F.when(head, F.trim("text")))
    out = at.groupBy(key, "__s").agg(F.max("__h").alias("heading"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum(F.length("text")).alias("n_chars"))
    return out.drop("__s")


def split_row(c: Column | str) -> Column:
    """Cells of a Markdown row: escaped bars and bars within code spans do not divide."""
    c = F.col(c) if isinstance(c, str) else c
    safe = F.regexp_replace(c, r"\\\|", "\x01")
    safe = F.regexp_replace(safe, r"\|(?=[^`]*`(?:[^`]*`[^`]*`)*[^`]*$)", "\x01")
    bare = F.regexp_replace(F.trim(safe), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda x: F.trim(F.replace(x, F.lit("\x01"), F.lit("|"))))


def markdown_tables(lines: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_index, column, value, is_header, missing): cells of pipe tables, outside fenced code.

    A table is a run of consecutive lines with bars whose second line is a separator;
    row 0 is the header. Short rows get missing cells; blanks stay blank.
    """
    w = Window.partitionBy(key).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^\s{0,3}(?:```|~~~)")
    out = lines.withColumn("__f", F.sum(F.when(fence, 1).otherwise(0)).over(upto)).where((F.col("__f") % 2 == 0) & ~fence)
    rows = out.where(F.contains("text", F.lit("|"))).withColumn("__i", F.col("line") - F.row_number().over(w))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__i").orderBy("line")))
    rows = rows.withColumn("cells", split_row("text"))
    tables = rows.where((F.col("__r") == 2) & F.col("text").rlike(SEPARATOR)).select(key, "__i")
    body = rows.where("__r != 2").join(tables, [key, "__i"])
    size = Window.partitionBy(key, "__i")
    width = F.max(F.when(F.col("__r") == 1, F.size("cells"))).over(size)
    body = body.withColumn("width", width).withColumn("table_no", F.dense_rank().over(Window.partitionBy(key).orderBy("__i")))
    body = body.withColumn("row_index", F.when(F.col("__r") == 1, 0).otherwise(F.col("__r") - 2))
    cell = F.posexplode(F.sequence(F.lit(0), F.greatest("width", F.size("cells")) - 1))
    out = body.select(key, "table_no", "row_index", "cells", cell.alias("__p", "column"))
    missing = F.col("column") >= F.size("cells")
    return out.select(key, "table_no", "row_index", "column", F.when(~missing, F.col("cells")[F.when(~missing, F.col("column"))]).alias("value"), (F.col("row_index") == 0).alias("is_header"), missing.alias("missing"))


class _Tables(HTMLParser):
    """Cells of the top-level tables of one page, spans spread out with their origin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            given = dict(attrs)
            self.cell = {"text": "", "rows": self._span(given.get("rowspan")), "cols": self._span(given.get("colspan"))}
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell["text"] += "\n"

    @staticmethod
    def _span(value: str | None) -> int:
        return int(value) if value and value.strip().isdigit() and 1 <= int(value) <= MAX_SPAN else 1

    def _close(self) -> None:
        self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self._close()
        elif tag in ("td", "th") and self.depth == 1:
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None and self.depth == 1:  # a table within a cell is not its text
            self.cell["text"] += data


def _grid(rows: list[list[dict]]) -> Iterator[tuple[int, int, str, bool, int, int]]:
    taken: dict[tuple[int, int], bool] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            for dr in range(cell["rows"]):
                for dc in range(cell["cols"]):
                    if (r + dr, c + dc) not in taken and r + dr < len(rows):
                        taken[r + dr, c + dc] = True
                        yield r + dr, c + dc, cell["text"].strip(), bool(dr or dc), r, c
            c += cell["cols"]


def html_tables(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_index, column, value, inherited, source_row, source_column): the grid of every table.

    Spanned positions repeat the value and name the cell they come from; spans that run
    over each other keep the first. Arrow batches through the standard parser.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "table_no", "row_index", "column", "value", "inherited", "source_row", "source_column"]
        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch["__html"]):
                if isinstance(page, str) and "<t" in page.lower():
                    parser = _Tables()
                    parser.feed(page)
                    parser.close()
                    out += [(k, n, *cell) for n, rows in enumerate(parser.tables, 1) for cell in _grid(rows)]
            yield pd.DataFrame(out, columns=names)

    return df.select(key, F.col(html).alias("__html")).mapInPandas(read, f"`{key}` {kind}, {CELL}")


def merge_continuations(tables: DataFrame, key: str) -> DataFrame:
    """(key, table_no, base_no): tables that continue an earlier one of the same document.

    tables: key, table_no, caption, header. A caption marked as continued joins the one earlier, unmarked table with the same
    number and the same, non-empty header; if there is none, or more than one, base_no is null.
    """
    t = tables.select(key, "table_no", "header", F.regexp_extract("caption", CAPTION, 1).alias("number"), (F.regexp_extract("caption", CAPTION, 2) != "").alias("more"))
    base = t.where("not more and number != ''").select(key, "number", F.col("table_no").alias("base"), F.col("header").alias("base_header"))
    joined = t.where("more").join(base, [key, "number"], "left").where("base is null or base < table_no")
    found = joined.groupBy(key, "table_no").agg(F.count("base").alias("n"), F.min("base").alias("b"), F.bool_and((F.col("header") == F.col("base_header")) & (F.col("header") != "")).alias("same"))
    return found.select(key, "table_no", F.when((F.col("n") == 1) & F.col("same"), F.col("b")).alias("base_no"))


def requirement_rows(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_index, project, unit, comparator, value, method): rows of three-column requirement tables.

    The unit is what stands in the project's last brackets; a comparator of the limit
    makes it a lower or an upper limit; the value stays text, blanks inside it removed, and is null where it is no decimal.
    """
    wide = cells.where("not is_header and column < 3").groupBy(key, "table_no", "row_index").agg(*(F.max(F.when(F.col("column") == i, F.col("value"))).alias(n) for i, n in enumerate(("project_raw", "limit_raw", "method"))))
    sign = F.regexp_extract("limit_raw", r"^\s*([≤≥<>＜＞])", 1)
    number = F.regexp_replace(F.regexp_extract("limit_raw", r"([0-9][0-9 .]*)", 1), r"\s", "")
    comparator = F.when(sign.isin("≥", ">", "＞"), "lower_limit").when(sign.isin("≤", "<", "＜"), "upper_limit").otherwise("qualitative")
    return wide.select(
        key, "table_no", "row_index",
        F.trim(F.regexp_replace("project_raw", r"[（(][^（()）]*[)）]\s*$", "")).alias("project"),
        F.nullif(F.regexp_extract("project_raw", r"[（(]([^（()）]*)[)）]\s*$", 1), F.lit("")).alias("unit"),
        comparator.alias("comparator"), F.when(number.rlike(r"^\d+(\.\d+)?$"), number).alias("value"), "method",
    )


def limit_conflicts(limits: DataFrame, by: list[str]) -> DataFrame:
    """(by, unit, reason): groups whose limits cannot hold together.

    Different upper (or different lower) values conflict, and a lower limit above an
    upper one. limits: by, unit, comparator, value (text). Units are compared as they are.
    """
    v = F.col("value").try_cast("decimal(38,18)")
    up, low = F.col("comparator") == "upper_limit", F.col("comparator") == "lower_limit"
    g = limits.where(v.isNotNull()).groupBy(*by, "unit").agg(
        F.count_distinct(F.when(up, v)).alias("n_up"), F.count_distinct(F.when(low, v)).alias("n_low"), F.min(F.when(up, v)).alias("least_up"), F.max(F.when(low, v)).alias("most_low")
    )
    reason = F.when(F.col("most_low") > F.col("least_up"), "crossing").when((F.col("n_up") > 1) | (F.col("n_low") > 1), "different_values")
    return g.select(*by, "unit", reason.alias("reason")).where("reason is not null")


def context(blocks: DataFrame, by: str, block: str, order: str, size: str, max_blocks: int, max_chars: int) -> DataFrame:
    """(by, block, kept): which blocks of each group fit its budget, in order; one that does not is skipped, later ones may still fit.

    A group is one document's blocks, an array as long as the document.
    """
    item = F.struct(F.col(order).alias("o"), F.col(block).alias("b"), F.col(size).cast("long").alias("n"))
    grouped = blocks.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = grouped.withColumn("kept", greedy_fit(F.col("items"), "n", max_blocks, max_chars))
    return kept.select(by, F.explode(F.arrays_zip("items", "kept")).alias("x")).select(by, F.col("x.items.b").alias(block), F.col("x.kept").alias("kept"))
