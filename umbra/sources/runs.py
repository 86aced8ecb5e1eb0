"""Text tables as lines with a place on a page.

A text has no layout of its own, so it gets a typewriter's: 50 lines a page, character i of a line 5 points wide from
5 * i on and 10 points high. A hit's rectangle then follows from its position, without a row for each character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES_A_PAGE, ADVANCE, HEIGHT, TOP, LEADING = 50, 5.0, 10.0, 780.0, 14.0
SHEET = (0.0, 0.0, 595.0, 842.0)


def text_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run_seq, page, text, lly): the lines that aren't empty, numbered from 0 in their document."""
    lines = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("run_seq", "text"))
    return placed(lines.where("text <> ''"))


def placed(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, run_seq, text) with their page and baseline."""
    page = F.floor(F.col("run_seq") / LINES_A_PAGE).cast("long")
    lly = F.lit(TOP) - LEADING * (F.col("run_seq") % LINES_A_PAGE)
    return lines.select("doc_id", F.col("run_seq").cast("long").alias("run_seq"), page.alias("page"), "text", lly.alias("lly"))


def span_rect(start: Column, length: Column, lly: Column) -> list[Column]:
    return [(ADVANCE * start).alias("llx"), lly.alias("lly"), (ADVANCE * (start + length)).alias("urx"), (lly + HEIGHT).alias("ury")]


def page_boxes(runs: DataFrame) -> DataFrame:
    """(doc_id, pages, llx, lly, urx, ury): how many pages each document has, and the sheet they all share."""
    return runs.groupBy("doc_id").agg((F.max("page") + 1).alias("pages")).select("doc_id", "pages", *(F.lit(v).alias(f"sheet_{n}") for n, v in zip(("llx", "lly", "urx", "ury"), SHEET, strict=True)))
