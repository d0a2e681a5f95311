"""Tables as documents: rows as sections, pages as Markdown, lines that repeat."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.parsers import html_to_markdown

HEADING_KEYS = ("title", "name", "heading", "id", "slug")


def record_heading(json: Column | str) -> Column:
    """The first of the usual naming keys that a JSON object has."""
    j = F.col(json) if isinstance(json, str) else json
    return F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{k}"), F.lit("")) for k in HEADING_KEYS])


def row_section(columns: list[str]) -> Column:
    """A row as a section: a heading of its first column, a labelled line for every other that isn't empty."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(f"- {c}: "), text(c)) for c in columns[1:]]
    return F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(text(columns[0]), F.lit(""))), *lines)


def markdown_table(rows: DataFrame, columns: list[str], order: str, by: str, most: int = 200) -> DataFrame:
    """A Markdown table for each value of ``by``: at most ``most`` rows, then a line that says how many are left out."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    r = rows.select(by, line.alias("line"), n.alias("n"), F.count("*").over(Window.partitionBy(by)).alias("all"))
    head = F.lit(f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "line")))), lambda x: x["line"]), "\n")
    left = F.when(F.max("all") > most, F.concat(F.lit("\n\n"), (F.max("all") - most).cast("string"), F.lit(" more rows omitted")))
    return r.groupBy(by).agg(F.concat(head, F.lit("\n"), body, F.coalesce(left, F.lit(""))).alias("markdown"))


def repeated_lines(texts: DataFrame, group: str, key: str, text: str, least: int = 3, shortest: int = 3, longest: int = 120) -> DataFrame:
    """``(group, line, docs)``: short lines that stand in at least ``least`` texts of a group."""
    lines = texts.select(group, key, F.explode(F.split(text, "\n")).alias("line")).select(group, key, F.trim("line").alias("line"))
    fit = lines.where(F.length("line").between(shortest, longest) & ~F.startswith("line", F.lit("#"))).distinct()
    return fit.groupBy(group, "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def page_boilerplate(pages: DataFrame, doc: str, text: str, share: float = 0.6) -> DataFrame:
    """``(doc, line, n)``: lines among the first or last two of many of a document's pages."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edges = F.concat(F.slice("l", 1, 2), F.when(F.size("l") >= 2, F.slice("l", -2, 2)).otherwise(F.col("l")))
    p = pages.select(doc, lines.alias("l"), F.count("*").over(Window.partitionBy(doc)).alias("pages")).where("pages >= 3")
    c = p.select(doc, "pages", F.explode(edges).alias("line")).where(F.length("line").between(3, 120))
    return c.groupBy(doc, "line", "pages").agg(F.count("*").alias("n")).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).select(doc, "line", "n")


def heading_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line, level)``: lines that read as headings, by number or by capitals."""
    numbered = r"^\d+(\.\d+)*\.?\s+\p{Lu}"
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim("line").alias("line"))
    caps = (F.col("line") == F.upper("line")) & F.col("line").rlike(r"\p{Lu}")
    is_number = F.col("line").rlike(numbered)
    dots = F.length(F.regexp_replace(F.regexp_extract("line", r"^[\d.]*\d", 0), "[^.]", ""))
    short = (F.col("line") != "") & (F.size(F.split("line", " ")) <= 10) & ~F.col("line").rlike("[.!?,;:]$")
    return lines.where(short & (is_number | caps)).select(key, "line", F.when(is_number, F.least(F.lit(6), 2 + dots)).otherwise(2).cast("bigint").alias("level"))


def looks_like_dataset(text: Column | str) -> Column:
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, 4096)
    return F.contains(head, F.lit('"documents"')) & F.contains(head, F.lit('"content"'))


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, title, source, content)`` with Markdown content, in one narrow pass."""

    def run(batches):
        # a slice at a time: neither this worker nor the next holds a whole batch of texts more than once
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            found = [html_to_markdown(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _, _ in found], pa.string()), batch.column(1), pa.array([m for _, m, _ in found], pa.string())], ["page_id", "title", "source", "content"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, title string, source string, content string")
