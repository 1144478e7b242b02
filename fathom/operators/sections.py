"""Page sections: what is noise, and how short ones join their successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import strip

LEAST, SHORT, LEAST_RAW = 100, 200, 50
FOOTER = r"(?i)Page\s+\d+\s+of\s+\d+"
#: Titles of sections without substance.
BOILERPLATE = ("Notes", "References", "Acknowledgements", "Disclaimer", "Reporting")


def clean_section(text: Column) -> Column:
    """Bullets and blanks normalised; lines of a page number alone and trailing footer lines dropped."""
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\uf0a7"), F.lit("-")), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: ~x.rlike(r"^\s*\d{1,4}\s*$"))
    last = F.aggregate(
        F.reverse(lines), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct(F.when(a["open"] & x.rlike(FOOTER), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["open"] & x.rlike(FOOTER)).alias("open")),
    )
    return strip(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - last["n"]), "\n"))


def is_contents(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\.{5,}")) >= 4


def is_footer(text: Column) -> Column:
    """A page mark with under 50 characters around it; only the first mark is taken out."""
    t = strip(text)
    mark = F.regexp_substr(t, F.lit(FOOTER))
    at = F.regexp_instr(t, F.lit(FOOTER))
    rest = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(mark), F.length(t)))
    return mark.isNotNull() & (F.length(strip(rest)) < 50)


def keep(text: Column, title: Column) -> Column:
    title = F.coalesce(strip(title), F.lit(""))
    return ~is_contents(text) & ~title.isin(*BOILERPLATE) & ~is_footer(text) & (F.length(text) >= LEAST)


def merge_forward(sections: DataFrame, document: str = "doc_id", position: str = "position") -> DataFrame:
    """Sections of under SHORT characters go in front of the next one, whose title stays; the earlier page stays.

    A merged section is never short, so of a run of short ones every second takes the one before it,
    and the last of an odd run goes to the long section after it: row numbers within runs tell which."""
    order = Window.partitionBy(document).orderBy(position)
    short = F.length("text") < SHORT
    rows = sections.withColumn("_short", short).withColumn("_run", F.sum(F.when(short, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_n", F.sum(F.when(F.col("_short"), 1).otherwise(0)).over(Window.partitionBy(document, "_run").orderBy(position)))
    gives = F.col("_short") & (F.col("_n") % 2 == 1) & F.lead("_n").over(order).isNotNull()
    rows = rows.withColumn("_gives", gives)
    takes = F.coalesce(F.lag("_gives").over(order), F.lit(False))
    rows = rows.select(
        *[c for c in sections.columns if c not in ("text", "page")],
        F.when(takes, F.concat(F.lag("text").over(order), F.lit(" "), F.col("text"))).otherwise(F.col("text")).alias("text"),
        *([F.when(takes, F.lag("page").over(order)).otherwise(F.col("page")).alias("page")] if "page" in sections.columns else []),
        "_gives",
    )
    return rows.where(~F.col("_gives")).drop("_gives").select(*sections.columns)


def page_sections(pages: DataFrame, document: str = "doc_id") -> DataFrame:
    """Plain pages (page, text) to sections: one for each whose cleaned text has LEAST_RAW characters, without a title."""
    rows = pages.withColumn("text", clean_section(F.coalesce("text", F.lit("")))).where(F.length("text") >= LEAST_RAW)
    return rows.select(document, F.col("page").alias("position"), F.lit("").alias("section_title"), "page", "text")


def titled_sections(elements: DataFrame, document: str = "doc_id", position: str = "position") -> DataFrame:
    """Page elements (kind, text, page) to sections: each title or header starts one; bodies of under LEAST_RAW characters go."""
    order = Window.partitionBy(document).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.col("kind").isin("Title", "Header")
    rows = elements.withColumn("section", F.sum(title.cast("int")).over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~title, F.struct(position, "text")))), lambda x: x["text"]), "\n")
    made = rows.groupBy(document, "section").agg(
        F.coalesce(F.max(F.when(title, F.col("text"))), F.lit("")).alias("section_title"), F.min_by("page", position).alias("page"), clean_section(body).alias("text")
    )
    return made.where(F.length("text") >= LEAST_RAW).withColumnRenamed("section", "position")
