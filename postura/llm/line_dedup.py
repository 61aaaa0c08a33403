"""Boilerplate lines by their frequency within a site, with SQL functions only.

Per host, the pages that contain a line are divided by all pages of the host; lines above ``ratio`` that stand on at least
``min_pages`` pages are dropped. Pages are counted by content: exact copies of a page within a host count once, above and
below the line, so that a copied article is not mistaken for boilerplate. Lines are compared without outer white space;
blank lines are never dropped.

Lines travel as 64-bit hashes, one per page and line, and are summed before the shuffle, so a host with a third of all
rows is no hot task. What remains per host is bounded by the mean number of lines on a page divided by ``ratio``,
whatever the size of the host; it is written once and joined by host, which Spark broadcasts or splits by itself.

Defined cases: null text stays null and has no lines; rows with a null host form one host; repeated rows count once but all
are returned; other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import ROW, as_row, column, text_of
from postura.operators.ordered import stage

RATIO, MIN_PAGES = 0.1, 5


def _host(name: str) -> Column:
    """A join key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), column(name).cast("string")), F.lit("-"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """Staged: ``host``, ``lines`` (hashes of its boilerplate lines); hosts without any are left out."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n", -1), _bare), lambda x: x != "")
    pages = (df.select(_host(host_col).alias("host"), text_of(text_col).alias("text"))
             .select("host", F.xxhash64("text").alias("page"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"))
             .groupBy("host", "page").agg(F.first("lines").alias("lines")))
    pages = stage(pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    held = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return stage(held.groupBy("host").agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counted: bool = False) -> DataFrame:
    """All columns, with the text cut; ``counted`` adds ``n_lines`` and ``n_dropped``."""
    held = boilerplate(df, host_col, text_col, ratio, min_pages).select(F.col("host").alias("_h"), F.col("lines").alias("_lines"))
    rows = df.select(as_row(df), _host(host_col).alias("_host"), F.split(column(text_col), "\n", -1).alias("_all"))
    joined = rows.join(held, F.col("_host") == F.col("_h"), "left")
    stays = F.filter("_all", lambda x: (_bare(x) == "") | ~F.array_contains("_lines", F.xxhash64(_bare(x))))
    kept = joined.withColumn("_kept", F.when(F.col("_lines").isNull(), F.col("_all")).otherwise(stays))
    text = F.when(F.size("_kept") == F.size("_all"), F.col(ROW)[text_col]).otherwise(F.array_join("_kept", "\n"))
    out = [(text if c == text_col else F.col(ROW)[c]).alias(c) for c in df.columns]
    if counted:
        n = [F.when(F.col("_all").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long") for c in ("_all", "_kept")]
        out += [n[0].alias("n_lines"), (n[0] - n[1]).alias("n_dropped")]
    return kept.select(*out)


#: The same in DuckDB's SQL, over ``documents``, at the default settings.
SQL = f"""
WITH doc AS (SELECT *, coalesce('=' || source, '-') AS host, string_split(text, chr(10)) AS lines FROM documents),
page AS (SELECT DISTINCT host, coalesce(text, '') AS body FROM doc),
total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
line AS (SELECT DISTINCT host, body, trim(unnest(string_split(body, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM page),
often AS (SELECT host, line, count(*) AS n FROM line WHERE line <> '' GROUP BY host, line HAVING count(*) >= {MIN_PAGES}),
held AS (SELECT host, list(line) AS held FROM often JOIN total USING (host) WHERE n > {RATIO} * pages GROUP BY host),
cut AS (SELECT doc.*, CASE WHEN held IS NULL THEN lines ELSE
        list_filter(lines, lambda x: NOT list_contains(held, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
        FROM doc LEFT JOIN held USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped FROM cut
"""
