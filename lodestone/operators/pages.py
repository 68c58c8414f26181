"""Which pages of a document are kept: by its table of contents, else by what its pages are, else its middle.

pages: doc, page, class (body, toc, front_matter, back_matter, title or unknown), heading, dense. ranges: doc, start, end (printed pages, both ends), title. places: doc, printed,
page (where a printed page lies). Every document chooses for itself, by counts that come from the same pass over its pages:

- contents: it has ranges, and the pages in those that can be placed are MIN_PAGES and a MIN_SHARE-th of its pages at least;
- body: otherwise its pages of class body, and dense ones that are unknown or titles;
- middle: if neither leaves a page, those from a tenth to nine tenths.

Front matter and contents are never kept, back matter only as an appendix and on request.

Defined results: rows with a null doc or page take no part; equal pages count once (the smallest row); a range whose ends can't be placed, or that ends before it starts, holds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
MIN_PAGES, MIN_SHARE = 10, 10
FROM, TO = 0.1, 0.9


def kept_pages(pages: DataFrame, ranges: DataFrame, places: DataFrame, keep_appendices: bool = False) -> DataFrame:
    """doc, page, method, kept of every page."""
    known = pages.where("doc is not null and page is not null").groupBy("doc", "page").agg(F.min(F.struct("class", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("dense", F.lit(False)).alias("dense"))).alias("r")).select("doc", "page", "r.*")
    at = places.groupBy("doc", "printed").agg(F.min("page").alias("page"))
    first, last = at.select("doc", F.col("printed").alias("start"), F.col("page").alias("lo")), at.select("doc", F.col("printed").alias("end"), F.col("page").alias("hi"))
    spans = ranges.join(first, ["doc", "start"]).join(last, ["doc", "end"]).where("lo <= hi")
    if not keep_appendices:
        spans = spans.where("lower(coalesce(title, '')) not like '%appendix%'")
    # a span becomes its pages, so pages meet it by equality
    told = spans.select("doc", F.explode(F.sequence("lo", "hi")).alias("page")).distinct().withColumn("told", F.lit(True))
    n_told = told.groupBy("doc").agg(F.count("*").alias("n_told"))
    marked = known.join(told, ["doc", "page"], "left").join(ranges.select("doc").distinct().withColumn("has", F.lit(True)), "doc", "left").join(n_told, "doc", "left")
    doc = Window.partitionBy("doc")
    marked = marked.withColumn("n", F.count("*").over(doc)).withColumn("by_contents", F.coalesce("has", F.lit(False)) & (F.coalesce("n_told", F.lit(0)) >= F.greatest(F.lit(MIN_PAGES), F.floor(F.col("n") / MIN_SHARE))))
    body = (F.col("class") == "body") | (F.col("class").isin("title", "unknown") & F.col("dense"))
    appendix = F.lit(keep_appendices) & F.lower("heading").contains("appendix")
    allowed = ~F.col("class").isin("front_matter", "toc") & ((F.col("class") != "back_matter") | appendix)
    marked = marked.withColumn("wanted", F.when(F.col("by_contents"), F.coalesce("told", F.lit(False)) & allowed).otherwise(body & allowed))
    marked = marked.withColumn("any", F.max("wanted").over(doc))
    low = F.greatest(F.lit(1), F.floor(F.col("n") * FROM))
    middle = F.col("page").between(low, F.greatest(low, F.floor(F.col("n") * TO)))
    method = F.when(~F.col("any"), "middle").when(F.col("by_contents"), "contents").otherwise("body")
    return marked.select("doc", "page", method.alias("method"), F.when(F.col("any"), F.col("wanted")).otherwise(middle).alias("kept"))
