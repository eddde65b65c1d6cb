"""Markdown sections: windows over lines, and a fold over a text's headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A header and a fence.
HEADER = r"^(#+)[^\S\r\n](.*)"
FENCE = r"^\s*```"


def _paths(heads: Column) -> Column:
    """section, path of each header of an ordered list, by the stack of those that are open above it."""
    nothing = F.struct(F.expr("cast(array() as array<struct<level:int,title:string>>)").alias("open"), F.expr("cast(array() as array<struct<section:bigint,path:string>>)").alias("done"))

    def step(so_far: Column, head: Column) -> Column:
        above = F.filter(so_far["open"], lambda up: up["level"] < head["level"])
        path = F.concat(F.lit("/"), F.array_join(F.transform(above, lambda up: F.concat(up["title"], F.lit("/"))), ""))
        own = F.struct(head["level"].alias("level"), head["title"].alias("title"))
        done = F.concat(so_far["done"], F.array(F.struct(head["section"].alias("section"), path.alias("path"))))
        return F.struct(F.concat(above, F.array(own)).alias("open"), done.alias("done"))

    return F.aggregate(heads, nothing, step, lambda so_far: so_far["done"])


def sections(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, start_line, end_line, path, body: a section begins at every header outside a fence.

    ``path`` names the headers above, of any depth, not the section's own. Sections without
    anything but white space are dropped. Lines end at newlines. All windows are within one
    text, and so are the headers that are gathered.
    """
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    is_fence = F.col("line").rlike(FENCE)
    open_before = F.coalesce(F.sum(is_fence.cast("int")).over(before), F.lit(0)) % 2 == 1
    marked = lines.withColumn("header", ~open_before & ~is_fence & F.col("line").rlike(HEADER))
    marked = marked.withColumn("section", F.sum(F.col("header").cast("int")).over(upto))
    level, title = F.length(F.regexp_extract("line", HEADER, 1)), F.trim(F.regexp_extract("line", HEADER, 2))
    heads = marked.where("header").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section", level.alias("level"), title.alias("title")))).alias("heads"))
    heads = heads.select(*keys, F.inline(_paths(F.col("heads"))))
    bodies = marked.groupBy(*keys, "section").agg(
        (F.min("at") + 1).cast("int").alias("start_line"),
        (F.max("at") + 1).cast("int").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    out = bodies.join(heads, [*keys, "section"], "left").where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "")
    return out.select(*keys, "start_line", "end_line", F.coalesce("path", F.lit("/")).alias("path"), "body")
