"""The catalog of indexes: questions about it, and its changes as DataFrames.

An entry has directory, indexed_at, tags, embed_model, children, split, skip, exclude and
description; of these, all but directory, indexed_at and embed_model may be null. A change
takes the catalog and gives the catalog after it; ``quarry.sources.store`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DEFAULT_MODEL, base_name

_names = T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [
        T.StructField("directory", T.StringType(), False),
        T.StructField("indexed_at", T.StringType()),
        T.StructField("tags", _names),
        T.StructField("embed_model", T.StringType()),
        T.StructField("children", _names),
        T.StructField("split", T.BooleanType()),
        T.StructField("skip", _names),
        T.StructField("exclude", _names),
        T.StructField("description", T.StringType()),
    ]
)


def _list(values: list[str] | None) -> Column:
    return F.lit(None).cast(_names) if values is None else F.array(*map(F.lit, values)).cast(_names)


# -- questions ------------------------------------------------------------------------------


def with_tags(catalog: DataFrame, tags: list[str]) -> DataFrame:
    """Entries that have all of the tags; of no tags: all entries."""
    return catalog.where(F.size(F.array_except(_list(tags), F.coalesce("tags", _list([])))) == 0)


def directories_by_tag(catalog: DataFrame) -> DataFrame:
    """tag, directory, one row each."""
    return catalog.select(F.explode("tags").alias("tag"), "directory").distinct()


def children_of(catalog: DataFrame) -> DataFrame:
    """parent, child of split entries."""
    return catalog.select(F.col("directory").alias("parent"), F.explode("children").alias("child"))


def top_level(catalog: DataFrame) -> DataFrame:
    """Entries that are not some other's child."""
    return catalog.join(children_of(catalog).select(F.col("child").alias("directory")), "directory", "left_anti").select(catalog.columns)


def view(catalog: DataFrame) -> DataFrame:
    """directory, description, tags, child, child_tags: top-level entries with their children, of
    whose tags only those of folders are shown; child is null where there is none."""
    top = top_level(catalog).select("directory", "description", F.array_join(F.array_sort(F.coalesce("tags", _list([]))), ",").alias("tags"), F.explode_outer("children").alias("child"))
    folder = F.array_join(F.array_sort(F.filter(F.coalesce("tags", _list([])), lambda t: t.startswith("folder:"))), ",")
    own = catalog.select(F.col("directory").alias("child"), folder.alias("child_tags"))
    return top.join(own, "child", "left").select("directory", "description", "tags", "child", "child_tags")


def nearest_ancestor(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, ancestor: the longest directory of the catalog that is the path or above it; null without one.

    A path's own ancestors are few, so each is looked up by equality.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = paths.select("path", F.explode(ups).alias("directory"))
    found = up.join(catalog.select("directory"), "directory").groupBy("path").agg(F.max_by("directory", F.length("directory")).alias("ancestor"))
    return paths.select("path").distinct().join(found, "path", "left")


def targets(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """directory, asked: what a rebuild of the paths comes to, each directory once with the number of
    paths that it answers; paths without a directory are counted under null."""
    return nearest_ancestor(paths, catalog).groupBy(F.col("ancestor").alias("directory")).agg(F.count("*").alias("asked"))


def stale_children(catalog: DataFrame, directory: str, current: list[str]) -> DataFrame:
    """directory: recorded children that are not among the current ones."""
    own = catalog.where(F.col("directory") == directory).select(F.explode("children").alias("directory"))
    return own.where(~F.array_contains(_list(current), F.col("directory")))


def stale(catalog: DataFrame, formats: DataFrame) -> DataFrame:
    """Directories whose stored files (directory, has_old, has_new) are of the old format alone."""
    old = formats.where(F.col("has_old") & ~F.col("has_new")).select("directory")
    return catalog.join(old, "directory", "left_semi").select("directory")


def of_model(catalog: DataFrame, model: str) -> DataFrame:
    """directory, matches: whether its vectors are of the model; entries that name none are of the default."""
    return catalog.select("directory", (F.coalesce("embed_model", F.lit(DEFAULT_MODEL)) == model).alias("matches"))


# -- changes --------------------------------------------------------------------------------


def register(
    catalog: DataFrame,
    directory: str,
    indexed_at: str,
    model: str,
    children: list[str] | None = None,
    split: bool | None = None,
    description: str | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Add or refresh an entry. What is None stays as it was; an empty list clears."""
    new = catalog.sparkSession.range(1).select(F.lit(directory).alias("directory"))
    old = catalog.where(F.col("directory") == directory).limit(1)
    entry = new.join(old, "directory", "left").select(
        "directory",
        F.lit(indexed_at).alias("indexed_at"),
        F.coalesce("tags", _list([])).alias("tags"),
        F.lit(model).alias("embed_model"),
        F.coalesce(_list(children), "children").alias("children"),
        F.coalesce(F.lit(split).cast("boolean"), "split").alias("split"),
        "skip",
        F.coalesce(_list(exclude), "exclude").alias("exclude"),
        F.coalesce(F.lit(description).cast("string"), "description").alias("description"),
    )
    return catalog.where(F.col("directory") != directory).unionByName(entry)


def cascade(catalog: DataFrame, directory: str) -> DataFrame:
    """directory: the entry and its children."""
    own = catalog.where(F.col("directory") == directory)
    return own.select("directory").union(own.select(F.explode("children"))).distinct()


def without(catalog: DataFrame, directories: DataFrame) -> DataFrame:
    return catalog.join(directories, "directory", "left_anti").select(catalog.columns)


def unregister(catalog: DataFrame, directory: str) -> DataFrame:
    """Without the entry and its children."""
    return without(catalog, cascade(catalog, directory))


def _at(catalog: DataFrame, directory: str, **values: Column) -> DataFrame:
    hit = F.col("directory") == directory
    return catalog.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def set_tags(catalog: DataFrame, directory: str, tags: list[str]) -> DataFrame:
    """Replace the tags: sorted, each once."""
    return _at(catalog, directory, tags=F.array_sort(F.array_distinct(_list(tags))))


def set_description(catalog: DataFrame, directory: str, description: str) -> DataFrame:
    return _at(catalog, directory, description=F.lit(description))


def removed_by_split(catalog: DataFrame, directory: str, skip: list[str] | None) -> DataFrame:
    """directory: children that no longer are indexes of their own (all, where splitting ends)."""
    own = catalog.where(F.col("directory") == directory).select(F.explode("children").alias("directory"))
    return own if skip is None else own.where(base_name(F.col("directory")).isin(*skip)) if skip else own.where(F.lit(False))


def set_split(catalog: DataFrame, directory: str, skip: list[str] | None) -> DataFrame:
    """Index subfolders separately but for some; with None, as one index again."""
    left = without(catalog, removed_by_split(catalog, directory, skip))
    if skip is None:
        return _at(left, directory, split=F.lit(None).cast("boolean"), skip=_list(None), children=_list(None))
    kept = F.filter(F.coalesce("children", _list([])), lambda c: ~F.array_contains(_list(skip), base_name(c)))
    return _at(left, directory, split=F.lit(True), skip=F.array_sort(F.array_distinct(_list(skip))), children=kept)


def tag_children(catalog: DataFrame, directory: str) -> DataFrame:
    """Give each child its parent's tags and that of its folder."""
    own = catalog.where(F.col("directory") == directory).select(F.explode("children").alias("child"), F.coalesce("tags", _list([])).alias("parent_tags"))
    joined = catalog.join(F.broadcast(own), F.col("directory") == F.col("child"), "left")  # the children of one entry
    tags = F.array_sort(F.array_distinct(F.concat("parent_tags", F.array(F.concat(F.lit("folder:"), base_name(F.col("directory")))))))
    return joined.withColumn("tags", F.when(F.col("child").isNotNull(), tags).otherwise(F.col("tags"))).select(catalog.columns)
