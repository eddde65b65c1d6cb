"""Queries of scalar functions, files, incremental upkeep, the catalog and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat
from ..operators import chunking, maintain, sections
from ..operators.embed import HashingEmbedder, embedded
from . import corpora, samples
from .corpora import CHUNKS

# -- literal tables, alike in both engines ------------------------------------------------


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]::VARCHAR[]"
    if isinstance(value, float):
        return f"{value}::DOUBLE"
    return str(value) + "::BIGINT" if isinstance(value, int) else "'" + str(value).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({columns}))"


OLD_FILES = [("/w/a.py", 10.5, 100), ("/w/b.py", 11.0, 200), ("/w/c.md", 12.0, 300), ("/w/d/e.ts", 13.0, 50), ("/w/gone.go", 9.0, 70)]
NEW_FILES = [("/w/a.py", 10.5, 100), ("/w/b.py", 11.25, 200), ("/w/c.md", 12.0, 301), ("/w/d/e.ts", 13.0, 50), ("/w/new.rs", 20.0, 5), ("/w/lost.py", None, None)]
FILES = "path string, mtime double, size long"

PATHS = [
    "src/app.py", "node_modules/x/index.js", "foo.egg-info/PKG.txt", "egg-info/PKG.txt", "docs/X.MD", "docs/x.md", "a/pyvenv.cfg", "a/lib/site.py", "ab/site.py",
    "src/x.min.js", "mcp/data/a.json", "mcp/data/deep/b.json", "pkg/__init__.py", ".github/ci.yml", "tests/t_test.go", "src/build", "build/src/a.ts", "README", "notes.txt", "lib/.hidden.py",
]
EXCLUDES = ["*.min.js", "mcp/data/", "deep"]

ENTRIES = [
    ("/ws/mono", "2024-01-01T00:00:00+00:00", ["lib", "team"], "m1", ["/ws/mono/api", "/ws/mono/web"], True, ["old"], ["*.min.js"], "the monorepo"),
    ("/ws/mono/api", "2024-01-02T00:00:00+00:00", ["folder:api", "lib", "team"], "m1", None, None, None, None, None),
    ("/ws/mono/web", "2024-01-02T00:00:00+00:00", ["folder:web", "lib", "team"], "m2", None, None, None, None, "front end"),
    ("/ws/solo", "2024-01-03T00:00:00+00:00", ["docs", "team"], None, None, None, None, None, None),
    ("/ws/mono-two", "2024-01-04T00:00:00+00:00", [], "m1", None, None, None, [], None),
    ("/ws/orphan", "2024-01-05T00:00:00+00:00", ["docs"], "m1", ["/ws/nowhere"], True, [], None, "points at a child that is gone"),
]
CATALOG = values("catalog", "directory, indexed_at, tags, embed_model, children, split, skip, exclude, description", ENTRIES)
ASKED = ["/ws/mono/api/v1/x.py", "/ws/mono", "/ws/mono-two/a", "/ws/monolith/a", "/elsewhere", "/ws/mono/lib", "/ws/solo/a/b/c"]
FORMATS = [("/ws/mono", True, True), ("/ws/solo", True, False), ("/ws/orphan", False, False), ("/ws/unknown", True, False)]

MARKDOWN = [
    (1, "x\n# A\n### B\n# C"),
    (2, "intro\n\n# One\ntext\n## Two\nmore\n### Three\ndeep\n## Four\nend"),
    (3, "# Code\n```\n# not a header\n```\n## After\nbody\n  ```py\n## inside\n  ```\n# Last"),
    (4, "#no header\n # nor this\n#\tTab\n##  Spaced  \nz"),
    (5, "\n\n  \n# Only\n\n"),
    (6, "#### Deep\na\n## Up\nb\n### Down\nc\n#### Deeper\nd"),
    (7, "no header at all"),
    (8, "\n".join(f"{'#' * n} h{n}\ntext {n}" for n in range(1, 16)) + "\n#### back\nx\n############## far\ny"),
]


def _files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FILES)


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, cat.SCHEMA)


def _flat(catalog: DataFrame) -> DataFrame:
    """Lists as text, so that results compare by value."""
    lists = {c: F.array_join(c, ",") for c in ("tags", "children", "skip", "exclude")}
    return catalog.withColumns(lists)


FLAT = """SELECT directory, indexed_at, array_to_string(tags, ',') AS tags, embed_model, array_to_string(children, ',') AS children, split,
  array_to_string(skip, ',') AS skip, array_to_string(exclude, ',') AS exclude, description FROM """

# -- the queries ----------------------------------------------------------------------------


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpora.table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


def strip_data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora.table(spark, sf_dir, "documents").select("doc_id", _with_uri(F.col("text"), F.col("doc_id")).alias("t"))
    return c.select("doc_id", F.md5(tx.strip_data_uri(F.col("t")).cast("binary")).alias("text_md5"))


def _with_uri(text, n):
    """The text with an inline payload of 95 to 104 characters."""
    return F.concat(text, F.lit(" <img src=\"data:image/svg+xml;base64,"), F.repeat(F.lit("Ab0+/"), 18), F.repeat(F.lit("="), (F.lit(5) + n % 10).cast("int")), F.lit("\">"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.lit("m1"), F.col("text")).alias("hash"))


def hash_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text has a vector in the cache; the cache holds those of embeddings' ids."""
    d = content_hash(spark, sf_dir)
    e = corpora.table(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select("hash", F.col("embedding").alias("vector"))
    found = maintain.reused_vectors(d, e)
    return found.select("doc_id", F.col("vector").isNotNull().alias("reused"))


def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora.chunks(spark, sf_dir)
    rel = tx.relative_path(F.col("file"), F.concat(F.lit("/ws/"), "index_id"))
    return c.select("row_id", tx.chunk_header(rel, F.concat(F.lit("language: "), tx.language_of(F.col("file")))).alias("header"))


def language_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark).select("path", tx.extension(F.col("path")).alias("extension"), tx.language_of(F.col("path")).alias("language"))


def line_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first and the last of each document's words."""
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+$", "").alias("t"))
    lead = F.length("t") - F.length(F.regexp_replace("t", r"^\s+", ""))
    return d.select("doc_id", tx.line_of(F.col("t"), lead).alias("start_line"), tx.line_of(F.col("t"), F.length("t")).alias("end_line"))


def location(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora.chunks(spark, sf_dir)
    start = F.when(F.col("row_id") % 3 > 0, (F.col("row_id") % 50 + 1).cast("int"))
    end = F.when(F.col("row_id") % 3 > 1, (F.col("row_id") % 50 + 9).cast("int"))
    return c.select("row_id", tx.location(F.col("file"), start, end).alias("loc"))


def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark)
    venv = p.where(F.col("path").endswith("/pyvenv.cfg")).select(F.regexp_replace("path", "pyvenv.cfg$", "").alias("env"))
    inside = p.join(F.broadcast(venv), F.col("path").startswith(F.col("env"))).select("path").distinct().withColumn("in_venv", F.lit(True))
    return p.join(inside, "path", "left").select(
        "path",
        tx.has_known_extension(F.col("path")).alias("known"),
        tx.in_skipped_folder(F.col("path")).alias("skipped"),
        F.coalesce("in_venv", F.lit(False)).alias("in_venv"),
        tx.excluded(F.col("path"), EXCLUDES).alias("excluded"),
    )


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.manifest_diff(_files(spark, NEW_FILES), _files(spark, OLD_FILES))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks of the old listing's files, five files in turn."""
    d = corpora.table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(f[0]) for f in OLD_FILES])
    return d.select(
        F.lit("w").alias("index_id"),
        F.col("doc_id").alias("row_id"),
        names[(F.col("doc_id") % len(OLD_FILES)).cast("int")].alias("file"),
        F.col("doc_id").cast("int").alias("start_line"),
        (F.col("doc_id") + 5).cast("int").alias("end_line"),
        "text",
    )


def rows_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.retained(_stored(spark, sf_dir), manifest_diff(spark, sf_dir)).select("row_id", "file")


def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = maintain.retained(_stored(spark, sf_dir), manifest_diff(spark, sf_dir))
    b = corpora.table(spark, sf_dir, "benchmark")
    lines = [F.col("item_id").cast("int").alias("start_line"), (F.col("item_id") + 2).cast("int").alias("end_line")]
    fresh = b.select(F.lit("w").alias("index_id"), F.lit(0).cast("long").alias("row_id"), F.lit("/w/new.rs").alias("file"), *lines, "text")
    return maintain.appended(kept, fresh).select("row_id", "file", "start_line", "end_line")


def files_per_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.files_per_extension(_paths(spark))


def catalog_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.with_tags(_catalog(spark), ["team", "lib"]).select("directory")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(spark.createDataFrame(MARKDOWN, "text_id long, text string"), "text_id")


def sections_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with some of their lines made headers, up to 20 deep, or fences."""
    d = corpora.table(spark, sf_dir, "documents")
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, n: F.concat(F.when(n % 7 == 3, "``` ").when(n % 2 == 0, F.concat(F.repeat(F.lit("#"), (F.col("doc_id") * 3 + n * 5).cast("int") % 20 + 1), F.lit(" "))).otherwise(""), line),
    )
    found = sections.sections(d.select("doc_id", F.array_join(marked, "\n").alias("text")), "doc_id")
    return found.select("doc_id", "start_line", "end_line", F.md5(F.col("path").cast("binary")).alias("path_md5"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files in chunks of at most 450 words and signs."""
    d = corpora.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/w/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = d.select(F.col("lang").alias("index_id"), name.alias("path"), F.substring(name, 4, 100).alias("rel"), F.col("text").cast("binary").alias("content"))
    return chunking.chunk_files(files)


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files of eight languages, and others; what they are cut into was worked out by hand."""
    files = spark.createDataFrame(samples.SOURCES, "rel string, t string")
    return chunking.chunk_files(files.select(F.lit("w").alias("index_id"), F.concat(F.lit("/w/"), "rel").alias("path"), "rel", F.col("t").cast("binary").alias("content")))


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with vectors of the model-free embedder, each distinct text computed once."""
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embedded(d, HashingEmbedder()).select("doc_id", "hash", "vector")


_REGISTERED = dict(directory="/ws/mono", indexed_at="2024-02-01T00:00:00+00:00", model="m3", children=["/ws/mono/api"], exclude=[])

QUERIES = {
    "strip_html": strip_html,
    "strip_data_uri": strip_data_uri,
    "content_hash": content_hash,
    "hash_cache_join": hash_cache_join,
    "chunk_header": chunk_header,
    "language_dispatch": language_dispatch,
    "line_span": line_span,
    "location": location,
    "path_filters": path_filters,
    "manifest_diff": manifest_diff,
    "rows_retained": rows_retained,
    "index_append": index_append,
    "files_per_extension": files_per_extension,
    "tags_all_of": catalog_tags,
    "tag_directory_list": lambda spark, d: cat.directories_by_tag(_catalog(spark)),
    "catalog_view": lambda spark, d: cat.view(_catalog(spark)),
    "nearest_ancestor": lambda spark, d: cat.nearest_ancestor(spark.createDataFrame([(p,) for p in ASKED], "path string"), _catalog(spark)),
    "children_cascade": lambda spark, d: cat.cascade(_catalog(spark), "/ws/mono"),
    "storage_key": lambda spark, d: _catalog(spark).select("directory", tx.storage_key(F.col("directory")).alias("key")),
    "stale_indexes": lambda spark, d: cat.stale(_catalog(spark), spark.createDataFrame(FORMATS, "directory string, has_old boolean, has_new boolean")),
    "model_match": lambda spark, d: cat.of_model(_catalog(spark), "m1"),
    "register_upsert": lambda spark, d: _flat(cat.register(_catalog(spark), **_REGISTERED)),
    "register_new": lambda spark, d: _flat(cat.register(_catalog(spark), "/ws/fresh", "2024-02-02T00:00:00+00:00", "m1", description="new")),
    "unregister_cascade": lambda spark, d: cat.unregister(_catalog(spark), "/ws/mono").select("directory"),
    "set_tags": lambda spark, d: _flat(cat.set_tags(_catalog(spark), "/ws/solo", ["z", "a", "z"])),
    "set_split_off": lambda spark, d: _flat(cat.set_split(_catalog(spark), "/ws/mono", None)),
    "set_split_skip": lambda spark, d: _flat(cat.set_split(_catalog(spark), "/ws/mono", ["web", "tmp", "web"])),
    "split_child_tags": lambda spark, d: _flat(cat.tag_children(_catalog(spark), "/ws/mono")),
    "markdown_sections": markdown_sections,
    "sections_of_documents": sections_of_documents,
    "set_description": lambda spark, d: _flat(cat.set_description(_catalog(spark), "/ws/solo", "a new one")),
    "top_level_indexes": lambda spark, d: cat.top_level(_catalog(spark)).select("directory"),
    "reindex_targets": lambda spark, d: cat.targets(spark.createDataFrame([(p,) for p in ASKED], "path string"), _catalog(spark)),
    "stale_children": lambda spark, d: cat.stale_children(_catalog(spark), "/ws/mono", ["/ws/mono/web", "/ws/mono/new"]),
    "index_statistics": lambda spark, d: maintain.index_statistics(corpora.chunks(spark, d)),
    "byte_budget": lambda spark, d: maintain.within_budget(maintain.index_statistics(corpora.chunks(spark, d)), 2_000_000),
    "split_overlap": split_overlap,
    "code_chunks": code_chunks,
    "hashed_vectors": hashed_vectors,
}



def _sections_sql(key: str) -> str:
    """Sections of a table ``texts``: the headers above one are those that no later one before it is as high as."""
    return f"""lines AS (SELECT {key}, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line FROM texts),
fenced AS (
  SELECT *, regexp_matches(line, '^\\s*```') AS fence, coalesce(sum(CAST(regexp_matches(line, '^\\s*```') AS INT)) OVER (PARTITION BY {key} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lines
),
headed AS (SELECT *, NOT inside AND NOT fence AND regexp_matches(line, '^#+[ \\t]') AS header FROM fenced),
numbered AS (SELECT *, sum(CAST(header AS INT)) OVER (PARTITION BY {key} ORDER BY place) AS section, len(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+[ \\t](.*)', 1)) AS title FROM headed),
heads AS (SELECT {key}, section, level, title FROM numbered WHERE header),
above AS (
  SELECT h.{key}, h.section, a.section AS up, a.title FROM heads h JOIN heads a ON a.{key} = h.{key} AND a.section < h.section AND a.level < h.level
  WHERE NOT EXISTS (SELECT 1 FROM heads b WHERE b.{key} = h.{key} AND b.section > a.section AND b.section < h.section AND b.level <= a.level)
),
paths AS (SELECT {key}, section, string_agg(title || '/', '' ORDER BY up) AS path FROM above GROUP BY ALL),
bodies AS (SELECT {key}, section, CAST(min(place) + 1 AS INTEGER) AS start_line, CAST(max(place) + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY place) AS body FROM numbered GROUP BY ALL),
sections AS (SELECT {key}, start_line, end_line, '/' || coalesce(path, '') AS path, body FROM bodies LEFT JOIN paths USING ({key}, section) WHERE regexp_matches(body, '\\S'))"""


_markup = "<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<svg\\b.*?</svg\\s*>|<!--.*?-->|<[^>]*>"
_language = "CASE lower(regexp_extract({0}, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in tx.LANGUAGES.items()) + " ELSE 'text' END"
_lines = "1 + len({0}) - len(replace({0}, chr(10), ''))"
_diff = f"""{values("cur", "path, mtime, size", NEW_FILES)}, {values("old", "path, mtime, size", OLD_FILES)},
diff AS (
  SELECT coalesce(cur.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted'
    WHEN cur.mtime = old.mtime AND cur.size = old.size THEN 'same' ELSE 'changed' END AS status
  FROM cur FULL JOIN old ON cur.path = old.path
), stored AS (
  SELECT doc_id AS row_id, ({_sql([f[0] for f in OLD_FILES])})[doc_id % {len(OLD_FILES)} + 1] AS file, CAST(doc_id AS INTEGER) AS start_line, CAST(doc_id + 5 AS INTEGER) AS end_line, text FROM documents
), kept AS (SELECT * FROM stored WHERE file IN (SELECT path FROM diff WHERE status = 'same'))"""
_paths_sql = values("paths", "path", [(p,) for p in PATHS])
_known = "(" + "|".join(e.replace(".", "\\.") for e in tx.LANGUAGES) + ")$"
_base = "split_part({0}, '/', -1)"

ORACLES = {
    "strip_html": f"""SELECT page_id, len(t) AS n_chars, md5(t) AS text_md5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '{_markup}', '', 'gis'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') AS t FROM pages)""",
    "strip_data_uri": """SELECT doc_id, md5(regexp_replace(t, '(data:[\\w/+.-]+;base64,)[A-Za-z0-9+/=]{100,}', '\\1', 'g')) AS text_md5 FROM (
  SELECT doc_id, text || ' <img src="data:image/svg+xml;base64,' || repeat('Ab0+/', 18) || repeat('=', 5 + doc_id % 10) || '">' AS t FROM documents)""",
    "content_hash": "SELECT doc_id, md5('m1' || chr(0) || text) AS hash FROM documents",
    "hash_cache_join": "SELECT doc_id, text IN (SELECT text FROM documents JOIN embeddings ON vec_id = doc_id) AS reused FROM documents",
    "chunk_header": f"WITH {CHUNKS} SELECT row_id, '# file: ' || substr(file, len(index_id) + 6) || ' | language: ' || {_language.format('file')} AS header FROM chunks",
    "language_dispatch": f"WITH {_paths_sql} SELECT path, regexp_extract({_base.format('path')}, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS extension, CASE WHEN extension = '' THEN 'text' ELSE {_language.format('extension')} END AS language FROM paths",
    "line_span": f"""SELECT doc_id, CAST({_lines.format("a")} AS INTEGER) AS start_line, CAST({_lines.format("t")} AS INTEGER) AS end_line FROM (
  SELECT doc_id, t, substr(t, 1, len(t) - len(regexp_replace(t, '^\\s+', ''))) AS a FROM (SELECT doc_id, regexp_replace(text, '\\s+$', '') AS t FROM documents))""",
    "location": f"""WITH {CHUNKS} SELECT row_id, file || CASE row_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || (row_id % 50 + 1) ELSE ':' || (row_id % 50 + 1) || '-' || (row_id % 50 + 9) END AS loc FROM chunks""",
    "path_filters": f"""WITH {_paths_sql} SELECT path, regexp_matches(path, '{_known}') AS known,
  len(list_intersect(string_split(path, '/')[:-2], {_sql(tx.SKIPPED_FOLDERS)})) > 0 AS skipped,
  EXISTS (SELECT 1 FROM paths v WHERE v.path LIKE '%/pyvenv.cfg' AND starts_with(p.path, replace(v.path, 'pyvenv.cfg', ''))) AS in_venv,
  {_base.format('path')} LIKE '%.min.js' OR path LIKE '%.min.js/%' OR path = 'mcp/data' OR path LIKE 'mcp/data/%' OR list_contains(string_split(path, '/'), 'deep') AS excluded
  FROM paths p""",
    "manifest_diff": f"WITH {_diff} SELECT path, status FROM diff",
    "rows_retained": f"WITH {_diff} SELECT row_id, file FROM kept",
    "index_append": f"""WITH {_diff} SELECT row_number() OVER (ORDER BY file, start_line, end_line, text) - 1 AS row_id, file, start_line, end_line FROM (
  SELECT file, start_line, end_line, text FROM kept UNION ALL SELECT '/w/new.rs', CAST(item_id AS INTEGER), CAST(item_id + 2 AS INTEGER), text FROM benchmark)""",
    "files_per_extension": f"WITH {_paths_sql} SELECT regexp_extract({_base.format('path')}, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS extension, count(*) AS files FROM paths GROUP BY 1",
    "tags_all_of": f"WITH {CATALOG} SELECT directory FROM catalog WHERE list_has_all(tags, ['team', 'lib'])",
    "tag_directory_list": f"WITH {CATALOG} SELECT DISTINCT unnest(tags) AS tag, directory FROM catalog",
    "catalog_view": f"""WITH {CATALOG}, kids AS (SELECT directory, unnest(children) AS child FROM catalog),
top AS (SELECT * FROM catalog WHERE directory NOT IN (SELECT child FROM kids))
SELECT top.directory, top.description, array_to_string(list_sort(top.tags), ',') AS tags, child,
  array_to_string(list_sort(list_filter(c.tags, lambda t: starts_with(t, 'folder:'))), ',') AS child_tags
FROM top LEFT JOIN kids USING (directory) LEFT JOIN catalog c ON c.directory = child""",
    "nearest_ancestor": f"""WITH {CATALOG}, {values("asked", "path", [(p,) for p in ASKED])}
SELECT path, arg_max(directory, len(directory)) AS ancestor FROM asked LEFT JOIN catalog ON path = directory OR starts_with(path, directory || '/') GROUP BY path""",
    "children_cascade": f"WITH {CATALOG} SELECT directory FROM catalog WHERE directory = '/ws/mono' UNION SELECT unnest(children) FROM catalog WHERE directory = '/ws/mono'",
    "storage_key": f"WITH {CATALOG} SELECT directory, substr(sha256(directory), 1, 12) || '-' || {_base.format('directory')} AS key FROM catalog",
    "stale_indexes": f"WITH {CATALOG}, {values('formats', 'directory, has_old, has_new', FORMATS)} SELECT directory FROM catalog JOIN formats USING (directory) WHERE has_old AND NOT has_new",
    "model_match": f"WITH {CATALOG} SELECT directory, coalesce(embed_model, '{tx.DEFAULT_MODEL}') = 'm1' AS matches FROM catalog",
    "register_upsert": f"""WITH {CATALOG}, after AS (
  SELECT * FROM catalog WHERE directory <> '/ws/mono' UNION ALL
  SELECT directory, '2024-02-01T00:00:00+00:00', tags, 'm3', ['/ws/mono/api'], split, skip, []::VARCHAR[], description FROM catalog WHERE directory = '/ws/mono') {FLAT} after""",
    "register_new": f"""WITH {CATALOG}, after AS (
  SELECT * FROM catalog UNION ALL SELECT '/ws/fresh', '2024-02-02T00:00:00+00:00', []::VARCHAR[], 'm1', NULL, NULL, NULL, NULL, 'new') {FLAT} after""",
    "unregister_cascade": f"WITH {CATALOG} SELECT directory FROM catalog WHERE directory NOT IN ('/ws/mono', '/ws/mono/api', '/ws/mono/web')",
    "set_tags": f"WITH {CATALOG}, after AS (SELECT * REPLACE (CASE WHEN directory = '/ws/solo' THEN ['a', 'z'] ELSE tags END AS tags) FROM catalog) {FLAT} after",
    "set_split_off": f"""WITH {CATALOG}, after AS (
  SELECT * REPLACE (CASE WHEN directory <> '/ws/mono' THEN split END AS split, CASE WHEN directory <> '/ws/mono' THEN skip END AS skip, CASE WHEN directory <> '/ws/mono' THEN children END AS children)
  FROM catalog WHERE directory NOT IN ('/ws/mono/api', '/ws/mono/web')) {FLAT} after""",
    "set_split_skip": f"""WITH {CATALOG}, after AS (
  SELECT * REPLACE (CASE WHEN directory = '/ws/mono' THEN ['tmp', 'web'] ELSE skip END AS skip, CASE WHEN directory = '/ws/mono' THEN ['/ws/mono/api'] ELSE children END AS children)
  FROM catalog WHERE directory <> '/ws/mono/web') {FLAT} after""",
    "split_child_tags": f"""WITH {CATALOG}, after AS (
  SELECT * REPLACE (CASE WHEN directory IN ('/ws/mono/api', '/ws/mono/web') THEN list_sort(list_distinct(list_concat(['lib', 'team'], ['folder:' || {_base.format('directory')}]))) ELSE tags END AS tags) FROM catalog) {FLAT} after""",
    "top_level_indexes": f"WITH {CATALOG} SELECT directory FROM catalog WHERE directory NOT IN (SELECT unnest(children) FROM catalog WHERE children IS NOT NULL)",
    "reindex_targets": f"""WITH {CATALOG}, {values("asked", "path", [(p,) for p in ASKED])}, found AS (
  SELECT path, arg_max(directory, len(directory)) AS directory FROM asked LEFT JOIN catalog ON path = directory OR starts_with(path, directory || '/') GROUP BY path)
SELECT directory, count(*) AS asked FROM found GROUP BY directory""",
    "stale_children": f"WITH {CATALOG}, kids AS (SELECT unnest(children) AS directory FROM catalog WHERE directory = '/ws/mono') SELECT directory FROM kids WHERE directory NOT IN ('/ws/mono/web', '/ws/mono/new')",
    "index_statistics": f"WITH {CHUNKS} SELECT index_id, count(DISTINCT file) AS files, count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM chunks GROUP BY index_id",
    "byte_budget": f"""WITH {CHUNKS}, sizes AS (SELECT index_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM chunks GROUP BY index_id)
SELECT index_id, bytes, CAST(sum(bytes) OVER (ORDER BY bytes DESC, index_id) AS BIGINT) AS running, running <= 2000000 AS fits FROM sizes""",
    "markdown_sections": f"""WITH {values("texts", "text_id, text", MARKDOWN)}, {_sections_sql("text_id")}
SELECT text_id, start_line, end_line, path, body FROM sections""",
    "sections_of_documents": f"""WITH texts AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, n: CASE WHEN (n - 1) % 7 = 3 THEN '``` ' WHEN (n - 1) % 2 = 0 THEN repeat('#', CAST((doc_id * 3 + (n - 1) * 5) % 20 + 1 AS INTEGER)) || ' ' ELSE '' END || line), chr(10)) AS text
  FROM documents), {_sections_sql("doc_id")}
SELECT doc_id, start_line, end_line, md5(path) AS path_md5, md5(body) AS body_md5 FROM sections""",
    "code_chunks": f"""WITH {values("expected", "name, start_line, end_line, text", samples.expected())}
SELECT 'w' AS index_id, '/w/' || name AS file, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, text FROM expected""",
    "set_description": f"WITH {CATALOG}, after AS (SELECT * REPLACE (CASE WHEN directory = '/ws/solo' THEN 'a new one' ELSE description END AS description) FROM catalog) {FLAT} after",
}
