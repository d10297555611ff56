"""Readers of file trees: inventories, parsed Markdown, rules, question lists, logs, normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File names of parsed texts in order of preference.
MARKDOWN_NAMES = ("document.md", "full.md", "auto.md", "middle.md")


def file_inventory(spark: SparkSession, root: str, pattern: str = "*.pdf", known: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, sha256) of the files below root.

    With `known` (path, size, mtime, sha256), only files that are new or changed are read and hashed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    if known is None:
        return listed.join(hashed, "path")
    same = listed.join(known, ["path", "size", "mtime"])
    fresh = listed.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return same.select("path", "size", "mtime", "sha256").unionByName(fresh.join(hashed, "path"))


def load_markdown(spark: SparkSession, root: str, least: int = 100) -> DataFrame:
    """(paper_id, markdown): the preferred text of each folder below root, with at least so many characters that are not blank."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root)
    path = F.col("_metadata.file_path")
    rows = rows.select(F.regexp_extract(path, "/([^/]+)/[^/]+$", 1).alias("paper_id"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("value").alias("markdown"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MARKDOWN_NAMES)), F.col("name")), F.lit(0)), F.lit(len(MARKDOWN_NAMES) + 1))
    order = Window.partitionBy("paper_id").orderBy("place", F.length("name"), "name")
    kept = rows.filter(F.length(F.regexp_replace("markdown", "\\s", "")) >= least).withColumn("place", place)
    return kept.withColumn("n", F.row_number().over(order)).filter("n = 1").select("paper_id", "markdown")


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return lines.select(F.from_json("v", "query string, expected_paper_ids array<string>, expected_terms array<string>, notes string").alias("q")).select("q.*")


def synonym_rules(spark: SparkSession, path: str) -> DataFrame:
    """(term, alt, ord) of a JSON object whose values are a string or a list of strings."""
    raw = spark.read.option("wholetext", "true").text(path)
    each = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "v"))
    alts = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    rows = each.select(F.lower(F.trim("term")).alias("term"), F.posexplode(alts).alias("ord", "alt")).withColumn("alt", F.trim("alt"))
    return rows.filter("term <> '' and alt <> '' and lower(alt) <> term")


def job_logs(spark: SparkSession, root: str) -> DataFrame:
    """(job, line): the lines of log files with the number in the file's name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(root)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).alias("job"), F.col("value").alias("line"))


def biblio_tables(spark: SparkSession, root: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The normalised tables below root as Parquet; a required one that is missing is an error."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in (*required, *optional):
        try:
            out[name] = spark.read.parquet(f"{root}/{name}.parquet")
        except AnalysisException as e:
            if name in required:
                raise ValueError(f"missing table: {name}") from e
    return out


def resolve_paths(rows: DataFrame, inventory: DataFrame, old: str, new: str, root: str) -> DataFrame:
    """(id, path): of the candidates of each row (id, path) the first that the inventory (path) holds, else null.

    Candidates are the path itself, the path with its prefix `old` replaced by `new`, and folder and
    name under `root`. They are looked up in one join.
    """
    p = F.col("path")
    tail = F.regexp_extract("path", "/storage/([A-Za-z0-9]{8}/[^/]+)$", 1)
    swapped = F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p))))
    candidates = F.array(p, swapped, F.when(tail != "", F.concat(F.lit(f"{root}/"), tail)))
    each = rows.select("id", F.posexplode(candidates).alias("order", "path"))
    found = each.join(inventory.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return found.groupBy("id").agg(F.min(F.when(F.col("there"), F.struct("order", "path")))["path"].alias("path"))


def jdbc_tables(spark: SparkSession, url: str, required: tuple[str, ...], options: dict | None = None, splits: dict[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """The required tables of a database behind JDBC; a missing one is an error that names it.

    `splits` gives a table's numeric key, its range and a number of partitions, so that it is read by
    several tasks; filters and columns are pushed to the database.
    """
    out, missing = {}, []
    for name in required:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **(options or {}))
        if splits and name in splits:
            key, low, high, n = splits[name]
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=n)
        try:
            out[name] = reader.load()
        except Exception as e:  # noqa: BLE001 - each driver raises its own kinds
            missing.append(f"{name} ({type(e).__name__})")
    if missing:
        raise ValueError("tables that can't be read: " + ", ".join(missing))
    return out
