"""Files in and out: JSON lines, uploaded texts, Markdown exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# What can be uploaded.
EXTENSIONS = ("md", "txt", "html", "htm", "json", "yaml", "yml", "go", "py", "js", "ts", "rst", "xml", "csv", "toml")


def read_json_lines(spark: SparkSession, path: str, schema: str, last: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of JSON lines; malformed and empty lines are left out; with last, the last rows by order."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return rows if last is None else rows.orderBy(F.desc(order)).limit(last)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Committed as a whole or not at all, by Spark's commit protocol."""
    rows.write.mode("overwrite").json(path)


def read_uploads(spark: SparkSession, path: str, least_bytes: int = 50) -> DataFrame:
    """path and content of each file with a known extension and at least least_bytes of text."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)
    return texts.filter(known & (F.octet_length("content") >= least_bytes))


# The columns of the JSON lines that are read and written.
SCHEMAS = {
    "dataset": "user_prompt string, assistant_response string, label string",
    "benchmark": "index bigint, classification string, stage string, stored int, latency_ms bigint, user_prompt_len int, assistant_len int, entry_len int, summary string, wp_stored int, wp_dupes int, wp_filtered int, wp_extended int, wp_merged int, error string",
    "rejections": "time timestamp, stage string, user_len int, asst_len int, user_prefix string, asst_text string",
}


def read_rows(spark: SparkSession, path: str, kind: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of JSON lines of one of SCHEMAS: the first `limit` good rows by file and line (0: all), and file, lines and bad, a row a file.

    A line that isn't a JSON object, or has a value of another type, is bad; blank lines are neither; missing values are null.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{SCHEMAS[kind]}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.col("row").isNotNull() & F.col("row._bad").isNull() & F.trim("value").startswith("{")
    bad = parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~good).alias("bad"))
    rows = parsed.filter(good)
    rows = rows.orderBy("at").limit(limit) if limit > 0 else rows
    return rows.select("row.*").drop("_bad"), bad


def export_markdown(memories: DataFrame, path: str, at: str, least_quality: float = 0.0, title: str = "Knowledge Base Export") -> int:
    """One Markdown file for each source and index.md in a new folder, which appears as a whole; gives the number of sources.

    memories: id, source, content, quality_score, hit_count, created_at; at: when, as it stands in the files. Best quality
    first, then the oldest. Null quality is 0, a null or empty source "captured"; below least_quality (where above 0) a
    memory is left out. A source whose name makes `index` is index-of-source.md. Sources whose names make the same file name share the file, one after the other. Without a
    memory nothing is written and it is an error. A file is sorted and written by one task, row by row.
    """
    from ..functions import text as T
    from ..operators.ranks import places

    spark = memories.sparkSession
    quality = F.coalesce("quality_score", F.lit(0.0))
    source = F.when(F.coalesce("source", F.lit("")) == "", F.lit("captured")).otherwise(F.col("source"))
    rows = memories.select("id", source.alias("source"), F.coalesce("content", F.lit("")).alias("content"), quality.alias("quality"), F.coalesce("hit_count", F.lit(0)).alias("hits"), F.col("created_at").cast("timestamp").alias("created"))
    named = lambda source: F.when(T.file_name(source) == "index", F.lit("index-of-source")).otherwise(T.file_name(source))
    placed = places(rows.filter(F.col("quality") >= least_quality) if least_quality > 0 else rows, ["source"], [F.desc("quality"), F.col("created"), F.col("id")])
    sizes = placed.groupBy("source").agg(F.count("*").alias("n")).withColumn("file", named(F.col("source")))
    entry = F.concat(
        F.lit("## "), F.col("place").cast("string"), F.lit(". "), T.first_line(F.col("content")), F.lit("\n\n"), F.col("content"), F.lit("\n\n_quality: "), F.format_string("%.2f", "quality"),
        F.lit(" | hits: "), F.col("hits").cast("string"), F.lit(" | created: "), F.date_format("created", "yyyy-MM-dd"), F.lit("_\n\n---\n"),
    )
    heads = sizes.select("file", "source", F.lit(0).cast("bigint").alias("place"), F.concat(F.lit("# "), "source", F.lit("\n\n> "), F.col("n").cast("string"), F.lit(f" memories | exported {at}\n")).alias("value"))
    files = heads.union(placed.select(named(F.col("source")).alias("file"), "source", F.col("place").cast("bigint"), entry.alias("value")))
    listed = sizes.select("source", "file", "n").orderBy("source").collect()  # a row a source: the index names each
    if not listed:
        raise ValueError(f"no memories to export (quality of {least_quality:.2f} or more)")
    total = sum(r.n for r in listed)
    filtered = f"> quality filter: >= {least_quality:.2f}\n\n" if least_quality > 0 else ""
    index = f"# {title}\n\n> {total} memories across {len(listed)} sources | exported {at}\n\n{filtered}## Sources\n\n" + "".join(f"- [{r.source}]({r.file}.md) ({r.n} memories)\n" for r in listed)
    draft = f"{path.rstrip('/')}.draft"
    whole = files.union(spark.createDataFrame([("", "", 0, index)], files.schema)).withColumn("name", F.when(F.col("file") == "", F.lit("index")).otherwise(F.col("file")))
    whole.repartition("name").sortWithinPartitions("name", "source", "place").select("name", "value").write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(draft)
    # Spark names files by task; they get their own names, then the folder its own.
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [f.getPath() for f in fs.listStatus(to(draft)) if f.isDirectory()]:
        (part,) = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        fs.rename(part, to(draft, f"{folder.getName().partition('=')[2]}.md"))
        fs.delete(folder, True)
    fs.delete(to(draft, "_SUCCESS"), False)
    if not fs.rename(to(draft), to(path)) or fs.exists(to(path, draft.rpartition("/")[2])):
        raise FileExistsError(path)
    return len(listed)
