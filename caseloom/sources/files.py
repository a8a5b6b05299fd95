"""Readers and writers of JSON lines, CSV, text and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caseloom.operators.ranking import running_totals


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, mode: str = "strict") -> DataFrame:
    """JSON lines under a schema. ``strict`` fails on a bad line, ``skip`` leaves it out, ``keep`` adds it as ``bad_line``."""
    if mode == "keep":
        full = StructType([*(StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, StructField("bad_line", StringType())])
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}).alias("x")).select("x.*")
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "skip": "DROPMALFORMED"}[mode]).json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are texts and nothing counts as missing."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    df = df.schema(schema).csv(path) if schema else df.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*columns) if columns else df


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, id)``: distinct ids of a text file, in the order in which they first occur."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("_at")).where("id <> ''")
    first = lines.groupBy("id").agg(F.min("_at").alias("_at"))
    return running_totals(first, ["_at"]).select((F.col("ahead") + 1).alias("seq"), "id")


def unique_keyed(df: DataFrame, key: str) -> DataFrame:
    """One row per key: equal copies count once, rows that disagree fail at run time."""
    n = df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*df.columns))).alias("_n"), F.first(F.struct(*df.columns)).alias("_x"))
    message = F.concat(F.lit("conflicting rows of key "), F.col(key).cast("string"))
    return n.where(F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True))).select("_x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, digits: int = 4, sep: str = ",") -> None:
    """CSV with a header and doubles at a fixed number of digits."""
    columns = [F.format_string(f"%.{digits}f", c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_trec(qrels: DataFrame, path: str) -> None:
    """``qid 0 doc grade`` lines, sorted."""
    qrels.orderBy("qid", "doc_id").select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", F.col("grade").cast("string"))).write.mode("overwrite").text(path)


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """``(qid, judged)``: the grades of a query as a JSON object."""
    return qrels.groupBy("qid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "grade"))))).alias("judged"))


def describe(df: DataFrame, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(column, type, filled, distinct_about)`` of a table by one aggregation, and its first ``rows`` rows."""
    counts = [x for c in df.columns for x in (F.count(F.col(f"`{c}`")).alias(f"n_{c}"), F.approx_count_distinct(F.to_json(F.struct(F.col(f"`{c}`")))).alias(f"d_{c}"))]
    got = df.agg(*counts)
    entry = lambda c, kind: F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"`n_{c}`").alias("filled"), F.col(f"`d_{c}`").alias("distinct_about"))
    return got.select(F.inline(F.array(*[entry(c, kind) for c, kind in df.dtypes]))), df.limit(rows)


def read_json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row ``(path, ...)`` per file: the whole file as one JSON object or, failing that, its first line that is one.

    Files without any object give no row.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parse = lambda c: F.from_json(c, schema if isinstance(schema, StructType) else StructType.fromDDL(schema), {"mode": "PERMISSIVE"})
    braced = lambda c: F.when(F.trim(c).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(c).isNotNull(), c)
    lines = F.filter(F.split("value", r"\r\n|\n|\r"), lambda x: F.trim(x).rlike(r"^\{.*\}$") & F.try_parse_json(x).isNotNull())
    return whole.select("path", F.coalesce(braced(F.col("value")), F.get(lines, 0)).alias("_o")).where("_o is not null").select("path", parse(F.col("_o")).alias("_x")).select("path", "_x.*")


def read_run_catalog(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """``(run, path, ...)``: the JSON summaries of many run folders, named by the folder that holds each."""
    return read_json_object(spark, pattern, schema).withColumn("run", F.element_at(F.split("path", "/"), -2))


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, name, length, modified)`` of all files below a folder whose name fits; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``discover`` with the MD5 of each file; one task reads one file at a time, so files must fit a task."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` between two fingerprints: added, removed or changed by content; a new time alone is none."""
    a, b = before.select("path", F.col("md5").alias("old")), after.select("path", F.col("md5").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def first_existing(spark: SparkSession, candidates: list[str], strict: bool = True) -> str | None:
    """The first path of ``candidates`` that the file system of the cluster holds; none is an error if ``strict``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(conf).exists(path):
            return c
    if strict:
        raise FileNotFoundError(", ".join(candidates))
    return None


def save_index(postings: DataFrame, path: str) -> None:
    """Postings ``(doc_id, dl, term, tf)`` as Parquet in parts by a hash of the term, each sorted by term, so that a search reads few row groups."""
    part = F.pmod(F.xxhash64("term"), F.lit(64)).cast("int")
    postings.withColumn("part", part).repartition("part").sortWithinPartitions("term", "doc_id").write.mode("overwrite").partitionBy("part").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")
