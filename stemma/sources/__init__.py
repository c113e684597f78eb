"""Sources and sinks: tables, JSON and XML files, ordered leaves, ledgers, lookups and manifests."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAVES = "path string, ordinal int, segment_id string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df``, evaluated once: a table in the folder that ``spark.checkpoint.dir`` names, as executors share it.

    Where that is unset, a session whose executors are the driver itself gets a folder of its own; any other keeps the rows in its executors.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            return df.persist()
        base = tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/stemma-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with a declared schema; malformed ones are an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def config(spark: SparkSession, **documents: tuple[str, str]) -> dict[str, DataFrame]:
    """The documents of a configuration, name = (path, schema)."""
    return {name: json_document(spark, path, schema) for name, (path, schema) in documents.items()}


def jsonl(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """JSON Lines with a declared schema; blank lines are no rows, malformed ones an error; a missing file is empty if ``optional``."""
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def jsonl_with_places(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON Lines of a directory with ``file`` and ``line`` (blank lines counted); a repeated key is an error.

    Files are the unit: each is read whole by one task, so that line numbers need no order across tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "json")).filter(F.trim("json") != "")
    rows = lines.select("file", (F.col("at") + 1).alias("line"), F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*", "file", "line")
    copies = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = rows.withColumn("checked", F.assert_true(copies == 1, F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))))
    return checked.filter("checked IS NULL").drop("checked")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, content binary) of the files whose name fits a glob pattern."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return read.load(path).select("path", "content")


def listed_files(spark: SparkSession, base: str, config: DataFrame) -> DataFrame:
    """``config`` with the content of the files that its column ``path`` names below ``base``; missing files are no rows."""
    wanted = [r.path for r in config.select("path").distinct().collect()]  # a configuration, not data
    there = [f"{base.rstrip('/')}/{p}" for p in wanted if _exists(spark, f"{base.rstrip('/')}/{p}")]
    if not there:
        return config.withColumn("content", F.lit(None).cast("binary")).limit(0)
    read = spark.read.format("binaryFile").load(there).select(F.col("path").alias("full"), "content")
    return config.join(read, F.endswith(F.col("full"), F.concat(F.lit("/"), F.col("path")))).drop("full")


def ordered_json(documents: DataFrame) -> DataFrame:
    """(path, ordinal, segment_id, text) of the entries of (path, content) JSON objects, in their order in the file.

    A map type would lose that order, so entries become rows as they are parsed.  Objects only; malformed JSON is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = json.loads(content)
                if isinstance(value, dict):
                    rows += [(path, i, k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for i, (k, v) in enumerate(value.items(), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["path", "ordinal", "segment_id", "text"])

    return documents.select("path", "content").filter("content IS NOT NULL").mapInArrow(run, LEAVES)


def leaf_scan(spark: SparkSession, base: str, languages: list[str]) -> DataFrame:
    """Leaves of the root texts below ``base``/language, with the id and language that a file's name tells; other names are skipped."""
    name = r"([^/]+?)_root-([a-z]+)(?:-[^./]+)?\.json$"
    parts = [ordered_json(files(spark, f"{base}/{x}", "*.json", True)) for x in languages if _exists(spark, f"{base}/{x}")]
    if not parts:
        return spark.createDataFrame([], LEAVES + ", canonical_id string, language string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    told = out.withColumns({"canonical_id": F.regexp_extract("path", name, 1), "language": F.regexp_extract("path", name, 2)})
    return told.filter("canonical_id <> ''")


def paired_leaves(roots: DataFrame, templates: DataFrame) -> DataFrame:
    """Root leaves (work, ordinal, segment_id, text) with the template of the same segment, ``{}`` where there is none."""
    held = templates.select("work", "segment_id", F.col("text").alias("template"))
    return roots.join(held, ["work", "segment_id"], "left").withColumn("template", F.coalesce("template", F.lit("{}")))


def review_input(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reviews of files that each hold one, an array of them, or an object with such an array as ``reviews``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    inner = F.get_json_object("value", "$.reviews")
    array = F.when(F.startswith("value", F.lit("[")), F.col("value")).when(inner.isNotNull(), inner).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    return text.select(F.explode(F.from_json(array, f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("r")).select("r.*")


def lookup(df: DataFrame, key: str, order: list, *columns: str) -> DataFrame:
    """(key, line, columns): an index of the lines that ``write_jsonl`` gives ``df`` in that order."""
    return df.select(key, F.row_number().over(Window.orderBy(*order)).alias("line"), *columns)


def manifest(df: DataFrame, errors: DataFrame, counts: dict) -> DataFrame:
    """One row: the aggregates named in ``counts`` and the errors (rule, subject), sorted."""
    told = errors.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "subject", "rule"))).alias("errors"))
    return df.agg(*[c.alias(name) for name, c in counts.items()]).join(told, F.lit(True))


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """One file of JSON Lines in an order, fields sorted by name, nulls left out."""
    fields = F.to_json(F.struct(*sorted(df.columns))).alias("value")
    df.orderBy(*order).select(fields).coalesce(1).write.mode("errorifexists").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A one-row result as pretty JSON, keys sorted, with a newline at the end."""
    row = [json.loads(r) for r in df.toJSON().take(2)]
    if len(row) != 1:
        raise ValueError(f"a JSON document is one row, not {len(row) or 'none'}")
    text = json.dumps(row[0], ensure_ascii=False, indent=2, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append(df: DataFrame, path: str, write: bool = False) -> DataFrame:
    """New ledger rows, written only if told to; what comes back is what was or would be written."""
    if write:
        df.write.mode("append").parquet(path)
    return df
