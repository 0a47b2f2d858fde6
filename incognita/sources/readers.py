"""Sources and sinks: texts, DOCX, gazetteers, rules and mappings."""

from __future__ import annotations

import io
import logging
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAPPING = "forward map<string,string>, reverse map<string,string>, counters map<string,bigint>, stats struct<total_entities:bigint,per_type:map<string,bigint>>"


#: Input up to which rows are dealt to all cores: a small file of one row group would be one task.
SPREAD_BYTES = 128 << 20


def spread(docs: DataFrame) -> DataFrame:
    """The documents, dealt to all cores if the files they come from are small; larger inputs stay as they are split."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else docs


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path and text of whole UTF-8 files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file's body, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        parts = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda x: "\t", f"{_W}br": lambda x: "\n", f"{_W}cr": lambda x: "\n"}
        out.append("".join(parts[x.tag](x) for x in p.iter() if x.tag in parts))
    return "\n".join(out)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and text of DOCX files; null text where a file isn't one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for content in b.column(1):
                try:
                    texts.append(docx_text(content.as_py()))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string").select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_gazetteers(spark: SparkSession, path: str) -> DataFrame:
    """gazetteer (the file's stem), name and category of all CSV files of a folder.

    A file names its entries ``name`` or else ``keyword``; both columns and the category are trimmed, other columns are
    ignored, and rows without a name or category are left out.
    """
    spark_path = f"{path.rstrip('/')}/*.csv"
    lines = spark.read.text(spark_path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''")
    paths = [r.path for r in lines.select("path").distinct().collect()]
    out = gazetteer_table(spark, {})
    for p in sorted(paths):
        table = spark.read.csv(p, header=True)
        named = next((c for c in ("name", "keyword") if c in table.columns), None)
        if named and "category" in table.columns:
            found = table.select(F.lit(PurePosixPath(p).stem).alias("gazetteer"), F.trim(named).alias("name"), F.trim("category").alias("category"))
            out = out.union(found.where("name <> '' and category <> ''"))
        else:
            log.warning("no entries in %s", p)
    return out


def gazetteer_table(spark: SparkSession, gazetteers: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """gazetteer, name and category of gazetteers held in memory."""
    return spark.createDataFrame([(g, n, c) for g, entries in gazetteers.items() for n, c in entries], "gazetteer string, name string, category string")


def read_rules(text: str) -> dict[str, dict[str, list[str]]]:
    """Family, category and patterns of a YAML rule file; unknown families and invalid patterns are left out."""
    import yaml

    from . import catalog

    out: dict[str, dict[str, list[str]]] = {}
    for family, categories in (yaml.safe_load(text) or {}).items():
        if family not in catalog.FAMILIES:
            continue
        for category, patterns in (categories or {}).items():
            good = []
            for p in patterns or []:
                try:
                    re.compile(p)
                    good.append(p)
                except re.error as e:
                    log.warning("%s: %s", category, e)
            if good:
                out.setdefault(family, {})[category] = good
    return out


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """original, alias, prefix and n of a mapping's JSON file."""
    return mapping_entries(spark.read.text(path, wholetext=True))


def mapping_entries(files: DataFrame) -> DataFrame:
    """The entries of mappings in JSON (column ``value``); numbers are read off the aliases, so that missing counters can't make them collide."""
    data = files.select(F.from_json("value", MAPPING).alias("m")).select(F.explode("m.forward").alias("original", "alias"))
    prefix = F.regexp_extract("alias", r"^<(.*)_(\d+)>$", 1)
    return data.select("original", "alias", prefix.alias("prefix"), F.regexp_extract("alias", r"^<(.*)_(\d+)>$", 2).cast("bigint").alias("n"))


def mapping_json(entries: DataFrame, *keys: str) -> DataFrame:
    """One mapping in JSON (column ``value``) for each value of the key columns, from original, alias, prefix and n.

    A mapping is one file's content and is put together in one task: meant for the mapping of a document.
    """
    one = F.struct("n", "original", "alias", "prefix")
    each = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("a"))
    counters = F.aggregate("a", F.create_map().cast("map<string,bigint>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["prefix"]), F.create_map(x["prefix"], F.greatest(F.coalesce(F.try_element_at(m, x["prefix"]), F.lit(0).cast("bigint")), x["n"]))))
    pairs = lambda a, b: F.map_from_entries(F.transform("a", lambda x: F.struct(x[a], x[b])))
    table = each.withColumn("counters", counters)
    stats = F.struct(F.size("a").cast("bigint").alias("total_entities"), F.col("counters").alias("per_type"))
    return table.select(*keys, F.to_json(F.struct(pairs("original", "alias").alias("forward"), pairs("alias", "original").alias("reverse"), "counters", stats.alias("stats"))).alias("value"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), deleted when the application ends.

    Only where that is unset and all runs on one machine a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_file(spark: SparkSession, path: str, content: str | bytes) -> str:
    """Writes one small file (a mapping, a rule file) wherever Spark can, in place of an earlier one; returns its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()
    return path


def read_file(spark: SparkSession, path: str) -> str:
    """The text of one small file, wherever Spark can read it; a byte order mark is left out."""
    return spark.read.text(path, wholetext=True).first().value.removeprefix("\ufeff")


def write_texts(docs: DataFrame, path: str) -> None:
    """doc_id and text as parquet: one row a document, whatever it holds."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)
