"""Segments: partitioned Parquet tables below one root, with a manifest each.

A segment is the unit of retry: it counts as written once its manifest is there. All
files go through Spark's file systems, so a root can be on any store.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.operators.prepare import transform_matrix
from viewforge.plans.schema import TABLES, Options

LEGACY = "legacy"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Writes a file beside its place and moves it there, over what is there, in one step."""
    system, at = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.part")
    out = system.create(part, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    out.close()
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    mode = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = context._gateway.new_array(mode, 1)
    over[0] = mode.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), context._jsc.hadoopConfiguration()).rename(part, at, over)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a file; None if there is none or it can't be read."""
    system, at = _file_system(spark, path)
    if not system.exists(at):
        return None
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path).toLocalIterator()))
    except ValueError:
        return None


def segment_path(root: str, dataset: str, language: str, stage: str, subsegment: str = "core") -> str:
    return f"{root.rstrip('/')}/{dataset}/{language}/transform-{stage}/{subsegment}"


def write_segment(tables: dict[str, DataFrame], root: str, dataset: str, language: str, stage: str, subsegment: str = "core", options: Options | None = None, shard_rows: int = 10_000, resume: bool = True) -> dict:
    """Writes the tables of a segment and returns its manifest; an existing one is kept with resume."""
    options = options or Options()
    spark = next(iter(tables.values())).sparkSession
    path = segment_path(root, dataset, language, stage, subsegment)
    if resume and (done := read_json(spark, f"{path}/manifest.json")):
        return done
    system, at = _file_system(spark, path)
    system.delete(at, True)
    counts = {}
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    matrix = []
    if stage in ("v0", "v1", "v2"):
        units, views = (spark.read.parquet(f"{path}/{t}") for t in ("units", "views"))
        matrix = [r.asDict() for r in transform_matrix(units, views, stage, language, options.only).toLocalIterator()]
    manifest = {
        "format": "viewforge-segment",
        "created_at_unix": time.time(),
        "dataset_key": dataset,
        "language": language,
        "transform_stage": stage,
        "subsegment": subsegment,
        "tokenizer_agnostic": True,
        "tables": list(tables),
        "counts": counts,
        "transform_matrix": matrix,
        "config": asdict(options),
    }
    write_json(spark, f"{path}/manifest.json", manifest)
    parent = f"{root.rstrip('/')}/{dataset}/manifest.json"
    known = read_json(spark, parent) or {}
    write_json(spark, parent, known | {"dataset_key": dataset, "children": sorted({*known.get("children", []), path.removeprefix(f"{root.rstrip('/')}/{dataset}/")})})
    return manifest


def _matches(column, wanted: tuple[str, ...]):
    if not wanted or "all" in wanted:
        return F.lit(True)
    return column.rlike("|".join(f"(?:{translate(w)})".replace(r"\Z", r"\z") for w in wanted))


def with_segment(df: DataFrame) -> DataFrame:
    """df read from files with the language, stage and subsegment that their paths name."""
    path = F.col("_metadata.file_path")
    parts = df.select("*", F.regexp_extract(path, r"/([^/]+)/transform-([^/]+)/([^/]+)/[^/]+/[^/]+$", 1).alias("segment_language"), F.regexp_extract(path, r"/transform-([^/]+)/", 1).alias("segment_stage"), F.regexp_extract(path, r"/transform-[^/]+/([^/]+)/", 1).alias("subsegment"))
    return parts.withColumns({c: F.when(F.col(c) == "", LEGACY).otherwise(F.col(c)) for c in ("segment_language", "segment_stage", "subsegment")})


def read_table(spark: SparkSession, root: str, table: str, languages: tuple[str, ...] = (), stages: tuple[str, ...] = (), subsegments: tuple[str, ...] = ()) -> DataFrame:
    """A table of all segments below root whose names match; patterns may have wildcards, stages their prefix."""
    files = spark.read.schema(TABLES[table]).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    rows = with_segment(files).filter(F.col("_metadata.file_path").contains(f"/{table}/"))
    stages = tuple(s.removeprefix("transform-") for s in stages)
    return rows.filter(_matches(F.col("segment_language"), languages) & _matches(F.col("segment_stage"), stages) & _matches(F.col("subsegment"), subsegments))


def segments(spark: SparkSession, root: str) -> DataFrame:
    """language, stage and subsegment of the segments that have triples."""
    return read_table(spark, root, "triples").select("segment_language", "segment_stage", "subsegment").distinct()


def manifest_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each table over all manifests of segments below root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").option("multiLine", "true").schema("counts map<string,bigint>").json(root)
    return rows.select(F.explode("counts").alias("table", "n")).groupBy("table").agg(F.sum("n").alias("rows"), F.count("*").alias("segments"))
