"""Whole preparations: corpora by language and stage to segments, segments to a token cache."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.operators import assemble, tokens
from viewforge.operators.files import capped
from viewforge.operators.prepare import prepare, prepare_tasks
from viewforge.plans import segments
from viewforge.plans.schema import LANGUAGES, Options, check_coverage, stage_chain
from viewforge.plans.scratch import materialise

#: Other names of languages on a command line.
ALIASES = {"js": "javascript", "node": "javascript", "golang": "go", "py": "python", "python3": "python"}


def chosen_languages(wanted: tuple[str, ...]) -> list[str]:
    """Languages in the order asked for, each once; `all` means all."""
    names = [ALIASES.get(w.strip().lower(), w.strip().lower()) for w in wanted]
    if "all" in names:
        return list(LANGUAGES)
    if unknown := sorted(set(names) - set(LANGUAGES)):
        raise ValueError(f"unknown languages: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


def file_cap(caps: dict[str, int], language: str, dataset: str) -> int | None:
    """The cap on files: the language's before the dataset's before the one named ''."""
    return next((caps[k] for k in (language, dataset, "") if k in caps), None)


def prepare_corpus(spark: SparkSession, sources: DataFrame, root: str, stages: tuple[str, ...] = ("v0", "v1", "v2"), languages: tuple[str, ...] = ("all",), options: Options | None = None, caps: dict[str, int] | None = None, resume: bool = True, strict: bool = False) -> dict:
    """Writes a segment for each dataset, language and stage of sources (plans.schema.SOURCE_FILES).

    The root manifest says `running` until all are written.
    """
    options, caps = options or Options(), caps or {}
    for stage in stages:
        stage_chain(stage)
    chosen = chosen_languages(languages)
    if strict:
        check_coverage(tuple(chosen))
    manifest = {"format": "viewforge-root", "status": "running", "created_at_unix": time.time(), "stages": list(stages), "languages": chosen, "config": asdict(options), "segments": []}
    place = f"{root.rstrip('/')}/manifest.json"
    segments.write_json(spark, place, manifest)
    subsegment = f"only-{options.only}" if options.only else "core"
    # the datasets of one call are few
    for dataset in sorted(r.dataset_key for r in sources.select("dataset_key").distinct().toLocalIterator()):
        for language in chosen:
            rows = sources.filter((F.col("dataset_key") == dataset) & (F.col("language") == language))
            cap = file_cap(caps, language, dataset)
            if cap is not None:
                rows = capped(rows, ["dataset_key", "language"], cap)
            if rows.isEmpty():
                continue
            for stage in stages:
                path = segments.segment_path(root, dataset, language, stage, subsegment)
                done = segments.read_json(spark, f"{path}/manifest.json") if resume else None
                done = done or segments.write_segment(prepare(rows, stage, options), root, dataset, language, stage, subsegment, options, resume=resume)
                manifest["segments"].append({"path": path, "counts": done["counts"]})
                segments.write_json(spark, place, manifest)
    manifest |= {"status": "complete", "finished_at_unix": time.time()}
    segments.write_json(spark, place, manifest)
    return manifest


def prepare_task_corpus(tasks: DataFrame, root: str, dataset: str, options: Options | None = None, resume: bool = True) -> dict:
    """Writes a segment of task solutions and their pairs."""
    return segments.write_segment(prepare_tasks(tasks, dataset, options), root, dataset, "multi", "task-semantic", "core", options, resume=resume)


def token_cache(spark: SparkSession, root: str, out: str, tokenizer_path: str, buckets: tuple[int, ...] = tokens.BUCKETS, pad: int = 0, languages: tuple[str, ...] = (), stages: tuple[str, ...] = (), subsegments: tuple[str, ...] = (), per_segment: int = 0, overwrite: bool = False) -> dict:
    """Triples of all matching segments, with their views' ids, cut and padded, one folder a bucket.

    A finished cache is kept unless overwritten; an unfinished one counts as an error
    unless overwritten.
    """
    place = f"{out.rstrip('/')}/manifest.json"
    done = segments.read_json(spark, place)
    if done and not overwrite:
        return done
    system, at = segments._file_system(spark, f"{out.rstrip('/')}/examples")
    if system.exists(at) and not overwrite:
        raise FileExistsError(f"{out} holds an unfinished cache")
    system.delete(at, True)
    chosen = (languages, stages, subsegments)
    parts = ["segment_language", "segment_stage", "subsegment"]
    triples = segments.read_table(spark, root, "triples", *chosen)
    if per_segment:
        triples = capped(triples, parts, per_segment, "triple_id")
    views = segments.read_table(spark, root, "views", *chosen).select("view_id", "code")
    wanted = materialise(triples, "cache-triples")
    joined = assemble.assemble(wanted, assemble.needed_views(wanted, views))
    rows = tokens.bucketed(tokens.encode_views(joined.select("triple_id", *parts, "positive_transform", "negative_transform", "negative_type", *assemble.SIDES), tokenizer_path), buckets, pad).drop(*assemble.SIDES)
    tokens.write_cache(rows, f"{out.rstrip('/')}/examples", overwrite=overwrite)
    cache = spark.read.parquet(f"{out.rstrip('/')}/examples")
    counts = cache.groupBy("bucket_len").agg(F.count("*").alias("n"), F.count_if("truncated").alias("cut")).toLocalIterator()
    by = {str(r.bucket_len): {"examples": r.n, "truncated": r.cut} for r in counts}
    total = sum(v["examples"] for v in by.values())
    named = {c: {r.name: r.id for r in assemble.vocabulary(cache, c).toLocalIterator()} for c in ("positive_transform", "negative_transform", "negative_type")}
    manifest = {"format": "viewforge-token-cache", "tokenizer": tokenizer_path, "buckets": by, "examples": total, "skipped_missing_view": wanted.count() - total, "vocabularies": named, "pad_id": pad}
    segments.write_json(spark, place, manifest)
    return manifest
