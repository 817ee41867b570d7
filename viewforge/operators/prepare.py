"""Source files to the seven tables of a segment.

One Arrow-backed pass parses each file once and emits its rows, tagged by table and
packed as JSON. That table is written with a folder for each of the seven, which are
projections of their own folder's rows, so the edits run once whatever is read
afterwards, and a reader of one table scans that one alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.code import languages as L
from viewforge.code import pyast, pyedits, textedits
from viewforge.code.pyedits import View
from viewforge.functions import text as T
from viewforge.plans.schema import TABLES, Options, stage_chain
from viewforge.plans.scratch import materialise

#: The labels that every triple and pair carries.
TRIPLE_LABELS = {
    "positive_strategy_label": "close",
    "positive_semantic_label": "close",
    "positive_local_label": "low_change",
    "negative_strategy_label": "close",
    "negative_semantic_label": "far",
    "negative_local_label": "changed_span_important",
}
#: Characters of packed rows that leave a task together.
PACKED_CHARS = 4 << 20
PAIR_LABELS = {"semantic_label": "close", "strategy_label": "far/maybe", "local_label": "diffuse"}


def stable_hash(*parts: object, length: int = 20) -> str:
    """functions.text.stable_hash for values at hand."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()[:length]


def split_of(key: str) -> str:
    value = int(stable_hash("split", key, length=8), 16) % 100
    return "train" if value < 90 else "validation" if value < 95 else "test"


def bucket_of(loc: int) -> tuple[str, float]:
    """Size bucket and sampling weight."""
    return next(((name, weight) for name, most, weight in T.SIZE_BUCKETS if loc <= most), T.LARGEST_BUCKET)


def line_window(code: str, first: int, last: int, radius: int) -> str:
    lines = code.splitlines()
    return "\n".join(lines[max(1, first - radius) - 1 : min(len(lines), last + radius)]).rstrip() + "\n"


def comment_text(text: str, language: str) -> str:
    mark = "#" if language in ("python", "ruby") else "//"
    return "".join(f"{mark} {line}\n" if line else f"{mark}\n" for line in text.splitlines()) or "\n"


def contextualize(code: str, unit: pyast.Unit, language: str) -> str:
    imports, head, siblings = unit.imports_context.strip(), unit.class_context.strip(), unit.siblings.strip()
    parts = [comment_text("<imports>", language) + imports] if imports else []
    parts += [comment_text(f"{tag}\n{body}", language) for tag, body in (("<class>", head), ("<siblings>", siblings)) if body]
    return "\n\n".join([*parts, comment_text("<focal>", language) + code.rstrip()]) + "\n"


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


class FileRows:
    """The rows of one source file."""

    def __init__(self, row: dict, stage: str, options: Options):
        self.row, self.stage, self.options = row, stage, options
        self.language = row["language"]
        self.out: list[tuple[str, dict]] = []

    def add(self, table: str, **values: object) -> dict:
        self.out.append((table, values))
        return values

    def rows(self) -> list[tuple[str, dict]]:
        row, options = self.row, self.options
        metadata = json.loads(row["metadata_json"] or "{}")
        source = (row["source"] or "").rstrip() + "\n"
        if str(metadata.get("autogenerated", "")).lower() == "true":
            return []
        parsed = L.parse(source, self.language)
        if not parsed.parse_ok:
            return []
        repository, path = row["repository_name"] or "", row["path"] or ""
        file_hash = str(metadata.get("hash") or stable_hash(repository, path, source))
        self.file_id = stable_hash(row["dataset_key"], repository, path, file_hash)
        self.split = split_of(repository or path or self.file_id)
        python = self.language == "python"
        imports = pyast.imports_context(parsed.tree, source) if python else L.imports_context(source, L.LANGUAGES[self.language])
        self.add(
            "files",
            file_id=self.file_id,
            dataset_key=row["dataset_key"],
            source_dataset=row["source_dataset"],
            source_split=row["source_split"],
            split=self.split,
            source_row_index=row["source_row_index"],
            repository_name=repository,
            path=path,
            language=self.language,
            source_available=True,
            source=source,
            char_len=len(source),
            loc=pyast.line_count(source),
            rough_token_len=len(source.split()),
            parse_ok=parsed.parse_ok,
            compile_ok=parsed.compile_ok,
            imports_context=imports,
            top_defs_json=json.dumps(pyast.top_definitions(parsed.tree) if python else [], ensure_ascii=False),
            metadata_json=_dump(metadata),
        )
        shape = (options.max_units, options.window_lines, options.window_stride, options.max_windows)
        for unit in pyast.units(source, *shape) if python else L.units(source, self.language, *shape):
            loc = pyast.line_count(unit.code)
            if unit.family in ("function", "method", "nested_function") and not options.min_loc <= loc <= options.max_loc:
                continue
            unit.imports_context = unit.imports_context or imports
            unit_id = stable_hash(self.file_id, self.language, unit.family, unit.name, unit.start_line, unit.end_line, unit.code)
            self.add_unit(unit_id, unit, parsed if unit.family == "file_window" else L.parse(unit.code, self.language))
            relation = stable_hash(self.file_id, "contains", unit_id)
            self.add("relations", relation_id=relation, file_id=self.file_id, src_id=self.file_id, dst_id=unit_id, relation_type="file_contains_unit", metadata_json=_dump({"unit_family": unit.family}))
            for span in pyast.spans(unit_id, unit.code, options.max_spans) if python else L.token_spans(unit_id, unit.code, options.max_spans):
                self.add("spans", **span, file_id=self.file_id, split=self.split)
            if options.transforms and self.stage != "extract-only":
                self.add_views(unit_id, unit)
        return self.out

    def add_unit(self, unit_id: str, unit: pyast.Unit, parsed: pyast.Parsed) -> None:
        row, loc = self.row, pyast.line_count(unit.code)
        self.add(
            "units",
            unit_id=unit_id,
            file_id=self.file_id,
            dataset_key=row["dataset_key"],
            source_dataset=row["source_dataset"],
            source_split=row["source_split"],
            split=self.split,
            transform_stage=self.stage,
            language=self.language,
            unit_family=unit.family,
            unit_type=unit.type,
            qualified_name=unit.name,
            repository_name=row["repository_name"],
            path=row["path"],
            start_line=unit.start_line,
            end_line=unit.end_line,
            code=unit.code,
            imports_context=unit.imports_context,
            class_context=unit.class_context,
            sibling_signatures=unit.siblings,
            identifiers_json=json.dumps(unit.identifiers, ensure_ascii=False),
            calls_json=json.dumps(unit.calls, ensure_ascii=False),
            ast_sequence=" ".join(unit.sequence),
            loc=loc,
            char_len=len(unit.code),
            rough_token_len=len(unit.code.split()),
            size_bucket=bucket_of(loc)[0],
            parse_ok=parsed.parse_ok,
            compile_ok=parsed.compile_ok,
            error=parsed.error,
        )

    def add_view(self, unit_id: str, family: str, view: View) -> str:
        parsed = L.parse(view.code, self.language)
        view_id = stable_hash(unit_id, family, view.role, view.name, view.code)
        self.add(
            "views",
            view_id=view_id,
            unit_id=unit_id,
            file_id=self.file_id,
            dataset_key=self.row["dataset_key"],
            source_dataset=self.row["source_dataset"],
            split=self.split,
            transform_stage=self.stage,
            family=family,
            role=view.role,
            transform_name=view.name,
            code=view.code.rstrip() + "\n",
            parse_ok=parsed.parse_ok,
            compile_ok=parsed.compile_ok,
            confidence=view.confidence,
            changed_spans_json=json.dumps(view.changed_spans, ensure_ascii=False),
            metadata_json=_dump(view.metadata),
        )
        return view_id

    def add_triple(self, unit_id: str, family: str, views: tuple[str, str, str], positive: str, negative: View, weight: float) -> None:
        ids = dict(zip(("anchor_view_id", "positive_view_id", "negative_view_id"), views, strict=True))
        kind = str(negative.metadata.get("negative_type", negative.name))
        self.add("triples", triple_id=stable_hash(unit_id, family, *views), unit_id=unit_id, file_id=self.file_id, split=self.split, transform_stage=self.stage, family=family, **ids, positive_transform=positive, negative_transform=negative.name, negative_type=kind, **TRIPLE_LABELS, sampling_weight=weight)

    def support(self, code: str, role: str) -> tuple[list[View], set[str]]:
        """The views of all stages carried, each code once, and the names that the last stage adds."""
        most = self.options.max_positive if role == "positive" else self.options.max_negative
        seen, found, fresh = {code.strip()}, [], set()
        for stage in stage_chain(self.stage):
            views = pyedits.views(code, stage, role, most) if self.language == "python" else textedits.views(code, self.language, stage, role, most)
            for view in views:
                if view.code.strip() in seen:
                    continue
                seen.add(view.code.strip())
                found.append(view)
                if stage == self.stage and self.options.only in ("", view.name):
                    fresh.add(view.name)
        return found, fresh

    def add_views(self, unit_id: str, unit: pyast.Unit) -> None:
        positives, new_positive = self.support(unit.code, "positive")
        negatives, new_negative = self.support(unit.code, "negative")
        if not positives or not negatives or self.options.only and not new_positive | new_negative:
            return
        lang = self.language
        anchors = {
            "focal_triplet": self.add_view(unit_id, "focal_triplet", View("anchor", "anchor", unit.code, "safe")),
            "context_triplet": self.add_view(unit_id, "context_triplet", View("anchor_context", "anchor", contextualize(unit.code, unit, lang), "safe")),
        }
        sequence = View("ast_sequence", "auxiliary", comment_text("<ast>\n" + " ".join(unit.sequence), lang), "safe", [], {"auxiliary_type": "ast_node_type_sequence"})
        aux = self.add_view(unit_id, "ast_aux", sequence)
        self.add("relations", relation_id=stable_hash(unit_id, "ast_aux", aux), file_id=self.file_id, src_id=unit_id, dst_id=aux, relation_type="unit_has_ast_aux_view", metadata_json="{}")

        def family_view(family: str, view: View) -> str:
            if family == "context_triplet":
                view = View(f"{view.role}_context", view.role, contextualize(view.code, unit, lang), view.confidence, view.changed_spans, view.metadata)
            return self.add_view(unit_id, family, view)

        weight = bucket_of(pyast.line_count(unit.code))[1]
        for family, anchor in anchors.items():
            ids = [[(v, family_view(family, v)) for v in views] for views in (positives, negatives)]
            for positive, positive_id in ids[0]:
                for negative, negative_id in ids[1]:
                    if positive.name in new_positive or negative.name in new_negative:
                        self.add_triple(unit_id, family, (anchor, positive_id, negative_id), positive.name, negative, weight)
        for negative in negatives:
            if negative.name in new_negative:
                for span in negative.changed_spans[:2]:
                    self.add_span_window(unit_id, unit, positives[0], negative, span)

    def add_span_window(self, unit_id: str, unit: pyast.Unit, positive: View, negative: View, span: dict) -> None:
        """A unit, three views and a triple of the lines around a changed place."""
        first = int(span.get("start_line") or 1)
        last = int(span.get("end_line") or first)
        anchor, kept, changed = (line_window(code, first, last, self.options.local_radius) for code in (unit.code, positive.code, negative.code))
        if not anchor.strip() or not changed.strip():
            return
        window = pyast.Unit("span_window", "span_window", f"{unit.name}:L{first}-{last}", anchor, first, last)
        parsed = L.parse(anchor, self.language)
        if self.language != "python":
            window.identifiers, window.calls = L.identifiers(anchor, L.LANGUAGES[self.language]), L.calls(anchor, L.LANGUAGES[self.language])
        elif parsed.tree is not None:
            window.identifiers, window.calls, window.sequence = pyast.identifiers(parsed.tree), pyast.calls(parsed.tree), pyast.sequence(parsed.tree)
        window_id = stable_hash(unit_id, "span_window", negative.name, first, last)
        self.add_unit(window_id, window, parsed)
        parent = {"parent_unit_id": unit_id}
        family = "local_span_triplet"
        ids = (
            self.add_view(window_id, family, View("span_anchor", "anchor", anchor, "safe", [], parent)),
            self.add_view(window_id, family, View("span_positive", "positive", kept, "likely", [], parent)),
            self.add_view(window_id, family, View(negative.name, "negative", changed, negative.confidence, [span], negative.metadata | parent)),
        )
        self.add_triple(window_id, family, ids, "span_positive", negative, 1.0)


def _mapper(stage: str, options: Options):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: list[str] = []
        rows: list[str] = []
        size = 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    found = FileRows(row, stage, options).rows()
                except (RecursionError, MemoryError):
                    continue
                tables += [t for t, _ in found]
                packed = [json.dumps(r, ensure_ascii=False) for _, r in found]
                rows += packed
                size += sum(map(len, packed))
                if size > PACKED_CHARS:
                    yield pd.DataFrame({"table": tables, "row": rows})
                    tables, rows, size = [], [], 0
        if rows:
            yield pd.DataFrame({"table": tables, "row": rows})

    return run


def prepare(files: DataFrame, stage: str, options: Options | None = None) -> dict[str, DataFrame]:
    """The tables of a segment from source files (plans.schema.SOURCE_FILES), by name.

    Files that don't parse or are generated give no rows; so do files whose trees are
    too deep to be read.
    """
    stage_chain(stage)
    packed = materialise(files.mapInPandas(_mapper(stage, options or Options()), "table string, row string"), f"prepare-{stage}", "table")
    return {name: packed.filter(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in TABLES.items()}


def rejected(files: DataFrame) -> DataFrame:
    """The files that give no rows, with why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons = []
            for row in pdf.to_dict("records"):
                parsed = L.parse((row["source"] or "").rstrip() + "\n", row["language"])
                generated = str(json.loads(row["metadata_json"] or "{}").get("autogenerated", "")).lower() == "true"
                reasons.append("autogenerated" if generated else None if parsed.parse_ok else parsed.error or "unbalanced")
            yield pdf[["source_row_index", "path"]].assign(reason=reasons)

    return files.mapInPandas(run, "source_row_index long, path string, reason string").filter("reason is not null")


def transform_matrix(units: DataFrame, views: DataFrame, stage: str, language: str, only: str = "") -> DataFrame:
    """For each edit of the stage's inventory: source units, views, those that parse, those with a changed span."""
    from viewforge.plans.schema import inventory

    spark = units.sparkSession
    known = spark.createDataFrame(inventory(stage, only), "stage string, role string, transform string")
    focal = views.filter("family = 'focal_triplet' and role in ('positive', 'negative')")
    seen = focal.groupBy("role", F.col("transform_name").alias("transform")).agg(
        F.count("*").alias("yielded"), F.count_if("parse_ok").alias("parse_valid_after_transform"), F.count_if(F.col("changed_spans_json") != "[]").alias("changed_span_present")
    )
    attempted = units.filter("unit_family <> 'span_window'").agg(F.count("*").alias("attempted"))
    # both sides are at most one row an edit
    out = known.join(F.broadcast(seen), ["role", "transform"], "left").crossJoin(F.broadcast(attempted)).withColumn("language", F.lit(language))
    counts = ("yielded", "parse_valid_after_transform", "changed_span_present")
    return out.select("language", "stage", "role", "transform", "attempted", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def prepare_tasks(tasks: DataFrame, dataset: str, options: Options | None = None) -> dict[str, DataFrame]:
    """files, units, views and semantic_pairs of tasks.

    tasks has task_id, split, prompt, metadata_json and solutions, an array of structs
    (language, code, solution_id).
    """
    options = options or Options()
    from viewforge.operators import tasks as K

    tasks = materialise(tasks, "tasks").withColumn("prompt", F.coalesce("prompt", F.lit("")))
    file_id = T.stable_hash(dataset, F.col("task_id"), "task")
    base = tasks.select("task_id", F.coalesce("split", F.lit("")).alias("source_split"), "prompt", "metadata_json", file_id.alias("file_id"), T.hash_split(F.concat(F.lit(f"{dataset}:"), F.col("task_id"))).alias("split"))
    listed = tasks.select("task_id", F.posexplode("solutions").alias("solution_index", "s")).select("task_id", "solution_index", "s.language", "s.code", "s.solution_id")
    unique = K.unique_solutions(listed, options.max_solutions)
    named = unique.join(listed.select("task_id", "solution_index", "solution_id"), ["task_id", "solution_index"])
    code = T.closed(F.col("code"))
    rows = named.join(base, "task_id").withColumn("code", code).withColumn("unit_id", T.stable_hash(dataset, F.col("task_id"), F.col("solution_id"), F.col("language"), F.col("code")))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for language, text in zip(pdf["language"], pdf["code"], strict=True):
                p = L.parse(text, language)
                names, called, sequence = [], [], []
                if p.tree is not None:
                    names, called, sequence = pyast.identifiers(p.tree), pyast.calls(p.tree), pyast.sequence(p.tree)
                elif language in L.LANGUAGES:
                    names, called = L.identifiers(text, L.LANGUAGES[language]), L.calls(text, L.LANGUAGES[language])
                found.append((p.parse_ok, p.compile_ok, p.error, json.dumps(names, ensure_ascii=False), json.dumps(called, ensure_ascii=False), " ".join(sequence)))
            if found:
                yield pdf.assign(**dict(zip(("parse_ok", "compile_ok", "error", "identifiers_json", "calls_json", "ast_sequence"), map(list, zip(*found, strict=True)), strict=True)))

    extra = "parse_ok boolean, compile_ok boolean, error string, identifiers_json string, calls_json string, ast_sequence string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + extra
    rows = materialise(rows.mapInPandas(parsed, schema), "task-solutions")
    view_id = T.stable_hash(F.col("unit_id"), "task_semantic_pair", "solution", "accepted_solution", F.col("code"))
    rows = rows.withColumns({"view_id": view_id, "loc": T.line_count(F.col("code"))})
    languages = listed.withColumn("language", K.task_language(F.col("language"))).groupBy("task_id").agg(F.when(F.count_distinct("language") > 1, "multi").otherwise(F.min("language")).alias("language"))
    constant = {"dataset_key": F.lit(dataset), "source_dataset": F.lit(dataset), "repository_name": F.lit(dataset), "path": F.concat("task_id", F.lit(".task"))}
    task_json = F.to_json(F.struct("prompt", "task_id"))
    files = base.join(languages, "task_id").withColumns(
        constant | {"source_row_index": F.lit(-1), "source_available": F.lit(False), "source": F.lit(""), "char_len": F.lit(0), "loc": F.lit(0), "rough_token_len": F.lit(0), "parse_ok": F.lit(True), "compile_ok": F.lit(True), "imports_context": F.lit(""), "top_defs_json": F.lit("[]"), "metadata_json": task_json}
    )
    units = rows.withColumns(
        constant | {"transform_stage": F.lit("task-semantic"), "unit_family": F.lit("task_solution"), "unit_type": F.lit("task_solution"), "qualified_name": F.concat_ws(":", "task_id", "solution_id"), "start_line": F.lit(1), "end_line": F.col("loc"), "imports_context": F.lit(""), "class_context": F.lit(""), "sibling_signatures": F.lit(""), "char_len": F.length("code"), "rough_token_len": T.token_count(F.col("code")), "size_bucket": T.size_bucket(F.col("loc"))}
    )
    views = rows.withColumns(
        constant | {"transform_stage": F.lit("task-semantic"), "family": F.lit("task_semantic_pair"), "role": F.lit("solution"), "transform_name": F.lit("accepted_solution"), "confidence": F.lit("accepted"), "changed_spans_json": F.lit("[]"), "metadata_json": F.to_json(F.struct("solution_id", "task_id"))}
    )
    pairs = K.semantic_pairs(rows.select("task_id", "position", "language", "solution_index"), options.max_pairs)
    for side in ("left", "right"):
        ids = rows.select("task_id", F.col("position").alias(f"{side}_position"), F.col("unit_id").alias(f"{side}_unit_id"), F.col("view_id").alias(f"{side}_view_id"))
        pairs = pairs.join(ids, ["task_id", f"{side}_position"])
    pairs = pairs.join(base.select("task_id", "split", "prompt"), "task_id").withColumns(
        constant | {"pair_id": T.stable_hash(dataset, F.col("task_id"), F.col("left_view_id"), F.col("right_view_id")), "family": F.lit("task_semantic_pair"), "sampling_weight": F.lit(1.0), "metadata_json": F.to_json(F.struct(F.substring("prompt", 1, 1000).alias("prompt"), "task_id"))} | {k: F.lit(v) for k, v in PAIR_LABELS.items()}
    )

    def shaped(df: DataFrame, table: str) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))

    return {"files": shaped(files, "files"), "units": shaped(units, "units"), "views": shaped(views, "views"), "semantic_pairs": shaped(pairs, "semantic_pairs")}
