"""The seven tables of a segment, the edits' inventory, and options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from viewforge.code.pyedits import EDITS, STAGES

LANGUAGES = ("python", "java", "javascript", "go", "php", "ruby")

_TEXT, _WHOLE, _REAL, _TRUTH = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(text: str, whole: str = "", real: str = "", truth: str = "") -> T.StructType:
    kinds = {n: t for names, t in ((whole, _WHOLE), (real, _REAL), (truth, _TRUTH)) for n in names.split()}
    return T.StructType([T.StructField(n, kinds.get(n, _TEXT)) for n in text.split()])


#: Columns in order; those named again are whole numbers, real numbers or truth values.
TABLES = {
    "files": _table(
        "file_id dataset_key source_dataset source_split split source_row_index repository_name path language source_available source char_len loc rough_token_len parse_ok compile_ok imports_context top_defs_json metadata_json",
        "source_row_index char_len loc rough_token_len",
        truth="source_available parse_ok compile_ok",
    ),
    "units": _table(
        "unit_id file_id dataset_key source_dataset source_split split transform_stage language unit_family unit_type qualified_name repository_name path start_line end_line code imports_context class_context sibling_signatures identifiers_json calls_json ast_sequence loc char_len rough_token_len size_bucket parse_ok compile_ok error",
        "start_line end_line loc char_len rough_token_len",
        truth="parse_ok compile_ok",
    ),
    "spans": _table(
        "node_type start_line start_col end_line end_col start_byte end_byte source span_id unit_id span_index file_id split",
        "start_line start_col end_line end_col start_byte end_byte span_index",
    ),
    "views": _table(
        "view_id unit_id file_id dataset_key source_dataset split transform_stage family role transform_name code parse_ok compile_ok confidence changed_spans_json metadata_json",
        truth="parse_ok compile_ok",
    ),
    "triples": _table(
        "triple_id unit_id file_id split transform_stage family anchor_view_id positive_view_id negative_view_id positive_transform negative_transform negative_type positive_strategy_label positive_semantic_label positive_local_label negative_strategy_label negative_semantic_label negative_local_label sampling_weight",
        real="sampling_weight",
    ),
    "relations": _table("relation_id file_id src_id dst_id relation_type metadata_json"),
    "semantic_pairs": _table(
        "pair_id task_id dataset_key split family relation_type left_unit_id right_unit_id left_view_id right_view_id left_language right_language semantic_label strategy_label local_label sampling_weight metadata_json",
        real="sampling_weight",
    ),
}

#: Source files as the normalisers make them; metadata is a JSON object.
SOURCE_FILES = _table("dataset_key source_dataset source_split source_row_index repository_name path language source metadata_json", "source_row_index")


def stage_chain(stage: str) -> tuple[str, ...]:
    """The stages whose views a stage carries."""
    if stage == "extract-only":
        return ()
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    return STAGES[: STAGES.index(stage) + 1]


def inventory(stage: str, only: str = "") -> list[tuple[str, str, str]]:
    """(stage, role, name) of the edits a stage carries, or of one of them."""
    chain = stage_chain(stage)
    return [(e.stage, e.role, e.name) for e in EDITS if e.stage in chain and only in ("", e.name)]


def check_coverage(languages: tuple[str, ...] = LANGUAGES) -> None:
    """Raises where a language lacks an edit of the inventory."""
    from viewforge.code import languages as L
    from viewforge.code import textedits

    have = {(e.stage, e.role, e.name) for e in textedits.EDITS}
    missing = [f"{language}:{':'.join(e)}" for language in languages for e in inventory("v2") if language != "python" and (language not in L.LANGUAGES or e not in have)]
    if missing:
        raise ValueError("edits missing: " + ", ".join(missing))


@dataclass(frozen=True)
class Options:
    """What changes the result of preparing files and tasks."""

    max_units: int = 96
    max_spans: int = 128
    max_positive: int = 16
    max_negative: int = 8
    min_loc: int = 3
    max_loc: int = 250
    window_lines: int = 120
    window_stride: int = 80
    max_windows: int = 8
    local_radius: int = 4
    max_solutions: int = 32
    max_pairs: int = 256
    only: str = ""
    transforms: bool = True
