from __future__ import annotations

import public_tokenizers
import pytest

from viewforge.plans import run, segments
from viewforge.plans.schema import Options
from viewforge.sources import benchmarks, normalise

PYTHON = "def f(a, b):\n    x = 1\n    if a < b and x:\n        return g(a, b)\n    return x\n"
SCRIPT = "function f(a, b) {\n  let x = 1;\n  if (a < b && x) { return g(a, b); }\n  return x;\n}\n"


@pytest.fixture(scope="module")
def sources(spark):
    rows = spark.createDataFrame([(PYTHON.replace("f(", f"f{k}("), "r", f"{k}.py") for k in range(4)], "whole_func_string string, repository_name string, func_path_in_repository string")
    other = spark.createDataFrame([(SCRIPT, "q", "f.js")], rows.schema)
    return normalise.functions(rows, "python").unionByName(normalise.functions(other, "javascript"))


def test_corpus_to_cache(spark, sources, tmp_path):
    root, out = str(tmp_path / "data"), str(tmp_path / "cache")
    done = run.prepare_corpus(spark, sources, root, ("v0", "v1"), ("py", "js"), caps={"python": 3, "": 9}, strict=True)
    assert done["status"] == "complete" and len(done["segments"]) == 4
    assert done["segments"][0]["counts"]["files"] == 3
    again = run.prepare_corpus(spark, sources.limit(0), root, ("v0",), ("all",))
    assert again["segments"] == [] and segments.read_json(spark, f"{root}/codesearchnet/python/transform-v0/core/manifest.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = run.token_cache(spark, root, out, path, (32, 256))
    assert cache["examples"] == sum(s["counts"]["triples"] for s in done["segments"]) and cache["skipped_missing_view"] == 0
    assert set(cache["buckets"]) <= {"32", "256"} and cache["vocabularies"]["positive_transform"]
    assert run.token_cache(spark, root, out, path, (32,)) == cache
    few = run.token_cache(spark, root, str(tmp_path / "few"), path, (64,), languages=("python",), stages=("transform-v0",), per_segment=2)
    assert few["examples"] == 2
    (tmp_path / "half" / "examples").mkdir(parents=True)
    with pytest.raises(FileExistsError):
        run.token_cache(spark, root, str(tmp_path / "half"), path)


def test_names_and_caps():
    assert run.chosen_languages(("Node", "py", "js")) == ["javascript", "python"] and len(run.chosen_languages(("all",))) == 6
    with pytest.raises(ValueError):
        run.chosen_languages(("cobol",))
    caps = {"corpus": 300_000}
    assert run.file_cap(caps, "python", "corpus") == 300_000 and run.file_cap(caps, "python", "other") is None


def test_task_corpus(spark, tmp_path):
    rows = normalise.apps(spark.createDataFrame([("7", "q", '["print(1)", "print(2)"]')], "id string, question string, solutions string"))
    done = run.prepare_task_corpus(rows, str(tmp_path), "apps", Options())
    assert done["counts"]["semantic_pairs"] == 1 and done["transform_matrix"] == []


def test_labelled_splits(spark, tmp_path):
    (tmp_path / "dataset").mkdir()
    for name in benchmarks.FILES.values():
        (tmp_path / "dataset" / name).write_text('{"code": "a", "label": 1}\n{"code": "b", "label": 2}\n')
    found = benchmarks.labelled_splits(spark, str(tmp_path), {"train": 1, "test": 1})
    assert {k: v.count() for k, v in found.items()} == {"train": 2, "validation": 2, "test": 1}
