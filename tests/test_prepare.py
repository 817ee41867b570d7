"""Files and tasks to tables, segments and back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from viewforge.operators import assemble, prepare, tasks, tokens
from viewforge.plans import segments
from viewforge.plans.schema import TABLES, Options
from viewforge.sources import normalise

MODULE = '''
import sys
import os


class Shop(object):
    """A shop."""

    def __init__(self, stock, limit=1):
        self.stock = stock.copy()
        self.limit = limit

    def sell(self, name, count):
        def left(n):
            total = 0
            for k in range(n):
                total += k
            return total

        if name not in self.stock or count < 1:
            return False
        try:
            with open(name) as file:
                return sorted(file, reverse=True)[0]
        except ValueError:
            return left(count) + len(self.stock)
'''


@pytest.fixture(scope="module")
def source_files(spark):
    rows = [(MODULE, "r/a", "a.py", "h1", "false"), (MODULE.replace("Shop", "Store"), "r/b", "b.py", None, None), ("def f(:", "r/c", "c.py", None, None), (MODULE, "r/d", "d.py", None, "True"), ("  \n", "r/e", "e.py", None, None)]
    return normalise.whole_files(spark.createDataFrame(rows, "content string, repo_name string, path string, hash string, autogenerated string"))


@pytest.fixture(scope="module")
def tables(source_files):
    return {name: df.cache() for name, df in prepare.prepare(source_files, "v2", Options(max_loc=80)).items()}


def test_tables(tables):
    assert {n: df.schema.fieldNames() for n, df in tables.items()} == {n: s.fieldNames() for n, s in TABLES.items()}
    assert tables["files"].count() == 2
    assert {r[0] for r in tables["units"].select("unit_family").distinct().collect()} >= {"class", "method", "nested_function", "span_window"}
    assert {r[0] for r in tables["views"].select("family").distinct().collect()} == {"focal_triplet", "context_triplet", "local_span_triplet", "ast_aux"}
    assert tables["views"].filter("family = 'context_triplet' and role = 'anchor' and not startswith(code, '# <')").count() == 0
    for name, key in (("files", "file_id"), ("units", "unit_id"), ("triples", "triple_id"), ("relations", "relation_id"), ("spans", "span_id")):
        assert tables[name].groupBy(key).count().filter("count > 1").count() == 0


def test_triples_resolve(tables):
    triples, views = tables["triples"], tables["views"]
    assert triples.count() > 50
    assert assemble.missing_views(triples, views).count() == 0
    whole = assemble.assemble(triples, views.select("view_id", "code"))
    assert whole.count() == triples.count()
    assert whole.filter("anchor = negative").count() == 0
    assert assemble.labelled_pairs(whole).count() == 2 * triples.count()
    assert assemble.needed_views(triples, views).select("view_id").distinct().count() <= views.count()
    lacking = assemble.assemble(triples, views.filter("role <> 'negative'").select("view_id", "code"))
    assert lacking.count() == 0
    twice = assemble.union_segments(views, views, key="view_id")
    assert twice.count() == views.select("view_id").distinct().count()


def test_splits_and_rejects(tables, source_files):
    assert tables["views"].join(tables["files"], ["file_id", "split"], "left_anti").count() == 0
    reasons = {r.path: r.reason for r in prepare.rejected(source_files).collect()}
    assert reasons.keys() == {"c.py", "d.py"} and reasons["d.py"] == "autogenerated"


def test_one_transform(source_files):
    only = prepare.prepare(source_files, "v0", Options(only="flip_comparison"))["triples"]
    assert only.count() > 0
    assert {r[0] for r in only.filter("family <> 'local_span_triplet'").select("negative_transform").distinct().collect()} == {"flip_comparison"}
    none = prepare.prepare(source_files, "extract-only")
    assert none["views"].count() == 0 and none["units"].count() > 0
    with pytest.raises(ValueError):
        prepare.prepare(source_files, "v7")


def test_too_deep(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    rows = spark.createDataFrame([(deep, "r", "p.py")], "content string, repo_name string, path string")
    assert all(df.count() == 0 for df in prepare.prepare(normalise.whole_files(rows), "v0").values())


def test_segment_round_trip(spark, tables, tmp_path):
    root = str(tmp_path / "out")
    manifest = segments.write_segment(tables, root, "d", "python", "v2", shard_rows=20)
    assert manifest["tokenizer_agnostic"] and manifest["counts"]["triples"] == tables["triples"].count()
    assert len(manifest["transform_matrix"]) == 32
    again = segments.write_segment({n: df.limit(0) for n, df in tables.items()}, root, "d", "python", "v2")
    assert again["counts"] == json.loads(json.dumps(manifest["counts"]))
    assert segments.read_table(spark, root, "units", ("py*",), ("transform-v2",)).count() == tables["units"].count()
    assert segments.read_table(spark, root, "units", ("java",)).count() == 0
    assert [tuple(r) for r in segments.segments(spark, root).collect()] == [("python", "v2", "core")]
    counts = {r.table: r.rows for r in segments.manifest_counts(spark, root).collect()}
    assert counts["views"] == tables["views"].count()
    assert segments.read_json(spark, f"{root}/d/manifest.json")["children"] == ["python/transform-v2/core"]


SOLUTIONS = "task_id string, split string, prompt string, metadata_json string, solutions array<struct<language string, code string, solution_id string>>"


def test_task_pairs(spark):
    rows = [("t", "train", "add", "{}", [("python", "print(1)\n", "0"), ("py", "print(2)", "1"), ("java", "class A { }", "2"), ("python3", " print(1) ", "3")])]
    out = prepare.prepare_tasks(spark.createDataFrame(rows, SOLUTIONS), "apps")
    pairs = out["semantic_pairs"].collect()
    assert len(pairs) == 3 and {p.relation_type for p in pairs} == {"same_task_different_solution", "cross_language_same_task"}
    assert {p.semantic_label for p in pairs} == {"close"} and out["files"].first().language == "multi"
    assert {p.left_view_id for p in pairs} <= {v.view_id for v in out["views"].collect()}
    unit = out["units"].filter("language = 'java'").first()
    assert unit.unit_id == prepare.stable_hash("apps", "t", "2", "java", "class A { }\n") and unit.parse_ok


def test_solution_caps(spark):
    rows = [("t", k, ("a", "b", "c")[k % 3], f"x{k}") for k in range(33)] + [("u", k, "a", f"y{k}") for k in range(24)]
    solutions = tasks.unique_solutions(spark.createDataFrame(rows, "task_id string, solution_index long, language string, code string")).cache()
    first = solutions.filter("task_id = 't'").orderBy("position").collect()
    assert len(first) == 32 and [r.language for r in first[:4]] == ["a", "b", "c", "a"]
    assert tasks.semantic_pairs(solutions).filter("task_id = 'u'").count() == 256


def test_corpora(spark):
    apps = normalise.apps(spark.createDataFrame([("7", "q", '["print(1)", " ", "print(2)"]'), ("8", "q", "no json")], "id string, question string, solutions string"))
    assert [(r.task_id, len(r.solutions)) for r in apps.collect()] == [("7", 2)]
    contest = spark.createDataFrame([("n", "d", ([1, 2, 3, 4], ["a", "b", "c", "d"]))], "name string, description string, solutions struct<language: array<int>, solution: array<string>>")
    assert [s.language for s in normalise.codecontests(contest).first().solutions] == ["python2", "cpp", "python", "java"]
    done = prepare.prepare_tasks(normalise.codecontests(contest), "codecontests")
    ok = {u.language: u.parse_ok for u in done["units"].collect()}
    assert ok["python"] and not ok["python2"]
    assert {p.relation_type for p in done["semantic_pairs"].collect()} == {"cross_language_same_task"}
    human = normalise.humaneval(spark.createDataFrame([("h/1", "def f():\n", "    return 1\n")], "task_id string, prompt string, canonical_solution string"))
    assert human.first().solutions[0].code == "def f():\n    return 1\n"
    assert normalise.mbpp(spark.createDataFrame([(5, "x = 1", "set x")], "task_id int, code string, text string")).first().task_id == "5"
    functions = normalise.functions(spark.createDataFrame([("f()  \n\n", None, "r", "doc")], "func_code_string string, whole_func_string string, repository_name string, func_documentation_string string"), "go")
    row = functions.first()
    assert row.source == "f()\n" and row.path == f"row-{row.source_row_index}.go" and json.loads(row.metadata_json)["documentation"] == "doc"
    assert normalise.chosen_splits(("test", "train")) == ["train", "test"] and normalise.chosen_splits(("all",)) == list(normalise.SPLITS)


def test_pair_files(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("1 2 1\nbad line\n2 9 0\n")
    (tmp_path / "functions.jsonl").write_text('{"idx": 1, "func": "a"}\n{"idx": 2, "func": "b"}\n')
    (tmp_path / "rows.jsonl").write_text('{"code": "a", "label": 1}\n{"code": null, "label": 2}\n')
    pairs = assemble.pair_codes(normalise.pair_file(spark, str(tmp_path / "pairs.txt")), normalise.function_map(spark, str(tmp_path / "functions.jsonl")))
    assert [(r.left_code, r.right_code, r.label) for r in pairs.collect()] == [("a", "b", 1)]
    assert normalise.labelled_rows(spark, str(tmp_path / "rows.jsonl")).count() == 1


def test_buckets(spark):
    with pytest.raises(ValueError):
        tokens.checked_buckets((0, 5), 10)
    need = spark.createDataFrame([(1,), (128,), (129,), (5000,)], "n int").select("n", tokens.bucket_of(F.col("n"), [256, 128]).alias("b"), tokens.batch_for(F.col("n"), {128: 8, 256: 4}).alias("s"))
    assert [(r.b, r.s) for r in need.orderBy("n").collect()] == [(128, 8), (128, 8), (256, 4), (256, 4)]
    row = spark.range(1).select(tokens.clip_and_pad(F.array(*map(F.lit, (1, 2, 3))), 5, 0).alias("p"), tokens.clip_and_pad(F.array(*map(F.lit, (1, 2, 3))), 2, 0).alias("c"), tokens.mode_tokens(F.array(F.lit(7), F.lit(8)), F.lit(4), 8, 0, 2, 1).alias("m")).first()
    assert (row.p, row.c, row.m) == ([1, 2, 3, 0, 0], [1, 2], [0, 4, 2, 7, 8, 2, 1, 1])
    assert tokens.parse_batches("128:8, 256:4") == {128: 8, 256: 4}
