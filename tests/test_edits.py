"""Goldens of the edits, written by hand."""

from __future__ import annotations

import pytest

from viewforge.code import languages as L
from viewforge.code import pyast, pyedits, textedits
from viewforge.plans.schema import check_coverage, inventory


def python(code: str, name: str) -> str | None:
    edit = next(e for e in pyedits.EDITS if e.name == name)
    found = {v.name: v.code for v in pyedits.views(code, edit.stage, edit.role, 64)}
    return found.get(name)


PYTHON = [
    ("surface_normalize", "x  =  1 # c\n", "x = 1\n"),
    ("remove_comments_or_docstrings", 'def f():\n    """d"""\n', "def f():\n    pass\n"),
    ("rename_locals", "def f(b, self):\n    a = b\n    return a\n", "def f(renamed_1, self):\n    renamed_0 = renamed_1\n    return renamed_0\n"),
    ("flip_comparison", "a < b <= c\n", "a <= b <= c\n"),
    ("flip_boolop", "a and (b or c)\n", "a and (b and c)\n"),
    ("swap_call_args", "f(g(1, 2), 3)\n", "f(g(2, 1), 3)\n"),
    ("wrong_variable", "x = a + b\n", "x = b + b\n"),
    ("flip_small_integer", "x = 5 + 1\n", "x = 5 + 0\n"),
    ("swap_independent_assignments", "a = 1\nb = 2\n", "b = 2\na = 1\n"),
    ("swap_independent_assignments", "a = 1\nb = a\n", None),
    ("bool_return_simplify", "def f(x):\n    if x:\n        return False\n    return True\n", "def f(x):\n    return not x\n"),
    ("if_return_merge", "def f(x):\n    if x:\n        return 1\n    else:\n        return 2\n", "def f(x):\n    return 1 if x else 2\n"),
    ("remove_unreachable_else", "def f(x):\n    if x:\n        return 1\n    else:\n        y = 2\n    return y\n", "def f(x):\n    if x:\n        return 1\n    y = 2\n    return y\n"),
    ("import_sort_same_block", "import b\nimport a\n", "import a\nimport b\n"),
    ("import_sort_same_block", "from __future__ import annotations\nimport a\n", None),
    ("flip_membership_or_identity", "a not in b\n", "a in b\n"),
    ("negate_condition", "if not a:\n    b\n", "if a:\n    b\n"),
    ("flip_arithmetic_operator", "a + b * c\n", "a + b // c\n"),
    ("flip_subscript_index", "a[1]\n", "a[0]\n"),
    ("flip_default_value", "def f(a='x'):\n    pass\n", "def f(a='x_wrong'):\n    pass\n"),
    ("flip_sort_reverse", "sorted(a)\n", "sorted(a, reverse=True)\n"),
    ("remove_return_value", "def f():\n    return 1\n", "def f():\n    return None\n"),
    ("remove_async_or_concurrency_wait", "async def f():\n    await g()\n", "async def f():\n    g()\n"),
    ("range_loop_to_while_or_equivalent", "for i in range(3):\n    f(i)\n", "i = 0\nwhile i < 3:\n    f(i)\n    i += 1\n"),
    ("range_loop_to_while_or_equivalent", "for i in range(3):\n    continue\n", None),
    ("append_loop_to_collection_literal", "def f(a):\n    o = []\n    for x in a:\n        o.append(x)\n    return o\n", "def f(a):\n    return [x for x in a]\n"),
    ("accumulator_loop_to_builtin", "def f(a):\n    t = 0\n    for x in a:\n        t += x\n    return t\n", "def f(a):\n    return sum(a)\n"),
    ("demorgan_rewrite", "not (a and b)\n", "not a or not b\n"),
    ("swap_independent_statement_block", "a = 1\nb\n", "b\na = 1\n"),
    ("shift_loop_bound", "range(1, n)\n", "range(1, n + 1)\n"),
    ("remove_guard_branch", "def f(x):\n    if x:\n        return 1\n", "def f(x):\n    if x:\n        pass\n"),
    ("flip_exception_type", "try:\n    a\nexcept KeyError:\n    b\n", "try:\n    a\nexcept IndexError:\n    b\n"),
    ("drop_keyword_argument", "f(1, a=2, b=3)\n", "f(1, b=3)\n"),
    ("copy_to_alias_mutation", "a = copy.deepcopy(b)\n", "a = b\n"),
    ("drop_resource_context", "with open(a) as f:\n    g(f)\n", "g(f)\n"),
]


@pytest.mark.parametrize("name,code,want", PYTHON)
def test_python_edit(name, code, want):
    assert python(code, name) == want


TEXT = [
    ("java", "surface_normalize", "a;  \n\n\n\nb;\n", "a;\n\nb;\n"),
    ("java", "remove_comments_or_docstrings", "a; // x\n/* y\n */b;\n", "a; \n\nb;\n"),
    ("java", "rename_locals", "foo(bar, bar);\n", "foo(renamed_bar, renamed_bar);\n"),
    ("java", "flip_comparison", "a < b == c\n", "a < b != c\n"),
    ("java", "flip_boolop", "a && b\n", "a || b\n"),
    ("java", "swap_call_args", "f(a, b);\n", "f(b, a);\n"),
    ("go", "wrong_variable", "bb := aa + aa\n", "bb := aa + bb\n"),
    ("java", "flip_small_integer", "x = 100 + 7;\n", "x = 100 + 6;\n"),
    ("java", "swap_independent_assignments", "int a = 1;\nint b = 2;\n", "int b = 2;\nint a = 1;\n"),
    ("javascript", "bool_return_simplify", "if (a) { return false; } else { return true; }\n", "return !(a);\n"),
    ("go", "if_return_merge", "if a { return 1 } else { return 2 }\n", "if !(a) { return 2 }\nreturn 1\n"),
    ("ruby", "if_return_merge", "if a\n  return 1\nelse\n  return 2\nend\n", "return a ? 1 : 2\n"),
    ("java", "import_sort_same_block", "import b;\n\nimport a;\nx;\n", "import a;\nimport b;\nx;\n"),
    ("javascript", "flip_membership_or_identity", "a === b\n", "a !== b\n"),
    ("ruby", "negate_condition", "if a\n", "unless a\n"),
    ("java", "flip_arithmetic_operator", '"+" + a;\n', '"+" - a;\n'),
    ("java", "flip_subscript_index", "a[i]\n", "a[i + 1]\n"),
    ("php", "flip_default_value", "f($a, b = true)\n", "f($a, b = false)\n"),
    ("ruby", "flip_sort_reverse", "a.sort()\n", "a.sort().reverse()\n"),
    ("go", "remove_return_value", "return x\n", "return;\n"),
    ("javascript", "remove_async_or_concurrency_wait", "await f();\n", "f();\n"),
    ("java", "range_loop_to_while_or_equivalent", "for (int i = 0; i < n; i++) { f(i); }\n", "int i = 0;\nwhile (i < n) { f(i);\ni++;\n}\n"),
    ("javascript", "append_loop_to_collection_literal", "let o = []; for (const v of x) { o.push(v + 1); }\n", "const o = x.map((v) => v + 1);\n"),
    ("ruby", "accumulator_loop_to_builtin", "t = 0\nxs.each do |x|\n  t += x\nend\n", "t = xs.sum { |x| x }\n"),
    ("java", "demorgan_rewrite", "!(a && b)\n", "!(a) || !(b)\n"),
    ("go", "swap_independent_statement_block", "a()\nb()\n", "b()\na()\n"),
    ("java", "shift_loop_bound", "i < 10\n", "i <= 10\n"),
    ("java", "remove_guard_branch", "if (a) { return; }\nb();\n", "b();\n"),
    ("java", "flip_exception_type", "catch (IOException e)\n", "catch (Exception e)\n"),
    ("javascript", "drop_keyword_argument", "f(a, b: 1)\n", "f(a)\n"),
    ("ruby", "copy_to_alias_mutation", "a = b.dup\n", "a = b\n"),
    ("java", "drop_resource_context", "try (X x = y) { }\n", "try { }\n"),
]


@pytest.mark.parametrize("language,name,code,want", TEXT)
def test_text_edit(language, name, code, want):
    edit = next(e for e in textedits.EDITS if e.name == name)
    found = {v.name: v.code for v in textedits.views(code, language, edit.stage, edit.role, 64)}
    assert found.get(name) == want


def test_inventories_agree():
    check_coverage()
    assert [(e.stage, e.role, e.name) for e in textedits.EDITS] == inventory("v2")
    assert len(inventory("v2")) == 32 and len(inventory("v0")) == 8
    with pytest.raises(ValueError):
        inventory("v9")


def test_stages_differ():
    code = "def f(a, b):\n    x = 1\n    y = 2\n    if a < b and x:\n        return True\n    return False\n"
    names = [{v.name for s in pyedits.STAGES[k : k + 1] for v in pyedits.views(code, s, "positive", 64)} for k in range(3)]
    assert "rename_locals" in names[0] and not names[0] & (names[1] | names[2])
    for stage in pyedits.STAGES:
        for view in pyedits.views(code, stage, "negative", 64):
            assert view.role == "negative" and view.confidence == "behavior_impacting" and pyast.parse(view.code).compile_ok
            assert view.changed_spans and {"start_byte", "end_byte"} <= view.changed_spans[0].keys()


def test_masks_and_balance():
    java = L.LANGUAGES["java"]
    text = 'a = "x // y"; // c\n/* 1\n2 */ b("é");\n'
    assert L.without_comments("a /* 1\n2 */ b // c\n", java) == "a \n b \n"
    assert len(L.blanked('f("abc");\n', java)) == len('f("abc");\n')
    assert L.balanced("f('(', [a])") and not L.balanced("f(]") and not L.balanced("(")
    assert L.balanced("'" + "\\'" * 60_000 + "'")
    assert [s["start_byte"] for s in L.token_spans("u", "é b\nc", 9)] == [3, 5]
    assert text


def test_units_windows():
    source = "".join(f"x{k} = {k}\n" for k in range(121))
    windows = [u for u in pyast.units(source, 96, 120, 80, 8) if u.family == "file_window"]
    assert [(u.start_line, u.end_line) for u in windows] == [(1, 120), (81, 121)]
    assert not [u for u in pyast.units("\n".join(source.split("\n")[:119]), 96, 120, 80, 8) if u.family == "file_window"]
    long = "".join(f"x{k} = {k}\n" for k in range(900))
    assert len([u for u in pyast.units(long, 96, 120, 80, 8) if u.family == "file_window"]) == 8
