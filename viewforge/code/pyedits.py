"""Edits of Python trees that keep or change behaviour.

One engine walks a copy of the tree and offers nodes to an edit until the first one it
changes. An edit is offered a node after everything below it, or, where it says so,
before, and then nothing below it. Edits are entries of a table; what an edit returns
is the new node and what to note in the changed span.
"""

from __future__ import annotations

import ast
import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from viewforge.code import pyast

STAGES = ("v0", "v1", "v2")
_BODIES = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_LEAVES = (ast.Return, ast.Raise, ast.Break, ast.Continue)


@dataclass
class View:
    """A changed text: its edit's name, role, certainty, changed places and notes."""

    name: str
    role: str
    code: str
    confidence: str
    changed_spans: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edit:
    stage: str
    role: str
    name: str  # canonical
    source_name: str  # as the edit of this language is called
    kind: str  # what the metadata call it
    nodes: tuple  # offered types
    change: Callable  # node -> (new node or nodes, span notes, spanned node) or None
    before: bool = False
    confidence: str = "behavior_impacting"
    staged: bool = False  # whether the metadata name the stage




def _first(tree: ast.AST, edit: Edit, code: str) -> dict | None:
    """Applies edit to its first site in tree; the changed span, or None without a site."""
    noted: list[dict] = []

    def offer(node: ast.AST):
        result = None if noted else edit.change(node)
        if result is None:
            return node
        new, notes, place = result
        noted.append(pyast.span_of(place, code) | notes)
        return new

    def walk(node: ast.AST):
        wanted = isinstance(node, edit.nodes)
        if not (wanted and edit.before) and not noted:
            for name, value in ast.iter_fields(node):
                if isinstance(value, list):
                    kept = []
                    for item in value:
                        new = walk(item) if isinstance(item, ast.AST) else item
                        kept.extend(new if isinstance(new, list) else [new])
                    value[:] = kept
                elif isinstance(value, ast.AST):
                    setattr(node, name, walk(value))
        return offer(node) if wanted else node

    # spans come from the places of the original, so the copy keeps them
    walk(tree)
    return noted[0] if noted else None


# --- helpers over names and purity


def _loads(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}


def _stores(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}


def _pure(node: ast.AST) -> bool:
    return not any(isinstance(n, ast.Call | ast.Await | ast.Yield | ast.YieldFrom | ast.NamedExpr | ast.Lambda) for n in ast.walk(node))


def _local_assignment(node: ast.stmt) -> bool:
    match node:
        case ast.Assign(targets=[ast.Name()], value=value):
            return _pure(value)
        case ast.AnnAssign(target=ast.Name(), value=ast.AST() as value):
            return _pure(value)
    return False


def _independent(a: ast.stmt, b: ast.stmt) -> bool:
    return not (_stores(a) & (_stores(b) | _loads(b)) or _stores(b) & _loads(a))


def _truth(node: ast.AST | None) -> bool | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, bool) else None


def _not(node: ast.expr) -> ast.expr:
    return ast.UnaryOp(ast.Not(), node)


def _whole(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, int) and not isinstance(node.value, bool)


def _tail(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


# --- changes of single nodes


def _operator_swap(kind: str, table: dict):
    """The first operator of a comparison that the table has."""

    def change(node: ast.Compare):
        for k, op in enumerate(node.ops):
            if type(op) in table:
                new = table[type(op)]
                node.ops[k] = new()
                return node, {"kind": kind, "original": type(op).__name__, "replacement": new.__name__}, node
        return None

    return change


def _both_ways(*pairs: tuple[type, type]) -> dict:
    return {a: b for x, y in pairs for a, b in ((x, y), (y, x))}


def _other_boolean(node: ast.BoolOp):
    old, new = (ast.And, ast.Or) if isinstance(node.op, ast.And) else (ast.Or, ast.And)
    node.op = new()
    return node, {"kind": "boolean_operator", "original": old.__name__, "replacement": new.__name__}, node


def _first_arguments_swapped(node: ast.Call):
    if len(node.args) < 2:
        return None
    node.args[:2] = node.args[1::-1]
    return node, {"kind": "call_arg_swap", "swapped_arg_indices": [0, 1]}, node


def _small_integer(node: ast.Constant):
    if not _whole(node) or node.value not in (0, 1, -1):
        return None
    old, node.value = node.value, 0 if node.value == 1 else 1
    return node, {"kind": "small_integer", "original": old, "replacement": node.value}, node


def _negated_test(node: ast.If | ast.While):
    kind = type(node.test).__name__
    node.test = node.test.operand if isinstance(node.test, ast.UnaryOp) and isinstance(node.test.op, ast.Not) else _not(node.test)
    return node, {"kind": "condition_negation", "original": kind}, node


_ARITHMETIC = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.FloorDiv, ast.FloorDiv: ast.Mult, ast.Mod: ast.Mult}


def _other_arithmetic(node: ast.BinOp):
    old, new = type(node.op), _ARITHMETIC.get(type(node.op))
    if new is None:
        return None
    node.op = new()
    return node, {"kind": "arithmetic_operator", "original": old.__name__, "replacement": new.__name__}, node


def _other_index(node: ast.Subscript):
    if not _whole(node.slice) or node.slice.value not in (0, 1, -1):
        return None
    old, node.slice.value = node.slice.value, 0 if node.slice.value == 1 else 1
    return node, {"kind": "subscript_index", "original": old, "replacement": node.slice.value}, node


def _other_default(node: ast.FunctionDef):
    for default in [*node.args.defaults, *node.args.kw_defaults]:
        if not isinstance(default, ast.Constant):
            continue
        match default.value:
            case bool(old):
                new = not old
            case None:
                new = 0
            case int(old):
                new = 0 if old == 1 else 1 if old in (0, -1) else old + 1
            case str(old):
                new = old + "_wrong"
            case _:
                continue
        old, default.value = default.value, new
        return node, {"kind": "default_value", "original": old, "replacement": new}, node
    return None


def _other_sort_order(node: ast.Call):
    if _tail(node.func) not in ("sorted", "sort"):
        return None
    for word in node.keywords:
        if word.arg == "reverse" and _truth(word.value) is not None:
            old = word.value.value
            word.value.value = not old
            return node, {"kind": "sort_reverse", "original": old, "replacement": not old}, node
    node.keywords.append(ast.keyword("reverse", ast.Constant(True)))
    return node, {"kind": "sort_reverse", "original": None, "replacement": True}, node


def _returned_none(node: ast.Return):
    if node.value is None:
        return None
    kind, node.value = type(node.value).__name__, ast.Constant(None)
    return node, {"kind": "return_value", "original": kind, "replacement": "None"}, node


def _without_await(node: ast.Await):
    return node.value, {"kind": "await_removed"}, node


def _longer_range(node: ast.Call):
    if not (isinstance(node.func, ast.Name) and node.func.id == "range" and node.args):
        return None
    at = min(1, len(node.args) - 1)
    stop = node.args[at]
    node.args[at] = ast.Constant(stop.value + 1) if _whole(stop) else ast.BinOp(stop, ast.Add(), ast.Constant(1))
    return node, {"kind": "loop_bound", "argument_index": at, "replacement": "+1"}, node


def _without_guard(node: ast.If):
    if not any(isinstance(s, _LEAVES) for s in node.body):
        return None
    size, node.body = len(node.body), [ast.Pass()]
    return node, {"kind": "guard_branch_removed", "original_body_len": size}, node


#: Which exception stands in for which; others become TypeError.
_EXCEPTIONS = {
    "Exception": "ValueError",
    "ValueError": "TypeError",
    "TypeError": "ValueError",
    "KeyError": "IndexError",
    "IndexError": "KeyError",
    "FileNotFoundError": "PermissionError",
    "PermissionError": "FileNotFoundError",
}


def _other_exception(node: ast.ExceptHandler):
    old = _tail(node.type) if node.type else None
    if old is None:
        return None
    new = _EXCEPTIONS.get(old, "TypeError")
    node.type = ast.Name(new, ast.Load())
    return node, {"kind": "exception_type", "original": old, "replacement": new}, node


def _without_keyword(node: ast.Call):
    named = [k for k in node.keywords if k.arg is not None]
    if not named:
        return None
    node.keywords.remove(named[0])
    return node, {"kind": "keyword_argument_dropped", "removed": named[0].arg}, node


def _alias_for_copy(node: ast.Call):
    method = node.func.attr if isinstance(node.func, ast.Attribute) else None
    if method == "copy" and not node.args and not node.keywords:
        new = node.func.value
    elif method in ("copy", "deepcopy") and node.args and _tail(node.func.value) in ("copy", "deepcopy"):
        new = node.args[0]
    else:
        return None
    return new, {"kind": "copy_to_alias", "method": method}, node


def _without_resource(node: ast.With | ast.AsyncWith):
    notes = {"kind": "context_manager_dropped", "items": len(node.items)}
    return node.body, notes | ({"async": True} if isinstance(node, ast.AsyncWith) else {}), node


def _range_as_while(node: ast.For):
    match node:
        case ast.For(target=ast.Name(id=name), iter=ast.Call(func=ast.Name(id="range"), args=[*bounds], keywords=[]), orelse=[]) if len(bounds) in (1, 2):
            start, stop = (ast.Constant(0), bounds[0]) if len(bounds) == 1 else bounds
        case _:
            return None
    written = set().union(*map(_stores, node.body))
    if name in written or any(isinstance(n, ast.Continue) for s in node.body for n in ast.walk(s)):
        return None
    if not all(isinstance(b, ast.Constant | ast.Name) and name not in _loads(b) for b in (start, stop)):
        return None
    if isinstance(stop, ast.Name) and stop.id in written:
        return None
    test = ast.Compare(ast.Name(name, ast.Load()), [ast.Lt()], [stop])
    step = ast.AugAssign(ast.Name(name, ast.Store()), ast.Add(), ast.Constant(1))
    return [ast.Assign([ast.Name(name, ast.Store())], start), ast.While(test, [*node.body, step], [])], {"kind": "for_range_to_while"}, node


def _negation_inside(node: ast.UnaryOp):
    if not (isinstance(node.op, ast.Not) and isinstance(node.operand, ast.BoolOp)):
        return None
    op = ast.Or() if isinstance(node.operand.op, ast.And) else ast.And()
    return ast.BoolOp(op, [_not(v) for v in node.operand.values]), {"kind": "demorgan_boolean_rewrite"}, node


def _sorted_imports(node: ast.Module):
    n = next((k for k, s in enumerate(node.body) if not isinstance(s, ast.Import | ast.ImportFrom)), len(node.body))
    block = node.body[:n]
    if n < 2 or any(isinstance(s, ast.ImportFrom) and s.module == "__future__" for s in block):
        return None
    ordered = sorted(block, key=ast.unparse)
    if list(map(ast.unparse, ordered)) == list(map(ast.unparse, block)):
        return None
    node.body[:n] = ordered
    return node, {"kind": "safe_import_sort_same_block", "imports": n}, block[0]


# --- changes of runs of statements in the body of a module, class or function


def _in_body(width: int, kind: str, change: Callable):
    """Offers each run of `width` statements (shorter at the end for width 0) to change.

    change gets the statements from k on and returns the new ones, how many they
    replace, the spanned statement and further notes.
    """

    def edit(node: ast.AST):
        body = node.body
        for k in range(len(body) - max(0, width - 1)):
            result = change(body[k:] if not width else body[k : k + width])
            if result is not None:
                new, taken, place, notes = result
                body[k : k + taken] = new
                return node, {"kind": kind} | notes, place
        return None

    return edit


def _swapped(allowed: Callable):
    return lambda run: ([run[1], run[0]], 2, run[0], {}) if allowed(*run) and _independent(*run) else None


def _assignments(a: ast.stmt, b: ast.stmt) -> bool:
    return _local_assignment(a) and _local_assignment(b)


def _movable(a: ast.stmt, b: ast.stmt) -> bool:
    return all(_local_assignment(s) or isinstance(s, ast.Expr) and _pure(s.value) for s in (a, b))


def _two_returns(run: list[ast.stmt]):
    """if-statement with one return, what it returns, what is returned otherwise, statements it takes."""
    match run:
        case [ast.If(body=[ast.Return(value=yes)], orelse=[ast.Return(value=no)]), *_]:
            return yes, no, 1
        case [ast.If(body=[ast.Return(value=yes)], orelse=[]), ast.Return(value=no), *_]:
            return yes, no, 2
    return None


def _boolean_return(run: list[ast.stmt]):
    found = _two_returns(run)
    if found is None:
        return None
    yes, no, taken = found
    match _truth(yes), _truth(no):
        case True, False:
            value = _not(_not(run[0].test))
        case False, True:
            value = _not(run[0].test)
        case _:
            return None
    return [ast.Return(value)], taken, run[0], {}


def _conditional_return(run: list[ast.stmt]):
    found = _two_returns(run)
    if found is None or found[0] is None or found[1] is None:
        return None
    return [ast.Return(ast.IfExp(run[0].test, found[0], found[1]))], found[2], run[0], {}


def _hoisted_else(run: list[ast.stmt]):
    node = run[0]
    if not (isinstance(node, ast.If) and node.orelse and isinstance(node.body[-1], _LEAVES)):
        return None
    moved, node.orelse = node.orelse, []
    return [node, *moved], 1, node, {}


def _append_loop(run: list[ast.stmt]):
    match run:
        case [
            ast.Assign(targets=[ast.Name(id=name)], value=ast.List(elts=[])),
            ast.For(orelse=[], body=[ast.Expr(ast.Call(func=ast.Attribute(value=ast.Name(id=owner), attr="append"), args=[item], keywords=[]))]) as loop,
            ast.Return(ast.Name(id=given)),
        ] if name == owner == given and name not in _loads(item):
            made = ast.ListComp(item, [ast.comprehension(loop.target, loop.iter, [], 0)])
            return [ast.Return(made)], 3, loop, {"accumulator": name}
    return None


def _sum_loop(run: list[ast.stmt]):
    match run:
        case [
            ast.Assign(targets=[ast.Name(id=name)], value=ast.Constant(value=start)),
            ast.For(target=ast.Name(id=each), orelse=[], body=[ast.AugAssign(target=ast.Name(id=total), op=ast.Add(), value=ast.Name(id=added))]) as loop,
            ast.Return(ast.Name(id=given)),
        ] if name == total == given and each == added and start == 0:
            return [ast.Return(ast.Call(ast.Name("sum", ast.Load()), [loop.iter], []))], 3, loop, {"accumulator": name}
    return None


# --- edits of the whole tree


def _normalised(tree: ast.AST, code: str) -> tuple[ast.AST, list[dict], dict] | None:
    return tree, [], {"positive_type": "format_comment_normalization"}


def _without_docstrings(tree: ast.AST, code: str):
    found = False
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef(body=body) | ast.AsyncFunctionDef(body=body) | ast.ClassDef(body=body):
                match body:
                    case [ast.Expr(ast.Constant(value=str())), *rest]:
                        node.body, found = rest or [ast.Pass()], True
    return (tree, [], {"positive_type": "docstring_removed"}) if found else None


class _Scope(ast.NodeVisitor):
    """Names that assignments and arguments bind, without those declared elsewhere."""

    def __init__(self, tree: ast.AST):
        self.bound: set[str] = set()
        self.declared: set[str] = set()
        self.visit(tree)

    def visit_arg(self, node: ast.arg) -> None:
        # annotations aren't looked into
        if node.arg not in ("self", "cls"):
            self.bound.add(node.arg)

    def generic_visit(self, node: ast.AST) -> None:
        match node:
            case ast.Global(names=names) | ast.Nonlocal(names=names):
                self.declared.update(names)
            case ast.Name(id=name, ctx=ast.Store()):
                self.bound.add(name)
        super().generic_visit(node)


#: How many locals get new names (a fixed value), and what these begin with.
MOST_RENAMED, NEW_NAME = 8, "renamed_"


class _Renamed(ast.NodeTransformer):
    """Puts new names in; the annotations of arguments stay."""

    def __init__(self, names: dict[str, str]):
        self.names = names

    def visit_arg(self, node: ast.arg) -> ast.AST:
        node.arg = self.names.get(node.arg, node.arg)
        return node

    def visit_Name(self, node: ast.Name) -> ast.AST:
        node.id = self.names.get(node.id, node.id)
        return node


def _renamed_locals(tree: ast.AST, code: str):
    """The first locals by name, dunders aside, are numbered."""
    scope = _Scope(tree)
    own = scope.bound.difference(scope.declared, {n for n in scope.bound if n[:2] == n[-2:] == "__"})
    mapping = {name: f"{NEW_NAME}{k}" for k, name in zip(range(MOST_RENAMED), sorted(own), strict=False)}
    if mapping:
        _Renamed(mapping).visit(tree)
    return (tree, [], {"mapping": mapping, "positive_type": "local_rename"}) if mapping else None


def _loads_in_order(node: ast.AST) -> list[ast.Name]:
    found = [node] if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) else []
    for child in ast.iter_child_nodes(node):
        found += _loads_in_order(child)
    return found


def _wrong_variable(tree: ast.AST, code: str):
    used = _loads_in_order(tree)
    names = [n for n in dict.fromkeys(n.id for n in used) if n not in ("self", "cls", "True", "False", "None")]
    if len(names) < 2:
        return None
    old, new = names[:2]
    site = next(n for n in used if n.id == old)
    site.id = new
    span = pyast.span_of(site, code) | {"kind": "wrong_variable", "original": old, "replacement": new}
    return tree, [span], {"negative_type": "wrong_variable", "mapping": {old: new}}


_COMPARISONS = _both_ways((ast.Lt, ast.LtE), (ast.Gt, ast.GtE), (ast.Eq, ast.NotEq))
_MEMBERSHIPS = _both_ways((ast.In, ast.NotIn), (ast.Is, ast.IsNot))


def _negative(stage: str, name: str, kind: str, nodes, change, source_name: str = "", before: bool = False) -> Edit:
    return Edit(stage, "negative", name, source_name or name, kind, nodes if isinstance(nodes, tuple) else (nodes,), change, before)


def _positive(stage: str, name: str, kind: str, nodes, change, source_name: str = "", confidence: str = "likely") -> Edit:
    return Edit(stage, "positive", name, source_name or name, kind, nodes if isinstance(nodes, tuple) else (nodes,), change, False, confidence, stage != "v0")


#: All edits in the order in which they are tried.
EDITS = [
    _positive("v0", "surface_normalize", "", (), _normalised, "ast_normalize", "safe"),
    _positive("v0", "remove_comments_or_docstrings", "", (), _without_docstrings, "remove_docstrings"),
    _positive("v0", "rename_locals", "", (), _renamed_locals),
    _negative("v0", "flip_comparison", "comparison_operator", ast.Compare, _operator_swap("comparison_operator", _COMPARISONS), before=True),
    _negative("v0", "flip_boolop", "boolean_operator", ast.BoolOp, _other_boolean),
    _negative("v0", "swap_call_args", "swapped_args", ast.Call, _first_arguments_swapped),
    _negative("v0", "wrong_variable", "wrong_variable", (), _wrong_variable),
    _negative("v0", "flip_small_integer", "small_integer", ast.Constant, _small_integer),
    _positive("v1", "swap_independent_assignments", "independent_statement_reorder", _BODIES, _in_body(2, "independent_assignment_reorder", _swapped(_assignments))),
    _positive("v1", "bool_return_simplify", "control_flow_simplification", _BODIES, _in_body(0, "bool_return_simplify", _boolean_return), confidence="safe"),
    _positive("v1", "if_return_merge", "control_flow_simplification", _BODIES, _in_body(0, "if_return_to_conditional_expr", _conditional_return), "if_return_to_conditional_expr", "safe"),
    _positive("v1", "remove_unreachable_else", "control_flow_simplification", _BODIES, _in_body(1, "unreachable_else_removed", _hoisted_else), confidence="safe"),
    _positive("v1", "import_sort_same_block", "import_block_sort", ast.Module, _sorted_imports, "safe_import_sort_same_block"),
    _negative("v1", "flip_membership_or_identity", "membership_or_identity", ast.Compare, _operator_swap("membership_or_identity", _MEMBERSHIPS), before=True),
    _negative("v1", "negate_condition", "condition_negation", (ast.If, ast.While), _negated_test),
    _negative("v1", "flip_arithmetic_operator", "arithmetic_operator", ast.BinOp, _other_arithmetic),
    _negative("v1", "flip_subscript_index", "subscript_index", ast.Subscript, _other_index),
    _negative("v1", "flip_default_value", "default_value", (ast.FunctionDef, ast.AsyncFunctionDef), _other_default),
    _negative("v1", "flip_sort_reverse", "sort_reverse", ast.Call, _other_sort_order),
    _negative("v1", "remove_return_value", "return_value_removed", ast.Return, _returned_none),
    _negative("v1", "remove_async_or_concurrency_wait", "await_removed", ast.Await, _without_await, "drop_await"),
    _positive("v2", "range_loop_to_while_or_equivalent", "loop_refactor", ast.For, _range_as_while, "for_range_to_while"),
    _positive("v2", "append_loop_to_collection_literal", "loop_to_comprehension", _BODIES, _in_body(3, "list_append_loop_to_comprehension", _append_loop), "list_append_loop_to_comprehension"),
    _positive("v2", "accumulator_loop_to_builtin", "loop_to_builtin", _BODIES, _in_body(3, "accumulator_loop_to_sum", _sum_loop), "accumulator_loop_to_sum"),
    _positive("v2", "demorgan_rewrite", "boolean_refactor", ast.UnaryOp, _negation_inside, "demorgan_boolean_rewrite", "safe"),
    _positive("v2", "swap_independent_statement_block", "independent_statement_reorder", _BODIES, _in_body(2, "independent_statement_block_reorder", _swapped(_movable))),
    _negative("v2", "shift_loop_bound", "loop_bound_off_by_one", ast.Call, _longer_range, "shift_range_bound"),
    _negative("v2", "remove_guard_branch", "missing_edge_case_branch", ast.If, _without_guard),
    _negative("v2", "flip_exception_type", "wrong_exception_handling", ast.ExceptHandler, _other_exception),
    _negative("v2", "drop_keyword_argument", "wrong_api_call", ast.Call, _without_keyword),
    _negative("v2", "copy_to_alias_mutation", "mutate_copy_vs_original", ast.Call, _alias_for_copy, "replace_copy_with_alias"),
    _negative("v2", "drop_resource_context", "missing_resource_handling", (ast.With, ast.AsyncWith), _without_resource, "drop_context_manager"),
]


def _apply(edit: Edit, code: str) -> View | None:
    tree = copy.deepcopy(pyast.parse(code).tree)
    if edit.nodes:
        span = _first(tree, edit, code)
        if span is None:
            return None
        found, metadata = [span], {f"{edit.role}_type": edit.kind} | ({"stage": edit.stage} if edit.staged else {})
    else:
        result = edit.change(tree, code)
        if result is None:
            return None
        tree, found, metadata = result
    written = ast.unparse(ast.fix_missing_locations(tree)).rstrip() + "\n"
    metadata = metadata | {"source_transform_name": edit.source_name, "stage_family_name": edit.name, "language": "python"}
    return View(edit.name, edit.role, written, edit.confidence, found, metadata)


def views(code: str, stage: str, role: str, most: int) -> list[View]:
    """Views of code by the edits of one stage and role: each new, compiling, in order, at most `most`."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    out: list[View] = []
    seen = {code.strip()}
    if pyast.parse(code).tree is None:
        return out
    for edit in EDITS:
        if len(out) >= most:
            break
        if (edit.stage, edit.role) != (stage, role):
            continue
        try:
            view = _apply(edit, code)
        except (RecursionError, MemoryError):
            continue
        if view is not None and view.code.strip() not in seen and pyast.parse(view.code).compile_ok:
            seen.add(view.code.strip())
            out.append(view)
    return out
