"""Python sources: parsing, spans, units, names."""

from __future__ import annotations

import ast
import textwrap
import warnings
from dataclasses import dataclass, field
from functools import lru_cache

MOST_NAMES, MOST_NODES, MOST_IMPORTS, MOST_SIBLINGS, MOST_SPAN_CHARS = 512, 1024, 128, 64, 240
#: Fixed value: the name of a unit that is a whole source.
WHOLE_SOURCE = "codesearchnet_row"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass(frozen=True)
class Parsed:
    tree: ast.AST | None
    parse_ok: bool
    compile_ok: bool
    error: str = ""


@dataclass
class Unit:
    """A piece of a file that views are made of."""

    family: str
    type: str
    name: str
    code: str
    start_line: int
    end_line: int
    imports_context: str = ""
    class_context: str = ""
    siblings: str = ""
    identifiers: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    sequence: list[str] = field(default_factory=list)


def _error(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


@lru_cache(maxsize=512)
def parse(code: str) -> Parsed:
    """The tree and whether it compiles. Callers must not change the tree."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(code)
        except SyntaxError as e:
            return Parsed(None, False, False, f"SyntaxError: {e}")
        except (ValueError, RecursionError, MemoryError) as e:
            return Parsed(None, False, False, _error(e))
        try:
            compile(tree, "<unit>", "exec")
        except Exception as e:  # a tree can parse and still be no program
            return Parsed(tree, True, False, _error(e))
    return Parsed(tree, True, True)


def line_count(code: str) -> int:
    return sum(1 for line in code.splitlines() if line.strip())


def byte_offset(lines: list[bytes], line: int, column: int) -> int:
    """The UTF-8 offset of a position that ast gives; columns are bytes already."""
    return sum(map(len, lines[: max(0, line - 1)])) + max(0, column)


def span_of(node: ast.AST, code: str, lines: list[bytes] | None = None) -> dict:
    """Where a node stands, and its source; nothing for nodes without a place."""
    if not hasattr(node, "end_col_offset") or not hasattr(node, "lineno"):
        return {}
    lines = lines or [line.encode() for line in code.splitlines(keepends=True)]
    source = ast.get_source_segment(code, node) or ""
    return {
        "node_type": type(node).__name__,
        "start_line": node.lineno,
        "start_col": node.col_offset,
        "end_line": node.end_lineno,
        "end_col": node.end_col_offset,
        "start_byte": byte_offset(lines, node.lineno, node.col_offset),
        "end_byte": byte_offset(lines, node.end_lineno, node.end_col_offset),
        "source": source if len(source) <= MOST_SPAN_CHARS else source[:MOST_SPAN_CHARS] + "...",
    }


def spans(unit_id: str, code: str, most: int) -> list[dict]:
    """The first `most` placed nodes in breadth-first order."""
    tree, found = parse(code).tree, []
    lines = [line.encode() for line in code.splitlines(keepends=True)]
    for index, node in enumerate(ast.walk(tree) if tree else ()):
        if len(found) == most:
            break
        if span := span_of(node, code, lines):
            found.append(span | {"span_id": f"{unit_id}:ast:{index}", "unit_id": unit_id, "span_index": index})
    return found


def unparse(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except Exception:  # trees can be deeper than the stack
        return "..."


def identifiers(tree: ast.AST) -> list[str]:
    names = set()
    for node in ast.walk(tree):
        match node:
            case ast.Name(id=name) | ast.arg(arg=name) | ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                names.add(name)
    return sorted(names)[:MOST_NAMES]


def dotted(node: ast.AST) -> str:
    """The name of what is called: attributes joined by dots as far as names go."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def calls(tree: ast.AST) -> list[str]:
    names = (dotted(node.func) for node in ast.walk(tree) if isinstance(node, ast.Call))
    return list(dict.fromkeys(filter(None, names)))[:MOST_NAMES]


def sequence(tree: ast.AST) -> list[str]:
    return [type(node).__name__ for node in ast.walk(tree)][:MOST_NODES]


def imports_context(tree: ast.AST, source: str) -> str:
    """The leading imports; bare expressions between them are passed over."""
    found = []
    for node in tree.body:
        if isinstance(node, ast.Import | ast.ImportFrom):
            found.append(ast.get_source_segment(source, node))
        elif not isinstance(node, ast.Expr):
            break
    return "\n".join(list(filter(None, found))[:MOST_IMPORTS])


def top_definitions(tree: ast.AST) -> list[dict]:
    return [{"name": n.name, "type": type(n).__name__} for n in tree.body if isinstance(n, (*_DEFS, ast.ClassDef))][:MOST_NAMES]


def _heading(node: ast.ClassDef) -> str:
    bases = ", ".join(map(unparse, node.bases))
    return f"class {node.name}({bases})" if bases else f"class {node.name}"


def signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        return f"{_heading(node)}: ..."
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{word} {node.name}({unparse(node.args)}): ..."


def _names(unit: Unit, tree: ast.AST | None) -> Unit:
    if tree is not None:
        unit.identifiers, unit.calls, unit.sequence = identifiers(tree), calls(tree), sequence(tree)
    return unit


def _class_unit(node: ast.ClassDef, imports: str) -> Unit:
    methods = [signature(child) for child in node.body if isinstance(child, _DEFS)]
    code = "\n".join([f"{_heading(node)}:", "    ...", *(f"    {s}" for s in methods)]) + "\n"
    return _names(Unit("class", "class_summary", node.name, code, node.lineno, node.end_lineno, imports, signature(node), "\n".join(methods)), node)


def _function_units(node: ast.AST, source: str, imports: str, classes: tuple, functions: tuple, room: int, out: list[Unit]) -> None:
    """Functions below node, in order, with the classes and functions around them."""
    for child in node.body if isinstance(node, (*_DEFS, ast.ClassDef)) else ast.iter_child_nodes(node):
        if isinstance(child, ast.ClassDef):
            _function_units(child, source, imports, (*classes, child), functions, room, out)
        elif isinstance(child, _DEFS):
            segment = ast.get_source_segment(source, child)
            if segment and len(out) < room:
                family = "nested_function" if functions else "method" if classes else "function"
                name = ".".join([*(c.name for c in classes), *(f.name for f in functions), child.name])
                code = textwrap.dedent(segment).rstrip() + "\n"
                unit = Unit(family, family, name, code, child.lineno, child.end_lineno, imports)
                if classes:
                    unit.class_context = signature(classes[-1])
                    others = [signature(s) for s in classes[-1].body if isinstance(s, _DEFS) and s.name != child.name]
                    unit.siblings = "\n".join(others[:MOST_SIBLINGS])
                out.append(_names(unit, child))
            _function_units(child, source, imports, classes, (*functions, child), room, out)
        else:
            _function_units(child, source, imports, classes, functions, room, out)


def window_units(source: str, imports: str, window: int, stride: int, most: int, describe) -> list[Unit]:
    """Overlapping windows of a file that has at least `window` lines."""
    lines, out = source.splitlines(), []
    for index, start in enumerate(range(0, len(lines), stride) if len(lines) >= window else ()):
        if len(out) >= most:
            break
        code = "\n".join(lines[start : start + window]).rstrip() + "\n"
        if code.strip():
            out.append(describe(Unit("file_window", "file_window", f"file_window_{index:03d}", code, start + 1, min(len(lines), start + window), imports)))
    return out


def units(source: str, most: int, window: int, stride: int, most_windows: int) -> list[Unit]:
    """Class summaries, functions, or else the whole source, then windows; at most `most`."""
    tree = parse(source).tree
    if tree is None:
        return []
    imports = imports_context(tree, source)
    out = [_class_unit(node, imports) for node in tree.body if isinstance(node, ast.ClassDef)][:most]
    if len(out) == most:
        return out
    functions: list[Unit] = []
    _function_units(tree, source, imports, (), (), most - len(out), functions)
    out += functions
    if not out:
        out.append(_names(Unit("function", "function", WHOLE_SOURCE, source.rstrip() + "\n", 1, line_count(source)), tree))
    return out + window_units(source, imports, window, stride, min(most - len(out), most_windows), lambda unit: _names(unit, parse(unit.code).tree))
