"""What the text-level edits need to know of each language, and text without strings and comments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from viewforge.code import pyast

#: Tokens of names, calls and string literals.
NAME = re.compile(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b")
CALL = re.compile(r"\b([A-Za-z_$][A-Za-z0-9_$.]*)\s*\(")
BRACKET = re.compile(r"[()\[\]{}]")
STRING = re.compile(r"('(?:\\.|[^'\\])*+'|\"(?:\\.|[^\"\\])*+\")", re.S)

#: Words that are no identifiers, in all languages and in each.
KEYWORDS = frozenset(
    "abstract and as async await break case catch class const continue def defer do else elsif end enum except false finally for func function if import in interface let new nil none not null or package private protected public raise rescue return static struct switch this throw throws true try use using var void while with yield".split()
)


@dataclass(frozen=True)
class Language:
    name: str
    imports: tuple[str, ...]
    words: frozenset[str]
    statement_end: str = ";"
    ternary: bool = True
    comment: str = "//"
    block: tuple[str, str] = ("/*", "*/")

    def keyword(self, name: str) -> bool:
        return name.lower() in KEYWORDS or name in self.words


def _language(name: str, imports: tuple[str, ...], words: str, **other) -> Language:
    return Language(name, imports, KEYWORDS | frozenset(words.split()), **other)


#: Beginnings of import lines, further keywords, statement ends, comments.
LANGUAGES = {
    language.name: language
    for language in (
        _language("java", ("import ", "package "), "assert boolean byte char double extends final float implements int long native short strictfp super synchronized throws transient volatile"),
        _language("javascript", ("import ", "const ", "var ", "let ", "require("), "arguments delete export from get import instanceof module of set typeof undefined"),
        _language("go", ("package ", "import "), "chan fallthrough func map range select type", statement_end="", ternary=False),
        _language("php", ("<?php", "namespace ", "use ", "require", "include"), "array echo extends implements include include_once namespace require require_once trait"),
        _language("ruby", ("require ", "require_relative ", "include "), "alias begin defined ensure module redo retry then undef unless until when", statement_end="", comment="#", block=("=begin", "=end")),
    )
}


def without_comments(code: str, language: Language) -> str:
    """code without comments; the line ends of block comments stay."""
    start, stop = map(re.escape, language.block)
    code = re.sub(rf"{start}[\s\S]*?{stop}", lambda m: "\n" * m[0].count("\n"), code)
    lines = [line.partition(language.comment)[0] for line in code.splitlines()]
    return "\n".join(lines) + ("\n" if code.endswith("\n") else "")


def blanked(code: str, language: Language) -> str:
    """code without comments, strings as so many spaces."""
    return STRING.sub(lambda m: " " * len(m[0]), without_comments(code, language))


def balanced(code: str) -> bool:
    """Whether brackets outside strings close in the order in which they open."""
    open_, closing = [], {")": "(", "]": "[", "}": "{"}
    for c in BRACKET.findall(STRING.sub("", code)):
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() != closing[c]:
            return False
    return not open_


def parse(code: str, language: str) -> pyast.Parsed:
    """Python is parsed; the other languages are checked for balance; what is neither is not ok."""
    if language == "python":
        return pyast.parse(code)
    if language in LANGUAGES:
        ok = balanced(code)
        return pyast.Parsed(None, ok, ok, "tree_sitter_language_pack_missing")
    return pyast.Parsed(None, False, False, f"parse_skipped_unsupported_language:{language}")


def names_in(text: str, language: Language) -> set[str]:
    return {name for name in NAME.findall(text) if not language.keyword(name)}


def identifiers(code: str, language: Language) -> list[str]:
    return sorted(names_in(blanked(code, language), language))[: pyast.MOST_NAMES]


def calls(code: str, language: Language) -> list[str]:
    found = (name for name in CALL.findall(blanked(code, language)) if not language.keyword(name.split(".")[-1]))
    return list(dict.fromkeys(found))[: pyast.MOST_NAMES]


def imports_context(code: str, language: Language) -> str:
    """The leading import lines; blank lines between them go."""
    found = []
    for line in filter(str.strip, code.splitlines()):
        if not line.strip().startswith(language.imports):
            break
        found.append(line)
    return "\n".join(found[: pyast.MOST_IMPORTS])


def positions(code: str, offsets: Iterable[int]) -> Iterator[tuple[int, int, int]]:
    """Line, from 1, column and byte of ascending character offsets, in one pass over code."""
    line, begin, at, size = 1, 0, 0, 0
    for offset in offsets:
        passed = code[at:offset]
        size += len(passed.encode())
        if feeds := passed.count("\n"):
            line += feeds
            begin = at + passed.rindex("\n") + 1
        at = offset
        yield line, offset - begin, size


def token_spans(unit_id: str, code: str, most: int) -> list[dict]:
    """The first `most` names, keywords too."""
    out = []
    names = list(islice(NAME.finditer(code), most))
    places = positions(code, (k for found in names for k in found.span()))
    for index, (found, (line, column, start), (end_line, end_column, stop)) in enumerate(zip(names, places, places, strict=True)):
        out.append(
            {
                "node_type": "identifier",
                "start_line": line,
                "start_col": column,
                "end_line": end_line,
                "end_col": end_column,
                "start_byte": start,
                "end_byte": stop,
                "source": found[0],
                "span_id": f"{unit_id}:tok:{index}",
                "unit_id": unit_id,
                "span_index": index,
            }
        )
    return out


def units(source: str, name: str, most: int, window: int, stride: int, most_windows: int) -> list[pyast.Unit]:
    """The whole source and its windows, each code once; trees of these languages aren't read."""
    language = LANGUAGES[name]

    def described(unit: pyast.Unit) -> pyast.Unit:
        unit.imports_context = imports_context(unit.code, language)
        unit.identifiers, unit.calls = identifiers(unit.code, language), calls(unit.code, language)
        return unit

    source = source.rstrip() + "\n"
    whole = described(pyast.Unit("function", "function", pyast.WHOLE_SOURCE, source, 1, pyast.line_count(source)))
    found = [whole, *pyast.window_units(source, "", window, stride, min(most - 1, most_windows), described)]
    first: dict[str, pyast.Unit] = {}
    for unit in found:
        if unit.code.strip():
            first.setdefault(unit.code.strip(), unit)
    return list(first.values())[:most]
