"""Syntax-aware chunker: pieces along definitions instead of fixed word windows.

The walk works on a tree of nodes (kind, start, end, named, extra, error,
children). Trees come from providers: Python's own parser for Python, and a
scanner of braces, brackets, comments and indents for the other languages, so
node borders can differ from those of a full grammar.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackenfold.functions.text import LANGUAGE_OF
from brackenfold.operators.word_chunks import check_window, windows

# Kinds of nodes that make chunks of their own.
TOP_LEVEL = frozenset(
    """annotation_type_declaration arrow_function attribute block block_mapping block_sequence class class_declaration class_definition
    compilation_unit constructor_declaration declaration def_function def_module defp_function document element enum_declaration
    enum_definition enum_item enum_specifier export_statement field_declaration function function_clause function_declaration
    function_def function_definition function_item function_signature_item generator_function_declaration impl_item import_declaration
    initializer interface_declaration interface_definition keyframes_statement local_function_declaration local_variable_declaration
    macro_def macro_definition media_statement method method_declaration method_definition module module_definition
    namespace_declaration namespace_definition object_definition package_declaration preproc_def preproc_else preproc_endif
    preproc_function_def preproc_if preproc_ifdef preproc_ifndef preproc_include program record_declaration rule rule_set
    script_element service_definition singleton_method source_file static_initializer struct_declaration struct_item struct_specifier
    style_element trait_definition trait_item type_alias_declaration type_definition type_item val_definition variable_assignment
    variable_declaration""".split()
)
COMMENTS = frozenset("line_comment block_comment comment html_comment doc_comment".split())
MIN_WORDS, MAX_GAP = 4, 2
_BLANKS = b" \t\n\r"


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    named: bool = True
    extra: bool = False
    error: bool = False


class Words:
    """Word counts of byte ranges by binary search; words are separated by blank, tab, CR and LF."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = [m.start() for m in re.finditer(rb"[^ \t\n\r]+", data)]
        self.to = [m.end() for m in re.finditer(rb"[^ \t\n\r]+", data)]

    def _index(self, xs: list[int], x: int) -> int:
        from bisect import bisect_left

        return bisect_left(xs, x)

    def count(self, a: int, b: int) -> int:
        """Words of the slice; one that the slice cuts counts."""
        if a >= b:
            return 0
        inner = self._index(self.at, b) - self._index(self.at, a)
        k = self._index(self.at, a) - 1
        return inner + (k >= 0 and self.to[k] > a and self.at[k] < a)

    def back(self, before: int, n: int) -> int | None:
        """Start of the n-th word before a place, 0 if there are no more than n, None without any."""
        k = self._index(self.at, before)
        if n == 0 or k == 0:
            return None
        return 0 if k <= n else self.at[k - n]


def _extended(words: Words, overlap: int, context: int | None, start: int, previous_end: int) -> int:
    lead = words.back(start, overlap)
    out = start if lead is None else min(start, lead)
    return context if context is not None and previous_end <= context < out else out


def _by_words(words: Words, start: int, end: int, limit: int, overlap: int, context: int | None, previous_end: int) -> list[tuple[int, int]]:
    from bisect import bisect_left

    a, b = bisect_left(words.at, start), bisect_left(words.at, end)
    out, k = [], a
    while k < b:
        stop = min(k + limit, b)
        x, y = words.at[k], min(words.to[stop - 1], end)
        while y < end and words.data[y] in _BLANKS:
            y += 1
        if not out and context is not None and previous_end <= context < x:
            x = context
        out.append((x, y))
        if stop == b:
            break
        k += limit - overlap
    return out


def _merged(words: Words, spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Small neighbours joined: either under MIN_WORDS, nearly touching, and within the limit together."""
    spans = [x for x in spans if x[0] < x[1]]
    out = spans[:1]
    for a, b in spans[1:]:
        pa, pb = out[-1]
        small = min(words.count(pa, pb), words.count(a, b)) < MIN_WORDS
        if small and max(0, a - pb) <= MAX_GAP and words.count(min(pa, a), max(pb, b)) <= limit:
            out[-1] = (min(pa, a), max(pb, b))
        else:
            out.append((a, b))
    return out


def spans_of(root: Node, data: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks, in document order."""
    words, out = Words(data), []
    stack: list[tuple[Node, int | None]] = [(root, None)]

    def last() -> int:
        return out[-1][1] if out else 0

    while stack:
        node, context = stack.pop()
        size = words.count(node.start, node.end)
        if node.error or not node.named:
            continue
        if node.extra:
            if node.kind in COMMENTS and size >= 2:
                out.append((node.start, node.end))
            continue
        top = node.kind in TOP_LEVEL
        if top and 0 < size <= limit:
            out.append((_extended(words, overlap, context, node.start, last()), node.end))
        elif top:
            later = []
            for child in node.children:
                n = words.count(child.start, child.end)
                if not child.named or child.error or not n:
                    continue
                if later:
                    later.append((child, None))  # keeps document order behind a child that waits
                elif n <= limit:
                    out.append((_extended(words, overlap, node.start, child.start, last()), child.end))
                elif child.kind in TOP_LEVEL or child.children:
                    later.append((child, None))
                else:
                    out += _by_words(words, child.start, child.end, limit, overlap, node.start, last())
            if not node.children and size:
                out += _by_words(words, node.start, node.end, limit, overlap, context, last())
            stack += reversed(later)
        elif node.children:
            stack += [(c, context) for c in reversed(node.children)]
        elif size >= 2 and last() <= node.start:
            if size <= limit:
                out.append((_extended(words, overlap, context, node.start, last()), node.end))
            else:
                out += _by_words(words, node.start, node.end, limit, overlap, context, last())
    return _merged(words, out, limit)


def python_tree(text: str) -> Node | None:
    """Module, classes and functions with their comments."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    at = lambda line, col: starts[line - 1] + col
    lines = text.split("\n")
    comments = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                a = starts[t.start[0] - 1] + len(lines[t.start[0] - 1][: t.start[1]].encode())
                comments.append(Node("comment", a, a + len(t.string.encode()), extra=True))
    except (tokenize.TokenError, IndentationError):
        pass
    kinds = {ast.ClassDef: "class_definition", ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition"}

    def build(x: ast.stmt) -> Node:
        first = min([x.lineno, *[d.lineno for d in getattr(x, "decorator_list", [])]])
        col = x.col_offset if first == x.lineno else max(0, x.decorator_list[0].col_offset - 1)
        children = [build(c) for c in getattr(x, "body", []) if isinstance(c, ast.stmt)]
        return Node(kinds.get(type(x), "statement"), at(first, col), at(x.end_lineno, x.end_col_offset), children)

    root = Node("module", 0, len(text.encode()), [build(x) for x in tree.body])

    def place(node: Node, c: Node) -> None:
        for child in node.children:
            if child.start <= c.start < child.end and child.children:
                return place(child, c)
            if child.start <= c.start < child.end:
                return None
        node.children.append(c)
        node.children.sort(key=lambda n: n.start)

    for c in comments:
        place(root, c)
    return root


_ROOTS = {"java": "program", "javascript": "program", "typescript": "program", "c": "translation_unit", "cpp": "translation_unit", "csharp": "compilation_unit", "json": "document", "yaml": "document", "html": "document", "css": "stylesheet", "bash": "program", "php": "program", "ruby": "program", "scala": "compilation_unit", "lua": "chunk"}
_DEFINES = re.compile(
    rb"\b(?:(?P<function>fn|func|function|def|sub|proc|fun)|(?P<class>class|object)|(?P<struct>struct|union|record)|(?P<enum>enum)|(?P<trait>trait)"
    rb"|(?P<interface>interface|protocol)|(?P<impl>impl|extension)|(?P<namespace>namespace|mod|module|package)|(?P<service>service|message|resource))\b"
)
_KINDS = {"function": "function_definition", "class": "class_declaration", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "interface": "interface_declaration", "impl": "impl_item", "namespace": "namespace_definition", "service": "service_definition"}
_HASH_COMMENTS = frozenset("bash python ruby yaml cmake make hcl elixir php".split())
_TOKENS = re.compile(rb"(?P<block>/\*.*?\*/|<!--.*?-->)|(?P<line>//[^\n]*)|(?P<hash>#[^\n]*)|(?P<dash>--[^\n]*|%[^\n]*)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<open>[{\[(])|(?P<close>[}\])])|(?P<end>;)|(?P<blank>\n[ \t\r]*\n)", re.S)


def braces_tree(text: str, language: str) -> Node:
    """A tree of statements and blocks for languages with brackets; of paragraphs for others."""
    data = text.encode()
    root = Node(_ROOTS.get(language, "source_file"), 0, len(data))
    stack, begin = [root], [0]

    def first(a: int, b: int) -> int:
        while a < b and data[a] in _BLANKS:
            a += 1
        return a

    def statement(end: int, node: Node | None = None) -> None:
        a = first(begin[-1], end)
        if a < end:
            # the words between the last border and the opening bracket say what is defined
            head = data[a : node.start if node else end]
            m = _DEFINES.search(head)
            kind = _KINDS[m.lastgroup] if m else "method_declaration" if node and head.rstrip().endswith(b")") else "import_declaration" if re.match(rb"(?:import|use|#include|package|require|from)\b", head) else "block" if node else "statement"
            stack[-1].children.append(Node(kind, a, end, node.children if node else []))
        begin[-1] = end

    for m in _TOKENS.finditer(data):
        g = m.lastgroup
        if g in ("block", "line") or g == "hash" and language in _HASH_COMMENTS or g == "dash" and language in ("lua", "erlang"):
            if len(stack) and stack[-1].kind != "group":
                statement(m.start())
                stack[-1].children.append(Node("block_comment" if g == "block" else "line_comment", m.start(), m.end(), extra=True))
                begin[-1] = m.end()
        elif g == "open":
            stack.append(Node("block" if m[0] == b"{" else "group", m.start(), m.end()))
            begin.append(m.end())
        elif g == "close" and len(stack) > 1:
            if stack[-1].kind != "group":
                statement(m.start())
            node = stack.pop()
            begin.pop()
            node.end = m.end()
            if node.kind == "block" and stack[-1].kind != "group":
                statement(m.end(), node)
        elif g == "end" and stack[-1].kind != "group" or g == "blank" and len(stack) == 1:
            statement(m.end() if g == "end" else m.start())
    while len(stack) > 1:  # unbalanced: the rest counts as plain text
        stack.pop()
        begin.pop()
    statement(len(data))
    return root


PROVIDERS: dict[str, Callable[[str], Node | None]] = {"python": python_tree}


def chunks_of(text: str, source: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(chunk_index, start, end, text), offsets in bytes; word windows for unknown languages or without a tree."""
    language = LANGUAGE_OF.get(source.rpartition(".")[2].lower() if "." in source else source.lower())
    if language is None or not text.strip():
        return list(windows(text, limit, overlap))
    tree = PROVIDERS[language](text) if language in PROVIDERS else braces_tree(text, language)
    data = text.encode()
    spans = spans_of(tree, data, limit, overlap) if tree else []
    if not spans:
        return list(windows(text, limit, overlap))
    return [(i, a, b, data[a:b].decode("utf-8", "ignore")) for i, (a, b) in enumerate(spans)]


def syntax_chunks(df: DataFrame, limit: int = 512, overlap: int = 64, source: str = "source", text: str = "text") -> DataFrame:
    """(source, chunk_index, start_offset, end_offset, text); the language follows from the source's extension.

    Null texts and sources have no chunks.
    """
    check_window(limit, overlap)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *c) for s, t in zip(b["s"], b["t"]) for c in chunks_of(t, s, limit, overlap)]
            yield pd.DataFrame(rows, columns=[source, "chunk_index", "start_offset", "end_offset", "text"])

    read = df.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(source).alias("s"), F.col(text).alias("t"))
    return read.mapInPandas(cut, f"`{source}` string, chunk_index int, start_offset bigint, end_offset bigint, text string")


def routed_chunks(df: DataFrame, limit: int = 512, overlap: int = 64, source: str = "source", text: str = "text") -> DataFrame:
    """Syntax chunks for sources in a known language, word chunks for all others."""
    from brackenfold.functions.text import language
    from brackenfold.operators.word_chunks import word_chunks

    known = language(source).isNotNull()
    return syntax_chunks(df.where(known), limit, overlap, source, text).unionByName(word_chunks(df.where(~F.coalesce(known, F.lit(False))), limit, overlap, source, text))
