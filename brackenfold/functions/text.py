"""Path and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types that a directory scan takes up.
INDEXABLE = ("pdf", "docx", "xlsx", "pptx", "txt", "md", "rs", "py", "js", "ts", "go", "java", "c", "cpp", "h", "json", "yaml", "yml", "toml", "xml", "csv", "html", "css")

# Languages with a syntax-aware chunker, and their file extensions.
LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "go": "go", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh",
    "java": "java", "csharp": "cs", "ruby": "rb", "php": "php", "scala": "scala sc", "html": "html htm", "css": "css scss less", "json": "json",
    "yaml": "yaml yml", "lua": "lua", "zig": "zig", "elixir": "ex exs", "erlang": "erl hrl", "hcl": "hcl tf tfvars", "proto": "proto",
    "bash": "sh bash zsh", "cmake": "cmake", "make": "mk makefile",
}
LANGUAGE_OF = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts.split()}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path) -> Column:
    """Lower-cased text after the last dot of the file name; "" without one."""
    return F.lower(F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1))


def supported_extension(path) -> Column:
    return extension(path).isin(*INDEXABLE)


def source_suffix(source) -> Column:
    """What routes a text source: lower-cased text after its last dot, the whole source without one."""
    return F.lower(F.substring_index(_col(source), ".", -1))


def language(source) -> Column:
    """Language of the syntax-aware chunker, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return table[source_suffix(source)]


def content_hash(content) -> Column:
    """Hex SHA-256 of bytes, or of a text's UTF-8 bytes."""
    return F.sha2(_col(content), 256)


def words(text) -> Column:
    """Runs of characters that aren't Unicode white space."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+"), F.lit(0))


def chunk_total(n_words, limit: int, overlap: int) -> Column:
    """How many word chunks a text of n words gives."""
    n = _col(n_words)
    return F.when(n == 0, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((n - limit) / F.lit(float(limit - overlap))))).cast("int")
