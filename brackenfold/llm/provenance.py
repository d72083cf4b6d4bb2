"""Generated, minified and copied source files, and data stored as code.

Merkle hashes: each line is a leaf, each window of three lines a block, each
file the combination of its blocks, each directory that of its files. Blocks,
files and directories that occur in unrelated repositories mark copies, also
slightly adapted ones; rules on headers and layout find the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenfold.operators.skew import lookup_join
from brackenfold.tables import checkpoint

#: Lines of a block, and the share of a file's blocks that another repository must hold.
BLOCK_LINES, COPY_SHARE, MIN_SHARED = 3, 0.5, 3
#: Shares of lines of one template or of bare literals, characters per word and lines from which a layout counts.
TEMPLATE_SHARE, DATA_SHARE, MINIFIED_WORD, MIN_LINES = 0.5, 0.6, 18, 4
HEADER_LINES = 6

# File types that hold prose or documents, and those that hold settings.
PROSE = ("md", "txt", "rst", "adoc", "html", "htm", "docx", "pdf", "pptx", "tex", "org")
#: the same without an ending
PROSE_NAMES = ("readme", "license", "licence", "copying", "notice", "authors", "contributors", "changelog", "changes", "news", "todo", "install", "thanks", "credits", "maintainers", "history")
SETTINGS = ("json", "yaml", "yml", "toml", "xml", "csv", "ini", "cfg", "conf", "properties", "css", "env", "lock")
#: settings that are copied as code is
STYLES = ("css", "lock")
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "extern", "external", "externals", "deps", "subprojects", "godeps", "node_modules", "bundled", "bower_components", "site-packages", "contrib")

COMMENT = re.compile(r"^\s*(?://+|#+|/\*+|\*+|--+|;+|<!--|\"\"\"|%+|REM\b)\s*(.*)")
GENERATED = re.compile(
    r"""(?ix)
    @generated | auto-?\s?generated | automatically\s+(?:generated|created) | code\s+generated\s+(?:by|from)
    | \bgenerated\s+(?:on\s+[\d-]+|by\s+\S+\s+(?:compiler|tool|from)|from\s+\S+\.\w+) | machine[\s-](?:written|generated)
    | (?:produced|generated|written|created|emitted)\s+by\s+(?:a|the)\s+(?:tool|program|script|generator|compiler)
    | do\s+not\s+(?:edit|modify|change)(?:\s+by\s+hand|\s+manually|\s+(?:this|the)\s+file|\s*[:.!,;]|\s*$) | \boutput\s+(?:of|from)\s+\W?\w
    | (?:changes|edits|modifications)\s+(?:will\s+be|get)\s+(?:lost|overwritten)
    | (?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt) | (?:stammt|kommt|entstand)\s+(?:aus|von|durch|mit)\s+(?:\w+\s+)?(?:werkzeug|programm|generator|skript) | nicht\s+(?:von\s+hand\s+)?(?:bearbeiten|ändern) | änderungen\s+gehen\s+verloren
    | (?:généré|produit|créé)e?\s+(?:automatiquement|par\s+[\w-]*gen\b|par\s+un\s+(?:outil|programme)) | ne\s+pas\s+(?:modifier|éditer)
    | (?:generad|gerad|cread|criad|generat|creat)[oa]\s+autom[aá]ticamente | no\s+(?:editar|modificar) | não\s+(?:edite|editar|modifique) | non\s+modificare
    | автоматически\s+(?:создан|сгенерирован) | не\s+(?:редактир|измен)\w+ | 自动生成 | 自動生成 | 자동\s?생성 | otomatik\s+(?:olarak\s+)?(?:oluştur|üret)
    """
)
COPIED = re.compile(
    r"""(?ix)
    taken\s+from\s+\S+\s+\(? | imported\s+unchanged\s+from | (?:local|verbatim|bundled|vendored|upstream)\s+copy\b | copied\s+(?:verbatim\s+)?from\s+the
    | original\s+authors? | single-file\s+library | release\s+archive | (?:send|submit|report|direct)\s+(?:patches|bugs|issues|changes|fixes)\s+(?:to\b|upstream) | forked\s+from
    """
)
LITERAL = re.compile(r"""(?:[\[\](){},;:\s]|=>)*(?:(?:[bru]?"(?:[^"\\]|\\.)*"|[bru]?'(?:[^'\\]|\\.)*'|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[a-zA-Z0-9]{0,3}|null|NULL|None|nil|true|false|True|False)(?:[\[\](){},;:\s]|=>)*)+""")
STRINGS, NUMBERS, NAMES = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`"), re.compile(r"-?\d[\w.]*"), re.compile(r"[^\W\d]\w*")
KEY_VALUE = re.compile(r"^[-a.\[\]]*a(?:\.a)*\s*[:=]\s*[as9](?:\.a)*,?$")


def lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip()]


def layout(text: str, settings: bool) -> tuple[int, int, int, int, int, bool, bool]:
    """(lines, words, word characters, lines of the top template, literal lines, generated header, copied header).

    The header is the comment at the top, however long, or what comments the
    first HEADER_LINES lines hold.
    """
    rows = lines(text)
    words = text.split()
    templates: Counter = Counter()
    literal = 0
    for x in rows:
        plain = NAMES.sub("a", NUMBERS.sub("9", STRINGS.sub("s", x)))
        if settings and KEY_VALUE.match(plain):
            continue
        templates[plain] += 1
        literal += LITERAL.fullmatch(x) is not None
    top = max((n for t, n in templates.items() if not KEY_VALUE.match(t) and re.search(r"\w", t)), default=0)
    generated = copied = False
    for i, x in enumerate(rows):
        if m := COMMENT.match(x):
            generated |= GENERATED.search(m[1]) is not None
            copied |= COPIED.search(m[1]) is not None
        elif i >= HEADER_LINES:
            break
    return len(rows), len(words), sum(map(len, words)), top, literal, generated, copied


LAYOUT = "source string, repo string, i int, n_lines bigint, n_words bigint, n_chars bigint, top bigint, literal bigint, generated boolean, copied boolean"


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(s, r, i, *layout(t, e in SETTINGS)) for s, r, t, i, e in zip(b["source"], b["repo"], b["text"], b["i"], b["ext"])]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def leaves(text: Column) -> Column:
    """Hashes of the lines that aren't blank, without blanks at their ends and with single ones inside."""
    rows = F.split(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)[\s&&[^\n]]+", " ")), r" ?\n[\s]*", "\n"), "\n")
    return F.transform(rows, lambda x: F.xxhash64(x))


def blocks(leaf: str) -> Column:
    """Distinct hashes of all windows of BLOCK_LINES lines: each a hash of child hashes, by position.

    ``leaf`` must be a column, not an expression, which would be computed for each window anew.
    """
    window = lambda x, i: F.xxhash64(x, *[F.get(F.col(leaf), i + k) for k in range(1, BLOCK_LINES)])
    full = F.transform(leaf, window)
    return F.array_distinct(F.slice(full, 1, F.greatest(F.size(leaf) - BLOCK_LINES + 1, F.lit(1))))


def provenance(chunks: DataFrame, source: str = "source", text: str = "text", index: str = "chunk_index") -> DataFrame:
    """One row per source with its evidence.

    (source, n_lines, template_share, literal_share, word_chars, generated_header,
    copied_header, blocks, shared_blocks, shared_tree, vendored_path, reason):
    reason is vendored, generated, minified, data, or null for hand-written files.
    A source's repository is the first part of its path. Prose and documents (by
    file type, or by name where there is none) and null sources aren't looked at
    and have no row; null texts add nothing, so the header is that of the first
    chunk with a text; repeated rows and sources cut twice count as the same lines.
    """
    files = (
        chunks.where(F.col(source).isNotNull() & F.col(text).isNotNull())
        .select(F.col(source).alias("source"), F.col(text).alias("text"), F.coalesce(F.col(index), F.lit(0)).cast("int").alias("i"), extension(F.col(source)).alias("ext"))
        .where(F.when(F.col("ext") == "", ~F.lower(F.substring_index("source", "/", -1)).isin(*PROSE_NAMES)).otherwise(~F.col("ext").isin(*PROSE)))
        .withColumn("repo", F.substring_index("source", "/", 1))
    )
    shape = files.mapInPandas(_layouts, LAYOUT).groupBy("source", "repo").agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_words", "n_chars", "top", "literal")], F.max_by("generated", F.struct(-F.col("i"), "generated")).alias("generated"), F.max_by("copied", F.struct(-F.col("i"), "copied")).alias("copied"))
    # Merkle hashes; settings files are short and alike by nature
    coded = files.where(~F.col("ext").isin(*[e for e in SETTINGS if e not in STYLES]))
    lines_of = coded.select(F.xxhash64("source").alias("f"), F.xxhash64("repo").alias("repo"), leaves(F.col("text")).alias("leaf"))
    # three numbers a block, written once and read by each of the aggregations below
    leaf = checkpoint(lines_of.select("f", "repo", F.explode(blocks("leaf")).alias("h")).distinct())
    of_block = leaf.groupBy("h").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count("*").alias("n")).where("a < b").select("h", "n")
    shared = lookup_join(leaf, of_block, ["h"], "n").groupBy("f").agg(F.count("*").alias("shared_blocks"))
    nodes = leaf.groupBy("f").agg(F.count("*").alias("blocks"), F.xxhash64(F.bit_xor("h"), F.count("*")).alias("node"))
    trees = _shared_trees(coded.select("source", "repo").distinct(), nodes)
    found = (
        shape.withColumn("f", F.xxhash64("source"))
        .join(nodes.drop("node"), "f", "left")
        .join(shared, "f", "left")
        .join(trees.withColumn("shared_tree", F.lit(True)), "f", "left")
    )
    share = lambda c: F.col(c) / F.greatest("n_lines", F.lit(1))
    # the directories between repository and file
    parts = F.split(F.lower("source"), "/")
    between = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    out = found.select(
        "source",
        "n_lines",
        share("top").alias("template_share"),
        share("literal").alias("literal_share"),
        (F.col("n_chars") / F.greatest("n_words", F.lit(1))).alias("word_chars"),
        F.col("generated").alias("generated_header"),
        F.col("copied").alias("copied_header"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"),
        F.coalesce("shared_blocks", F.lit(0)).alias("shared_blocks"),
        F.coalesce("shared_tree", F.lit(False)).alias("shared_tree"),
        F.arrays_overlap(between, F.array(*map(F.lit, VENDOR_DIRS))).alias("vendored_path"),
    )
    held = (F.col("shared_blocks") >= MIN_SHARED) & (F.col("shared_blocks") >= COPY_SHARE * F.col("blocks"))
    long_enough = F.col("n_lines") >= MIN_LINES
    return out.withColumn(
        "reason",
        F.when(F.col("vendored_path") | F.col("copied_header") | held | F.col("shared_tree"), "vendored")
        .when(F.col("generated_header"), "generated")
        .when(long_enough & (F.col("literal_share") >= DATA_SHARE), "data")
        .when(F.col("word_chars") >= MINIFIED_WORD, "minified")
        .when(long_enough & (F.col("template_share") >= TEMPLATE_SHARE), "generated"),
    )


def _shared_trees(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(f): files below a directory of at least two that an unrelated repository holds unchanged."""
    # every directory above a file takes part of its hash from it: the hash of a directory is that of all its paths and nodes
    parts = F.split("source", "/")
    depth = F.size(parts)
    at = files.withColumn("f", F.xxhash64("source")).join(nodes.select("f", "node"), "f").where(depth > 2)
    below = at.select("f", "repo", "node", parts.alias("p"), F.explode(F.sequence(F.lit(2), depth - 1)).alias("d")).select(
        "f", "repo", F.xxhash64("repo", F.slice("p", 2, F.col("d") - 1)).alias("dir"), F.xxhash64(F.slice("p", F.col("d") + 1, F.size("p")), "node").alias("part")
    )
    trees = below.groupBy("dir", "repo").agg(F.xxhash64(F.bit_xor("part"), F.count("*")).alias("tree"), F.count("*").alias("n"))
    both = trees.where("n >= 2").groupBy("tree").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count("*").alias("dirs")).where("a < b").select("tree", "dirs")
    # a directory may hold a large part of all files
    held = lookup_join(trees.select("dir", "tree", "n"), both, ["tree"], "dirs").select("dir", "n")
    return lookup_join(below.select("f", "dir"), held, ["dir"], "n").select("f").distinct()
