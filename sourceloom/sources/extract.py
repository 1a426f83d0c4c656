"""Definitions, calls, imports and constants of source files: one small helper per file, tables by Spark.

Python is read with the standard library's ast, by indentation where a file does not parse or is nested too deeply. C++ is read by
sources.cpp. A file that cannot be read, whatever the error, keeps the error's name and gives no definitions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..scratch import small_batches
from .cpp import read_cpp

SCHEMA = (
    "repo string, path string, language string, line_count int, error string, "
    "chunks array<struct<pos:int,parent:int,name:string,symbol_type:string,start_line:int,end_line:int,source:string,header:string,called_names:array<string>>>, "
    "includes array<struct<target:string,is_system:boolean,line:int>>, constants array<struct<name:string,line:int>>"
)
_COLUMNS = ["repo", "path", "language", "line_count", "error", "chunks", "includes", "constants"]
_WORD = r"[A-Za-z_]\w*"
#: Characters of files whose definitions a task holds at a time, apart from a single longer file.
SLICE = 1 << 20


def _last(names: list[str]) -> list[str]:
    return list(dict.fromkeys(n for n in names if n))


def _python(text: str) -> tuple[list, list, list]:
    tree, data = ast.parse(text), text.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", data))]  # ast ends a line at a lone \r too
    chunks, includes, constants = [], [], []

    def slice_of(node) -> str:
        return data[starts[node.lineno - 1] + node.col_offset : starts[node.end_lineno - 1] + node.end_col_offset].decode()

    def walk(node, owner: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            mine = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if owner is not None else "function"
                source = slice_of(child)
                body = child.body[0]
                n_head = (min([body.lineno, *(d.lineno for d in getattr(body, "decorator_list", []))])) - child.lineno
                header = "\n".join(re.split(r"\r\n|\r|\n", source)[:n_head]) if n_head else source.split(":")[0] + ":"
                mine = len(chunks)
                chunks.append([mine, owner, child.name, kind, child.lineno, child.end_lineno, source, header, []])
            elif isinstance(child, ast.Call) and owner is not None:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    chunks[owner][8].append((child.lineno, child.col_offset, name))
            elif isinstance(child, ast.Import):
                includes.extend([a.name, False, child.lineno] for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                dots = "." * child.level
                targets = [dots + child.module] if child.module else [a.name for a in child.names]
                includes.extend([t, False, child.lineno] for t in targets)
            walk(child, mine)

    walk(tree, None)
    for chunk in chunks:
        chunk[8] = _last([n for _, _, n in sorted(chunk[8])])
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        constants.extend([t.id, node.lineno] for t in targets[:1] if isinstance(t, ast.Name))
    return chunks, includes, constants


def _python_by_indent(text: str) -> tuple[list, list, list]:
    """For files that do not parse: a header and all following lines that are blank or indented deeper."""
    lines, chunks, includes, constants = text.split("\n"), [], [], []
    head = re.compile(rf"(\s*)(?:async\s+)?(def|class)\s+({_WORD})")
    open_chunks: list[tuple[int, int]] = []
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_chunks and indent <= open_chunks[-1][0]:
            open_chunks.pop()
        owner = open_chunks[-1][1] if open_chunks else None
        for _, c in open_chunks:
            chunks[c][5] = k + 1
        found = head.match(line)
        if found:
            kind = "class" if found[2] == "class" else "method" if owner is not None else "function"
            open_chunks.append((indent, len(chunks)))
            chunks.append([len(chunks), owner, found[3], kind, k + 1, k + 1, "", line.strip(), []])
        elif owner is not None:
            chunks[owner][8] += re.findall(rf"({_WORD})\s*\(", line)
        if m := re.match(r"\s*import\s+(.+)", line):
            includes.extend([x.split(" as ")[0].strip(), False, k + 1] for x in m[1].split(","))
        elif m := re.match(r"\s*from\s+(\S+)\s+import", line):
            includes.append([m[1], False, k + 1])
        elif m := re.match(rf"({_WORD})\s*(?::[^=]+)?=(?!=)", line):
            constants.append([m[1], k + 1])
    for chunk in chunks:
        chunk[6] = "\n".join(lines[chunk[4] - 1 : chunk[5]]).lstrip()
        chunk[8] = _last(chunk[8])
    return chunks, includes, constants


_CHUNK = ("pos", "parent", "name", "symbol_type", "start_line", "end_line", "source", "header", "called_names")


def _extract(content: str, language: str) -> tuple[list, list, list]:
    text = content.replace("\r\n", "\n")
    if language != "Python":
        return read_cpp(text)
    try:
        return _python(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indent(text)


def _read(content: str | None, language: str) -> tuple[str | None, tuple[list, list, list]]:
    """The error, if there is one, and what was found."""
    if content is None:
        return "not valid UTF-8", ([], [], [])
    try:
        return None, _extract(content, language)
    except Exception as why:  # noqa: BLE001  one bad file must not end the job
        return type(why).__name__, ([], [], [])


def extract(files: DataFrame) -> DataFrame:
    """A row per file (repo, path, content, language) with its chunks, includes and constants, or an error.

    Files reach the helper in batches of bounded bytes, and what is found leaves it as soon as their texts come to SLICE characters.
    """
    small_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.itertuples():
                error, found = _read(r.content, r.language)
                text = r.content or ""
                n = text.count("\n") + 1 - text.endswith("\n")
                chunks = [dict(zip(_CHUNK, c)) for c in found[0]]
                rows.append((r.repo, r.path, r.language, n, error, chunks, [dict(zip(("target", "is_system", "line"), x)) for x in found[1]], [dict(zip(("name", "line"), x)) for x in found[2]]))
                held += len(text)
                if held > SLICE:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("repo", "path", "content", "language").mapInPandas(run, SCHEMA)


def chunks_of(extracted: DataFrame) -> DataFrame:
    """A row per definition, with its signature, short name and whether it contains others."""
    rows = extracted.where("error is null").select("repo", "path", "language", F.explode("chunks").alias("c"), F.transform("chunks", lambda c: c["parent"]).alias("_p"))
    header = F.regexp_replace(F.regexp_replace("c.header", r"//[^\n]*|#[^\n]*", ""), r"\s+", " ")
    signature = F.substring(F.btrim(F.regexp_replace(F.btrim(header), r"[:{]\s*$", "")), 1, rules.SIGNATURE_CHARS)
    return rows.select(
        "repo", "path", "language", "c.pos", "c.parent", "c.name", F.element_at(F.split("c.name", "::", -1), -1).alias("short_name"), "c.symbol_type",
        "c.start_line", "c.end_line", "c.source", signature.alias("signature"), "c.called_names", F.coalesce(F.array_contains("_p", F.col("c.pos")), F.lit(False)).alias("is_container"),
    )


def includes_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("error is null").select("repo", "path", F.inline("includes"))


def constants_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("error is null").select("repo", "path", F.inline("constants"))
