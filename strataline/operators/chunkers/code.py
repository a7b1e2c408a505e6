"""Source files to chunks: plug-ins by language and the table function that runs them.

Python files are parsed with the standard library's parser. TypeScript and Ruby files are tokenized (see
``scan``): strings, templates, regular expressions, comments and heredocs are told from code, and the top-level
definitions that become chunks are followed by a stack of brackets or keywords.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.chunkers import scan
from strataline.schema import CODE_CHUNK
from strataline.sources.files import TEST_PATTERNS

SMALL_FILE_LINES = 50
MAX_IMPORTS = 10
#: Classes of more tokens carry the note of a cut, whether or not they are longer than a chunk may be.
LARGE_CLASS_TOKENS = 500
#: Characters of chunks that are handed over at once.
BATCH_CHARS = 4_000_000
# Names that frameworks give a meaning: fixed values.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
CONFIG_NAMES = ("next.config.js", "next.config.mjs", "next.config.ts", "tailwind.config.js", "tailwind.config.ts", "postcss.config.js", "postcss.config.mjs")


@dataclass(frozen=True)
class Chunk:
    name: str
    chunk_type: str
    line_start: int
    line_end: int
    code: str
    exported: bool = False
    role: str | None = None
    whole: bool = False  # a file as one chunk, which is never cut


class LanguagePlugin(Protocol):
    name: str
    extensions: tuple[str, ...]
    test_patterns: tuple[str, ...]
    comment: str

    def chunks(self, path: str, content: str) -> list[Chunk]: ...

    def imports(self, content: str) -> list[str]: ...

    def language(self, path: str) -> str: ...


def _whole(path: str, content: str, kind: str = "other", role: str | None = None, exported: bool = False, name: str | None = None) -> list[Chunk]:
    return [Chunk(name or path.rsplit("/", 1)[-1], kind, 1, content.count("\n") + 1, content, exported, role, True)]


def line_finder(content: str) -> Callable[[int], int]:
    """The number of the line that a place of a text is in; the text is read once."""
    ends = [m.start() for m in re.finditer("\n", content)]
    return lambda at: bisect_left(ends, at) + 1


class PythonPlugin:
    name, extensions, comment = "python", ("py",), "#"
    test_patterns = TEST_PATTERNS[("py",)]

    def language(self, path: str) -> str:
        return "python"

    def imports(self, content: str) -> list[str]:
        return [x for x in content.split("\n") if x.lstrip().startswith(("import ", "from "))][:MAX_IMPORTS]

    def chunks(self, path: str, content: str) -> list[Chunk]:
        lines = content.split("\n")
        if len(lines) < SMALL_FILE_LINES:
            return _whole(path, content)
        try:
            body = ast.parse(content).body
        except (SyntaxError, ValueError, RecursionError):
            return _whole(path, content)
        except MemoryError as e:  # with a message: the parser's own stack is full; without one memory is, which no chunk may hide
            if not e.args:
                raise
            return _whole(path, content)
        out = []
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "decorator" if node.decorator_list else "class" if isinstance(node, ast.ClassDef) else "function"
                out.append(Chunk(node.name, kind, start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno])))
        return out or _whole(path, content)


class RubyPlugin:
    name, extensions, comment = "ruby", ("rb", "rake"), "#"
    test_patterns = TEST_PATTERNS[("rb", "rake")]

    def language(self, path: str) -> str:
        return "ruby"

    def imports(self, content: str) -> list[str]:
        return [x for x in content.split("\n") if x.lstrip().startswith(("require ", "require_relative ", "include ", "extend ", "prepend "))][:MAX_IMPORTS]

    def chunks(self, path: str, content: str) -> list[Chunk]:
        lines = content.split("\n")
        if len(lines) < SMALL_FILE_LINES:
            return _whole(path, content)
        out, line = [], line_finder(content)
        for d in scan.ruby_definitions(content):
            first, last = line(d.start), line(d.stop)
            out.append(Chunk(d.name, "function" if d.kind == "def" else "class", first, last, content[d.start : d.stop]))
        return out or _whole(path, content)


class TypeScriptPlugin:
    name, extensions, comment = "typescript", ("ts", "tsx", "js", "jsx", "mjs", "mts"), "//"
    test_patterns = TEST_PATTERNS[("ts", "tsx", "js", "jsx", "mjs", "mts")]
    _markup = re.compile(r"(?:return\s*\(?|=>\s*\(?|\(|\?|:|&&)\s*<(?:[A-Za-z][\w.]*(?:\s|>|/)|>)")

    def language(self, path: str) -> str:
        return "tsx" if path.endswith((".tsx", ".jsx")) else "typescript"

    def imports(self, content: str) -> list[str]:
        return [x for x in content.split("\n") if x.startswith(("import ", "import{"))][:MAX_IMPORTS]

    @staticmethod
    def role(path: str) -> str | None:
        base = path.rsplit("/", 1)[-1]
        stem = re.sub(r"\.(tsx?|jsx?|mts|mjs)$", "", base)
        if stem in ("page", "layout", "middleware"):
            return stem
        if stem == "route" and "api" in path:
            return "api_route"
        return "config" if base in CONFIG_NAMES else None

    @staticmethod
    def route_path(path: str) -> str:
        """The address of a page file: the folders below 'app' without (groups); all folders without 'app'."""
        folders = path.split("/")[:-1]
        if "app" in path.split("/"):
            folders = [p for p in folders[path.split("/").index("app") + 1 :] if not p.startswith("(")]
        return "/" + "/".join(folders)

    def kind(self, name: str, declared: str, code: str, path: str) -> str:
        if declared in ("interface", "type", "class"):
            return declared
        if name in HTTP_METHODS:
            return "route"
        if name.startswith("use") and len(name) > 3 and name[3] == name[3].upper():
            return "hook"
        if re.fullmatch(r"[A-Z][a-zA-Z0-9]*", name) and (declared == "function" or self._markup.search(code)):
            return "component"
        return "config" if path.rsplit("/", 1)[-1] in CONFIG_NAMES else "function"

    def chunks(self, path: str, content: str) -> list[Chunk]:
        role = self.role(path)
        if content.count("\n") + 1 < SMALL_FILE_LINES:
            return _whole(path, content, "config" if role == "config" else "other", role)
        if role in ("page", "layout", "middleware"):
            return [replace(c, whole=True) for c in _whole(path, content, "function" if role == "middleware" else "component", role, True, self.route_path(path) if role == "page" else None)]
        out, seen, line = [], -1, line_finder(content)
        for d in scan.typescript_definitions(content):
            if role == "api_route":
                if d.name in HTTP_METHODS and d.kind in ("function", "const"):
                    first, last = line(d.outer), line(d.stop)
                    out.append(Chunk(d.name, "route", first, last, content[d.outer : d.stop], d.exported, role, True))
                continue
            if d.kind == "const":
                if d.start == seen or not scan.is_function_value(d.value):
                    continue
                seen = d.start  # a statement is one chunk, named by its first function
            first, last = line(d.start), line(d.stop)
            code = content[d.start : d.stop]
            out.append(Chunk(d.name, self.kind(d.name, d.kind, code, path), first, last, code, d.exported, role))
        return out or _whole(path, content, "config" if role == "config" else "other", role)


class PluginRegistry:
    """Plug-ins by extension; the one registered last for an extension counts."""

    def __init__(self, plugins=()):
        self.by_extension: dict[str, LanguagePlugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: LanguagePlugin) -> None:
        for e in plugin.extensions:
            self.by_extension[e] = plugin

    def plugin_for(self, path: str) -> LanguagePlugin | None:
        return self.by_extension.get(path.rsplit(".", 1)[-1]) if "." in path else None

    def is_test_file(self, path: str) -> bool:
        plugin = self.plugin_for(path)
        return plugin is not None and any(re.search(p, path) for p in plugin.test_patterns)


def default_registry() -> PluginRegistry:
    return PluginRegistry([TypeScriptPlugin(), PythonPlugin(), RubyPlugin()])


def chunk_text(plugin: LanguagePlugin, path: str, content: str, code: str, max_tokens: int, chunk: Chunk | None = None, found: list[str] | None = None) -> str:
    """File comment, imports (``found``, if they are known) and code; cut at max_tokens * 4 characters with a note, but for chunks that are whole files."""
    found = plugin.imports(content) if found is None else found
    text = "\n".join([f"{plugin.comment} file: {path}", *(["\n".join(found), ""] if found else []), code])
    if chunk is not None and chunk.whole:
        return text
    cut = lambda t: t[: max_tokens * 4] + f"\n{plugin.comment} ... truncated"
    if chunk is not None and chunk.chunk_type == "class" and -(-len(code) // 4) > LARGE_CLASS_TOKENS:
        text = cut(text)
    return cut(text) if -(-len(text) // 4) > max_tokens else text


def chunk_files(files: DataFrame, max_tokens: int = 8000, registry: PluginRegistry | None = None) -> DataFrame:
    """Code chunks of (path, content[, package_name]); files of no known language and null texts give none.

    Ids hash the relative path and the lines, so they do not depend on where the tree lies. Package names
    apply to TypeScript files; other languages have 'root'.
    """
    registry = registry or default_registry()
    package = F.col("package_name") if "package_name" in files.columns else F.lit("root")

    def chunked(path, content, package_name):
        plugin = registry.plugin_for(path) if path is not None else None
        if plugin is None or content is None:
            return
        owner, found = package_name if plugin.name == "typescript" else "root", plugin.imports(content)
        for c in plugin.chunks(path, content):
            yield path, owner, c.name, c.chunk_type, c.line_start, c.line_end, chunk_text(plugin, path, content, c.code, max_tokens, c, found), plugin.language(path), c.exported, c.role or ""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):  # a file at a time, so that a batch's texts are never held twice
                for row in chunked(*(batch.column(k)[i].as_py() for k in range(3))):
                    rows.append(row)
                    size += len(row[6])
                    if size >= BATCH_CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    schema = "file_path string, package_name string, name string, chunk_type string, line_start int, line_end int, content string, language string, exported boolean, framework_role string"
    out = files.select("path", "content", package.alias("package_name")).mapInArrow(run, schema)
    out = out.withColumn("id", C.short_id(F.concat_ws(":", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"))))
    return out.select(*[F.col(f.name) for f in CODE_CHUNK])
