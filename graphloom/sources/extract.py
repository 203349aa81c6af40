"""Symbols, calls, imports and heritage from source text.

Extraction is a map over files in Arrow batches: one file is one task's work for milliseconds, a broken file
gives a row with its error and no other trouble. Python is read with its own parser, other languages by
patterns of their declarations; an extractor for a language can be registered.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "kind string, file string, language string, name string, type string, start_line int, end_line int, exported boolean, parent string, detail string, names array<string>, error string"
#: language -> function(file, text) yielding dicts of ROW.
EXTRACTORS: dict[str, Callable[[str, str], Iterator[dict]]] = {}


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def python_rows(file: str, text: str) -> Iterator[dict]:
    """Classes, functions and methods (a leading underscore is private), calls, imports and bases."""
    tree = ast.parse(text)

    def walk(node: ast.AST, owner: str | None) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "Class" if is_class else "Method" if owner else "Function"
                decorators = [d for d in map(_dotted, (x.func if isinstance(x, ast.Call) else x for x in child.decorator_list)) if d]
                yield {"kind": "symbol", "name": child.name, "type": kind, "start_line": child.lineno, "end_line": child.end_lineno, "exported": not child.name.startswith("_"), "parent": owner, "names": decorators}
                for base in child.bases if is_class else ():
                    if name := _dotted(base):
                        yield {"kind": "heritage", "name": child.name, "detail": "extends", "parent": name}
                inner = child.name if is_class else None
            elif isinstance(child, ast.Call) and (name := _dotted(child.func)):
                yield {"kind": "call", "name": name, "start_line": child.lineno}
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield {"kind": "import", "detail": a.name, "start_line": child.lineno, "names": [a.asname or a.name]}
            elif isinstance(child, ast.ImportFrom):
                yield {"kind": "import", "detail": "." * child.level + (child.module or ""), "start_line": child.lineno, "names": [a.name for a in child.names]}
            yield from walk(child, inner)

    yield from walk(tree, None)


#: Declarations by language: (pattern with `name`, node type); the first that matches a line counts.
DECLARATIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "typescript": (
        (r"^\s*(?P<out>export\s+)?(default\s+)?(abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?(?:\s+implements\s+(?P<implements>[\w, ]+))?", "Class"),
        (r"^\s*(?P<out>export\s+)?interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?", "Interface"),
        (r"^\s*(?P<out>export\s+)?type\s+(?P<name>\w+)\s*[=<]", "Type"),
        (r"^\s*(?P<out>export\s+)?enum\s+(?P<name>\w+)", "Enum"),
        (r"^\s*(?P<out>export\s+)?(default\s+)?(async\s+)?function\s*\*?\s*(?P<name>\w+)", "Function"),
        (r"^\s*(?P<out>export\s+)?const\s+(?P<name>\w+)\s*(:[^=]+)?=\s*(async\s*)?(\([^)]*\)|\w+)\s*(:[^=]+)?=>", "Function"),
    ),
    "go": (
        (r"^func\s+\(\w+\s+\*?(?P<parent>\w+)\)\s+(?P<name>\w+)", "Method"),
        (r"^func\s+(?P<name>\w+)", "Function"),
        (r"^type\s+(?P<name>\w+)\s+struct", "Struct"),
        (r"^type\s+(?P<name>\w+)\s+interface", "Interface"),
        (r"^type\s+(?P<name>\w+)\s", "Type"),
    ),
    "rust": (
        (r"^\s*(?P<out>pub(\([^)]*\))?\s+)?(async\s+)?fn\s+(?P<name>\w+)", "Function"),
        (r"^\s*(?P<out>pub(\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "Struct"),
        (r"^\s*(?P<out>pub(\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "Enum"),
        (r"^\s*(?P<out>pub(\([^)]*\))?\s+)?trait\s+(?P<name>\w+)", "Trait"),
    ),
    "java": (
        (r"^\s*(?P<out>public\s+)?(\w+\s+)*class\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?(?:\s+implements\s+(?P<implements>[\w, ]+))?", "Class"),
        (r"^\s*(?P<out>public\s+)?(\w+\s+)*interface\s+(?P<name>\w+)", "Interface"),
        (r"^\s*(?P<out>public\s+)?(\w+\s+)*enum\s+(?P<name>\w+)", "Enum"),
        (r"^\s+(?P<out>public\s+)?((private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(throws [\w, ]+)?\{", "Method"),
    ),
    "ruby": (
        (r"^\s*class\s+(?P<name>\w+)(?:\s*<\s*(?P<extends>\w+))?", "Class"),
        (r"^\s*module\s+(?P<name>\w+)", "Module"),
        (r"^\s*def\s+(self\.)?(?P<name>\w+[?!]?)", "Method"),
    ),
    "c": (
        (r"^\s*(typedef\s+)?(struct|union)\s+(?P<name>\w+)\s*\{", "Struct"),
        (r"^\s*(typedef\s+)?enum\s+(?P<name>\w+)", "Enum"),
        (r"^[A-Za-z_][\w\s\*]*?[\s\*](?P<name>\w+)\s*\([^;]*\)\s*\{", "Function"),
    ),
    "php": (
        (r"^\s*(abstract\s+|final\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<extends>\w+))?(?:\s+implements\s+(?P<implements>[\w, ]+))?", "Class"),
        (r"^\s*interface\s+(?P<name>\w+)", "Interface"),
        (r"^\s*trait\s+(?P<name>\w+)", "Trait"),
        (r"^\s+(?P<out>public\s+)?((private|protected|static)\s+)*function\s+(?P<name>\w+)", "Method"),
        (r"^function\s+(?P<name>\w+)", "Function"),
    ),
    "kotlin": (
        (r"^\s*(\w+\s+)*class\s+(?P<name>\w+)", "Class"),
        (r"^\s*(\w+\s+)*interface\s+(?P<name>\w+)", "Interface"),
        (r"^\s*(\w+\s+)*object\s+(?P<name>\w+)", "Class"),
        (r"^\s*(\w+\s+)*fun\s+(<[^>]+>\s*)?(\w+\.)?(?P<name>\w+)", "Function"),
    ),
    "swift": (
        (r"^\s*(\w+\s+)*class\s+(?!func)(?P<name>\w+)(?:\s*:\s*(?P<extends>\w+))?", "Class"),
        (r"^\s*(\w+\s+)*struct\s+(?P<name>\w+)", "Struct"),
        (r"^\s*(\w+\s+)*protocol\s+(?P<name>\w+)", "Interface"),
        (r"^\s*(\w+\s+)*enum\s+(?P<name>\w+)", "Enum"),
        (r"^\s*(\w+\s+)*func\s+(?P<name>\w+)", "Function"),
    ),
}
DECLARATIONS["cpp"] = ((r"^\s*(template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)(?:\s*:\s*(public|private|protected)?\s*(?P<extends>\w+))?", "Class"), (r"^\s*namespace\s+(?P<name>\w+)", "Package"), *DECLARATIONS["c"])
DECLARATIONS["csharp"] = ((r"^\s*(?P<out>public\s+)?(\w+\s+)*struct\s+(?P<name>\w+)", "Struct"), *DECLARATIONS["java"])
IMPORTS = {
    "typescript": r"^\s*import\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*(?:from\s+)?['\"](?P<source>[^'\"]+)['\"]",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<source>[\w./-]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+)",
    "java": r"^\s*import\s+(?:static\s+)?(?P<source>[\w.]+)",
    "kotlin": r"^\s*import\s+(?P<source>[\w.]+)",
    "csharp": r"^\s*using\s+(?P<source>[\w.]+)\s*;",
    "php": r"^\s*use\s+(?P<source>[\w\\]+)",
    "ruby": r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)['\"]",
    "swift": r"^\s*import\s+(?P<source>\w+)",
    "c": r"^\s*#\s*include\s+[<\"](?P<source>[^>\"]+)[>\"]",
    "cpp": r"^\s*#\s*include\s+[<\"](?P<source>[^>\"]+)[>\"]",
}
_CALL = re.compile(r"(?<![\w.])(?:[\w.]+\.)?([A-Za-z_]\w*)\s*\(")
#: Words before a bracket that are no calls (fixed values).
NO_CALL = (
    "if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "super", "this",
    "import", "require", "fn", "func", "def", "class", "match", "loop", "sizeof", "elif", "not", "and", "or", "in",
)
#: Calls that say nothing of a TypeScript project. Fixed values.
TYPESCRIPT_NO_CALL = (
    "require", "import", "console", "log", "warn", "error", "info", "debug", "setTimeout", "setInterval",
    "clearTimeout", "clearInterval", "Promise", "resolve", "reject", "then", "catch", "finally", "JSON", "parse",
    "stringify", "toString", "valueOf", "Array", "Object", "Map", "Set", "String", "Number", "Boolean", "push",
    "pop", "shift", "unshift", "splice", "slice", "concat", "filter", "map", "reduce", "forEach", "find",
    "findIndex", "some", "every", "includes", "indexOf", "join", "split", "replace", "trim", "match", "test",
    "keys", "values", "entries", "has", "get", "set", "delete", "add", "clear", "from", "of", "isArray", "assign",
    "freeze", "defineProperty", "addEventListener", "removeEventListener", "querySelector", "getElementById",
    "createElement", "appendChild", "emit", "on", "off", "once", "describe", "it", "test", "expect", "beforeEach",
    "afterEach", "beforeAll", "afterAll",
)
_COMPONENT = re.compile(r"<([A-Z]\w*)[\s/>]")
_REEXPORT = re.compile(r"^\s*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{(?P<names>[^}]*)\})\s+from\s+['\"](?P<source>[^'\"]+)['\"]")
_EXPORT_LIST = re.compile(r"^\s*export\s+(?:type\s+)?\{([^}]*)\}\s*;?\s*$")
_TYPE_ARGUMENTS = re.compile(r"\w<([A-Z][\w\s,|<\[\]]*)>")
_API_CONSTANT = re.compile(r"(\w+):\s*(?:\([^)]*\)\s*=>\s*)?[\"`](/api/v1/[^\"`]+)[\"`]")
_API_USE = re.compile(r"(?:\.(get|post|put|patch|delete)(?:<[^>]*>)?\(\s*)?\bAPI((?:\.\w+)+)")
_API_PATH = re.compile(r"\.(get|post|put|patch|delete)(?:<[^>]*>)?\(\s*[\"'`](/api/v1/[^\"'`]+)")
_ROUTE = re.compile(r"(\w+)\.(Get|Post|Put|Patch|Delete)\(\"([^\"]+)\".*?h\.(\w+)\)")
_GO_FUNCTION = re.compile(r"^func\s+(\w+)\(")


def _names(text: str) -> list[str]:
    """Names before `as` in a list between braces."""
    return [w[0] for part in text.split(",") if (w := [x for x in part.split() if x != "type"])]


def typescript_rows(n: int, line: str) -> Iterator[dict]:
    """Re-exports, type arguments, API constants and their uses on a line."""
    if m := _REEXPORT.match(line):
        yield {"kind": "reexport", "detail": m["source"], "start_line": n, "names": _names(m["names"]) if m["names"] is not None else ["*"]}
    for m in _TYPE_ARGUMENTS.finditer(line):
        for name in re.findall(r"\b[A-Z]\w*", m[1]):
            yield {"kind": "type_use", "name": name, "start_line": n}
    for m in _API_CONSTANT.finditer(line):
        yield {"kind": "api_constant", "name": m[1], "detail": m[2], "start_line": n}
    for m in _API_USE.finditer(line):
        yield {"kind": "api_use", "name": m[2].rsplit(".", 1)[1], "parent": m[1] and m[1].upper(), "start_line": n}
    for m in _API_PATH.finditer(line):
        yield {"kind": "api_use", "detail": m[2], "parent": m[1].upper(), "start_line": n}


def _block_end(lines: list[str], at: int) -> int:
    """Last line of the braces that open at or after a declaration; the line itself if none do."""
    depth, opened = 0, False
    for n in range(at, len(lines)):
        depth += lines[n].count("{") - lines[n].count("}")
        opened = opened or "{" in lines[n]
        if (opened and depth <= 0) or (not opened and lines[n].rstrip().endswith(";")):
            return n + 1
    return at + 1 if not opened else len(lines)


#: Words on a declaration that hide it, by language.
_HIDING = {"php": "private|protected", "csharp": "private|internal", "kotlin": "private|internal|protected", "swift": "private|fileprivate"}
_JAVA_MODIFIERS = re.compile(r"\b(private|protected|static|final|abstract|synchronized)\b")


def _exported(language: str, name: str, line: str, marked: bool) -> bool:
    """Whether a declaration is visible outside: by marker, capital, underscore or modifier, as the language has it."""
    if language in ("typescript", "rust"):
        return marked
    if language == "go":
        return name[:1].isupper()
    if language == "ruby":
        return not name.startswith("_")
    if language == "java":
        return marked or not _JAVA_MODIFIERS.search(line)
    return not (language in _HIDING and re.search(rf"\b({_HIDING[language]})\b", line))


def pattern_rows(language: str, file: str, text: str) -> Iterator[dict]:
    declarations = [(re.compile(p), t) for p, t in DECLARATIONS.get(language, ())]
    imports = re.compile(IMPORTS[language]) if language in IMPORTS else None
    silent = {*NO_CALL, *(TYPESCRIPT_NO_CALL if language == "typescript" else ())}
    lines = text.split("\n")
    listed = {x for line in lines if (m := _EXPORT_LIST.match(line)) for x in _names(m[1])} if language == "typescript" else set()
    around = ""
    for n, line in enumerate(lines):
        if language == "typescript":
            yield from typescript_rows(n + 1, line)
        elif language == "go":
            around = m[1] if (m := _GO_FUNCTION.match(line)) else around
            if m := _ROUTE.search(line):
                yield {"kind": "route", "name": m[2].upper(), "detail": m[3], "parent": m[4], "start_line": n + 1, "names": [around, m[1]]}
        m = imports.match(line) if imports else None
        if m:
            names = re.findall(r"\w+", re.sub(r"\btype\b|\bas\b", " ", m.groupdict().get("names") or ""))
            yield {"kind": "import", "detail": m["source"], "start_line": n + 1, "names": names}
            continue
        found = next(((m, t) for p, t in declarations if (m := p.match(line))), None)
        if found:
            m, kind = found
            groups = m.groupdict()
            name = groups["name"]
            if language == "typescript" and kind in ("Function", "Class") and name[:1].isupper() and file.endswith("x"):
                kind = "Component"
            out = name in listed or _exported(language, name, line, bool(groups.get("out")))
            yield {"kind": "symbol", "name": name, "type": kind, "start_line": n + 1, "end_line": _block_end(lines, n), "exported": out, "parent": groups.get("parent"), "names": []}
            for how in ("extends", "implements"):
                for parent in re.findall(r"\w+", groups.get(how) or ""):
                    yield {"kind": "heritage", "name": name, "detail": how, "parent": parent}
        start = found[0].end() if found else 0
        for m in _CALL.finditer(line, start):
            if m[1] not in silent:
                yield {"kind": "call", "name": m[1], "start_line": n + 1}
        for m in _COMPONENT.finditer(line) if language == "typescript" else ():
            yield {"kind": "component", "name": m[1], "start_line": n + 1}


EXTRACTORS["python"] = python_rows


def extract(files: DataFrame) -> DataFrame:
    """ROW rows of (file, language, content): kinds symbol, call, import, heritage, component, reexport, type_use, api_constant, api_use, route, error."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ROW.split(", ")])
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, language, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    rows = list(extractors[language](file, text) if language in extractors else pattern_rows(language, file, text))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows = [{"kind": "error", "error": f"{type(e).__name__}: {e}"[:300]}]
                out += [{"file": file, "language": language} | r for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("file", "language", "content").mapInArrow(run, ROW)


def symbols(rows: DataFrame) -> DataFrame:
    """Symbol rows with ids prefix:kind:file:name:line, once per name and line."""
    own = rows.where("kind = 'symbol'").dropDuplicates(["file", "name", "start_line"])
    prefix = F.when(F.col("language") == "typescript", "ts").when(F.col("language") == "python", "py").otherwise(F.col("language"))
    node_id = F.concat_ws(":", prefix, F.lower("type"), "file", "name", F.col("start_line").cast("string"))
    test = F.col("file").rlike(r"(^|/)(tests?|__tests__|spec)/|[._](test|spec)\.|(^|/)test_")
    return own.select(
        F.xxhash64("file", "start_line", "name").alias("seq"), node_id.alias("id"), "name", "type", "file", "start_line", "end_line", "language",
        F.regexp_extract("file", r"^(.*)/", 1).alias("package"), "exported", test.alias("is_test"), F.col("parent").alias("receiver"),
    )


def extraction_stats(rows: DataFrame) -> DataFrame:
    """(language, files, symbols, calls, failed)."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("language").agg(F.count_distinct("file").alias("files"), count("symbol").alias("symbols"), count("call").alias("calls"), count("error").alias("failed"))


def build_graph(files: DataFrame, aliases: dict[str, str] | None = None):
    """The graph of a source tree: extracted rows, linked."""
    from ..storage import staged

    return link_rows(staged(extract(files)), files.select("file", "language"), aliases)


def link_rows(rows: DataFrame, file_table: DataFrame, aliases: dict[str, str] | None = None):
    """The graph of extracted rows and their (file, language) table.

    Reading sources is the costly part and goes file by file; linking always sees all rows, so an
    incremental index links calls between changed and unchanged files like a full one.
    """
    from ..functions.columns import route_prefix
    from ..graph import CodeGraph
    from ..operators import linking
    from ..storage import staged

    syms = staged(symbols(rows))
    raw_imports = rows.where("kind = 'import'").select("file", F.col("detail").alias("source"), "names", F.col("start_line").alias("line"))
    imports = linking.resolve_imports(raw_imports, file_table, aliases)
    calls = linking.link_calls(
        rows.where("kind = 'call'").select("file", F.col("name").alias("callee"), F.col("start_line").alias("line")),
        syms, imports.select("file", F.col("target").alias("source")),
    )
    heritage = rows.where("kind = 'heritage'").select(F.col("name").alias("child"), "file", "parent", F.col("detail").alias("kind"))
    typed = lambda df, t: df.select(F.lit(t).alias("type"), "source_id", "target_id", "confidence")
    defines = syms.select(F.concat(F.lit("file:"), "file").alias("source_id"), F.col("id").alias("target_id"), F.lit(1.0).alias("confidence"))
    files_in = imports.select(F.concat(F.lit("file:"), "file").alias("source_id"), F.concat(F.lit("file:"), "target").alias("target_id"), F.lit(1.0).alias("confidence")).distinct()
    components = linking.link_components(rows.where("kind = 'component'").select("file", "name"), syms)
    edges = typed(calls, "CALLS").unionByName(linking.link_heritage(heritage, syms)).unionByName(typed(linking.link_methods(syms), "HAS_METHOD"))
    reexports = rows.where("kind = 'reexport'").select("file", F.col("detail").alias("source"), "names")
    reexports = linking.resolve_imports(reexports, file_table, aliases).where("file <> target")
    passed = reexports.select("file", "target", F.lit(1.0).alias("confidence")).unionByName(linking.expand_barrels(imports, reexports))
    passed = passed.select(F.concat(F.lit("file:"), "file").alias("source_id"), F.concat(F.lit("file:"), "target").alias("target_id"), "confidence")
    files_in = files_in.unionByName(passed).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))
    uses = rows.where("kind = 'type_use'").select("file", "name", F.col("start_line").alias("line"))
    types = linking.link_usages(uses, syms, "USES_TYPE", 0.8, linking.CLASS_TYPES)
    routes = rows.where("kind = 'route'").select(
        F.col("name").alias("method"), F.concat(route_prefix(F.col("names")[0], F.col("names")[1]), "detail").alias("pattern"), F.col("parent").alias("handler")
    )
    constants = rows.where("kind = 'api_constant'").select("file", F.col("name").alias("key"), F.col("detail").alias("pattern"))
    asked = rows.where("kind = 'api_use'").select("file", F.col("start_line").alias("line"), F.col("name").alias("key"), F.col("detail").alias("pattern"), F.col("parent").alias("method"))
    api = linking.link_routes(routes, linking.api_calls(asked, constants, syms), syms)
    api = api.groupBy("type", "source_id", "target_id").agg(F.max("confidence").alias("confidence"), F.min("metadata").alias("metadata"))
    edges = edges.unionByName(typed(defines, "DEFINES")).unionByName(typed(files_in, "IMPORTS")).unionByName(components).unionByName(types)
    edges = edges.unionByName(api, allowMissingColumns=True)
    edge_id = F.concat_ws(":", "type", "source_id", "target_id")
    edges = edges.select(F.xxhash64("type", "source_id", "target_id").alias("edge_seq"), edge_id.alias("id"), "type", "source_id", "target_id", "confidence", "metadata")
    nodes = syms.withColumnRenamed("seq", "node_seq").unionByName(
        file_table.select(F.xxhash64("file").alias("node_seq"), F.concat(F.lit("file:"), "file").alias("id"), F.col("file").alias("name"), F.lit("File").alias("type"), "file", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "language", F.lit(False).alias("exported")),
        allowMissingColumns=True,
    )
    return CodeGraph.of(nodes, edges)


ROUTE = r"(\w+)\.(Get|Post|Put|Patch|Delete)\(\"([^\"]+)\".*?h\.(\w+)\)"


def go_routes(lines: DataFrame) -> DataFrame:
    """(method, pattern, handler) of router lines (file, n, line), with the prefix of the function around each."""
    from pyspark.sql import Window

    from ..functions.columns import normalize_pattern, route_prefix

    func = F.regexp_extract("line", r"^func\s+(\w+)\(", 1)
    rows = lines.withColumn("func", F.last(F.when(func != "", func), ignorenulls=True).over(Window.partitionBy("file").orderBy("n")))
    part = lambda k: F.regexp_extract(F.trim("line"), ROUTE, k)
    rows = rows.where(F.trim("line").rlike(ROUTE))
    pattern = F.concat(route_prefix(F.coalesce("func", F.lit("")), part(1)), part(3))
    return rows.select(F.upper(part(2)).alias("method"), pattern.alias("pattern"), part(4).alias("handler"), normalize_pattern(pattern).alias("normalized"))


def api_constants(files: DataFrame) -> DataFrame:
    """(key, pattern, normalized) of API paths in (file, content): string members and template functions."""
    from ..functions.columns import normalize_pattern

    text = r"(\w+):\s*\"(/api/v1/[^\"]+)\""
    template = r"(\w+):\s*\([^)]*\)\s*=>\s*`(/api/v1/[^`]+)`"
    out = None
    for p in (text, template):
        hit = files.select(F.explode(F.regexp_extract_all("content", F.lit(p), 0)).alias("m"))
        hit = hit.select(F.regexp_extract("m", p, 1).alias("key"), F.regexp_extract("m", p, 2).alias("pattern"))
        out = hit if out is None else out.unionByName(hit)
    return out.select("*", normalize_pattern("pattern").alias("normalized"))
