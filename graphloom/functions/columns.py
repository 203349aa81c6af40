"""Column functions: tokenizers, predicates and scalar rules of the code-graph domain."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def camel_split(text: Column | str) -> Column:
    """A space at aA and AAa boundaries."""
    text = F.regexp_replace(_col(text), r"([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def search_tokens(text: Column | str) -> Column:
    """Ranking tokens: camel case and letter/digit boundaries split, other than ASCII letters and digits dropped."""
    text = F.regexp_replace(camel_split(F.coalesce(_col(text), F.lit(""))), r"([a-zA-Z])(\d)", "$1 $2")
    text = F.regexp_replace(text, r"(\d)([a-zA-Z])", "$1 $2")
    return F.transform(F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda t: t != ""), F.lower)


def index_tokens(text: Column | str) -> Column:
    """Prefix-search tokens: split at _ - . / \\ and camel case, digits stay with their letters."""
    spaced = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[_\-./\\]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return _words(F.lower(spaced))


def name_tokens(text: Column | str) -> Column:
    """find's tokens: _ and . and camel case split; a hyphen stays."""
    return _words(F.lower(camel_split(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[_.]", " "))))


def wildcard_regex(pattern: str) -> str:
    """* and ? as wildcards, anchored, ignoring case; everything else literal."""
    return "(?is)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


#: Test-file predicates by the place that applies each (fixed patterns).
TEST_FILE = {
    "process": r"\.(test|spec|_test)\.[^.]+$|[\\/](test|tests|__tests__|__test__|spec|specs)[\\/]|[\\/]fixtures?[\\/]",
    "tools": r"(?i)[._]test\.|[._]spec\.|__tests__|test\/|tests\/|_test\.go$",
    "extractor": r"\.test\.[tj]sx?$|\.spec\.[tj]sx?$|_test\.[tj]sx?$|[\\/]__tests__[\\/]|[\\/]test[\\/]",
    "typescript": r"\.test\.[tj]sx?$|\.spec\.[tj]sx?$|_test\.[tj]sx?$|[\\/]__tests__[\\/]|[\\/]test[\\/]",
    "watcher": r"\.test\.|\.spec\.",
}


def is_test_file(file: Column | str, variant: str = "tools") -> Column:
    return F.coalesce(_col(file), F.lit("")).rlike(TEST_FILE[variant])


#: Framework patterns, first match wins: (pattern, framework, multiplier). Fixed values.
PATH_FRAMEWORKS = (
    (r"/pages/api/", "nextjs", 2.0), (r"/app/.*/route\.(ts|js)$", "nextjs", 2.0), (r"/pages/.*\.(tsx|jsx)$", "nextjs", 1.5),
    (r"/app/.*/page\.(tsx|jsx)$", "nextjs", 1.5), (r"/routes?/", "express", 1.8), (r"/middleware/", "express", 1.3),
    (r"/controllers?/", "express", 1.8), (r"\.controller\.(ts|js)$", "nestjs", 2.0), (r"\.service\.(ts|js)$", "nestjs", 1.5),
    (r"\.module\.(ts|js)$", "nestjs", 1.2), (r"\.guard\.(ts|js)$", "nestjs", 1.3), (r"/views?\.(py)$", "django", 2.0),
    (r"/urls?\.(py)$", "django", 1.5), (r"/models?\.(py)$", "django", 1.3), (r"/serializers?\.(py)$", "django", 1.5),
    (r"/app\.(py)$", "flask", 2.0), (r"/routers?/", "fastapi", 1.8), (r"/handlers?/", "go-http", 1.8), (r"/cmd/", "go-cli", 2.0),
    (r"main\.go$", "go", 2.0), (r"Controller\.(java|kt)$", "spring", 2.0), (r"Service\.(java|kt)$", "spring", 1.5),
    (r"Repository\.(java|kt)$", "spring", 1.3), (r"main\.rs$", "rust", 2.0), (r"lib\.rs$", "rust", 1.5), (r"/handlers?\.rs$", "rust", 1.8),
    (r"\.(test|spec|e2e)\.(ts|js|tsx|jsx|py|go|rs|java)$", "test", 0.1), (r"/tests?/", "test", 0.1), (r"/__tests__/", "test", 0.1),
)
NAME_FRAMEWORKS = (
    (r"^(get|post|put|delete|patch)[A-Z]", "rest", 1.5), (r"^handle[A-Z]", "handler", 1.8), (r"^on[A-Z]", "event", 1.5),
    (r"^(use|create)[A-Z].*Hook$", "react", 1.3), (r"^main$", "entry", 2.0), (r"^(init|setup|bootstrap|start)$", "entry", 1.8),
)


def _first_match(text: Column, patterns) -> Column:
    """Place of the first pattern found in text, from 1; null without any."""
    out = F.when(text.rlike(patterns[0][0]), F.lit(1))
    for place, p in enumerate(patterns[1:], 2):
        out = out.when(text.rlike(p[0]), F.lit(place))
    return out


def _pick(patterns, field: int, place: Column) -> Column:
    return F.get(F.array(*[F.lit(p[field]) for p in patterns]), place - 1)


def framework(file: Column | str, name: Column | str) -> tuple[Column, Column]:
    """(framework, multiplier): the higher of the path's and the name's, the path's on a tie; else unknown and 1."""
    path, name = F.regexp_replace(F.coalesce(_col(file), F.lit("")), r"\\", "/"), F.coalesce(_col(name), F.lit(""))
    hints = F.array(
        *[
            F.struct(_pick(table, 2, place).alias("multiplier"), F.lit(rank).alias("rank"), _pick(table, 1, place).alias("name"))
            for rank, table, place in ((1, PATH_FRAMEWORKS, _first_match(path, PATH_FRAMEWORKS)), (0, NAME_FRAMEWORKS, _first_match(name, NAME_FRAMEWORKS)))
        ]
    )
    best = F.array_max(F.filter(hints, lambda h: h["multiplier"].isNotNull()))
    return F.coalesce(best["name"], F.lit("unknown")), F.coalesce(best["multiplier"], F.lit(1.0))


#: Entry-point names, for all languages and by language. Fixed values.
ENTRY_NAMES = {
    "*": (
        r"(?i)^(main|init|bootstrap|start|run|setup|configure|app)$", r"^handle[A-Z]", r"^on[A-Z]",
        r"(?i)^(get|post|put|delete|patch)(Handler)?$", r"(?i)^(create|register|subscribe|dispatch|emit)$",
        r"Controller$", r"Handler$", r"Middleware$", r"Command$", r"Router$",
    ),
    "typescript": (r"^use[A-Z]", r"^render[A-Z]", r"^app\.", r"Server$", r"Route$", r"Plugin$"),
    "python": (r"(?i)^(cli|main|app|run)$", r"_handler$", r"_view$", r"_command$", r"^test_"),
    "go": (r"^(main|Run|Start|Serve|Listen)$", r"Handler$", r"^New[A-Z]", r"Server$"),
    "java": (r"^do(Get|Post|Put|Delete)$", r"^create[A-Z]", r"^build[A-Z]", r"Service$", r"Controller$"),
    "rust": (r"^(main|run|start|new)$", r"^handle_", r"_handler$"),
}
#: Helper names. Fixed values.
HELPER_NAMES = (
    r"^(get|set|is|has|can|should|will|did)[A-Z]", r"^_", r"^(to|from|as|into)[A-Z]",
    r"(?i)^(parse|format|validate|sanitize|normalize|encode|decode)", r"Helper$", r"Util(s)?$",
    r"^(map|filter|reduce|find|some|every|forEach)$", r"(?i)^(log|debug|warn|error|trace|info)$",
)


def _any(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether name has one of the patterns, each with its own flags."""
    return name.rlike("|".join(f"(?:{p})" for p in patterns))


def is_entry_name(name: Column | str, language: Column | str) -> Column:
    name, language = _col(name), _col(language)
    own = F.lit(False)
    for lang, patterns in ENTRY_NAMES.items():
        if lang != "*":
            own = own | ((language == lang) & _any(name, patterns))
    return _any(name, ENTRY_NAMES["*"]) | F.coalesce(own, F.lit(False))


def is_helper_name(name: Column | str) -> Column:
    return _any(_col(name), HELPER_NAMES)


#: File name endings and their languages (fixed values).
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".py": "python", ".pyw": "python", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin",
    ".kts": "kotlin", ".swift": "swift",
}
#: Endings of files that a watcher follows (fixed values).
WATCHED = (".ts", ".tsx", ".go", ".py", ".rs", ".java", ".c", ".cpp", ".rb", ".php", ".kt", ".swift", ".cs")


def is_watched(file: Column | str) -> Column:
    file = _col(file)
    ending = F.regexp_extract(file, r"(\.[^.]*)$", 1)
    return ending.isin(*WATCHED) & ~is_test_file(file, "watcher") & ~file.endswith(".d.ts")


def file_language(file: Column | str) -> Column:
    """Language by the last dot's ending, case-sensitive; null for others."""
    ending = F.regexp_extract(_col(file), r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, lang in EXTENSIONS.items():
        out = F.when(ending == e, F.lit(lang)).otherwise(out)
    return out


def package_of(file: Column | str) -> Column:
    """The path before the last slash."""
    return F.regexp_extract(_col(file), r"^(.*)/", 1)


def ts_package(file: Column | str, app: str = ".") -> Column:
    """Folders between an app's src and the file; root (or the app) for files elsewhere or right in src."""
    file, prefix = _col(file), "src/" if app == "." else f"{app}/src/"
    folder = F.regexp_extract(F.substring(file, len(prefix) + 1, 1 << 20), r"^(.*)/", 1)
    inside = F.when(folder != "", folder).otherwise(F.lit("root"))
    return F.when(file.startswith(prefix), inside).otherwise(F.lit("root" if app == "." else app))


def normalize_pattern(path: Column | str) -> Column:
    """A route or API path without its prefix, parameters as *, without query and outer slashes."""
    path = F.regexp_replace(_col(path), r"^/api/v1/", "")
    path = F.regexp_replace(path, r":[^/]+", "*")
    path = F.regexp_replace(path, r"\$\{[^}]+\}", "*")
    path = F.regexp_replace(path, r"\?.*$", "")
    return F.regexp_replace(path, r"^/+|/+$", "")


def route_prefix(func: Column | str, variable: Column | str) -> Column:
    func, variable = _col(func), _col(variable)
    setup = func == "Setup"
    return (
        F.when(setup & (variable == "app"), F.lit(""))
        .when(setup & (variable == "v1"), F.lit("/api/v1"))
        .when(setup & (variable == "tools"), F.lit("/api/v1/tools"))
        .when((func == "registerAdminRoutes") & (variable == "a"), F.lit("/api/v1/admin"))
        .otherwise(F.lit("/api/v1"))
    )


def capitalized(text: Column | str) -> Column:
    text = _col(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def mermaid_id(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[^a-zA-Z0-9_]", "_")


def half_up(x: Column, digits: int = 1) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is null; accumulated in double."""
    a, b = (F.transform(_col(x), lambda v: v.cast("double")) for x in (a, b))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(b, lambda v: v * v)))
    return F.when(norms == 0, 0.0).otherwise(total(F.zip_with(a, b, lambda x, y: x * y)) / norms)


def confidence_label(confidence: Column | str) -> Column:
    c = _col(confidence)
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


RELATION_WORDS = {
    "CALLS": "called", "IMPORTS": "imported", "HAS_METHOD": "has method", "IMPLEMENTS": "implemented",
    "USES_COMPONENT": "used", "CALLS_API": "API-called", "CONTAINS": "contained", "DEFINES": "defined",
}


def relation_word(edge_type: Column | str) -> Column:
    edge_type, out = _col(edge_type), F.lit("referenced")
    for t, word in RELATION_WORDS.items():
        out = F.when(edge_type == t, F.lit(word)).otherwise(out)
    return out
