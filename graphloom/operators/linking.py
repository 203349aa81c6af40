"""Linking extracted rows into a graph: names to symbols, lines to enclosing symbols, imports to files, routes to calls.

Raw tables: symbols(seq, id, name, type, file, start_line, end_line, language, package, exported, is_test),
calls(file, callee, line), imports(file, source, names, line), heritage(child, file, parent, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_pattern

CLASS_TYPES = ("Class", "Struct", "Interface", "Trait", "Enum", "Type")


#: Blocks of lines are 1, 8, 64, ... long: 2 to the power of STEP times their level.
STEP = 3


def _level(lines: Column) -> Column:
    """The highest level with blocks no longer than so many lines."""
    return F.floor((F.length(F.bin(lines)) - 1) / STEP).cast("int")


def _blocks(symbols: DataFrame) -> DataFrame:
    """symbols with (__level, __block), one row for each of the fewest blocks that make up their lines, 2 * (2^STEP - 1) of a level at most."""
    start, end = F.col("start_line").cast("long"), F.col("end_line").cast("long") + 1
    level, side = F.col("__level"), F.lit(1 << STEP)
    whole = lambda n: (F.ceil(start / F.pow(F.lit(2.0), STEP * n)), F.floor(end / F.pow(F.lit(2.0), STEP * n)))
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    (first, last), (above, beyond) = whole(level), whole(level + 1)
    parts = F.when(above < beyond, F.concat(between(first, above * side), between(beyond * side, last))).otherwise(between(first, last))
    rows = symbols.where("start_line <= end_line").withColumn("__level", F.explode(F.sequence(F.lit(0), _level(end - start))))
    return rows.withColumn("__block", F.explode(parts))


def enclosing(points: DataFrame, symbols: DataFrame, narrowest: bool = True) -> DataFrame:
    """Adds source_id to (file, line): the narrowest symbol whose lines contain it, or the first; repeated rows stay once.

    A symbol's lines are cut into blocks, a block keeps only its best symbol, and a line looks up the block of each
    level that it lies in. The cost grows with the lines and the symbols, never with their product in a file.
    """
    width = [(F.col("end_line").cast("long") - F.col("start_line")).alias("width")] if narrowest else []
    best = F.min(F.struct(*width, "seq", "id")).alias("__best")
    table = _blocks(symbols).groupBy(F.col("file").alias("__file"), "__level", "__block").agg(best)
    lines = F.col("end_line").cast("long") - F.col("start_line") + 1
    top = symbols.where("start_line <= end_line").agg(F.max(_level(lines)).alias("__top"))  # one row
    rows = points.crossJoin(F.broadcast(top)).withColumn("__level", F.explode(F.sequence(F.lit(0), "__top")))
    rows = rows.withColumn("__block", F.floor(F.col("line") / F.pow(F.lit(2.0), STEP * F.col("__level"))))
    rows = rows.join(table.withColumnRenamed("__level", "__l").withColumnRenamed("__block", "__b"), (F.col("file") == F.col("__file")) & (F.col("__level") == F.col("__l")) & (F.col("__block") == F.col("__b")))
    return rows.groupBy(*points.columns).agg(F.min("__best").alias("__best")).select(*points.columns, F.col("__best.id").alias("source_id"))


def link_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS edges (source_id, target_id, confidence): the callee by name, another file's before the own, the first of those.

    0.7 within a file, 1.0 from an imported file, 0.4 otherwise; calls of a symbol to itself drop out. A name is
    reduced to its first symbol and the first of another file before calls meet it, so a name that very many
    files define costs each of its calls one row.
    """
    own = symbols.select("name", F.struct("seq", "id", "file").alias("at"))
    first = own.groupBy("name").agg(F.min("at").alias("first"))
    other = own.join(first, "name").where(F.col("at.file") != F.col("first.file")).groupBy("name").agg(F.min("at").alias("other"))
    names = first.join(other, "name", "left").withColumnRenamed("name", "callee")
    at = enclosing(calls.select("file", "callee", "line"), symbols).join(names, "callee")
    away = F.when(F.col("first.file") != F.col("file"), F.col("first")).otherwise(F.coalesce("other", "first"))
    rows = at.withColumn("to", away).select("file", "source_id", F.col("to.id").alias("target_id"), F.col("to.file").alias("t_file"))
    rows = rows.where("source_id <> target_id")
    known = imports.select(F.col("file"), F.col("source").alias("t_file")).distinct().withColumn("imported", F.lit(True))
    rows = rows.join(known, ["file", "t_file"], "left")
    sure = F.when(F.col("file") == F.col("t_file"), 0.7).when(F.col("imported"), 1.0).otherwise(0.4)
    return rows.groupBy("source_id", "target_id").agg(F.max(sure).alias("confidence"))


def link_heritage(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges: the child in its own file first, the parent by its first symbol; confidence 0.9."""
    by = symbols.select("name", "id", F.col("file").alias("s_file"), "seq")
    rows = heritage.withColumn("__row", F.monotonically_increasing_id())
    child = rows.join(by, rows["child"] == by["name"])
    best = Window.partitionBy("__row").orderBy(F.col("s_file") != F.col("file"), "seq")
    child = child.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("__row", "parent", "kind", F.col("id").alias("source_id"))
    first = Window.partitionBy("name").orderBy("seq")
    parent = by.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(F.col("name").alias("parent"), F.col("id").alias("target_id"))
    rows = child.join(parent, "parent").where("source_id <> target_id")
    kind = F.when(F.col("kind").isin("implements", "trait"), "IMPLEMENTS").otherwise("EXTENDS")
    return rows.select(kind.alias("type"), "source_id", "target_id", F.lit(0.9).alias("confidence")).distinct()


def link_methods(symbols: DataFrame) -> DataFrame:
    """HAS_METHOD edges: each Method to the first class-like symbol around it."""
    methods = symbols.where("type = 'Method'").select("file", F.col("start_line").alias("line"), F.col("id").alias("target_id"))
    rows = enclosing(methods, symbols.where(F.col("type").isin(*CLASS_TYPES)), narrowest=False)
    return rows.where("source_id <> target_id").select("source_id", "target_id", F.lit(1.0).alias("confidence"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(file, source, target): relative and aliased specifiers to files, five spellings tried in order."""
    base = F.regexp_extract("file", r"^(.*)/", 1)
    raw = F.when(F.col("source").startswith("."), F.concat_ws("/", base, "source"))
    for alias, root in sorted((aliases or {"@/": "src/"}).items()):
        raw = raw.when(F.col("source").startswith(alias), F.concat(F.lit(root), F.substring("source", len(alias) + 1, 1 << 20)))
    # a/./b and a/b/../c, folded segment by segment
    parts = F.aggregate(
        F.split(raw, "/"), F.array().cast("array<string>"),
        lambda out, p: F.when((p == ".") | (p == ""), out).when((p == "..") & (F.size(out) > 0), F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(p))),
    )
    path = F.array_join(parts, "/")
    tried = F.array(path, *[F.concat(path, F.lit(e)) for e in (".ts", ".tsx", "/index.ts", "/index.tsx")])
    rows = imports.withColumn("__row", F.monotonically_increasing_id()).where(raw.isNotNull())
    rows = rows.select("*", F.posexplode(tried).alias("__rank", "target"))
    rows = rows.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    best = Window.partitionBy("__row").orderBy("__rank")
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__rank", "__row")


def expand_barrels(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Imports of an index file passed on, one level: (file, target, names) with reexports (file, target, names).

    A re-export serves an import if it names one of its names, re-exports everything, or the import has no names.
    """
    barrel = imports.where(F.col("target").rlike(r"(^|/)index\.tsx?$")).withColumnRenamed("target", "barrel")
    via = reexports.select(F.col("file").alias("barrel"), F.col("target").alias("target"), F.col("names").alias("out"))
    rows = barrel.join(via, "barrel")
    serves = F.arrays_overlap("names", "out") | F.array_contains("out", "*") | (F.size("names") == 0)
    return rows.where(serves & (F.col("file") != F.col("target"))).select("file", "target", F.lit(0.9).alias("confidence")).distinct()


def name_map(symbols: DataFrame) -> DataFrame:
    """One symbol a name: the last exported one, else the first."""
    order = [F.desc("exported"), F.when(F.col("exported"), -F.col("seq")).otherwise(F.col("seq"))]
    best = Window.partitionBy("name").orderBy(*order)
    return symbols.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def link_usages(usages: DataFrame, symbols: DataFrame, edge_type: str, confidence: float, types: tuple[str, ...] = ()) -> DataFrame:
    """Edges for (file, name, line) usages of mapped names, of symbols of these types only, from the symbol around each."""
    at = enclosing(usages.select("file", "name", "line"), symbols)
    to = name_map(symbols.where(F.col("type").isin(*types)) if types else symbols).select("name", F.col("id").alias("target_id"))
    rows = at.join(to, "name").where("source_id <> target_id").select("source_id", "target_id").distinct()
    return rows.select(F.lit(edge_type).alias("type"), "source_id", "target_id", F.lit(confidence).alias("confidence"))


def link_components(usages: DataFrame, symbols: DataFrame) -> DataFrame:
    """USES_COMPONENT edges (0.9) for (file, name): from the file's only exported component, else from the file."""
    own = symbols.where("type = 'Component' AND exported").groupBy("file").agg(F.count("*").alias("n"), F.first("id").alias("only"))
    to = name_map(symbols.where("type = 'Component'")).select("name", F.col("id").alias("target_id"))
    rows = usages.select("file", "name").distinct().join(to, "name").join(own, "file", "left")
    source = F.when(F.col("n") == 1, F.col("only")).otherwise(F.concat(F.lit("file:"), "file"))
    rows = rows.select(source.alias("source_id"), "target_id").where("source_id <> target_id").distinct()
    return rows.select(F.lit("USES_COMPONENT").alias("type"), "source_id", "target_id", F.lit(0.9).alias("confidence"))


def api_calls(uses: DataFrame, constants: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, method, pattern) of uses (file, line, key, pattern, method) and of the files of constants (file, key, pattern).

    A use of a constant's key stands for its pattern, a path of its own for itself; the caller is the symbol around it.
    """
    known = constants.select("key", F.col("pattern").alias("known")).distinct()
    rows = uses.join(known, "key", "left").withColumn("pattern", F.coalesce("pattern", "known")).where("pattern IS NOT NULL")
    rows = enclosing(rows.select("file", "line", "method", "pattern"), symbols).select(F.col("source_id").alias("caller_id"), "method", "pattern")
    files = constants.select(F.concat(F.lit("file:"), "file").alias("caller_id"), F.lit(None).cast("string").alias("method"), "pattern")
    return rows.unionByName(files).distinct()


def link_routes(routes: DataFrame, constants: DataFrame, symbols: DataFrame) -> DataFrame:
    """CALLS_API edges from (caller_id, method, pattern) calls of constants to (method, pattern, handler) routes.

    They meet on the normalised path; the handler is a Method before a Function of that name; 0.6 with a
    wildcard in the path, else 0.9.
    """
    r = routes.select("method", "handler", normalize_pattern("pattern").alias("path"), F.col("pattern").alias("route"))
    c = constants.select("caller_id", F.col("method").alias("verb"), normalize_pattern("pattern").alias("path"))
    rows = c.join(r, "path").where(F.col("verb").isNull() | (F.col("verb") == F.col("method")))
    own = symbols.where(F.col("type").isin("Method", "Function"))
    best = Window.partitionBy("name").orderBy(F.col("type") == "Function", "seq")
    own = own.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(F.col("name").alias("handler"), F.col("id").alias("target_id"))
    rows = rows.join(own, "handler")
    sure = F.when(F.col("path").contains("*"), 0.6).otherwise(0.9)
    return rows.select(
        F.lit("CALLS_API").alias("type"), F.col("caller_id").alias("source_id"), "target_id", sure.alias("confidence"),
        F.struct(F.col("method").alias("http_method"), F.col("route").alias("url_pattern")).alias("metadata"),
    ).distinct()
