"""Source trees as DataFrames, hashing, and what changed since the last index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_language

MOST_BYTES = 1_000_000
#: Folders that are never sources; hidden ones are skipped as well (fixed values).
SKIPPED = ("node_modules", "vendor", "target", "build", "dist", "out", "venv", "__pycache__", "bin", "obj")


def scan_sources(spark: SparkSession, root: str, glob: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(file, language, content, length, hash) of source files below root: known endings, up to MOST_BYTES, no skipped, ignored or hidden folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).where(F.col("length") <= MOST_BYTES)
    base = F.lit(root.rstrip("/").split("://")[-1] + "/")
    path = F.regexp_replace("path", r"^\w+:/*", "/")
    rows = rows.withColumn("file", F.element_at(F.split(path, base, 2), -1))
    folders = F.slice(F.split("file", "/"), 1, F.greatest(F.size(F.split("file", "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED, *ignore))
    rows = rows.where(~hidden).withColumn("language", file_language("file")).where("language IS NOT NULL")
    return rows.select("file", "language", F.decode("content", "UTF-8").alias("content"), "length", F.sha2("content", 256).alias("hash"))


def scan_typescript(spark: SparkSession, root: str) -> DataFrame:
    return scan_sources(spark, root, "*.{ts,tsx}").where(~F.col("file").endswith(".d.ts"))


def scan_named(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Sources whose file name matches a pattern, ignoring case."""
    return scan_sources(spark, root).where(F.element_at(F.split("file", "/"), -1).rlike(f"(?i){pattern}"))


def content_hash(column: str = "content"):
    return F.sha2(F.col(column), 256)


def compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file, status) of two (file, hash) tables: new, changed, unchanged or deleted."""
    a, b = previous.select("file", F.col("hash").alias("was")), current.select("file", F.col("hash").alias("now"))
    rows = a.join(b, "file", "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return rows.select("file", status.alias("status"))


def carry_over(previous, new, status: DataFrame):
    """The new graph plus the old one's unchanged files; edges only with both ends, ids of the new graph winning."""
    from ..graph import CodeGraph
    from .graph_store import without_dangling

    same = status.where("status = 'unchanged'")
    nodes = previous.nodes.join(same, "file", "left_semi").join(new.nodes.select("id"), "id", "left_anti").select(*new.nodes.columns)
    nodes = new.nodes.unionByName(nodes)
    key = ["type", "source_id", "target_id"]
    edges = new.edges.unionByName(previous.edges.join(new.edges.select(*key), key, "left_anti").select(*new.edges.columns))
    return without_dangling(CodeGraph.of(nodes, edges))


#: What a manifest's text tells of the stack: (file, text in it, name); fixed values.
STACK = (
    *(("package.json", f'"{key}":', name) for key, name in (
        ("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("@angular/core", "Angular"), ("express", "Express"),
        ("@nestjs/core", "NestJS"), ("fastify", "Fastify"), ("vite", "Vite"), ("vitest", "Vitest"), ("jest", "Jest"),
        ("tailwindcss", "Tailwind"), ("prisma", "Prisma"),
    )),
    ("go.mod", "gin-gonic/gin", "Gin"), ("go.mod", "labstack/echo", "Echo"), ("go.mod", "gofiber/fiber", "Fiber"), ("go.mod", "go-chi/chi", "Chi"),
    *((file, text, name) for file in ("requirements.txt", "pyproject.toml", "Pipfile") for text, name in (
        ("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"), ("pytest", "pytest"),
    )),
    ("Cargo.toml", "actix", "Actix"), ("Cargo.toml", "axum", "Axum"), ("Cargo.toml", "rocket", "Rocket"), ("Cargo.toml", "tokio", "Tokio"),
    ("Dockerfile", "", "Docker"),
)
#: Of these manifests the first that exists counts.
PYTHON_MANIFESTS = ("requirements.txt", "pyproject.toml", "Pipfile")


def tech_stack(manifests: DataFrame) -> DataFrame:
    """(name) found in (file, content) manifests of a project."""
    table = manifests.sparkSession.createDataFrame(list(STACK), "manifest string, needle string, name string")
    rows = manifests.withColumn("manifest", F.element_at(F.split("file", "/"), -1))
    rank = F.array_position(F.array(*map(F.lit, PYTHON_MANIFESTS)), F.col("manifest"))
    first = rows.where(rank > 0).agg(F.min(rank).alias("first"))
    chosen = rows.join(F.broadcast(first)).where((rank == 0) | (rank == F.col("first")))  # one row
    text = F.regexp_replace(F.when(rank > 0, F.lower("content")).otherwise(F.col("content")), r'"\s+:', '":')
    found = chosen.join(F.broadcast(table), "manifest").where(text.contains(F.col("needle"))).select("name")
    workflows = manifests.where(F.col("file").contains(".github/workflows/")).select(F.lit("GitHub Actions").alias("name"))
    return found.unionByName(workflows).distinct().orderBy("name")
