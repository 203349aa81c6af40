"""Command line: index, status, query and the tools; `python -m graphloom.cli index .`"""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

from . import config
from .engine import Engine
from .errors import GraphError, IndexStale
from .operators import community, guide, review
from .service import Service, http_server, stdio_server
from .session import local_session
from .sources import extract, graph_store, scan
from .storage import staged


def _commit(root: str) -> str:
    done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, check=False)
    return done.stdout.strip()


def _meta(spark, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}


def index(spark, settings: config.Config) -> None:
    """Reads new and changed files, links them with the rows kept of all others, names communities, and writes it all."""
    files = scan.scan_sources(spark, str(Path(settings.root).resolve()), ignore=settings.ignore)
    target = str(Path(settings.root, settings.index).resolve())
    hashes = staged(files.select("file", "language", "hash"))
    if Path(target, "rows").exists():
        status = scan.compare(spark.read.parquet(f"{target}/hashes"), hashes)
        fresh = files.join(status.where("status IN ('new', 'changed')"), "file", "left_semi")
        kept = spark.read.parquet(f"{target}/rows").join(status.where("status = 'unchanged'"), "file", "left_semi")
        rows = staged(extract.extract(fresh).unionByName(kept))
    else:
        rows = staged(extract.extract(files))
    graph = extract.link_rows(rows, hashes.select("file", "language"), settings.aliases | config.tsconfig_aliases(settings.root))
    graph = community.with_communities(graph.staged())
    new = f"{target}.new"
    graph_store.save(graph, new)
    rows.write.mode("overwrite").parquet(f"{new}/rows")
    hashes.write.mode("overwrite").parquet(f"{new}/hashes")
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    graph_store.set_meta(spark, None, repo=settings.repo, commit=_commit(settings.root), indexed_at=now).write.mode("overwrite").parquet(f"{new}/meta")
    shutil.rmtree(target, ignore_errors=True)
    Path(new).rename(target)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--root", default=".")
    tools = parser.add_subparsers(dest="tool", required=True)
    for name in ("index", "init", "status", "clean", "map", "guide", "rules", "changes", "serve", "stdio"):
        tools.add_parser(name)
    for name, what in (("query", "text"), ("find", "text"), ("explain", "symbol"), ("impact", "symbol"), ("export", "symbol")):
        tools.add_parser(name).add_argument(what)
    rename = tools.add_parser("rename")
    rename.add_argument("symbol")
    rename.add_argument("new_name")
    given = parser.parse_args(args)
    settings = config.load(given.root)
    path = str(Path(settings.root, settings.index).resolve())
    if given.tool == "init":
        print(config.init(given.root))
        return 0
    if given.tool == "clean":
        shutil.rmtree(path, ignore_errors=True)
        return 0
    spark = local_session()
    try:
        if given.tool == "index":
            index(spark, settings)
            return 0
        meta = _meta(spark, path)
        if given.tool == "status":
            if (now := _commit(settings.root)) != meta["commit"]:
                raise IndexStale(meta["commit"], now)
            print("\n".join(f"{k}: {v}" for k, v in sorted(meta.items())))
            return 0
        engine = Engine.load(spark, path)
        if given.tool == "guide":
            print(guide.agent_guide(engine.graph, meta["repo"]))
        elif given.tool == "changes":
            print(engine.report("changes", review.git_diff(spark, settings.root), review.changed_files(spark, settings.root)))
        elif given.tool == "serve":
            http_server(Service(engine, settings.root)).serve_forever()
        elif given.tool == "stdio":
            stdio_server(Service(engine, settings.root))
        elif given.tool == "export":
            print(engine.report("export", symbol=given.symbol))
        else:
            values = [v for k, v in vars(given).items() if k not in ("root", "tool")]
            print(engine.report(given.tool, *values))
    except GraphError as e:
        print(e.to_json(), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
