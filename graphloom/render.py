"""Text reports from bounded results; everything here runs on collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .graph import CodeGraph
from .operators import export, lookup, review, traversal
from .plans import pattern


def _cell(x) -> str:
    return str("" if x is None else x).replace("|", "\\|").replace("\n", " ")


def table(rows: DataFrame, limit: int | None = None) -> str:
    """A markdown table; `limit` is the query's, to note that it was reached."""
    found = rows.collect()
    if not found:
        return "_No results._"
    lines = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns)]
    lines += [" | ".join(_cell(x) for x in r) for r in found]
    text = "\n".join(f"| {x} |" for x in lines)
    return text + (f"\n\n_Results truncated at {len(found)} rows._" if limit and len(found) >= limit else "")


def query(text: str, graph: CodeGraph, default_limit: int = pattern.DEFAULT_LIMIT) -> str:
    q = pattern.parse(text)
    return table(pattern.compile_query(q, graph, default_limit), q.limit or default_limit)


def _count(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def found(rows: DataFrame) -> str:
    out = rows.collect()
    if not out:
        return "No results found."
    lines = [f"**Found {_count(len(out), 'result')}**", ""]
    for r in out:
        lines.append(f"- **{r['name']}** ({r['type']}) [{'exported' if r['exported'] else 'unexported'}]")
        lines.append(f"  `{r['file']}:{r['line']}` — {r['package']}")
        lines.append(f"  {_count(r['callers'], 'caller')}, {_count(r['callees'], 'callee')}")
    return "\n".join(lines)


def impact(target, direction: str, rows: DataFrame) -> str:
    s = traversal.impact_summary(rows).first()
    who = "callers" if direction == "upstream" else "callees"
    lines = [
        f"# Impact Analysis: {target['name']}", "",
        f"**Target:** {target['name']} ({target['type']}) -- `{target['file']}:{target['start_line']}`",
        f"**Direction:** {direction}", f"**Risk:** {s['risk']}",
        f"**Summary:** {s['direct']} direct {who}, {s['total']} total affected", "",
    ]
    found_rows = rows.orderBy("depth", "rank").collect()
    for depth in sorted({r["depth"] for r in found_rows}):
        own = [r for r in found_rows if r["depth"] == depth and not r["is_test"]]
        if own:
            lines += [f"## d={depth}: {traversal.DEPTH_LABELS.get(depth, f'Depth {depth}')} ({len(own)})", ""]
            lines += [f"- **{r['name']}** ({r['type']}) -- `{r['file']}:{r['line']}` [{r['edge_type']}]" for r in own] + [""]
    if tests := [r for r in found_rows if r["is_test"]]:
        lines += [f"## Affected Tests ({len(tests)})", ""] + [f"- **{r['name']}** -- `{r['file']}:{r['line']}`" for r in tests] + [""]
    return "\n".join(lines)


def explain(target, rows: DataFrame, flows: DataFrame | None = None) -> str:
    lines = [f"# {target['name']} ({target['type']})", "", f"`{target['file']}:{target['start_line']}` — {target['package']}", ""]
    sections: dict[str, list] = {}
    for r in rows.collect():
        sections.setdefault(r["section"], []).append(r)
    for name, refs in sections.items():
        lines += [f"## {name.replace('_', ' ').capitalize()} ({len(refs)})", ""] + [f"- **{r['name']}** -- `{r['file']}:{r['line']}`" for r in refs] + [""]
    if flows is not None and (found := flows.collect()):
        lines += [f"## Flows ({len(found)})", ""] + [f"- **{r['name']}** -- step {r['step']} of {r['total']}" for r in found] + [""]
    return "\n".join(lines)


def rules(rows: DataFrame) -> str:
    by: dict[str, list] = {}
    for r in rows.collect():
        by.setdefault(r["rule"], []).append(r)
    lines = []
    for rule, items in by.items():
        lines += [f"## {rule} ({len(items)})", ""]
        lines += [f"- **{i['name']}**" + (f" `{i['file']}{':%d' % i['line'] if i['line'] else ''}`" if i["file"] else "") + f" — {i['detail']}" for i in items] + [""]
    return "\n".join(lines) or "No issues found."


def rename(edits: DataFrame, dry_run: bool = True) -> str:
    rows = edits.collect()
    if not rows:
        return "_No references found in the graph._"
    graph_edits = sum(r["confidence"] == "graph" for r in rows)
    lines = [
        f"# Rename: {rows[0]['old_name']} → {rows[0]['new_name']}", "",
        f"**Status:** {'DRY RUN (preview only)' if dry_run else 'APPLIED'}",
        f"**Files affected:** {len({r['file'] for r in rows})}",
        f"**Total edits:** {len(rows)} ({graph_edits} graph, {len(rows) - graph_edits} text_search)", "", "## Edit Plan", "",
    ]
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["file"], []).append(r)
    for file, own in by.items():
        lines += [f"### `{file}`", ""]
        lines += [f"- **Line {r['line']}:** `{r['old_name']}` → `{r['new_name']}` [{r['confidence']}] — {r['context']}" for r in own] + [""]
    return "\n".join(lines)


def review_report(parts: dict[str, DataFrame], title: str = "") -> str:
    risk, files = parts["risk"].first(), parts["files"].collect()
    if not files:
        return "# PR Review\n\n_No changes detected._"
    modified = parts["changed"].where("reason = 'modified'").count()
    affected = parts["affected"].orderBy("depth", "seed_seq", "rank").collect()
    direct = [a for a in affected if a["depth"] == 1]
    flows = parts["flows"].collect()
    lines = [
        f"# PR Review: {title}".rstrip(": "), "", "## Summary", f"- **Risk:** {risk['risk']}",
        f"- **Changed:** {len(files)} files, {modified} symbols modified",
        f"- **Blast radius:** {len(affected)} affected symbols ({len(direct)} direct, {len(affected) - len(direct)} indirect)",
    ]
    if flows:
        lines.append(f"- **Breaking flows:** {len(flows)} execution path(s) impacted")
    lines += ["", "## Per-File Analysis", ""]
    lines += [f"### `{f['file']}` — {f['risk']}" for f in files] + [""]
    if direct:
        lines += ["## Directly Affected (d=1)", ""]
        lines += [f"- **{a['name']}** ({a['type']}) ← via `{a['via']}` | `{a['file']}:{a['line']}`" for a in direct[:20]]
        lines += [f"_...and {len(direct) - 20} more_"] * (len(direct) > 20) + [""]
    if flows:
        lines += ["## Affected Execution Flows", ""]
        lines += [f"- **{f['name']}** — modified at {'entry point' if not f['step'] else 'step %d/%d' % (f['step'], f['total'])}" for f in flows] + [""]
    if first := parts["priorities"].collect():
        lines += ["## Review Priorities", ""] + [f"{n}. **{p['name']}** — {p['callers']} caller(s) | `{p['file']}`" for n, p in enumerate(first, 1)] + [""]
    return "\n".join(lines)


def mermaid(graph: CodeGraph, direction: str = "TD") -> str:
    """A flowchart of a bounded graph, nodes in a box for each package."""
    nodes = graph.nodes.orderBy("node_seq", "id").select("id", "package").collect()
    if not nodes:
        return f'graph {direction}\n  empty["No nodes match filter"]'
    text = {(r["part"], r["id"]): r["line"] for r in export.mermaid_lines(graph).collect()}
    lines, boxes = [f"graph {direction}"], {}
    for n in nodes:
        boxes.setdefault(n["package"] or "root", []).append(text["node", n["id"]])
    for package, own in boxes.items():
        box = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in package)
        lines += [f'    subgraph {box}["{package}"]'] + [f"        {x}" for x in own] + ["    end"]
    edges = graph.edges.orderBy("edge_seq", "id").select("id").collect()
    return "\n".join(lines + [f"    {text['edge', e['id']]}" for e in edges])


def overview(graph: CodeGraph) -> str:
    """The map report: totals, languages, packages, critical symbols."""
    totals = {r["what"]: r["n"] for r in graph.counts().collect()}
    lines = ["# Code Map", "", f"**{totals['nodes']} symbols, {totals['edges']} relationships**", "", "## Languages", ""]
    lines += [f"- {r['language']}: {r['n']}" for r in lookup.language_counts(graph).collect()]
    lines += ["", "## Packages", ""] + [f"- {r['package']}: {r['symbols']} symbols ({r['exported']} exported)" for r in lookup.package_summary(graph).collect()]
    lines += ["", "## Critical Symbols", ""] + [f"- {r['name']} ({r['type']}) — {r['callers']} callers" for r in lookup.critical_symbols(graph).collect()]
    return "\n".join(lines)


def stats_yaml(graph: CodeGraph) -> str:
    lines, kind = [], None
    for r in sorted(lookup.stats(graph).collect(), key=lambda r: (r["kind"], r["key"] or "")):
        if r["kind"] != kind:
            kind = r["kind"]
            lines.append(f"{kind}:")
        lines.append(f"  {r['key']}: {r['n']}")
    return "\n".join(lines)
