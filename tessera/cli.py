"""The command line: ``python -m tessera.cli COMMAND``. Exit codes: 0 done, 1 a gate failed, 2 bad usage or unknown name, 3 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import session
from tessera.engine import Engine
from tessera.functions.storage import stored
from tessera.operators import crypto, graph, safety
from tessera.plans import export
from tessera.sources import git


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command")

    def add(name, *flags, path=True):
        c = sub.add_parser(name)
        if path:
            c.add_argument("path", nargs="?", default=".")
        for f in flags:
            c.add_argument(f, action="store_true")
        return c

    c = add("analyze", "--json", "--include-tests", "--no-color")
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("--output")
    add("cycles", "--json", "--fail-on-cycles", "--include-tests")
    c = add("impact", "--json", "--suggest-tests", "--no-color", path=False)
    c.add_argument("name")
    c.add_argument("--path", default=".")
    c.add_argument("-d", "--depth", type=int, default=3)
    c = add("trace", "--no-color", path=False)
    c.add_argument("start")
    c.add_argument("goal")
    c.add_argument("--path", default=".")
    c.add_argument("--max-hops", type=int, default=10)
    c = add("diff-impact", "--no-color", path=False)
    c.add_argument("base", nargs="?", default="")
    c.add_argument("--path", default=".")
    c.add_argument("-d", "--depth", type=int, default=3)
    c.add_argument("-o", "--output")
    c.add_argument("--fail-on-cycles", default="true")
    c = add("prepare", path=False)
    c.add_argument("-t", "--target", required=True)
    c.add_argument("--path", default=".")
    c.add_argument("-o", "--output", default=".tessera-plan.json")
    c = add("verify", path=False)
    c.add_argument("--plan", default=".tessera-plan.json")
    c.add_argument("--path", default=".")
    add("sarif", "--include-tests").add_argument("-o", "--output", default="tessera.sarif")
    c = add("scan", "--include-tests", "--fail-on-findings", "--no-default-rules", "--no-color", "--demo-rule")
    c.add_argument("-o", "--output")
    c.add_argument("--format", default="table", choices=["table", "json", "sarif", "html"])
    add("cbom", "--include-tests").add_argument("-o", "--output", default="crypto-bom.json")
    for name, text in (("inventory", "text"), ("pqc", "table")):
        c = add(name, "--include-tests", "--json", "--no-color")
        c.add_argument("-o", "--output")
        c.add_argument("--format", default=text, choices=[text, "json"])
        if name == "pqc":
            c.add_argument("--max-depth", type=int, default=10)
    return p


#: Groups that may stand before some commands.
GROUPS = {"security": {"scan"}, "crypto": {"inventory", "cbom", "pqc"}}


def ungrouped(argv: list[str]) -> list[str]:
    """``security scan ...`` and ``crypto pqc ...`` as ``scan ...`` and ``pqc ...``."""
    return argv[1:] if len(argv) > 1 and argv[1] in GROUPS.get(argv[0], ()) else argv


def _is_json(args: argparse.Namespace) -> bool:
    return args.json or args.format == "json" or (args.output or "").lower().endswith(".json")


def _write(root: str, output: str | None, text: str) -> None:
    if not output:
        print(text)
        return
    path = output if os.path.isabs(output) else os.path.join(root, output)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _json(x: dict) -> str:
    return json.dumps(x, indent=2, default=str)


def _assessed(e: Engine, depth: int):
    """Assessments, without a graph if some source couldn't be parsed or the graph can't be made."""
    error = None
    try:
        broken = e.errors.select("path").distinct().count()
        if broken:
            error = f"Graph analysis incomplete: {broken} files with errors"
        rows = stored(e.assessments(depth, not broken), "assessments")
    except (PySparkException, RuntimeError, ValueError) as failure:
        error = f"Graph analysis incomplete: {type(failure).__name__}"
        rows = stored(e.assessments(depth, False), "assessments")
    if error:
        print(error, file=sys.stderr)
    return e.ranked(rows), error


def _security(e: Engine, rows: list[dict]) -> dict:
    """What a security page shows: findings, inventory and assessment."""
    assessed, error = _assessed(e, 10)
    summary = crypto.summary(e.described, e.assets).first().asDict()
    families = {r["asset_family"]: r["n"] for r in crypto.breakdown(e.described, "asset_family").collect()}
    inventory = export.inventory(summary | {"familyCounts": families}, e.assets)
    pqc = export.assessment(assessed, e.described, error)
    errors = [r.asDict() for r in e.errors.collect()] + [{"path": rule, "error": error} for rule, error in e.rule_errors]
    return {"repositoryName": os.path.basename(e.root), "errors": errors, "findings": rows, "inventory": inventory["summary"], "assets": inventory["assets"], "pqc": pqc["summary"], "assessments": pqc["assessments"]}


def run(args: argparse.Namespace, spark) -> int:
    root = args.path
    if not os.path.isdir(root):
        print(f"no such folder: {root}", file=sys.stderr)
        return 2
    e = Engine(spark, os.path.abspath(root), getattr(args, "include_tests", args.command in ("impact", "trace", "diff-impact", "prepare")))
    if args.command == "analyze":
        payload = export.analysis(e.units.count(), e.vertices.count(), e.edges.count(), e.cycles.count(), e.hotspots, args.output)
        if args.output:
            _write(root, os.path.join(args.output, "report.html"), export.page("Architecture", payload | export.architecture(e)))
        if args.json:
            print(_json(payload))
        elif not args.quiet:
            print(export.markdown("Architecture", {"hotspots": e.hotspots.orderBy("position").limit(10), "risk": e.risk.orderBy(F.desc("overall"), "position").limit(10)}))
        return 0
    if args.command == "cycles":
        report = export.cycle_report(e.cycles)
        print(_json(report) if args.json else "\n".join([f"{report['totalCycles']} cycles", *[c["cyclePath"] for c in report["cycles"]]]))
        return int(args.fail_on_cycles and report["totalCycles"] > 0)
    if args.command == "impact":
        found = e.impact(args.name, args.depth)
        if found is None:
            print(f"unknown type: {args.name}", file=sys.stderr)
            return 2
        target, reached = found
        scores = e.hotspots.select("id", F.col("rank").alias("score"))
        total = graph.impact(reached, scores).first()
        degree = graph.degrees(e.edges).where(F.col("id") == target).first()
        tests = reached.where(graph.is_test(F.col("id"))).select("id")
        out = export.impact(target, degree["in_degree"] if degree else 0, reached, total["risk"] if total else 0.0, tests)
        if args.suggest_tests:
            impacted = reached.select("id").union(spark.createDataFrame([(target,)], "id string")).select(F.element_at(F.split("id", r"[.$]"), -1).alias("simple_name"))
            out["suggestedTests"] = sorted({r["file"] for r in safety.suggested_tests(e.vertices, impacted).collect()})
        print(_json(out) if args.json else f"{target}: {out['totalBlastRadius']} callers, risk {out['cumulativeRisk']}\n" + export.tree(target, graph.caller_tree(e.edges, target, args.depth)) + "".join(f"\ntest: {t}" for t in out["recommendedTestScope"] + out.get("suggestedTests", [])))
        return 0
    if args.command == "trace":
        path = e.trace(args.start, args.goal, args.max_hops)
        if path is None:
            print("unknown type", file=sys.stderr)
            return 2
        rows = path.collect()
        print("\n".join(f"{r['hop']}. {r['src']} -> {r['dst']} ({r['call_count']} calls)" for r in rows) or "no path")
        return 0
    if args.command == "diff-impact":
        parts = e.diff_impact(args.base, args.depth)
        cycles = e.cycles.count()
        status = "Failed (Cycles)" if cycles else "Passed (Clean)"
        text = f"Status: {status}\n\n" + export.markdown("Change impact", parts)
        if args.output:
            with open(args.output, "w") as f:
                f.write(text)
        else:
            print(text)
        return int(cycles > 0 and str(args.fail_on_cycles).lower() != "false")
    if args.command == "prepare":
        plan = safety.plan(e.vertices, e.edges, args.target)
        if plan is None:
            print(f"unknown type: {args.target}", file=sys.stderr)
            return 2
        _write(root, args.output, _json(plan))
        return 0
    if args.command == "verify":
        path = args.plan if os.path.isabs(args.plan) else os.path.join(root, args.plan)
        if not os.path.exists(path):
            print(f"no plan: {path}", file=sys.stderr)
            return 2
        with open(path) as f:  # Spark's readers pass over files with a leading dot
            plan = json.load(f)
        allowed = spark.createDataFrame([(x,) for x in plan.get("allowedModifiedFiles", [])], "file string")
        bad = [r["file"] for r in safety.violations(git.modified(spark, root), allowed, args.plan).collect()]
        print("\n".join(f"scope violation: {f}" for f in bad) or "passed")
        return int(bool(bad))
    if args.command in ("scan", "sarif"):
        registry = crypto.Registry(()) if getattr(args, "no_default_rules", False) else crypto.Registry()
        found = e.demonstration_findings() if getattr(args, "demo_rule", False) else e.findings(registry)
        for rule, error in e.rule_errors:
            print(f"rule {rule} failed: {error}", file=sys.stderr)
        output = args.output or ""
        shape = "sarif" if args.command == "sarif" or output.endswith(".sarif") else "html" if output.endswith((".html", ".htm")) else args.format
        if args.command == "sarif":
            found = found.unionByName(e.architectural_findings(), allowMissingColumns=True)
        rows = [export.finding(r) for r in crypto.ordered(found).collect()]
        text = {"sarif": lambda: _json(export.sarif(found, registry)), "json": lambda: _json({"findings": rows}), "html": lambda: export.page("Findings", _security(e, rows))}.get(shape, lambda: export.markdown("Findings", {"findings": crypto.ordered(found)}))()
        _write(root, args.output, text)
        return int(getattr(args, "fail_on_findings", False) and bool(rows))
    if args.command == "inventory":
        summary = crypto.summary(e.described, e.assets).first().asDict()
        _write(root, args.output, _json(export.inventory(summary, e.assets)) if _is_json(args) else export.markdown("Cryptographic inventory", {"assets": e.assets}))
        return 0
    if args.command == "cbom":
        _write(root, args.output, _json(export.cbom(e.assets, e.described, os.path.basename(e.root))))
        return 0
    if args.command == "pqc":
        rows, error = _assessed(e, args.max_depth)
        text = _json(export.assessment(rows, e.described, error)) if _is_json(args) else export.markdown("Post-quantum assessment", {"assessments": rows})
        _write(root, args.output, text)
        return 0
    return 2


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    try:
        args = p.parse_args(ungrouped(sys.argv[1:] if argv is None else argv))
    except SystemExit as e:
        return 2 if e.code else 0
    if not args.command:
        p.print_help()
        return 0
    try:
        return run(args, spark or session.build())
    except (OSError, ValueError, RuntimeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
