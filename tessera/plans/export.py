"""Results as documents: JSON, SARIF, CycloneDX, Markdown and a self-contained HTML page. Small tables, collected by their order."""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.javasrc import resolve
from tessera.operators import crypto

LEVELS = {"INFO": "note", "LOW": "note", "MEDIUM": "warning", "HIGH": "error", "CRITICAL": "error"}
FUNCTIONS = {
    "block-cipher": ["encrypt", "decrypt"], "stream-cipher": ["encrypt", "decrypt"], "pke": ["encrypt", "decrypt"], "hash": ["digest"], "signature": ["sign", "verify"],
    "mac": ["tag", "digest"], "key-agree": ["other"], "kdf": ["generate"], "drbg": ["generate"], "other": [],
}
MODES = ("cbc", "ecb", "ccm", "gcm", "cfb", "ofb", "ctr")


def analysis(files: int, vertices: int, edges: int, cycles: int, hotspots: DataFrame, report: str | None = None) -> dict:
    top = hotspots.orderBy("position").limit(10).collect()
    rows = [{"rank": r["position"], "fqcn": r["id"], "pageRank": r["rank"], "inDegree": r["in_degree"], "outDegree": r["out_degree"]} for r in top]
    return {"totalFiles": files, "totalClasses": vertices, "totalInvocations": edges, "totalCycles": cycles, "reportPath": report, "hotspots": rows}


def cycle_report(found: DataFrame) -> dict:
    rows = found.orderBy("component", "nth").collect()
    out = [{"length": r["length"], "cyclePath": " -> ".join(r["path"]), "classes": list(r["path"][:-1])} for r in rows]
    return {"totalCycles": len(out), "isTruncated": any(r["truncated"] for r in rows), "cycles": out}


def impact(target: str, in_degree: int, reached: DataFrame, risk: float, tests: DataFrame) -> dict:
    rows = reached.orderBy("depth", "id").collect()
    return {
        "targetClass": target.split(".")[-1].split("$")[-1], "targetFqcn": target, "inDegree": in_degree, "totalBlastRadius": len(rows), "cumulativeRisk": round(risk, 3),
        "directCallers": [r["id"] for r in rows if r["depth"] == 1], "transitiveCallers": {r["id"]: r["depth"] for r in rows}, "recommendedTestScope": sorted(r["id"] for r in tests.collect()),
    }


def finding(r) -> dict:
    name, advice = crypto.ADVICE.get(r["rule_id"], (r["rule_id"], ""))
    row = r.asDict()
    place = {"startLine": row["line"], "startColumn": row["col"], "endLine": row.get("end_line") or row["line"], "endColumn": row.get("end_col") or row["col"]}
    properties = {k: v for k, v in (("algorithm", row["raw"] if row["category"] in ("CRYPTOGRAPHY", "TLS") else None), ("cipherFamily", row.get("family")), tuple(row["status"].split("=", 1)) if row["status"] else ("", None)) if v}
    return {
        "ruleId": row["rule_id"], "ruleName": name, "category": row["category"], "severity": row["severity"], "message": row["message"], "filePath": row["path"], "location": place if row["line"] else None,
        "evidence": row.get("evidence") or row["message"], "remediation": advice, "cweId": row["cwe"], "confidence": "HIGH", "properties": properties,
    }


def sarif(found: DataFrame, registry: crypto.Registry | None = None) -> dict:
    """SARIF 2.1.0; rules that fired but aren't registered are made up from their findings."""
    rows = crypto.ordered(found).collect()
    known = {}
    for r in (registry or crypto.Registry()).rules:
        known.setdefault(r[0], {"id": r[0], "shortDescription": {"text": r[6].rstrip(": '") + "."}, "defaultConfiguration": {"level": LEVELS[r[3]]}, "properties": {"category": r[4], "cwe": r[5]}})
    for r in rows:
        known.setdefault(r["rule_id"], {"id": r["rule_id"], "shortDescription": {"text": r["rule_id"]}, "defaultConfiguration": {"level": LEVELS[r["severity"]]}})
    order = list(known)
    results = []
    for r in rows:
        where = {"artifactLocation": {"uri": (r["path"] or "").replace("\\", "/").lstrip("/")}}
        if r["line"]:
            where["region"] = {"startLine": r["line"], "startColumn": max(1, r["col"] or 1)}
        results.append({"ruleId": r["rule_id"], "ruleIndex": order.index(r["rule_id"]), "level": LEVELS[r["severity"]], "message": {"text": r["message"]}, "locations": [{"physicalLocation": where}], "properties": {"severity": r["severity"], "category": r["category"]}})
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "tessera", "rules": list(known.values())}}, "results": results}]}


def _padding(x: str | None) -> str | None:
    if x is None:
        return None
    flat = x.lower()
    for test, name in ((("nopadding", "none", "raw"), "raw"), (("pkcs5",), "pkcs5"), (("pkcs7",), "pkcs7"), (("pkcs1",), "pkcs1v15"), (("oaep",), "oaep")):
        if any(t in flat for t in test):
            return name
    return "other"


def cbom(assets: DataFrame, usages: DataFrame, name: str, when: datetime | None = None) -> dict:
    """A CycloneDX 1.6 bill of cryptographic materials; the time is its only part that isn't determined by the input."""
    places: dict[str, list] = {}
    for r in usages.select("key", "path", "line", "usage_id").distinct().orderBy("usage_id").collect():
        places.setdefault(r["key"], []).append({"location": r["path"], "line": r["line"]})
    out = []
    for r in assets.orderBy(F.desc("is_resolved"), F.lower("asset_family"), F.lower("name"), "asset_id").collect():
        kind = crypto.CYCLONE.get(r["primitive"], "other")
        properties: dict = {"assetType": "protocol" if r["primitive"] == "TLS_PROTOCOL" else "algorithm"}
        if r["primitive"] == "TLS_PROTOCOL":
            properties["protocolProperties"] = {"type": "tls"}
        else:
            own = {"primitive": kind, "cryptoFunctions": FUNCTIONS.get(kind, [])}
            if r["mode"]:
                own["mode"] = r["mode"].lower() if r["mode"].lower() in MODES else "other"
            if r["padding"]:
                own["padding"] = _padding(r["padding"])
            properties["algorithmProperties"] = own
        out.append({"type": "cryptographic-asset", "bom-ref": r["asset_id"], "name": r["name"], "cryptoProperties": properties, "evidence": {"occurrences": places.get(r["key"], [])}})
    digest = bytearray(hashlib.md5(json.dumps([name, out], sort_keys=True).encode()).digest())
    digest[6], digest[8] = digest[6] & 0x0F | 0x30, digest[8] & 0x3F | 0x80
    when = when or datetime.now(UTC)
    root = {"type": "application", "bom-ref": name, "name": name}
    return {
        "bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": f"urn:uuid:{uuid.UUID(bytes=bytes(digest))}", "version": 1,
        "metadata": {"timestamp": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "component": root}, "components": out, "dependencies": [{"ref": name, "dependsOn": [c["bom-ref"] for c in out]}],
    }


def inventory(summary: dict, assets: DataFrame) -> dict:
    rows = assets.orderBy(F.desc("is_resolved"), F.lower("asset_family"), F.lower("name"), "asset_id").collect()
    keys = {"assetId": "asset_id", "name": "name", "algorithmFamily": "asset_family", "primitiveType": "primitive", "mode": "mode", "padding": "padding", "usageCount": "usage_count", "isResolved": "is_resolved", "confidence": "confidence"}
    return {"summary": summary, "assets": [{k: r[c] for k, c in keys.items() if r[c] is not None} for r in rows]}


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """All rows of each table, in its order."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in df.collect()] + [""]
    return "\n".join(out)


STYLE = "body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left;vertical-align:top}th{cursor:pointer}tr.row:hover{background:#eef}pre{margin:0;white-space:pre-wrap}"
#: The page filters rows by text, sorts by a column that is clicked, opens the whole record of a row, and follows ids from one table to another.
SCRIPT = """
const data = JSON.parse(document.getElementById('payload').textContent);
const tables = [...document.querySelectorAll('table')];
const shown = s => tables.forEach(t => [...t.tBodies[0].rows].forEach(r => {
  if (!r.dataset.at) { r.remove(); return; }
  r.hidden = !r.textContent.toLowerCase().includes(s);
}));
const search = document.getElementById('search');
search.oninput = () => shown(search.value.trim().toLowerCase());
tables.forEach(t => {
  [...t.tHead.rows[0].cells].forEach((h, k) => h.onclick = () => {
    const up = h.dataset.up = h.dataset.up === '1' ? '0' : '1';
    const rows = [...t.tBodies[0].rows].filter(r => r.dataset.at);
    rows.sort((a, b) => a.cells[k].textContent.localeCompare(b.cells[k].textContent, undefined, {numeric: true}) * (up === '1' ? 1 : -1));
    t.tBodies[0].replaceChildren(...rows);
  });
  t.tBodies[0].onclick = e => {
    const r = e.target.closest('tr');
    if (!r || !r.dataset.at) return;
    if (r.nextSibling && !r.nextSibling.dataset.at) { r.nextSibling.remove(); return; }
    const all = document.createElement('tr'), cell = all.insertCell(), text = document.createElement('pre');
    cell.colSpan = r.cells.length;
    text.textContent = JSON.stringify(data[t.dataset.name][r.dataset.at], null, 2);
    cell.append(text);
    r.after(all);
  };
});
"""


def page(title: str, payload: dict) -> str:
    """One offline HTML page: the payload as escaped JSON and a table for each list of rows in it, to search, sort and open."""
    data = json.dumps(payload, default=str).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    name = html.escape(title)
    parts = [f'<!doctype html><meta charset=utf-8><title>{name}</title><style>{STYLE}</style><h1>{name}</h1><input id="search" type="search" placeholder="Search all tables" aria-label="Search all tables">']
    for key, rows in payload.items():
        if isinstance(rows, list) and rows and isinstance(rows[0], dict):
            columns = list(dict.fromkeys(k for r in rows for k in r))
            parts.append(f'<h2>{html.escape(key)}</h2><table data-name="{html.escape(key)}"><thead><tr>' + "".join(f"<th>{html.escape(str(k))}</th>" for k in columns) + "</tr></thead><tbody>")
            parts += [f'<tr class="row" data-at="{i}">' + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for i, r in enumerate(rows)]
            parts.append("</tbody></table>")
    return "".join(parts) + f'<script type="application/json" id="payload">{data}</script><script>{SCRIPT}</script>'


def tree(target: str, paths: DataFrame) -> str:
    """The paths of :func:`graph.caller_tree` as an indented tree, simple names only."""
    simple = lambda x: x.split(".")[-1].split("$")[-1]
    return "\n".join([f"[{simple(target)}]", *(f"{'  ' * (2 * r['depth'] - 1)}<-- [{simple(r['id'])}] (depth {r['depth']})" for r in paths.collect())])


def architecture(engine) -> dict:
    """Everything an architecture page shows, under stable keys: areas, classes with short aliases, implementations, edges, loops, methods, calls and a summary. Boundary types stay out, except from the number of connections."""
    rows = engine.classes.orderBy("id").collect()
    display, alias = {r["id"]: r["display"] for r in rows}, {r["id"]: f"c{i}" for i, r in enumerate(rows)}
    keys = {a: f"p{i}" for i, a in enumerate(sorted({r["area"] for r in rows}))}
    declared = {r["fqcn"]: r for r in engine.types.collect()}
    implementations: dict[str, list] = {}
    for r in resolve.subtypes(resolve.hierarchy(engine.types), engine.types.select(F.col("fqcn").alias("target"))).orderBy("target", "child").collect():
        if r["target"] in display and r["child"] in display:
            implementations.setdefault(display[r["target"]], []).append(display[r["child"]])
    edges = [r for r in engine.edges.orderBy("src", "dst").collect() if r["src"] in alias and r["dst"] in alias]
    methods = {display[t]: _methods(r["methods"]) for t, r in sorted(declared.items()) if t in display}
    calls = []
    for r in edges:
        for c in r["details"]:
            a, b = c["caller_method"] or "(init)", c["method"] or "(call)"
            for owner, name in ((r["src"], a), (r["dst"], b)):
                own = methods.setdefault(display[owner], [])
                own.extend([name] if name not in own else [])
            calls.append(f"{display[r['src']]}.{a}>{display[r['dst']]}.{b}:L{c['line']}")
    loops = [" ".join(alias[x] for x in r["path"][:-1]) for r in engine.cycles.orderBy("component", "nth").collect() if all(x in alias for x in r["path"])]

    def described(t) -> str:
        if t is not None and t["interfaces"]:
            return "Implements " + ", ".join(t["interfaces"]) + "."
        return f"Extends {t['superclass']}." if t is not None and t["superclass"] else f"Part of the {(t and t['package']) or 'default'} package."

    return {
        "summary": {"classes": len(rows), "connections": engine.edges.count(), "critical": engine.risk.where("level = 'CRITICAL'").count(), "loops": len(loops)},
        "areas": {k: [a, a.split(".")[-1]] for a, k in keys.items()},
        "descriptions": {r["display"]: described(declared.get(r["id"])) for r in rows},
        "interfaces": [r["display"] for r in rows if r["kind"] == "INTERFACE"],
        "implementations": implementations,
        "aliases": {alias[r["id"]]: r["display"] for r in rows},
        "classes": [{"id": r["display"], "area": keys[r["area"]], "risk": round(r["overall"], 1), "level": r["shown_level"], "rank": r["position"], "dependents": r["in_degree"], "dependencies": r["out_degree"], "churn": r["churn"], "commits": r["commits"], "authors": r["authors"], "instability": round(r["instability"], 3), "inLoop": r["in_loop"]} for r in rows],
        "edges": " ".join(f"{alias[r['src']]}>{alias[r['dst']]}:{r['call_count']}" for r in edges),
        "loops": loops,
        "methods": methods,
        "calls": " ".join(calls),
    }


def _methods(rows) -> list[str]:
    """Method names of a type; overloads with their parameters' simple types."""
    names = [m["name"] for m in rows]
    out: list[str] = []
    for m in rows:
        short = ",".join(p.split(".")[-1] for p in m["param_types"])
        name = f"{m['name']}({short})" if names.count(m["name"]) > 1 and short else m["name"]
        out += [name] if name not in out else []
    return out


def assessment(rows: DataFrame, usages: DataFrame, error: str | None = None) -> dict:
    """The post-quantum report; ``error`` tells why there is no graph."""
    places: dict[str, list] = {}
    for u in usages.dropDuplicates(["key", "usage_id"]).orderBy("path", "line", "col").collect():
        places.setdefault(u["key"], []).append({"filePath": u["path"], "line": u["line"], "column": u["col"], "apiOwner": u["owner"], "methodName": u["method"], "originalArgument": u["argument"], "status": u["status"]})
    found = rows.collect()
    count = lambda k, v: sum(r[k] == v for r in found)
    tally = lambda k: {v: count(k, v) for v in sorted({r[k] for r in found})}
    summary = {"totalAssets": len(found)} | {n: count("exposure", v) for n, v in (("quantumVulnerable", "QUANTUM_VULNERABLE"), ("quantumImpacted", "QUANTUM_IMPACTED"), ("classicallyWeak", "CLASSICALLY_WEAK"), ("quantumSafe", "QUANTUM_SAFE"), ("unknown", "UNKNOWN"))}
    summary |= {n: count("category", v) for n, v in (("pqcMigrationCandidates", "PQC_MIGRATION_CANDIDATE"), ("classicalRemediation", "CLASSICAL_REMEDIATION"), ("quantumConsiderations", "QUANTUM_CONSIDERATION"), ("unknownOrUnresolved", "UNKNOWN_OR_UNRESOLVED"))}
    summary |= {n: count("priority", v) for n, v in (("lowPriority", "LOW"), ("reviewRequiredPriority", "REVIEW_REQUIRED"), ("undeterminedPriority", "PRIORITY_UNDETERMINED"))}
    summary["totalCallerClassesAffected"] = len({c for r in found for c in [*(r["direct_classes"] or []), *(r["transitive_classes"] or [])]})
    return {
        "graphAnalysisStatus": "unavailable" if error else "complete", **({"graphAnalysisError": error} if error else {}),
        "summary": summary | {"exposureBreakdown": tally("exposure"), "purposeBreakdown": tally("purpose")},
        "assessments": [
            {
                "assetId": r["asset_id"], "name": r["name"], "algorithmFamily": r["asset_family"], "primitiveType": r["primitive"], "category": r["category"], "exposureLevel": r["exposure"], "purpose": r["purpose"], "priority": r["priority"], "threatSummary": r["threat"],
                "recommendation": {"targetStandard": ", ".join(r["targets"]) or r["recommendation"], "standardFamily": r["standard"], "transitionStrategy": r["strategy"]},
                "blastRadius": {"directDependentClasses": r["direct_classes"] or [], "transitiveOnlyDependentClasses": r["transitive_classes"] or [], "totalDirectDependents": r["direct"], "totalTransitiveOnlyDependents": r["transitive_only"], "totalReachableClasses": r["reachable"], "maxCallDepth": r["max_depth"], "cumulativeRiskScore": r["cumulative_risk"], "isSharedUtilityUsage": r["shared_utility"], "affectedCompilationUnits": sorted({u["filePath"] for u in places.get(r["key"], [])})},
                "usages": places.get(r["key"], []),
            }
            for r in found
        ],
    }


def colour(flag_off: bool, environment: dict[str, str]) -> bool:
    """Whether a terminal takes colours: not if switched off, if NO_COLOR is set, or if TERM is dumb."""
    return not flag_off and "NO_COLOR" not in environment and environment.get("TERM", "").lower() != "dumb"


def plain(text: str) -> str:
    """``text`` without terminal escapes."""
    return re.sub("\x1b" + r"\[[;?0-9]*[A-Za-z]", "", text)
