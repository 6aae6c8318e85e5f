import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.cli import main
from tessera.engine import Engine
from tessera.operators import crypto, graph, risk, safety
from tessera.plans import export
from tessera.sources import git
from tessera.streaming import churn as stream

USAGE = "path string, line int, col int, owner string, raw string, confidence string, resolved boolean"


def usages(spark, rows):
    return spark.createDataFrame(rows, USAGE)


def one(spark, owner, raw, **k):
    return usages(spark, [("a.java", 1, 1, owner, raw, k.get("confidence", "HIGH"), k.get("resolved", True))])


@pytest.mark.parametrize(
    ("owner", "raw", "rules"),
    [
        ("CIPHER", "AES/ECB/PKCS5Padding", ["CC-CRYPTO-001"]), ("CIPHER", "RSA/ECB/OAEP", []), ("CIPHER", "DES", ["CC-CRYPTO-002", "CC-CRYPTO-004"]), ("CIPHER", "DESede/CBC/x", ["CC-CRYPTO-002"]),
        ("CIPHER", "AES/GCM/NoPadding", []), ("CIPHER", "AES", ["CC-CRYPTO-004"]), ("MESSAGE_DIGEST", "sha-1", ["CC-CRYPTO-003"]), ("MESSAGE_DIGEST", "SHA-256", []), ("SSL_CONTEXT", "TLSv1.1", ["CC-TLS-001"]), ("SSL_CONTEXT", "TLSv1.3", []),
    ],
)
def test_rules(spark, owner, raw, rules):
    assert sorted(r["rule_id"] for r in crypto.findings(one(spark, owner, raw)).collect()) == rules


def test_rules_need_a_confirmed_resolved_usage(spark):
    assert crypto.findings(one(spark, "CIPHER", "DES", confidence="LOW")).count() == crypto.findings(one(spark, "CIPHER", "DES", resolved=False)).count() == 0
    assert crypto.findings(one(spark, "CIPHER", "DES"), crypto.Registry(())).count() == 0
    own = crypto.Registry(())
    own.register(("DEMO001", "CIPHER", F.col("raw").startswith("D"), "INFO", "CRYPTOGRAPHY", None, "Seen '", "'.", ""))
    assert [r["rule_id"] for r in crypto.findings(one(spark, "CIPHER", "DES"), own).collect()] == ["DEMO001"] and own.get("DEMO001")


def test_order_and_histogram(spark):
    found = crypto.findings(usages(spark, [("b", 1, 1, "CIPHER", "DES", "HIGH", True), ("a", 9, 1, "SSL_CONTEXT", "SSL", "HIGH", True), ("b", 1, 1, "CIPHER", "DES", "HIGH", True)]))
    rows = crypto.ordered(crypto.deduplicated(found)).collect()
    assert [(r["path"], r["rule_id"]) for r in rows] == [("a", "CC-TLS-001"), ("b", "CC-CRYPTO-002"), ("b", "CC-CRYPTO-004")]
    assert {r["severity"]: r["n"] for r in crypto.severity_histogram(found).collect()} == {"INFO": 0, "LOW": 0, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 0}


def test_inventory(spark):
    rows = crypto.described(usages(spark, [("b", 1, 1, "CIPHER", "aes/gcm/NoPadding", "HIGH", True), ("a", 2, 2, "CIPHER", "AES/GCM/NOPADDING", "HIGH", True), ("a", 2, 2, "CIPHER", "AES/GCM/NOPADDING", "HIGH", True), ("c", 1, 1, "SECURE_RANDOM", None, "HIGH", True)]))
    assets = {r["key"]: r for r in crypto.inventory(rows).collect()}
    gcm = assets["CIPHER|AES/GCM/NOPADDING"]
    assert (gcm["name"], gcm["usage_count"], gcm["files"], gcm["is_resolved"]) == ("AES/GCM/NOPADDING", 2, 2, True)
    assert bytes.fromhex(gcm["asset_id"].removeprefix("crypto-asset-")).decode() == gcm["key"]
    assert assets["SECURE_RANDOM|UNKNOWN"]["name"] == "UNKNOWN-SECURE_RANDOM" and not assets["SECURE_RANDOM|UNKNOWN"]["is_resolved"]
    assert crypto.summary(rows, crypto.inventory(rows)).first().asDict() == {"observations": 4, "unresolved_usages": 1, "files": 3, "unique_assets": 2, "resolved_assets": 1}


@pytest.mark.parametrize(
    ("owner", "raw", "exposure", "advice"),
    [
        ("SSL_CONTEXT", "TLSv1.3", "UNKNOWN", "none"), ("SIGNATURE", "SHA256withRSA", "QUANTUM_VULNERABLE", "mlDsaSignature"), ("KEY_AGREEMENT", "ECDH", "QUANTUM_VULNERABLE", "mlKemKeyExchange"), ("CIPHER", "RSA/ECB/x", "QUANTUM_VULNERABLE", "kemDemArchitecture"),
        ("CIPHER", "AES_128/GCM/NoPadding", "QUANTUM_IMPACTED", "symmetricUpgrade128"), ("MESSAGE_DIGEST", "SHA-384", "QUANTUM_IMPACTED", "hashBaseline"), ("MESSAGE_DIGEST", "MD5", "CLASSICALLY_WEAK", "classicalRemediation"), ("SIGNATURE", "ML-DSA", "QUANTUM_SAFE", "pqcApproved"), ("SECURE_RANDOM", "SHA1PRNG", "UNKNOWN", "providerAudit"),
    ],
)
def test_exposure(spark, owner, raw, exposure, advice):
    r = crypto.exposure(crypto.inventory(crypto.described(one(spark, owner, raw)))).first()
    assert (r["exposure"], r["recommendation"]) == (exposure, advice)


def test_family_order(spark):
    rows = spark.createDataFrame([("SHA384",), ("SHA3-256",), ("SHA-512",), ("HmacMD5",), ("desede",), ("Custom",), ("SSLv3",)], "raw string")
    assert [r[0] for r in rows.select(crypto.family(F.col("raw"))).collect()] == ["SHA-2", "SHA-3", "SHA-2", "HMAC", "3DES", "Custom", "TLS"]


def test_risk(spark):
    hot = spark.createDataFrame([("p.A", 1, 90.0, True, "src/A.java")], "id string, position int, minmax_score double, in_cycle boolean, path string")
    metrics = spark.createDataFrame([("module/src/A.java", 10, 50, 10, 1.0)], "path string, commits int, added int, deleted int, bus_factor double")
    r = risk.composite(hot, metrics).first()
    assert (r["overall"], r["level"]) == (pytest.approx(96.0), "CRITICAL")
    assert risk.composite(hot, None).first()["overall"] == pytest.approx(94.0)
    levels = spark.createDataFrame([(x,) for x in (10.0, 25.0, 26.0, 50.0, 51.0, 75.0, 76.0, 100.0)], "x double").select(risk.level(F.col("x"))).collect()
    assert [r[0] for r in levels] == ["LOW"] * 2 + ["MEDIUM"] * 2 + ["HIGH"] * 2 + ["CRITICAL"] * 2


def test_longest_suffix_wins(spark):
    left = spark.createDataFrame([("x", "src/A.java"), ("y", "none/B.java")], "id string, file string")
    right = spark.createDataFrame([("A.java", 1), ("m/src/A.java", 2), ("other/A.java", 3)], "path string, n int")
    assert {r["id"]: r["n"] for r in risk.suffix_joined(left, right, "file", "path", "id").collect()} == {"x": 2, "y": None}


def test_paths_meet_on_whole_ends(spark):
    left = spark.createDataFrame([("a", "index.html"), ("b", "x/index.html"), ("c", "ndex.html"), ("d", None), ("e", "m\\x\\y.java")], "id string, file string")
    right = spark.createDataFrame([(f"p{i}/x/index.html", i) for i in range(50)] + [("y.java", 90), ("x/y.java", 91), (None, 92)], "path string, n int")
    assert {r["id"]: r["n"] for r in risk.suffix_joined(left, right, "file", "path", "id").collect()} == {"a": 0, "b": 0, "c": None, "d": None, "e": 91}
    files = left.select("id", F.col("file").alias("path"))
    changed = spark.createDataFrame([("https://host/p1/x/index.html?q",), ("y.java",)], "file string")
    assert sorted(r["id"] for r in safety.touched(files, changed).collect()) == ["a", "b", "e"]
    assert [r["file"] for r in safety.violations(spark.createDataFrame([("a/b.c",), ("b.c",), ("xb.c",)], "file string"), spark.createDataFrame([("b.c",)], "file string")).collect()] == ["xb.c"]


def test_suggested_tests_contain_the_name(spark):
    files = spark.createDataFrame([("t/OrderServiceIntegrationTest.java",), ("t/OrderServiceTests.java",), ("t/OrderServiceIT.java",), ("t/MyOrderServiceTestCase.java",), ("Order.java",), (None,)], "path string")
    names = spark.createDataFrame([("OrderService",), ("Order",), ("Other",), ("",), (None,)], "simple_name string")
    got = {(r["file"][2:-5], r["simple_name"]) for r in safety.suggested_tests(files, names).collect()}
    assert got == {(f, n) for f in ("OrderServiceIntegrationTest", "OrderServiceTests", "MyOrderServiceTestCase") for n in ("OrderService", "Order")}
    assert safety.suggested_tests(files, names.limit(0)).count() == 0


def test_a_failing_rule_leaves_the_others(spark):
    rows = usages(spark, [("b", 1, 1, "CIPHER", "DES", "HIGH", True)])
    broken = F.udf(lambda x: 1 / 0 == x, "boolean")
    own = [("OWN", "CIPHER", F.col("raw") == "DES", "INFO", "C", None, "", "", ""), ("RUN", "CIPHER", broken("raw"), "INFO", "C", None, "", "", ""), ("PLAN", "CIPHER", F.col("no_such"), "INFO", "C", None, "", "", "")]
    found, wrong = crypto.isolated(lambda rules: crypto.findings(rows, crypto.Registry(tuple(rules))), [*crypto.RULES, *own])
    assert sorted(r["rule_id"] for r in found.collect()) == ["CC-CRYPTO-002", "CC-CRYPTO-004", "OWN"] and sorted(r for r, _ in wrong) == ["PLAN", "RUN"]
    with pytest.raises(Exception):  # noqa: B017
        crypto.isolated(lambda rules: rows.select("no_such"), [("A",)])


def test_rules_over_calls(spark):
    calls = spark.createDataFrame([("p", 1, 1, "demoHook", "METHOD_CALL"), ("p", 2, 1, "other", "METHOD_CALL"), ("p", 3, 1, "<init>", "CONSTRUCTOR_CALL")], "path string, line int, col int, method string, kind string")
    assert [(r["rule_id"], r["line"]) for r in crypto.demonstration(calls).collect()] == [("DEMO001", 1)]
    registry = crypto.Registry(())
    for text in ("one", "two"):
        registry.register_call(crypto.CallRule("NEW", crypto.CREATIONS, F.lit(True), "LOW", "C", "CWE-1", F.lit(text)))
    assert [(r["line"], r["message"], r["cwe"]) for r in crypto.call_findings(calls, registry.call_rules).collect()] == [(3, "two", "CWE-1")]
    assert crypto.call_findings(calls, []).count() == 0


def test_bus_factor(spark):
    changes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y")], "path string, commit int, author string")
    assert {r["path"]: r["bus_factor"] for r in risk.bus_factor(changes).collect()} == {"a": 1.0, "b": pytest.approx(0.0)}


def test_plan_check(spark):
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "file string")
    bad = safety.violations(files("src/A.java", "src/XA.java", ".plan.json", "m/src/B.java"), files("A.java", "src/B.java"), ".plan.json")
    assert [r["file"] for r in bad.collect()] == ["src/XA.java"]


def test_windowed_churn(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1, 0), ("a", "2024-01-02 00:00:00", 2, 1), ("a", "2024-02-01 00:00:00", 5, 5)], "path string, ts string, added int, deleted int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["commits"], r["added"]) for r in stream.windowed(rows).collect()) == [(1, 5), (2, 3)]


@pytest.fixture
def repo(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("src/main/java/app/OrderController.java", "package app; class OrderController { OrderService service; void go() { service.run(1); } }")
    put("src/main/java/app/OrderService.java", 'package app; import javax.crypto.Cipher; class OrderService { void run(int x) throws Exception { new PaymentService().pay(); Cipher.getInstance("AES/ECB/PKCS5Padding"); } }')
    put("src/main/java/app/PaymentService.java", "package app; class PaymentService { void pay() { } }")
    put("src/test/java/app/OrderServiceTest.java", "package app; class OrderServiceTest { void t() { OrderService s = new OrderService(); s.run(2); } }")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Alice", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    put("src/main/java/app/OrderService.java", (tmp_path / "src/main/java/app/OrderService.java").read_text() + "\n// changed\n")
    return str(tmp_path)


def test_history(spark, repo):
    rows = risk.churn(git.changes(spark, repo)).collect()
    assert len(rows) == 4 and {(r["commits"], r["added"], r["deleted"], r["authors"]) for r in rows} == {(1, 10, 0, 1)}
    assert [r["file"] for r in git.modified(spark, repo).collect()] == ["src/main/java/app/OrderService.java"]
    with pytest.raises(git.GitError):
        git.modified(spark, repo, "no-such-ref")
    assert git.changes(spark, os.path.join(repo, "src")).count() == 0
    os.remove(os.path.join(repo, "src/main/java/app/PaymentService.java"))
    assert [r["file"] for r in git.modified(spark, repo).collect()] == ["src/main/java/app/OrderService.java"]


def test_history_stops_at_the_window(spark, repo, monkeypatch):
    monkeypatch.setattr(git, "CHUNK", 1)
    for n, days in enumerate((200, 50, 0)):
        when = f"{1_700_000_000 - days * 86_400} +0000"
        with open(os.path.join(repo, f"f{n}"), "w") as f:
            f.write("x\n")
        subprocess.run(["git", "-C", repo, "add", f"f{n}"], check=True)
        subprocess.run(["git", "-C", repo, "-c", "user.name=Al", "-c", "user.email=a@x", "commit", "-qm", str(n)], check=True, env=os.environ | {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when})
    files = lambda **k: sorted(r["path"] for r in git.changes(spark, repo, **k).where("path like 'f%'").collect())
    assert files() == ["f1", "f2"] and files(days=None) == ["f0", "f1", "f2"] and files(days=10) == ["f2"]
    assert files(days=100, as_of=1_700_000_000 - 150 * 86_400) == ["f0", "f1", "f2"]


def test_commands(spark, repo, capsys):
    def run(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out

    code, out = run("analyze", repo, "--json")
    assert code == 0 and json.loads(out)["hotspots"][0]["fqcn"] == "app.OrderService" and list(json.loads(out))[:3] == ["totalFiles", "totalClasses", "totalInvocations"]
    assert run("cycles", repo, "--fail-on-cycles")[0] == 0
    impact = json.loads(run("impact", "OrderService", "--path", repo, "--suggest-tests", "--json")[1])
    assert impact["directCallers"] == ["app.OrderController", "app.OrderServiceTest"] and impact["recommendedTestScope"] == ["app.OrderServiceTest"] and len(impact["suggestedTests"]) == 1
    assert run("impact", "Nope", "--path", repo)[0] == run("analyze", "/nope")[0] == run("nonsense")[0] == 2
    assert "2. app.OrderService -> app.PaymentService" in run("trace", "OrderController", "PaymentService", "--path", repo)[1]
    assert "Passed (Clean)" in run("diff-impact", "--path", repo)[1]
    assert run("prepare", "-t", "PaymentService", "--path", repo)[0] == 0
    code, out = run("verify", "--path", repo)
    assert code == 1 and "OrderService.java" in out
    assert run("prepare", "-t", "OrderService", "--path", repo)[0] == 0 and run("verify", "--path", repo)[0] == 0
    assert run("scan", repo, "--fail-on-findings")[0] == 1 and run("scan", repo, "--fail-on-findings", "--no-default-rules")[0] == 0
    assert run("sarif", repo)[0] == run("cbom", repo)[0] == run("scan", repo, "-o", "f.html")[0] == run("pqc", repo, "-o", "pqc.json")[0] == 0
    load = lambda name: json.load(open(os.path.join(repo, name)))
    sarif = load("tessera.sarif")["runs"][0]
    crypto_results = [r for r in sarif["results"] if r["ruleId"] == "CC-CRYPTO-001"]  # a hotspot's finding can come before, at its type
    assert len(crypto_results) == 1 and crypto_results[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "src/main/java/app/OrderService.java"
    bom = load("crypto-bom.json")
    assert bom["specVersion"] == "1.6" and bom["components"][0]["cryptoProperties"]["algorithmProperties"] == {"primitive": "block-cipher", "cryptoFunctions": ["encrypt", "decrypt"], "mode": "ecb", "padding": "pkcs5"}
    pqc = load("pqc.json")
    assert pqc["graphAnalysisStatus"] == "complete" and pqc["assessments"][0]["blastRadius"]["totalDirectDependents"] == 1
    assert pqc["assessments"][0]["recommendation"]["standardFamily"] == "NIST SP 800-175B" and pqc["assessments"][0]["usages"][0]["originalArgument"] == '"AES/ECB/PKCS5Padding"'
    assert "<script>" not in export.page("x", {"a": [{"b": "<script>"}]}).split("application/json")[0]


def test_tree_and_pages(spark, repo, capsys):
    def run(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out

    code, out = run("impact", "PaymentService", "--path", repo)
    assert code == 0 and "  <-- [OrderService] (depth 1)\n      <-- [OrderController] (depth 2)" in out
    found = json.loads(run("scan", repo, "--format", "json")[1])["findings"][0]
    assert found["evidence"] == "API call: Cipher.getInstance(\"AES/ECB/PKCS5Padding\") with resolved cipher 'AES/ECB/PKCS5Padding'" and found["properties"] == {"algorithm": "AES/ECB/PKCS5Padding", "cipherFamily": "AES", "mode": "ECB"}
    assert found["location"]["endColumn"] > found["location"]["startColumn"] and found["ruleName"] and found["remediation"]
    assert run("scan", repo, "--demo-rule", "--fail-on-findings")[0] == 0
    page = export.architecture(Engine(spark, repo))
    assert page["summary"] == {"classes": 3, "connections": 4, "critical": 1, "loops": 0} and page["areas"] == {"p0": ["app", "app"]}
    assert page["edges"] == "c0>c1:1 c1>c2:1"  # a call on a new object has no receiver type
    assert "OrderService.run>PaymentService.<init>:L1" in page["calls"] and page["methods"] == {"OrderController": ["go"], "OrderService": ["run"], "PaymentService": ["pay", "<init>"]}
    assert run("analyze", repo, "--output", "report", "--quiet")[0] == 0 and "OrderController" in open(os.path.join(repo, "report", "report.html")).read()


def test_a_broken_source_leaves_the_assessment(spark, repo):
    with open(os.path.join(repo, "src/main/java/app/Bad.java"), "w") as f:
        f.write("package app; class Bad { void x( { } ")
    assert main(["pqc", repo, "-o", "p.json"], spark) == 0
    pqc = json.load(open(os.path.join(repo, "p.json")))
    assert pqc["graphAnalysisStatus"] == "unavailable" and pqc["assessments"][0]["blastRadius"]["totalReachableClasses"] == 0 and pqc["summary"]["totalAssets"] == 1


def test_renames_and_merges_in_the_history(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=Bob", "-c", "user.email=b@x", *a], check=True, capture_output=True)
    run("commit", "-qam", "two")
    run("checkout", "-qb", "side", "HEAD~1")
    run("mv", "src/main/java/app/PaymentService.java", "src/main/java/app/Zahlüng.java")
    run("commit", "-qm", "rename")
    run("checkout", "-q", "-")
    run("merge", "-q", "--no-edit", "side")
    rows = {r["path"].rsplit("/", 1)[1]: (r["commits"], r["authors"]) for r in risk.churn(git.changes(spark, repo)).collect()}
    assert rows["Zahlüng.java"] == (2, 1) and rows["PaymentService.java"] == (1, 1) and rows["OrderService.java"] == (2, 2)


def test_interactive_tables(spark):
    found = crypto.findings(usages(spark, [("b", 1, 1, "CIPHER", "DES", "HIGH", True), ("a", 9, 1, "SSL_CONTEXT", "SSL", "HIGH", True)]))
    assert crypto.searched(found, " tls ").count() == 1 and crypto.searched(found, severity="MEDIUM").count() == 1 and crypto.searched(found, severity="ALL").count() == 3
    ranks = spark.createDataFrame([("CRITICAL",), ("odd",), (None,)], "priority string").select(crypto.shown_rank("priority")).collect()
    assert [r[0] for r in ranks] == [5, 0, 0]
    assert export.colour(False, {"TERM": "xterm"}) and not export.colour(False, {"TERM": "dumb"}) and not export.colour(False, {"NO_COLOR": ""}) and export.plain("\x1b[31mred\x1b[0m") == "red"


def test_empty_tables(spark):
    none = usages(spark, [])
    rows = crypto.described(none)
    assert crypto.findings(none).count() == crypto.inventory(rows).count() == crypto.advised(crypto.exposure(crypto.inventory(rows))).count() == 0
    edges = spark.createDataFrame([], "src string, dst string, call_count long")
    assert graph.reach(edges, spark.createDataFrame([("x",)], "target string")).count() == graph.method_edges(spark.createDataFrame([], "caller string, caller_method string, target string, method string, line int")).count() == 0
    assert graph.caller_tree(edges, "x").count() == 0


def test_command_forms():
    parse = lambda *x: cli.parser().parse_args(cli.ungrouped(list(x)))
    assert parse("security", "scan", "x", "--format", "sarif").command == "scan" and parse("crypto", "pqc", ".", "--format", "json").max_depth == 10
    assert cli._is_json(parse("crypto", "inventory", "-o", "a.JSON")) and not cli._is_json(parse("inventory")) and parse("analyze", "-q").quiet
    assert main([]) == 0 and main(["security"]) == 2 and main(["impact"]) == 2
