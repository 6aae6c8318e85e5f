import pytest

from tessera.javasrc import extract, resolve, stage
from tessera.javasrc.extract import Scopes, extracted
from tessera.javasrc.parser import parse, unquoted


def constant(body, fields="", head="import javax.crypto.Cipher;"):
    row = extracted("A.java", f"package p; {head} class A {{ {fields} void f(String given) {{ {body} }} }}")
    assert not row["errors"], row["errors"]
    c = row["crypto"][-1]
    return c["status"], c["raw"]


@pytest.mark.parametrize(
    ("body", "fields", "want"),
    [
        ('Cipher.getInstance("AES");', "", ("RESOLVED", "AES")),
        ('Cipher.getInstance((String) ("AES" + "/GCM"));', "", ("RESOLVED", "AES/GCM")),
        ('Cipher.getInstance("AES/" + given);', "", ("PARTIALLY_RESOLVED", None)),
        ("Cipher.getInstance(given);", 'static final String given = "AES";', ("UNKNOWN", None)),
        ('String a = "SHA-256"; { Cipher.getInstance(a); }', "", ("RESOLVED", "SHA-256")),
        ('String a = "x"; a += "256"; Cipher.getInstance(a);', "", ("UNKNOWN", None)),
        ('String a = "x"; a = "y"; Cipher.getInstance(a);', "", ("RESOLVED", "y")),
        ('String a = "x"; if (given == null) a = "y"; Cipher.getInstance(a);', "", ("AMBIGUOUS", None)),
        ('String a = "x"; { a = "y"; } Cipher.getInstance(a);', "", ("UNKNOWN", None)),
        ("Cipher.getInstance(ALG);", 'private static final String ALG = "A" + B; static final String B = "ES";', ("RESOLVED", "AES")),
        ("Cipher.getInstance(ALG);", 'static String ALG = "AES";', ("UNKNOWN", None)),
        ("Cipher.getInstance(A1);", "static final String A1 = A2; static final String A2 = A1;", ("AMBIGUOUS", None)),
        ("Cipher.getInstance(B.ALG);", 'static class B { static final String ALG = "DES"; }', ("RESOLVED", "DES")),
        ("Cipher.getInstance(this.alg);", 'final String alg = "RC4";', ("RESOLVED", "RC4")),
        ("Cipher.getInstance(make());", "", ("UNKNOWN", None)),
        ('for (String a : list()) Cipher.getInstance(a);', 'static final String a = "AES";', ("UNKNOWN", None)),
        ('Cipher.getInstance(a); String a = "AES";', "", ("UNKNOWN", None)),
    ],
)
def test_constants(body, fields, want):
    assert constant(body, fields) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("import javax.crypto.Cipher; class A { Object x = Cipher.getInstance(\"AES\"); }", ["HIGH"]),
        ("import javax.crypto.*; class A { Object x = Cipher.getInstance(\"AES\"); }", ["HIGH"]),
        ("import javax.crypto.*; import com.fake.*; class A { Object x = Cipher.getInstance(\"AES\"); }", ["LOW"]),
        ("import com.fake.Cipher; class A { Object x = Cipher.getInstance(\"AES\"); }", []),
        ("import javax.crypto.*; class A { class Cipher {} Object x = Cipher.getInstance(\"AES\"); }", []),
        ("class A { Object x = javax.crypto.Cipher.getInstance(\"AES\"); }", ["HIGH"]),
        ("class A { Object x = Cipher.getInstance(\"AES\"); }", []),
        ("import static javax.crypto.Cipher.getInstance; class A { Object x = getInstance(\"AES\"); }", ["HIGH"]),
        ("import java.security.SecureRandom; class A { Object x = new SecureRandom(); }", ["HIGH"]),
        ("class A { Object x = new SecureRandom(); }", []),
        ("import javax.crypto.Cipher; class A { Object x = Cipher.getInstance(); }", []),
    ],
)
def test_owners_are_confirmed(source, want):
    assert [c["confidence"] for c in extracted("A.java", source)["crypto"]] == want


def test_declarations():
    row = extracted("a/B.java", "package p; import java.util.*; import static a.B.c;\n@Deprecated public abstract class B<T extends Comparable<T>> extends q.Base<T> implements x.I, J<K> {\n  int[] a, b = 3; B(int q) {} <E> Map<String, List<E>> m(final E e, int... r) throws X { return null; }\n  enum E { X { void z() {} }, Y(1); E() {} } record R(int a, String b) { R { } } @interface N { int v() default 1; } interface I extends K, L { } }")
    assert not row["errors"]
    t = {x["fqcn"]: x for x in row["types"]}
    assert list(t) == ["p.B", "p.B$E", "p.B$R", "p.B$N", "p.B$I"]
    b = t["p.B"]
    assert (b["superclass"], b["interfaces"], b["annotations"], b["kind"]) == ("q.Base", ["I", "J"], ["@Deprecated"], "CLASS")
    assert [(f["name"], f["type"]) for f in b["fields"]] == [("a", "int"), ("b", "int")]
    assert [(m["signature"], m["return_type"]) for m in b["methods"]] == [("m(E,int...)", "Map<String, List<E>>"), ("B(int)", "void")]
    assert [(f["name"], f["modifiers"]) for f in t["p.B$R"]["fields"]] == [("a", ["private", "final"]), ("b", ["private", "final"])]
    assert t["p.B$I"]["interfaces"] == ["K", "L"] and [t[x]["kind"] for x in list(t)[1:]] == ["ENUM", "RECORD", "ANNOTATION", "INTERFACE"]
    assert b["range"]["line"] == 2 and [(i["name"], i["is_static"], i["wildcard"]) for i in row["imports"]] == [("java.util", False, True), ("a.B.c", True, False)]


def test_modern_syntax_and_errors():
    source = 'class A { int f(Object o) { var s = """\n    hi\n      x"""; int r = switch (o) { case Integer i when i > 3 -> i; default -> { yield 2; } }; Runnable q = () -> g(); if (o instanceof String t && t.length() > 2) h(t); return a < b ? x >> 2 : y >>> 3; } }'
    assert parse(source)[1] == []
    broken = extracted("A.java", "package p; class A { void f() { int = ; g(); } void h() { k(); } } class B { }")
    assert broken["errors"] and [t["fqcn"] for t in broken["types"]] == ["p.A", "p.B"] and {c["method"] for c in broken["calls"]} >= {"g", "k"}
    assert extracted("A.java", None)["types"] == [] and extracted("A.java", "(" * 5000)["errors"]
    assert unquoted(r'"a\tbA\101"') == "a\tbAA" and unquoted('"""\n  x\n   y"""') == "x\n y"


def test_scopes():
    s = Scopes()
    s.pop()
    s.declare("a", "X")
    s.push()
    s.declare("a", "Y")
    assert (s.lookup("a"), s.depth()) == ("Y", 2)
    s.pop()
    assert s.lookup("a") == "X" and s.lookup("b") is None


FILES = {
    "p/Outer.java": "package p; public class Outer { static class Inner { void go() { helper(); new Other().work(1); } void helper() {} } }",
    "p/Base.java": "package p; public class Base { void shared(int a) {} void twice(int a) {} void twice(String s) {} }\nclass Kid extends Base { void run() { shared(1); super.shared(2); this.twice(1); make().run(); } Kid make() { return this; } }",
    "p/Other.java": "package p; import q.Far; import r.*; class Other { Far far; void work(int x) { far.call(); Wild.go(); String s = null; s.trim(); Unknown.f(); } }",
    "q/Far.java": "package q; public class Far { public void call() {} }",
    "r/Wild.java": "package r; public class Wild { public static void go(int x) {} }",
}


def test_resolution(spark):
    units = stage.parsed(spark.createDataFrame(list(FILES.items()), "path string, source string")).cache()
    calls = resolve.invocations(units, stage.types(units))
    got = {(r["caller"], r["method"], r["line"], r["col"]): r for r in calls.collect()}
    by = lambda caller, method: [r for k, r in got.items() if k[:2] == (caller, method)]
    assert by("p.Outer$Inner", "helper")[0]["target"] == "p.Outer$Inner" and by("p.Outer$Inner", "helper")[0]["signature"] == "helper()"
    assert {(r["target"], r["handler"]) for r in by("p.Outer$Inner", "<init>")} == {("p.Other", "same-package")}
    assert {(r["target"], r["signature"], r["kind"]) for r in by("p.Kid", "shared")} == {("p.Base", "shared(int)", "METHOD_CALL"), ("p.Base", "shared(int)", "SUPER_CALL")}
    assert by("p.Kid", "twice")[0]["signature"] == "twice(?)"
    assert by("p.Kid", "run")[0]["target"] == "<unresolved>:make()" and by("p.Kid", "run")[0]["unresolved"]
    assert by("p.Other", "call")[0]["target"] == "q.Far" and by("p.Other", "call")[0]["handler"] == "explicit-import"
    wild = by("p.Other", "go")[0]
    assert (wild["target"], wild["signature"], wild["kind"], wild["handler"]) == ("r.Wild", "go(?)", "STATIC_METHOD_CALL", "wildcard-import")
    assert (by("p.Other", "trim")[0]["target"], by("p.Other", "trim")[0]["resolved_locally"]) == ("java.lang.String", False)
    assert by("p.Other", "f")[0]["target"] == "Unknown"
    m = {r["path"]: r for r in resolve.metrics(calls).collect()}
    assert m["p/Base.java"]["unresolvable"] == 1 and m["p/Base.java"]["total"] == 5
    assert stage.scan_summary(units).first()["types"] == 7


def test_hierarchy(spark):
    units = stage.parsed(spark.createDataFrame([("a.java", "package p; class A extends B implements I {} class B extends C {} class C extends A { void m() {} } interface I { void m(); }")], "path string, source string"))
    types = stage.types(units)
    parents = resolve.hierarchy(types)
    assert {(r["child"], r["parent"], r["kind"]) for r in parents.collect()} == {("p.A", "B", "extends"), ("p.A", "I", "implements"), ("p.B", "C", "extends"), ("p.C", "A", "extends")}
    names = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("A", "I")], "child string, parent string")
    assert {(r["parent"], r["depth"]) for r in resolve.supertypes(names).where("child = 'A'").collect()} == {("B", 1), ("I", 1), ("C", 2)}
    assert {r["child"] for r in resolve.subtypes(parents, spark.createDataFrame([("p.C",)], "target string")).collect()} == {"p.B"}
    own = spark.createDataFrame([("p.A", "p.I", 2), ("p.A", "p.C", 1)], "child string, parent string, position int")
    ordered = resolve.supertypes(spark.createDataFrame([("C", "Z", 0), ("C", "A", 1), ("Z", "Y", 0), ("A", "B", 0), ("Z", "D", 1)], "child string, parent string, nth int"))
    assert [r["parent"] for r in ordered.where("child = 'C'").orderBy("position").collect()] == ["Z", "A", "Y", "D", "B"]
    assert {(r["fqcn"], r["declarer"]) for r in resolve.find_method(types, own).where("name = 'm'").collect()} == {("p.C", "p.C"), ("p.I", "p.I"), ("p.A", "p.C")}


def test_file_scan(spark, tmp_path):
    for p in ("src/main/A.java", "src/test/B.java", "build/C.java", "src/main/DTest.java", "src/main/readme.txt", "src/target/E.java"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("class X {}")
    find = lambda **k: sorted(r["path"] for r in stage.source_files(spark, str(tmp_path), **k).collect())
    assert find() == ["src/main/A.java"]
    assert find(include_tests=True) == ["src/main/A.java", "src/main/DTest.java", "src/test/B.java"]


SHADOWED = """package p; class S { private Long id; void update(Account from) { String id = "1"; Number x = 1; if (true) { Double x = 2.0; }
  try (Reader r = open()) { r.read(); } catch (IOException e) { e.print(); } } void other() { int y = 1; } }"""


def test_names_in_scope():
    rows = extract.scopes("S.java", SHADOWED)
    names = lambda r: {x["name"]: x["type"] for x in r["names"]}
    ends = {r["method"]: names(r) for r in rows if r["method_end"]}
    assert ends == {"update": {"from": "Account", "id": "String", "x": "Number"}, "other": {"y": "int"}}
    inside = [names(r) for r in rows if not r["method_end"] and r["method"] == "update"]
    assert any(n.get("x") == "Double" for n in inside) and any(n.get("r") == "Reader" for n in inside) and any(n.get("e") == "IOException" for n in inside)
    assert extract.scopes("x", None) == []


def test_names_in_scope_as_a_table(spark):
    rows = stage.scopes(spark.createDataFrame([("S.java", SHADOWED), ("E.java", None)], "path string, source string"))
    assert rows.where("method_end").count() == 2
