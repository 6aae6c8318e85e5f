"""Cryptography: transformation predicates, rules, inventory and post-quantum assessment, all as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from . import balls, graph

OWNERS = {
    "CIPHER": "javax.crypto.Cipher", "MAC": "javax.crypto.Mac", "KEY_AGREEMENT": "javax.crypto.KeyAgreement", "KEY_GENERATOR": "javax.crypto.KeyGenerator",
    "MESSAGE_DIGEST": "java.security.MessageDigest", "SIGNATURE": "java.security.Signature", "KEY_PAIR_GENERATOR": "java.security.KeyPairGenerator",
    "SECURE_RANDOM": "java.security.SecureRandom", "SSL_CONTEXT": "javax.net.ssl.SSLContext",
}
CYCLONE = {
    "BLOCK_CIPHER": "block-cipher", "STREAM_CIPHER": "stream-cipher", "PUBLIC_KEY_ENCRYPTION": "pke", "MESSAGE_DIGEST": "hash", "MAC": "mac", "SIGNATURE": "signature",
    "KEY_AGREEMENT": "key-agree", "KEY_GENERATOR": "kdf", "KEY_PAIR_GENERATOR": "pke", "SECURE_RANDOM": "drbg", "TLS_PROTOCOL": "other", "OTHER": "other",
}
LEGACY = ("DES", "RC2", "RC4", "ARCFOUR", "BLOWFISH")
TRIPLE = ("DESEDE", "TRIPLEDES", "3DES")
WEAK_DIGESTS = ("MD2", "MD4", "MD5", "SHA1")
OLD_TLS = ("SSL", "SSLV2", "SSLV3", "TLSV1", "TLSV1.0", "TLSV1.1")
CLASSICALLY_WEAK = ("DES", "3DES", "TRIPLEDES", "DESEDE", "MD2", "MD4", "MD5", "SHA-1", "SHA1", "RC2", "RC4", "ARCFOUR", "BLOWFISH")
SAFE = ("ML-KEM", "ML-DSA", "SLH-DSA", "KYBER", "DILITHIUM", "SPHINCS", "FALCON", "XMSS", "LMS")
PURPOSES = {
    "SYMMETRIC_ENCRYPTION": ("BLOCK_CIPHER", "STREAM_CIPHER"), "PUBLIC_KEY_ENCRYPTION": ("PUBLIC_KEY_ENCRYPTION",), "DIGITAL_SIGNATURE": ("SIGNATURE",), "KEY_AGREEMENT": ("KEY_AGREEMENT",),
    "HASH_FUNCTION": ("MESSAGE_DIGEST",), "MAC": ("MAC",), "SYMMETRIC_KEY_GENERATION": ("KEY_GENERATOR",), "KEY_PAIR_GENERATION": ("KEY_PAIR_GENERATOR",), "SECURE_RANDOM": ("SECURE_RANDOM",), "SECURE_TRANSPORT": ("TLS_PROTOCOL",),
}
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def _part(raw: Column, i: int) -> Column:
    parts = F.split(raw, "/")
    return F.when(F.size(parts) >= i, F.nullif(F.trim(F.get(parts, F.lit(i - 1))), F.lit("")))


def _any(value: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in needles:
        out = out | value.contains(x)
    return out


def classified(usages: DataFrame) -> DataFrame:
    """Add ``family``, ``mode``, ``padding`` and the predicates ``bare``, ``asymmetric``, ``ecb``, ``legacy``, ``triple_des``, ``weak_digest``, ``old_tls`` to ``usages(owner, raw)``."""
    raw = F.trim("raw")
    out = usages.withColumns({"family": _part(raw, 1), "mode": _part(raw, 2), "padding": _part(raw, 3)})
    upper = F.upper("family")
    flat = F.regexp_replace(upper, "-", "")
    no = lambda x: F.coalesce(x, F.lit(False))
    asymmetric = no(_any(upper, ("RSA", "ELGAMAL", "ECIES")))
    return out.withColumns({
        "bare": no(~raw.contains("/")) & F.col("mode").isNull() & F.col("padding").isNull(),
        "asymmetric": asymmetric,
        "ecb": ~asymmetric & (no(F.upper("mode") == "ECB") | no(F.upper(raw).rlike("/ECB(/.*)?$|^ECB$"))),
        "legacy": no(upper.isin(*LEGACY)),
        "triple_des": no(upper.isin(*TRIPLE)),
        "weak_digest": no(flat.isin(*WEAK_DIGESTS)),
        "old_tls": no(upper.isin(*OLD_TLS)),
    })


#: (rule, owner, predicate, severity, category, CWE, message before the raw name, and after it, status property)
RULES = (
    ("CC-CRYPTO-001", "CIPHER", "ecb", "HIGH", "CRYPTOGRAPHY", "CWE-327", "Insecure Electronic Codebook (ECB) cipher mode selected: '", "'.", "mode=ECB"),
    ("CC-CRYPTO-002", "CIPHER", "legacy", "HIGH", "CRYPTOGRAPHY", "CWE-327", "Broken legacy cipher algorithm selected: '", "'.", "status=BROKEN"),
    ("CC-CRYPTO-002", "CIPHER", "triple_des", "MEDIUM", "CRYPTOGRAPHY", "CWE-327", "Deprecated Triple DES (3DES/DESede) cipher selected: '", "'.", "status=DEPRECATED"),
    ("CC-CRYPTO-003", "MESSAGE_DIGEST", "weak_digest", "MEDIUM", "CRYPTOGRAPHY", "CWE-328", "Weak or collision-broken message digest algorithm '", "' selected.", ""),
    ("CC-CRYPTO-004", "CIPHER", "bare", "MEDIUM", "CRYPTOGRAPHY", "CWE-327", "Cipher transformation '", "' omits explicit mode and padding specifications.", "issue=UNSPECIFIED_MODE_AND_PADDING"),
    ("CC-TLS-001", "SSL_CONTEXT", "old_tls", "HIGH", "TLS", "CWE-326", "Obsolete and deprecated TLS protocol version requested: '", "'.", "status=DEPRECATED"),
)


class Registry:
    """Rules by id: a predicate over classified usages, or over calls and creations, and what a finding says. One usage may fire several."""

    def __init__(self, rules: tuple = RULES):
        self.rules = list(rules)
        self.call_rules: list[CallRule] = []

    def register(self, rule: tuple) -> None:
        """Add a rule in place of those of its id."""
        self.rules = [r for r in self.rules if r[0] != rule[0]] + [rule]

    def get(self, rule_id: str) -> list[tuple]:
        return [r for r in self.rules if r[0] == rule_id]

    def clear(self) -> None:
        self.rules, self.call_rules = [], []

    def register_call(self, rule: CallRule) -> None:
        """Add a rule over calls or object creations in place of those of its id."""
        self.call_rules = [r for r in self.call_rules if r.rule_id != rule.rule_id] + [rule]


def findings(usages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row for each rule that a confirmed, resolved usage fires, from a single pass over ``usages(owner, raw, path, line, col, confidence, resolved)``."""
    rows = classified(usages.where("resolved and confidence = 'HIGH'"))
    made = []
    for rule, owner, predicate, severity, category, cwe, before, after, status in (registry or Registry()).rules:
        fires = F.col(predicate) if isinstance(predicate, str) else predicate
        if isinstance(predicate, str) and predicate == "triple_des":
            fires = fires & ~F.col("legacy")
        said = F.struct(
            F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(cwe).alias("cwe"),
            F.concat(F.lit(before), F.col("raw"), F.lit(after)).alias("message"), F.lit(status).alias("status"),
        )
        made.append(F.when((F.col("owner") == owner) & fires, said))
    said = "rule_id:string,severity:string,category:string,cwe:string,message:string,status:string"
    fired = F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.expr(f"cast(array() as array<struct<{said}>>)")
    places = ["path", "line", "col", "raw", *[c for c in ("end_line", "end_col", "source", "family") if c in usages.columns or (c == "family" and "source" in usages.columns)]]
    found = rows.select(*places, F.explode(fired).alias("f")).select(*places, "f.*")
    if "source" in usages.columns:
        how = F.when(F.col("rule_id") == "CC-TLS-001", "requested protocol").when(F.col("rule_id") == "CC-CRYPTO-004", "bare transformation").when(F.col("rule_id") == "CC-CRYPTO-003", "resolved digest").otherwise("resolved cipher")
        found = found.withColumn("evidence", F.concat(F.lit("API call: "), "source", F.lit(" with "), how, F.lit(" '"), "raw", F.lit("'"))).drop("source")
    return found


#: Name of each rule and what to do about its findings.
ADVICE = {
    "CC-CRYPTO-001": ("Insecure ECB Mode Encryption", "Use an authenticated mode, such as AES/GCM/NoPadding."),
    "CC-CRYPTO-002": ("Legacy Cipher Algorithm", "Use AES/GCM/NoPadding or ChaCha20-Poly1305."),
    "CC-CRYPTO-003": ("Weak Message Digest", "Use SHA-256, SHA-384, SHA-512 or SHA-3."),
    "CC-CRYPTO-004": ("Provider-Dependent Cipher Transformation", "Name mode and padding, such as AES/GCM/NoPadding."),
    "CC-TLS-001": ("Obsolete TLS Protocol Selection", "Ask for TLSv1.2 or TLSv1.3."),
    "CC001": ("Architectural Cycle", "Break the cycle at its weakest link, or put an interface between its types."),
    "CC002": ("High-Risk Hotspot", "Add tests before changes and split responsibilities."),
    "DEMO001": ("Demonstration Rule", "Remove the call."),
}


CALLS, CREATIONS = ("METHOD_CALL", "STATIC_METHOD_CALL", "SUPER_CALL"), ("CONSTRUCTOR_CALL",)


class CallRule(NamedTuple):
    """A rule over resolved calls or object creations: fires where ``predicate`` holds on a row of ``invocations`` of one of the kinds ``on``."""

    rule_id: str
    on: tuple[str, ...]
    predicate: Column
    severity: str
    category: str
    cwe: str | None
    message: Column


def call_findings(invocations: DataFrame, rules: list[CallRule]) -> DataFrame:
    """One row for each rule that a call or creation fires, from a single pass over ``invocations``; no rule, no row."""
    made = []
    for r in rules:
        said = F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.cwe).cast("string").alias("cwe"), r.message.alias("message"), F.lit("").alias("status"),
        )
        made.append(F.when(F.col("kind").isin(*r.on) & r.predicate, said))
    kind = "array<struct<rule_id:string,severity:string,category:string,cwe:string,message:string,status:string>>"
    fired = F.filter(F.array(*made), lambda x: x.isNotNull()).cast(kind) if made else F.array().cast(kind)
    return invocations.select("path", "line", "col", F.col("method").alias("raw"), F.explode(fired).alias("f")).select("path", "line", "col", "raw", "f.*")


def demonstration(invocations: DataFrame, hook: str = "demoHook") -> DataFrame:
    """DEMO001: an INFO finding for each call of a method named ``hook``; shows how a rule over calls is made."""
    rule = CallRule("DEMO001", CALLS, F.col("method") == hook, "INFO", "CODE_QUALITY", None, F.concat(F.lit("The hook of the demonstration rule is called: "), "method"))
    return call_findings(invocations, [rule])


def isolated(evaluate: Callable[[list], DataFrame], rules: list, name: Callable = lambda r: r[0]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """What ``evaluate`` finds with all of ``rules`` that work, written, and ``(rule, error)`` of those that don't.

    All rules run in one pass. Only if that fails is the failing one looked for, by halves; where
    all fail, and no rule at all as well, it is no rule's fault and the error is raised.
    """
    try:
        return stored(evaluate(rules), "findings"), []
    except Exception as e:  # whatever a rule raises, when planned or run
        if not rules:
            raise
        if len(rules) == 1:
            return stored(evaluate([]), "findings"), [(name(rules[0]), str(e).strip().split("\n")[0])]
    half = len(rules) // 2
    (a, wrong), (b, more) = isolated(evaluate, rules[:half], name), isolated(evaluate, rules[half:], name)
    return a.unionByName(b), wrong + more


def deduplicated(found: DataFrame) -> DataFrame:
    """One finding for each rule, path, place (its end too, if known) and evidence, or message where there is no evidence."""
    said = F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.col("message")) if "evidence" in found.columns else F.col("message")
    return found.withColumn("_said", said).dropDuplicates(["rule_id", "path", *[c for c in ("line", "col", "end_line", "end_col") if c in found.columns], "_said"]).drop("_said")


def searched(rows: DataFrame, text: str = "", columns: tuple[str, ...] = ("rule_id", "message", "path"), **equal: str) -> DataFrame:
    """Rows of which some of ``columns`` contains ``text`` (any case; all rows for a blank one) and whose other columns equal what is given ("ALL" is any)."""
    wanted = text.strip().lower()
    hit = F.lit(wanted == "")
    for c in columns if wanted else ():
        hit = hit | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    out = rows.where(hit)
    for c, value in equal.items():
        out = out.where(F.col(c) == value) if value != "ALL" else out
    return out


#: Orders of the interactive tables; they differ from the reports' own.
SHOWN = {
    "severity": ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"),
    "priority": ("INFO", "LOW", "MEDIUM", "REVIEW_REQUIRED", "HIGH", "CRITICAL"),
    "exposure": ("QUANTUM_SAFE", "UNKNOWN", "QUANTUM_IMPACTED", "CLASSICALLY_WEAK", "QUANTUM_VULNERABLE"),
}


def shown_rank(column: str) -> Column:
    """The place of a severity, priority or exposure in an interactive table; what isn't listed has the lowest."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, SHOWN[column])), F.col(column)), F.lit(0)) - 1, F.lit(0))


def unresolved(rows: DataFrame) -> DataFrame:
    """Usages of :func:`described` whose asset is unknown, each once."""
    return rows.where("not resolved_asset").dropDuplicates(["key", "usage_id"])


def breakdown(rows: DataFrame, by: str) -> DataFrame:
    """Distinct usages for each value of ``by`` (``asset_family`` or ``primitive``), most first."""
    return rows.dropDuplicates(["key", "usage_id"]).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "col", "rule_id", severity_rank(F.col("severity")), "message")


def severity_histogram(found: DataFrame) -> DataFrame:
    """Findings of each severity, zeros kept."""
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    dim = found.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, severity_rank int")
    return dim.join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n"))


def severity_cards(found: DataFrame) -> DataFrame:
    n = lambda *s: F.count(F.when(F.col("severity").isin(*s), 1))
    return found.agg(n("HIGH", "CRITICAL").alias("high"), n("MEDIUM").alias("medium"), n("LOW", "INFO").alias("low"))


def top_files(found: DataFrame, count: int = 5) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(count)


def resolution_ratio(usages: DataFrame) -> DataFrame:
    good = F.count(F.when(F.col("resolved") & (F.col("confidence") == "HIGH"), 1))
    return usages.agg(good.alias("resolved"), (F.count("*") - good).alias("unresolved"), F.when(F.count("*") == 0, 1.0).otherwise(good / F.count("*")).alias("ratio"))


def family(raw: Column) -> Column:
    """The normalised family; the order of the cases matters."""
    f = F.regexp_replace(F.upper(F.trim(raw)), "-", "")
    out = (
        F.when(raw.isNull() | (f == ""), "UNKNOWN").when(f == "AES", "AES").when(f == "DES", "DES").when(f.isin("DESEDE", "3DES", "TRIPLEDES"), "3DES").when(f == "RC2", "RC2")
        .when(f.isin("RC4", "ARCFOUR"), "RC4").when(f == "BLOWFISH", "Blowfish").when(f.startswith("CHACHA20"), "ChaCha20")
        .when(f.isin("ECDH", "DH") | f.contains("DIFFIEHELLMAN"), "Diffie-Hellman").when(f.contains("RSA"), "RSA").when(f.contains("ECDSA"), "ECDSA")
        .when((f == "EC") | f.contains("ELLIPTIC"), "EC").when(f.contains("DSA"), "DSA").when(f.contains("ED25519"), "Ed25519").when(f.startswith("HMAC"), "HMAC")
        .when(f.isin("MD2", "MD4", "MD5"), f).when(f == "SHA1", "SHA-1").when(f.startswith("SHA2") | f.isin("SHA256", "SHA384", "SHA512", "SHA224"), "SHA-2")
        .when(f.startswith("SHA3"), "SHA-3").when(f.startswith("TLS") | f.startswith("SSL"), "TLS")
    )
    return out.otherwise(raw)


def primitive(owner: Column, fam: Column) -> Column:
    up = F.upper(fam)
    cipher = F.when(up.contains("RSA") | up.contains("ELGAMAL") | up.contains("ECIES"), "PUBLIC_KEY_ENCRYPTION").when(up.contains("CHACHA20") | up.contains("RC4") | up.contains("ARCFOUR"), "STREAM_CIPHER").otherwise("BLOCK_CIPHER")
    return F.when(owner == "CIPHER", cipher).when(owner == "SSL_CONTEXT", "TLS_PROTOCOL").when(owner.isin(*(o for o in OWNERS if o not in ("CIPHER", "SSL_CONTEXT"))), owner).otherwise("OTHER")


def described(usages: DataFrame) -> DataFrame:
    """Add ``resolved_asset``, ``name``, ``key``, ``asset_family``, ``primitive`` and ``usage_id`` to usages with their transformation parsed."""
    rows = classified(usages)
    solved = F.coalesce(F.col("resolved") & (F.col("confidence") == "HIGH") & F.col("family").isNotNull(), F.lit(False))
    name = F.when(F.col("mode").isNotNull() & F.col("padding").isNotNull(), F.concat(F.upper("family"), F.lit("/"), F.upper("mode"), F.lit("/"), "padding")).when(F.col("mode").isNotNull(), F.concat(F.upper("family"), F.lit("/"), F.upper("mode"))).otherwise(F.trim("raw"))
    rows = rows.withColumn("resolved_asset", solved)
    rows = rows.withColumn("name", F.when(F.col("resolved_asset"), name).otherwise(F.concat(F.lit("UNKNOWN-"), "owner")))
    rows = rows.withColumn("key", F.when(F.col("resolved_asset"), F.concat_ws("|", "owner", F.upper("name"))).otherwise(F.concat_ws("|", "owner", F.lit("UNKNOWN"))))
    rows = rows.withColumn("asset_family", F.when(F.col("resolved_asset"), family(F.col("family"))).otherwise("UNKNOWN"))
    rows = rows.withColumn("primitive", primitive(F.col("owner"), F.when(F.col("resolved_asset"), F.col("family")).otherwise(F.lit(""))))
    return rows.withColumn("usage_id", F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string")))


def inventory(rows: DataFrame) -> DataFrame:
    """Assets of :func:`described` usages: one for each key, its usages distinct by place, its name the first seen by path, line and column."""
    distinct = rows.dropDuplicates(["key", "usage_id"])
    first = F.min(F.struct("path", "line", "col", "name", F.upper("mode").alias("mode"), "padding", "asset_family", "primitive"))
    return distinct.groupBy("key").agg(
        first.alias("f"), F.max("resolved_asset").alias("is_resolved"), F.count("*").alias("usage_count"), F.countDistinct("path").alias("files"), F.max(F.col("confidence") == "HIGH").alias("any_high")
    ).select(
        F.concat(F.lit("crypto-asset-"), F.lower(F.hex(F.encode("key", "UTF-8")))).alias("asset_id"), "key", "f.name", "f.asset_family", "f.primitive", "f.mode", "f.padding",
        "is_resolved", "usage_count", "files", F.when(F.col("is_resolved") & F.col("any_high"), "HIGH").otherwise("LOW").alias("confidence"),
    )


def relationships(rows: DataFrame) -> DataFrame:
    return rows.select("usage_id", F.concat(F.lit("crypto-asset-"), F.lower(F.hex(F.encode("key", "UTF-8")))).alias("asset_id"), F.lit("USES_ALGORITHM").alias("relation")).distinct()


def summary(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: observations before usages are made distinct, assets, resolved assets, unresolved usages, files."""
    distinct = rows.dropDuplicates(["key", "usage_id"])
    a = rows.agg(F.count("*").alias("observations"))
    b = distinct.agg(F.count(F.when(~F.col("resolved_asset"), 1)).alias("unresolved_usages"), F.countDistinct("path").alias("files"))
    c = assets.agg(F.count("*").alias("unique_assets"), F.count(F.when(F.col("is_resolved"), 1)).alias("resolved_assets"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def exposure(assets: DataFrame) -> DataFrame:
    """Add ``exposure``, ``purpose``, ``priority``, ``category`` and ``recommendation`` to assets; cases are tried in order."""
    name, fam, prim = F.upper("name"), F.upper("asset_family"), F.col("primitive")
    shor = _any(fam, ("RSA", "DIFFIE-HELLMAN", "EC", "ED25519", "ED448", "X25519", "X448")) | fam.isin("DH", "DSA") | _any(name, ("RSA", "ECDSA", "DIFFIE", "DH"))
    shor = shor | prim.isin("PUBLIC_KEY_ENCRYPTION", "SIGNATURE", "KEY_AGREEMENT", "KEY_PAIR_GENERATOR")
    level = (
        F.when(~F.col("is_resolved"), "UNKNOWN").when(_any(name, SAFE) | _any(fam, SAFE), "QUANTUM_SAFE")
        .when(fam.isin(*CLASSICALLY_WEAK), "CLASSICALLY_WEAK").when(name.contains("SHA1PRNG") | (fam == "SHA1PRNG"), "UNKNOWN").when(shor, "QUANTUM_VULNERABLE")
        .when(prim.isin("BLOCK_CIPHER", "STREAM_CIPHER", "MESSAGE_DIGEST", "MAC", "KEY_GENERATOR", "SECURE_RANDOM"), "QUANTUM_IMPACTED").otherwise("UNKNOWN")
    )
    purpose = F.when(~F.col("is_resolved"), "UNKNOWN")
    for value, of in PURPOSES.items():
        purpose = purpose.when(prim.isin(*of), value)
    purpose = purpose.otherwise("UNKNOWN")
    out = assets.withColumns({"exposure": level, "purpose": purpose})
    e, p = F.col("exposure"), F.col("purpose")
    template = (
        F.when(~F.col("is_resolved") | (p == "SECURE_TRANSPORT"), "none").when(e == "CLASSICALLY_WEAK", "classicalRemediation")
        .when((e == "QUANTUM_VULNERABLE") & (p == "DIGITAL_SIGNATURE"), "mlDsaSignature").when((e == "QUANTUM_VULNERABLE") & (p == "KEY_AGREEMENT"), "mlKemKeyExchange")
        .when((e == "QUANTUM_VULNERABLE") & (p == "PUBLIC_KEY_ENCRYPTION"), "kemDemArchitecture").when((e == "QUANTUM_VULNERABLE") & (p == "KEY_PAIR_GENERATION"), "keyPairUsageDependent")
        .when((e == "QUANTUM_IMPACTED") & p.isin("SYMMETRIC_ENCRYPTION", "SYMMETRIC_KEY_GENERATION"), F.when(name.contains("128"), "symmetricUpgrade128").otherwise("symmetricUpgrade"))
        .when((e == "QUANTUM_IMPACTED") & p.isin("HASH_FUNCTION", "MAC"), "hashBaseline").when((e == "QUANTUM_IMPACTED") & (p == "SECURE_RANDOM"), "none").when(e == "QUANTUM_SAFE", "pqcApproved")
        .when(name.contains("SHA1PRNG") | (fam == "SHA1PRNG"), "providerAudit").otherwise("none")
    )
    return out.withColumns({
        "priority": F.when(~F.col("is_resolved"), "PRIORITY_UNDETERMINED").when(e == "QUANTUM_SAFE", "LOW").otherwise("REVIEW_REQUIRED"),
        "category": F.when(~F.col("is_resolved") | (e == "UNKNOWN"), "UNKNOWN_OR_UNRESOLVED").when(e == "CLASSICALLY_WEAK", "CLASSICAL_REMEDIATION").when(e == "QUANTUM_IMPACTED", "QUANTUM_CONSIDERATION").otherwise("PQC_MIGRATION_CANDIDATE"),
        "recommendation": template,
    })


#: Standard, target algorithms and strategy behind each recommendation.
TEMPLATES = {
    "mlDsaSignature": ("NIST FIPS 204 / FIPS 205", ("ML-DSA-44", "ML-DSA-65", "ML-DSA-87", "SLH-DSA"), "Move signatures to ML-DSA; SLH-DSA is the hash-based fallback."),
    "mlKemKeyExchange": ("NIST FIPS 203", ("ML-KEM-512", "ML-KEM-768", "ML-KEM-1024"), "Use hybrid key establishment where protocols support it."),
    "kemDemArchitecture": ("NIST FIPS 203", ("ML-KEM + symmetric AEAD",), "Redesign: encapsulate a symmetric key with ML-KEM, encrypt the payload with an AEAD."),
    "keyPairUsageDependent": ("NIST FIPS 203 / FIPS 204 / FIPS 205", ("ML-DSA", "SLH-DSA", "ML-KEM"), "Find out what the keys are for: signatures or key encapsulation."),
    "symmetricUpgrade": ("NIST SP 800-175B", ("AES-256-GCM",), "Keep or move to keys of 256 bits."),
    "symmetricUpgrade128": ("NIST SP 800-175B", ("AES-256-GCM",), "Keys of 128 bits keep 64 bits against quantum search: move to 256."),
    "hashBaseline": ("NIST FIPS 180-4 / FIPS 202", ("SHA-256", "SHA-384", "SHA-512", "SHA3-256", "SHA3-512"), "Keep modern digests; SHA-384 or SHA-512 for a wider margin."),
    "classicalRemediation": ("NIST classical deprecation", ("AES-256-GCM", "SHA-256", "SHA-3"), "Replace it now; it is broken without any quantum computer."),
    "pqcApproved": ("NIST post-quantum standard", (), "A standard post-quantum algorithm by its name; the provider isn't checked."),
    "providerAudit": ("Provider review", (), "Check which provider serves it and how it is seeded."),
    "none": ("None required", (), "Nothing to change; watch the standards."),
}
THREATS = {
    "QUANTUM_VULNERABLE": "Shor's algorithm breaks the factoring or discrete logarithm problem that it rests on.",
    "CLASSICALLY_WEAK": "Broken or deprecated by classical cryptanalysis, whatever quantum computers do.",
    "QUANTUM_SAFE": "A standard post-quantum algorithm, lattice- or hash-based.",
    "UNKNOWN": "The argument isn't known statically, so the exposure can't be told.",
}


def advised(assessed: DataFrame) -> DataFrame:
    """Assessed assets with ``threat``, ``standard``, ``targets`` and ``strategy``; the templates are a fixed broadcast table."""
    spark = assessed.sparkSession
    dim = spark.createDataFrame([(k, a, list(b), c) for k, (a, b, c) in TEMPLATES.items()], "recommendation string, standard string, targets array<string>, strategy string")
    e, p = F.col("exposure"), F.col("purpose")
    threat = F.when(F.upper("name").contains("SHA1PRNG"), "Its strength depends on the provider and on seeding; the provider must be checked.").when(p == "SECURE_TRANSPORT", "Key establishment can't be seen from the protocol's name, so the exposure is unknown.")
    for level, text in THREATS.items():
        threat = threat.when(e == level, text)
    threat = threat.when((e == "QUANTUM_IMPACTED") & p.isin("SYMMETRIC_ENCRYPTION", "SYMMETRIC_KEY_GENERATION"), "Grover's search halves the bits of a key: 256 become 128, 128 become 64.").otherwise("Grover's search halves the bits of preimages; digests of 256 bits and more hold.")
    targets = F.when(F.col("recommendation") == "pqcApproved", F.array("name")).otherwise(F.col("targets"))
    return assessed.withColumn("threat", threat).join(F.broadcast(dim), "recommendation").withColumn("targets", targets)


def blast_radius(users: DataFrame, edges: DataFrame, scores: DataFrame, depth: int = 10, shared_from: int = 5, names: bool = False, kernel_edges: int | None = None) -> DataFrame:
    """What calls the types that use each asset: ``(key, direct, transitive_only, reachable, max_depth, cumulative_risk, shared_utility)`` from ``users(key, target)``.

    Each caller counts once, at its least depth over all types of the asset; a using type that
    calls another one is a caller too. An asset is a shared utility if one of its types has
    ``shared_from`` direct callers. Types are reached once, however many assets share them. With
    ``names``, ``direct_classes`` and ``transitive_classes`` list the callers, for a report; else, up
    to ``kernel_edges`` (HELD_EDGES) edges, tasks that hold the graph count them by asset.
    """
    users = users.where("target is not null").distinct()
    step = None if names else stored(graph.steps(edges), "step")
    if step is not None and step.count() <= (balls.HELD_EDGES if kernel_edges is None else kernel_edges):
        nodes, links = balls.in_numbers(step)
        keys = balls.named("key", users, "key", "g")
        asked = users.join(nodes.withColumnRenamed("id", "target"), "target").join(keys, keys["key"] == users["key"]).select(F.col("n").alias("a"), F.col("g").alias("b"))
        known = scores.select("id", F.col("score").cast("double").alias("b")).where("b is not null").join(nodes, "id").select(F.col("n").alias("a"), "b")
        found = balls.searched(links, asked, asked.count(), balls.by_group(depth if depth > 0 else 10, 0.01, shared_from), "g long, direct long, transitive_only long, reachable long, max_depth int, cumulative_risk double, shared_utility boolean", known)
        rows = keys.join(found, "g", "left").drop("g")
        return rows.fillna({"direct": 0, "transitive_only": 0, "reachable": 0, "max_depth": 0, "cumulative_risk": 0.0, "shared_utility": False})
    reached = stored(graph.reach(edges, users.select("target"), depth), "reached")
    near = users.join(reached, "target").groupBy("key", "id").agg(F.min("depth").alias("depth"))
    fan = reached.where("depth = 1").groupBy("target").agg(F.count("*").alias("n"))
    shared = users.join(fan, "target").groupBy("key").agg((F.max("n") >= shared_from).alias("shared_utility"))
    risk = F.coalesce("score", F.lit(0.01)) / F.pow(F.lit(2.0), F.col("depth") - 1)
    counts = near.join(scores.select("id", "score"), "id", "left").groupBy("key").agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count(F.when(F.col("depth") > 1, 1)).alias("transitive_only"), F.count("*").alias("reachable"), F.max("depth").alias("max_depth"), F.sum(risk).alias("cumulative_risk"),
        *([F.array_sort(F.collect_list(F.when(F.col("depth") == 1, F.col("id")))).alias("direct_classes"), F.array_sort(F.collect_list(F.when(F.col("depth") > 1, F.col("id")))).alias("transitive_classes")] if names else []),
    )
    rows = users.select("key").distinct().join(counts, "key", "left").join(shared, "key", "left")
    return rows.fillna({"direct": 0, "transitive_only": 0, "reachable": 0, "max_depth": 0, "cumulative_risk": 0.0, "shared_utility": False})


def report(assessed: DataFrame) -> DataFrame:
    """One row of counts by exposure and priority."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1)).alias(v.lower())
    return assessed.agg(F.count("*").alias("assets"), *[n("exposure", x) for x in ("QUANTUM_VULNERABLE", "QUANTUM_IMPACTED", "CLASSICALLY_WEAK", "QUANTUM_SAFE", "UNKNOWN")], *[n("priority", x) for x in ("REVIEW_REQUIRED", "PRIORITY_UNDETERMINED", "LOW")])
