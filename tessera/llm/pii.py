"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans; regex, gazetteer and context labelers vote on each; expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is; the
posteriors train a logistic span classifier, which decides on the spans beyond the strict ones.
"""

from __future__ import annotations

from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from .common import table

KINDS = ("email", "ip", "card", "phone", "person")
#: Characters on either side of a span that labelers look at, rounds of the estimates, and the chance from which a span is taken.
NEAR, ROUNDS, STEPS, CHANCE = 40, 50, 300, 0.5


class Pattern(NamedTuple):
    """``strict``: the pattern is of the base definition, whose valid matches always stay. ``gate``: an inexpensive test without which the text has no match."""

    kind: str
    strict: bool
    regex: str
    gate: str


# Possessive loops match what greedy ones do here and neither recurse nor backtrack; a look-behind (or
# the end of the match before, \G) keeps a run that failed from being tried again at each of its characters.
PATTERNS = (
    Pattern("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    Pattern("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Pattern("card", True, r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    Pattern("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Pattern("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\(@\)|\[@\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\(\.\)|\[\.\]| dot ) ?[A-Za-z0-9-]{2,63}+)++", r"\(dot\)|\[dot\]|\(\.\)|\[\.\]| dot "),
    Pattern("phone", False, r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Pattern("person", False, r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?)\.? \p{Lu}[\p{L}'-]{1,30}+(?: \p{Lu}[\p{L}'-]{1,30}+)?", r"Mr|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor"),
)
LABELERS = ("by_check", "by_list", "by_context", "by_shape", "by_edge")

TLDS = r"(?i)(?:\.|dot\W? ?)(?:com|org|net|edu|gov|info|io|co|fr|de|es|eu|uk|us|ca|it|nl|ch|at|be)$"
ISSUERS = r"^(?:4(?:.{12}|.{15}|.{18})|5[1-5].{14}|2[2-7].{14}|3[47].{13}|3(?:0[0-5]|[68].).{11}|6(?:011|5..).{12}|35.{14})$"
CALLING = r"^(?:1[2-9][0-9]{9}|7[0-9]{10}|2[07][0-9]{7,}|3[0-46-9][0-9]{7,}|4[0-9]{8,}|5[0-9]{8,}|6[0-9]{8,}|8[1-46][0-9]{7,}|9[0-9]{8,}|[0-9]{10})$"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|2[2-5][0-9])\."
NAMES = r"(?i) (?:james|john|robert|michael|william|david|maria|mary|anna|marie|pierre|jean|hans|peter|klaus|juan|jose|carmen|smith|jones|garcia|martin|muller|müller|schmidt|dupont|lopez)\b"
WORDS = {
    "email": r"(?i)e-?mail|contact|write|reach|send|correo|courriel|@|kontakt",
    "ip": r"(?i)\bip\b|server|host|address|login|adresse|client",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta|cvv|expir",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|cell|contact|telefon|téléphone|teléfono|\bsms\b",
    "person": r"(?i)name|dear|born|lives|signed|said|nom|nombre|\bherr\b|sincerely",
}
AGAINST = r"(?i)version|release|isbn|order|invoice|serial|figure|section|chapter|port|sku|part no"


def _found(text: Column, p: Pattern, at: int) -> Column:
    """Matches of ``p`` with their order, the length of the gap before each, and what stands around it: the gaps of a split are what lies between the matches."""
    gaps, hits = F.split(text, p.regex, -1), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    around = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.substring(g, -NEAR, NEAR).alias("left"), F.substring(g, 1, NEAR).alias("right")))
    made = F.transform(
        F.arrays_zip(around.alias("g"), hits.alias("h"), F.slice(around, 2, 1 << 30).alias("n")),
        lambda z, i: F.struct(F.lit(at).alias("pattern"), i.alias("nth"), z["g"]["gap"].alias("gap"), z["g"]["left"].alias("left"), z["h"].alias("hit"), z["n"]["right"].alias("right")),
    )
    kind = "array<struct<pattern:int,nth:int,gap:int,left:string,hit:string,right:string>>"
    return F.when(text.rlike(p.gate), F.filter(made, lambda m: m["hit"].isNotNull())).otherwise(F.array()).cast(kind)


def _luhn(digits: Column) -> Column:
    """True if the check digit is right; ``digits`` has at most 19."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise(F.when(i % 2 == 1, 2 * d.try_cast("int")).otherwise(d.try_cast("int"))))
    return F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each proposed span, with places and votes (1, 0 or -1); a text without any keeps one row of nulls.

    ``row`` numbers the rows of ``docs``; ``start`` and ``end`` are code points. The table is written.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # numbered below the generator: beside it, the number would be that of the generated row
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    found = numbered.select("row", "doc_id", F.explode_outer(F.concat(*[_found(F.col("text"), p, i) for i, p in enumerate(PATTERNS)])).alias("m")).select("row", "doc_id", "m.*")
    before = Window.partitionBy("row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("hit")).over(before)
    by = {k: F.col("pattern").isin([i for i, p in enumerate(PATTERNS) if p.kind == k]) for k in KINDS}
    strict = F.col("pattern").isin([i for i, p in enumerate(PATTERNS) if p.strict])
    spans = found.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("hit")).cast("int")).drop("gap", "nth").withColumn("digits", F.regexp_replace("hit", "[^0-9]", ""))
    n = F.length("digits")
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    valid = (
        F.when(by["ip"], F.col("hit").rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(by["card"], F.when((n >= 13) & (n <= 19), _luhn(F.col("digits"))).otherwise(False))
        .when(by["phone"] & strict, (n >= 9) & (n <= 15))
        .otherwise(strict)
    )
    kind = F.lit(None).cast("string")
    for k in KINDS:
        kind = F.when(by[k], k).otherwise(kind)
    spans = spans.withColumn("kind", kind).withColumn("base", F.coalesce(strict & valid, F.lit(False)))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    around = F.concat("left", F.lit(" "), F.coalesce("right", F.lit("")))
    words = F.lit(False)
    for k, pattern in WORDS.items():
        words = F.when(F.col("kind") == k, around.rlike(pattern)).otherwise(words)
    listed = (
        F.when(F.col("kind") == "email", vote(F.col("hit").rlike(TLDS), F.lit(False)))
        .when(F.col("kind") == "ip", vote(~F.col("hit").rlike(RESERVED), F.lit(True)))
        .when(F.col("kind") == "card", vote(F.col("digits").rlike(ISSUERS), F.lit(True)))
        .when(F.col("kind") == "phone", vote(F.col("digits").rlike(CALLING), F.lit(True)))
        .otherwise(vote(F.col("hit").rlike(NAMES), F.lit(False)))
    )
    odd = F.col("digits").rlike(r"^([0-9])\1+$") | (F.length("hit") > 80)
    shaped = F.when(F.col("kind") == "email", F.col("hit").rlike(r"[A-Za-z0-9]{2}")).when(F.col("kind") == "person", F.col("hit").rlike(r"\. \p{Lu}\p{Ll}")).otherwise(F.col("hit").rlike(r"^[+(]?[0-9]{1,4}(?:[ ().-]+[0-9]{2,4})+$|^[0-9]{15,16}$"))
    edges = F.col("left").rlike(r"[\p{L}\p{N}@#/=_-]$") | F.coalesce(F.col("right"), F.lit("")).rlike(r"^[\p{L}\p{N}@#/=_-]")
    spans = spans.select(
        "row", "doc_id", "kind", "base", "start", "end",
        vote(F.col("base"), strict).alias("by_check"),
        listed.alias("by_list"),
        vote(words, around.rlike(AGAINST)).alias("by_context"),
        vote(shaped & ~odd, odd).alias("by_shape"),
        vote(~edges, edges).alias("by_edge"),
        F.least(F.length("hit") / 8, F.lit(3)).cast("int").alias("size"),
    )
    return stored(spans, "spans")


def reliabilities(counts: list[dict]) -> dict[str, tuple[float, list[dict[int, tuple[float, float]]]]]:
    """For each kind the share of true spans and, for each labeler, the chance of each vote on false and on true spans (Dawid and Skene's estimate).

    ``counts``: rows of kind, votes and ``n``, at most 3 ** 5 for each kind. Starts from majority votes.
    """
    out = {}
    for kind in KINDS:
        rows = [([r[x] for x in LABELERS], r["n"]) for r in counts if r["kind"] == kind]
        if not rows:
            continue
        belief = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in rows]
        for _ in range(ROUNDS):
            total = sum(n for _, n in rows)
            true = sum(b * n for b, (_, n) in zip(belief, rows, strict=True))
            prior = (true + 1) / (total + 2)
            tables = []
            for j in range(len(LABELERS)):
                votes = {x: (1.0, 1.0) for x in (-1, 0, 1)}
                for b, (v, n) in zip(belief, rows, strict=True):
                    no, yes = votes[v[j]]
                    votes[v[j]] = (no + (1 - b) * n, yes + b * n)
                tables.append({x: (no / (total - true + 3), yes / (true + 3)) for x, (no, yes) in votes.items()})
            belief = [posterior(prior, tables, v) for v, _ in rows]
        out[kind] = (prior, tables)
    return out


def posterior(prior: float, tables: list[dict[int, tuple[float, float]]], votes: list[int]) -> float:
    odds = log(prior / (1 - prior)) + sum(log(t[v][1] / t[v][0]) for t, v in zip(tables, votes, strict=True))
    return 1 / (1 + exp(-max(-30.0, min(30.0, odds))))


def _features(row: dict) -> list[float]:
    return [1.0, *[float(row[x] == v) for x in LABELERS[1:] for v in (-1, 1)], *[float(row["size"] == s) for s in range(1, 4)]]


def classifier(counts: list[dict], known: dict) -> dict[str, list[float]]:
    """Weights of a logistic regression for each kind on all votes but the check's, and the span's size; targets are the posteriors."""
    out = {}
    for kind in known:
        rows = [(_features(r), posterior(*known[kind], [r[x] for x in LABELERS]), r["n"]) for r in counts if r["kind"] == kind]
        total, w = sum(n for *_, n in rows), [0.0] * len(rows[0][0])
        for _ in range(STEPS):
            grad = [0.001 * x for x in w]
            for x, y, n in rows:
                p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for j, v in enumerate(x):
                    if v:
                        grad[j] += (p - y) * v * n / total
            w = [a - b for a, b in zip(w, grad, strict=True)]
        out[kind] = w
    return out


def scored(spans: DataFrame) -> DataFrame:
    """``spans`` of :func:`candidates` with ``chance``: what the span classifier, trained on all of them, makes of each."""
    counts = [r.asDict() for r in spans.where(F.col("kind").isNotNull()).groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n")).collect()]
    score = F.lit(-30.0)
    for kind, w in classifier(counts, reliabilities(counts)).items():
        own = F.lit(w[0])
        terms = [(x, v) for x in LABELERS[1:] for v in (-1, 1)] + [("size", s) for s in range(1, 4)]
        for (x, v), weight in zip(terms, w[1:], strict=True):
            own = own + F.when(F.col(x) == v, weight).otherwise(0.0)
        score = F.when(F.col("kind") == kind, own).otherwise(score)
    return spans.withColumn("chance", 1 / (1 + F.exp(-score)))


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``row``, ``doc_id`` and ``spans``, an array of (rank, start, end, kind, base, chance) by kind, then start.

    Strict matches whose checks hold are always there (``base``). Others are there if the classifier
    gives them CHANCE or more and they overlap no base span nor an added one before them. Null and
    empty texts have no spans, as do all in an empty table. Repeated rows stay; extra columns go.
    """
    taken = F.col("base") | ((F.col("by_check") >= 0) & (F.col("chance") >= CHANCE))  # a failed check is no personal datum, whatever stands around it
    spans = scored(candidates(docs, id_col, text_col)).withColumn("kind", F.when(taken, F.col("kind"))).withColumn("end", F.when(taken, F.col("end")))
    w = Window.partitionBy("row").orderBy("start", F.desc("base"), F.desc("end"), "kind")
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    clear = F.col("base") | ((F.coalesce(F.max("end").over(earlier), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.col("end")) >= F.col("end")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.when(F.col("kind").isNotNull() & F.col("_clear"), F.struct(rank.alias("rank"), "start", "end", "kind", "base", "chance"))
    return spans.withColumn("_clear", clear).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span in ``text_col`` replaced by its kind in angle brackets; all rows and columns stay, whatever their names.

    Rows are matched by their number in a written copy, so repeated and null ids are rows of their
    own. Overlapping spans are replaced as one, under the kind of the first. Null stays null; an
    empty table stays empty.
    """
    kept = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(kept))])
    text_col = f"c{kept.index(text_col)}"
    numbered = stored(held.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = personal(numbered.select(F.col("_row").alias("key"), F.col(text_col).alias("text")), "key", "text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)
    rest = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return numbered.join(found.select(F.col("doc_id").alias("_key"), "spans"), F.col("_row") == F.col("_key")).withColumn(text_col, F.when(F.size("spans") > 0, rest).otherwise(text)).select(*held.columns).toDF(*kept)


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``; nulls, repeated rows, an empty table and other columns as in :func:`personal`."""
    found = personal(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k) & s["base"])).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
