"""SimHash near-duplicates: fingerprints of word shingles, linked through a pigeonring filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.functions.storage import stored
from tessera.operators.components import components

from .common import bounded, lean, slices, table

#: Words of a shingle, the hash's seed, bits that linked fingerprints may differ in.
WIDTH, SEED, BITS = 3, 42, 3
#: Hashes whose bits are unpacked at once (64 bytes each).
PIECE = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's shingles; 0 without words. Signed."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z is lower-cased, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, at, starts, ends = b" ".join(words), 0, [], []
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit ``hashes`` have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, text_col: str = "text", out: str = "_fingerprint") -> DataFrame:
    """``docs`` without its text, with the column ``out`` (long)."""
    kept = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            bits = pa.array([fingerprint(t, width) for t in batch.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), bits], [*kept, out])

    schema = docs.select(*kept).schema.add(out, "long")
    return docs.select(*kept, text_col).mapInArrow(lean(run), schema)


def _segments(bits: int) -> list[tuple[int, int]]:
    """Shift and width of the segments of a fingerprint, one more than the bits that may differ."""
    cuts = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, bits: int = BITS, col: str = "fp") -> DataFrame:
    """Pairs ``(x, y)`` of distinct fingerprints that differ in ``bits`` bits at most (1 to 7); ``fps`` has each once.

    With ``bits + 1`` segments on a ring, two such fingerprints have a segment from which every
    chain of l segments differs in at most ``l * bits / (bits + 1)`` bits, rounded down: none in
    the first, one in the first two, and so on. The first two steps are the join key: the index
    holds both segments, and a probe holds them too, as they are or with one set bit of the second
    cleared (of two values that differ in one bit, just one has it set, so each pair meets once).
    The longer chains are checked in the join, then the whole distance. Keys of two segments keep
    candidates few: by chance, N fingerprints give about N * N * 36 / 2**32 for 3 bits.
    """
    ring, x, y = _segments(bits), F.col("x"), F.col("y")
    index, probe = [], []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        fp = F.col(col)
        a, b = _segment(fp, *first), _segment(fp, *second)
        key = lambda v, i=i, a=a: F.xxhash64(F.lit(i), a, v)
        index.append(F.struct(F.lit(i).alias("i"), key(b).alias("key")))
        cleared = [F.when(b.bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.lit(i).alias("i"), key(b.bitwiseAND(F.lit(~(1 << k)))).alias("key"), F.lit(False).alias("same"))) for k in range(second[1])]
        probe += [F.struct(F.lit(i).alias("i"), key(b).alias("key"), F.lit(True).alias("same")), *cleared]
    left = fps.select(F.col(col).alias("x"), F.explode(F.filter(F.array(*probe), lambda p: p.isNotNull())).alias("p")).select("x", "p.*")
    right = fps.select(F.col(col).alias("y"), F.explode(F.array(*index)).alias("p")).select("y", "p.key", F.col("p.i").alias("j"))
    apart = x.bitwiseXOR(y)
    chains = F.lit(False)
    for i in range(len(ring)):
        differ, within = F.lit(0), F.col("i") == i
        for n in range(len(ring)):
            differ = differ + F.bit_count(_segment(apart, *ring[(i + n) % len(ring)]))
            within = within & (differ <= (n + 1) * bits // len(ring))
        chains = chains | within
    found = left.join(right, (left["key"] == right["key"]) & (F.col("i") == F.col("j")) & (x != y) & (~F.col("same") | (x < y)) & (F.bit_count(apart) <= bits) & chains)
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row ``(id, fingerprint, component_id)`` for each row of ``docs``.

    ``component_id`` is the least id in the component of fingerprints that link at ``bits``
    differing bits or fewer. Equal fingerprints are one class before any link is sought, so copies
    are never paired. A null or empty text has fingerprint 0 and links like any other. Rows with a
    null id take part, but name no component unless all do (then null). Repeated rows stay. Extra
    columns are dropped. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs.select(id_col, text_col), width, text_col), "fingerprints")
    classes = stored(rows.groupBy(F.col("_fingerprint").alias("fp")).agg(F.min(id_col).alias("least")), "classes")
    near = components(stored(links(classes.select("fp"), bits), "pairs"), "x", "y")
    near = stored(near.join(classes, near["node"] == classes["fp"]).select("fp", "component", "least"), "linked")
    named = near.join(near.groupBy("component").agg(F.min("least").alias("_component")), "component").select("fp", "_component")
    named = classes.join(named, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("_component", "least").alias("component_id"))
    return rows.join(named, rows["_fingerprint"] == F.col("_fp")).select(id_col, F.lpad(F.lower(F.hex("_fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id (of its repeated rows, one; of null ids, one of each component without others).

    Columns stay, whatever their names; null and empty texts are one class; an empty table stays empty.
    """
    kept = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(kept))])
    numbered = stored(held.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col(f"c{kept.index(id_col)}").alias("id"), F.col("_row").alias("row")).alias("_key")
    found = near_duplicates(numbered.select(key, F.col(f"c{kept.index(text_col)}").alias("_text")), width, bits, "_key", "_text")
    found = stored(found.select(F.col("_key.row").alias("_row"), F.struct(F.col("_key.id").isNull().alias("no_id"), F.col("_key.id").alias("id"), F.col("_key.row").alias("row")).alias("k"), "component_id"), "components")
    first = found.groupBy("component_id").agg(F.min("k").alias("k")).select(F.col("k.row").alias("_row"))
    gone = stored(found.select("_row").join(first, "_row", "left_anti"), "gone")
    return numbered.join(bounded(gone), "_row", "left_anti").select(*held.columns).toDF(*kept)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; nulls, empty texts, repeated rows, an empty table and other columns as in :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
