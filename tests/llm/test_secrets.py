import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm.secrets import find, joined, redact

SECRET = "password: hunter2secret"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_by_hand(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x for *_, x in sorted(out))


@given(st.text(alphabet=st.sampled_from(list("tokensecrpaswd:= \"'AKI09fé_\n")), max_size=80) | st.lists(st.sampled_from(["token", "secret", "=", ":", " ", "abcdef", "AKIA", "0123456789abcdef" * 2, "ABCDEFGHIJKLMNOP", "ſecret", "é"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert joined(find(text).base) == base_by_hand(text)


def nested(layers):
    out = SECRET.encode()
    for layer in layers:
        out = {"b64": base64.b64encode, "gzip": lambda x: gzip.compress(x, mtime=0), "zlib": zlib.compress, "url": lambda x: "".join(f"%{b:02x}" for b in x).encode(), "u": lambda x: "".join(f"\\u{b:04x}" for b in x).encode()}[layer](out)
    return out.decode()


@pytest.mark.parametrize("layers", [["b64"], ["url"], ["u"], ["b64", "b64"], ["gzip", "b64"], ["zlib", "b64", "url"], ["b64", "gzip", "b64", "b64"], ["u", "b64"], ["url", "url"]])
def test_nested_layers_map_to_the_stretch_that_encodes_them(layers):
    blob = nested(layers)
    found = find(f"é {blob} end")
    assert f"assign:2:{2 + len(blob)}" in joined(found.added).split(",")
    assert found.depth >= 1 and SECRET not in (redact(f"é {blob} end") or "")


def test_single_escapes_map_to_their_own_places():
    text = "x pass%77ord: hunter2secret y"
    assert joined(find(text).added) == f"assign:2:{text.index(' y')}"
    assert joined(find("to\\u006ben=abcdefgh.").added) == "assign:0:20"
    assert joined(find("q" + quote("token=abcdefgh z", safe="")).added) == "assign:1:17"


def test_long_and_hostile_texts_end():
    for t in ["a" * 200_000, "%25" * 50_000, "%" * 200_000, "\\" * 200_000, "&#65;" * 20_000, "AKIA" * 50_000, "token" + " " * 200_000]:
        find(t)


def encoded(data):
    return base64.b64encode(data).decode()


def test_long_streams_are_scanned_in_chunks(monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 1 << 20)
    text = b"filler words " * 300_000 + SECRET.encode() + b" filler" * 100_000
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        blob = encoded(pack(text))
        assert joined(find(blob).added) == f"assign:0:{len(blob)}"
    blob = encoded(gzip.compress(zlib.compress(text)))
    assert joined(find(blob).added) == f"assign:0:{len(blob)}"
    for at in range(1 << 20, (1 << 20) - 30, -7):  # across the edge of a chunk
        assert "assign" in joined(find(encoded(zlib.compress(b"x " * (at // 2) + SECRET.encode() + b" y" * (1 << 20)))).added)


def test_what_asks_for_too_much_is_reported(monkeypatch):
    monkeypatch.setattr(secrets, "INFLATED", 1 << 20)
    assert "opaque" in joined(find(encoded(zlib.compress(b"0" * (1 << 21)))).added)
    monkeypatch.undo()
    monkeypatch.setattr(secrets, "DECODER", 1 << 20)
    big = lzma.compress(SECRET.encode(), filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 64 << 20}])
    assert "opaque" in joined(find(encoded(big)).added)
    wide = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=27, write_content_size=0)).compressobj()
    wide = wide.compress(SECRET.encode()) + wide.flush()
    assert "opaque" in joined(find(encoded(wide)).added)
    monkeypatch.undo()
    assert "assign" in joined(find(encoded(big)).added) and "assign" in joined(find(encoded(wide)).added)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
def test_members_prefixes_and_other_encodings(pack):
    two = encoded(pack(b"nothing in this one ") + pack(b" but " + SECRET.encode()))
    assert (pack is zlib.compress) or "assign" in joined(find(two).added)
    assert "assign" in joined(find(encoded(b"\x00\x01head" + pack(SECRET.encode() * 3))).added) or pack is zlib.compress
    for odd in ("i", "id", "id_", "id__"):
        blob = odd + encoded(SECRET.encode() + b"\xff\xfe\x00 bytes")
        assert joined(find(blob).added) == f"assign:0:{len(blob.rstrip('='))}" or joined(find(blob).added) == f"assign:0:{len(blob)}"
    for codec in ("utf-16", "utf-16-be", "utf-32"):
        assert "assign" in joined(find(encoded(("é " + SECRET).encode(codec))).added)
    assert "assign" in joined(find(encoded(b"\x01\x02\x03\x04 " + SECRET.encode())).added)


def test_table_keeps_rows_and_columns(spark, docs):
    df = docs([(1, SECRET), (1, SECRET), (2, None), (3, ""), (None, "none here")]).withColumn("secrets", F.lit("old"))
    rows = {(r["doc_id"], r["text"]): r["secrets"] for r in secrets.secrets(df).collect()}
    assert [(s["kind"], s["start"], s["end"], s["decoded"]) for s in rows[1, SECRET]] == [("assign", 0, 23, False)]
    assert rows[2, None] == rows[3, ""] == rows[None, "none here"] == []
    cleaned = secrets.redacted(df)
    assert cleaned.columns == df.columns and sorted(str(r["text"]) for r in cleaned.collect()) == sorted(["<secret>", "<secret>", "None", "", "none here"])
    assert secrets.secrets(df.limit(0)).count() == 0


def test_query_digest(spark, tmp_path, docs):
    docs([(1, SECRET + " " + nested(["b64"])), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in secrets.op1_secret_scans(spark, str(tmp_path)).collect()}
    assert rows[1]["n_assign"] == 1 and rows[1]["base_sha256"] == hashlib.sha256(b"assign:0:23").hexdigest() and rows[1]["spans"].startswith("assign:0:23,assign:24:")
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
