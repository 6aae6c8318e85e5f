import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import binary

LIBRARY = Tokenizer.from_file(binary.tokenizer_path())


@given(st.lists(st.text(max_size=60) | st.sampled_from(["It's THE 'Re don't", "a<|endoftext|>b", "Ünï çødé²½ Œuvre ‘x’ — €5", "İstanbul ΟΔΟΣ é", "１２ 中文 한글 x\x85y\x1cz", "''s 'S", "A" * 300]), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_library_does(texts):
    e = binary.encoder(binary.tokenizer_path())
    want = [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, e.dtype).tobytes() for t in texts]
    assert e.by_piece and e.encode(texts) == want


def test_other_tokenizers_go_through_the_library():
    path = binary.tokenizer_path("byte_bpe_50k.json")
    e = binary.Encoder(path)
    assert not e.by_piece
    assert np.frombuffer(e.encode(["Hello  there"])[0], e.dtype).tolist() == Tokenizer.from_file(path).encode("Hello  there", add_special_tokens=False).ids


def test_round_trip(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SEGMENT_DOCS", 7)
    rows = [(i * 3, f"Some words, number {i}. " * (i % 9)) for i in range(120)] + [(500, None), (501, ""), (6, "again"), (6, "again"), (502, "long " * 50_000)]
    path = f"{tmp_path}/out"
    binary.write(docs(rows), path)
    got = sorted(binary.read(spark, path).collect(), key=lambda r: (r["start"], r["doc_id"]))
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in rows)
    at, texts = 0, {}
    for d, t in rows:
        texts.setdefault(d, []).append(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert r["ids"] in texts[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    only = binary.read(spark, path, only=[9, 502, 77777])
    assert sorted(r["doc_id"] for r in only.collect()) == [9, 502]


def test_wrong_dictionary_is_told():
    data = binary.packed([(1, 1, b"")], 0, b"0" * 32, np.dtype("<u2"))
    with pytest.raises(ValueError):
        list(binary.opened(data, b"other"))


def test_empty_table_and_null_id(spark, docs, tmp_path):
    binary.write(docs([]), f"{tmp_path}/none")
    assert binary.read(spark, f"{tmp_path}/none").count() == 0
    binary.write(docs([(None, "x"), (3, "y")]), f"{tmp_path}/null")
    assert [(r["doc_id"], r["start"]) for r in sorted(binary.read(spark, f"{tmp_path}/null").collect(), key=lambda r: r["start"])] == [(None, 0), (3, 2)]


PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿĀ-į]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿĀ-į0-9²³¹¼½¾]+")
PLAIN = "".join(map(chr, [*range(0x130), *range(0x2010, 0x2028), *range(0x2030, 0x2039), 0x20AC]))


def lasts(run):
    """The least CPU seconds of a few runs."""
    out = []
    for _ in range(5):
        begin = time.thread_time()
        run()
        out.append(time.thread_time() - begin)
    return min(out)


def test_encoding_costs_less_than_a_loop_over_pieces():
    texts = [f"Some words of text {k}, which aren't new; they are met again and again, señor. " * 100 for k in range(100)]
    e = binary.Encoder(binary.tokenizer_path())
    e.encode(texts)
    known = {p: b"12" for t in texts for p in PIECES.findall(t.lower())}
    assert lasts(lambda: e.encode(texts)) < lasts(lambda: [b"".join(map(known.__getitem__, PIECES.findall(t.lower()))) for t in texts])


def test_pieces_met_again_stay(monkeypatch):
    monkeypatch.setattr(binary.Encoder, "KEPT", 64)
    e = binary.Encoder(binary.tokenizer_path())
    given_, pieces = [], e._pieces
    monkeypatch.setattr(e, "_pieces", lambda new: (given_.extend(new), pieces(new))[1])
    for k in range(30):
        e.encode(["ever " + " ".join("q" * (1 + i) + chr(97 + k % 26) + "z" * (k // 26) for i in range(9))])
    assert sum(x in (b"ever", "ever") for x in given_) == 1 and len(given_) > 128


@given(st.lists(st.text(st.sampled_from(PLAIN) | st.sampled_from("' 'stmdrevl 09aÉéÏ×÷²½\x85\xa0-.\0"), max_size=80), max_size=6))
@settings(max_examples=300, deadline=None)
def test_split_is_the_pattern(texts):
    for t in texts:
        low, begin, end = binary.split(np.frombuffer(t.encode(), np.uint8))
        assert [low[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == PIECES.findall(t.lower())
    e = binary.encoder(binary.tokenizer_path())
    assert e.encode(texts) == e._whole(texts) and e.by_piece


def test_every_character():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    raw = np.frombuffer("".join(chars).encode(), np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    assert "".join(chars[i] for i in np.searchsorted(first, binary.odd(raw))) == "".join(c for c in chars if c not in PLAIN)
    texts = [x for c in PLAIN for x in (c, f"a{c}b", f"-{c}'s", f"'{c}ve", f"{c}{c}'Re9{c}")]
    e = binary.encoder(binary.tokenizer_path())
    assert e.encode(texts) == e._whole(texts) and e.by_piece


def test_full_tables_and_short_stretches(monkeypatch):
    monkeypatch.setattr(binary.Known, "BITS", 7)
    monkeypatch.setattr(binary.Known, "BLOCK", 32)
    monkeypatch.setattr(binary.Encoder, "KEPT", 64)
    monkeypatch.setattr(binary.Encoder, "STRETCH", 50)
    monkeypatch.setattr(binary.Encoder, "ASSURED", 1 << 40)
    e, r = binary.Encoder(binary.tokenizer_path()), np.random.default_rng(5)
    parts = ["a", "bc", "\0", "\0\0", "eightlet", "eightletters", "sixteenlettersxx", "sixteenlettersxxy", "x" * 31, "x" * 32, "x" * 33, "'ll", "''s", "ÉÉ", "ñ", "²", "7", " ", "\n", " ", "-", "×", "€", "漢字", "<|endoftext|>"]
    for _ in range(60):
        texts = ["".join(parts[i] for i in r.integers(len(parts), size=r.integers(60))) + f"new{r.integers(1 << 30)}x" * 3 for _ in range(5)] + ["", "a'b'c'd'" * 40]
        texts += [f"{x} {x}" for x in map(str, texts[:2]) if "漢" not in x]
        assert e.encode(texts) == e._whole(texts)
    assert e.by_piece
