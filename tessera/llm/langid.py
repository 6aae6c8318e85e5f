"""Language identification: scripts narrow candidates, then a Viterbi path over per-word scores labels spans."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, lean, slices, table

#: Character n-grams of a word (with its ends marked), counted in so many hashed cells.
GRAMS, CELLS = (1, 2, 3), 1 << 16
#: What a change of language costs on the path, in nats, and the most that one word may tell.
SWITCH, WORD = 12.0, 20.0
#: A script is a language's own if it holds this share of its letters or more.
SHARE = 0.02
UND = "und"


RUNS = re.compile(r"[^\W\d_]+")
#: Numerals like ``²`` or ``½``, which the library counts among word characters but which are no letters, each to a space.
NUMERALS = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
SPACED = str.maketrans(NUMERALS)
SCRIPTS = [
    ("latin", "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿＡ-Ｚａ-ｚ"),
    ("greek", "Ͱ-Ͽἀ-῿"),
    ("cyrillic", "Ѐ-ԯ"),
    ("armenian", "԰-֏"),
    ("hebrew", "֐-׿"),
    ("arabic", "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"),
    ("devanagari", "ऀ-ॿ"),
    ("bengali", "ঀ-৿"),
    ("thai", "฀-๿"),
    ("georgian", "Ⴀ-ჿ"),
    ("hangul", "ᄀ-ᇿ가-힯"),
    ("kana", "぀-ヿ"),
    ("han", "㐀-䶿一-鿿豈-﫿"),
]
RANGES = [(name, re.compile(f"[{span}]")) for name, span in SCRIPTS]
#: Words kept with their scores in a worker, and bytes of text whose paths are walked together.
KEPT, TOGETHER = 120_000, 2 << 20


_script_of: dict[str, str | None] = {}


def lettered(text: str) -> str:
    """``text`` with each numeral that would pass for a letter as a space, so that RUNS finds runs of letters only; places stay."""
    return text if text.isascii() or NUMERALS.keys().isdisjoint(text) else text.translate(SPACED)


def script(word: str) -> str:
    """The script of the first letter that a range holds; words of scripts without a range are "other"."""
    for c in word:
        if c not in _script_of:
            _script_of[c] = next((name for name, pattern in RANGES if pattern.match(c)), None)
        if _script_of[c]:
            return _script_of[c]
    return "other"


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of the n-grams of lower-cased words between marks, and the index of each one's word."""
    codes = np.frombuffer("".join(f"\1{w}\2" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    out, of = [], []
    for n in GRAMS:
        size = max(0, len(codes) - n + 1)
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : size + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = np.flatnonzero(word[:size] == word[n - 1 : size + n - 1])
        out.append((h[inside] % np.uint64(CELLS)).astype(np.int64))
        of.append(word[inside])
    return np.concatenate(out), np.concatenate(of)


class Model(NamedTuple):
    """``weights``: a row of log-likelihoods for each language; ``scripts``: the languages each script leaves."""

    langs: list[str]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]


#: Scripts by number, in the table of counts; different words that are held, with how often they came, before their n-grams are counted.
NAMES = [name for name, _ in SCRIPTS] + ["other"]
HELD = 50_000


class Counts:
    """What the model is made of, for each language: occurrences of n-gram cells, then letters of each script."""

    def __init__(self):
        self.words: dict[str, Counter] = {}
        self.of: dict[str, np.ndarray] = {}
        self.held = 0

    def add(self, rows: Iterable[tuple[str, str]]) -> None:
        """Count whole texts, given as ``(lang, text)``."""
        for lang, text in rows:
            own = self.words.setdefault(lang, Counter())
            before = len(own)
            own.update(RUNS.findall(lettered(text)))
            self.held += len(own) - before
            if self.held >= HELD:
                self.done()

    def flush(self, lang: str) -> None:
        own = self.words.pop(lang, None)
        total = self.of.setdefault(lang, np.zeros(CELLS + len(NAMES), np.int64))
        if not own:
            return
        every, times = [w.lower() for w in own], np.fromiter(own.values(), np.int64, len(own))
        for k in range(0, len(every), 50_000):
            cell, word = cells(every[k : k + 50_000])
            np.add.at(total, cell, times[k : k + 50_000][word])
        for w, n in zip(every, times.tolist(), strict=True):
            total[CELLS + NAMES.index(script(w))] += n * len(w)

    def done(self) -> dict[str, np.ndarray]:
        for lang in list(self.words):
            self.flush(lang)
        self.held = 0
        return self.of


def modelled(of: dict[str, np.ndarray]) -> Model:
    """Naive Bayes over hashed n-grams of words from the counts of each language."""
    langs = sorted(of)
    if not langs:
        return Model([], np.zeros((0, CELLS)), {})
    counts = np.stack([of[x][:CELLS] for x in langs]) + 1.0
    letters = np.stack([of[x][CELLS:] for x in langs])
    every = np.maximum(letters.sum(axis=1), 1)
    scripts = {s: np.flatnonzero((letters[:, i] > 0) & (letters[:, i] >= SHARE * every)) for i, s in enumerate(NAMES)}
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), {s: x for s, x in scripts.items() if len(x)})


def fitted(rows: list[tuple[str, str]]) -> Model:
    """The model of ``(lang, text)`` rows; words count once for each occurrence."""
    counts = Counts()
    counts.add(rows)
    return modelled(counts.done())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the whole texts of all labelled rows.

    Cells are counted in tasks and summed by Spark; the driver gets one array of ``CELLS`` and a
    few numbers for each language, whatever the number of rows. Rows without label or text teach
    nothing; without any other row the model has no language. Other columns aren't read.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in slices(batches, "text", TOGETHER):
            counts.add(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True))
        for lang, total in counts.done().items():
            at = np.append(np.flatnonzero(total[:CELLS]), np.arange(CELLS, len(total)))  # a language is known if no cell is, too
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "cell", "n"])

    summed = labelled.mapInArrow(lean(count), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    of: dict[str, np.ndarray] = {}
    for r in summed.groupBy("lang").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n")).toArrow().to_batches():
        for lang, cell, n in zip(r.column("lang").to_pylist(), r.column("cell"), r.column("n"), strict=True):
            of[lang] = np.zeros(CELLS + len(NAMES), np.int64)
            of[lang][cell.values.to_numpy()] = n.values.to_numpy()
    return modelled(of)


class Scorer:
    """Scores of words as written under a model, kept for words met before, and whether no language was learned in their script."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)), np.float32)
        self.strange = np.zeros(1024, bool)
        self.sizes = np.zeros(1024, np.int32)

    def index(self, words: list[str]) -> None:
        for k in range(0, len(words), 50_000):
            some, at = words[k : k + 50_000], len(self.known)
            while at + len(some) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.strange = np.concatenate((self.strange, np.zeros_like(self.strange)))
                self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            lower = [w.lower() for w in some]
            scripts = list(map(script, lower))
            self.rows[at : at + len(some)] = self.scores(lower, scripts)
            self.strange[at : at + len(some)] = [s not in self.model.scripts for s in scripts]
            self.sizes[at : at + len(some)] = list(map(len, some))
            self.known.update(zip(some, range(at, at + len(some)), strict=True))

    def scores(self, words: list[str], scripts: list[str]) -> np.ndarray:
        """Log-likelihoods of lower-cased words less the best one, cut at WORD; languages that a word's script rules out get the cut."""
        cell, word = cells(words)
        s = np.stack([np.bincount(word, w[cell], len(words)) for w in self.model.weights], axis=1)
        for name in set(scripts):
            allowed = self.model.scripts.get(name)
            if allowed is not None and len(allowed) < s.shape[1]:
                of = np.array([x == name for x in scripts])
                s[np.ix_(of, np.setdiff1d(np.arange(s.shape[1]), allowed))] = -np.inf
        return np.maximum(s - s.max(axis=1, keepdims=True), -WORD)


def paths(scores: np.ndarray, of: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word on each document's path; document d has the words ``of[d]`` to ``of[d + 1]``. All documents take each step together."""
    sizes = np.diff(of)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = of[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # documents that have more words than that
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        at, v = begins[:n] + t, value[:n]
        best = v.argmax(axis=1)
        jump = v[np.arange(n), best][:, None] - switch
        keep = v >= jump
        stay[at], source[at] = keep, best
        value[:n] = np.where(keep, v, jump) + scores[at]
        value[:n] -= value[:n].max(axis=1, keepdims=True)
    out = np.zeros(len(scores), np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        out[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], source[at])
    return out


class Label(NamedTuple):
    lang: str
    score: float
    strange: float
    spans: list[tuple[int, int, str]]


def labels(scorer: Scorer, texts: list[str | None], spans: bool, switch: float = SWITCH) -> Iterator[Label]:
    """The language that holds most letters of each text, its share of the letters, the share in scripts of no learned language, and, if asked for, spans in code points."""
    plain = [lettered(t) if t else "" for t in texts]
    found = list(map(RUNS.findall, plain))
    if not scorer.model.langs:
        yield from (Label(UND, 0.0, float(len(x) > 0), []) for x in found)
        return
    every = list(chain.from_iterable(found))
    new = set(every)
    if len(scorer.known) + len(new) > KEPT:
        scorer.known.clear()
    scorer.index(list(new.difference(scorer.known)))
    known, langs = scorer.known, scorer.model.langs
    flat = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
    sizes = scorer.sizes[flat].astype(np.float64)
    of = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    path = paths(scorer.rows[flat], of, switch)
    row = np.repeat(np.arange(len(texts)), np.diff(of))
    weight = np.bincount(row * len(langs) + path, sizes, len(texts) * len(langs)).reshape(len(texts), -1)
    turns = np.flatnonzero((path[1:] != path[:-1]) & (row[1:] == row[:-1])) + 1
    mixed = np.bincount(row[turns], minlength=len(texts)) > 0
    bests, sums = weight.argmax(axis=1).tolist(), weight.sum(axis=1)
    scores = (weight.max(axis=1) / np.maximum(sums, 1)).tolist()
    strange = (np.bincount(row, sizes * scorer.strange[flat], len(texts)) / np.maximum(sums, 1)).tolist()
    for i, text in enumerate(texts):
        if of[i] == of[i + 1]:
            yield Label(UND, 0.0, 0.0, [])
            continue
        best = langs[bests[i]]
        out = []
        if spans and mixed[i]:
            own = path[of[i] : of[i + 1]]
            places = [m.span() for m in RUNS.finditer(plain[i])]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            out = [(places[a][0], places[b - 1][1], langs[own[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        elif spans:
            end = len(text)
            while not text[end - 1].isalpha():
                end -= 1
            out = [(RUNS.search(plain[i]).start(), end, best)]
        yield Label(best, scores[i], strange[i], out)


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identified(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``strange`` and, if asked for, ``lang_spans``.

    ``lang_pred`` is the learned language that labels most letters of the text's path, ``score``
    the share of the letters that it labels (0 to 1); ties go to the lesser name. ``strange`` is the
    share of the letters in words of scripts that no language was learned in. A null text and
    one without letters are ``und`` with score 0, as is every text if nothing was learned. Rows are
    independent, so repeated ones agree; other columns stay, those named like the new ones are
    replaced. An empty table gives no rows.
    """
    new = ["lang_pred", "score", "strange", *["lang_spans"] * spans]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("strange", "double")
    if spans:
        schema = schema.add("lang_spans", kind(SPANS))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in slices(batches, text_col, TOGETHER):
            got = list(labels(scorer, batch.column(text_col).to_pylist(), spans))
            columns = [pa.array([x.lang for x in got], pa.string()), pa.array([x.score for x in got], pa.float64()), pa.array([x.strange for x in got], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "lang": s} for a, b, s in x.spans] for x in got], ranges))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *new])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a fifth of the ids, by their crc32 as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", langs: list[str] | None = None) -> DataFrame:
    """``docs`` without those in no known language; the columns stay, whatever their names.

    Rejected are texts that are null or without letters (``und``), those with more than half of
    their letters in scripts of no learned language, and, if ``langs`` is given, those in another
    language. Repeated rows share their fate; an empty table stays empty.
    """
    kept = docs.columns
    held = docs.toDF(*[f"_{i}" for i in range(len(kept))])  # no name of theirs is one of the labels'
    found = identified(held, model, f"_{kept.index(text_col)}", False)
    wanted = (F.col("lang_pred") != UND) & (F.col("strange") <= 0.5)
    if langs is not None:
        wanted &= F.col("lang_pred").isin(langs)
    return found.where(wanted).select(*held.columns).toDF(*kept)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from all whole labelled texts that aren't held out.

    A null text and one without a letter are ``und`` with score 0. Rows are independent, so repeated
    ones agree; a row without id isn't held out. An empty table gives no rows, and columns besides
    ``doc_id``, ``text`` and ``lang`` aren't read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identified(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")
