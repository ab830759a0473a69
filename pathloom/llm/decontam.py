"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all benchmark items.

Texts are folded to words (``A-Z`` lower-cased; every other ASCII character that is no letter or digit separates).
A window is ``window`` consecutive words of an item, or the whole of a shorter item. A document is scanned once; a word
inside any occurrence of any window is hit, and hit runs are given as code-point offsets of the original text.

The automaton runs over numbers of words, not their characters: every word of the items is a number of a few digits (in base
``BASE``, as a state's branches are searched one after another), any other word a mark that no window has. It goes to every worker, so its size is checked: items beyond ``automaton_bytes`` of text
are split by a hash of their text into several automata, through which every row passes with the hits so far. A row's answer
depends on that row and the items only, whatever the limit.

Null and empty texts have no words; an item without words never occurs; the windows of an item without an id are hit but it
is not among the items found; repeated item rows count once; rows with null or repeated ids are rows like others; an
empty benchmark leaves every document clean; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
AUTOMATON_BYTES = 4 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
STATE = "runs array<struct<first:int,last:int>>, items array<long>"
SCAN = "doc_id long, n_words long, n_hit long, runs array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>, items array<long>"
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
#: Branches of a state. First digits of a number are other characters than the rest, so that windows are found at words only.
BASE = 64
_FIRST, _REST, _OTHER = 1, 1 + BASE, chr(1 + 2 * BASE)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """All windows of the items, each with its word count and the items that have it."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        import ahocorasick

        texts = [(item, words_of(text)) for item, text in items]
        known = dict.fromkeys(w for _, words in texts for w in words)
        self.digits = 1
        while BASE**self.digits < len(known):
            self.digits += 1
        self.codes = {w: self.number(k) for k, w in enumerate(known)}
        owners: dict[str, tuple[int, set[int]]] = {}
        for item, words in texts:
            line = [self.codes[w] for w in words]
            n = min(window, len(line))
            for i in range(len(line) - n + 1) if n else ():
                _, ids = owners.setdefault("".join(line[i : i + n]), (n, set()))
                if item is not None:
                    ids.add(item)
        self.found = ahocorasick.Automaton()
        for key, (n, ids) in owners.items():
            self.found.add_word(key, (n, tuple(ids)))
        self.empty = not owners
        if owners:
            self.found.make_automaton()

    def number(self, k: int) -> str:
        out = []
        for _ in range(self.digits - 1):
            k, digit = divmod(k, BASE)
            out.append(chr(_REST + digit))
        return chr(_FIRST + k) + "".join(out)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, hit runs as (first, last) word, sorted ids of the items that occur."""
        import numpy as np

        words = words_of(text)
        if self.empty or not words:
            return len(words), [], []
        hits = list(self.found.iter("".join(map(self.codes.get, words, repeat(_OTHER)))))
        if not hits:
            return len(words), [], []
        ends = np.cumsum([self.digits if w in self.codes else 1 for w in words])
        lasts = np.searchsorted(ends, [end for end, _ in hits], "right").tolist()
        pairs = sorted((last - n + 1, last) for last, (_, (n, _)) in zip(lasts, hits, strict=True))
        return len(words), merged(pairs), sorted({i for _, (_, ids) in hits for i in ids})


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted inclusive intervals, overlapping or touching ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in pairs:
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets, end exclusive, of runs of words in the original text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b][1]) for a, b in runs]


def item_groups(benchmark: DataFrame, limit: int = AUTOMATON_BYTES) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items in groups of about ``limit`` bytes, by a hash of their text; one group where they fit."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in part.toLocalIterator()]


def _scan_pass(docs: DataFrame, items: list, window: int, last: bool) -> DataFrame:
    """doc_id, text and the state, with what one automaton hits added; the last pass gives the result in their place."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for whole in batches:
            for part in common.slices(whole):
                counts, runs, ids, spans = [], [], [], []
                for text, old, known in zip(common.utf8(part), common.values(part, "runs"), common.values(part, "items"), strict=True):
                    n, hit, found = automaton.scan(text)
                    if old:
                        hit = merged(sorted({*hit, *((r["first"], r["last"]) for r in old)}))
                    counts.append((n, sum(b - a + 1 for a, b in hit)))
                    runs.append([{"first": a, "last": b} for a, b in hit])
                    ids.append(sorted({*found, *known}))
                    spans.append([{"start": a, "end": b} for a, b in offsets(text.decode(), hit)] if last and hit else [])
                state = [pa.array(runs, _RUNS), pa.array(ids, pa.list_(pa.int64()))]
                if last:
                    numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
                    places = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([part.column(0), *numbers, state[0], places, state[1]], names=["doc_id", "n_words", "n_hit", "runs", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *state], names=["doc_id", "text", "runs", "items"])

    return docs.mapInArrow(run, SCAN if last else f"doc_id long, text string, {STATE}")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row for each document: words, hit words, hit runs and their offsets, items that occur."""
    groups = list(item_groups(benchmark, automaton_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.expr(f"cast(array() as {t})").alias(c) for c, t in (x.split(" ", 1) for x in STATE.split(", "))])
    for k, items in enumerate(groups):
        rows = _scan_pass(rows, items, window, k == len(groups) - 1)
    return rows


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of :func:`scan`, one row for each document."""
    found = scan(docs, benchmark, **options)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents, all their columns, in which no benchmark window occurs; texts are not moved."""
    for items in item_groups(benchmark, automaton_bytes):
        docs = _clean_pass(docs, items, window)
    return docs


def _clean_pass(docs: DataFrame, items: list[tuple[int, bytes | None]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value, window)
        for whole in batches:
            for part in common.slices(whole):
                yield part.filter(pa.array([not automaton.scan(text)[1] for text in common.utf8(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[int]) -> str:
    """What ``items_sha256`` holds, in plain Python."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
