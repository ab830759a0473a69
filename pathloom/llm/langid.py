"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

A model holds, for each learned language, hashed character n-gram log-probabilities of words (orders 1 to ``ORDER`` with
word ends) and the scripts that its training letters are in. Each word's script narrows the languages to those that use it;
the word's score for a language is the sum over its n-grams. Viterbi over the words of a text, with a penalty for each
change of language, labels spans; words in a script that no language uses score alike for all. A document's language is
the one whose spans hold the most letters (then the first in the alphabet), and its score is their share of all letters.

The model is fitted on a bounded sample: of each language about ``SAMPLE_ROWS`` labelled documents of the training folds,
those with the least hashes of their ids. It takes 256 KB for each language.

Null texts and texts without a letter are ``und`` with score 0; a model without languages says ``und`` everywhere; rows
that repeat get equal rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
BITS = 16
#: Labelled documents of each language that are used for fitting, about.
SAMPLE_ROWS = 1000
FOLDS, HELD = 4, 2
SWITCH = 12.0
#: What a language loses on a word in a script it doesn't use, and the share of letters that makes a script used.
OTHER_SCRIPT, SCRIPT_SHARE = 1000.0, 0.01
SMOOTH = 0.5
#: Words whose scores a worker keeps.
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
#: First code points of Unicode's script ranges, with a name; a range ends where the next begins.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]
NAMES = sorted({name for _, name in SCRIPTS})


def scripts_of(codes):
    """Script numbers of code points."""
    import numpy as np

    starts = np.array([a for a, _ in SCRIPTS])
    which = np.array([NAMES.index(name) for _, name in SCRIPTS])
    return which[np.searchsorted(starts, codes, "right") - 1]


def grams(words: list[str]):
    """(buckets, owner of each, code points, owner of each): hashed n-grams of lower-cased words with their ends."""
    import numpy as np

    line = " " + " ".join(words).lower() + " "
    if line.count(" ") != len(words) + 1 or len(line) != sum(map(len, words)) + len(words) + 1:
        line = " " + " ".join(x if len(x := w.lower()) == len(w) and " " not in x else w for w in words) + " "
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = code == 32
    owner = np.cumsum(gap) - 1  # the space before a word is its own; the one after it begins the next
    at = np.flatnonzero(~gap)
    u, buckets, owners, h = np.uint64, [], [], code
    inner = gap.astype(np.int64)
    for n in range(1, ORDER + 1):
        if n > 1:
            if len(code) < n:
                break
            h = h[:-1] * u(0x9E3779B97F4A7C15) + code[n - 1 :]
        # a gram may begin and end with a space but not have one inside
        ends = np.concatenate([[0], np.cumsum(inner)])
        ok = ends[n - 1 : len(code)] - ends[1 : len(code) - n + 2] <= 0 if n > 1 else ~gap
        if n == 2:
            ok = ~(gap[:-1] & gap[1:])
        some = np.flatnonzero(ok)
        buckets.append(((h[some] ^ (h[some] >> u(31))) * u(0xBF58476D1CE4E5B9 + 2 * n) >> u(64 - BITS)).astype(np.int64))
        owners.append(owner[some])
    return np.concatenate(buckets), np.concatenate(owners), code[at], owner[at]


class Model:
    """Languages, log-probabilities (buckets x languages) and which scripts each uses."""

    def __init__(self, langs: list[str], logs, used):
        self.langs, self.logs, self.used = langs, logs, used

    def words(self, words: list[str]):
        """Scores of words, one row each."""
        import numpy as np

        buckets, owner, code, code_owner = grams(words)
        order = np.argsort(owner, kind="stable")
        sums = np.add.reduceat(self.logs[buckets[order]], np.searchsorted(owner[order], np.arange(len(words))), axis=0)
        first = np.searchsorted(code_owner, np.arange(len(words)))
        allowed = self.used[scripts_of(code[first])]
        none = ~allowed.any(axis=1)
        sums = np.where(allowed, sums, sums - OTHER_SCRIPT)
        sums[none] = 0
        return sums.astype(np.float32)


def viterbi(scores, lengths, switch: float = SWITCH):
    """Label of every word. ``scores`` holds the words of all texts one after another; every length is 1 at least.

    All texts step together, the longest first, so a step is one operation over the texts that still have words.
    """
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # how many have a word at step t
    best = scores[first].astype(np.float64)
    stay = np.ones(scores.shape, bool)
    jump = np.zeros(len(scores), np.int16)
    last = np.zeros(len(size), np.int64)
    for t in range(1, int(size[0])):
        n = active[t]
        ended = active[t - 1]
        last[n:ended] = best[n:ended].argmax(axis=1)
        best = best[:n]
        at = first[:n] + t
        to = best.argmax(axis=1)
        moved = best[np.arange(n), to][:, None] - switch
        keep = best >= moved
        stay[at], jump[at] = keep, to
        best = np.where(keep, best, moved) + scores[at]
    last[: len(best)] = best.argmax(axis=1)
    labels = np.zeros(len(scores), np.int16)
    state = last.copy()
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], jump[at])
    return labels


class Labeller:
    """Labels the words of many texts, with a bounded cache of word scores."""

    def __init__(self, model: Model):
        import numpy as np

        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def rows(self, texts: list[list[str]]):
        import numpy as np

        if len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = list({w for words in texts for w in words if w not in known})
        if new:
            known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            parts = [self.model.words(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
            self.table = np.concatenate([self.table, *parts])
        get = known.__getitem__
        return np.fromiter((get(w) for words in texts for w in words), np.int64, sum(map(len, texts)))

    def labels(self, texts: list[list[str]]):
        """Labels of the words of all texts, one after another; texts without words are passed over."""
        import numpy as np

        lengths = np.array([len(x) for x in texts if x], np.int64)
        return viterbi(self.table[rows], lengths) if len(rows := self.rows(texts)) else np.zeros(0, np.int16)

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """Language and score of each text, and its spans: (start, end, language) in code points, the end exclusive."""
        import numpy as np

        words = [WORD.findall(t) if t else [] for t in texts]
        words = [w if w and (w[0].isalpha() or any(c.isalpha() for x in w for c in x)) else [] for w in words]
        n = len(self.model.langs)
        if not n:
            return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        labels = self.labels(words)
        letters = np.fromiter((len(w) for x in words for w in x), np.float64, len(labels))
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        shares = np.bincount(doc * n + labels, letters, len(texts) * n).reshape(-1, n)
        top, total = shares.argmax(axis=1), shares.sum(axis=1)
        share = shares.max(axis=1) / np.maximum(total, 1)
        change = np.ones(len(labels), bool)
        change[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        first = np.cumsum([0, *map(len, words)])
        runs = np.split(np.flatnonzero(change), np.searchsorted(np.flatnonzero(change), first[1:-1]))
        found = [self.spans(t, w, r.tolist(), at, labels) if w else [] for t, w, r, at in zip(texts, words, runs, first.tolist(), strict=False)]
        return [self.model.langs[k] if some else "und" for k, some in zip(top, total, strict=True)], share.tolist(), found

    def spans(self, text: str, words: list[str], runs: list[int], at: int, labels) -> list[tuple[int, int, str]]:
        """The runs of equal labels, which begin at the words ``runs`` of all words; the text's first word is ``at``."""
        langs = [self.model.langs[labels[k]] for k in runs]
        end = text.rindex(words[-1]) + len(words[-1])  # no letter follows the last word
        if len(runs) == 1:
            return [(WORD.search(text).start(), end, langs[0])]
        places = [m.span() for m in WORD.finditer(text)]
        ends = [places[k - at - 1][1] for k in runs[1:]] + [end]
        return [(places[k - at][0], e, lang) for k, e, lang in zip(runs, ends, langs, strict=True)]


def spans(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str]]]:
    """(start, end, language) of the spans of each text, in code points, the end exclusive."""
    return Labeller(model).documents(texts)[2]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the training folds."""
    import numpy as np

    known = docs.where("lang is not null and text is not null and doc_id is not null").where(common.crc_mod("doc_id", FOLDS) != HELD)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((len(NAMES), 0), bool))
    least = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < least[F.col("lang")]).select("lang", "text").repartition(8)
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(((1 << BITS) + len(NAMES), len(langs)))
        for whole in batches:
            for part in common.slices(whole):
                for lang, text in zip(common.values(part, "lang"), common.values(part, "text"), strict=True):
                    if words := WORD.findall(text):
                        buckets, _, code, _ = grams(words)
                        sums[: 1 << BITS, number[lang]] += np.bincount(buckets, minlength=1 << BITS)
                        sums[1 << BITS :, number[lang]] += np.bincount(scripts_of(code), minlength=len(NAMES))
        at, which = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(which, pa.int64()), pa.array(sums[at, which])], names=["at", "lang", "n"])

    sums = np.zeros(((1 << BITS) + len(NAMES), len(langs)))
    found = picked.mapInArrow(run, "at long, lang long, n double").groupBy("at", "lang").agg(F.sum("n").alias("n")).toArrow()
    sums[found["at"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    counts, scripts = sums[: 1 << BITS] + SMOOTH, sums[1 << BITS :]
    return Model(langs, (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def report(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (``lang:start:end``, comma-joined) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for whole in batches:
            for part in common.slices(whole):
                langs, score, found = labeller.documents(common.values(part, "text"))
                places = [",".join(f"{lang}:{a}:{b}" for a, b, lang in x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(places, pa.string())], names=["doc_id", "lang_pred", "score", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans string")
    return found.select("doc_id", (common.crc_mod("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "spans")
