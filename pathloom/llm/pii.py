"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. They are the protected entities, by
kind. Corpus co-occurrence then tells which other terms reveal an entity of a kind: over all documents, a term's
occurrences are counted, and those within ``WINDOW`` words of a base span. With p(kind) the share of all word places that
lie in such a context, a term's pointwise mutual information with the kind is log2(p(kind | term) / p(kind)) and the
kind's information content is -log2 p(kind). A term with ``SUPPORT`` context occurrences whose mutual information is at
least ``DISCLOSES`` times that content is a disclosing term: its occurrences become spans of kind ``term``, in all
documents. Sanitised texts have base spans generalised to their kind, disclosing terms generalised to ``[TERM]``, and
terms that reach ``REMOVES`` times the content removed.

Candidates are counted with map-side sums, and so are their occurrences in whole texts; where there are more candidates than
a worker is to hold (``TERMS_PER_PASS``), all words are counted and the sums joined. Marking takes a pass for each group of so
many terms. Results are the same either way.

Null counts as empty; documents without personal data count towards the statistics; repeated rows count as often as they
are there; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW = 5
SUPPORT = 8
DISCLOSES, REMOVES = 0.85, 0.995
TERMS_PER_PASS = 200_000
WORD = re.compile(r"[^\W\d_]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their at signs: the part before one is the whole run of its characters."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            past = found.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str | None) -> list[Span]:
    """Spans by kind as listed, then start; ends exclusive, in code points."""
    out: list[Span] = []
    if not text:
        return out
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def contexts(text: str, spans: list[Span]) -> Counter:
    """(kind, term) to its places within the window of a span of the kind; (kind, '') to all such places."""
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    covered: list[list[int]] = []  # disjoint, by start
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    free, k = [], 0
    for a, b, w in words:
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or covered[k][0] >= b:
            free.append((a, w))
    starts, out = [a for a, _ in free], Counter()
    import bisect

    for kind in {s[0] for s in spans}:
        near: set[int] = set()
        for s in spans:
            if s[0] == kind:
                i = bisect.bisect_left(starts, s[1])
                near.update(range(max(0, i - WINDOW), min(len(free), i + WINDOW)))
        out[kind, ""] += len(near)
        for i in near:
            out[kind, free[i][1].lower()] += 1
    return out


def _counted(texts: DataFrame, count) -> DataFrame:
    """kind, term and n, summed over all documents: each task sends one row for each key it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for whole in batches:
            for part in common.slices(whole):
                for text in common.values(part, "text"):
                    if text:
                        count(text, total)
                if len(total) > TERMS_PER_PASS:
                    yield packed(total)
                    total.clear()
        yield packed(total)

    def packed(total):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([t for _, t in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["kind", "term", "n"])

    return texts.select("text").mapInArrow(run, "kind string, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _groups(terms: DataFrame, column: str = "term") -> Iterator[list]:
    """Rows in groups that a worker can hold, by a hash of the term."""
    n = -(-terms.count() // TERMS_PER_PASS) or 1
    for k in range(n):
        yield (terms if n == 1 else terms.where(F.pmod(F.xxhash64(column), F.lit(n)) == k)).collect()


def disclosing(docs: DataFrame) -> DataFrame:
    """term, kind, ratio: terms whose mutual information with a kind reaches ``DISCLOSES`` of its content, checkpointed."""
    spark = docs.sparkSession

    def near(text: str, total: Counter) -> None:
        if spans := base_spans(text):
            total.update(contexts(text, spans))

    around = common.cut(_counted(docs, near).where((F.col("term") == "") | (F.col("n") >= SUPPORT)))
    places = {r["kind"]: r["n"] for r in around.where("term = ''").collect()}  # one row for each kind
    terms = around.where("term <> ''").select("term").distinct()
    few = terms.count() <= TERMS_PER_PASS
    shared = spark.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()) if few else None)

    def words(text: str, total: Counter) -> None:
        found, known = WORD.findall(text.lower()), shared.value
        total["", ""] += len(found)
        total.update(("", w) for w in found if known is None or w in known)

    totals = common.cut(_counted(docs, words))
    every = (totals.where("term = ''").agg(F.sum("n")).first()[0] or 0) if places else 0
    out = totals.where("term <> ''").select("term", F.col("n").alias("of"))
    content = {k: -math.log2(n / max(every, n + 1)) for k, n in places.items() if n}
    bits = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(content.get(k)).cast("double"))])[F.col("kind")]
    rate = F.log2(F.least(F.lit(1.0), F.col("n") / F.col("of")))
    ratio = (rate + bits) / bits
    return common.cut(around.where("term <> ''").join(out.hint("merge"), "term").select("term", "kind", ratio.alias("ratio")).where(F.col("ratio") >= DISCLOSES))


MARKED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def term_spans(text: str | None, terms: dict[str, float], base: list[Span]) -> list[Span]:
    """Occurrences of disclosing terms outside the base spans."""
    if not text or not terms:
        return []
    if terms.keys().isdisjoint(WORD.findall(text.lower())):
        return []
    return [("term", *m.span()) for m in WORD.finditer(text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]


def _marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text and the spans of kind ``term``; one pass for each group of terms, without a shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("terms", F.expr("cast(array() as array<string>)"))
    for group in _groups(terms.groupBy("term").agg(F.max("ratio").alias("ratio"))):
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["ratio"] for r in group})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for whole in batches:
                for part in common.slices(whole):
                    texts, before = common.values(part, "text"), common.values(part, "terms")
                    found = [[*old, *(f"{'-' if known[text[a:b].lower()] >= REMOVES else '+'}{a}:{b}" for _, a, b in term_spans(text, known, base_spans(text)))] for text, old in zip(texts, before, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text", "terms"])

        docs = docs.mapInArrow(run, "doc_id long, text string, terms array<string>")
    return docs


def _places(terms: list[str]) -> list[tuple[int, int, bool]]:
    """(start, end, removed), by start."""
    return sorted((int(a), int(b), t[0] == "-") for t in terms for a, b in [t[1:].split(":")])


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole):
                rows = []
                for doc_id, text, terms in zip(common.values(part, "doc_id"), common.values(part, "text"), common.values(part, "terms"), strict=True):
                    base = base_spans(text)
                    n = Counter(s[0] for s in base)
                    rows.append((doc_id, *(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [("term", a, b) for a, b, _ in _places(terms)])))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=MARKED.replace(",", "").split()[::2])

    return _marked(docs, disclosing(docs)).mapInArrow(run, MARKED)


def sanitised(text: str | None, terms: list[str]) -> str | None:
    """The text with its spans generalised or removed; of overlapping spans the first, then the longest, is replaced."""
    if text is None:
        return None
    spans = sorted([(a, -b, f"[{k.upper()}]") for k, a, b in base_spans(text)] + [(a, -b, "" if gone else "[TERM]") for a, b, gone in _places(terms)])
    out, at = [], 0
    for a, b, put in spans:
        if a >= at:
            out += [text[at:a], put]
            at = -b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and sanitised text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.slices(whole):
                texts = [sanitised(t, x) for t, x in zip(common.values(part, "text"), common.values(part, "terms"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _marked(docs, disclosing(docs)).mapInArrow(run, "doc_id long, text string")
