"""Toxicity, language, personal data, licenses and sampled pieces on awkward rows and against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pathloom.llm import langid, license, pieces, pii, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    en, de = "the of and that with from".split(), "der und die nicht eine schön".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)) + (" vile idiot" if i % 5 == 0 else ""), "en" if i % 2 else "de", "s", None, 0.0, "x") for i in range(400)]
    odd = [None, "", "  ", "123 !?", "x", "日本語", "the " * 30_000, "a\x00b", "👍🏽 é"]
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(odd)]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(5, 0, 0), (None, 0, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == 409 and toxicity.report(docs, labels).count() == 410
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in range(400) if got[i]["held_out"]]) > 0.97
    assert got[1000]["score"] == got[1001]["score"]
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.report(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.report(docs, labels.where("false")).collect()} == {0}


def test_language(docs, empty):
    got = {r["doc_id"]: r for r in langid.report(docs).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(400))
    assert all(got[1000 + i]["lang_pred"] == "und" and got[1000 + i]["score"] == 0 for i in range(4))
    assert got[1006]["lang_pred"] == "en" and langid.report(empty).count() == 0
    assert {r["lang_pred"] for r in langid.report(docs.withColumn("lang", docs.source.substr(9, 1).cast("string")).where("lang is null or lang = ''").drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} <= {"und"}


def test_mixed_spans(docs):
    model = langid.train(docs)
    text = "the of and that with from the of " * 3 + "der und die nicht eine der und die " * 3
    found = langid.spans([text, None], model)
    assert [x[2] for x in found[0]] == ["en", "de"] and found[1] == []


def test_spans_are_in_the_report(docs):
    rows = {r["doc_id"]: r for r in langid.report(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows[1]["spans"] == f"en:0:{len(text[1].rstrip())}" and rows[1000]["spans"] == ""
    model = langid.train(docs)
    mixed = ["12 the of and that with from the of 7 der und die nicht eine der und die. !", None, "the of and", "?", "der und die nicht " * 3 + "that with from of " * 3]
    for t, found in zip(mixed, langid.spans(mixed, model), strict=True):
        words = [(m.start(), m.end()) for m in langid.WORD.finditer(t or "")]
        assert [a for a, *_ in found[:1]] == [a for a, _ in words[:1]] and [b for _, b, _ in found[-1:]] == [b for _, b in words[-1:]]
        assert all(x[1] < y[0] and x[2] != y[2] and (x[1] in [b for _, b in words]) and (y[0] in [a for a, _ in words]) for x, y in itertools.pairwise(found))
    assert len(langid.spans(mixed, model)[4]) == 2


def test_distinct_grams_and_scores_equal_brute_force():
    rng = random.Random(8)
    grams, w = toxicity.Grams(), np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    score = toxicity.scorer((w, 0.25))
    for _ in range(60):
        t = "".join(rng.choice("abAÉ日 .") for _ in range(rng.randrange(30)))
        line = f" {t.lower()} "
        want = set()
        for n in toxicity.ORDERS:
            for k in range(len(line) - n + 1):
                h = 0
                for c in line[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
                want.add((((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) % (1 << 64)) >> (64 - toxicity.BITS))
        assert sorted(grams.of(t).tolist()) == sorted(want)
        assert score(t) == pytest.approx(1 / (1 + math.exp(-min(40, max(-40, float(w[sorted(want)].astype(float).sum()) + 0.25)))), abs=1e-4)


def test_the_classifier_scales_features_by_log_count_ratios():
    rows = [("bad words here", 1), ("bad thing", 1), ("fine words here", 0), ("fine thing", 0), ("fine day", 0), ("bad day", 1)] * 3
    w, b = toxicity.fit(iter(rows))
    grams = toxicity.Grams()
    both = set(grams.of("thing").tolist()) - set(grams.of("bad").tolist())
    lists = [set(toxicity.Grams().of(t).tolist()) for t, _ in rows]
    ratio = {k: sum(k in x for x, (_, y) in zip(lists, rows, strict=True) if y) - sum(k in x for x, (_, y) in zip(lists, rows, strict=True) if not y) for k in set().union(*lists)}
    assert all(w[k] == 0 for k in np.flatnonzero(w == 0)) and all(w[k] > 0 for k in grams.of("bad").tolist() if ratio.get(k, 0) > 0 and w[k])
    score = toxicity.scorer((w, b))
    assert both and all((score(t) >= 0.5) == bool(y) for t, y in rows)


def test_repeated_labelled_ids_are_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (77, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 10).collect()
    assert all(r["label"] == (r["doc_id"] == 1) for r in got) and len({r["doc_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} <= {1, 2}


def test_contexts_skip_words_within_any_span():
    text = "alpha u@ex.com beta +1 222 333 4444 gamma"
    found = pii.contexts(text, [("email", 6, 14), ("phone", 20, 35), ("card", 22, 30)])
    assert {t for _, t in found if t} == {"alpha", "beta", "gamma"}


def test_many_candidates_give_the_same_terms(spark, monkeypatch):
    rng = random.Random(2)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (f" mailto u{i}@ex.com" if i % 10 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, pii.disclosing(docs).collect()))
    monkeypatch.setattr(pii, "TERMS_PER_PASS", 3)
    assert few and sorted(map(tuple, pii.disclosing(docs).collect())) == few


def brute_disclosing(texts):
    """Terms and ratios by the definition, all places counted one by one."""
    n, of, places, every = {}, {}, {}, 0
    for t in texts:
        spans = pii.base_spans(t)
        found = [(m.start(), m.end(), m[0].lower()) for m in pii.WORD.finditer(t or "")]
        every += len(found)
        for *_, w in found:
            of[w] = of.get(w, 0) + 1
        free = [f for f in found if not any(a < f[1] and f[0] < b for _, a, b in spans)]
        for kind in {s[0] for s in spans}:
            near = set()
            for _, start, _ in (s for s in spans if s[0] == kind):
                before = [k for k, f in enumerate(free) if f[0] < start]
                after = [k for k, f in enumerate(free) if f[0] >= start]
                near |= {*before[-pii.WINDOW :], *after[: pii.WINDOW]}
            places[kind] = places.get(kind, 0) + len(near)
            for k in near:
                n[kind, free[k][2]] = n.get((kind, free[k][2]), 0) + 1
    out = []
    for (kind, w), k in n.items():
        bits = -math.log2(places[kind] / max(every, places[kind] + 1))
        ratio = (math.log2(min(1, k / of[w])) + bits) / bits
        if k >= pii.SUPPORT and ratio >= pii.DISCLOSES:
            out.append((w, kind, ratio))
    return sorted(out)


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(2)) for _ in range(40)]
    extra = ["mail me@ex.org", "call +1 222 333 4444", "host 10.0.0.1 a@b.cc", "ring +49 30 1234567 now", ""]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + " " + rng.choice(extra) + " " + rng.choice(words) for _ in range(300)] + [None, ""]
    got = sorted(tuple(r) for r in pii.disclosing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    want = brute_disclosing(texts)
    assert [x[:2] for x in got] == [x[:2] for x in want] and want
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


@pytest.mark.parametrize("limit", [1, 150, 1 << 22])
def test_rows_with_null_or_repeated_ids(spark, limit):
    from pathloom.llm import decontam, exact, records, sharding, simhash

    docs = spark.createDataFrame([(None, "one two three"), (None, "clean"), (1, "one two three"), (1, "other words"), (None, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, "one two"), (8, "words"), (None, "three"), (9, "one two")], "item_id long, text string")
    rows = sorted(map(tuple, decontam.report(docs, bench, automaton_bytes=limit).collect()), key=str)
    want = [(None, 3, 3, 2, [7, 9]), (None, 1, 0, 0, []), (1, 3, 3, 2, [7, 9]), (1, 2, 1, 1, [8]), (None, 0, 0, 0, [])]
    assert rows == sorted(((i, n, h, k, decontam.digest(ids), h > 0) for i, n, h, k, ids in want), key=str)
    if limit > 1000:
        path = queries.tokenizer_path("byte_bpe_50k.json")
        found = records.report(docs, path).orderBy("start").collect()
        assert [r["doc_id"] for r in found] == [None, None, None, 1, 1] and found == records.report(docs.repartition(1), path).orderBy("start").collect()
        for op in (exact.groups, sharding.report, simhash.report, pii.report, license.report):
            assert op(docs).count() == 5
        assert sorted((r["doc_id"], r["kept"]) for r in exact.groups(docs).collect() if r["doc_id"]) == [(1, True), (1, True)]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 5, 2])
    scores = rng.normal(size=(12, 3)) * 3
    labels, at = langid.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        part = scores[at : at + n]

        def value(path, part=part):
            return sum(part[k, s] for k, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        assert value(labels[at : at + n]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(n))))
        at += n


def brute_base(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "x@y.zz", ".", "_", "1", "255", "256", "1.2.3.4", "+", "4111111111111111", " ", "-", "(", ")", "+1 (222) 333-4444", "é", "007", "@a.b@c.d", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == brute_base(t), t


def test_disclosing_terms_become_spans(spark, empty):
    rng = random.Random(2)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (f" mailto u{i}@ex.com" if i % 10 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "mailto nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert "term:0:6" in got[902]["spans"] and got[902]["n_email"] == 0 and got[900]["spans"] == ""
    assert sum(r["n_email"] for r in got.values()) == 40
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "@" not in "".join(t or "" for t in texts.values()) and texts[10].rstrip().endswith("[EMAIL]") and texts[900] is None
    assert pii.report(empty).count() == 0


def test_licenses(spark, docs, empty):
    mit = license.TEMPLATES["MIT"].strip()
    noise = "lorem ipsum " * 200
    rows = [(1, noise + mit + noise), (2, noise + mit.replace("deal in", "deal with") + noise + mit), (3, noise), (4, None), (5, "x. Licensed under CC BY-NC 4.0. y"), (6, "the license is for you")]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    best = got[1]["licenses"][0]
    assert best["license"] == "MIT" and best["coverage"] == 1 and rows[0][1][best["start"] : best["end"]] == mit.rstrip(".")
    assert [x["license"] for x in got[2]["licenses"]].count("MIT") == 2 and not got[3]["licenses"] and not got[4]["licenses"] and not got[6]["licenses"]
    assert got[5]["licenses"][0]["license"] == "CC-BY-NC-4.0-notice"
    assert license.report(empty).count() == 0 and license.report(docs).count() == docs.count()


def test_pieces(docs, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode(docs, path, 3).collect()
    lib = pieces.vocabulary_of(path).lib
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} == set(text)
    for r in rows[:200]:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert "\x00" in (text[r["doc_id"]] or "") or lib.decode(ids) == (text[r["doc_id"]] or "")
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert all(len(set(v)) == (len(v) if k != 3 else len(v) // 2) for k, v in by.items()) and len(by[1001]) == 1
    assert pieces.encode(empty, path).count() == 0


def test_sampling_is_without_replacement_and_exact():
    v = pieces.vocabulary_of(queries.tokenizer_path("piece_bpe_32k.model"))
    full = pieces.sampled(v, [1], ["able"], 60)[0]
    p = {a[0].tobytes(): math.exp(a[1]) for a in full}
    assert len(p) == len(full) and sum(p.values()) == pytest.approx(1) and all(a[3] == 1 for a in full)
    n = 8000
    seen = {}
    for first, second in pieces.sampled(v, list(range(n)), ["able"] * n, 2):
        assert first[2] > second[2]
        seen[second[0].tobytes()] = seen.get(second[0].tobytes(), 0) + 1
    for k in p:
        want = sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)
        assert seen.get(k, 0) / n == pytest.approx(want, abs=0.025)


def test_pipeline_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < docs.count() < 200


def test_the_whole_pipeline_runs_on_awkward_and_empty_documents(spark, tmp_path):
    rows = [(None, "alpha beta gamma delta one two", "en"), (1, None, None), (2, "", "en"), (3, "same text here", "en"), (3, "same  text here", "en"), (4, "x " * 5000, None), (5, "the benchmark passage of ten words stands right here today now", "en")]
    for name, given in (("full", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(given, "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(9, "the benchmark passage of ten words stands right here today")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
        assert got == ({None, 1, 3, 4} if given else set())
