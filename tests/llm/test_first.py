"""Exact dedup, sharding, records, SimHash and decontamination against brute force on awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

from pathloom.llm import common, components, decontam, exact, queries, records, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string"


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "straße", "é", "x", "12", "<s>", "—", "日本語", "a.b"]
    base = " ".join(rng.choice(words) for _ in range(400))
    texts = [None, "", " ", "\t\n", "x", "X", "one two", "one  two", "onetwo ", base, base, base.replace("x", "xx", 1), base + " tail", base.upper(), " ".join(rng.choice(words) for _ in range(30_000)), "ÀÉ ﬀ", "a\x00b", "a\x1cb c", "a b c", "<|endoftext|> a", "  lead", "end  ", "a\n b\n\n c \r\n d", "don't  stop 'll"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["copy of one text"] * 40
    rows = [(i, t, "en", "s", None, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[9], rows[4]]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_exact(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(strip(t), []).append((-len(t or ""), i))
    return sorted((i, min(by[strip(t)])[1], len(by[strip(t)]), min(by[strip(t)])[1] == i, hashlib.sha256(strip(t).encode()).hexdigest()) for i, t, *_ in rows)


def test_exact(docs, awkward, empty):
    got = exact.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == brute_exact(awkward)
    assert exact.groups(empty).count() == 0


def test_exact_dedup_keeps_one_row_of_each_group(docs, awkward, empty):
    got = exact.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({k for _, k, *_ in brute_exact(awkward)})
    assert exact.dedup(empty).count() == 0


def test_trie_spills_without_losing_rows(monkeypatch):
    monkeypatch.setattr(exact, "TRIE_BYTES", 2000)
    rng, trie, want, got = random.Random(1), exact.Trie(), {}, {}

    def take(found):
        for key, owner in found:
            got[key] = exact.better(got.get(key), owner)

    for i in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9)))
        owner = [rng.randrange(5), i, 1, 1]
        want[key] = exact.better(want.get(key), owner)
        trie.insert(key, owner)
        if trie.bytes > exact.TRIE_BYTES:
            take(trie.spill())
    take(trie.terminals())
    assert got == want


def brute_bfd(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fit = min(((r, b) for b, r in enumerate(left) if r >= s), default=None)
        if fit is None:
            left.append(capacity)
            fit = (capacity, len(left) - 1)
        left[fit[1]] -= s
        out.append(fit[1])
    return out


def test_packing_by_classes_equals_one_by_one():
    for seed in range(40):
        rng = random.Random(seed)
        sizes = sorted((rng.choice([1, 2, 3, 5, 8, 13, 40, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 300))), reverse=True)
        capacity = max(sizes) + rng.randrange(50)
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        flat = [b for b, n in sharding.pack(classes, capacity) for _ in range(n)]
        assert flat == brute_bfd(sizes, capacity)


def test_tree_stays_balanced():
    tree, rng, keys = sharding.Tree(), random.Random(2), set()
    for _ in range(3000):
        key = (rng.randrange(500), rng.randrange(50))
        if key in keys:
            tree.remove(key)
            keys.remove(key)
        else:
            tree.insert(key)
            keys.add(key)
        bound = rng.randrange(520)
        assert tree.at_least(bound) == min((k for k in keys if k[0] >= bound), default=None)
    assert sharding._height(tree.root) <= 1.45 * (len(keys) + 2).bit_length()


def test_sharding(docs, awkward, empty):
    got = [r.asDict() for r in sharding.report(docs).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in awkward)
    text = {i: t for i, t, *_ in awkward}
    shard_of, loads = {}, [0] * 8
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert shard_of.setdefault(t, r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
    for k in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    shared = [loads[k] for k in range(8) if len({t for t in shard_of if shard_of[t] == k}) > 1]  # large groups are alone
    assert len(shared) >= 4 and max(shared) - min(shared) <= 0.02 * max(shared)
    assert sharding.report(empty).count() == 0


def test_shards_of_many_small_groups_are_equal(spark):
    rng = random.Random(3)
    rows = [(i, "y" * rng.randrange(1, 300)) for i in range(3000)]
    loads = [0] * 8
    for r in sharding.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        loads[r["shard"]] += r["size"]
    # equal texts are one group: the loads differ by less than a hundredth
    assert max(loads) - min(loads) <= 0.01 * max(loads)


def test_records(docs, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(map(tuple, records.report(docs, path).collect()))
    import numpy as np

    at, want = 0, []
    seen = []
    for i, t, *_ in sorted(awkward, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        seen.append((i, np.array(ids, "<u2").tobytes()))
        at += len(ids)
    assert got == sorted(want)
    assert records.report(empty, path).count() == 0
    where = f"file://{tmp_path}/out"
    files = records.write(docs.coalesce(1), where, path).collect()
    found = []
    for f in files:
        order = list(range(f["n_records"]))
        random.Random(0).shuffle(order)
        found += records.lookup(where, f["data"][:-4], order)
    assert sorted(found) == sorted(seen)


def test_records_show_damage():
    frame = records.framed(b"abcdef")
    assert records.unframed(frame, 0) == b"abcdef"
    for k in range(len(frame)):
        with pytest.raises((ValueError, OverflowError)):
            records.unframed(frame[:k] + bytes([frame[k] ^ 4]) + frame[k + 1 :], 0)


def brute_print(t, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_of_slices():
    rng = random.Random(4)
    data = rng.randbytes(5000)
    starts = [rng.randrange(4800) for _ in range(800)]
    lengths = [rng.choice([0, 1, 3, 4, 7, 8, 11, 31, 32, 33, 63, 64, 100, rng.randrange(200)]) for _ in starts]
    want = [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, lengths, strict=True)]
    assert simhash.xxh64(data, starts, lengths).tolist() == want


def brute_components(rows):
    fp = {i: brute_print(t) for i, t, *_ in rows}
    edges = ((a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4)
    low = components.forest(edges)
    return sorted((i, f"{fp[i]:016x}", low.get(i, i)) for i, *_ in rows)


def test_simhash(docs, awkward, empty):
    assert sorted(map(tuple, simhash.report(docs).collect())) == brute_components(awkward)
    assert simhash.report(empty).count() == 0
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in brute_components(awkward)})


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(6)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(not m & diff for m in simhash.masks()) and any(not m & diff for m in simhash.masks(family=1))


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_links_keep_all_components(spark, block):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    want = components.forest((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = [tuple(x % (1 << 64) for x in r) for r in simhash.links(frame, block=block).collect()]
    assert components.forest(iter(edges)) == want


def test_a_hot_bucket_is_dealt_again(spark):
    rng = random.Random(9)
    low = [b for b in range(64) if not simhash.masks()[0] >> b & 1]  # all agree under the first mask
    fps = {0}
    for _ in range(60):
        x = sum(1 << b for b in rng.sample(low, 12))
        fps |= {x, x ^ 1 << rng.choice(low)}
    fps = sorted(fps)
    want = components.forest((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4)
    edges = [tuple(x % (1 << 64) for x in r) for r in simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), block=2).collect()]
    assert components.forest(iter(edges)) == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2000)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == components.forest(iter(edges))


def brute_hits(rows, items, k=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for i, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(k, len(b))
            wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    ids.add(item)
        out.append((i, len(w), len(hit), len(ids), decontam.digest(list(ids)), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontam.AUTOMATON_BYTES, 150])
def test_decontamination(spark, docs, awkward, empty, limit):
    base = awkward[9][1].split()
    items = [(1, " ".join(base[20:45])), (10, "ONE, two"), (2, "日本語"), (3, None), (4, "!!"), (5, " ".join(base[30:40])), (5, " ".join(base[30:40])), (6, "not in any of them at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.report(docs, bench, automaton_bytes=limit).collect()))
    assert got == brute_hits(awkward, items)
    kept = decontam.clean(docs, bench, automaton_bytes=limit)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in got if not r[-1])
    assert decontam.report(empty, bench).count() == 0
    assert not any(r[-1] for r in decontam.report(docs, bench.where("false")).collect())


def test_decontamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Été — so ONE,\n two! then one two")], "doc_id long, text string")
    row = decontam.scan(docs, spark.createDataFrame([(7, "one two")], "item_id long, text string")).first()
    text = "Été — so ONE,\n two! then one two"
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ONE,\n two", "one two"]


def test_ids_are_folded_by_crc(spark):
    got = spark.range(50).select(common.crc_mod("id", 5).alias("m"), "id").collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
