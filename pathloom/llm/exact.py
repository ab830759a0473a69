"""Exact dedup by the owners of Patricia tries.

A text's key is its UTF-8 without the characters ``[\\x20\\x09-\\x0D]``. Each input partition first inserts its keys into a
compressed radix trie; a trie over its budget is spilled by subtree, the heaviest first, as partial owners. Partial
owners are dealt by length and content hash; each such partition sorts its keys and has one trie for all of them, into
which the full byte strings go, so equal hashes never merge different texts. A terminal node stores the owner: the row
with the most code points in its original text, then the smallest id. As keys come sorted, subtrees that lie wholly before
the newest key are final and leave when a trie is over budget. Rows then find their terminal by the SHA-256 of its key.

Null counts as empty; all-white texts equal the empty one; ties go to the smallest id, a null id last; rows that repeat an
id and text share the verdict of that id (``owner_rows`` tells how many rows the owner's id has); one row of each group
stays in :func:`dedup`, also where ids are null or stand on several texts; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of labels that a trie may hold before subtrees are spilled.
TRIE_BYTES = 32 << 20
WHITE = b" \t\n\x0b\x0c\r"


def normal(text: bytes | None) -> bytes:
    return text.translate(None, WHITE) if text else b""


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner = label, {}, None


def better(a: list[int] | None, b: list[int]) -> list[int]:
    """Owners are [code points, id, rows, rows of that id]: the winner's, with the rows of both. A null id comes last.

    A fifth item, the digest of the owner's text, decides between texts of one length under one id.
    """
    if a is None:
        return b
    rows = a[2] + b[2]
    if (a[0], a[1]) == (b[0], b[1]):
        return [a[0], a[1], rows, a[3] + b[3], *min(a[4:], b[4:])]
    first, second = ((x[0], x[1] is not None, -(x[1] or 0)) for x in (a, b))
    win = a if first > second else b
    return [win[0], win[1], rows, win[3], *win[4:]]


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes ``a`` and ``b[at:]`` share."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes, owner: list[int]) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.bytes += len(kid.label) + 200
                node, at = kid, len(key)
            elif key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                n = common_prefix(kid.label, key, at)
                fork = node.kids[key[at]] = Node(kid.label[:n])
                fork.kids[kid.label[n]] = kid
                kid.label = kid.label[n:]
                self.bytes += 200
                node, at = fork, at + n
        node.owner = better(node.owner, owner)

    def terminals(self) -> Iterator[tuple[bytes, list[int]]]:
        yield from walk(self.root, b"")

    def before(self, key: bytes) -> Iterator[tuple[bytes, list[int]]]:
        """Takes out all that lies wholly before ``key``, the newest of sorted keys: subtrees beside its path, and owners on it."""
        node, at, self.bytes = self.root, 0, 0
        while at < len(key):
            if node.owner:
                yield key[:at], node.owner
                node.owner = None
            for c in [c for c in node.kids if c != key[at]]:
                yield from walk(node.kids.pop(c), key[:at])
            node = node.kids[key[at]]
            at += len(node.label)
            self.bytes += len(node.label) + 200

    def spill(self) -> Iterator[tuple[bytes, list[int]]]:
        """Takes subtrees out, the heaviest first, until half the bytes are gone."""
        below = {c: weight(kid) for c, kid in self.root.kids.items()}
        for c in sorted(below, key=below.get, reverse=True):
            if self.bytes <= TRIE_BYTES // 2:
                return
            self.bytes -= below[c]
            yield from walk(self.root.kids.pop(c), b"")


def walk(top: Node, prefix: bytes) -> Iterator[tuple[bytes, list[int]]]:
    stack = [(top, prefix)]
    while stack:
        node, before = stack.pop()
        key = before + node.label
        if node.owner:
            yield key, node.owner
        stack.extend((kid, key) for kid in node.kids.values())


def weight(top: Node) -> int:
    total, stack = 0, [top]
    while stack:
        node = stack.pop()
        total += len(node.label) + 200
        stack.extend(node.kids.values())
    return total


PARTIAL = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("key", pa.binary()), ("chars", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("owner_rows", pa.int64()), ("text_sha", pa.binary())])
OWNERS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("owner_rows", pa.int64()), ("text_sha", pa.binary())])


def _packed(rows: Iterator[tuple], schema: pa.Schema, limit: int = common.SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def rows():
        trie = Trie()
        for whole in batches:
            for part in common.slices(whole):
                for doc_id, text in zip(common.values(part, "doc_id"), common.utf8(part), strict=True):
                    trie.insert(normal(text), [_chars(text), doc_id, 1, 1, hashlib.sha256(text or b"").digest()])
                if trie.bytes > TRIE_BYTES:
                    yield from map(row, trie.spill())
        yield from map(row, trie.terminals())

    def row(found):
        key, (chars, doc_id, n, own, sha) = found
        return len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key, chars, doc_id, n, own, sha

    return _packed(rows(), PARTIAL)


def _chars(text: bytes | None) -> int:
    """Code points of UTF-8: bytes that don't continue one."""
    return len(text.decode()) if text else 0


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        trie = Trie()
        for batch in batches:
            for key, chars, doc_id, n, own, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(key, [chars, doc_id, n, own, sha])
                if trie.bytes > TRIE_BYTES:
                    yield from map(row, trie.before(key))
        yield from map(row, trie.terminals())

    def row(found):
        key, (_, doc_id, n, own, sha) = found
        return hashlib.sha256(key).digest(), doc_id, n, own, sha

    return _packed(rows(), OWNERS)


def owners(docs: DataFrame) -> DataFrame:
    """One row for each distinct key: its sha, keep_id, group_size, owner_rows, text_sha (of the owner's text)."""
    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_partial, "length long, hash long, key binary, chars long, id long, rows long, owner_rows long, text_sha binary")
    dealt = partial.repartition("length", "hash").sortWithinPartitions("key")
    return dealt.drop("length", "hash").mapInArrow(_final, "sha binary, keep_id long, group_size long, owner_rows long, text_sha binary")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in common.slices(whole):
            shas = [hashlib.sha256(normal(text)).digest() for text in common.utf8(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas, pa.binary())], names=["doc_id", "sha"])


def groups(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the owner of its group.

    The second pass carries ids and digests only. A hot group makes one partition of that join large; it is a plain
    sort-merge join of two shuffled sides, so adaptive execution splits it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hashed, "doc_id long, sha binary")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(owners(docs).hint("merge"), "sha").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "owner_rows")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, the owner's, with all its columns."""
    keep = owners(docs).select(F.col("text_sha").alias("_sha"), F.coalesce("keep_id", F.lit(0)).alias("_id"), F.col("keep_id").isNull().alias("_none"))
    return common.staying(common.keyed(docs), keep, common.ROW_KEY).select(docs.columns)
