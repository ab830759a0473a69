"""Token ids as length-delimited binary records with a separate offset index.

File format. A data file ``part-<k>.rec`` is a run of frames:

    length   8 bytes, little-endian unsigned: bytes of the payload
    check    4 bytes, little-endian: masked crc32 of the 8 length bytes
    payload  ids of one document as 2-byte (or 4-byte) little-endian unsigned integers
    check    4 bytes, little-endian: masked crc32 of the payload

Masking turns a crc right by 15 bits and adds 0xA282EAD8, so that checks of data that holds checks differ. The index
``part-<k>.idx`` has a header (magic, id width, number of records) and for each record its doc_id, the offset of its
frame and the number of ids before it in the file, 8 bytes each: any record can be read alone, in any order. Documents are
in ascending order of doc_id over all files.

Texts are encoded by the ``tokenizers`` library. As its pre-tokenizer starts a new piece at every space that a
non-space follows, a text is cut there and ids of cut pieces are kept in a bounded cache; pieces that are not in it go
through the library, and so do whole texts that hold the string of a special token, which the library gives its own id.

Files are written under a name of the attempt and then renamed, so that a repeated task leaves one whole file. Null
counts as empty: only the end id; an empty table writes no file; repeated rows are records of their own; null ids come
first and are stored as ``NO_ID``; rows of one id are in the order of a hash of their texts; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"PLRECIDX"
END_ID = 2
#: What the index holds where the id is null.
NO_ID = -(1 << 63)
#: Entries of a worker's cache, and the longest piece that enters it.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 40


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes, at: int) -> bytes:
    """The payload of the frame that begins at an offset; raises where a check fails."""
    head = data[at : at + 8]
    (length,), (check,) = struct.unpack("<Q", head), struct.unpack("<I", data[at + 8 : at + 12])
    if check != masked(head):
        raise ValueError(f"length check fails at {at}")
    payload = data[at + 12 : at + 12 + length]
    if len(payload) != length or struct.unpack("<I", data[at + 12 + length : at + 16 + length])[0] != masked(payload):
        raise ValueError(f"payload check fails at {at}")
    return payload


#: Spaces that begin no piece, as white space or the text's end follows; and those that begin one.
ODD = re.compile(r" (?:[\s\u180e]|\Z)")
CUT = re.compile(r" (?![\s\u180e]|\Z)")
#: ASCII marks whose run at a piece's end is a pre-token of its own after letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^`{|}~"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Known(dict):
    """Ids of pieces; one that is asked for and not there is found by ``find``. ``long`` has the long ones, which go after a batch."""

    def __init__(self, find):
        self.find, self.long = find, []

    def __missing__(self, text: str) -> bytes:
        ids = self[text] = self.find(text)
        if len(text) > CACHE_CHARS:
            self.long.append(text)
        return ids


class Encoder:
    """Texts to packed ids through a ``tokenizers`` file of a byte-level BPE.

    A piece of letters is one pre-token, so it goes to the library's model; other pieces go through the library's
    pre-tokenizer first.
    """

    def __init__(self, path: str, width: int = 2):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.split = self.lib.model, self.lib.pre_tokenizer.pre_tokenize_str
        self.code, self.known, self.letters = {2: "H", 4: "I"}[width], Known(self.piece), byte_letters()

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def library(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        """Ids of a piece with the space before it."""
        if text.isalpha():
            return self.packed([t.id for t in self.model.tokenize("\u0120" + (text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)))])
        core = text.rstrip(MARKS)
        if core.isalpha():
            return self.known[core] + self.run(text[len(core) :])
        head, line, tail = text.partition("\n")
        if head and tail and not head[-1].isspace() and tail.isalpha():  # the pre-tokenizer splits around the line's end
            return self.known[head] + self.run("\n") + self.run(tail)
        return self.packed([t.id for word, _ in self.split(" " + text) for t in self.model.tokenize(word)])

    def run(self, text: str) -> bytes:
        """Ids of one pre-token without a space before it."""
        key = "\n" + text  # no piece begins with white space
        if key not in self.known:
            self.known[key] = self.packed([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))])
        return self.known[key]

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The text up to the first cut, and what follows each cut without its leading space."""
        parts = CUT.split(text) if ODD.search(text) else text.split(" ")
        return parts[0], parts[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [(t, []) if self.special and self.special.search(t) else self.pieces(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        get = self.known.__getitem__
        heads = self.library([head for head, _ in cut])
        out = [head + b"".join(map(get, rest)) for head, (_, rest) in zip(heads, cut, strict=True)]
        for p in self.known.long:
            del self.known[p]
        self.known.long.clear()
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, width: int) -> Encoder:
    """This worker's encoder; its cache outlives a task."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


MANIFEST = "part int, data string, idx string, n_records long, n_ids long, before long"


def _fs(path: str):
    """pyarrow's file system for the shared folder's scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes data files and indexes below ``path``; returns the manifest, one row for each file, as a small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filesystem, root = _fs(path)
        filesystem.create_dir(root, recursive=True)
        attempt = f"{root}/.{part}-{uuid.uuid4().hex}"
        encoder, tail = encoder_of(tokenizer, width), struct.pack({2: "<H", 4: "<I"}[width], end_id)
        index, at, before = [], 0, 0
        out = None
        for whole in batches:
            for some in common.slices(whole, limit=4 << 20):
                ids = encoder.encode([t or "" for t in common.values(some, "text")])
                out = out or filesystem.open_output_stream(attempt + ".rec")
                for doc_id, packed in zip(common.values(some, "doc_id"), ids, strict=True):
                    frame = framed(packed + tail)
                    out.write(frame)
                    index.append(struct.pack("<qqq", NO_ID if doc_id is None else doc_id, at, before))
                    at, before = at + len(frame), before + len(packed) // width + 1
        if out is None:
            return
        out.close()
        with filesystem.open_output_stream(attempt + ".idx") as f:
            f.write(MAGIC + struct.pack("<qq", width, len(index)) + b"".join(index))
        names = [f"part-{part:06d}.rec", f"part-{part:06d}.idx"]
        for name in names:
            filesystem.move(attempt + name[-4:], f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(names[:1]), pa.array(names[1:]), pa.array([len(index)], pa.int64()), pa.array([before], pa.int64()), pa.array([0], pa.int64())], names=MANIFEST.replace(",", "").split()[::2])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = given.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    rows, total = [], 0
    for row in sorted(ordered.mapInArrow(run, MANIFEST).collect()):  # one row for each file
        rows.append((*row[:5], total))
        total += row["n_ids"]
    return docs.sparkSession.createDataFrame(rows, MANIFEST)


def _index(filesystem, path: str) -> tuple[int, list[tuple[int, int, int]]]:
    with filesystem.open_input_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{path} is no index")
    width, n = struct.unpack("<qq", data[8:24])
    return width, [struct.unpack_from("<qqq", data, 24 + 24 * i) for i in range(n)]


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and packed little-endian 4-byte ids of every record, checked as they are read."""
    import numpy as np

    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, root = _fs(path)
                width, index = _index(filesystem, f"{root}/{row['idx']}")
                with filesystem.open_input_file(f"{root}/{row['data']}") as f:
                    ends = [at for _, at, _ in index[1:]] + [f.size()]
                    i = 0
                    while i < len(index):
                        j = i + 1
                        while j < len(index) and ends[j] - index[i][1] <= common.SLICE_BYTES:
                            j += 1
                        base = index[i][1]
                        f.seek(base)
                        data = f.read(ends[j - 1] - base)
                        ids = [np.frombuffer(unframed(data, at - base), f"<u{width}").astype("<u4").tobytes() for _, at, _ in index[i:j]]
                        yield pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d, _, _ in index[i:j]], pa.int64()), pa.array([row["before"] + b for _, _, b in index[i:j]], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        i = j

    return manifest.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(path: str, name: str, rows: list[int]) -> list[tuple[int, bytes]]:
    """(doc_id, payload) of the records with these numbers in the file ``name``, in the given order: a shuffled read."""
    filesystem, root = _fs(path)
    _, index = _index(filesystem, f"{root}/{name}.idx")
    out = []
    with filesystem.open_input_file(f"{root}/{name}.rec") as f:
        for i in rows:
            doc_id, at, _ = index[i]
            end = index[i + 1][1] if i + 1 < len(index) else f.size()
            f.seek(at)
            out.append((doc_id, unframed(f.read(end - at), 0)))
    return out


def report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the records, reads them back and gives their digest, one row for each document."""
    spark = docs.sparkSession
    path = path or common.scratch(spark, "records")
    manifest = write(docs, path, tokenizer)
    found = read(spark, path, manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
