"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the lattice.

The lattice of a text has an edge for every vocabulary piece that matches at a position (characters without a piece have
one edge of byte pieces). A piece's probability falls with its merge rank by Zipf's law, as the file holds ranks only; a
segmentation's probability is the product over its edges, normalised over all segmentations by backward sums.

Sampling is a perturbed A-star search from the top down: each region of the search has one Gumbel value, the maximum
over its segmentations and so an exact bound. The first path is followed to its end at once; what it leaves is one region, "another
edge at one of its decisions, anything after". Such a region has the mass of what comes before its first decision without the path's own
after its last, so that it takes one Gumbel, truncated at the path's, and not one a decision. The best region is opened
next: the decision is drawn by mass, the edge and what follows too, and that path's rest and the decisions before and after this one are
regions again, truncated at its value. So k paths are the k segmentations with the largest perturbed log-probabilities, that is
k distinct draws without replacement, in order. The best value that is left is the threshold of the inclusion probability
1 - exp(-exp(log p - threshold)). Random numbers are a hash of the row key, the sample and the decision, so they don't
depend on partitions or order.

No piece crosses from a non-space to a space or over a line's end, so the lattice of a text is a chain of lattices
of chunks, which equal chunks share: a worker keeps those it meets first, up to a bound, so that common chunks are built
once and not once a slice; the file is checked for this. An executor can have more workers than tasks, and an idle one holds
what it keeps; where other stages have left such workers, ``brief`` keeps fewer chunks, and only as long as the task lasts.

Null counts as empty; an empty text has one segmentation, without pieces, of probability 1; texts with fewer than k
segmentations give all they have; repeated rows give equal rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLES = 3
SPACE = "▁"
CHUNK = re.compile(" *[^ \n]+| +|\n")
#: Zipf-Mandelbrot: a piece's weight is 1 / (rank + SHIFT).
SHIFT = 2.7
SLICE = 1 << 17
#: Edges below which one slow call does for what else takes several.
FEW = 256
#: Nodes of the chunks that a worker keeps, and those of a task that leaves nothing behind.
KEPT_NODES, BRIEF_NODES = 1 << 21, 1 << 19
TABLE_BITS, SLOT_BITS = 22, 19
#: Ids that are decoded together.
DECODED = 1 << 15
#: Between the numbers of a key.
STRIDE = 0xD1342543DE82EF95


def normal(text: str | None) -> str:
    """What the file's normaliser makes of a text: a space before it, spaces as marks."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunked(text: str | None) -> list[str]:
    """The chunks of a normalised text, with spaces for marks: most texts are then strings of one byte a character."""
    if not text:
        return []
    text = " " + text.replace(SPACE, " ")
    if "  " in text or "\0" in text:
        return CHUNK.findall(text)
    return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


class Vocabulary:
    """Pieces by hash, their log-probabilities and their bytes."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lib = lib
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        names = [lib.id_to_piece(i) for i in plain]
        if any("\n" in p or SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in names):
            raise ValueError("pieces cross chunks")
        self.byte0 = next((i for i in range(lib.get_piece_size()) if lib.is_byte(i)), None)
        rank = np.argsort(np.argsort([-lib.get_score(i) for i in plain], kind="stable"), kind="stable")
        weight = 1 / (rank + SHIFT)
        self.longest = max(map(len, names))
        size = np.array([len(p) for p in names])
        code = np.zeros((len(names), self.longest), np.uint64)
        code[np.repeat(np.arange(len(names)), size), np.concatenate([np.arange(n) for n in size])] = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        hashes, h, starts = np.zeros(len(names), np.uint64), np.zeros(len(names), np.uint64), []
        for n in range(self.longest):
            h = rolled(h, code[:, n])
            starts.append(h[size > n])
            hashes[size == n + 1] = h[size == n + 1]
        starts = np.concatenate(starts)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("hashes of pieces clash")
        self.hashes, self.ids, self.logs = hashes[order], np.array(plain, np.int32)[order], np.log(weight / weight.sum())[order]
        self.begun = np.zeros(1 << TABLE_BITS, bool)  # which hashes begin a piece; others need no longer window
        self.begun[(starts >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        slots = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]  # the first of those that share a slot
        self.many = np.zeros(1 << SLOT_BITS, bool)
        self.many[slots[1:][slots[1:] == slots[:-1]]] = True
        self.bytes: list[bytes] = [b""] * lib.get_piece_size()
        for i, p in zip(plain, names, strict=True):
            self.bytes[i] = p.encode()
        for b in range(256 if self.byte0 is not None else 0):
            self.bytes[self.byte0 + b] = bytes([b])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lattice = Lattice(self)

    def find(self, h):
        """Places of hashes among the pieces, -1 where there is none."""
        import numpy as np

        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        k = self.slot[slot]
        k[self.hashes[k] != h] = -1  # an empty slot gives the last piece, whose hash differs
        more = np.flatnonzero((k < 0) & self.many[slot])
        if len(more):
            at = np.minimum(np.searchsorted(self.hashes, h[more]), len(self.hashes) - 1)
            k[more] = np.where(self.hashes[at] == h[more], at, -1)
        return k

    def decode(self, ids: list) -> list[bytes]:
        """The normalised texts of arrays of ids, in UTF-8."""
        import numpy as np

        row = np.concatenate(ids).astype(np.intp) if ids else np.zeros(0, np.intp)
        texts, ends = [], np.cumsum(self.sizes[row])
        for at in range(0, len(row), DECODED):
            part = row[at : at + DECODED]
            size = self.sizes.take(part)
            place = np.repeat(self.begins.take(part) - np.cumsum(size) + size, size)
            place += np.arange(len(place))
            texts.append(self.letters.take(place, mode="clip").tobytes())
        text, cuts = b"".join(texts), np.append(0, ends)[np.cumsum([0, *map(len, ids)])].tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def rolled(h, code):
    """Hashes of strings that are one character longer."""
    import numpy as np

    h = (h + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class Bases(dict):
    """First nodes of chunks, as four bytes; one that is asked for and not there gets the next nodes and is noted in ``new``."""

    def __init__(self):
        self.end, self.new = 0, []

    def __missing__(self, chunk: str) -> bytes:
        base = self[chunk] = self.end.to_bytes(4, "little")
        self.end += len(chunk)
        self.new.append(chunk)
        return base


class Lattice:
    """The lattices of chunks: nodes are positions, edges lie node by node with cumulated conditional probabilities.

    ``bases`` has the first node of each chunk. Chunks are kept as long as they have no more than ``most`` nodes together (``KEPT_NODES``
    where it is not given); later ones are put behind them and go again with :meth:`forget`.
    """

    def __init__(self, vocabulary: Vocabulary, most: int | None = None):
        import numpy as np

        self.most = KEPT_NODES if most is None else most
        self.vocabulary, self.bases, self.passing, self.kept = vocabulary, Bases(), [], (0, 0)
        self.nodes = self.edges = 0
        self.first = np.zeros(1, np.int32)
        self.node, self.next, self.id, self.log, self.within = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.float64, np.float64))

    def see(self, texts: list[list[str]]):
        """The first nodes of the chunks of all texts, text by text; builds those that are not there."""
        import numpy as np

        out = np.frombuffer(b"".join(map(self.bases.__getitem__, chain.from_iterable(texts))), "<i4")
        new, self.bases.new = self.bases.new, []
        self._build(new)
        if self.nodes <= self.most:
            self.kept = self.nodes, self.edges
        else:
            self.passing = new
        return out

    def forget(self) -> None:
        """Drops the chunks that are not kept."""
        for c in self.passing:
            del self.bases[c]
        self.passing = []
        self.nodes, self.edges = self.kept
        self.bases.end = self.nodes

    def _room(self, names: tuple[str, ...], used: int, more: int) -> None:
        import numpy as np

        for name in names:
            if len(old := getattr(self, name)) < used + more:
                setattr(self, name, new := np.empty((used + more) * 5 // 4, old.dtype))
                new[:used] = old[:used]

    def _build(self, chunks: list[str]) -> None:
        import numpy as np

        if not chunks:
            return
        v, size = self.vocabulary, np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        left = np.repeat(np.cumsum(size).astype(np.int32), size) - np.arange(len(code), dtype=np.int32)  # characters from a position to its chunk's end
        froms, ids, logs, lens = [], [], [], []
        live, h = np.arange(len(code), dtype=np.int32), np.zeros(len(code), np.uint64)
        for n in range(1, v.longest + 1):
            h = rolled(h, code[live + n - 1])
            go = v.begun[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            at, found = live[go], h[go]
            k = v.find(found)
            hit = k >= 0
            more = left[at] > n
            live, h = at[more], found[more]
            at, k = at[hit], k[hit]
            if n == 1:
                bare = np.ones(len(code), bool)
                bare[at] = False
                bare = np.flatnonzero(bare)  # no piece: bytes, told by a negative number
                at, own, log = np.concatenate([at, bare.astype(np.int32)]), np.concatenate([v.ids[k], -code[bare].astype(np.int32) - 1]), np.concatenate([v.logs[k], np.full(len(bare), v.logs.min())])
            else:
                own, log = v.ids[k], v.logs[k]
            froms.append(at)
            ids.append(own)
            logs.append(log)
            lens.append(np.full(len(at), n, np.int8))
        # longest first, as they are likeliest: a walk then looks at few edges
        froms, lens, ids, logs = froms[::-1], lens[::-1], ids[::-1], logs[::-1]
        at, lens = np.concatenate(froms), np.concatenate(lens)
        order = np.argsort(at, kind="stable")  # merges of sorted runs
        node, reach, own, logs = at[order], lens[order].astype(np.int32), np.concatenate(ids)[order], np.concatenate(logs)[order]
        to, away = node + reach, left[node]
        to[away <= reach] = len(code)  # the end, whose sum is 0
        order = np.argsort(away.astype(np.uint16) if away.max() < 1 << 16 else away, kind="stable")  # by distance from the end
        at, ends, given, away = node[order], to[order], logs[order], away[order]
        beta = np.zeros(len(code) + 1)
        head = np.concatenate([[True], at[1:] != at[:-1]])
        heads, group = np.flatnonzero(head), np.cumsum(head) - 1
        steps = np.searchsorted(away, np.arange(1, int(away[-1]) + 2))
        begun = np.append(group, len(heads))[steps]  # nodes before each distance
        steps, begun, nodes = steps.tolist(), begun.tolist(), at[heads]
        for a, b, i, j in zip(steps, steps[1:], begun, begun[1:], strict=False):  # all nodes at one distance together
            if a == b:
                continue
            score, first = given[a:b] + beta[ends[a:b]], heads[i:j] - a
            if b - a < FEW:
                beta[nodes[i:j]] = np.logaddexp.reduceat(score, first)
                continue
            top = np.maximum.reduceat(score, first)
            beta[nodes[i:j]] = top + np.log(np.add.reduceat(np.exp(score - top[group[a:b] - i]), first))
        log = np.minimum(logs + beta[to] - beta[node], 0.0)
        e, m = self.edges, self.edges + len(node)
        self._room(("node", "next", "id", "log", "within"), e, len(node))
        self._room(("first",), self.nodes + 1, len(code))
        first = np.searchsorted(node, np.arange(len(code) + 1, dtype=np.int32))
        p = np.exp(log)
        run = np.cumsum(p)
        within = run - (run - p)[first[:-1]][node]
        within[first[1:] - 1] = 1.0
        to += self.nodes
        to[to == self.nodes + len(code)] = -1
        self.node[e:m], self.next[e:m], self.id[e:m], self.log[e:m], self.within[e:m] = node + self.nodes, to, own, log, within
        self.first[self.nodes : self.nodes + len(code) + 1] = first + e
        self.nodes, self.edges = self.nodes + len(code), m

    def walk(self, nodes, seeds):
        """Edges of paths that begin at these nodes (-1: none), and how many each path has. Step k takes the number of seed + k * STRIDE."""
        import numpy as np

        first, within, after = self.first, self.within, self.next
        live = np.flatnonzero(nodes >= 0)
        now, seeds, count, steps = nodes.take(live).astype(np.intp), seeds.take(live), np.zeros(len(nodes), np.int64), []
        while len(live):
            u = number(seeds)
            edge = first.take(now, mode="clip").astype(np.intp)  # all are within the bounds; clip takes without a copy
            more = np.flatnonzero(within.take(edge, mode="clip") < u)
            at, least = edge.take(more), u.take(more)
            while len(more):
                at += 1
                edge[more] = at
                go = np.flatnonzero(within.take(at, mode="clip") < least)
                more, at, least = more.take(go), at.take(go), least.take(go)
            steps.append((live, edge))
            count[live] = len(steps)
            now = after.take(edge, mode="clip")
            go = np.flatnonzero(now >= 0)
            live, now, seeds = live.take(go), now.take(go).astype(np.intp), seeds.take(go)
            seeds += np.uint64(STRIDE)
        heads = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            place = heads.take(who)
            place += k
            out[place] = edge
        return out, count


def mixed(x):
    """splitmix64 of unsigned numbers."""
    import numpy as np

    u = np.uint64
    x = x + u(0x9E3779B97F4A7C15)
    x ^= x >> u(30)
    x *= u(0xBF58476D1CE4E5B9)
    x ^= x >> u(27)
    x *= u(0x94D049BB133111EB)
    x ^= x >> u(31)
    return x


def number(seeds):
    """Numbers in (0, 1), one for each seed."""
    import numpy as np

    x = mixed(seeds)
    x >>= np.uint64(12)
    x = x + 0.5
    x *= 1 / (1 << 52)
    return x


def uniform(keys, counters):
    """Numbers in (0, 1) that depend on key and counter only."""
    import numpy as np

    return number(keys + counters.astype(np.uint64) * np.uint64(STRIDE))


def cut_gumbel(log_mass: float, bound: float, u: float) -> float:
    """A Gumbel of this log mass, truncated at ``bound``."""
    return log_mass - math.log(math.exp(min(log_mass - bound, 700.0)) - math.log(u)) if log_mass > -math.inf else log_mass


class Path:
    """A segmentation: ``prefix``, which ends with the edge that told it from another, and the edges walked from there.

    ``before`` and ``after`` are the log-probabilities up to that edge and with it; ``run`` cumulates the costs (-log) of ``edges``,
    of which ``chunk`` gives the chunk, with ``first`` that of the prefix's last edge. ``ids`` are those of ``edges``.
    """

    __slots__ = ("prefix", "before", "after", "first", "value", "edges", "run", "ids", "chunk")

    def __init__(self, prefix, before: float, after: float, first: int, value: float):
        self.prefix, self.before, self.after, self.first, self.value = prefix, before, after, first, value


class Search:
    """The search of one text: the paths found, and the regions that are left.

    A region is (value, path, lo, hi, gone): another edge at one of the path's decisions from lo to hi; or, where ``gone`` is given, at the
    end of its prefix an edge that is not in it.
    """

    __slots__ = ("paths", "regions")

    def __init__(self):
        self.paths, self.regions = [], []

    def leave(self, path: Path, lo: int, hi: int, bound: float, u: float) -> None:
        """Decisions from lo to hi become a region, unless they leave no choice."""
        if lo < hi and (cost := float(path.run[hi] - path.run[lo])) > 0:
            mass = path.after - float(path.run[lo]) + math.log(-math.expm1(-cost))
            self.regions.append((cut_gumbel(mass, bound, u), path, lo, hi, None))

    def best(self) -> float:
        return max((x[0] for x in self.regions), default=-math.inf)


#: Numbers that a search takes in a round.
DRAWS = 6


def sampled(vocabulary: Vocabulary, keys, texts: list[str | None], k: int) -> list[list[tuple]]:
    """For each text its samples in order: (ids, log-probability, perturbed log-probability, inclusion probability)."""
    import numpy as np

    lattice = vocabulary.lattice
    chunks = [chunked(t) for t in texts]
    n = np.fromiter(map(len, chunks), np.int64, len(chunks))
    flat, ends = lattice.see(chunks), np.cumsum(n)
    starts = ends - n
    keys = mixed(np.asarray(keys, np.int64).astype(np.uint64))
    places = ((np.arange(len(flat)) - np.repeat(starts, n)) << 20).astype(np.uint64) * np.uint64(STRIDE)
    searches, lefts, rights = [Search() for _ in texts], starts.tolist(), ends.tolist()
    first = -np.log(-np.log(uniform(keys, np.zeros(len(keys), np.int64))))
    none = np.zeros(0, np.int64)
    # what is to be walked in this round: a text, its path, the node from where, and the edges that are gone there with the mass of those left
    todo = [(t, Path(none, 0.0, 0.0, 0, value), None, None, 0.0) for t, value in enumerate(first.tolist())]
    for r in range(k):
        if r:
            nodes = np.full(len(flat), -1, np.int32)
            for t, path, node, _, _ in todo:
                at = lefts[t] + path.first
                nodes[at : rights[t]] = flat[at : rights[t]]
                nodes[at] = node
        edges, steps = lattice.walk(nodes if r else flat, np.repeat(mixed(keys + np.uint64(r + 1)), n) + places)
        passed = np.cumsum(steps)
        cuts = np.append(0, passed)
        begins, stops = cuts[starts].tolist(), cuts[ends].tolist()
        cost, ids = lattice.log.take(edges, mode="clip"), lattice.id.take(edges, mode="clip")
        np.negative(cost, out=cost)
        draws = uniform(keys[:, None] + np.uint64(1000 + r), np.arange(DRAWS)).tolist()
        for t, path, _, gone, rest in todo:
            a, b, s = begins[t], stops[t], searches[t]
            path.edges, path.ids, path.run, path.chunk = edges[a:b], ids[a:b], np.zeros(b - a + 1), (passed[lefts[t] : rights[t]], a)
            np.cumsum(cost[a:b], out=path.run[1:])
            s.paths.append(path)
            s.leave(path, 0, b - a, path.value, draws[t][0])
            if rest > 0:
                s.regions.append((cut_gumbel(path.before + math.log(rest), path.value, draws[t][1]), path, 0, 0, gone))
        if r + 1 < k:
            todo = [(t, *x) for t, s in enumerate(searches) if (x := _next(lattice, s, draws[t])) is not None]
    out = [_samples(vocabulary, lattice, s) for s in searches]
    lattice.forget()
    return out


def _next(lattice: Lattice, s: Search, draws: list[float]):
    """Opens the best region: another edge at one of its decisions, all chunks after it to be walked."""
    import numpy as np

    if not s.regions:
        return None
    region = max(s.regions, key=lambda x: x[0])
    s.regions.remove(region)
    value, path, lo, hi, gone = region
    if gone is None:
        # the decision whose share holds a point of the mass; forced ones have none
        low, high, run = float(path.run[lo]), float(path.run[hi]), path.run
        point = min(max(low - math.log1p(draws[2] * math.expm1(low - high)), math.nextafter(low, math.inf)), high)
        at = lo + int(run[lo + 1 : hi + 1].searchsorted(point))
        s.leave(path, lo, at, value, draws[4])
        s.leave(path, at + 1, hi, value, draws[5])
        taken, prefix, before = int(path.edges[at]), np.concatenate([path.prefix, path.edges[:at]]), path.after - float(run[at])
        passed, offset = path.chunk
        first, gone = int(passed.searchsorted(offset + at, "right")), {taken}
    else:
        taken, prefix, before, first = int(path.prefix[-1]), path.prefix[:-1], path.before, path.first
    node = int(lattice.node[taken])
    edges = [e for e in range(int(lattice.first[node]), int(lattice.first[node + 1])) if e not in gone]
    logs = lattice.log[edges].tolist()
    p = [math.exp(x) for x in logs]
    point, j = draws[3] * sum(p), 0
    while j + 1 < len(p) and point >= p[j]:
        point -= p[j]
        j += 1
    rest = sum(p[:j]) + sum(p[j + 1 :])
    return Path(np.append(prefix, edges[j]), before, before + logs[j], first, value), int(lattice.next[edges[j]]), gone | {edges[j]}, rest


def _samples(vocabulary: Vocabulary, lattice: Lattice, s: Search) -> list[tuple]:
    import numpy as np

    threshold = s.best()
    out = []
    for path in s.paths:
        ids, log = np.concatenate([lattice.id[path.prefix], path.ids]), path.after - float(path.run[-1])
        if len(ids) and ids.min() < 0:
            odd = np.flatnonzero(ids < 0)
            code = -ids[odd] - 1
            if (code < 128).all():
                ids[odd] = vocabulary.byte0 + code
            else:
                ids = np.array([y for x in ids.tolist() for y in ([x] if x >= 0 else [vocabulary.byte0 + b for b in chr(-x - 1).encode("utf-8", "surrogatepass")])], np.int64)
        inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(log - threshold, 700.0)))
        out.append((ids.astype("<u4"), log, path.value, inclusion))
    return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, model: str, samples: int = SAMPLES, brief: bool = False) -> DataFrame:
    """One row for each document and sample: ids, probabilities and whether decoding gives the normalised text back.

    ``brief``: a task gives back the memory of its chunks, with the same rows.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        if brief:
            vocabulary.lattice = Lattice(vocabulary, BRIEF_NODES)
        for whole in batches:
            for part in common.slices(whole, limit=SLICE):
                texts, keys = common.values(part, "text"), common.values(part, "doc_id")
                found = sampled(vocabulary, [x or 0 for x in keys], texts, samples)
                decoded = iter(vocabulary.decode([x[0] for own in found for x in own]))
                rows = []
                for doc_id, text, own in zip(keys, texts, found, strict=True):
                    want = normal(text).encode()
                    rows += [(doc_id, j, ids.tobytes(), len(ids), log, value, inclusion, next(decoded) == want) for j, (ids, log, value, inclusion) in enumerate(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
        if brief:
            vocabulary.lattice = Lattice(vocabulary)
            common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sample int, ids binary, n_tokens long, log_prob double, perturbed double, inclusion double, round_trip boolean")


def report(docs: DataFrame, model: str, samples: int = SAMPLES, brief: bool = False) -> DataFrame:
    """The digest of :func:`encode`: the crc32 of each sample's ids in place of them."""
    return encode(docs, model, samples, brief).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
