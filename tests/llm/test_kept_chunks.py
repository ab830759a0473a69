"""Chunks of sampled segmentations: built once a worker and not once a slice; those beyond the bound go again, with the same samples."""

from pathloom.llm import pieces
from pathloom.llm.queries import tokenizer_path

TEXTS = ["the cat sat on the mat.\n\nThe  cat", None, "", "naïve 漢字" + "字" * 400 + "  the end ", "x" * 300]


def test_chunks_are_built_once(monkeypatch):
    v = pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))
    built, build = [], pieces.Lattice._build
    monkeypatch.setattr(pieces.Lattice, "_build", lambda self, chunks: (built.extend(chunks), build(self, chunks))[1])
    whole = [[(x[0].tolist(), round(x[1], 6)) for x in s] for s in pieces.sampled(v, range(5), TEXTS, 3)]
    assert len(built) == len(set(built)) > 10
    n = len(built)
    assert [[(x[0].tolist(), round(x[1], 6)) for x in s] for s in pieces.sampled(v, range(5), TEXTS, 3)] == whole
    assert len(built) == n
    for keep in (0, 40):
        monkeypatch.setattr(pieces, "KEPT_NODES", keep)
        other = pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))
        for _ in range(2):
            for k, text in enumerate(TEXTS):
                assert [(x[0].tolist(), round(x[1], 6)) for x in pieces.sampled(other, [k], [text], 3)[0]] == whole[k]
        assert other.lattice.nodes <= keep and sum(map(len, other.lattice.bases)) == other.lattice.nodes
