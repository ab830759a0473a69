"""The pipeline's last stage: a task leaves no chunks in its worker, as an executor's idle workers would hold them beside the next stages."""

import pyarrow as pa

import corpus_pipeline
from pathloom.llm import pieces
from pathloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["the cat sat on the mat.\n\nThe  cat", None, "", "naïve 漢字  the end ", "the mat sat on the cat"]


class Task:
    """Stands for a table; holds what its workers are to run."""

    def select(self, *_):
        return self

    withColumn = drop = select

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def rows(self):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["doc_id", "text"])
        return [row for out in self.run(iter([batch, batch])) for row in out.to_pylist()]


def test_a_task_leaves_no_chunks(spark):
    pieces._VOCABULARIES.pop(MODEL, None)
    kept = pieces.encode(Task(), MODEL).rows()
    assert pieces.vocabulary_of(MODEL).lattice.nodes > 0
    pieces._VOCABULARIES.pop(MODEL)
    brief = corpus_pipeline.pieces_stage(spark, Task(), "").rows()
    lattice = pieces.vocabulary_of(MODEL).lattice
    assert lattice.nodes == len(lattice.bases) == len(lattice.log) == 0 and lattice.most == pieces.KEPT_NODES
    assert len(brief) == len(kept) > 3 * len(TEXTS) and [(r["doc_id"], r["sample"], r["ids"], r["round_trip"]) for r in brief] == [(r["doc_id"], r["sample"], r["ids"], r["round_trip"]) for r in kept]
