import tracemalloc

import numpy as np
import pyarrow as pa

from servops.llm import decontam, line_dedup, near_dedup


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_scratch_stays_small_whatever_the_batch():
    """A batch of 16 MB, as Spark sends it, takes a small multiple of a MB of scratch arrays in a task."""
    words = np.array([f"word{i} and" for i in range(5000)])
    rng = np.random.default_rng(2)
    texts = [" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(3500)]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["id", "tie", "text"])
    widths, none = [(k, raw) for raw in (False, True) for k in range(8, 3, -1)], np.zeros(1 << 10, np.uint8).tobytes()
    assert peak(lambda: list(decontam._window_rows([batch], widths, 8, none, list("abcdefg")))) < 70

    def sets():
        for b in near_dedup.small_batches([batch], 2):
            near_dedup.circulant_signatures(near_dedup.text_sets(b.column(2), 5), 180)
    assert peak(sets) < 30


def test_scratch_of_lines_stays_small_whatever_the_batch():
    rng = np.random.default_rng(3)
    words = np.array([f"word{i} and" for i in range(5000)])
    texts = ["\n".join(" ".join(words[rng.integers(0, 5000, n)]) for n in (3, 9, 40, 150, 200)) for _ in range(2000)]
    batch, rule = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), line_dedup.Rule(grow=4, short=20)

    def keys():
        for b in line_dedup.small_batches([batch], 0, line_dedup._BATCH):
            lines = line_dedup.Lines(b.column(0).to_pylist())
            rows = np.flatnonzero(lines.full)
            for found in (line_dedup.own_keys, line_dedup.other_keys):
                for _ in found(lines, rows, rule):
                    pass
    line_dedup._power.clear()
    assert peak(keys) < 60
