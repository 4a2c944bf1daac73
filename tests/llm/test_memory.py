"""What a Python worker holds beside the executor's heap."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid

REPO = Path(__file__).parents[2]


def test_arrays_of_a_slice_stay_small():
    model = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.1)
    texts = [f"word{i} " * 400 for i in range(1024)]
    tracemalloc.start()
    try:
        langs, _ = langid.score(model, texts)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(langs) == 1024 and peak < 25


KEPT = """
import re, pyarrow as pa
from tidemark.llm import common
def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def batches():
    for i in range(4):
        yield pa.record_batch({"text": pa.array([f"{i} {k} " * 400 for k in range(10_000)])})
before = mb()
rows = sum(b.num_rows for b in common.in_slices(batches()))
b = None
print(rows, mb() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_slices_give_memory_back():
    out = subprocess.run([sys.executable, "-c", KEPT], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == 40_000 and float(out[1]) < 30


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_move_texts_in_small_batches(spark, name, stage):
    session = spark.newSession()
    few = session.createDataFrame([(1, "the cat sat on the mat", "en", 22), (2, "password = abcdefghijkl1", "en", 24)], "doc_id long, text string, lang string, n_chars long")
    assert stage(session, few, "").count() == 2
    big = session.range(0, 4000, 1, 1).selectExpr("id", "repeat('some text ', 1000) text").mapInArrow(_sizes, "n long, size long").toPandas()
    assert big["n"].sum() == 4000 and big["size"].max() < 8e6
