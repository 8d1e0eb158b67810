"""Workers outlive their tasks: what a stage has freed mustn't stay with them."""

import pathlib
import subprocess
import sys

import pytest

HELD = """
import sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from loomstate.llm import exact_dedup, near_dedup

def own_mb():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024

def texts(n):
    for k in range(n):
        rows = [" ".join(f"{k}x{i}y{j}" for j in range(150)) for i in range(1024)]
        ids = pa.array(range(1024 * k, 1024 * k + 1024), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(rows), pa.array(rows)], names=["doc_id", "ident", "text", "content"])

list(near_dedup.set_rows(texts(1), 5)), list(exact_dedup.gather(texts(1)))
before = own_mb()
rows = [sum(b.num_rows for b in f) for f in (exact_dedup.gather(texts(14)), near_dedup.set_rows(texts(14), 5))]
near_dedup._words.clear()
print(*rows, own_mb() - before)
"""


@pytest.mark.skipif(not pathlib.Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_worker_gives_back_what_it_has_freed():
    top = str(pathlib.Path(__file__).resolve().parents[2])
    said = subprocess.run([sys.executable, "-c", HELD, top], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert said[:2] == ["14336", "14336"]
    assert float(said[2]) < 25, f"{said[2]} MB stay"
