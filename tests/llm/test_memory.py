"""Workers that wait for tasks hold no memory of earlier ones."""

import re
import subprocess
import sys
from pathlib import Path

HELD = r"""
import re
import numpy as np
from twinplan.llm.common import lean
mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
pins = []

@lean
def task(batches):
    held = []
    for _ in range(3000):
        held.append(np.ones(12_000))
        pins.append(np.ones(400))
    yield len(held)

before = mb()
assert list(task(None)) == [3000]
print("MB", mb() - before)
"""


def test_a_finished_task_gives_its_memory_back():
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", HELD], cwd=root, capture_output=True, text=True, check=True).stdout
    assert float(re.search(r"MB (.*)", out)[1]) < 100  # of 275 that it held


def test_functions_of_the_pipeline_are_lean():
    from twinplan.llm import components, jaccard, packing, quality, repeats

    some = [jaccard._ask, jaccard._answer, jaccard._decide, jaccard._cover, jaccard._meet, jaccard._sets, jaccard._join_regions, components._in_one_task]
    some += [repeats._ship, repeats._meet, repeats._reopen, repeats._compare, repeats._cut, packing._lengths, quality._kept_rows, quality._line_rows]
    assert all(hasattr(f, "__wrapped__") for f in some)
