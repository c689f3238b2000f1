from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

SCATTERED = """
import re
import numpy as np
from paceline.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))

before = held()
common.worker_state("big", lambda: [np.ones(5000) for _ in range(4000)])
last = np.ones(5000)
common.UNUSED_S = -1.0
common.forget_unused()
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_dropped_memory_is_given_back():
    """160 MB in small pieces, with one more in use behind them."""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", SCATTERED], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(re.findall(r"-?\d+", out)[-1]) < 30_000
