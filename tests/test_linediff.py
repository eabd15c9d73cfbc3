"""Edit scripts against the table of all edit distances."""

import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.functions import linediff

LINES = st.lists(st.sampled_from("abc"), max_size=12)


def by_table(a, b):
    """The script whose edits, from the last to the first, come from the diagonal that reaches further, a deletion on ties; from the table of distances."""
    grid = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            grid[i][j] = grid[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(grid[i - 1][j], grid[i][j - 1])
    reach = {}
    for i, row in enumerate(grid):
        for j, d in enumerate(row):
            reach[d, i - j] = max(i, reach.get((d, i - j), 0))
    x, y, out = len(a), len(b), []
    for d in range(grid[x][y], 0, -1):
        k = x - y
        below, above = reach.get((d - 1, k - 1), -2), reach.get((d - 1, k + 1), -2)
        x, y = (above, above - k - 1) if below < above else (below, below - k + 1)
        out.append((x, y, below < above))
    return out[::-1]


@settings(max_examples=400, deadline=None)
@given(LINES, LINES, st.sampled_from([4, 9, 1 << 22]))
def test_edits(a, b, cells):
    kept, linediff.CELLS = linediff.CELLS, cells
    try:
        assert linediff.edits(a, b) == by_table(a, b)
    finally:
        linediff.CELLS = kept
    script = linediff.script(a, b)
    assert [s for k, s in script if k != "insert"] == a and [s for k, s in script if k != "delete"] == b


def test_memory_of_many_changes():
    """8,000 changed lines on either side: all levels would hold 128 million values."""
    code = (
        "import resource; from wakeline.functions import linediff as x; "
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; "
        "assert len(x.edits([f'a{i}' for i in range(8000)], [f'b{i}' for i in range(8000)])) == 16000; "
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(got.stdout) < 150 * 1024


def test_one_side_or_nothing():
    assert linediff.edits([], []) == [] and linediff.script(["a"], ["a"]) == [("equal", "a")]
    assert linediff.script([], ["a", "b"]) == [("insert", "a"), ("insert", "b")]
    assert linediff.script(["a", "b"], []) == [("delete", "a"), ("delete", "b")]
