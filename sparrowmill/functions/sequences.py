"""Order-dependent scans of short sequences: monotone anchors and rows of a page."""

from __future__ import annotations

from bisect import bisect_right


def longest_nondecreasing(values: list[int]) -> list[int]:
    """Positions of a longest non-decreasing subsequence, the earliest end of equals."""
    ends: list[int] = []  # positions of the least last value of subsequences of each length
    before: dict[int, int] = {}
    for i, value in enumerate(values):
        k = bisect_right([values[e] for e in ends], value)
        before[i] = ends[k - 1] if k else -1
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def reading_rows(lines: list[dict], reach: float = 0.6) -> list[list[int]]:
    """Numbers of a page's lines (x, y, h) by row, each row from left to right.

    From the top down, a line joins the row as long as its middle is within ``reach`` heights of the
    mean middle of the row's lines so far.
    """
    middle = [line["y"] + line["h"] / 2 for line in lines]
    rows: list[list[int]] = []
    for i in sorted(range(len(lines)), key=lambda i: (middle[i], lines[i]["x"])):
        if rows:
            row = rows[-1]
            mean = sum(middle[k] for k in row) / len(row)
            height = max(1.0, min(lines[row[0]]["h"], lines[i]["h"]))
            if abs(middle[i] - mean) <= reach * height:
                row.append(i)
                continue
        rows.append([i])
    return [sorted(row, key=lambda i: lines[i]["x"]) for row in rows]
