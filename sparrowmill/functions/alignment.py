"""Approximate occurrences of a pattern in a text by bit-parallel edit distance.

Columns of the dynamic program are kept as two bit vectors of differences (Myers 1999); Python's
integers hold patterns of any length in one vector each, so that a text's character costs a few
operations on as many bits as the pattern has characters.
"""

from __future__ import annotations


def _distances(pattern: str, text: str, anywhere: bool):
    """Edit distances of the pattern to what ends after each character of the text.

    What is compared begins anywhere in the text, or else at its first character.
    """
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, size  # one more, one less than the row above
    for c in text:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | (not anywhere)) & full, (right_down << 1) & full
        keep = same | down
        up, down = right_down | (full & ~(keep | right_up)), right_up & keep
        yield score


def best(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, begin, end) of the part of the text that is least far from the pattern.

    Of several, the one that ends first; of those, the shortest.  An empty pattern is at the beginning.
    """
    if not pattern:
        return 0, 0, 0
    distance, end = len(pattern), 0
    for i, d in enumerate(_distances(pattern, text, anywhere=True), 1):
        if d < distance:
            distance, end = d, i
    if end == 0 or distance == len(pattern):
        return distance, 0, 0
    back = _distances(pattern[::-1], text[max(0, end - len(pattern) - distance) : end][::-1], anywhere=False)
    return distance, end - next(i for i, d in enumerate(back, 1) if d == distance), end


def common(pattern: str, text: str) -> int:
    """How many characters of the pattern a text has in the same order, whatever stands between them.

    The longest common subsequence, its rows as bit vectors whose zeros are the steps.
    """
    full = (1 << len(pattern)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    flat = full
    for c in text:
        same = flat & places.get(c, 0)
        flat = ((flat + same) | (flat - same)) & full
    return len(pattern) - flat.bit_count()
