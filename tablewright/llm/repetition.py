"""Quality rules on repetition: a suffix array over the words of each text.

Adjacent suffixes and their longest common prefixes give, for every place, the
longest word sequence that also begins elsewhere in the same text. Those of at
least ``min_repeat`` words are repeated spans; a text is rejected if their union
covers too large a part of it, or if one of them is too long.

Null and empty texts have no words, so they fail the base rule. Repeated rows
are judged one by one, columns that the input has besides are left alone, and
an empty table gives an empty one. Nothing is shuffled.
"""

import numpy as np
from pyspark.sql import DataFrame

from tablewright.llm.chunks import IS_SPACE, Chunk, appended, covered

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_spans long, repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks that each doubling gave.

    ``words`` are integers that differ between texts; ``ends[i]`` is where the
    text of place i ends, and no suffix goes beyond it. Two places have the
    same rank at level k if their first 2**k words exist and are equal.
    Only suffixes that still tie are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        alone = first & np.append(first[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, levels
        places = order[slots]
        ahead = places + step
        inside = ahead < ends[places]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[places]
        again = np.lexsort((second, group))
        places, second, group = places[again], second[again], group[again]
        order[slots] = places
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first[slots] = new
        rank = rank.copy()
        rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.astype(np.int32))
        step *= 2


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the length of the longest sequence there that also begins elsewhere in its text."""
    longest = np.zeros(len(words), np.int64)
    if len(words) < 2:
        return longest
    order, levels = suffix_array(words, ends)
    tied = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    one, two = order[tied], order[tied + 1]
    common = np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + common, two + common
        here = np.flatnonzero((a < ends[one]) & (b < ends[two]))
        same = levels[k][a[here]] == levels[k][b[here]]
        common[here[same]] += 1 << k
    np.maximum.at(longest, one, common)
    np.maximum.at(longest, two, common)
    return longest


def duplicate_lines(chunk: Chunk) -> np.ndarray:
    out = np.zeros(len(chunk), np.int64)
    data = chunk.data.tobytes()
    for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
        lines = data[a:b].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                out[i] += line in seen and bool(line.split())
                seen.add(line)
    return out


def _per_row(chunk: Chunk, flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def measures(chunk: Chunk, min_repeat: int) -> dict[str, np.ndarray]:
    offsets, rows = chunk.word_offsets, chunk.word_rows
    ends = offsets[1:][rows]
    # Equal words of different rows are different symbols, so no suffix is compared with another row's.
    with np.errstate(over="ignore"):
        symbols = chunk.word_hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    longest = repeats(symbols, ends)
    n = len(longest)
    three, spans = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_repeat)
    inside = covered(three, np.full(len(three), 3), n)
    union = covered(spans, longest[spans], n)
    before = np.zeros(n, np.int64)
    before[1:] = longest[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = 0
    maximal = np.zeros(n, bool)
    maximal[spans] = before[spans] <= longest[spans]  # not the rest of a span that begins one word earlier
    top = np.zeros(len(chunk), np.int64)
    np.maximum.at(top, rows, longest)
    letters = _letters(chunk)
    return {
        "n_words": np.diff(offsets),
        "word_chars": _per_row(chunk, letters, chunk.offsets),
        "n_symbols": _per_row(chunk, _IS_SYMBOL[chunk.data], chunk.offsets),
        "n_dup_lines": duplicate_lines(chunk),
        "n_repeat_words": _per_row(chunk, inside, offsets),
        "n_spans": _per_row(chunk, maximal, offsets),
        "repeat_words": _per_row(chunk, union, offsets),
        "longest_repeat": np.where(top >= min_repeat, top, 0),
    }


def _letters(chunk: Chunk) -> np.ndarray:
    """First bytes of the characters inside words."""
    first = (chunk.data & 0xC0) != 0x80
    return first & ~IS_SPACE[chunk.data]


def judge_repetition(
    docs: DataFrame,
    min_repeat: int = 8,
    max_covered: float = 0.3,
    max_longest: int = 100,
    column: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the base counts, the repeated spans and the verdict of each text.

    Kept are texts of 50 words or more, at most half of them in repeated
    three-word windows, at most ``max_covered`` of them in repeated spans of at
    least ``min_repeat`` words, and no such span longer than ``max_longest``.
    """

    def measure(chunk: Chunk) -> dict[str, np.ndarray]:
        m = measures(chunk, min_repeat)
        n = m["n_words"]
        base = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
        fine = (m["repeat_words"] <= max_covered * n) & (m["longest_repeat"] <= max_longest)
        return {**m, "base_failed": base, "kept": ~base & fine}

    return appended(docs, FIELDS, measure, keep, column)
