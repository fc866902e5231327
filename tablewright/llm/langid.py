"""Language identification by cross-parsing.

One suffix automaton per language holds labelled text. A text is parsed greedily
into the longest phrases that the automaton contains, beginning anew after each;
the language whose text explains it in the fewest phrases per character wins.
A letter that no labelled text of a language has is a phrase of its own there.
Long texts are walked in pieces side by side; a piece is walked again from the state
the one before it ended in until all begin rightly, so phrases run on over the cuts.
Case is ignored and all that is no letter counts as a blank, runs of which count once.
The automata are tables of transitions, so many pieces of text take a step at once.

Null texts and texts without letters get ``und`` and score 0; with a single
learned language the score is 1; ties go to the first label in order. Repeated rows
are judged one by one, columns that the input has besides are left alone, and an
empty table gives an empty one. A table without labelled text cannot be learned
from and raises.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import OperationError
from tablewright.llm.chunks import Chunk, appended

FIELDS = "lang_pred string, score double, phrases_per_char double"
_RESTART = np.int32(-(2**31))
_PIECE = 2048  # characters that are walked in one go
_PLANES = 0x110000


@dataclass(frozen=True)
class Languages:
    """labels; small letter of each character; symbol of each letter; next state by (language, state, symbol), negative where a phrase ends."""

    labels: list[str]
    letters: np.ndarray
    symbols: np.ndarray
    steps: np.ndarray
    roots: np.ndarray
    width: int


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(steps[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


_BLANK = ord(" ")


def _lowered() -> np.ndarray:
    """Lower case of each letter, where that is one character; a blank for all that is no letter."""
    out = np.full(_PLANES, _BLANK, np.uint32)
    for c in range(_PLANES):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _squeezed(points: np.ndarray) -> np.ndarray:
    """Which places to keep so that runs of blanks become one."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _BLANK) | (points[:-1] != _BLANK)
    return keep


def fit_languages(
    labelled: DataFrame, texts_per_language: int = 40, chars_per_language: int = 65536, short_chars: int = 2000
) -> Languages:
    """Automata over a bounded sample of whole texts.

    ``labelled`` has ``text`` and ``lang``. Of each language the distinct texts of at most
    ``short_chars`` characters come first, by hash, then longer ones; taken are at most
    ``texts_per_language``, and none that begins beyond ``chars_per_language``. So what reaches
    the driver is bounded by these and the number of languages, but for one text at the end of each.
    """
    lettered = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    lettered = lettered.select("lang", "text", F.xxhash64("text").alias("hash"), F.char_length("text").alias("chars"))
    order = Window.partitionBy("lang").orderBy(F.col("chars") > short_chars, "hash", "chars")
    before = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = lettered.select("lang", "hash", "chars").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts_per_language)
    drawn = ranked.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < chars_per_language)
    sample = (
        lettered.join(F.broadcast(drawn), ["lang", "hash", "chars"])
        .groupBy("lang", "n")
        .agg(F.min("text").alias("text"))
        .withColumn("text", F.regexp_replace("text", r"\P{L}+", " "))
        .collect()
    )
    if not sample:
        raise OperationError("no labelled text to learn languages from")
    low = _lowered()
    texts: dict[str, list[np.ndarray]] = {}
    for row in sorted(sample, key=lambda r: (r.lang, r.n)):
        points = np.frombuffer(row.text.encode("utf-32-le"), np.uint32)
        letters = low[points]
        texts.setdefault(row.lang, []).append(letters[_squeezed(letters)])
    known = np.unique(np.concatenate([t for all_texts in texts.values() for t in all_texts]))
    number = np.zeros(_PLANES, np.int32)  # 0: not seen in any labelled text
    number[known] = np.arange(1, len(known) + 1)
    width = len(known) + 1
    tables, roots = [], []
    at = 0
    for label in texts:
        steps = suffix_automaton([int(c) for t in texts[label] for c in number[t]])
        table = np.full((len(steps), width), -1, np.int32)
        for state, out in enumerate(steps):
            table[state, list(out)] = list(out.values())
        # A missing step ends the phrase; the character begins the next one, or stands alone if it is unknown.
        begin = np.where(table[0] >= 0, table[0], 0)
        begun = np.broadcast_to((begin + at) * width, table.shape)
        steps_on = np.where(table >= 0, (table + at) * width, begun | _RESTART).astype(np.int32)
        steps_on[0] = begun[0] | _RESTART  # in the first state no phrase is open
        tables.append(steps_on)
        roots.append(at * width)
        at += len(steps)
        if at * width >= 2**31:
            raise OperationError("too much labelled text; lower texts_per_language or chars_per_language")
    return Languages(list(texts), low, number, np.concatenate(tables).ravel(), np.array(roots, np.int32), width)


def _walked(
    model: Languages, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each piece of ``symbols``, and the states it ends in, by (language, piece)."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = states[:, order]
    count = np.zeros(state.shape, np.int64)
    active = len(starts)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[active - 1] <= t:
            active -= 1
        step = model.steps[state[:, :active] + symbols[starts[:active] + t]]
        count[:, :active] += step < 0
        state[:, :active] = step & 0x7FFFFFFF
    counts, ends = np.empty_like(count), np.empty_like(state)
    counts[:, order], ends[:, order] = count, state
    return counts, ends


def phrases(model: Languages, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of phrases of each text in ``symbols`` for each language, shape (languages, texts)."""
    pieces = -(-lengths // _PIECE)
    rows = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[rows] + nth * _PIECE
    n = np.minimum((starts + lengths)[rows] - at, _PIECE)
    begin = np.repeat(model.roots[:, None], len(rows), axis=1)
    counts, ends = _walked(model, symbols, at, n, begin)
    later = np.flatnonzero(nth > 0)
    while True:
        # Each round settles at least one more piece of every text; parses that begin apart mostly meet within a few phrases.
        wrong = later[(begin[:, later] != ends[:, later - 1]).any(axis=0)]
        if not len(wrong):
            break
        begin[:, wrong] = ends[:, wrong - 1]
        counts[:, wrong], ends[:, wrong] = _walked(model, symbols, at[wrong], n[wrong], begin[:, wrong])
    return np.array([np.bincount(rows, c, len(starts)) for c in counts])


def identify_languages(
    docs: DataFrame, model: Languages, column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the language of the fewest phrases per character, and how far the second is behind."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data, as executors may lack this package

    def measure(chunk: Chunk) -> dict:
        model = Languages(**shared.value)
        labels = np.array(model.labels, object)
        points = np.frombuffer(chunk.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        letters = model.letters[points]
        first = (chunk.data & 0xC0) != 0x80
        places = np.zeros(len(first) + 1, np.int64)
        np.cumsum(first, out=places[1:])
        begins = places[chunk.offsets]  # byte offsets to offsets among the characters
        keep = _squeezed(letters)
        keep[begins[:-1][np.diff(begins) > 0]] = True
        symbols = model.symbols[letters[keep]]
        kept = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        offsets = kept[begins]
        n = np.diff(offsets)
        rates = phrases(model, symbols, offsets[:-1], n) / np.maximum(n, 1)
        lowest = rates.min(axis=0)
        second = np.partition(rates, 1, axis=0)[1] if len(labels) > 1 else np.full(len(chunk), np.inf)
        texts = chunk.rows.column(column).fill_null("")
        lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(second > 0, 1 - lowest / second, 0.0)
        return {
            "lang_pred": pa.array(np.where(lettered, labels[rates.argmin(axis=0)], "und"), pa.string()),
            "score": np.where(lettered, np.clip(score, 0, 1), 0.0),
            "phrases_per_char": lowest,
        }

    return appended(docs, FIELDS, measure, keep, column)
