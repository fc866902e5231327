"""Secrets in text: fixed patterns, and strings whose characters look drawn at random.

Built-in functions only. A candidate is a run of key characters with letters and
digits. A window slides over it; counts of the characters in the window and the sum
of n log2 n change by one character in and one out, which gives the Shannon
entropy of every window. A candidate is reported if one window reaches the
threshold of its class of characters, unless a pattern of the allow list fits it.
A window with letters and digits has the class of its own characters, so that a label
before a secret does not raise the threshold; others have that of the candidate. A path
is only allowed if its last part would not be reported alone.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Repeated rows are scanned one by one, an empty table gives an empty one, and an
input column with the name of a new one gives way to it.
"""

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of known kinds, in the order that breaks ties of starts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

_KEY = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_KEY})(?={_KEY}*[0-9])(?={_KEY}*[A-Za-z]){_KEY}{{20,}}"
WINDOW = 20
# Least entropy of a window by class; random hexadecimal windows lie about 3.4, random base-64 ones about 4.1.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("lower", r"^[0-9a-z_-]+$", 3.6), ("mixed", r"^.+$", 3.8))

# The group is possessive: a part of a path can end in one way only, and Java matches such a group in a loop, others by recursion.
_PATH = r"^/?([A-Za-z_-]+/)++[A-Za-z0-9_-]*$"
#: Not reported, whatever their entropy.
ALLOWED = (
    r"(?i)example|placeholder|changeme|your_?(api)?_?key|dummy|sample|x{6,}",
    r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghij",
    _PATH,
)

_FIRST, _LAST = ord("+"), ord("z")
_SPAN = "struct<start:int,kind:int,end:int>"


_TOGETHER = 256


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches with their places, as (start, end, group); leftmost, not overlapping.

    What stands between the matches has the lengths that the starts are sums of. Sums are made in
    blocks and then over blocks, as an array that grows match by match is copied each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"),
        found.alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group"),
    )
    spans_type = "array<struct<start:int,end:int,group:string>>"
    none = F.array().cast(spans_type)

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["match"])
        span = F.struct(start.alias("start"), end.alias("end"), part["group"].alias("group"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def summed(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("spans")), add)

    def shifted(state: Column, block: Column) -> Column:
        spans = F.transform(
            block["spans"],
            lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["group"].alias("group")),
        )
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["blocks"], F.array(spans)).alias("blocks"))

    def placed(all_parts: Column) -> Column:
        last = F.floor((F.size(all_parts) - 1) / _TOGETHER).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_parts, i * _TOGETHER + 1, F.lit(_TOGETHER)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans_type}>").alias("blocks"))
        return F.aggregate(F.transform(cut, summed), first, shifted, lambda state: F.flatten(state["blocks"]))

    # An array of one, so that the matches are found once and not for every block.
    spans = F.get(F.transform(F.array(parts), placed), F.lit(0))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest entropy of a window of ASCII characters from ``+`` to ``z``; texts are at least as long as the window."""
    return _best_window(text, F.lit(0.0), F.lit(False), window)


def window_excess(text: Column, by_window: Column, window: int = WINDOW) -> Column:
    """The most by which a window exceeds the threshold of its class, or where not ``by_window``, of the class of ``text``."""
    return _best_window(text, _threshold(text), by_window, window)


def _chars(fits: str) -> Column:
    """Of each code, whether the character fits."""
    return F.array(*(F.lit(bool(re.search(fits, chr(_FIRST + k)))) for k in range(_LAST - _FIRST + 1)))


def _best_window(text: Column, least: Column, by_window: Column, window: int) -> Column:
    """The most by which the entropy of a window exceeds ``least``, or the threshold of its own class."""
    # n log2 n for all counts that a window can hold
    weight = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))
    coded = F.transform(F.split(text, ""), lambda c: F.ascii(c) - _FIRST)
    cells = F.array_repeat(F.lit(0), _LAST - _FIRST + 1)
    # The last places of a digit, a letter, and of what does not fit each class but the last.
    marks = {"digit": _chars("[0-9]"), "letter": _chars("[A-Za-z]")}
    marks |= {f"not_{name}": F.transform(_chars(pattern), lambda ok: ~ok) for name, pattern, _ in CLASSES[:-1]}

    def cell(counts: Column, code: Column) -> Column:
        return F.get(counts, code)

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            counts = state["counts"]
            new = F.get(codes, i)
            old = F.when(i >= window, F.get(codes, i - window))  # null while the window fills
            # One character out, then one in.
            less = F.when(old.isNull(), counts).otherwise(F.transform(counts, lambda n, k: n - (k == old).cast("int")))
            down = F.when(old.isNull(), F.lit(0.0)).otherwise(
                F.get(weight, cell(counts, old) - 1) - F.get(weight, cell(counts, old))
            )
            up = F.get(weight, cell(less, new) + 1) - F.get(weight, cell(less, new))
            total = state["total"] + down + up
            more = F.transform(less, lambda n, k: n + (k == new).cast("int"))
            last = {m: F.when(F.get(fits, new), i).otherwise(state[m]) for m, fits in marks.items()}
            own = F.lit(CLASSES[-1][2])
            for name, _, lowest in reversed(CLASSES[:-1]):
                own = F.when(last[f"not_{name}"] <= i - window, F.lit(lowest)).otherwise(own)
            mixed = (last["digit"] > i - window) & (last["letter"] > i - window)
            bound = F.when(state["by_window"] & mixed, own).otherwise(state["least"])
            excess = F.lit(math.log2(window)) - total / F.lit(float(window)) - bound
            best = F.when(i >= window - 1, F.greatest(state["best"], excess)).otherwise(state["best"])
            return F.struct(
                more.alias("counts"),
                total.alias("total"),
                *(at.alias(m) for m, at in last.items()),
                state["least"].alias("least"),
                state["by_window"].alias("by_window"),
                best.alias("best"),
            )

        start = F.struct(
            cells.alias("counts"),
            F.lit(0.0).alias("total"),
            *(F.lit(-1).alias(m) for m in marks),
            least.alias("least"),
            by_window.alias("by_window"),
            F.lit(-float(window)).alias("best"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])

    # An array of one, so that the codes are made once and not for every place.
    return F.get(F.transform(F.array(coded), slide), F.lit(0))


def _threshold(text: Column) -> Column:
    out = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        out = F.when(text.rlike(pattern), F.lit(least)).otherwise(out)
    return out


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))
    )


def _written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    each = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def scan_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, column: str = "text") -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (both arrays of start, kind, end)."""
    text = F.coalesce(F.col(column), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 2), lambda m: F.char_length(m["group"]) >= 8)

    def fits(part: Column, patterns: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for pattern in patterns:
            out = out | part.rlike(pattern)
        return out

    def suspicious(m: Column) -> Column:
        value = F.rtrim(m["group"], F.lit("="))  # without labels
        value = F.substring_index(F.substring_index(value, "/", -1), "=", -1)
        known = fits(value, allowed)
        glued = fits(m["group"], tuple(p for p in allowed if p == _PATH)) & value.rlike(f"^{CANDIDATE}$") & ~known
        suppressed = fits(m["group"], tuple(p for p in allowed if p != _PATH))
        suppressed = suppressed | (fits(m["group"], tuple(p for p in allowed if p == _PATH)) & ~glued)
        judged = F.array(F.when(glued, value).otherwise(m["group"]))
        return ~suppressed & F.exists(judged, lambda part: window_excess(part, ~known) >= 0)

    found = docs.withColumns(
        {
            "_assign": _spans(assign, "assign"),
            "_access": _spans(_matches(text, ACCESS), "access"),
            "_hex": _spans(_matches(text, HEX), "hex"),
            "_entropy": _spans(F.filter(_matches(text, CANDIDATE), suspicious), "entropy"),
        }
    )
    base = F.array_sort(F.concat("_assign", "_access", "_hex").cast(f"array<{_SPAN}>"))
    return found.withColumns(
        {
            "n_assign": F.size("_assign").cast("long"),
            "n_access": F.size("_access").cast("long"),
            "n_hex": F.size("_hex").cast("long"),
            "base": base,
            "spans": F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy").cast(f"array<{_SPAN}>")),
        }
    ).drop("_assign", "_access", "_hex", "_entropy")


def span_list(spans: Column) -> Column:
    return _written(spans)


_MASKED = 4096  # characters that are masked together


def mask_spans(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of spans that overlap, replaced by ``mask``. ``spans`` are in order.

    A text is masked in blocks of characters, since a place in a text is found by counting from its beginning.
    """

    def masked(block: Column, number: Column) -> Column:
        low = number * _MASKED
        high = low + F.char_length(block)
        own = F.filter(spans, lambda s: (s["start"] >= low) & (s["start"] < high))
        before = F.filter(spans, lambda s: s["start"] < low)
        begun = F.greatest(F.coalesce(F.array_max(F.transform(before, lambda s: s["end"])), F.lit(0)), low)

        def step(state: Column, span: Column) -> Column:
            apart = span["start"] >= state["at"]
            between = F.when(apart, F.concat(F.substr(block, state["at"] - low + 1, span["start"] - state["at"]), F.lit(mask)))
            return F.struct(
                F.concat(state["out"], F.coalesce(between, F.lit(""))).alias("out"),
                F.greatest(state["at"], span["end"]).alias("at"),
            )

        start = F.struct(F.lit("").alias("out"), begun.alias("at"))
        return F.aggregate(own, start, step, lambda state: F.concat(state["out"], F.substr(block, state["at"] - low + 1)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_MASKED}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(blocks, masked), "")).otherwise(text)
