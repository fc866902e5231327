"""Source divergence against plain counting, its SQL, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from suite.check import connect, difference
from tablewright.llm import divergence
from tablewright.llm.queries import ORACLE_SQL, op11_divergence
from tests.llm.texts import LONG, ODD, corpus

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, ranks=200):
    """(text, lang, source) rows -> the result, by counting."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [TERM.findall(t.translate(LOWER)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        here = [(t, r[2]) for t, r in zip(terms, rows, strict=True) if r[1] == lang]
        held = Counter(w for t, _ in here for w in set(t))
        kept = sorted((w for w, n in held.items() if n >= 3), key=str.encode)
        counts = {s: Counter() for _, s in here}
        for t, s in here:
            counts[s].update(w for w in t if held[w] >= 3)
        whole = sum(counts.values(), Counter())

        def shares(count, kept=kept):
            n = sum(count.values())
            return [1 + 10**9 * (count[w] + 1) // (n + len(kept)) for w in kept]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in counts if o != s]
            found = [(w, (a - b) ** 2 // b) for w, a, b in zip(kept, p[s], q, strict=True) if counts[s][w] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, w, v, i + 1) for i, (w, v) in enumerate(items)]
    return sorted(out)


def result(frame, **how):
    return sorted(tuple(r) for r in divergence.source_divergence(frame, **how).collect())


def corpus_rows():
    draw = random.Random(2)
    odd = ["Éá été ÉTÉ", "a_b-c`d", "字字 字", "x" * 90 + " " + "y" * 64, "A b İi ſ"]
    rows = [(draw.choice([t, t.upper(), t + " " + draw.choice(odd)]), draw.choice(["en", "de", None]), draw.choice("abcd")) for t in corpus().values()]
    return rows + [(None, "en", "silent"), ("", "xx", "one"), ("only one", "xx", "two"), ("same same", "yy", None), ("same", "yy", ""), ("same", "yy", "z")]


@pytest.mark.parametrize("hot, shard", [(1 << 16, 1 << 16), (0, 7), (40, 20)])
def test_divergence_equals_plain_counting(spark, hot, shard):
    rows = corpus_rows()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert result(frame, hot_terms=hot, shard_terms=shard) == plain(rows)


def test_small_holds_and_few_ranks(spark, monkeypatch):
    for name, value in (("_HELD", 50), ("_CHUNK", 400), ("_PAIRS", 9)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus_rows()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert result(frame, hot_terms=100, ranks=4) == plain(rows, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    named = odd_docs.withColumns({"lang": F.col("score"), "source": F.col("digest"), "term": F.lit(1), "ordinal": F.lit("n")})
    assert result(named) == plain([(t, a, b) for _, t, a, b, _ in ODD])
    assert result(named.limit(0)) == []
    repeated = spark.createDataFrame([("w " + LONG[:50], "l", s) for s in "aabb"], "text string, lang string, source string")
    assert result(repeated) == plain([("w " + LONG[:50], "l", s) for s in "aabb"])


def test_transducer_numbers_exactly_the_terms():
    draw = random.Random(6)
    terms = {}
    for lang in ("a", "b"):
        held = {bytes(draw.choices(b"ab\xc3\xa9", k=draw.randint(1, 7))) for _ in range(200)}
        terms[lang] = sorted(held)
    rows = [(lang, t, 1000 * (lang == "b") + i) for lang in terms for i, t in enumerate(terms[lang])]
    draw.shuffle(rows)
    tool = divergence.transducer(rows)
    queries = [(lang, q) for lang in ("a", "b", "c") for q in {*terms["a"], *terms["b"], b"a" * 9, b"zz"}]
    data = np.frombuffer(b"".join(q for _, q in queries), np.uint8)
    cuts = np.cumsum([0, *(len(q) for _, q in queries)])
    names = ["a", "b", "c"]
    found = tool.read(data, cuts, np.array([names.index(lang) for lang, _ in queries]), names).tolist()
    want = {(lang, t): i for lang, t, i in rows}
    assert found == [want.get(q, -1) for q in queries]


def test_transducer_is_minimal():
    terms = sorted({a + b for a in (b"x", b"yy", b"z") for b in (b"", b"ing", b"ed", b"s")})
    tool = divergence.transducer([("l", t, i) for i, t in enumerate(terms)])
    behind = {}  # states are the distinct sets of what may still follow
    for t in terms:
        for k in range(len(t) + 1):
            behind[t[:k]] = frozenset(u[k:] for u in terms if u.startswith(t[:k]))
    assert len(tool.final) == len(set(behind.values()))


def test_no_terms_at_all():
    tool = divergence.transducer([])
    assert tool.read(np.frombuffer(b"ab", np.uint8), np.array([0, 1, 2]), np.array([0, 0]), ["l"]).tolist() == [-1, -1]


def test_shares_are_exact_for_large_counts(spark):
    n = 8_999_999_999
    for count in (n, n + 1, 10**15):
        got = spark.range(1).selectExpr(f"CAST({count} AS LONG) AS n", "CAST(4000000000000000 AS LONG) AS t", "CAST(77 AS LONG) AS v")
        got = got.selectExpr(divergence._share("n", "t", "v") + " AS p").first().p
        assert got == 1 + 10**9 * (count + 1) // (4 * 10**15 + 77)


def test_query_agrees_with_its_sql(spark, sf):
    assert difference(op11_divergence(spark, sf), connect(sf), ORACLE_SQL["op11_divergence"]) is None


def test_counts_travel_packed_and_come_back_whole():
    draw = np.random.default_rng(3)
    both = np.unique(draw.integers(0, 4 * 9_000, 20_000))
    n, seen = draw.integers(1, 99, len(both)), {("l", "a"): 0, ("l", "b"): 1, ("m", "a"): 2, ("", ""): 3}
    batches = list(divergence._packed(both, n, 9_000, 7, seen))
    assert sum(b.num_rows for b in batches) <= 4 * 7 + len(both) // divergence._PACK  # far fewer rows than counts
    got = {}
    for batch in batches:
        row, ordinal, count = divergence._unpacked(batch["packed"])
        place = batch["place"].to_numpy()[row]
        assert (place == ordinal % 7).all()
        group = divergence._coded_batch(batch, dict(seen))[row]
        got |= dict(zip((group * 9_000 + ordinal).tolist(), count.tolist(), strict=True))
    assert got == dict(zip(both.tolist(), n.tolist(), strict=True))
    assert list(divergence._packed(both[:0], n[:0], 9_000, 7, seen)) == []


def test_counts_of_other_terms_travel_packed_too(monkeypatch):
    monkeypatch.setattr(divergence, "_PACK_BYTES", 2_000)
    draw, seen = random.Random(5), {("l", "a"): 0, ("l", "b"): 1, ("m", "a"): 2}
    terms = [*{"".join(draw.choices("abé", k=draw.randint(1, 9))).encode() for _ in range(4_000)}, b"x" * 5_000, b"y" * 5_000]
    want = {(g, t): draw.randint(1, 99) for t in terms for g in range(3) if draw.random() < 0.7}
    held = divergence._Held()
    for part in (list(want), list(want)[:500]):
        held.add(np.array([g for g, _ in part]), pa.array([t for _, t in part], pa.large_binary()), np.array([want[k] for k in part]))
    batches = list(divergence._packed_terms(held.summed(), 7, seen))
    assert sum(b.num_rows for b in batches) < len(want) / 20  # far fewer rows than counts
    got, shard = {}, {}
    for batch in batches:
        row, length, n = divergence._unpacked(batch["packed"])
        data = b"".join(batch["terms"].to_pylist())
        ends = np.cumsum(length).tolist()
        for r, a, b, m in zip(row.tolist(), [0, *ends], ends, n.tolist(), strict=False):
            key = divergence._coded_batch(batch, dict(seen))[r], data[a:b]
            assert key not in got
            got[key] = m
            assert shard.setdefault((batch["lang"][r].as_py(), data[a:b]), batch["place"][r].as_py()) == batch["place"][r].as_py()
    first = set(list(want)[:500])
    assert got == {k: n * (1 + (k in first)) for k, n in want.items()}
    for lang in "lm":  # kept terms are sent to the same shards
        own = [t for x, t in shard if x == lang]
        place = divergence._places(pa.array([t.decode() for t in own]), np.zeros(len(own), int), [lang], 7)
        assert place.tolist() == [shard[lang, t] for t in own] and set(place.tolist()) == set(range(7))


def test_packed_rows_of_many_groups_travel_as_few(monkeypatch):
    seen = {("l", f"s{i}"): i for i in range(80)}
    both = np.arange(0, 80 * 9_000, 9)
    rows = pa.Table.from_batches(divergence._packed(both, both + 1, 9_000, 50, seen))
    for size in (divergence._BUNDLE_BYTES, 700):
        monkeypatch.setattr(divergence, "_BUNDLE_BYTES", size)
        made = pa.Table.from_batches(divergence._bundled(rows.to_batches(max_chunksize=333), 1)).combine_chunks()
        assert size == 700 or made.num_rows <= 50 + rows["packed"].nbytes // size < rows.num_rows / 20
        back = pa.Table.from_batches(divergence._unbundled(made["bundle"].chunk(0)))
        pick = ["lang", "source", "packed"]
        assert sorted(map(str, back.select(pick).to_pylist())) == sorted(map(str, rows.select(pick).to_pylist()))
        for batch in made.slice(0, 60).to_batches():
            for bundle, shard in zip(batch["bundle"], batch["shard"].to_pylist(), strict=True):
                for part in divergence._unbundled(pa.array([bundle.as_py()], pa.binary())):
                    assert set((divergence._unpacked(part["packed"])[1] % 50).tolist()) == {shard}
    assert list(divergence._bundled([], 1)) == []


def test_recount_gives_each_count_once_with_that_of_its_language(spark, monkeypatch):
    for name, value in (("_HELD", 50), ("_CHUNK", 400), ("_PACK", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(t or "", lang or "", source or "") for t, lang, source in corpus_rows()]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    kept = divergence.numbered_terms(divergence.document_frequencies(frame), 3)
    known = {(r.lang, r.term): r.ordinal for r in kept.collect()}
    want, whole = Counter(), Counter()
    for text, lang, source in rows:
        for term in TERM.findall(text.translate(LOWER)):
            if (lang, term) in known:
                want[lang, source, known[lang, term]] += 1
                whole[known[lang, term]] += 1
    for hot in (0, 40, 1 << 16):
        got = [tuple(r) for r in divergence.recount(frame, kept, hot, 20).select("lang", "source", "ordinal", "n", "lang_n").collect()]
        assert sorted(got) == sorted((*key, n, whole[key[2]]) for key, n in want.items())
