"""Long, repeated and awkward inputs of the older operators, and executors that lack this package."""

import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard, secret_scan
from tests.llm.test_operators import _distance
from tests.llm.texts import PLAIN

KEY = "x9Kf83jLqPz7Wd2RtYb5Vn0aSg"


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.scan_secrets(docs)
    rows = found.select("doc_id", "text", "spans", "n_assign", secret_scan.mask_spans(F.col("text"), F.col("spans"), "[-]").alias("masked"))
    return [r for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def plain_mask(text, spans):
    out, at = "", 0
    for s in spans:
        if s.start >= at:
            out += text[at : s.start] + "[-]"
        at = max(at, s.end)
    return out + text[at:]


def test_a_path_of_many_parts_is_scanned(spark):
    path = "a/" * 100_000
    rows = scanned(spark, [path + KEY, f"{path} {KEY}", path + "readme_2024"])
    assert [len(r.spans) for r in rows] == [1, 1, 0]
    assert rows[1].spans[0].start == len(path) + 1


def test_scan_time_grows_in_proportion(spark):
    draw = random.Random(1)
    run = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1 << 16))
    scanned(spark, [run[:2000]])
    took = []
    for text in (run[: 1 << 14], run[: 1 << 14] + "/x", run, run + "/x"):
        start = time.perf_counter()
        rows = scanned(spark, [text])
        took.append(time.perf_counter() - start)
        assert [(s.start, s.end) for s in rows[0].spans if s.kind == 3] == [(0, len(text))] or "/x" in text
    assert took[3] < 2.5 * took[2] + 2 and took[2] < 8 * took[0] + 2


def test_a_text_with_many_secrets(spark):
    texts = ["é password=abcdefgh12 " * 50_000, ("token: " + "A" * 20 + " ") * 700 + "AKIA" + "B" * 5000 + "\n" + "f" * 9000]
    rows = scanned(spark, texts)
    assert rows[0].n_assign == 50_000
    assert [(s.start, s.end) for s in rows[0].spans if s.kind == 0] == [(2 + 22 * k, 21 + 22 * k) for k in range(50_000)]
    assert [r.masked for r in rows] == [plain_mask(r.text, r.spans) for r in rows]


def test_an_id_with_two_texts_loses_no_link(spark):
    other = " ".join(f"other{i}" for i in range(80))
    near = PLAIN + " one more"
    for rows in ([(7, PLAIN), (7, other), (9, near)], [(7, other), (7, PLAIN), (9, near)], [(7, PLAIN), (7, other), (9, near), (7, PLAIN)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
        assert got == {(7, 7), (9, 7)}


@pytest.mark.parametrize("length", [15, 60, 200, 500, 1000])
def test_recall_by_item_length(spark, length):
    draw = random.Random(length)
    items = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(length))) for i in range(4)]
    docs, allowed = [], int(0.2 * length)
    for k in range(60):
        words = items[k % 4][1].split()
        for _ in range(allowed // 4):
            del words[draw.randrange(len(words))]
            words.insert(draw.randrange(len(words) + 1), "added")
        for at in draw.sample(range(len(words)), allowed - 2 * (allowed // 4)):
            words[at] = "swapped"
        docs.append((k, " ".join([f"f{i}" for i in range(30)] + words + [f"g{i}" for i in range(30)])))
        if k < 4:
            assert _distance(items[k % 4][1].split(), words) <= allowed
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_contamination(frame, benchmark).collect()}
    assert set(got) <= {(k, k % 4) for k in range(60)} and all(e <= allowed for e in got.values())
    need = {k for k in range(60) if _triples_left(items[k % 4][1], docs[k][1], allowed)}
    assert len(got) >= 0.95 * len(need) and len(need) >= 50


def _triples_left(item, text, allowed):
    """Whether some three words of the item in a row are left, without which no window is a candidate."""
    words, held = item.split(), text
    return any(" ".join(words[i : i + 3]) in held for i in range(len(words) - 2))


def test_stretches_are_those_of_a_plain_alignment():
    import numpy as np

    draw = random.Random(5)
    items, texts = [], []
    for _ in range(60):
        items.append(np.array([draw.randrange(1, 5) for _ in range(draw.randint(1, 12))], np.uint64))
        texts.append(np.array([draw.randrange(1, 5) for _ in range(draw.randint(0, 25))], np.uint64))
    allowed = np.array([draw.randint(0, len(x)) for x in items])
    for item, text, most, got in zip(items, texts, allowed, decontaminate.best_stretches(items, texts, allowed), strict=True):
        all_ = [(_distance(item.tolist(), text[a:b].tolist()), a, b) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        least = min(x[0] for x in all_)
        assert (got is None) == (least > most)
        if got:
            assert got[0] == least and got in all_


def test_executors_without_the_package(tmp_path):
    """Functions and models travel as plain code and data: workers cannot import this package here."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tablewright.llm.queries import QUERIES
sys.path.remove({root!r})
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", 4).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op1_langid", "op9_decontaminate", "op10_quality", "op11_divergence", "op12_prefixes", "op13_bpe"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 12


def test_phrases_run_on_over_every_cut(spark):
    """As many as a plain greedy parse has, also in long texts, with unknown letters and in step with no cut."""
    import random

    import numpy as np

    from tablewright.llm import langid

    draw = random.Random(8)
    learned = {"ab": "".join(draw.choice("abc ") for _ in range(400)).strip(), "aa": "aaa", "got": "\U00010330\U00010331\U00010332 \U00010331\U00010330"}
    model = langid.fit_languages(spark.createDataFrame(list(learned.items()), "lang string, text string"))
    texts = ["".join(draw.choice("abcd ") for _ in range(10_000)), "a" * 10_000, "", "xa", "a x b", "\U00010331\U00010332" * 3000]
    texts = [" ".join(t.split()) for t in texts]

    def plain(text, reference):
        count, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in reference:
                n += 1
            count, at = count + 1, at + n
        return count

    symbols = model.symbols[model.letters[[ord(c) for c in "".join(texts)]]]
    lengths = np.array([len(t) for t in texts])
    got = langid.phrases(model, symbols, np.cumsum(lengths) - lengths, lengths)
    squeezed = {k: " ".join(v.split()) for k, v in learned.items()}
    assert got.tolist() == [[plain(t, squeezed[k]) for t in texts] for k in model.labels]
    docs = spark.createDataFrame([("\U00010331\U00010330!",), ("!? ab",), (" ",)], "text string")
    found = langid.identify_languages(docs.coalesce(1), model).collect()
    assert [r.lang_pred for r in found] == ["got", "ab", "und"]


def test_languages_learn_whole_texts_up_to_a_bound(spark):
    from tablewright.llm import langid

    rows = [("ab " * 1500 + "q", "long"), *[(f"{c}z" * 20, "short") for c in "abcdefgh"]]
    model = langid.fit_languages(spark.createDataFrame(rows, "text string, lang string"), texts_per_language=3, chars_per_language=50)
    assert model.symbols[ord("q")] > 0
    # The first of 40 characters leaves room for a second, the third begins beyond the bound.
    assert sum(model.symbols[ord(c)] > 0 for c in "cdefgh") <= 2
