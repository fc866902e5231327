"""Each operator against a plain version of what it promises, and on odd rows."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.errors import OperationError
from tablewright.llm import (
    components,
    decontaminate,
    jaccard,
    langid,
    packing,
    quality,
    rans,
    repetition,
    secret_scan,
    substring,
    tokens,
    warc,
)
from tablewright.llm.chunks import chunks
from tablewright.llm.queries import tokenizer_path
from tests.llm.texts import LONG, ODD, PLAIN

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 1: languages

SAMPLES = {
    "aa": "banana cabana abacus baobab banal cabal ",
    "bb": "zephyr rhythm pygmy myrrh crypt lynx ",
}


def test_suffix_automaton_reads_exactly_the_substrings():
    text = [random.Random(3).randrange(3) for _ in range(60)]
    steps = langid.suffix_automaton(text)
    found = {()}
    todo = [((), 0)]
    while todo:
        word, state = todo.pop()
        for c, to in steps[state].items():
            found.add((*word, c))
            todo.append(((*word, c), to))
    assert found == {tuple(text[a:b]) for a in range(60) for b in range(a, 61)}


def test_languages(spark, odd_docs, no_docs):
    rows = [(i, SAMPLES[k] * 5, k) for i, k in enumerate(["aa", "bb"] * 3)] + [(9, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(labelled)
    docs = spark.createDataFrame([(1, "Cabana, banana!"), (2, "crypt | lynx"), (3, "12 %"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["aa", "bb", "und", "und"]
    assert got[1].score > 0 and got[3].score == 0
    odd = langid.identify_languages(odd_docs, model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert langid.identify_languages(no_docs, model).count() == 0
    with pytest.raises(OperationError):
        langid.fit_languages(labelled.where("doc_id > 99"))


def test_phrases_are_those_of_a_greedy_parse(spark):
    labelled = spark.createDataFrame([(SAMPLES["aa"], "aa")], "text string, lang string")
    model = langid.fit_languages(labelled)
    text, reference = "abanal cabazephyr", SAMPLES["aa"]
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        count, at = count + 1, at + n
    symbols = model.symbols[model.letters[[ord(c) for c in text]]]
    assert abs(int(langid.phrases(model, symbols, np.array([0]), np.array([len(text)]))[0, 0]) - count) <= 1


def test_languages_learn_from_distinct_whole_texts(spark):
    letters = "bcdfghjklm"
    copies = [(f"{c}a{c} " * 50, "copies") for c in letters for _ in range(50)]
    opening = [("nonono " * 60 + f"{c}o{c} " * 1000, "opening") for c in letters]
    late = [("12 % " * 100 + f"{c}u{c} " * 20, "late") for c in letters]
    labelled = spark.createDataFrame(copies + opening + late, "text string, lang string").repartition(4)
    model = langid.fit_languages(labelled, texts_per_language=10)
    assert sorted(model.labels) == ["copies", "late", "opening"]
    docs = spark.createDataFrame([(f"{c}{v}{c} " * 30, lang) for c in letters for v, lang in (("a", "copies"), ("o", "opening"), ("u", "late"))], "text string, want string")
    got = langid.identify_languages(docs, model).collect()
    assert [r.lang_pred for r in got] == [r.want for r in got]


# --- 2: packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_constraint(rule):
    draw = random.Random(1)
    lengths = Counter(draw.choice([1, 2, 3, 7, 20, 33, 50, 64, 99, 100]) for _ in range(3000))
    runs = packing.pack_counts(lengths, 100, 12, 6000 + 4000, rule)
    bins: dict[int, list] = {}
    seen: Counter = Counter()
    for length, _, each, sequences, first, offset in runs.tolist():
        seen[length] += each * sequences
        for s in range(first, first + sequences):
            bins.setdefault(s, []).extend((offset + k * length, length) for k in range(each))
    assert seen == lengths
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 100 and len(held) <= 12 and sum(n * n for _, n in held) <= 10_000


def test_packing_odd_rows(odd_docs, no_docs):
    path = tokenizer_path("word_bpe_49k.json")
    pieces = packing.tokenized_pieces(odd_docs, path, 1, 256, with_ids=True)
    rows = packing.pack(pieces, 256).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in ODD)
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= math.ceil(total / 256) + 1
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
    assert packing.pack(packing.tokenized_pieces(no_docs, path, 1, 256), 256).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_have_the_ids_of_whole_texts(name):
    draw = random.Random(2)
    signs = ["a", "Be", " ", "  ", "\n", "\t", "́", "é", "İ", "Σ", "'s", "'", "12", "<|endoftext|>", ".", ",", "中", "　", "\r\n", "\x85", "_", "\U0001f600", "ñ", "×", "#", "|", "<", "(", "-"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    encoder = tokens.Encoder(tokenizer_path(name))
    for chunk in chunks([batch], limit=1 << 14):
        ids, at = encoder.encode(chunk.data, chunk.offsets)
        for i, text in enumerate(chunk.rows.column("text").to_pylist()):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder.shrink(10)
    assert len(encoder.place) == 10


# --- 3: similar documents


def _shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def _groups(sets: dict[int, frozenset], per_cent: int) -> dict[int, int]:
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("per_cent", [75, 50])
def test_jaccard_against_all_pairs(small, per_cent):
    texts = {r.doc_id: r.text for r in small.collect()}
    sets = {d: _shingles(t) for d, t in texts.items()}
    want = _groups(sets, per_cent)
    got = jaccard.jaccard_components(small, per_cent=per_cent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in texts}


def test_similar_sets_share_a_signature():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.choice([3, 20, 30, 47, 48, 96, 150, 400])
        one = [f"w{draw.randrange(10**6)}" for _ in range(n + 4)]
        two = list(one)
        for _ in range(draw.randint(0, max(1, n // 30))):
            two[draw.randrange(len(two))] = "changed"
        two += [f"v{i}" for i in range(draw.randint(0, n // 8))]
        a, b = _shingles(" ".join(one)), _shingles(" ".join(two))
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        batch = pa.RecordBatch.from_pydict({"text": [" ".join(one), " ".join(two)]})
        (chunk,) = chunks([batch])
        value, rows, _ = jaccard.signatures(jaccard.Shingles(chunk, 5), 75)
        assert set(value[rows == 0].tolist()) & set(value[rows == 1].tolist())


def test_jaccard_odd_rows(odd_docs, no_docs):
    rows = jaccard.jaccard_components(odd_docs).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    n = len(_shingles(PLAIN))
    assert got[:5] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5)]
    assert got[6:10] == [(7, n, 7), (7, n, 7), (7, n + 3, 7), (8, n, 7)]
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None and r.n_shingles) == [(n, 7)]
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for pair in links for x in pair}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert dict(map(tuple, got)) == want and len(got) == len(want)


# --- 4: repetition


def _repeats(words: list[str]) -> list[int]:
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def test_repetition_against_comparing_all_places(spark):
    draw = random.Random(7)
    texts = [" ".join(draw.choices(["a", "b", "cé", "d"], k=draw.randint(0, 70))) for _ in range(60)]
    texts += ["of " * 200, "x\n\ny\nx\n\n y \n#*|<>", PLAIN, " ".join([PLAIN, PLAIN]), "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r for r in repetition.judge_repetition(docs).collect()}
    for i, text in enumerate(texts):
        words, r = WORD.findall(text), got[i]
        longest = _repeats(words)
        three = {p for k, n in enumerate(longest) if n >= 3 for p in range(k, k + 3)}
        span = {p for k, n in enumerate(longest) if n >= 8 for p in range(k, k + n)}
        lines, seen, twice = text.split("\n"), set(), 0
        for line in lines:
            twice += bool(WORD.search(line)) and line in seen
            seen.add(line)
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text)), twice)
        assert (r.n_repeat_words, r.repeat_words) == (len(three), len(span))
        assert r.longest_repeat == max([n for n in longest if n >= 8], default=0)
        base = len(words) < 50 or 100 * len(three) > 50 * len(words)
        assert r.base_failed == base
        assert r.kept == (not base and len(span) <= 0.3 * len(words) and r.longest_repeat <= 100)


def test_repetition_odd_rows(odd_docs, no_docs):
    rows = repetition.judge_repetition(odd_docs).collect()
    assert len(rows) == len(ODD) and {r.kept for r in rows if r.n_words < 50} == {False}
    assert [r.kept for r in rows if r.doc_id == 8] == [True] and [r.kept for r in rows if r.doc_id == 6] == [True]
    assert repetition.judge_repetition(no_docs).count() == 0


# --- 5: substrings


def _kept(texts: list[tuple[int, str]], window: int = 13) -> list[tuple]:
    split = [(d, (t or "").encode().split()) for d, t in texts]
    first: dict[tuple, int] = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, words in split:
        gone = {p for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < d for p in range(i, i + window)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("words", "rows"), [(20_000, 100_000), (60, 15)])
def test_substrings_against_all_windows(small, monkeypatch, words, rows):
    """Small shards make anchors with many contexts go on as single windows, and shards hand on what they hold."""
    monkeypatch.setattr(substring, "SHARD_WORDS", words)
    monkeypatch.setattr(substring, "SHARD_ROWS", rows)
    got = substring.deduplicate_substrings(small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == _kept([tuple(r) for r in small.collect()])


def test_substrings_odd_rows(odd_docs, no_docs):
    rows = substring.deduplicate_substrings(odd_docs).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.doc_id is not None)
    assert got == _kept([(r[0], r[1]) for r in ODD if r[0] is not None])
    assert sorted((r.n_words, r.n_removed) for r in rows if r.doc_id is None) == [(0, 0), (120, 0)]
    assert substring.deduplicate_substrings(no_docs).count() == 0


def test_substrings_of_repeated_rows_that_lose_words(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    first, other = f"x1 x2 x3 {one}", " ".join([*two.split()[:30], *(f"y{i}" for i in range(60))])
    rows = [(1, f"{one} {two}"), (7, first), (7, first), (7, first.replace(" ", "  ")), (7, other), (7, other), (8, first), (9, f"{one} z1 z2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.deduplicate_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = _kept(rows)
    assert sorted(map(tuple, got)) == want and [r[2] for r in want] == [0, 40, 40, 40, 30, 30, 43, 40]


def test_automaton_knows_the_smallest_holder():
    draw = random.Random(8)
    texts = [(d, draw.choices(range(3), k=30)) for d in (5, 3, 9, 4)]
    automaton = substring.Automaton()
    for d, words in texts:
        automaton.add(words, d)
    automaton.finish()
    stream = draw.choices(range(3), k=200)
    want = [
        min([d for d, words in texts for k in range(26) if words[k : k + 5] == stream[i : i + 5]], default=1 << 62)
        for i in range(len(stream) - 4)
    ]
    assert automaton.first_holders(stream, 5) == want


# --- 6: secrets


def test_secrets(spark, odd_docs, no_docs):
    key = "Zq8RkT3vLx9WmB2nYc7HpD5s"
    texts = [
        f"é Password: '{'a' * 8}' token=secret=abcdefgh token:token:abcdefgh1 api-key = x",
        "AKIA" + "A" * 12 + " AKIA" + "A" * 11 + " " + "0123456789abcdef" * 2 + " " + "f" * 31,
        f"use {key} or example{key} or 123e4567-e89b-12d3-a456-426614174000 or {'ab12' * 8}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    patterns = [re.compile(secret_scan.ASSIGN), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    for i, text in enumerate(texts):
        want = []
        for kind, p in enumerate(patterns):
            for m in p.finditer(text):
                if len(m[2] if kind == 0 else m[0]) >= (8, 16, 32)[kind]:
                    want.append((m.start(), kind, m.end()))
        assert [tuple(s) for s in got[i].base] == sorted(want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
    added = [texts[2][s.start : s.end] for s in got[2].spans if s.kind == 3]
    assert added == [key]
    masked = secret_scan.scan_secrets(docs).select("doc_id", secret_scan.mask_spans(docs["text"], secret_scan.F.col("spans"), "[-]").alias("m"))
    assert masked.where("doc_id = 2").first().m == texts[2].replace(f"use {key}", "use [-]").replace("ab12" * 8, "[-]")
    assert secret_scan.scan_secrets(odd_docs).count() == len(ODD)
    assert secret_scan.scan_secrets(no_docs).count() == 0


def test_labels_do_not_hide_secrets(spark):
    draw = random.Random(12)
    digits = "0123456789"
    texts = []
    for label in ("", "sig=", "auth/", "id_", "v-", "a/b=", "X-Sig="):
        for signs, n in [("0123456789abcdef", 24), ("0123456789ABCDEF", 24), ("0123456789abcdef", 40), ("0123456789ABCDEF", 64)]:
            texts += [f"see {label}{''.join(draw.choices(signs, k=n))} there" for _ in range(25)]
    other = [f"id={uuid.UUID(int=draw.getrandbits(128))} users/{uuid.UUID(int=draw.getrandbits(128))}" for _ in range(100)]
    other += [f"order={''.join(draw.choices(digits, k=30))} id_{''.join(draw.choices(digits, k=20))}" for _ in range(100)]
    other += ["docs/parts/page_page_page_page_2 example/0f1e2d3c4b5a69788796a5b4"]
    docs = spark.createDataFrame(list(enumerate(texts + other)), "i int, text string")
    got = {r.i: [r.text[s.start : s.end] for s in r.spans if s.kind == 3] for r in secret_scan.scan_secrets(docs).collect()}
    found = [got[i] == [text.split()[1]] for i, text in enumerate(texts)]
    assert all(np.mean(found[i : i + 100]) >= 0.97 for i in range(0, len(texts), 100))
    for i, text in enumerate(other):  # labels of what is allowed or has digits only change nothing
        windows = [Counter(text.split()[0][k : k + 20]).values() for k in range(len(text.split()[0]) - 19)]
        high = i < 100 and max(-sum(n / 20 * math.log2(n / 20) for n in w) for w in windows) >= 3.8
        assert got[len(texts) + i] == ([text.split()[0]] if high else [])


def test_windows_are_judged_by_their_own_class(spark):
    draw = random.Random(13)
    texts = ["".join(draw.choices(draw.choice(["0123456789abcdefABCDEF", "0123456789", "abc-_019xyz", "aBcXYZ019+/=_-"]), k=draw.randint(5, 25))) for _ in range(120)]
    texts = [a + b for a, b in zip(texts, texts[1:] + ["0a" * 10], strict=True) if len(a + b) >= 20]

    def least(part: str) -> float:
        return next(low for _, pattern, low in secret_scan.CLASSES if re.search(pattern, part))

    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    one, two = (secret_scan.window_excess(docs["t"], secret_scan.F.lit(flag)) for flag in (True, False))
    for row in docs.select("t", one.alias("one"), two.alias("two")).collect():
        windows = [row.t[i : i + 20] for i in range(len(row.t) - 19)]
        bits = [-sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) for w in windows]
        own = [least(w if re.search("[0-9]", w) and re.search("[A-Za-z]", w) else row.t) for w in windows]
        assert math.isclose(row.one, max(b - o for b, o in zip(bits, own, strict=True)), abs_tol=1e-9)
        assert math.isclose(row.two, max(bits) - least(row.t), abs_tol=1e-9)


def test_window_entropy(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choices("abcXYZ019+/=_-", k=draw.randint(20, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in docs.select("t", secret_scan.window_entropy(docs["t"]).alias("h")).collect():
        windows = [Counter(row.t[i : i + 20]).values() for i in range(len(row.t) - 19)]
        assert math.isclose(row.h, max(-sum(n / 20 * math.log2(n / 20) for n in w) for w in windows), abs_tol=1e-9)


# --- 7: archives


def test_archives_round_trip(spark):
    big = "x" * 1000
    rows = [(1, "u1", big), (2, None, big), (3, "a\nb", "é"), (4, "u", None), (5, "u", "é"), (6, "u", big), (6, "u", big), (None, "u", big), (7, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_warc(pages, archive_bytes=200)
    got = Counter(tuple(r)[:1] + tuple(r)[2:] for r in warc.read_warc(archives).collect())
    want: Counter = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 6
        want[page, "revisit" if again else "response", 6 if again else None, len(data), hashlib.sha1(data).hexdigest()] += 1
    assert got == want
    assert warc.read_warc(warc.write_warc(pages.where("page_id = 99"))).count() == 0


def test_damaged_archives_are_found():
    good = warc.record(1, "u", b"payload" * 50, None, "1970-01-01T00:00:00Z")
    assert [r["page_id"] for r in warc.records(good + good)] == [1, 1]
    for bad in (good[:-3], good[:40], good + good[:20]):
        with pytest.raises(warc.WarcError):
            list(warc.records(bad))
    plain = zlib.decompress(good, 31)
    for a, b in ((b"payloadpay", b"paYloadpay"), (b"Content-Length: 435", b"Content-Length: 434")):
        assert a in plain or a.startswith(b"Content")
        if a in plain:
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            with pytest.raises(warc.WarcError):
                list(warc.records(deflate.compress(plain.replace(a, b, 1)) + deflate.flush()))


# --- 8: token files


def test_blocks_round_trip():
    draw = np.random.default_rng(1)
    for n in (1, 5, rans.LANES, rans.LANES + 1, 100_000):
        ids = np.minimum(draw.geometric(0.01, n), 5000).astype(np.uint32)
        counts = np.bincount(ids, minlength=6000)
        table = rans.Table(rans.scaled(counts))
        assert table.frequency.sum() == 1 << rans.SCALE_BITS and ((table.frequency > 0) == (counts > 0)).all()
        block = rans.encode_block(ids, table)
        assert (rans.decode_block(block, n, table) == ids).all()
    many = rans.scaled(np.ones(900_000, np.int64) + np.arange(900_000) * 1000)
    assert many.sum() == 1 << rans.SCALE_BITS and many.min() == 1


def test_damaged_files_are_found():
    ids = np.arange(300, dtype=np.uint32) % 7
    table = rans.Table(rans.scaled(np.bincount(ids)))
    content = rans.encode_file(np.array([4, 5]), np.array([0, 1]), np.array([100, 200]), ids, table)
    _, _, _, blocks = rans.decode_file(content, table)
    assert (np.concatenate(list(blocks)) == ids).all()
    for at in (20, 60, len(content) - 3):
        bad = bytearray(content)
        bad[at] ^= 1
        with pytest.raises(ValueError):  # noqa: PT011
            list(rans.decode_file(bytes(bad), table)[3])


def test_token_files_odd_rows(odd_docs, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    files, table = rans.write_archive(odd_docs, path, 2, 50257, docs_per_range=2)
    rows = rans.read_archive(files, table, 50257).collect()
    plain = tokens.Encoder(path).tokenizer
    want = [(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ODD]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4"))) for d, x in want)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    files, table = rans.write_archive(no_docs, path, 2, 50257)
    assert rans.read_archive(files, table, 50257).count() == 0


# --- 9: benchmark passages


def test_decontamination_finds_edited_items(spark, odd_docs, no_docs):
    draw = random.Random(10)
    items = [(i, " ".join(f"{draw.choice('abcd')}{draw.randrange(300)}" for _ in range(draw.randint(15, 60)))) for i in range(30)]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (None, "a b c"), (92, "Exactly this")], "item_id long, text string")
    docs, want = [], set()
    for k in range(300):
        item, text = draw.choice(items)
        words = text.split()
        for _ in range(draw.randint(0, len(words) // 6)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 1)] = draw.choice([[], ["new"], ["New", "words"]])[:1]
        before = [f"f{draw.randrange(900)}" for _ in range(draw.randint(0, 50))]
        docs.append((k, " ".join(before + words + before[:9])))
        if _distance(text.split(), [w.lower() for w in words]) <= int(0.2 * len(text.split())):
            want.add((k, item))
    docs += [(1000 + k, " ".join(f"f{draw.randrange(900)}" for _ in range(200))) for k in range(50)]
    docs += [(2000, "is it EXACTLY\n this?"), (2001, "or exactly this then")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame, benchmark).collect()}
    assert len(got & want) >= 0.95 * len(want) and (2001, 92) in got
    assert all(d < 300 or d == 2001 for d, _ in got)
    blocks = decontaminate.find_contamination(frame, benchmark, block_bytes=1500).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == got
    left = decontaminate.drop_contaminated(frame, benchmark)
    assert left.columns == ["doc_id", "text"] and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_contamination(odd_docs, benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, benchmark).count() == len(ODD)
    assert decontaminate.find_contamination(no_docs, benchmark).count() == 0
    assert decontaminate.find_contamination(frame, benchmark.where("item_id = -1")).count() == 0


def _distance(one: list[str], two: list[str]) -> int:
    cost = list(range(len(two) + 1))
    for i, a in enumerate(one, 1):
        last, cost[0] = cost[0], i
        for j, b in enumerate(two, 1):
            last, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, last + (a != b))
    return cost[-1]


# --- 10: quality


def test_quality_on_held_out_rows(spark, sf, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 3 <> 0"))
    scored = quality.score_quality(docs, model, keep=["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in scored]) >= 0.95
    odd = quality.score_quality(odd_docs, model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if not r.text}) == 1
    assert quality.score_quality(no_docs, model).count() == 0
    with pytest.raises(OperationError):
        quality.fit_quality(docs, labels.where("quality = 1"))


def test_long_text_is_read_whole(odd_docs):
    row = repetition.judge_repetition(odd_docs).where("doc_id = 6").first()
    assert row.n_words == len(LONG.split())
