"""Byte-pair encoding against the tokenizers library, a plain merge loop, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe
from tablewright.llm.queries import op13_bpe, tokenizer_path
from tests.llm.texts import LONG, ODD

PATH = tokenizer_path("byte_bpe_50k.json")
STRANGE = [
    "", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "x" * 3000, "ab" * 900 + " é　z",
    "  hi 's don't 12ab½\r\n\n  ", "\U0001f600" * 40, "a1b2c3 " * 30, "\x00\x01", "é<|endoftext|>é", LONG[:5000], "ß" * 200,
]


def plain_merges(symbols, ranks):
    """The leftmost pair of the lowest rank, again and again."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]


def test_trees_merge_as_the_plain_loop():
    draw = random.Random(3)
    known, merged, ranks = [], [], {}
    for rank in range(40):
        pair = (draw.randrange(4 + rank), draw.randrange(4 + rank))
        known.append(pair)
        merged.append(4 + rank)
        ranks.setdefault(pair, (rank, 4 + rank))
    table = bpe.Merges(np.array(known), np.array(merged))
    for n in (1, 2, 3, 8, 16, 64):
        words = [[draw.randrange(4) for _ in range(draw.randint(n // 2 + 1, n))] for _ in range(60)]
        size = 1 << (max(map(len, words)) - 1).bit_length()
        padded = np.array([w + [-1] * (size - len(w)) for w in words])
        ids, counts = bpe.merge_words(padded, np.array([len(w) for w in words]), table)
        want = [plain_merges(w, ranks) for w in words]
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
        assert [bpe.merge_word(w, table.one) for w in words] == want
    assert bpe.merge_word([], table.one) == []


def test_texts_encode_as_the_library_does(spark):
    draw = random.Random(7)
    signs = "aA1 \n\t'.,<|>endoftext½é　 字\U0001f600̀"
    texts = STRANGE + ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(PATH)
    coded = bpe.encode_texts(docs, PATH)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for row in bpe.decode_ids(coded, PATH).collect():
        assert row.ids == want[row.doc_id]
        assert row.decoded == texts[row.doc_id] == library.decode(row.ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_does(spark):
    draw = random.Random(9)
    lists = [[], [50256], [50257, 5, -1], *([draw.randrange(50257) for _ in range(30)] for _ in range(60))]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "k long, ids array<long>")
    got = {r.k: r.decoded for r in bpe.decode_ids(frame, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert got.pop(-1) == "" and got[2] == library.decode([5], skip_special_tokens=False)
    assert [got[i] for i in range(3, len(lists))] == [library.decode(x, skip_special_tokens=False) for x in lists[3:]]


def test_bpe_odd_rows(odd_docs, no_docs):
    coded = bpe.decode_ids(bpe.encode_texts(odd_docs.withColumn("ids", F.lit("x")), PATH), PATH)
    assert coded.columns == ["doc_id", "text", "score", "digest", "sequence_id", "ids", "decoded"]
    rows = coded.collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for _, t, *_ in ODD)
    assert bpe.decode_ids(bpe.encode_texts(no_docs, PATH), PATH).count() == 0
    assert bpe.encode_texts(odd_docs, PATH, column="score").count() == len(ODD)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.TreeEncoder(tokenizer_path("word_bpe_49k.json"))


def test_query_digests(spark, sf):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
