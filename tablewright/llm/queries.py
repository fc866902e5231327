"""The registered queries of this package: each applies its operator to the whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, divergence, jaccard, langid, packing, prefix_trie, quality, rans, repetition, secret_scan, substring, warc
from tablewright.llm.chunks import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(F.coalesce(_fold(4) != 2, F.lit(True))))
    found = langid.identify_languages(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1, 4096)
    return packing.pack(pieces, max_tokens=4096)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files, table = rans.write_archive(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, vocabulary=50257)
    return rans.read_archive(files, table, vocabulary=50257)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs.select("doc_id", "text"), items)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels").where(_fold(5) != 0))
    scored = quality.score_quality(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(*prefix_trie.spliced(turns))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    ids = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode_ids(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_langid, op2_pack, op3_jaccard, op4_repetition, op5_substrings, op6_secrets, op7_warc, op8_rans, op9_decontaminate, op10_quality, op11_divergence, op12_prefixes, op13_bpe)
}
_PREFIXES_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal digits, bit by bit
c AS (
  SELECT conv_id, count(*) AS own, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, least(h, coalesce((SELECT b.own FROM c b WHERE b.conv_id = c.conv_id - c.conv_id % 5), 0)) + t.i - h, role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
k AS (
  SELECT conv_id, 0 AS d, '' AS node, '' AS above, 0 AS bytes FROM c
  UNION ALL
  SELECT conv_id, d, string_agg(m, '') OVER w, coalesce(string_agg(m, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), bytes
  FROM (SELECT conv_id, d, md5(md5(role) || text) AS m, strlen(text) AS bytes FROM r) WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM k),
n AS (
  SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM e GROUP BY node, d),
f AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.above = n.node AND m.d = n.d + 1) AS n_children FROM n),
-- the nodes above each node, itself included, are those of its smallest member
s AS (
  SELECT k.node, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM f JOIN k ON k.conv_id = f.conv_id AND k.d <= f.d GROUP BY k.node)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.node LEFT JOIN n p ON f.d > 0 AND p.node = f.above AND p.d = f.d - 1
"""
_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL) USING (lang, source)),
l AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(l.total) + any_value(v.v)) AS q
  FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
t AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
s AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
r AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM s
  UNION ALL
  SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM t)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: list_slice(w, i, i + 4))) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, md5_number(array_to_string(shingle, ' ')) AS shingle FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM h a JOIN h b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""
_SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 12 <= len(w) THEN md5_number(array_to_string(list_slice(w, i, i + 12), ' ')) END AS passage
  FROM o),
f AS (SELECT passage, min(doc_id) AS first FROM t WHERE passage IS NOT NULL GROUP BY passage),
c AS (
  SELECT doc_id, i, word, coalesce(max(first < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS 12 PRECEDING), false) AS gone
  FROM t LEFT JOIN f USING (passage)),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
ORACLE_SQL: dict[str, str] = {"op3_jaccard": _JACCARD_SQL, "op5_substrings": _SUBSTRINGS_SQL, "op7_warc": _WARC_SQL, "op11_divergence": _DIVERGENCE_SQL, "op12_prefixes": _PREFIXES_SQL}
