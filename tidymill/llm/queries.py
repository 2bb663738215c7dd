"""The registered queries of this subpackage and, where SQL can say it, the same question for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymill.llm.codes import vector_codes
from tidymill.llm.common import read
from tidymill.llm.exact import exact_duplicates
from tidymill.llm.lines import shared_lines
from tidymill.llm.mixing import mix_sources
from tidymill.llm.near import near_duplicates
from tidymill.llm.packing import byte_bpe, packed_pieces
from tidymill.llm.pieces import Pieces, decode_pieces, encode_pieces, load_pieces
from tidymill.llm.quality import Model, score_quality, train_quality
from tidymill.llm.suffixes import repeated_bytes
from tidymill.llm.tries import conversation_trie, rebuilt_turns
from tidymill.llm.vectors import near_vectors
from tidymill.llm.windows import repeated_windows
from tidymill.llm.secret_scan import find_secrets, train_markov

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), keep="max", fold_case=True)


ORACLES["op10_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {FOLDED} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("kept")).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id < f.keep_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL OR k.doc_id = f.keep_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_secrets(docs, train_markov(docs))

    def kind(name: str) -> Column:
        return F.filter("spans", lambda x: x["kind"] == name)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *(F.size(kind(name)).cast("bigint").alias(f"n_{name}") for name in ("assign", "access", "hex")),
        sha256_of(listed(F.filter("spans", lambda x: x["kind"] != "random"))).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def vocabulary():
    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"), vocabulary)


HELD_OUT = "crc32(cast(doc_id AS string)) % 3 = 1"


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.filter(f"NOT {HELD_OUT}").select("doc_id", F.col("quality").alias("label"))
    return train_quality(docs, known)


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_windows(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept")).alias("kept_sha256"))


def merge_pieces() -> Pieces:
    return load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_pieces(encode_pieces(read(spark, sf_dir, "documents"), merge_pieces), merge_pieces)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", sha256_of(F.col("text")).alias("decoded_sha256"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256_of(F.col("kept")).alias("kept_sha256"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(*rebuilt_turns(read(spark, sf_dir, "conversations")))


# CRC-32 by its bitwise rule over the bytes of a decimal number
CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
ORACLES["op11_conversation_trie"] = f"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS founder, {CRC} % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, t.place, digest, words FROM c JOIN t ON t.conv_id = c.founder AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, digest, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
s AS (SELECT conv_id, words, string_agg(digest, '') OVER w AS path, row_number() OVER w AS depth FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, path, depth, words FROM s UNION ALL SELECT conv_id, '', 0, 0 FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT path, any_value(depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS cost,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM m JOIN e ON m.conv_id = e.conv_id GROUP BY path),
k AS (SELECT left(path, 32 * (depth - 1)) AS above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.above),
x AS (SELECT left(path, 32 * up) AS top, sum(cost) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM a) GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, x.n_leaves,
  x.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN x ON a.path = x.top LEFT JOIN n p ON a.depth > 0 AND p.path = left(a.path, 32 * (a.depth - 1))
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _nearest(book: str) -> str:
    return f"""(SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
      SELECT vec_id, v.part, entry, sum((x - y) * (x - y)) AS d FROM v JOIN {book} b ON v.part = b.part AND v.place = b.place
      GROUP BY ALL) GROUP BY ALL)"""


def _moved(book: str) -> str:
    return f"""SELECT b.part, b.entry, b.place, coalesce(floor(u.total / u.n)::BIGINT, b.y) AS y FROM {book} b LEFT JOIN (
      SELECT v.part, entry, place, sum(x) AS total, count(*) AS n FROM v JOIN {_nearest(book)} f
      ON v.vec_id = f.vec_id AND v.part = f.part GROUP BY ALL) u
      ON b.part = u.part AND b.entry = u.entry AND b.place = u.place"""


ORACLES["op12_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS MATERIALIZED (SELECT vec_id, len(embedding) // 16 AS width, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) - 1 AS i FROM k),
v AS MATERIALIZED (SELECT vec_id, i // width AS part, i % width AS place, floor(256 * c)::BIGINT AS x FROM f),
b0 AS MATERIALIZED (SELECT part, entry, place, x AS y FROM v JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64) s ON v.vec_id = s.vec_id),
b1 AS MATERIALIZED ({_moved("b0")}),
b2 AS MATERIALIZED ({_moved("b1")}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {_nearest("b2")} GROUP BY vec_id)
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) FROM b2) AS codebooks_sha256
FROM r JOIN k ON r.vec_id = k.vec_id
"""


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
