"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bloom_dedup, media, mixing, piece_codec, prefix_trie, quality, sharding, simhash, spelling, substring_dedup, token_counts, token_store, toxicity

#: Where the public tokenizers lie; a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_rows(_table(spark, sf_dir, "documents"), WORD_BPE, 2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.decide(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_rows(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_quality, op3_exact_dedup, op4_media_columns, op5_substring_dedup, op6_mixing, op7_token_counts, op8_simhash, op9_toxicity, op10_sentencepiece, op11_spelling, op12_prefix_trie, op13_sharding)}

#: The checksum's table as a list in the only row of `crc`; with it, the unsigned crc32 of a text's UTF-8 bytes.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(text: str) -> str:
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda c: ('0x' || c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


def _walk(x: str) -> str:
    """A pass of the sharding permutation over column x of rows that have sides a and b."""
    sql = f"SELECT *, {x} // b AS l, {x} % b AS r FROM q"
    for i, (k0, k1, k2, k3) in enumerate(sharding.round_keys(sharding.SEED)):
        here, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"SELECT * REPLACE (({other} * {k0} + {k1}) % {sharding.PRIME} AS u) FROM (SELECT *, 0 AS u FROM ({sql}))"
        sql = f"SELECT * REPLACE ((u * u % {sharding.PRIME} * {k2} + {k3}) % {sharding.PRIME} AS u) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (u) REPLACE (({here} + u * u % {sharding.PRIME}) % {side} AS {here}) FROM ({sql})"
    return sql


ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win
                   FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s)
                   WHERE k > 1),
             gone AS (SELECT DISTINCT doc_id, i + j AS at FROM r, (SELECT unnest(range(0, 20)) AS j)),
             word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS at FROM w),
             kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.at) AS t, count(*) AS n
                      FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.at = gone.at GROUP BY word.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE},
             r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{spelling.RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
             c AS (SELECT doc_id, w, count(*) AS k FROM r GROUP BY ALL),
             h AS (SELECT w, k, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM c, crc),
             g AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h),
             v AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM g WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
             d AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS s FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
             p AS (SELECT DISTINCT x.w AS a, y.w AS b, y.n FROM d x JOIN d y ON x.s = y.s AND x.i = y.i AND x.w <> y.w AND length(x.w) = length(y.w)
                   UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.s = v.w UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.s = v.w),
             q AS (SELECT a, count(*) AS n_near, min((-n, b)) AS best FROM p GROUP BY a),
             f AS (SELECT w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form,
                   CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN q ON a = w),
             walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.root WHERE e.form IS NULL""",
    "op12_prefix_trie": f"""
        WITH {_CRC_TABLE},
             own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
                     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             cut AS (SELECT c, l, c - c % 5 AS first, {_crc32("c::VARCHAR")} % 9 AS h FROM own, crc),
             built AS (SELECT cut.c, list_concat(coalesce(lent.l[:h], []), cut.l[h + 1:]) AS l FROM cut LEFT JOIN own AS lent ON lent.c = first),
             ways AS (SELECT c, d, len(l) = d AS ends, md5(CAST(l[:d] AS JSON)::VARCHAR) AS node, coalesce(strlen(l[d].t), 0) AS bytes,
                      list_transform(range(d + 1), lambda i: md5(CAST(l[:i] AS JSON)::VARCHAR)) AS above
                      FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM built)),
             nodes AS (SELECT node, min(c) AS c, any_value(d) AS d, any_value(above) AS above, count(*) AS n, any_value(bytes) AS bytes,
                       coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM ways GROUP BY node),
             kids AS (SELECT above[d] AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
             facts AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (node)),
             sums AS (SELECT top AS node, sum((k = 0)::INT) AS leaves, sum((n - 1) * bytes) AS saved FROM (SELECT unnest(above) AS top, k, n, bytes FROM facts) GROUP BY top)
        SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM facts f JOIN sums USING (node) LEFT JOIN nodes p ON f.d > 0 AND p.node = f.above[f.d]""",
    "op13_sharding": f"""
        WITH RECURSIVE {_CRC_TABLE},
             d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc),
             k AS (SELECT *, ('0x' || left(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', size, ':', text_crc32)), 15))::BIGINT AS key FROM d),
             o AS (SELECT *, row_number() OVER (ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM k),
             s AS (SELECT *, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM o),
             w AS (SELECT row_number, row_number AS x, n, a, (n + a - 1) // a AS b, 0 AS walks FROM s
                   UNION ALL SELECT row_number, l * b + r, n, a, b, walks + 1 FROM ({_walk("x").replace("FROM q", "FROM w WHERE walks = 0 OR x >= n")})),
             e AS (SELECT row_number, x FROM w WHERE walks > 0 AND x < n)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 8 AS INTEGER) AS shard, x // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, o.row_number
        FROM o JOIN e ON e.row_number = o.row_number""",
}
