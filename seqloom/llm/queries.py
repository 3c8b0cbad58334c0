"""The queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.llm import capfilters, chat, hardneg, jaccard, mixing, packing, quality, secretscan, suffixtree, topk, trie, urlgraph, warc
from seqloom.session import read

#: (verdict, rule) that op8's contract names; judged() has its own defaults.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op2_quality(spark, sf_dir):
    return quality.quality_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark, sf_dir):
    return capfilters.linked(read(spark, sf_dir, "embeddings"))


def op3_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("row_key")


def op4_chat(spark, sf_dir):
    same = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(chat.formatted(rows, vocabulary("byte_bpe_50k.json")))


def op5_secret_scan(spark, sf_dir):
    return secretscan.scanned(read(spark, sf_dir, "documents"))


def op6_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_suffix_tree(spark, sf_dir):
    return suffixtree.scored(read(spark, sf_dir, "documents"))


def op8_url_filters(spark, sf_dir):
    return urlgraph.judged(read(spark, sf_dir, "pages"), URL_RULES)


def op9_jaccard(spark, sf_dir):
    return jaccard.linked(read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_mixing(spark, sf_dir):
    return mixing.taken(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_warc(spark, sf_dir):
    return warc.reread(read(spark, sf_dir, "pages"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: CRC-32 of a decimal number's text.
CRC = """xor(list_reduce(list_transform(range(0, length(k) * 8), lambda i: CASE WHEN i % 8 = 0 THEN ascii(k[i // 8 + 1]) ELSE 0 END::BIGINT),
                lambda h, b: CASE WHEN xor(h, b) & 1 = 1 THEN xor(xor(h, b) >> 1, 3988292384) ELSE xor(h, b) >> 1 END, 4294967295::BIGINT), 4294967295)"""

#: Base 32 of 40 hexadecimal digits: four letters for every five digits.
BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')"""

SQL = {
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || t)) AS nth, r, t
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce("text", '') AS t FROM conversations WHERE conv_id IS NOT NULL)
        ), conv AS (
            SELECT c, c - c % 100 AS first, h FROM (SELECT c, {CRC} % 6 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS k FROM t))
        ), rebuilt AS (
            SELECT v.c, t.nth, r, t FROM conv v JOIN t ON t.c = v.first AND t.nth <= v.h
            UNION ALL SELECT v.c, t.nth + 1000000, r, t FROM conv v JOIN t ON t.c = v.c AND t.nth > v.h
        ), seqs AS (
            SELECT v.c, list(struct_pack(r := r, t := t) ORDER BY nth) FILTER (nth IS NOT NULL) AS x FROM conv v LEFT JOIN rebuilt b ON b.c = v.c GROUP BY v.c
        ), pre AS (
            SELECT c, d, coalesce(x[1:d], []) AS p, d = coalesce(len(x), 0) AS last FROM (SELECT c, x, unnest(range(0, coalesce(len(x), 0) + 1)) AS d FROM seqs)
        ), node AS (
            SELECT d, p, min(c) AS conv_id, count(*) AS n, coalesce(length(p[d].t), 0) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
            FROM pre GROUP BY d, p
        ), fam AS (
            SELECT n.*, m.conv_id AS parent, (SELECT count(*) FROM node k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS kids
            FROM node n LEFT JOIN node m ON m.d = n.d - 1 AND m.p = n.p[1:n.d - 1]
        ), under AS (
            SELECT a.d, a.p, CAST(count(*) FILTER (b.kids = 0) AS BIGINT) AS leaves, CAST(sum((b.n - 1) * b.chars) AS BIGINT) AS saved
            FROM fam a JOIN fam b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p
        )
        SELECT conv_id, f.d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
        FROM fam f JOIN under u ON u.d = f.d AND u.p = f.p""",
    "op4_chat": """
        WITH c AS (
            SELECT conv_id, turn, role, coalesce("text", '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), x AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
                   coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
                   sum(length(regexp_replace(t, '<(&*)\\|', '<&\\1|', 'g')) + length(regexp_replace(role, '<(&*)\\|', '<&\\1|', 'g')) + 8 + 1 + 8) AS formatted_chars
            FROM c GROUP BY conv_id
        )
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM x""",
    "op12_warc": f"""
        WITH p AS (
            SELECT page_id, strlen(h) AS size, sha1(h) AS x, first_value(page_id) OVER w AS top, row_number() OVER w AS r
            FROM (SELECT page_id, url, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
        )
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN r > 1 THEN top END AS refers_to
        FROM p""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS a, c.vec_id AS x, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        ), pos AS (
            SELECT a, x AS positive_id, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, x) <= 5
        ), neg AS (
            SELECT pos.a, positive_id, p, x, score, CAST(row_number() OVER (PARTITION BY pos.a, positive_id ORDER BY score DESC, x) AS INTEGER) AS rank
            FROM pos JOIN s ON s.a = pos.a AND NOT same AND 80 * p <= 100 * score AND 100 * score <= 100 * p
        )
        SELECT a AS anchor_id, positive_id, rank, x AS negative_id, p AS positive_score, score AS negative_score FROM neg WHERE rank <= 5""",
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}


def oracle_sql():
    return dict(SQL)
