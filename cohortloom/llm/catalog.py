"""Queries of the operators, and their SQL for the check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import align, ann, htmltext, jaccard, lm, mixing, packing, quality, ring, rules, shards, substring, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(key: str, sql: str | None = None):
    def keep(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a text as a list in SQL; ``{text}`` stands for the text.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


@_query(
    "op6_substring_dedup",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
    k AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
    h AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
    g AS (SELECT DISTINCT r, i + o AS p FROM k JOIN h USING (h), (SELECT unnest(range(35)) AS o)),
    e AS (SELECT r, list(p) AS ps FROM g GROUP BY r),
    f AS (SELECT doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN e USING (r))
    SELECT doc_id, len(w) AS n_words, len(ps) AS n_removed,
           sha256(CASE WHEN len(ps) = 0 THEN array_to_string(w, ' ')
                       ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' '), '') END)
               AS kept_sha256
    FROM f""",
)
def op6_substring_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return substring.remove_duplicates(docs, is_stored=True, keep_text=False).drop("row")


@_query(
    "op7_mixing",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS.format(text='text')}) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
    l AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM p),
    v AS (SELECT *, ((SELECT sum(source_size) FROM l) * 1.5e0
                  - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / ((SELECT sum(weight) FROM l)
                  - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 AS level FROM l),
    c AS (SELECT arg_min(level, most / weight) FILTER (WHERE level < most / weight) AS chosen FROM v),
    t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(chosen * weight, CAST(most AS DOUBLE))) AS target FROM v, c),
    b AS (SELECT r, doc_id, size, source_size, target,
                 CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('/', 'mix', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))),
                     doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(least(2 * size, rounds * size + greatest(0, least(size, CAST(floor(target - rounds * source_size) AS BIGINT) - before))) AS BIGINT) AS taken
    FROM b""",
)
def op7_mixing(spark, sf_dir):
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("row")


@_query(
    "op10_quality_rules",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(text='text')} AS w FROM documents),
    g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
    k AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM g),
    m AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM k),
    c AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM m, (SELECT unnest(range(3)) AS o) WHERE n > 1 GROUP BY r),
    l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    x AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
          FROM d JOIN l USING (r) LEFT JOIN c USING (r)),
    y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
    SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                                    OR 10 * n_dup_lines > 5 * n_lines) AS kept
    FROM y""",
)
def op10_quality_rules(spark, sf_dir):
    return rules.report(_table(spark, sf_dir, "documents"))


@_query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op3_training_order_shards")
def op3_training_order_shards(spark, sf_dir):
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return shards.write_shards(_table(spark, sf_dir, "documents"), vocabulary, is_stored=True)


@_query("op8_backoff_lm")
def op8_backoff_lm(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


@_query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, quality.grades_of(_table(spark, sf_dir, "labels")), 3))


@_query(
    "op4_ngram_jaccard",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text='text')} AS w FROM documents),
    c AS (SELECT t, min(doc_id) AS class_id, count(*) AS class_size, any_value(w) AS w FROM d GROUP BY t),
    s AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM c),
    n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.class_id <> b.class_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
    r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS group_id FROM r GROUP BY 1),
    k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
    SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, group_id
    FROM d JOIN c USING (t) JOIN m ON m.a = class_id LEFT JOIN k ON k.a = class_id""",
)
def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), is_stored=True).drop("row", "group_row")


@_query("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    return htmltext.main_texts(_table(spark, sf_dir, "pages"))


@_query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", is_stored=True)


@_query("op13_sharding")
def op13_sharding(spark, sf_dir):
    placed = ring.assign(_table(spark, sf_dir, "documents"), 16, is_stored=True)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


@_query(
    "op12_conversation_trie",
    f"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role,
                      coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    i AS (SELECT DISTINCT conv_id FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, 3 - (list_reduce(
                 flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                 lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END,
                 CAST(4294967295 AS BIGINT)) & 3) AS h FROM i),
    r AS (SELECT c.conv_id, 0 AS s, p, role, text FROM c JOIN t ON t.conv_id = base AND p <= h
          UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
    n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s, p) AS d,
                 md5(concat(CAST(length(role) AS VARCHAR), ':', role, text)) AS m, len({_WORDS.format(text='text')}) AS w FROM r),
    q AS (SELECT conv_id, 0 AS d, 0 AS w, '' AS k FROM c
          UNION ALL SELECT conv_id, d, w, string_agg(m, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) FROM n),
    z AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS top FROM q),
    g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = top), '')) AS ends FROM z GROUP BY 1, 2),
    x AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
    f AS (SELECT g.*, coalesce(n, 0) AS n_children FROM g LEFT JOIN x USING (k)),
    a AS (SELECT k, d, n_children, (n_convs - 1) * w AS own, unnest(range(0, d + 1)) AS e FROM f),
    b AS (SELECT left(k, 32 * e) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM a GROUP BY 1)
    SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
    FROM f JOIN b USING (k) LEFT JOIN f AS u ON f.d > 0 AND u.k = left(f.k, length(f.k) - 32)""",
)
def op12_conversation_trie(spark, sf_dir):
    return trie.trie(trie.with_family_starts(trie.turns(_table(spark, sf_dir, "conversations")))).drop("key")


@_query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.aligned(_table(spark, sf_dir, "documents"), a, b)
