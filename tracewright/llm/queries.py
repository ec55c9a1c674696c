"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, fingerprints, html_extract, licenses, near_duplicates, quality, secrets, topk, unigram, vector_codes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def byte_vocabulary() -> str:
    """Path of the public byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    """Path of the public piece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_column(docs, piece_model()).drop("text")


@query
def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_column(docs, byte_vocabulary(), digests=True).drop("text")


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_column(docs, model).drop("text")


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secrets.fit(secrets.labelled_samples(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(docs, ratios).drop("text")


@query
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.similar_groups(docs, shingle=3, similarity=(90, 100))


ORACLE["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * inter >= 90 * (x.n + y.n - inter)
), reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_column(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE["op11_conversation_prefix_trie"] = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS root, (4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
    SELECT c.conv_id, 0 AS own, t.place, role, text FROM convs c JOIN turns t ON t.conv_id = c.root AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1 AS own, t.place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), seqs AS (
    SELECT c.conv_id, coalesce(list([role, text] ORDER BY own, place) FILTER (role IS NOT NULL), []) AS s FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, s[1:d] AS p, d, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)
), nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d][2]) END AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
    FROM prefixes GROUP BY p, d
), families AS (
    SELECT a.*, b.conv_id AS parent, count(c.d) AS children FROM nodes a LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]
    LEFT JOIN nodes c ON c.d = a.d + 1 AND c.p[1:a.d] = a.p GROUP BY ALL
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, a.parent AS parent_conv_id, a.n AS n_convs, a.children AS n_children,
       count(*) FILTER (s.children = 0) AS n_leaves, CAST(sum(s.saved) AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM families a JOIN families s ON s.d >= a.d AND s.p[1:a.d] = a.p
GROUP BY a.conv_id, a.d, a.parent, a.n, a.children, a.ends
"""


@query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int) -> str:
    """The rounds of op13 unrolled, every distance worked out."""
    nearest = "SELECT rid, part, min([CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), entry]) AS near FROM parts p JOIN b{k} b USING (part) GROUP BY rid, part"
    step = """, a{k} AS MATERIALIZED ({nearest}), b{n} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY i) AS x FROM (
            SELECT part, near[2] AS entry, i, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
            FROM (SELECT part, near, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k} JOIN parts USING (rid, part)) GROUP BY part, near[2], i
        ) GROUP BY part, entry
    ) m USING (part, entry)
)"""
    return "".join(step.format(k=k, n=k + 1, nearest=nearest.format(k=k)) for k in range(rounds)) + f", a{rounds} AS MATERIALIZED ({nearest.format(k=rounds)})"


ORACLE["op13_vector_code_compression"] = """
WITH v AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT rid, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) p(part)
), b0 AS MATERIALIZED (
    SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= 256
){rounds}, coded AS (
    SELECT rid, string_agg(lower(printf('%02x', near[2])), '' ORDER BY part) AS code, CAST(sum(near[1]) AS BIGINT) AS error FROM a4 GROUP BY rid
), book AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), book
""".replace("{rounds}", lloyd_sql(4))

ORACLE["op2_warc"] = """
WITH h AS (
    SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
    SELECT page_id, url, html, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
        list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(x, CAST(5 * (j // 4) + k + 1 AS BIGINT), 1)) - 1) << CAST(4 * (4 - k) AS INTEGER)))::BIGINT
        >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS digest FROM h
), g AS (
    SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, url,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

ORACLE["op5_license_scans"] = r"""
WITH t AS (
    SELECT * FROM (VALUES {rows}) AS t(template, phrase, label, words)
), tp AS (
    SELECT template, phrase, label, len(words) - 1 AS pairs, unnest(range(1, len(words))) AS i, words FROM t
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dp AS (
    SELECT doc_id, w[i] AS a, w[i + 1] AS b, i FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs)
), votes AS (
    SELECT doc_id, template, phrase, label, pairs, dp.i - tp.i AS diagonal, list(tp.i) AS places, list([tp.i, dp.i]) AS votes
    FROM dp JOIN tp ON dp.a = tp.words[tp.i] AND dp.b = tp.words[tp.i + 1] GROUP BY ALL
), bands AS (
    SELECT *, list_sort(flatten(list(votes) OVER near)) AS band, sum(len(places)) OVER near AS n FROM votes
    WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {drift} PRECEDING AND {drift} FOLLOWING)
), aligned AS (
    -- The longest path of votes in which both places grow: for each vote, one more than the best before it.
    SELECT *, list_max(list_reduce(list_prepend([]::BIGINT[], list_transform(range(len(band)), lambda k: [k])), lambda held, k:
        list_append(held, 1 + coalesce(list_max(list_transform(list_filter(range(k[1]), lambda j: band[j + 1][1] < band[k[1] + 1][1] AND band[j + 1][2] < band[k[1] + 1][2]), lambda j: held[j + 1])), 0)))) AS longest
    FROM bands WHERE NOT phrase AND pairs > {short} AND n >= pairs * {cover}
), good AS (
    SELECT doc_id, phrase, label, diagonal, 1.0::DOUBLE AS cover FROM votes WHERE (phrase OR pairs <= {short}) AND len(places) = pairs
    UNION ALL SELECT doc_id, phrase, label, diagonal, longest / pairs FROM aligned WHERE longest / pairs >= {cover}
), found AS (
    SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(diagonal) FILTER (phrase) AS first_word, max(diagonal) FILTER (phrase) AS last_word,
           array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score
    FROM good GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
""".replace("{rows}", ", ".join(
    f"({k}, {phrase}, '{label}', string_split('{words}', ' '))"
    for k, (phrase, label, words) in enumerate([*(("true", n, p) for p, n in licenses.PHRASES), *(("false", n, p) for n, p in licenses.TEMPLATES)])
)).replace("{upper}", licenses.UPPER).replace("{lower}", licenses.LOWER).replace("{drift}", str(licenses.DRIFT)).replace("{short}", str(licenses.SHORT)).replace("{cover}", str(licenses.COVER))
