"""One query per operator over its whole table, with production parameters, and DuckDB SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm import quality
from mediaquarry.llm.bpe import bpe_round_trip
from mediaquarry.llm.exact_dedup import exact_dedup
from mediaquarry.llm.filter_audit import filter_audit
from mediaquarry.llm.jaccard_join import jaccard_components
from mediaquarry.llm.language_model import score_language_model
from mediaquarry.llm.line_dedup import line_dedup
from mediaquarry.llm.merkle import document_manifest
from mediaquarry.llm.mixing import mix_sources
from mediaquarry.llm.packing import pack_documents
from mediaquarry.llm.topk_search import topk_search
from mediaquarry.llm.url_filter import LIMIT, TERMS, TERMS_SHA256, Rule, load_terms, url_filter
from mediaquarry.llm.warc import warc_round_trip

#: Host and path rules of the url query.
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def vocabulary_path() -> str:
    """The word vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language_model(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rules=URL_RULES)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary, ranks=ranks, pattern=public_tokenizers.PATTERN)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_warc": op3_warc,
    "op4_url_filters": op4_url_filters,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_topk_search": op8_topk_search,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}


def _url_oracle() -> str:
    """Terms are letters and digits, so those that stand alone are the parts between other characters."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    terms = ", ".join(f"('{t.term}', '{t.kind}', {t.weight})" for t in load_terms(TERMS, TERMS_SHA256))
    return rf"""
        WITH rules(verdict, host, path) AS (VALUES {rules}), terms(term, kind, weight) AS (VALUES {terms}),
        cut AS (SELECT row_number() OVER () AS row, page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT row, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        words AS (
            SELECT row, unnest(string_split_regex(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+')) AS term FROM parts),
        counted AS (SELECT row, term, kind, weight, count(*) AS n FROM words JOIN terms USING (term) GROUP BY ALL),
        hits AS (
            SELECT row, count(*) FILTER (kind = 'strict')::INT AS strict_hits, count(*) FILTER (kind = 'soft')::INT AS soft_hits,
                   coalesce(sum(n) FILTER (kind = 'strict'), 0)::INT AS strict_count, coalesce(sum(n) FILTER (kind = 'soft'), 0)::INT AS soft_count, sum(weight)::INT AS weight
            FROM counted GROUP BY row),
        fits AS (
            SELECT row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY row)
        SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(strict_count, 0) AS strict_count,
               coalesce(soft_count, 0) AS soft_count, coalesce(weight, 0) AS weight
        FROM parts LEFT JOIN fits f USING (row) LEFT JOIN hits USING (row)
    """


ORACLES = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d
    """,
    "op4_url_filters": _url_oracle(),
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
        e AS (SELECT doc_id, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 85 * (len(sa.g) + len(sb.g) - c)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, b FROM r JOIN both_ways ON reached = a)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(reached) FROM r WHERE id = doc_id) AS component_id FROM s
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
            FROM documents),
        d AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claim FROM f),
        l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        up(tree, level, pos, digest, n) AS (
            SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM l
            UNION ALL SELECT tree, any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, pos // 2),
        subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
        top(level, pos, digest, n) AS (
            SELECT 0, pos, digest, count(*) OVER () FROM subroots
            UNION ALL SELECT any_value(level) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY pos // 2),
        nodes AS (
            SELECT u.tree, u.level, u.pos, u.digest FROM up u WHERE n > 1
            UNION ALL SELECT s.tree, h.height + t.level, t.pos, t.digest FROM subroots s JOIN (SELECT tree, max(level) AS height FROM up GROUP BY tree) h USING (tree) CROSS JOIN top t WHERE n > 1),
        spots AS (
            SELECT l.doc_id, l.tree, l.pos AS row, l.leaf, x.level, x.pos FROM l, LATERAL (
                SELECT u.level, u.pos FROM up u WHERE u.tree = l.tree AND u.n > 1 AND u.pos = l.pos >> u.level
                UNION ALL SELECT h.height + t.level, t.pos FROM (SELECT max(level) AS height FROM up v WHERE v.tree = l.tree) h, subroots s, top t WHERE s.tree = l.tree AND t.n > 1 AND t.pos = s.pos >> t.level) x),
        sibs AS (
            SELECT s.tree, s.row, s.level, s.pos % 2 AS side, coalesce(n.digest, '') AS sibling
            FROM spots s LEFT JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.pos = xor(s.pos, 1)),
        paths AS (SELECT tree, row, list({'side': side, 'sibling': sibling} ORDER BY level) AS path, string_agg(sibling, '' ORDER BY level) AS proof FROM sibs GROUP BY tree, row),
        every AS (SELECT l.doc_id, l.tree, l.pos, l.leaf, l.claim, coalesce(path, []) AS path, sha256(coalesce(proof, '')) AS proof_sha256 FROM l LEFT JOIN paths p ON p.tree = l.tree AND p.row = l.pos),
        fold(tree, pos, level, digest, path) AS (
            SELECT tree, pos, 1, coalesce(claim, leaf), path FROM every
            UNION ALL SELECT tree, pos, level + 1, sha256(CASE WHEN path[level].side = 1 THEN path[level].sibling || digest ELSE digest || path[level].sibling END), path FROM fold WHERE level <= len(path)),
        r AS (SELECT digest AS root FROM top WHERE n = 1)
        SELECT e.doc_id, e.leaf, s.digest AS subroot, root, e.proof_sha256, f.digest AS folded_root, f.digest = root AS verified
        FROM every e JOIN subroots s USING (tree) JOIN fold f ON f.tree = e.tree AND f.pos = e.pos AND f.level = len(e.path) + 1 CROSS JOIN r
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        f AS (
            SELECT part, list_filter([CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                                      CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                                      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda l: l IS NOT NULL) AS fails,
                   coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY ALL),
        perms(o) AS (SELECT '' UNION ALL SELECT o || l FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
        steps AS (SELECT o AS filter_order, s::INT AS step, o[s] AS letter, string_split(o[1:s - 1], '') AS before FROM (SELECT o, unnest(range(1, 6)) AS s FROM perms WHERE length(o) = 5)),
        r AS (
            SELECT part, filter_order, step, letter, sum(CASE WHEN NOT list_contains(fails, letter) AND NOT list_has_any(fails, before) THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN list_contains(fails, letter) AND NOT list_has_any(fails, before) THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN list_contains(fails, letter) AND list_has_any(fails, before) THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN fails = [letter] THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN list_contains(fails, letter) AND NOT list_has_any(fails, before) THEN g ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN list_contains(fails, letter) AND NOT list_has_any(fails, before) THEN t ELSE 0 END)::BIGINT AS toxic_lost
            FROM m CROSS JOIN steps GROUP BY ALL)
        SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
    """,
}
