"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe_count, decontaminate, exact_dedup, filter_audit, katz, language_id, packing, pii, secret_scan, simhash, token_files, vector_codes, warc
from .common import id_remainder
from .tokens import default_vocabulary


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"), id_remainder(5) == 0)


def op3_lm_scoring(spark, sf_dir):
    return katz.katz_scores(_table(spark, sf_dir, "documents"), id_remainder(10) != 0)


def op4_pii(spark, sf_dir):
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    index = exact_dedup.temporary_index(spark)
    out = index.add(_table(spark, sf_dir, "documents"))
    index.drop()
    return out


def op6_simhash(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), default_vocabulary())


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), default_vocabulary())


def op9_token_files(spark, sf_dir):
    return token_files.token_file_round_trip(_table(spark, sf_dir, "documents"), default_vocabulary())


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_filters(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))[0]


def op13_warc(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def queries():
    ops = (op1_secret_scan, op2_language_id, op3_lm_scoring, op4_pii, op5_exact_dedup, op6_simhash, op7_token_counts, op8_packing, op9_token_files, op10_decontamination, op11_filter_audit, op12_vector_codes, op13_warc)
    return {f.__name__: f for f in ops}


#: Filters by letter: a text's failures as bits, A first, then every order of the five letters step by step.
FILTER_AUDIT = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
         w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
         l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
         m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                      CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
                      || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
                      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                      || CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 'E' ELSE '' END AS failed
               FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
         c AS (SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
         f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
         s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[:step - 1] AS earlier FROM o, range(1, 6) r(step)),
         e AS (SELECT c.*, s.*, contains(failed, letter) AS fails,
                      earlier <> '' AND regexp_matches(failed, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone
               FROM c, s),
         r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
                      CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
                      CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
                      CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
                      CAST(sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                      CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                      CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
               FROM e GROUP BY ALL)
    SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


def _vector_codes_sql() -> str:
    """Four rounds of assignment and means, then a last assignment; d * 256 + entry orders by distance, then by entry."""
    steps = ["""k AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(x::DOUBLE * 1024) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
        WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "v AS MATERIALIZED (SELECT vec_id, p, q[len(q) // 4 * p + 1 : len(q) // 4 * (p + 1)]::DOUBLE[] AS x FROM k, range(4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v QUALIFY e < 256)"]
    for i in range(5):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, CAST(min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e) AS BIGINT) AS m
            FROM v JOIN b{i} USING (p) GROUP BY vec_id, p)""")
        if i < 4:
            steps.append(f"s{i} AS (SELECT p, m % 256 AS e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i})")
            steps.append(f"f{i} AS (SELECT p, e, j, floor(sum(y) / count(*)) AS y FROM s{i} GROUP BY ALL)")
            steps.append(f"u{i} AS (SELECT p, e, list(y ORDER BY j) AS c FROM f{i} GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.c, b.c) AS c FROM b{i} b LEFT JOIN u{i} u USING (p, e))")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)")
    steps.append("r AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id)")
    return "WITH " + ", ".join(steps) + """
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h"""


def oracle_sql():
    return {
        "op11_filter_audit": FILTER_AUDIT,
        "op12_vector_codes": _vector_codes_sql(),
        "op13_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
                 g AS (SELECT h, max(page_id) AS response FROM p WHERE strlen(h) >= 1000 GROUP BY h)
            SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN response <> page_id THEN response END AS refers_to
            FROM p LEFT JOIN g USING (h)""",
        "op5_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
                 g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
    }
