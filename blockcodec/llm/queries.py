"""The opN_<name> queries and their DuckDB SQL."""

from __future__ import annotations

from .common import table
from .exact_dedup import exact_dedup
from .html_extraction import extract_pages
from .packing import pack_documents
from .quality import quality
from .quality_rules import quality_rules
from .sentencepiece_lattice import load, sentencepiece
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup
from .token_files import token_files
from .toxicity import toxicity


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_dedup(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, which every executor has too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece(table(spark, sf_dir, "documents"), load(tokenizer_file("piece_bpe_32k.model")), digest=True)


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity": op10_toxicity,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op7_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM t),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM starts),
        early AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN early USING (s) WHERE m < doc_id),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT t.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
        FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id""",
}
