"""The subpackage's queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.graph_ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), 50, 5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.spotsigs import edited_likeness

    return edited_likeness(_table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.token_output import read_blocks, write_blocks

    return read_blocks(write_blocks(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality import fit_prepared, prepared, scores_prepared

    table = prepared(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores_prepared(table, fit_prepared(table))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.line_dedup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


#: Host, path, verdict of the rules that the url query applies. Fixed values.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.packing import best_fit

    return best_fit(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 0, 2048)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.shingle_join import joined

    return joined(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.hard_negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' similarity join over all documents: length classes, pruned Jaccard, one class id a document."""
    from lodestrata.llm.spotsigs import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def spotsigs_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_spotsigs says of a document and its edited text that SQL can say as well."""
    return op3_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op5_mixing works with."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_url_filter says of an url before its models: host, path, the rule that fits."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def _rule_case() -> str:
    """The rules as a CASE, longest first."""
    whens = (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {' '.join(whens)} END"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_graph_ann": op1_graph_ann,
        "op2_simhash": op2_simhash,
        "op3_spotsigs": op3_spotsigs,
        "op4_token_output": op4_token_output,
        "op5_mixing": op5_mixing,
        "op6_html_text": op6_html_text,
        "op7_quality": op7_quality,
        "op8_url_filter": op8_url_filter,
        "op9_packing": op9_packing,
        "op10_line_dedup": op10_line_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_shingle_join": op12_shingle_join,
        "op13_hard_negatives": op13_hard_negatives,
        "spotsigs_groups": spotsigs_groups,
        "spotsigs_edits": spotsigs_edits,
        "mixing_sizes": mixing_sizes,
        "url_rules": url_rules,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express, whole or in part; tests/llm holds the others against brute force."""
    from lodestrata.llm import filter_audit, hard_negatives

    return {
        "op11_filter_audit": filter_audit.SQL,
        "op12_shingle_join": op12_shingle_join,
        "op13_hard_negatives": hard_negatives.SQL,
        "spotsigs_edits": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                              coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following
                       FROM documents)
            SELECT doc_id, n::BIGINT AS n_chars, sha256(substring(text, 1, n - n // 4) || substring(following, 1, n // 4)) AS edited_sha256 FROM d""",
        "mixing_sizes": r"""
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
            SELECT doc_id, size, (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size FROM d""",
        "url_rules": f"""
            WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
            SELECT page_id, host, path, {_rule_case()} AS rule FROM p""",
    }
