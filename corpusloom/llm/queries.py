"""Registered queries of the training-text operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import crosssplit, leakage, lookalike, mixing, packing, quality, splits, subjects, tokens
from corpusloom.session import materialize, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def training_texts(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, text) of the three text tables."""
    parts = [("adapted_record", "doc_id", "text"), ("near_texts", "id", "text"), ("pool", "pool_id", "prompt")]
    a, b, c = (table(spark, d, t).selectExpr(f"'{t}' AS src_table", f"{k} AS row_id", f"{x} AS text") for t, k, x in parts)
    return a.unionByName(b).unionByName(c)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(training_texts(spark, d), table(spark, d, "benchmark_items"))


def p1_item_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p1_found(spark, d), table(spark, d, "benchmark_items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(training_texts(spark, d))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The records of every look that has more than one string, with which all pairs can be written."""
    return lookalike.look_members(training_texts(spark, d))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize(training_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.unnatural(table(spark, d, "adapted_record"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.mark(table(spark, d, "adapted_record"))


def split_records(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, src_table, evaluation, split, source, payload, prompt): eligible with its present split, and the pool, which is training data."""
    split = "lower(trim(split))"
    a = table(spark, d, "eligible").selectExpr("id AS row_id", "'eligible' AS src_table", f"CASE WHEN {split} IN ('dev', 'test') THEN true WHEN {split} = 'train' THEN false END AS evaluation", "split", "source", "payload", "CAST(NULL AS STRING) AS prompt")
    b = table(spark, d, "pool").selectExpr("pool_id AS row_id", "'pool' AS src_table", "false AS evaluation", "'train' AS split", "family AS source", "payload", "prompt")
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = crosssplit.overlaps(split_records(spark, d))
    return pairs.selectExpr("least(eval_id, train_id) AS id_a", "greatest(eval_id, train_id) AS id_b")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_members(split_records(spark, d))


def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_passages(split_records(spark, d))


def p4_split_report(spark: SparkSession, d: str) -> DataFrame:
    records = split_records(spark, d)
    return crosssplit.overlap_report(materialize(crosssplit.overlaps(records), "overlaps"), records)


def p5_token_cube(spark: SparkSession, d: str) -> DataFrame:
    return tokens.rollup(tokens.update(table(spark, d, "adapted_record"), tokens.empty_ledger(spark)).cube)


def p5_incremental_cube(spark: SparkSession, d: str) -> DataFrame:
    """The same totals reached in two deliveries: what was loaded by the end of 2024, then everything."""
    docs = table(spark, d, "adapted_record")
    early = tokens.update(docs.where("loaded_at < timestamp'2025-01-01 00:00:00'"), tokens.empty_ledger(spark))
    return tokens.rollup(tokens.update(docs, early).cube)


def p5_removed_cube(spark: SparkSession, d: str) -> DataFrame:
    """Totals after documents were removed: everything is counted and kept, then what was loaded before July 2024 is gone."""
    docs, path = table(spark, d, "adapted_record"), f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    tokens.save(tokens.update(docs, tokens.load(spark, path)), path)
    tokens.save(tokens.update(docs.where("loaded_at >= timestamp'2024-07-01 00:00:00'"), tokens.load(spark, path)), path)
    return tokens.rollup(tokens.load(spark, path).cube)


SHARES = {"train": 0.9, "dev": 0.05, "test": 0.05}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn(table(spark, d, "eligible"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "eligible"), SHARES)


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.share_report(materialize(splits.assign(table(spark, d, "eligible"), SHARES), "assigned"), SHARES)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents"), ["doc_id"]), table(spark, d, "containers"))


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d), table(spark, d, "containers"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.count_tokens(table(spark, d, "documents"), ["doc_id", "source"]), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_BARE = r"""regexp_replace(regexp_replace(book, '[\p{Cf}\x{34F}\x{FE00}-\x{FE0F}]|[\p{Z}\s\x{85}]', '', 'g'), '[《》〈〉「」『』【】﹁﹂﹃﹄“”‘’"'']', '', 'g')"""
_NUMBER = "[一二三四五六七八九十百千零〇两兩廿卅0-9０-９]+"
_CUT = rf"""regexp_replace({_BARE}, '[·•・．.:：,，、—_(（\[-]*(?:第{_NUMBER}[卷巻册冊回章篇部]|[卷巻册冊][之第]?(?:{_NUMBER}[上中下]?|[上中下首末前後后终終]))[)）\]]*$', '')"""
_NONE = ", ".join("'" + x + "'" for x in splits.NO_BOOK)

P6_SQL = f"""WITH RECURSIVE r AS (SELECT id, min(split) AS split, min(book) AS book, min(doc) AS doc FROM eligible WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT id, split, CASE WHEN {_CUT} = '' THEN {_BARE} ELSE {_CUT} END AS name, CASE WHEN trim(doc) <> '' AND NOT starts_with(trim(doc), 'unresolved:') THEN 'd:' || trim(doc) END AS d FROM r),
k AS (SELECT id, split, CASE WHEN lower(name) NOT IN ({_NONE}) THEN 'b:' || name END AS b, d FROM n),
e AS (SELECT DISTINCT b AS u, d AS v FROM k WHERE b IS NOT NULL AND d IS NOT NULL UNION SELECT DISTINCT d, b FROM k WHERE b IS NOT NULL AND d IS NOT NULL),
w AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, w.root FROM w JOIN e ON w.node = e.u),
c AS (SELECT node, min(root) AS root FROM w GROUP BY node),
t AS (SELECT id, split, coalesce(root, b, d, 'r:' || id) AS root FROM k LEFT JOIN c ON c.node = coalesce(b, d))
SELECT id FROM t WHERE root IN (SELECT root FROM t GROUP BY root HAVING min(split) <> max(split))"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL}
