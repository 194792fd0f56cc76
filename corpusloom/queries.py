"""Registered queries of the core operators and their SQL.

Every query runs over its whole tables. SQL is given where DuckDB expresses the same over whole tables in bearable
time; the others are tested against brute force on fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import adapters, aggregates, clean, decontaminate, dedup, evaluate, graph, vocab
from corpusloom.operators import select as sel
from corpusloom.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Profiles, buckets and rates of the test sources.
PROFILES = {"hanweb_hq": "curated_zh", "lanjuan": "broad_zh", "zhiku_edu": "web_zh", "meshweb_en": "curated_en", "meshweb_edu": "web_multilingual", "meshweb_fr": "web_multilingual", "paperbay": "scientific", "proofmath": "math", "stackyard": "code", "guji_scrolls": "classical", "bilingua": "web_zh"}
PRIORITY = [
    ("specialized", "specialized", ["stackyard", "proofmath", "paperbay"]),
    ("zh_general", "zh_general", ["hanweb_hq", "lanjuan", "guji_scrolls"]),
    ("zh_knowledge", "zh_knowledge", ["zhiku_edu", "hanweb_hq"]),
    ("english", "english", ["meshweb_en", "meshweb_edu"]),
    ("mixed", "mixed_technical", ["bilingua", "lanjuan"]),
]
NEW_CHARACTERS = "霁鹭砚芷溆"
SEED = 20
WS = r"\t\x{0B}\x{0C} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _lines(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[{WS}]+(\n|\z)', '\1', 'g')"
    return rf"regexp_replace({x}, '\A[{WS}\n]+|[{WS}\n]+\z', '', 'g')"


def _normal(x: str) -> str:
    x = rf"regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g')"
    return _lines(rf"regexp_replace(regexp_replace({x}, '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}]', '', 'g'), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')")


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _case(column: str, mapping: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def _key(seed: int, ns: str, value: str) -> str:
    return f"('0x' || substr(sha256('{seed}:{ns}:' || {value}), 1, 15))::BIGINT"


_HASH = f"sha256({_lines('text')})"
_RANK = _case("source", {s: dedup.PROFILE_RANK.get(p, 100) for s, p in PROFILES.items()}, "1000000")
_LEAST = _case("source", {s: clean.MINIMUM[p] for s, p in PROFILES.items()}, "20")
_HANZI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{323AF}]"
_UNPRINTABLE = r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{A0}\x{AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]"
_MARKERS = "[兮矣焉哉曰於者也其之乎乃遂]"
_MATH = r"\\(frac|sum|prod|int|sqrt|begin)\b|\$\$|[∑∏√∞∫∂∇≈≠≤≥]"
_CODE_SUFFIX = ", ".join(f"'{s}'" for s in clean.CODE_SUFFIXES)
_STRUCTURED_SUFFIX = ", ".join(f"'{s}'" for s in clean.STRUCTURED_SUFFIXES)

#: The cleaned table in SQL, for the queries built on it.
_CLEANED = rf"""
cleaned AS (
  SELECT *,
    CASE WHEN char_count < least_chars THEN 'too_short' WHEN printable < 0.98 THEN 'low_printable_ratio' WHEN coalesce(license, '') = '' THEN 'missing_license' END AS reject_reason,
    list_filter([CASE WHEN source = 'guji_scrolls' THEN 'classical' END, CASE WHEN language = 'zh' AND char_count > 0 AND {_count("text", _MARKERS)} / char_count >= 0.025 THEN 'classical_candidate' END,
      CASE WHEN char_count >= 8192 THEN 'long_doc' END, CASE WHEN language = 'zh_en_mixed' THEN 'mixed' END], lambda x: x IS NOT NULL) AS tags
  FROM (
    SELECT doc_id, text, source, license, char_count, hanzi_count, latin_count, least_chars, CASE WHEN char_count = 0 THEN 0 ELSE 1 - bad / char_count END AS printable,
      CASE WHEN coalesce(language, '') = '' THEN CASE WHEN hanzi_count > 0 AND latin_count > 0 AND least(hanzi_count, latin_count) / (hanzi_count + latin_count) >= 0.05 THEN 'zh_en_mixed' WHEN hanzi_count > latin_count THEN 'zh' WHEN latin_count > 0 THEN 'en' ELSE 'unknown' END
        WHEN lower(language) IN ('zh', 'cmn', 'zho', 'chinese') THEN 'zh' WHEN lower(language) IN ('en', 'eng', 'english') THEN 'en' ELSE lower(language) END AS language,
      CASE WHEN suffix IN ({_CODE_SUFFIX}) THEN 'code' WHEN suffix IN ({_STRUCTURED_SUFFIX}) THEN 'structured' WHEN regexp_matches(text, '{_MATH}') THEN 'math' ELSE domain END AS domain
    FROM (
      SELECT doc_id, source, license, language, domain, t AS text, length(t) AS char_count, {_count("t", _HANZI)} AS hanzi_count, {_count("t", "[A-Za-z]")} AS latin_count, {_count("t", _UNPRINTABLE)} AS bad, {_LEAST} AS least_chars,
        lower(regexp_extract(source_path, '[^/.][^/]*?(\.[^./]+)\z', 1)) AS suffix
      FROM (SELECT *, coalesce({_normal("text")}, '') AS t FROM adapted_record))))"""


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_and_tag(table(spark, d, "adapted_record"), PROFILES, classical=("guji_scrolls",))


@query(f"SELECT doc_id, md5({_normal('text')}) AS normal FROM adapted_record")
def flt1_normalize_text(spark, d):
    return table(spark, d, "adapted_record").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


@query(f"WITH {_CLEANED} SELECT doc_id, char_count, hanzi_count, latin_count, language, domain, array_to_string(tags, ',') AS tags, reject_reason FROM cleaned")
def flt9_clean_and_tag(spark, d):
    return _cleaned(spark, d).select("doc_id", "char_count", "hanzi_count", "latin_count", "language", "domain", F.array_join("tags", ",").alias("tags"), "reject_reason")


@query(f"WITH {_CLEANED} SELECT source, coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS docs FROM cleaned GROUP BY ALL")
def agg13_reject_counts(spark, d):
    return clean.reject_counts(_cleaned(spark, d))


_SIGN = "(" + " OR ".join(f"contains(text, '{s}')" for s in clean.SIGNALS) + ")"
_TECH = f"(language = 'zh_en_mixed' OR list_contains(tags, 'mixed') OR (hanzi_count >= 10 AND latin_count >= 10 AND {_SIGN}))"
_DOMAIN = "coalesce(nullif(domain, ''), 'general')"
_SELECTORS = {
    "specialized": f"{_DOMAIN} IN ('code', 'math', 'scientific', 'structured')",
    "zh_general": f"(language = 'zh' AND {_DOMAIN} = 'general' AND NOT list_contains(tags, 'classical'))",
    "zh_knowledge": f"(language = 'zh' AND {_DOMAIN} = 'knowledge')",
    "english": f"(language = 'en' AND {_DOMAIN} = 'general')",
    "mixed_technical": _TECH,
}
_BUCKET = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) AND {_SELECTORS[s]} THEN '{name}'" for name, s, sources in PRIORITY) + " END"
_FRESH = f"CASE WHEN source IN ('hanweb_hq', 'lanjuan') AND language IN ('zh', 'zh_en_mixed') AND regexp_matches(text, '[{NEW_CHARACTERS}]') THEN 'enhancement' END"
_ELIGIBLE = f"eligible AS (SELECT *, list_filter([{_BUCKET}, {_FRESH}], lambda x: x IS NOT NULL) AS eligible FROM cleaned WHERE reject_reason IS NULL)"


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return clean.eligible_buckets(_cleaned(spark, d).where("reject_reason is null"), PRIORITY, ("enhancement", ["hanweb_hq", "lanjuan"], NEW_CHARACTERS))


@query(f"WITH {_CLEANED}, {_ELIGIBLE} SELECT doc_id, array_to_string(eligible, ',') AS eligible FROM eligible")
def flt13_eligible_buckets(spark, d):
    return _eligible(spark, d).select("doc_id", F.array_join("eligible", ",").alias("eligible"))


_FRACTION = _key(SEED, "candidate", "b || ':' || doc_id") + " / 1152921504606846976.0"


@query(f"WITH {_CLEANED}, {_ELIGIBLE} SELECT doc_id, eligible[1] AS candidate_bucket FROM (SELECT doc_id, eligible, unnest(eligible) AS b FROM eligible) GROUP BY doc_id, eligible HAVING bool_or({_FRACTION} < CASE WHEN b = 'enhancement' THEN 0.5 ELSE 0.3 END)")
def flt14_candidate_sample(spark, d):
    rates = spark.createDataFrame([(b, s, 0.3) for b, _, ss in PRIORITY for s in ss] + [("enhancement", s, 0.5) for s in ("hanweb_hq", "lanjuan")], "bucket string, source string, rate double")
    return clean.sample_candidates(_eligible(spark, d), rates, SEED).select("doc_id", "candidate_bucket").distinct()


@query(rf"SELECT id, coalesce(regexp_replace(text, '\A[{WS}\n\r]+|[{WS}\n\r]+\z', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x{{00}}-\x{{08}}\x{{0B}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{AD}}\x{{600}}-\x{{605}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]') AND NOT (contains(text, '□') OR contains(text, chr(65533)) OR contains(text, '<|') OR contains(text, '<think>') OR contains(text, '</think>')), false) AS usable FROM near_texts")
def flt15_usable_text(spark, d):
    return table(spark, d, "near_texts").select("id", clean.usable_text(F.col("text")).alias("usable"))


PAIR = "struct<ancient:string,modern:string,task:string,messages:array<struct<role:string,content:string>>>"
_PAIRS = "pairs AS (SELECT id, json_extract_string(p, '$.ancient') AS ancient, json_extract_string(p, '$.modern') AS modern FROM (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM eligible))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")), "ancient string, modern string")
    return table(spark, d, "eligible").select("id", p.alias("p")).select("id", "p.ancient", "p.modern")


@query(f"WITH {_PAIRS} SELECT id, coalesce(ancient <> modern AND length(modern) / nullif(length(ancient), 0) BETWEEN 0.2 AND 5.0, false) AS aligned FROM pairs")
def flt16_aligned_pairs(spark, d):
    return _pairs(spark, d).select("id", clean.aligned(F.col("ancient"), F.col("modern")).alias("aligned"))


@query(
    r"""WITH m AS (SELECT pool_id, from_json(json_extract(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.messages'), '[{"role":"VARCHAR","content":"VARCHAR"}]') AS ms FROM pool),
    b AS (SELECT pool_id, ms, CASE WHEN ms[1].role = 'system' THEN ms[2:] ELSE ms END AS body FROM m)
    SELECT pool_id, CASE WHEN ms IS NULL OR len(ms) = 0 THEN 'bad_messages'
      WHEN NOT coalesce(list_bool_and([body[i].role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END FOR i IN range(1, len(body) + 1)]), true) THEN 'bad_roles'
      WHEN list_bool_or([trim(coalesce(x.content, '')) = '' FOR x IN ms]) THEN 'empty_content'
      WHEN list_bool_or([contains(x.content, '<|') OR contains(x.content, '<think>') OR contains(x.content, '</think>') FOR x IN ms]) THEN 'template_tokens'
      WHEN list_bool_or([contains(x.content, chr(65533)) OR regexp_matches(regexp_replace(x.content, '\r\n?', chr(10), 'g'), '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]') FOR x IN ms]) THEN 'corrupt_text'
      WHEN ms[-1].role <> 'assistant' THEN 'missing_assistant'
      WHEN list_sum([length(coalesce(x.content, '')) FOR x IN ms]) > 100000 THEN 'too_long' END AS reason FROM b"""
)
def flt17_conversation_rejects(spark, d):
    return adapters.conversations(table(spark, d, "pool")).select("pool_id", clean.message_reject(F.col("messages")).alias("reason"))


_MESSAGES = """from_json(json_extract(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.messages'), '[{"role":"VARCHAR","content":"VARCHAR"}]')"""


@query(f"SELECT pool_id, CASE WHEN n > 300 THEN 'too_long' WHEN coalesce(k, 0) <= 0 THEN 'no_target' END AS reason FROM (SELECT pool_id, coalesce(list_sum([length(coalesce(x.content, '')) FOR x IN ms]), 0) AS n, list_sum([CASE WHEN x.role = 'assistant' THEN length(coalesce(x.content, '')) ELSE 0 END FOR x IN ms]) AS k FROM (SELECT pool_id, {_MESSAGES} AS ms FROM pool))")
def flt19_overlength(spark, d):
    m = adapters.conversations(table(spark, d, "pool")).select("pool_id", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")).alias("m"))
    size = lambda f: F.aggregate("m", F.lit(0), lambda a, x: a + F.when(f(x), F.length(F.coalesce(x["content"], F.lit("")))).otherwise(0))
    return m.select("pool_id", clean.overlength(size(lambda x: F.lit(True)), size(lambda x: F.coalesce(x["role"] == "assistant", F.lit(False))), 300).alias("reason"))


def _audit_unp(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[{WS}\r\n\x{{1C}}-\x{{1F}}]+', '', 'g'), '\p{{P}}+', '', 'g')"


@query(
    rf"""WITH p AS (SELECT id, task, payload, {_MESSAGES} AS ms, json_extract_string(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.ancient') AS a, json_extract_string(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.modern') AS m FROM eligible),
    q AS (SELECT id, coalesce(task = 'punctuate', false) AS pu, coalesce(ms, []) AS ms, coalesce(CASE WHEN task = 'punctuate' THEN {_audit_unp("a")} WHEN task = 'm2c' THEN m ELSE a END, '') AS s, coalesce(CASE WHEN task = 'punctuate' OR task = 'm2c' THEN a ELSE m END, '') AS t FROM p),
    r AS (SELECT *, {_audit_unp("s")} = {_audit_unp("t")} AS same, length(t) / greatest(length(s), 1) AS ratio FROM q)
    SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN NOT coalesce([x.role FOR x IN ms] = ['user', 'assistant'], false) THEN 'unexpected_message_roles' END,
      CASE WHEN NOT ends_with(coalesce(ms[1].content, ''), s) OR coalesce(ms[-1].content, '') <> t THEN 'metadata_message_mismatch' END,
      CASE WHEN regexp_replace(s, '[{WS}\n\r]+', '', 'g') = '' OR regexp_replace(t, '[{WS}\n\r]+', '', 'g') = '' THEN 'empty_pair' END,
      CASE WHEN pu AND NOT same THEN 'punctuation_changes_characters' END, CASE WHEN pu AND regexp_matches(t, '\A\p{{P}}') THEN 'leading_punctuation_review' END,
      CASE WHEN NOT pu AND same THEN 'translation_copies_source_review' END, CASE WHEN NOT pu AND (ratio > 3 OR ratio < 0.33) THEN 'length_ratio_review' END], lambda x: x IS NOT NULL), ',') AS flags FROM r"""
)
def flt21_audit_flags(spark, d):
    p = F.from_json(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")), "ancient string, modern string, messages array<struct<role:string,content:string>>")
    x = table(spark, d, "eligible").select("id", "task", p.alias("p")).select("id", "task", "p.*")
    source = F.when(F.col("task") == "punctuate", T.unpunctuated(F.col("ancient"))).when(F.col("task") == "m2c", F.col("modern")).otherwise(F.col("ancient"))
    target = F.when(F.col("task").isin("punctuate", "m2c"), F.col("ancient")).otherwise(F.col("modern"))
    return x.select("id", F.array_join(clean.audit_flags(F.col("task"), source, target, F.col("messages")), ",").alias("flags")).distinct()


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50")
def flt22_first_per_channel(spark, d):
    return sel.first_n(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 50)


@query(f"SELECT doc_id, {_HASH} AS content_sha256 FROM adapted_record")
def dup1_content_hash(spark, d):
    return table(spark, d, "adapted_record").select("doc_id", T.content_hash(F.col("text")).alias("content_sha256"))


_KEPT = f"""kept AS (SELECT doc_id, h AS content_sha256, first_value(doc_id) OVER (PARTITION BY h ORDER BY r, q, n, doc_id) AS kept_doc_id
  FROM (SELECT doc_id, {_HASH} AS h, {_RANK} AS r, -coalesce(quality_prior, -1e30) AS q, -length(text) AS n FROM adapted_record WHERE text IS NOT NULL))"""


@query(f"WITH {_KEPT} SELECT * FROM kept")
def dup2_exact_representatives(spark, d):
    return dedup.exact_representatives(table(spark, d, "adapted_record"), dedup.source_rank(F.col("source"), PROFILES))


@query(f"WITH {_KEPT} SELECT DISTINCT * FROM kept WHERE doc_id <> kept_doc_id")
def dup4_exact_removals(spark, d):
    return dedup.exact_removals(table(spark, d, "adapted_record"), dedup.source_rank(F.col("source"), PROFILES)).distinct()


@query(f"WITH {_KEPT} SELECT source, count(*) AS docs FROM adapted_record WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM kept WHERE doc_id <> kept_doc_id) GROUP BY source")
def dup4_exact_kept(spark, d):
    return dedup.exact_kept(table(spark, d, "adapted_record"), dedup.source_rank(F.col("source"), PROFILES)).groupBy("source").agg(F.count("*").alias("docs"))


@query(f"WITH {_KEPT} SELECT DISTINCT * FROM kept WHERE doc_id <> kept_doc_id")
def dup5_rounds(spark, d):
    """Exact removals over two rounds of candidates: what was loaded by the end of 2024, and the rest."""
    t = table(spark, d, "adapted_record")
    early = F.coalesce(F.col("loaded_at") < F.lit("2025-01-01").cast("timestamp"), F.lit(False))
    return dedup.rounds_removals([t.where(early), t.where(~early)], dedup.source_rank(F.col("source"), PROFILES)).distinct()


@query("SELECT DISTINCT doc_id, doc_id AS cluster FROM adapted_record WHERE text IS NOT NULL AND NOT coalesce(trim(lower(domain)) IN ('code', 'structured'), false)")
def dup10_exact_only(spark, d):
    """The clusters of the profiles that stop at exact deduplication: each document is its own."""
    t = table(spark, d, "adapted_record").where("text is not null").select("doc_id", "text", dedup.minhash_profile(F.trim(F.lower("domain")), F.when(F.lower("language").startswith("zh"), "zh").otherwise(F.lower("language"))).alias("profile"))
    return dedup.near_clusters(t.where("profile <> 'code'"), ("zh", "en"))


@query(rf"SELECT id, CASE WHEN length(t) < 5 THEN 0 ELSE len(list_distinct([substr(t, i, 5) FOR i IN range(1, length(t) - 3)])) END AS shingles FROM (SELECT id, regexp_replace(text, '[{WS}\r\n\x{{1C}}-\x{{1F}}]+', '', 'g') AS t FROM near_texts WHERE text IS NOT NULL)")
def dup7_shingles(spark, d):
    return table(spark, d, "near_texts").where("text is not null").select("id", F.size(dedup.shingles(F.col("text"), F.lit("zh"))).alias("shingles"))


@query()
def dup9_minhash_clusters(spark, d):
    t = table(spark, d, "adapted_record").dropDuplicates(["doc_id"]).where("text is not null").select("doc_id", "text", dedup.minhash_profile(F.trim(F.lower("domain")), F.when(F.lower("language").startswith("zh"), "zh").otherwise(F.lower("language"))).alias("profile"))
    return dedup.minhash_clusters(t)


@query()
def dup14_near_duplicates(spark, d):
    return dedup.near_duplicates(table(spark, d, "near_texts").dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "text"))[1]


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'b:' || book AS b, 'd:' || doc AS d FROM eligible WHERE book IS NOT NULL AND doc IS NOT NULL),
    l AS (SELECT b AS u, d AS v FROM e UNION SELECT d, b FROM e), r AS (SELECT u AS node, u AS c FROM l UNION SELECT l.v, r.c FROM r JOIN l ON r.node = l.u)
    SELECT node, min(c) AS component FROM r GROUP BY node"""
)
def dup15_components(spark, d):
    e = table(spark, d, "eligible").where("book is not null and doc is not null").selectExpr("'b:' || book AS u", "'d:' || doc AS v").distinct()
    return graph.components(e)


@query(f"SELECT prompt, min_by(pool_id, (family, shuffle, pool_id)) AS pool_id FROM (SELECT *, {_lines('prompt')} AS p FROM pool) GROUP BY p, prompt HAVING false UNION ALL SELECT p, min_by(pool_id, (family, shuffle, pool_id)) FROM (SELECT *, {_lines('prompt')} AS p FROM pool) GROUP BY p")
def dup18_first_prompt(spark, d):
    t = table(spark, d, "pool").select(T.lines_normal(F.col("prompt")).alias("prompt"), "pool_id", "family", "shuffle")
    return dedup.first_per_key(t, ["prompt"], [F.col("family"), F.col("shuffle"), F.col("pool_id")]).select("prompt", "pool_id")


@query()
def dup17_two_key_greedy(spark, d):
    t = table(spark, d, "eligible").select("id", "task", "cluster", "input_hash", "priority", F.when(F.col("source") == "gujishu", 0).otherwise(1).alias("rank")).dropDuplicates(["id"])
    return dedup.two_key_greedy(t, "task", "cluster", "input_hash", ["rank", "priority"]).select("id")


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY id) > 1 THEN 'duplicate' WHEN text IN (SELECT prompt FROM pool WHERE prompt IS NOT NULL) THEN 'overlap' ELSE 'kept' END AS status FROM near_texts WHERE text IS NOT NULL")
def dup20_source_dedup(spark, d):
    t = table(spark, d, "near_texts").where("text is not null").select("id", F.col("text").alias("source"))
    return dedup.source_dedup(t, table(spark, d, "pool").where("prompt is not null").select(F.col("prompt").alias("source")), ["id"]).select("id", "status")


def _docs_for_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "adapted_record").select("doc_id", "text", F.when(F.lower(F.trim("language")).startswith("zh"), "zh").otherwise("en").alias("language"))


_COMPACT = rf"regexp_replace(text, '[{WS}\r\n\x{{1C}}-\x{{1F}}]+', '', 'g')"


def _grams(x: str) -> str:
    return f"CASE WHEN length({x}) >= 32 THEN [substr({x}, i, 32) FOR i IN range(1, length({x}) - 30)] ELSE [] END"


def _word_grams(x: str) -> str:
    return f"CASE WHEN len({x}) >= 13 THEN [array_to_string({x}[i:i+12], ' ') FOR i IN range(1, len({x}) - 11)] ELSE [] END"


_BENCH = rf"""t AS (SELECT 'd' || row_number() OVER () AS k, doc_id, {_HASH} AS h, {_COMPACT} AS c, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w, coalesce(lower(trim(language)) LIKE 'zh%', false) AS wide FROM adapted_record WHERE text <> ''),
  b AS (SELECT {_HASH} AS h, {_COMPACT} AS c, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM (SELECT question AS text FROM benchmark_items WHERE question <> '')),
  bc AS (SELECT DISTINCT unnest({_grams("c")}) AS g FROM b), bw AS (SELECT DISTINCT unnest({_word_grams("w")}) AS g FROM b),
  hits AS (SELECT doc_id, 0 AS n FROM t WHERE h IN (SELECT h FROM b) UNION ALL SELECT doc_id, 1 FROM (SELECT doc_id, unnest({_grams("c")}) AS g FROM t WHERE wide) WHERE g IN (SELECT g FROM bc)
    UNION ALL SELECT doc_id, 2 FROM (SELECT doc_id, unnest({_word_grams("w")}) AS g FROM t WHERE NOT wide) WHERE g IN (SELECT g FROM bw))"""


@query(f"WITH {_BENCH} SELECT * FROM (SELECT doc_id, CASE WHEN count(*) FILTER (n = 0) > 0 THEN 'exact' WHEN count(*) FILTER (n = 1) >= 2 THEN 'chars' WHEN count(*) FILTER (n = 2) >= 1 THEN 'words' END AS reason FROM hits GROUP BY doc_id) WHERE reason IS NOT NULL")
def dup12_contamination(spark, d):
    items = table(spark, d, "benchmark_items").select(F.col("question").alias("text"))
    return decontaminate.contamination(_docs_for_benchmarks(spark, d), items)


@query()
def dup19_contained_passages(spark, d):
    m = adapters.conversations(table(spark, d, "pool")).select("pool_id", "prompt", F.transform("messages", lambda m: m["content"]).alias("contents"))
    own = F.concat(F.array("prompt"), F.coalesce("contents", F.array().cast("array<string>")))  # a broken payload still has its prompt
    t = m.select(F.col("pool_id").alias("row_id"), F.explode(F.array_distinct(own)).alias("text")).where("text is not null")
    return decontaminate.contained_passages(t, table(spark, d, "benchmark_items").where("question is not null").select("item_id", F.col("question").alias("text")))


_UNP = rf"regexp_replace({_COMPACT}, '\p{{P}}+', '', 'g')"


@query(
    rf"""WITH p AS (SELECT item_id, {_UNP} AS p FROM (SELECT item_id, question AS text FROM benchmark_items)), a AS (SELECT DISTINCT item_id, unnest(list_distinct(list_concat([substr(p, i, 24) FOR i IN range(1, length(p) - 22, 12)], [substr(p, length(p) - 23, 24)]))) AS g FROM p WHERE length(p) >= 24),
    t AS (SELECT id, {_UNP} AS t FROM near_texts WHERE text IS NOT NULL), g AS (SELECT DISTINCT id, unnest([substr(t, i, 24) FOR i IN range(1, length(t) - 22)]) AS g FROM t WHERE length(t) >= 24)
    SELECT DISTINCT id AS row_id, item_id FROM g JOIN a USING (g)"""
)
def dup13_shared_spans(spark, d):
    t = table(spark, d, "near_texts").where("text is not null").select(F.col("id").alias("row_id"), "text")
    return decontaminate.shared_spans(t, table(spark, d, "benchmark_items").select("item_id", F.col("question").alias("text")))


@query(
    rf"""WITH p AS (SELECT id AS row_id, {_UNP} AS p FROM near_texts WHERE text IS NOT NULL), c AS (SELECT doc_id AS chapter_id, {_UNP} AS c FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT row_id, chapter_id FROM p JOIN c ON contains(c, p) WHERE length(p) >= 3"""
)
def dup21_locate(spark, d):
    p = table(spark, d, "near_texts").where("text is not null").select(F.col("id").alias("row_id"), "text")
    return decontaminate.locate(p, table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chapter_id"), "text"))


@query()
def dup22_boundary_conflicts(spark, d):
    e = _pairs(spark, d).join(table(spark, d, "eligible").select("id", "task", "split", "book", "doc", "cluster").dropDuplicates(["id"]), "id").dropDuplicates(["id"])
    translated = F.lower(F.trim("task")).isin("c2m", "m2c")
    x = e.select(F.col("id").alias("row_id"), "split", T.doc_key(F.col("doc")).alias("chapter"), T.book_key(F.col("book")).alias("book"), F.nullif("cluster", F.lit("")).alias("near_group"), F.md5("modern").alias("translation"), F.coalesce("ancient", F.lit("")).alias("text"), F.when(translated, F.col("modern")).alias("modern"))
    x = materialize(x, "boundary")
    return decontaminate.boundary_conflicts(x.where("split = 'train'"), x.where("split = 'dev'"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {_CLEANED}, {_ELIGIBLE}, x AS (SELECT source, unnest(eligible) AS bucket, char_count, hanzi_count + latin_count // 4 AS tokens FROM eligible), n AS (SELECT source, count(*) AS whole FROM eligible GROUP BY source) SELECT source, bucket, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(char_count)::BIGINT AS chars, round(count(*) / any_value(whole), 9) AS doc_rate, round(sum(tokens) / count(*), 6) AS tokens_per_doc FROM x JOIN n USING (source) GROUP BY source, bucket")
def agg1_calibration(spark, d):
    x = aggregates.calibration(_eligible(spark, d).withColumn("tokens", F.col("hanzi_count") + F.expr("latin_count div 4")))
    return x.withColumns({"doc_rate": F.round("doc_rate", 9), "tokens_per_doc": F.round("tokens_per_doc", 6)})


_MIX = f"WITH {_CLEANED}, {_ELIGIBLE}, m AS (SELECT coalesce(eligible[1], 'none') AS bucket, source, domain, char_count, hanzi_count + latin_count // 4 AS tokens, list_contains(tags, 'classical_candidate') AS classical FROM eligible)"


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d).select(F.coalesce(F.get("eligible", F.lit(0)), F.lit("none")).alias("bucket"), "source", "domain", "char_count", (F.col("hanzi_count") + F.expr("latin_count div 4")).alias("tokens"), F.array_contains("tags", "classical_candidate").alias("classical"))


@query(f"{_MIX} SELECT bucket, source, domain, grouping_id(bucket, source, domain) AS level, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(CASE WHEN char_count >= 8192 THEN tokens ELSE 0 END)::BIGINT AS long_tokens, sum(CASE WHEN classical THEN tokens ELSE 0 END)::BIGINT AS classical_tokens FROM m GROUP BY GROUPING SETS ((), (bucket), (bucket, source), (bucket, domain))")
def agg2_mixture_metrics(spark, d):
    return aggregates.mixture_metrics(_mixture(spark, d))


@query(f"{_MIX}, t AS (SELECT 'zh_general' AS bucket, unnest(['hanweb_hq', 'lanjuan', 'guji_scrolls']) AS source, unnest([0.5, 0.4, 0.1]) AS target_fraction) SELECT bucket, source, target_fraction, round(coalesce(p, 0) / w, 9) AS actual_fraction, abs(coalesce(p, 0) / w - target_fraction) <= 0.01 AS passed FROM t LEFT JOIN (SELECT bucket, source, sum(tokens) AS p FROM m GROUP BY ALL) USING (bucket, source) LEFT JOIN (SELECT bucket, sum(tokens) AS w FROM m GROUP BY ALL) USING (bucket)")
def agg3_mixture_checks(spark, d):
    t = spark.createDataFrame([("zh_general", s, w) for s, w in (("hanweb_hq", 0.5), ("lanjuan", 0.4), ("guji_scrolls", 0.1))], "bucket string, source string, target_fraction double")
    return aggregates.mixture_checks(aggregates.mixture_metrics(_mixture(spark, d)), t).withColumn("actual_fraction", F.round("actual_fraction", 9))


@query(rf"WITH c AS (SELECT doc_id, source, unnest(string_split(text, '')) AS char FROM documents WHERE text IS NOT NULL) SELECT char, count(*) AS tf, count(DISTINCT doc_id) AS df, count(DISTINCT source) AS source_df FROM c WHERE regexp_matches(char, '{_HANZI}') GROUP BY char")
def agg4_character_frequencies(spark, d):
    return aggregates.character_frequencies(table(spark, d, "documents"), F.col("char").rlike(T.HANZI))


@query("SELECT source, lang, count(*) AS docs, sum(length(coalesce(text, '')))::BIGINT AS tokens FROM documents GROUP BY source, lang")
def agg5_distribution(spark, d):
    return aggregates.distribution(table(spark, d, "documents").withColumn("tokens", F.length(F.coalesce("text", F.lit("")))), ["source", "lang"])


@query("SELECT task, count(*) AS rows, count(DISTINCT book) AS books, count(DISTINCT doc) AS docs, round(avg(n), 6) AS mean, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS most FROM (SELECT *, length(payload) AS n FROM eligible) GROUP BY task")
def agg6_task_report(spark, d):
    return aggregates.task_report(table(spark, d, "eligible").withColumn("n", F.length("payload")), "n").withColumns({"mean": F.round("mean", 6), "p95": F.col("p95").cast("bigint"), "p99": F.col("p99").cast("bigint")})


@query("SELECT field, value, count(*) AS n FROM (SELECT unnest([{'field': 'source', 'value': source}, {'field': 'split', 'value': split}, {'field': 'task', 'value': task}], recursive := true) FROM eligible) GROUP BY field, value")
def agg6_histogram(spark, d):
    return aggregates.histogram(table(spark, d, "eligible"), ["source", "split", "task"])


@query("WITH b AS (SELECT task, max(n) AS top FROM (SELECT task, book, count(*) AS n FROM eligible WHERE split = 'dev' AND book IS NOT NULL GROUP BY ALL) GROUP BY task) SELECT task, count(*) AS rows, count(DISTINCT doc) AS groups, count(DISTINCT book) AS books, round(coalesce(any_value(top), 0) / count(*), 9) AS max_book_share, count(DISTINCT doc) >= 20 AND count(DISTINCT book) >= 20 AND coalesce(any_value(top), 0) / count(*) <= 0.1 AS passed FROM eligible LEFT JOIN b USING (task) WHERE split = 'dev' GROUP BY task")
def agg7_acceptance(spark, d):
    return aggregates.acceptance(table(spark, d, "eligible").where("split = 'dev'"), 20, 20, 0.1).withColumn("max_book_share", F.round("max_book_share", 9))


@query("SELECT doc, book, task, split, count(*) AS n FROM eligible GROUP BY ALL")
def agg8_candidate_groups(spark, d):
    return table(spark, d, "eligible").groupBy("doc", "book", "task", "split").agg(F.count("*").alias("n"))


@query("SELECT language AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM pool), 9) AS share FROM pool GROUP BY language")
def agg9_shares(spark, d):
    return aggregates.shares(table(spark, d, "pool"), "language").withColumn("share", F.round("share", 9))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(CASE WHEN json_valid(metadata_json) THEN json_keys(metadata_json) ELSE ['<invalid>'] END) AS field FROM adapted_record) GROUP BY field")
def agg10_field_frequencies(spark, d):
    return aggregates.field_frequencies(table(spark, d, "adapted_record"), "metadata_json")


@query("SELECT source AS domain, count(*) AS documents, sum(n_chars)::BIGINT AS tokens, round(exp(sum(length(text) * 0.75) / sum(n_chars)), 6) AS ppl, round(sum(length(text) * 0.75) / sum(length(text)) / ln(2), 6) AS bpc, round(sum(length(text) * 0.75) / sum(octet_length(encode(text))) / ln(2), 6) AS bpb, round(sum(n_chars) / sum(length(text)), 6) AS tokens_per_char FROM documents GROUP BY source")
def agg11_perplexity(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("domain"), (F.length("text") * 0.75).alias("nll"), F.col("n_chars").alias("token_count"), F.length("text").alias("char_count"), F.octet_length("text").alias("byte_count"))
    return aggregates.perplexity(x).select("domain", "documents", "tokens", *(F.round(c, 6).alias(c) for c in ("ppl", "bpc", "bpb", "tokens_per_char")))


@query("SELECT source, round(avg(m), 6) AS macro FROM (SELECT source, lang, avg(length(text)) AS m FROM documents GROUP BY ALL) GROUP BY source")
def agg12_macro_mean(spark, d):
    x = table(spark, d, "documents").withColumn("n", F.length("text"))
    return aggregates.macro_mean(x, "source", "lang", "n").withColumn("macro", F.round("macro", 6))


@query("SELECT event_type, count(value) AS n, min(value) AS least, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def agg14_numeric_summary(spark, d):
    return aggregates.numeric_summary(table(spark, d, "events"), "event_type", "value").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("SELECT o_orderpriority, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 9) AS ratio FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def agg15_ratio(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_orderpriority").agg(F.round(aggregates.ratio(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0), F.col("l_quantity")), 9).alias("ratio"))


@query("SELECT lang AS domain, count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS empty, sum(length(coalesce(text, '')))::BIGINT AS chars, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY lang")
def src18_input_inspection(spark, d):
    return aggregates.input_inspection(table(spark, d, "documents").withColumn("domain", F.col("lang")))


# ---------------------------------------------------------------- selection


@query("SELECT id, row_number() OVER (PARTITION BY book, doc, least(length(payload) // 200, 9) ORDER BY priority, id) AS strata_rank FROM (SELECT DISTINCT ON (id) * FROM eligible)")
def win1_strata_rank(spark, d):
    x = table(spark, d, "eligible").withColumn("bin", F.least(F.expr("length(payload) div 200"), F.lit(9))).dropDuplicates(["id"])
    return sel.strata_rank(x, ["book", "doc", "bin"], "priority", "id").select("id", "strata_rank")


def _order(ns: str, column: str) -> str:
    return _key(SEED, ns, f"{column}::VARCHAR")


@query(f"SELECT doc_id, n AS taken FROM (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY {_order('order', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)) WHERE before < 100000")
def win2_running_budget(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return sel.budget(x, "n", 100000, sel.hash_order(SEED, "doc_id")).select("doc_id", "taken")


@query(f"WITH x AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY {_order('order', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)), p AS (SELECT unnest([0, 1, 2]) AS part, unnest([0, 50000, 200000]) AS a, unnest([50000, 200000, 100000000]) AS b) SELECT doc_id, part, greatest(0, a - before)::BIGINT AS first, least(n, b - before)::BIGINT AS last FROM x JOIN p ON greatest(0, a - before) < least(n, b - before)")
def win4_token_ranges(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return sel.token_ranges(x, "n", sel.hash_order(SEED, "doc_id"), [0, 50000, 200000, 100000000]).select("doc_id", "part", "first", "last")


@query(f"SELECT doc_id FROM documents ORDER BY {_order('order', 'doc_id')} LIMIT 200")
def top1_bottom_k(spark, d):
    return sel.bottom_k(table(spark, d, "documents"), sel.hash_order(SEED, "doc_id"), 200).select("doc_id")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) <= 20")
def top2_longest_per_source(spark, d):
    return sel.first_n(table(spark, d, "documents"), ["source"], [F.length("text").desc_nulls_last(), F.col("doc_id")], 20).select("source", "doc_id")


_UNIQUE = f"WITH a AS (SELECT id FROM (SELECT DISTINCT id FROM eligible WHERE task = 'c2m') ORDER BY {_key(SEED, 'order', 'id')} LIMIT 100)"


@query(f"{_UNIQUE} SELECT id, 'c2m' AS picked_for FROM a UNION ALL SELECT id, 'm2c' FROM (SELECT id FROM (SELECT DISTINCT id FROM eligible WHERE task = 'm2c' AND id NOT IN (SELECT id FROM a)) ORDER BY {_key(SEED, 'order', 'id')} LIMIT 50)")
def top6_unique_quotas(spark, d):
    x = table(spark, d, "eligible").select("id", F.col("task").alias("category"))
    return sel.pick_unique(x, [("c2m", 100), ("m2c", 50)], sel.hash_order(SEED, "id")).select("id", "picked_for")


@query(f"WITH q AS (SELECT unnest(['hanweb_hq', 'lanjuan', 'meshweb_en']) AS source, unnest([40000, 20000, 30000]) AS quota) SELECT doc_id, source FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY {_order('order', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, source, quota, length(text) AS n FROM documents JOIN q USING (source) WHERE text IS NOT NULL)) WHERE before < quota")
def sta4_quota_fill(spark, d):
    q = spark.createDataFrame([("hanweb_hq", 40000), ("lanjuan", 20000), ("meshweb_en", 30000)], "source string, quota bigint")
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.length("text").alias("n"))
    return sel.quota_fill(x, q, ["source"], "n", sel.hash_order(SEED, "doc_id")).select("doc_id", "source")


@query(f"WITH x AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY {_order('order', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)) SELECT doc_id, least(n, 100000 - before)::BIGINT AS taken FROM x WHERE before < 100000")
def sta6_clipped_budget(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return sel.budget(x, "n", 100000, sel.hash_order(SEED, "doc_id"), clip=True).select("doc_id", F.col("taken").cast("bigint").alias("taken"))


@query(f"WITH x AS (SELECT doc_id, n, (coalesce(sum(n) OVER (ORDER BY {_order('order', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM (SELECT doc_id, length(text) + 1 AS n FROM documents WHERE text IS NOT NULL)), s AS (SELECT *, unnest(range(pos // 2048, (pos + n - 1) // 2048 + 1)) AS sequence FROM x) SELECT sequence, doc_id, greatest(pos, sequence * 2048) - pos AS first, least(pos + n, (sequence + 1) * 2048) - greatest(pos, sequence * 2048) AS count FROM s")
def sta7_pack_sequences(spark, d):
    return sel.pack_sequences(table(spark, d, "documents").where("text is not null"), F.length("text"), 2048, sel.hash_order(SEED, "doc_id"))


@query()
def sta8_dev_holdout(spark, d):
    g = table(spark, d, "eligible").where("doc is not null and book is not null").groupBy("doc", "book", "task").agg(F.count("*").alias("n"))
    held = sel.holdout(materialize(g, "groups"), {"c2m": 200, "m2c": 200, "punctuate": 100})
    return table(spark, d, "eligible").join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(held)], "doc string")), "doc", "left_semi").select("id", "doc")


# ---------------------------------------------------------------- adapters


@query(r"SELECT doc_id, source || ':' || left(regexp_replace(regexp_replace(url, '[^0-9A-Za-z_.:-]+', '_', 'g'), '\A_+|_+\z', '', 'g'), 160) AS new_id FROM adapted_record")
def prj7_document_id(spark, d):
    return table(spark, d, "adapted_record").select("doc_id", adapters.document_id(F.col("source"), F.col("url")).alias("new_id"))


@query("SELECT doc_id, coalesce(nullif(url, ''), nullif(subset, ''), source_path) AS value FROM adapted_record")
def prj1_first_of(spark, d):
    t = table(spark, d, "adapted_record")
    return t.select("doc_id", adapters.first_of(t, ("url", "subset", "absent", "source_path")).alias("value"))


@query(
    r"""SELECT pool_id, m.source_family AS source_family, coalesce(nullif(nullif(m.license, ''), 'unspecified'), CASE WHEN m.source_family = 'tulip' AND contains(lower(m.source), 'wiki') THEN 'CC-BY-SA-4.0' ELSE 'unspecified' END) AS license, coalesce(len(m.messages), 0) AS turns, m.messages IS NOT NULL AS valid
    FROM (SELECT pool_id, from_json(CASE WHEN json_valid(payload) THEN payload::JSON END, '{"messages":[{"role":"VARCHAR","content":"VARCHAR"}],"source_family":"VARCHAR","source":"VARCHAR","license":"VARCHAR"}') AS m FROM pool)"""
)
def prj13_conversations(spark, d):
    return adapters.conversations(table(spark, d, "pool"), families={"tulip": [("wiki", "CC-BY-SA-4.0")]}).select("pool_id", "source_family", "license", "turns", "valid")


@query("SELECT pool_id, md5(CASE WHEN prompt LIKE '改写这段话：%' THEN substr(prompt, 7) ELSE prompt END) AS body FROM pool")
def prj14_unwrap(spark, d):
    return table(spark, d, "pool").select("pool_id", F.md5(adapters.unwrap(F.col("prompt"), "改写这段话：")).alias("body"))


@query("SELECT id, regexp_replace(trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')), '^(昔|夫|故)', '') AS line FROM near_texts")
def prj20_clean_prediction(spark, d):
    return table(spark, d, "near_texts").select("id", adapters.clean_prediction(F.col("text"), ("昔", "夫", "故")).alias("line"))


@query(f"WITH {_PAIRS} SELECT id || ':' || t.task AS id, t.task AS task, md5(t.src) AS src, md5(t.gold) AS gold FROM (SELECT id, unnest([{{'task': 'classify', 'src': ancient, 'gold': source}}, {{'task': 'retrieve', 'src': ancient, 'gold': book}}, {{'task': 'entities', 'src': ancient, 'gold': doc}}, {{'task': 'punctuate', 'src': {_UNP.replace('text', 'ancient')}, 'gold': ancient}}, {{'task': 'translate', 'src': ancient, 'gold': modern}}]) AS t FROM pairs JOIN (SELECT DISTINCT ON (id) id, source, book, doc FROM eligible) USING (id)) WHERE t.gold IS NOT NULL")
def prj16_five_tasks(spark, d):
    e = _pairs(spark, d).join(table(spark, d, "eligible").select("id", "source", "book", "doc").dropDuplicates(["id"]), "id")
    x = e.select("id", F.col("ancient").alias("classical"), "modern", F.col("source").alias("category"), F.col("book").alias("source"), F.col("doc").alias("entity"))
    return adapters.five_tasks(x).withColumns({"src": F.md5("src"), "gold": F.md5("gold")})


@query("WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT path, unnest([{'block': i // 8, 'text': array_to_string(l[i+1:i+12], chr(10))} FOR i IN range(0, greatest(len(l), 1), 8)], recursive := true) FROM l) SELECT path, block, length(text) AS n FROM b WHERE length(trim(text)) BETWEEN 30 AND 1000")
def src26_line_blocks(spark, d):
    f = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    return adapters.line_blocks(f, 12, 8, 30, 1000).select("path", "block", F.length("text").alias("n"))


@query("SELECT pool_id, left(prompt, 512) AS text FROM pool WHERE length(replace(prompt, ' ', '')) >= 2")
def prj23_smoke_text(spark, d):
    return table(spark, d, "pool").where("length(replace(prompt, ' ', '')) >= 2").select("pool_id", F.left("prompt", F.lit(512)).alias("text"))


# ---------------------------------------------------------------- functions


@query(f"SELECT doc_id, {_key(SEED, 'any', 'doc_id::VARCHAR')} AS k FROM documents")
def fn3_stable_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_key(SEED, "any", F.col("doc_id")).alias("k"))


@query(f"SELECT id, length({_UNP}) AS n FROM near_texts WHERE text IS NOT NULL")
def fn5_unpunctuated(spark, d):
    return table(spark, d, "near_texts").where("text is not null").select("id", F.length(T.unpunctuated(F.col("text"))).alias("n"))


@query("SELECT id, array_to_string([regexp_replace(x, '^[" + WS + "]+|[" + WS + "]+$', '', 'g') FOR x IN string_split(regexp_replace(book, '[·/‧]', '·', 'g'), '·')], '|') AS parts FROM (SELECT DISTINCT id, book FROM eligible WHERE book IS NOT NULL)")
def fn8_book_parts(spark, d):
    return table(spark, d, "eligible").where("book is not null").select("id", "book").distinct().select("id", F.array_join(T.book_parts(F.col("book")), "|").alias("parts"))


@query("SELECT DISTINCT source_path, lower(regexp_extract(source_path, '[^/.][^/]*?(\\.[^./]+)\\z', 1)) AS suffix, regexp_extract(source_path, '([^/]+)/[^/]*\\z', 1) AS parent FROM adapted_record".replace("\\\\", "\\"))
def fn18_path_parts(spark, d):
    return table(spark, d, "adapted_record").select("source_path", T.path_suffix(F.col("source_path")).alias("suffix"), T.path_parent(F.col("source_path")).alias("parent")).distinct()


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] ELSE [] END AS g FROM w) SELECT doc_id, CASE WHEN len(g) = 0 THEN 0 ELSE round(1 - len(list_distinct(g)) / len(g), 9) END AS share FROM g")
def fn14_repeated_grams(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.repeated_gram_share(T.words(F.col("text"))), 9).alias("share"))


def _stated(x: str) -> str:
    tried = [rf"regexp_extract({x}, '\A([ABCD])', 1)", *(f"regexp_extract({x}, '{p}', {g})" for p, g in T.CHOICE_STATED)]
    tried += [f"regexp_extract(regexp_extract({x}, '[ABCD].*?{w}', 0), '.*([ABCD])', 1)" for w in T.CHOICE_AFTER]
    letters = f"regexp_replace({x}, '[^ABCD]+', '', 'g')"
    return "coalesce(" + ", ".join(f"nullif({t}, '')" for t in [*tried, f"regexp_extract({x}, '{T.CHOICE_WEAK}', 1)"]) + f", CASE WHEN length({letters}) = 1 THEN {letters} END, 'Z')"


@query(f"SELECT doc_id, {_stated('text')} AS choice FROM adapted_record UNION ALL SELECT 'i' || item_id, {_stated('t')} FROM (SELECT item_id, '答案' || (item_id % 3)::VARCHAR || '选择：' || chr((65 + item_id % 5)::INT) || '项正确，' || question AS t FROM benchmark_items)")
def fn12_choices(spark, d):
    x = table(spark, d, "adapted_record").select("doc_id", "text")
    stated = F.concat(F.lit("答案"), (F.col("item_id") % 3).cast("string"), F.lit("选择："), F.chr(65 + F.col("item_id") % 5), F.lit("项正确，"), F.col("question"))
    y = table(spark, d, "benchmark_items").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("doc_id"), stated.alias("text"))
    return x.unionByName(y).select("doc_id", T.choice(F.col("text")).alias("choice"))


def _loop(x: str) -> str:
    x = rf"regexp_replace({x}, '[{WS}\r\n\x{{1C}}-\x{{1F}}]+\z', '')"
    return rf"coalesce(list_bool_or([ends_with({x}, repeat(right({x}, w), greatest(CASE WHEN w = 1 THEN 16 ELSE 4 END, ceil(length({x}) / (2 * w))::BIGINT))) AND regexp_matches(right({x}, w), '[\p{{L}}\p{{N}}]') FOR w IN range(1, least(64, length({x})) + 1)]), false)"


@query(f"SELECT doc_id, {_loop('text')} AS loop FROM adapted_record WHERE text IS NOT NULL")
def fn13_terminal_loops(spark, d):
    return table(spark, d, "adapted_record").where("text is not null").select("doc_id", T.ends_in_loop("text").alias("loop"))


# ---------------------------------------------------------------- evaluation

_SPELL = "translate(text, '之也於', '也之于')", "translate(text, '之夫', '也天')"


def _spelling(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "near_texts").where("text is not null")
    return t.select(F.left("doc", F.lit(2)).alias("subset"), F.col("text").alias("src"), F.translate("text", "之也於", "也之于").alias("tgt"), F.translate("text", "之夫", "也天").alias("prediction"))


@query(
    f"""WITH x AS (SELECT left(doc, 2) AS subset, text AS s, {_SPELL[0]} AS t, {_SPELL[1]} AS p FROM near_texts WHERE text IS NOT NULL),
    y AS (SELECT *, s <> t AS g, s <> p AS q, t = p AS e, [{{'g': s[i] <> t[i], 'q': s[i] <> p[i], 'e': t[i] = p[i]}} FOR i IN range(1, length(s) + 1)] AS m FROM x),
    a AS (SELECT subset, count(*) AS n, count(*) FILTER (g) AS gold, count(*) FILTER (q) AS pred, count(*) FILTER (g AND q) AS hit, count(*) FILTER (g AND q AND e) AS ok, count(*) FILTER (NOT g AND q) AS fp, count(*) FILTER (e) AS exact, count(*) FILTER (NOT g) AS clean,
      sum(len(list_filter(m, lambda z: z.g))) AS cg, sum(len(list_filter(m, lambda z: z.q))) AS cq, sum(len(list_filter(m, lambda z: z.g AND z.q))) AS cd, sum(len(list_filter(m, lambda z: z.g AND z.q AND z.e))) AS cc FROM y GROUP BY subset)
    SELECT subset, n, round(coalesce(100 * hit / nullif(pred, 0), 0), 6) AS sentence_detection_p, round(coalesce(100 * ok / nullif(gold, 0), 0), 6) AS sentence_correction_r, round(coalesce(100 * cd / nullif(cq, 0), 0), 6) AS char_detection_p, round(coalesce(200 * (cc / nullif(cq, 0)) * (cc / nullif(cg, 0)) / nullif(cc / nullif(cq, 0) + cc / nullif(cg, 0), 0), 0), 6) AS char_correction_f,
      round(100 * (hit + clean - fp) / n, 6) AS detection_accuracy, round(100 * exact / n, 6) AS correction_accuracy, round(coalesce(100 * fp / nullif(clean, 0), 0), 6) AS false_positive_rate FROM a"""
)
def evl1_spelling_metrics(spark, d):
    m = evaluate.spelling_metrics(_spelling(spark, d), ["subset"])
    return m.select("subset", "n", *(F.round(c, 6).alias(c) for c in ("sentence_detection_p", "sentence_correction_r", "char_detection_p", "char_correction_f", "detection_accuracy", "correction_accuracy", "false_positive_rate")))


@query("SELECT task, count(*) AS n, round(100 * avg(coalesce(trim(source) = trim(split), false)::INT), 6) AS accuracy FROM eligible GROUP BY task")
def evl6_classification(spark, d):
    t = table(spark, d, "eligible").select("task", F.col("source").alias("gold"), F.col("split").alias("prediction"))
    return evaluate.classification(t, ["task"]).withColumn("accuracy", F.round("accuracy", 6))


@query(r"WITH x AS (SELECT split, list_distinct(list_filter(string_split(coalesce(book, ''), '·'), lambda x: x <> '')) AS g, list_distinct(list_filter(string_split(coalesce(regexp_replace(book, '[《》]', '', 'g'), ''), '·'), lambda x: x <> '')) AS p FROM eligible), a AS (SELECT split, sum(len(list_intersect(g, p))) AS h, sum(len(p)) AS np, sum(len(g)) AS ng FROM x GROUP BY split) SELECT split, round(100 * h / np, 6) AS set_p, round(100 * h / ng, 6) AS set_r, round(200 * (h / np) * (h / ng) / (h / np + h / ng), 6) AS set_f FROM a")
def evl6_set_f1(spark, d):
    t = table(spark, d, "eligible").select("split", F.col("book").alias("gold"), F.regexp_replace("book", "[《》]", "").alias("prediction"))
    return evaluate.set_f1(t, ["split"], "·").select("split", *(F.round(c, 6).alias(c) for c in ("set_p", "set_r", "set_f")))


def _levels(x: str) -> str:
    return f"[regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g') FOR x IN string_split(regexp_replace({x}, '[·/‧]', '·', 'g'), '·')]"


@query(f"WITH x AS (SELECT split, {_levels('book')} AS g, {_levels("regexp_replace(coalesce(book, ''), '[《》]', '', 'g')")} AS p FROM eligible) SELECT split, count(*) AS n, round(100 * avg((g[1:1] = p[1:1])::INT), 6) AS level1, round(100 * avg((g[1:2] = p[1:2])::INT), 6) AS level2, round(100 * avg((g = p)::INT), 6) AS whole FROM x GROUP BY split")
def evl6_level_match(spark, d):
    t = table(spark, d, "eligible").select("split", F.col("book").alias("gold"), F.regexp_replace("book", "[《》]", "").alias("prediction"))
    return evaluate.level_match(t, ["split"]).select("split", "n", *(F.round(c, 6).alias(c) for c in ("level1", "level2", "whole")))


def _punctuation(x: str) -> str:
    return rf"list_filter([CASE WHEN regexp_matches(substr({x}, i + 1, 1), '\p{{P}}') THEN substr({x}, i + 1, 1) || length({_audit_unp(f'substr({x}, 1, i)')})::VARCHAR END FOR i IN range(0, length({x}))], lambda z: z IS NOT NULL)"


@query(f"WITH t AS (SELECT left(doc, 2) AS subset, text AS a, regexp_replace(text, '，', '。', 'g') AS b FROM near_texts WHERE text IS NOT NULL), x AS (SELECT subset, list_distinct({_punctuation('a')}) AS g, list_distinct({_punctuation('b')}) AS p, {_audit_unp('a')} = {_audit_unp('b')} AS same FROM t), s AS (SELECT subset, sum(CASE WHEN same THEN len(list_intersect(g, p)) ELSE 0 END) AS h, sum(len(p)) AS np, sum(len(g)) AS ng FROM x GROUP BY subset) SELECT subset, round(100 * h / np, 6) AS punctuation_p, round(100 * h / ng, 6) AS punctuation_r, round(200 * (h / np) * (h / ng) / (h / np + h / ng), 6) AS punctuation_f FROM s")
def evl6_punctuation_f1(spark, d):
    t = table(spark, d, "near_texts").where("text is not null").select(F.left("doc", F.lit(2)).alias("subset"), F.col("text").alias("gold"), F.regexp_replace("text", "，", "。").alias("prediction"))
    return evaluate.punctuation_f1(t, ["subset"]).select("subset", *(F.round(c, 6).alias(c) for c in ("punctuation_p", "punctuation_r", "punctuation_f")))


@query("WITH x AS (SELECT doc_id, n, unnest(CASE WHEN n <= 512 THEN [0] ELSE range(0, ((n - 512 + 255) // 256)::BIGINT + 1) END) AS i FROM (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 1)) SELECT doc_id, i * 256 AS begin, least(i * 256 + 512, n) AS end, CASE WHEN i = 0 THEN 1 ELSE i * 256 - 256 + 512 END AS scored_from FROM x")
def evl9_scoring_windows(spark, d):
    return evaluate.scoring_windows(table(spark, d, "documents").withColumn("n", F.length("text")), "n", 512, 256)


@query(f"WITH x AS (SELECT task, CASE WHEN length(prompt) > 400 THEN 'length' ELSE 'stop' END AS f, trim(coalesce(prompt, '')) = '' AS e, {_loop("coalesce(prompt, '')")} AS l FROM pool) SELECT task, count(*) AS n, round(avg((f = 'stop')::INT), 9) AS stop, round(avg((f = 'length')::INT), 9) AS cut, round(avg(l::INT), 9) AS loop, round(avg(e::INT), 9) AS empty, grouping(task) AS \"all\" FROM x GROUP BY ROLLUP(task)")
def evl12_health(spark, d):
    t = table(spark, d, "pool").select("task", F.when(F.length("prompt") > 400, "length").otherwise("stop").alias("finish_reason"), F.col("prompt").alias("prediction"))
    return evaluate.health(t).withColumns({c: F.round(c, 9) for c in ("stop", "cut", "loop", "empty")})


@query()
def evl14_paired_bootstrap(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("a_sum"), F.lit(1.0).alias("a_count"), (F.length("text") * 1.1).alias("b_sum"), F.lit(1.0).alias("b_count"))
    return evaluate.paired_bootstrap(t, 200)


@query()
def evl6_corpus_bleu(spark, d):
    t = _spelling(spark, d).select("subset", F.monotonically_increasing_id().alias("id"), F.col("tgt").alias("gold"), "prediction")
    return evaluate.corpus_bleu(materialize(t, "bleu"), ["subset"])


@query()
def evl11_answer_f1(spark, d):
    t = table(spark, d, "benchmark_items").where("answer is not null").select("benchmark", F.col("item_id").alias("id"), F.col("answer").alias("reference"), F.element_at("choices", 1).alias("prediction"))
    return evaluate.answer_f1(t, ["benchmark"])


@query("SELECT id AS key, CASE WHEN l IS NULL THEN 'missing_left' WHEN r IS NULL THEN 'missing_right' ELSE 'repeated' END AS problem FROM (SELECT coalesce(a.id, b.id) AS id, l, r FROM (SELECT id, count(*) AS l FROM eligible GROUP BY id) a FULL JOIN (SELECT id, count(*) AS r FROM eligible WHERE split = 'train' GROUP BY id) b ON a.id = b.id) WHERE l IS NULL OR r IS NULL OR l > 1 OR r > 1")
def evl16_aligned_rows(spark, d):
    e = table(spark, d, "eligible").select(F.col("id").alias("key"), "split")
    return evaluate.aligned_rows(e, e.where("split = 'train'"), "key")


# ---------------------------------------------------------------- vocabulary


@query("SELECT chr(i::INT) AS char FROM (SELECT unnest(range(13312, 19904)) AS i UNION ALL SELECT unnest(range(19968, 40960)) UNION ALL SELECT unnest(range(63744, 64256)) UNION ALL SELECT unnest(range(131072, 205744)) UNION ALL SELECT unnest(range(191472, 192096)))")
def voc1_range_characters(spark, d):
    return vocab.range_characters(spark)


@query("SELECT value, id FROM (SELECT unnest(['<pad>', '<none>', '<unk>']) AS value, unnest([0, 1, 2]) AS id UNION ALL SELECT lang, row_number() OVER (ORDER BY lang) + 2 FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))")
def voc3_feature_vocabulary(spark, d):
    return vocab.feature_vocabulary(table(spark, d, "documents").select(F.col("lang").alias("value")))


@query("SELECT 'text' AS rule, count(*) FILTER (NOT coalesce(text <> '', false)) AS n FROM documents UNION ALL SELECT 'length', count(*) FILTER (NOT coalesce(n_chars = length(text), false)) FROM documents")
def voc8_violations(spark, d):
    return vocab.violations(table(spark, d, "documents"), {"text": "text <> ''", "length": "n_chars = length(text)"})


# ---------------------------------------------------------------- set operations


@query("SELECT doc FROM eligible WHERE split = 'train' INTERSECT SELECT doc FROM eligible WHERE split = 'dev'")
def set_shared_groups(spark, d):
    e = table(spark, d, "eligible")
    return e.where("split = 'train'").select("doc").intersect(e.where("split = 'dev'").select("doc"))


@query("SELECT source FROM documents EXCEPT SELECT source FROM mix_targets")
def set_unknown_sources(spark, d):
    return table(spark, d, "documents").select("source").subtract(table(spark, d, "mix_targets").select("source"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
