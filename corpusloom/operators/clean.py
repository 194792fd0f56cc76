"""Cleaning, tagging and filtering of documents, with a reason for every rejected row."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import text as T

#: Least length by quality profile; suffixes of code and of structured files; technical signs; marks of damage.
MINIMUM = {"curated_zh": 20, "curated_en": 50, "web_zh": 80, "web_multilingual": 80, "broad_zh": 20, "code": 20, "math": 80, "scientific": 200, "classical": 10}
CODE_SUFFIXES = (".py", ".js", ".ts", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".go", ".rs", ".sh", ".sql")
STRUCTURED_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".xml", ".md", ".rst")
SIGNALS = ("```", "http://", "https://", " API ", " CLI ", "::", "_", "/")
DAMAGED = ("□", "\ufffd", "<|", "<think>", "</think>")


def language(stated: Column, hanzi: Column, latin: Column) -> Column:
    """The stated language in one spelling, else what the counts of ideographs and Latin letters say."""
    s = F.lower(stated)
    known = F.when(s.isin("zh", "cmn", "zho", "chinese"), "zh").when(s.isin("en", "eng", "english"), "en").otherwise(s)
    mixed = (hanzi > 0) & (latin > 0) & (F.try_divide(F.least(hanzi, latin), hanzi + latin) >= 0.05)
    seen = F.when(mixed, "zh_en_mixed").when(hanzi > latin, "zh").when(latin > 0, "en").otherwise("unknown")
    return F.when(F.coalesce(stated, F.lit("")) == "", seen).otherwise(known)


def domain(stated: Column, path: Column, text: Column) -> Column:
    """The domain by file suffix, else mathematics by its signs, else the stated one."""
    suffix = F.coalesce(T.path_suffix(path), F.lit(""))
    return F.when(suffix.isin(*CODE_SUFFIXES), "code").when(suffix.isin(*STRUCTURED_SUFFIXES), "structured").when(text.rlike(T.MATH), "math").otherwise(stated)


def _normal(text: str) -> str:
    """The same as ``text.normalize_text``."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _HIDDEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    return _LINE_END.sub(r"\1", text).strip(_ENDS)


_BLANKS = "\t\x0b\x0c \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ENDS = _BLANKS + "\n"
_LINE_END = re.compile(f"[{_BLANKS}]+(\n|\\Z)")
_HIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200d\u2060\ufeff]+")


def normalized(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` normalised in one Arrow pass; null texts become empty.

    Unlike a column expression the pass is done once, whatever filters on derived columns follow.
    """
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            new = pa.array([_normal(x) if x else "" for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, StructType.fromJson(docs.schema.jsonValue()))


def clean_and_tag(docs: DataFrame, profiles: dict[str, str], traditional: tuple[str, ...] = (), classical: tuple[str, ...] = ()) -> DataFrame:
    """Normalised text, counts, language, domain, tags and ``reject_reason`` (null where a row is accepted).

    ``docs``: doc_id, text, source, source_path, license, language, domain. Reasons in order: too_short (below the
    minimum of the source's quality profile), low_printable_ratio (below 0.98), missing_license. A null text is
    too short. Tags are sorted.
    """
    t = normalized(docs)
    profile = F.create_map(*(F.lit(x) for kv in profiles.items() for x in kv)) if profiles else F.create_map().cast("map<string,string>")
    minimum = F.create_map(*(F.lit(x) for kv in MINIMUM.items() for x in kv))
    least = F.coalesce(minimum[profile[F.col("source")]], F.lit(20))
    text = F.col("text")
    t = t.withColumns({"char_count": F.length(text), "hanzi_count": T.hanzi_count(text), "latin_count": T.latin_count(text), "digit_count": T.digit_count(text), "printable": F.coalesce(T.printable_ratio(text), F.lit(0.0)), "particles": T.class_count(text, T.PARTICLES[1:-1]), "least": least})
    t = t.withColumns({"language": language(F.col("language"), F.col("hanzi_count"), F.col("latin_count")), "domain": domain(F.col("domain"), F.col("source_path"), text)})
    reason = F.when(F.col("char_count") < F.col("least"), "too_short").when(F.col("printable") < 0.98, "low_printable_ratio").when(F.coalesce(F.col("license"), F.lit("")) == "", "missing_license")
    tags = F.array(
        F.when(F.col("source").isin(*classical) if classical else F.lit(False), "classical"),
        F.when((F.col("language") == "zh") & (F.col("char_count") > 0) & (F.try_divide("particles", "char_count") >= 0.025), "classical_candidate"),
        F.when(F.col("char_count") >= 8192, "long_doc"),
        F.when(F.col("language") == "zh_en_mixed", "mixed"),
        F.when(F.col("source").isin(*traditional) if traditional else F.lit(False), "traditional"),
    )
    return t.withColumns({"tags": F.array_compact(tags), "reject_reason": reason}).drop("particles", "least")


def reject_counts(cleaned: DataFrame) -> DataFrame:
    """(source, reject_reason, docs): rejected and accepted rows; accepted ones under ``accepted``."""
    return cleaned.groupBy("source", F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")).agg(F.count("*").alias("docs"))


def technical_mixed(text: Column, lang: Column, tags: Column, hanzi: Column, latin: Column) -> Column:
    """Mixed language, or ten letters of both scripts and a technical sign."""
    sign = F.lit(False)
    for s in SIGNALS:
        sign = sign | text.contains(s)
    return F.coalesce((lang == "zh_en_mixed") | F.array_contains(tags, "mixed") | ((hanzi >= 10) & (latin >= 10) & sign), F.lit(False))


def selector(name: str, new_characters: str = "") -> Column:
    """The predicate of a bucket selector over a cleaned table; an unknown name is an error."""
    lang, dom = F.coalesce("language", F.lit("")), F.coalesce(F.nullif("domain", F.lit("")), F.lit("general"))
    mixed = technical_mixed(F.col("text"), lang, F.col("tags"), F.col("hanzi_count"), F.col("latin_count"))
    hard = dom.isin("code", "math", "scientific", "structured")
    fresh = F.translate(F.col("text"), new_characters, "") != F.col("text") if new_characters else F.lit(False)
    return {
        "new_char_coverage": lang.isin("zh", "zh_en_mixed") & fresh,
        "zh_general": (lang == "zh") & (dom == "general") & ~F.array_contains("tags", "classical"),
        "zh_knowledge": (lang == "zh") & (dom == "knowledge"),
        "english": (lang == "en") & (dom == "general"),
        "mixed_technical": mixed,
        "specialized": hard,
        "english_multilingual_mixed": ~lang.isin("", "unknown", "zh") | mixed,
        "math_code_science": hard,
    }[name]


def eligible_buckets(cleaned: DataFrame, priority: list[tuple[str, str, list[str]]], enhancement: tuple[str, list[str], str] | None = None) -> DataFrame:
    """Adds ``eligible``: the first bucket of ``priority`` (name, selector, sources) that takes a row, and the
    enhancement bucket (name, sources, new characters) if it does."""
    first = F.lit(None).cast("string")
    for name, sel, sources in reversed(priority):
        first = F.when(F.col("source").isin(*sources) & selector(sel), F.lit(name)).otherwise(first)
    more = [F.when(F.col("source").isin(*enhancement[1]) & selector("new_char_coverage", enhancement[2]), F.lit(enhancement[0]))] if enhancement else []
    return cleaned.withColumn("eligible", F.array_compact(F.array(first, *more)))


def sample_candidates(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Rows of which any eligible bucket's stable fraction is below its rate; the first eligible bucket becomes ``candidate_bucket``.

    ``rates``: bucket, source, rate. A bucket without a rate takes nothing. One row per input row.
    """
    r = rates.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "rate"))).alias("rates"))
    x = rows.join(r, "source", "left")
    taken = F.exists("eligible", lambda b: T.stable_key(seed, "candidate", F.concat_ws(":", b, F.col("doc_id"))) / F.lit(float(1 << 60)) < F.coalesce(F.col("rates")[b], F.lit(0.0)))
    return x.where(taken).withColumn("candidate_bucket", F.get("eligible", F.lit(0))).drop("rates")


def usable_text(text: Column) -> Column:
    """Whether a training text is neither empty, damaged nor corrupt, nor holds template marks."""
    ok = (F.regexp_replace(text, rf"\A[{T.BLANKS}\n\r]+|[{T.BLANKS}\n\r]+\z", "") != "") & ~F.regexp_replace(text, r"\r\n?", "\n").rlike(r"[\p{Cc}\p{Cf}\p{Cs}&&[^\n\t]]")
    for mark in DAMAGED:
        ok = ok & ~text.contains(mark)
    return F.coalesce(ok, F.lit(False))


def aligned(source: Column, target: Column) -> Column:
    """Whether a translation pair is plausible: differs, and is 0.2 to 5 times as long."""
    ratio = F.length(target) / F.nullif(F.length(source), F.lit(0))
    return F.coalesce((source != target) & ratio.between(0.2, 5.0), F.lit(False))


def punctuation_pair(raw: Column, marked: Column) -> Column:
    """Whether ``marked`` is ``raw`` with punctuation added: same characters, raw has none, marked has some."""
    return F.coalesce(~raw.rlike(r"\p{P}") & marked.rlike(r"\p{P}") & (T.unpunctuated(raw) == T.unpunctuated(marked)), F.lit(False))


def message_reject(messages: Column) -> Column:
    """Why a conversation is unusable, or null: bad_messages, bad_roles, empty_content, template_tokens, corrupt_text, missing_assistant, too_long."""
    roles = F.transform(messages, lambda m: m["role"])
    body = F.when(F.get(roles, F.lit(0)) == "system", F.slice(messages, 2, F.size(messages))).otherwise(messages)
    order = F.forall(F.transform(body, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: F.coalesce(x, F.lit(False)))
    content = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    long = F.aggregate(content, F.lit(0), lambda a, c: a + F.length(c)) > 100_000
    template = F.exists(content, lambda c: c.contains("<|") | c.contains("<think>") | c.contains("</think>"))
    corrupt = F.exists(content, lambda c: F.regexp_replace(c, r"\r\n?", "\n").rlike(r"[\p{Cc}\p{Cs}&&[^\n\t]]") | c.contains("\ufffd"))
    empty = F.exists(content, lambda c: F.trim(c) == "")
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "bad_messages").when(~order, "bad_roles").when(empty, "empty_content").when(template, "template_tokens")
        .when(corrupt, "corrupt_text").when(F.get(roles, F.size(roles) - 1) != "assistant", "missing_assistant").when(long, "too_long")
    )


def overlength(size: Column, target: Column, most: int) -> Column:
    """Why a training row is left out, or null: too_long (more than ``most``), else no_target (nothing to learn from)."""
    return F.when(size > most, "too_long").when(F.coalesce(target, F.lit(0)) <= 0, "no_target")


def audit_flags(task: Column, source: Column, target: Column, messages: Column) -> Column:
    """Structural flags of a task pair and its messages, in order; an empty array where nothing is odd.

    Null sources and targets count as empty, null messages as none.
    """
    source, target = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.coalesce(messages, empty)
    content = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    roles = F.transform(messages, lambda m: m["role"])
    first, last = F.coalesce(F.get(content, F.lit(0)), F.lit("")), F.coalesce(F.get(content, F.size(content) - 1), F.lit(""))
    same = T.unpunctuated(source) == T.unpunctuated(target)
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    blank = lambda c: F.regexp_replace(c, rf"[{T.BLANKS}\n\r]+", "") == ""
    punctuate = F.coalesce(task == "punctuate", F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(roles == F.array(F.lit("user"), F.lit("assistant")), F.lit(False)), "unexpected_message_roles"),
            F.when(~first.endswith(source) | (last != target), "metadata_message_mismatch"),
            F.when(blank(source) | blank(target), "empty_pair"),
            F.when(punctuate & ~same, "punctuation_changes_characters"),
            F.when(punctuate & target.rlike(r"\A\p{P}"), "leading_punctuation_review"),
            F.when(~punctuate & same, "translation_copies_source_review"),
            F.when(~punctuate & ((ratio > 3) | (ratio < 0.33)), "length_ratio_review"),
        )
    )


def has_target(labels: Column, ignore: int = -100) -> Column:
    """Whether any label after the first is not the ignored one."""
    return F.exists(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != ignore)


def row_validity(ids: Column, labels: Column, mask: Column) -> Column:
    """Why an encoded row is invalid, or null: lengths, too_short, mask, supervised_padding."""
    padded = F.exists(F.arrays_zip(labels.alias("l"), mask.alias("m")), lambda z: (z["m"] == 0) & (z["l"] != -100))
    return F.when((F.size(ids) != F.size(labels)) | (F.size(ids) != F.size(mask)), "lengths").when(F.size(ids) < 2, "too_short").when(~F.forall(mask, lambda m: m.isin(0, 1)), "mask").when(padded, "supervised_padding")
