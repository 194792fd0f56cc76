"""Adapters: projections from raw source rows to the canonical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

TEXT_FIELDS = ("text", "content", "body", "document")
ID_FIELDS = ("id", "doc_id", "corpus_id", "hexsha", "swhid")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that is neither null nor empty; absent columns are skipped."""
    return F.coalesce(*(F.nullif(_column(df, n), F.lit("")) for n in names))


def generic_text(df: DataFrame) -> Column:
    """The text of a row of any source."""
    return first_of(df, TEXT_FIELDS)


def exam_text(df: DataFrame) -> Column:
    """Question, options A to E, answer and explanation of an exam row, one per line; missing parts are left out."""
    full = lambda n: F.nullif(F.trim(_column(df, n)), F.lit(""))
    options = [F.concat(F.lit(f"{x.upper()}. "), full(f"option_{x}")) for x in "abcde"]
    answer = F.coalesce(full("std_ans"), full("answer"))
    return F.nullif(F.concat_ws("\n", F.coalesce(full("q_main"), full("q_mean")), *options, F.concat(F.lit("答案："), answer), full("answer_detail")), F.lit(""))


def paper_text(text: Column, title: Column, sections: Column) -> Column:
    """A paper's text, else its title and its sections' headings and bodies, separated by blank lines."""
    parts = F.flatten(F.transform(sections, lambda s: F.array(F.coalesce(F.nullif(s["heading"], F.lit("")), F.nullif(s["title"], F.lit(""))), F.coalesce(F.nullif(s["content"], F.lit("")), F.nullif(s["text"], F.lit(""))))))
    whole = F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.concat_ws("\n\n", F.array_compact(parts)))
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(F.regexp_replace(whole, r"\A\n+|\n+\z", ""), F.lit("")))


def repository_files(repos: DataFrame, source: str) -> DataFrame:
    """One row per file of ``repos (repo_path, repo_id, commit_id, files)`` with ``reject_reason``: vendor_file, non_permissive, missing_license, empty."""
    x = repos.select("repo_path", "repo_id", "commit_id", F.posexplode("files").alias("pos", "f"))
    licenses = F.array_join(F.array_sort(F.filter(F.coalesce("f.detected_licenses", F.array().cast("array<string>")), lambda s: s != "")), ",")
    reason = (
        F.when(F.coalesce("f.is_vendor", F.lit(False)), "vendor_file").when(F.coalesce("f.license_type", F.lit("")) == "", "missing_license")
        .when(F.col("f.license_type") != "permissive", "non_permissive").when(licenses == "", "missing_license").when(F.trim(F.coalesce("f.content", F.lit(""))) == "", "empty")
    )
    return x.select(F.lit(source).alias("source"), "repo_path", "commit_id", document_id(F.lit(source), F.coalesce("f.content_id", F.concat_ws(":", "repo_id", "pos"))).alias("doc_id"), F.col("f.content").alias("text"), F.col("f.file_path").alias("source_path"), F.col("f.language").alias("language"), licenses.alias("license"), reason.alias("reject_reason"))


def document_id(source: Column, raw: Column) -> Column:
    """``source:raw`` with runs of other signs than letters, digits, ``_ . : -`` as one ``_``, cut to 160 characters."""
    return F.concat(source, F.lit(":"), F.left(F.regexp_replace(F.regexp_replace(raw.cast("string"), "[^0-9A-Za-z_.:-]+", "_"), r"\A_+|_+\z", ""), F.lit(160)))


def fallback_id(path: Column, member: Column, row: Column) -> Column:
    """An id for rows without one, from where they are stored."""
    return F.left(F.sha2(F.concat_ws(":", path, F.coalesce(member, F.lit("")), row.cast("string")), 256), F.lit(24))


def license_text(fixed: str | None, stated: Column) -> Column:
    """The source's fixed license, else the row's; a JSON list becomes its sorted parts."""
    if fixed:
        return F.lit(fixed)
    parts = F.array_join(F.array_sort(F.filter(F.from_json(stated, "array<string>"), lambda x: x != "")), ",")
    return F.nullif(F.when(stated.startswith("["), parts).otherwise(stated), F.lit(""))


def adapt(df: DataFrame, source: str, license: str | None = None, domain: str | None = None) -> DataFrame:
    """Raw rows as (doc_id, text, source, subset, source_path, revision, license, url, language, domain, quality_prior).

    ``df`` may have any columns, ``_path`` and ``_row`` among them (where a row was read). Zero and empty values of
    a field fall through to the next one, as an absent field does.
    """
    path = F.coalesce(first_of(df, ("path", "file_path", "member", "file")), _column(df, "_path"))
    nonzero = lambda n: F.nullif(_column(df, n).try_cast("double"), F.lit(0.0))
    raw = F.coalesce(first_of(df, ID_FIELDS), fallback_id(_column(df, "_path"), _column(df, "member"), _column(df, "_row")))
    return df.select(
        document_id(F.lit(source), raw).alias("doc_id"), generic_text(df).alias("text"), F.lit(source).alias("source"), F.nullif(T.path_parent(_column(df, "_path")), F.lit("")).alias("subset"), path.alias("source_path"),
        first_of(df, ("revision", "commit_id", "dump", "date")).alias("revision"), license_text(license, first_of(df, ("license", "licenses"))).alias("license"), _column(df, "url").alias("url"),
        first_of(df, ("language", "lang")).alias("language"), F.lit(domain or "general").alias("domain"), F.coalesce(nonzero("quality_score"), nonzero("score"), nonzero("int_score")).alias("quality_prior"),
    )


def provenance(df: DataFrame, fields: list[str]) -> Column:
    """A JSON object of the named fields that are not null, in the order of their names."""
    return F.to_json(F.struct(*(F.col(f) for f in sorted(fields) if f in df.columns)))


def training_pair(df: DataFrame, prompts: dict[str, str], reverse: tuple[str, ...] = ()) -> DataFrame:
    """(id, task, messages, input_hash) of ``df (task, source, target)``: the task's prompt and the source, answered by the target; ``reverse`` tasks swap them."""
    swap = F.col("task").isin(*reverse) if reverse else F.lit(False)
    ask, say = F.when(swap, F.col("target")).otherwise(F.col("source")), F.when(swap, F.col("source")).otherwise(F.col("target"))
    prompt = F.create_map(*(F.lit(x) for kv in prompts.items() for x in kv))[F.col("task")]
    x = df.select("task", F.concat(F.coalesce(prompt, F.lit("")), ask).alias("ask"), say.alias("say"))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("ask").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("say").alias("content")))
    return x.select(F.sha2(F.to_json(F.struct("ask", "say", "task")), 256).alias("id"), "task", messages.alias("messages"), F.sha2(F.col("ask"), 256).alias("input_hash"))


MESSAGES = "messages array<struct<role:string,content:string>>, source_family string, source string, original_id string, task_type string, license string, human_verified boolean"


def conversations(rows: DataFrame, json: str = "payload", families: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Parsed conversations with their family, license and first user message; ``valid`` is false for broken JSON.

    ``families`` maps a family to ordered (substring of the source, license) rules for rows without a license.
    """
    p = F.from_json(F.when(F.try_parse_json(json).isNotNull(), F.col(json)), MESSAGES)
    x = rows.withColumn("c", p)
    rule = F.lit("unspecified")
    for family, table in (families or {}).items():
        for part, lic in reversed(table):
            rule = F.when((F.col("c.source_family") == family) & F.lower("c.source").contains(part), lic).otherwise(rule)
    user = F.get(F.filter("c.messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return x.select(*rows.columns, F.col("c.messages").alias("messages"), F.col("c.source_family").alias("source_family"), F.coalesce(F.nullif(F.nullif("c.license", F.lit("")), F.lit("unspecified")), rule).alias("license"), T.lines_normal(user).alias("first_user"), F.size(F.coalesce("c.messages", F.array().cast("array<struct<role:string,content:string>>"))).alias("turns"), F.col("c.messages").isNotNull().alias("valid"))


def unwrap(text: Column, prefix: str, suffix: str = "") -> Column:
    """A prompt without its fixed wrapping; others stay as they are."""
    wrapped = text.startswith(prefix) & (text.endswith(suffix) if suffix else F.lit(True)) & (F.length(text) >= len(prefix) + len(suffix))
    return F.when(wrapped, F.substring(text, F.lit(len(prefix) + 1), F.length(text) - len(prefix) - len(suffix))).otherwise(text)


def clean_prediction(text: Column, prefixes: tuple[str, ...]) -> Column:
    """The first line of a prediction that is not blank, without one of the prefixes."""
    first = F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    return F.trim(F.regexp_replace(F.trim(first), "^(" + "|".join(prefixes) + ")", "")) if prefixes else F.trim(first)


def cloze(rows: DataFrame, blank: str = "#idiom[0-9]+#") -> DataFrame:
    """One row per blank of ``rows (id, text, answers)``: its number, its answer and the text with the other blanks as ``____``.

    Answers beyond the blanks and blanks beyond the answers are left out.
    """
    tags = F.regexp_extract_all("text", F.lit(f"({blank})"), F.lit(1))
    x = rows.select("id", "text", "answers", F.posexplode(tags).alias("pos", "tag")).where(F.col("pos") < F.size("answers"))
    left = F.element_at(F.split("text", F.col("tag"), 2), 1)
    right = F.element_at(F.split("text", F.col("tag"), 2), 2)
    return x.select("id", "pos", F.get("answers", F.col("pos")).alias("answer"), F.concat(F.regexp_replace(left, blank, "____"), F.col("tag"), F.regexp_replace(right, blank, "____")).alias("text"))


def five_tasks(rows: DataFrame) -> DataFrame:
    """(id, task, src, gold): five evaluation tasks of each row (id, classical, modern, category, source, entity)."""
    bare = T.unpunctuated(F.col("classical"))
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), s.alias("src"), g.alias("gold")) for t, s, g in (("classify", F.col("classical"), F.col("category")), ("retrieve", F.col("classical"), F.col("source")), ("entities", F.col("classical"), F.col("entity")), ("punctuate", bare, F.col("classical")), ("translate", F.col("classical"), F.col("modern")))))
    return rows.select("id", F.explode(tasks).alias("t")).select(F.concat_ws(":", "id", "t.task").alias("id"), "t.task", "t.src", "t.gold").where("gold is not null")


def line_blocks(files: DataFrame, size: int, step: int, least: int, most: int) -> DataFrame:
    """(path, block, text): windows of ``size`` lines every ``step`` lines of ``files (path, text)`` with ``least`` to ``most`` characters."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(step))
    x = files.select("path", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(lines, i + 1, size), "\n"))).alias("block", "text"))
    return x.where(F.length(F.trim("text")).between(least, most))


def token_limit(dataset: Column, task: Column, source: Column) -> Column:
    """Generation budget by dataset and task: corrections get their source's length and a margin, choices little, texts more."""
    return F.when(task.isin("csc", "cgec", "punctuate"), F.least(F.length(source) * 2 + 32, F.lit(1024))).when(task.isin("choice", "classify"), F.lit(32)).when(dataset == "fuxi", F.lit(512)).otherwise(F.lit(256))


def edit_programs(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, src, references) of ``rows (id, src, operations)``: every text the edit programs allow, each once, in order.

    ``operations`` is JSON: Switch, a new order of the characters; Delete, positions; Insert, a list of {pos, label};
    Modify, a list of {pos, label}, where a label is one text or several alternatives and Modify replaces as many
    characters as its ``size`` says, one by default. A switch comes first; deletions, insertions and changes address
    positions of the switched text. More than ``most`` alternatives, or broken JSON, give no references.
    """
    import itertools
    import json
    from collections.abc import Iterator

    import pandas as pd

    def expand(src: str, ops: dict) -> list[str]:
        order = ops.get("Switch")
        base = [src[i] for i in order] if order else list(src)
        gone = set(ops.get("Delete") or ())
        edits = [("insert", e) for e in ops.get("Insert") or ()] + [("modify", e) for e in ops.get("Modify") or ()]
        options = [e["label"] if isinstance(e["label"], list) else [e["label"]] for _, e in edits]
        total = 1
        for o in options:
            total *= len(o)
        if total > most:
            return []
        out: dict[str, None] = {}
        for pick in itertools.product(*options):
            cells = ["" if i in gone else c for i, c in enumerate(base)]
            after: dict[int, str] = {}
            for (kind, e), text in zip(edits, pick, strict=True):
                if kind == "insert":
                    after[e["pos"]] = after.get(e["pos"], "") + text
                else:
                    for i in range(e["pos"], min(e["pos"] + e.get("size", 1), len(cells))):
                        cells[i] = text if i == e["pos"] else ""
            out["".join(after.get(-1, "") if i < 0 else cells[i] + after.get(i, "") for i in range(-1, len(cells)))] = None
        return list(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            refs = []
            for src, ops in zip(x.src, x.operations, strict=True):
                try:
                    refs.append(expand(src or "", json.loads(ops or "{}")))
                except (ValueError, KeyError, IndexError, TypeError):
                    refs.append([])
            yield pd.DataFrame({"id": x.id, "src": x.src, "references": refs})

    return rows.select("id", "src", "operations").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, src string, references array<string>")


def split_passages(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(id, block, text): paragraphs of ``rows (id, text)`` cut at the last sentence end between ``least`` and ``most`` characters.

    Paragraphs are separated by blank lines, blanks within them are one. A stretch without a sentence end there is
    cut at ``most``; a rest shorter than ``least`` is left out.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    def cut(text: str) -> list[str]:
        out = []
        for p in re.split(r"\n\s*\n", text or ""):
            p = re.sub(r"\s+", " ", p).strip()
            while len(p) >= least:
                if len(p) <= most:
                    out.append(p)
                    break
                ends = [m.end() for m in re.finditer(r"[。！？.!?；;]", p[:most]) if m.end() >= least]
                at = ends[-1] if ends else most
                out.append(p[:at].strip())
                p = p[at:].strip()
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            got = [(i, n, t) for i, text in zip(x.id, x.text, strict=True) for n, t in enumerate(cut(text))]
            yield pd.DataFrame(got, columns=["id", "block", "text"])

    return rows.select("id", "text").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, block bigint, text string")


def script_class(text: Column, traditional: str, simplified: str) -> Column:
    """traditional, simplified, mixed_or_ambiguous or shared_or_unknown by the characters only one script has, which the caller lists."""
    t, s = F.translate(text, traditional, "") != text, F.translate(text, simplified, "") != text
    return F.when(t & s, "mixed_or_ambiguous").when(t, "traditional").when(s, "simplified").when(text.isNotNull(), "shared_or_unknown")


def chapter_owners(hits: DataFrame, passages: DataFrame, most: int = 16) -> DataFrame:
    """(row_id, resolution, chapter_id) of ``hits (row_id, chapter_id, book)`` for ``passages (row_id, book)``.

    resolution: none, unique, same_book (one chapter of several lies in the passage's book), ambiguous, or unresolved
    where more than ``most`` chapters hold the passage; only unique and same_book name the chapter.
    """
    x = passages.select("row_id", F.col("book").alias("own")).join(hits, "row_id", "left")
    own = F.col("book") == F.col("own")
    a = x.groupBy("row_id").agg(F.countDistinct("chapter_id").alias("n"), F.countDistinct(F.when(own, F.col("chapter_id"))).alias("m"), F.min("chapter_id").alias("any"), F.min(F.when(own, F.col("chapter_id"))).alias("mine"))
    r = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").when(F.col("n") > most, "unresolved").when(F.col("m") == 1, "same_book").otherwise("ambiguous")
    return a.select("row_id", r.alias("resolution"), F.when(r == "unique", F.col("any")).when(r == "same_book", F.col("mine")).alias("chapter_id"))
