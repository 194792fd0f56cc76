"""Removal of benchmark material by exact hashes, shared windows and contained passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import materialize, small

CHARS, WORDS = 32, 13
def char_windows(text: Column) -> Column:
    return T.char_grams(T.compact(text), CHARS)


def word_windows(text: Column) -> Column:
    return T.windows(T.words(text), WORDS)


def benchmark_index(items: DataFrame) -> DataFrame:
    """(kind, h): distinct hashes of whole texts (exact), 32-character (chars) and 13-word windows (words) of ``items (text)``."""
    t = items.where("text is not null and text <> ''")
    exact = t.select(F.lit("exact").alias("kind"), F.xxhash64(T.content_hash(F.col("text"))).alias("h"))
    chars = t.select(F.lit("chars").alias("kind"), F.explode(char_windows(F.col("text"))).alias("g")).select("kind", F.xxhash64("g").alias("h"))
    words = t.select(F.lit("words").alias("kind"), F.explode(word_windows(F.col("text"))).alias("g")).select("kind", F.xxhash64("g").alias("h"))
    return exact.unionByName(chars).unionByName(words).distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, reason): documents that hold benchmark text: exact, chars (two or more positions) or words.

    ``docs``: doc_id, text, language. Texts in Chinese or mixed are tested by 32-character windows, others by
    13-word windows. Positions count, not distinct windows. Only hashes are exploded, they meet the index before
    any shuffle where it is small, and hits are counted per document.
    """
    index = benchmark_index(items)
    wide = F.col("language").isin("zh", "zh_en_mixed")
    t = docs.where("text is not null and text <> ''").select("doc_id", "text", wide.alias("wide"))
    grams = F.when(F.col("wide"), char_windows(F.col("text"))).otherwise(word_windows(F.col("text")))
    kind = F.when(F.col("wide"), "chars").otherwise("words")
    probes = t.select("doc_id", kind.alias("kind"), F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h"))
    whole = t.select("doc_id", F.lit("exact").alias("kind"), F.xxhash64(T.content_hash(F.col("text"))).alias("h"))
    hits = whole.unionByName(probes).join(small(index), ["kind", "h"], "left_semi").groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "chars", "words")))
    reason = F.when(F.col("exact") > 0, "exact").when(F.col("chars") >= 2, "chars").when(F.col("words") >= 1, "words")
    return hits.select("doc_id", reason.alias("reason")).where("reason is not null")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark material."""
    return docs.join(contamination(docs, items).select("doc_id"), "doc_id", "left_anti")


def contained_passages(texts: DataFrame, passages: DataFrame, anchor: int = 24) -> DataFrame:
    """(row_id, item_id): texts that contain a whole passage of ``anchor`` characters or more, in NFKC, without case and white space.

    A passage's first ``anchor`` characters are its join key against all windows of the texts; the whole passage
    is then looked up in the text.
    """
    flat = lambda c: T.compact(T.nfkc_casefold(c))
    p = passages.select("item_id", flat(F.col("text")).alias("p")).where(F.length("p") >= anchor).select("item_id", "p", F.lit(anchor).alias("k"))
    t = texts.select("row_id", flat(F.col("text")).alias("t"))
    return _containing(t, p, "item_id", [anchor]).select("row_id", "item_id").distinct()


def _containing(texts: DataFrame, passages: DataFrame, name: str, sizes: list[int]) -> DataFrame:
    """(row_id, ``name``) of the ``texts (row_id, t)`` that contain all of a passage of ``passages (name, p, k)``.

    A passage's first ``k`` characters (one of ``sizes``) are looked up among the texts' windows of that length.
    Only numbers and hashes are exploded and shuffled; the texts of the windows found come in afterwards, once each.
    """
    t = materialize(texts.where("t is not null").select(F.xxhash64("row_id", "t").alias("__t"), "row_id", "t").dropDuplicates(["__t", "row_id"]), "texts")
    p = materialize(passages.select(F.xxhash64(name, "p").alias("__p"), name, "p", "k").distinct(), "passages")
    hashed = lambda k: F.transform(T.char_grams(F.col("t"), k), lambda g: F.xxhash64(g, F.lit(k)))
    windows = F.flatten(F.array(*map(hashed, sizes))) if sizes else F.array().cast("array<bigint>")
    heads = p.select("__p", F.xxhash64(F.left("p", F.col("k")), F.col("k").cast("int")).alias("h"))
    found = t.select("__t", F.explode(F.array_distinct(windows)).alias("h")).join(small(heads), "h").select("__t", "__p").distinct()
    return found.join(t, "__t").join(p, "__p").where(F.col("t").contains(F.col("p"))).select("row_id", name)


def shared_spans(texts: DataFrame, passages: DataFrame, span: int = 24, step: int = 12) -> DataFrame:
    """(row_id, item_id): texts that share a run of ``span`` characters with a passage, tested at every ``step``-th position and the tail."""
    flat = lambda c: T.unpunctuated(c)
    p = passages.select("item_id", flat(F.col("text")).alias("p")).where(F.length("p") >= span)
    last = F.length("p") - span + 1
    at = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last)))
    anchors = p.select("item_id", F.explode(F.transform(at, lambda i: F.substring("p", i, F.lit(span)))).alias("g")).distinct()
    t = texts.select("row_id", F.explode(F.array_distinct(T.char_grams(flat(F.col("text")), span))).alias("g"))
    return t.join(small(anchors), "g").select("row_id", "item_id").distinct()


def locate(passages: DataFrame, chapters: DataFrame, key: int = 16) -> DataFrame:
    """(row_id, chapter_id): chapters that contain a passage, without punctuation and white space.

    The passage's first ``key`` characters (all of a shorter one; fewer than three have no chapter) are looked up
    among the chapters' windows of that length, then the whole passage in the chapter.
    """
    p = passages.select("row_id", T.unpunctuated(F.col("text")).alias("p")).where(F.length("p") >= 3).withColumn("k", F.least(F.length("p"), F.lit(key)))
    p = materialize(p, "wanted")
    sizes = sorted(r[0] for r in p.select("k").distinct().collect())  # at most ``key`` lengths
    c = chapters.select(F.col("chapter_id").alias("row_id"), T.unpunctuated(F.col("text")).alias("t"))
    found = _containing(c, p.withColumnRenamed("row_id", "passage"), "passage", sizes)
    return found.select(F.col("passage").alias("row_id"), F.col("row_id").alias("chapter_id")).distinct()


def boundary_conflicts(train: DataFrame, dev: DataFrame, least: int = 8, span: int = 24) -> DataFrame:
    """(row_id, reason): training records that must not stay beside the dev records, with the first reason that holds.

    Both sides: row_id, chapter, book, near_group, translation, text and, where there is one, modern. Reasons in
    order: chapter, book (where one side has no chapter), near_group, parallel_translation, dev_text_in_train,
    train_text_in_dev (8 characters or more), shared_24_char_span; the last three first by text, then by modern,
    each against both texts of the dev records. Null keys tie nothing. Windows travel as hashes beside a text's
    number, and texts meet only where a window did.
    """
    out = None
    keyed = (("chapter", "chapter"), ("book", "book"), ("near_group", "near_group"), ("translation", "parallel_translation"))
    loose = F.col("chapter").isNull()
    for i, (c, reason) in enumerate(keyed):
        named = dev.where(F.col(c).isNotNull())
        if c == "book":
            hit = train.where(loose).join(named.select(c).distinct(), c, "left_semi").unionByName(train.join(named.where(loose).select(c).distinct(), c, "left_semi"))
        else:
            hit = train.join(named.select(c).distinct(), c, "left_semi")
        hit = hit.select("row_id", F.lit(i).alias("n"), F.lit(reason).alias("reason"))
        out = hit if out is None else out.unionByName(hit)

    def sides(x: DataFrame) -> DataFrame:
        own = F.array(*(T.unpunctuated(F.col(c)) for c in ("text", "modern") if c in x.columns))
        t = x.select("row_id", F.posexplode(own).alias("pos", "t")).where("t <> ''")
        size = F.length("t")
        return materialize(t.select(F.xxhash64("row_id", "pos").alias("id"), "row_id", "pos", "t", F.when(size >= span, span).otherwise(F.least(size, F.lit(least))).alias("k")), "sides")

    def windows(x: DataFrame, k: int) -> DataFrame:
        return x.where(F.length("t") >= k).select("id", F.explode(F.array_distinct(F.transform(T.char_grams(F.col("t"), k), lambda g: F.xxhash64(g)))).alias("h"))

    def heads(x: DataFrame, k: int) -> DataFrame:
        return x.where(F.col("k") == k).select(F.col("id").alias("inner"), F.col("t").alias("p"), F.xxhash64(F.substring("t", 1, k)).alias("h"))

    def holds(found: DataFrame, outer: DataFrame) -> DataFrame:
        """(id, inner) of the windows ``found (id, h, p, ...)`` whose text in ``outer`` holds the whole of ``p``."""
        return found.join(outer.select("id", "t"), "id").where(F.col("t").contains(F.col("p")))

    def add(ids: DataFrame, n: int, reason: str) -> None:
        nonlocal out
        hit = a.join(ids.distinct(), "id", "left_semi").select("row_id", (F.col("pos") * 3 + n).alias("n"), F.lit(reason).alias("reason"))
        out = out.unionByName(hit)

    a, b = sides(train), sides(dev)
    shared = materialize(windows(a, span).join(windows(b, span).select("h").distinct(), "h", "left_semi").select("id", "h"), "shared")
    add(shared.select("id"), 6, "shared_24_char_span")
    for k in [r[0] for r in b.select("k").distinct().collect()]:  # at most ``least`` + 1 lengths
        p = heads(b, k).select("h", "p").distinct()
        add(holds((shared if k == span else windows(a, k)).join(p, "h"), a).select("id"), 4, "dev_text_in_train")
    for k in [r[0] for r in a.where(F.col("k") >= least).select("k").distinct().collect()]:
        p = heads(a, k)
        found = windows(b, k).join(p.select("h").distinct(), "h", "left_semi").join(p, "h")
        add(holds(found, b).select(F.col("inner").alias("id")), 5, "train_text_in_dev")
    return out.groupBy("row_id").agg(F.min_by("reason", "n").alias("reason"))
