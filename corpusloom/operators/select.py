"""Ordered selection: budgets, quotas, strata, holdouts and sequence packing, all by distributed prefix sums or windows.

Orders that the reference takes from files are hash orders here, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.prefix import prefix_sum


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def bottom_k(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """The ``k`` rows of least key; a top-k that keeps at most ``k`` rows per task."""
    return rows.withColumn("__k", key).orderBy("__k").limit(k).drop("__k")


def hash_order(seed: int, *columns: str) -> Column:
    """An order that replaces a seeded shuffle: the same for any partitioning."""
    return T.stable_key(seed, "order", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns]))


def strata_rank(rows: DataFrame, strata: list[str], priority: str, id: str) -> DataFrame:
    """Adds ``strata_rank``: the position of a row within its stratum by priority, for round-robin order."""
    return rows.withColumn("strata_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(priority, id)))


def budget(rows: DataFrame, value: str, limit: float, order: Column, groups: list[str] | None = None, clip: bool = False) -> DataFrame:
    """Rows taken in order while the sum before them is below ``limit``; the crossing row stays.

    Adds ``taken``: the row's value, with ``clip`` cut so that the sum is the limit exactly.
    """
    x = prefix_sum(rows, F.col(value), order, groups or [], out="__before").where(F.col("__before") < limit)
    taken = F.least(F.col(value), F.lit(limit) - F.col("__before")) if clip else F.col(value)
    return x.withColumn("taken", taken).drop("__before")


def token_ranges(rows: DataFrame, value: str, order: Column, bounds: list[int]) -> DataFrame:
    """(columns, part, first, last): which tokens of each row fall into the ranges between consecutive ``bounds`` of the running sum."""
    x = prefix_sum(rows, F.col(value), order, [], out="__before")
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)))))
    x = x.select(*rows.columns, "__before", parts.alias("p"))
    first, last = F.greatest(F.lit(0), F.col("p.a") - F.col("__before")), F.least(F.col(value), F.col("p.b") - F.col("__before"))
    return x.where(first < last).select(*rows.columns, F.col("p.part").alias("part"), first.alias("first"), last.alias("last"))


def mask_labels(labels: Column, first: Column, last: Column, ignore: int = -100) -> Column:
    """Labels outside the first..last-th supervised position are ignored."""
    counted = F.transform(labels, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(labels, 1, i + 1), lambda y: y != ignore)).alias("n")))
    return F.transform(counted, lambda z: F.when((z["x"] != ignore) & (z["n"] > first) & (z["n"] <= last), z["x"]).otherwise(ignore))


def quota_fill(rows: DataFrame, quotas: DataFrame, keys: list[str], value: str, order: Column, parent: str | None = None) -> DataFrame:
    """Rows taken per key in order while the sum before them is below the key's ``quota``; the crossing row stays.

    ``quotas``: keys, quota. With ``parent`` only the first row of each parent in the order takes part.
    """
    if parent:
        first = rows.withColumn("__o", order).groupBy(parent).agg(F.min("__o").alias("__first"))
        rows = rows.join(first, parent).where(order == F.col("__first")).drop("__first")
    x = prefix_sum(rows.join(quotas, keys), F.col(value), order, keys, out="__before")
    return x.where(F.col("__before") < F.col("quota")).drop("__before", "quota")


def nested_quota(rows: DataFrame, bucket_quota: float, source_share: dict[str, float], value: str, order: Column) -> DataFrame:
    """Rows of one bucket under two limits: each source its share of the quota, then the bucket its quota, the crossing row clipped (``taken``)."""
    q = rows.sparkSession.createDataFrame([(s, float(bucket_quota * w)) for s, w in source_share.items()], "source string, quota double")
    inner = prefix_sum(rows.join(F.broadcast(q), "source"), F.col(value), order, ["source"], out="__s").where(F.col("__s") < F.col("quota"))
    inner = inner.withColumn("__v", F.least(F.col(value), F.floor(F.col("quota") - F.col("__s")))).drop("quota", "__s").where("__v > 0")
    return budget(inner, "__v", bucket_quota, order, clip=True).drop("__v")


def pick_unique(rows: DataFrame, quotas: list[tuple[str, int]], order: Column) -> DataFrame:
    """For each category in turn its quota of rows whose ``id`` no earlier category took; adds ``picked_for``."""
    out = None
    for name, n in quotas:
        free = rows.where(F.col("category") == name)
        if out is not None:
            free = free.join(out.select("id").distinct(), "id", "left_anti")
        got = bottom_k(free.dropDuplicates(["id"]), order, n).withColumn("picked_for", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def pack_sequences(docs: DataFrame, tokens: Column, length: int, order: Column) -> DataFrame:
    """(sequence, doc_id, first, count): documents and an end mark each, laid end to end and cut every ``length`` tokens.

    ``first`` is the document's first token in the sequence and ``count`` the number of its tokens there, the end
    mark included. Documents may span sequences; only the last sequence is shorter.
    """
    x = prefix_sum(docs.withColumn("__n", tokens + 1), F.col("__n"), order, [], out="__at")
    seqs = F.explode(F.sequence(F.floor(F.col("__at") / length), F.floor((F.col("__at") + F.col("__n") - 1) / length)))
    x = x.select("doc_id", "__at", "__n", seqs.alias("sequence"))
    begin, end = F.greatest(F.col("__at"), F.col("sequence") * length), F.least(F.col("__at") + F.col("__n"), (F.col("sequence") + 1) * length)
    return x.select("sequence", "doc_id", (begin - F.col("__at")).alias("first"), (end - begin).alias("count"))


def sequences(docs: DataFrame, length: int, end_mark: int, order: Column) -> DataFrame:
    """(sequence, input_ids, token_count, document_ids) from ``docs (doc_id, input_ids)``; the ids of each sequence in order."""
    rows = docs.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(end_mark).cast("bigint"))))
    cut = pack_sequences(docs.withColumn("__n0", F.size("input_ids")), F.col("__n0"), length, order)
    cut = cut.join(rows.select("doc_id", "input_ids", order.alias("__o")), "doc_id").select("sequence", "doc_id", "__o", F.slice("input_ids", F.col("first").cast("int") + 1, F.col("count").cast("int")).alias("ids"))
    parts = cut.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("__o", "doc_id", "ids"))).alias("p"))  # at most ``length`` parts
    ids = F.flatten(F.transform("p", lambda z: z["ids"]))
    return parts.select("sequence", ids.alias("input_ids"), F.size(ids).alias("token_count"), F.transform("p", lambda z: z["doc_id"]).alias("document_ids"))


def sequence_length(doc: Column, weights: dict[int, float], seed: int) -> Column:
    """The length group of a document, drawn by its stable fraction from cumulative weights."""
    f, out, total = T.stable_fraction(seed, "length", doc), F.lit(None).cast("int"), sum(weights.values())
    upper = 1.0
    for n, w in reversed(list(weights.items())):
        out = F.when(f < upper, n).otherwise(out) if out is not None else F.lit(n)
        upper -= w / total
    return out


def holdout_groups(groups: list[dict], capacity: dict[str, int], least_train: float = 0.8, book_cap: int = 3) -> set[str]:
    """Group ids held out for dev, from group rows (doc, book, task, n): rare tasks first, least used books first, at most ``book_cap`` groups per book, a task keeps ``least_train`` of its rows for training.

    Runs on the aggregated group table, which the caller bounds.
    """
    total: Counter = Counter()
    for g in groups:
        total[g["task"]] += g["n"]
    used: Counter = Counter()
    held: set[str] = set()
    for task in sorted(capacity, key=lambda t: (total[t], t)):
        own, taken = sorted((g for g in groups if g["task"] == task), key=lambda g: (g["doc"] or "", g["book"] or "")), 0
        while own and taken < capacity[task]:
            g = min(own, key=lambda g: (used[g["book"]], g["n"], g["doc"] or ""))
            own.remove(g)
            if g["doc"] in held or used[g["book"]] >= book_cap or taken + g["n"] > capacity[task] or taken + g["n"] > (1 - least_train) * total[task] + 1e-9:
                continue
            held.add(g["doc"])
            used[g["book"]] += 1
            taken += g["n"]
    return held


def holdout(groups: DataFrame, capacity: dict[str, int], least_train: float = 0.8, book_cap: int = 3) -> set[str]:
    """What ``holdout_groups`` gives for all ``groups (doc, book, task, n)``, whatever their number.

    A task takes books in the order of their use, and among books used equally often groups by size and name. So
    it is filled level by level of use, and a level needs few groups: with room for ``r`` rows at most ``r`` groups
    are taken there, hence a group behind ``r`` others of its book or of its doc that fit is never reached, and of
    the rest only the first r + 2r(r + 1) are. These are ranked in Spark, and only they are collected.
    """
    groups = groups.where(F.col("task").isin(list(capacity)))
    total: Counter = Counter({r["task"]: r["n"] for r in groups.groupBy("task").agg(F.sum("n").alias("n")).collect()})
    used: Counter = Counter()
    held: set[str] = set()
    for task in sorted(capacity, key=lambda t: (total[t], t)):
        room = min(capacity[task], int((1 - least_train) * total[task] + 1e-9))
        for level in range(book_cap):
            if room < 1:
                break
            own = groups.where((F.col("task") == task) & (F.col("n") <= room))
            if level:
                own = own.where(F.col("book").isin([b for b, u in used.items() if u == level]))
            elif used:
                own = own.where(~F.col("book").isin(list(used)))
            if held:
                own = own.where(~F.col("doc").isin(list(held)))
            own = first_n(own.select("doc", "book", "n"), ["book"], [F.col("n"), F.col("doc")], room + 1)
            own = first_n(own, ["doc"], [F.col("n"), F.col("book")], room + 1)
            own = own.orderBy("n", "doc", "book")
            for most in (8 * room, room + 2 * room * (room + 1)):  # the first few are nearly always enough
                books, docs, left = set(), set(), room
                rows = own.limit(most).collect()
                for g in rows:
                    if g["n"] > left:
                        break
                    if g["book"] not in books and g["doc"] not in docs:
                        books.add(g["book"])
                        docs.add(g["doc"])
                        left -= g["n"]
                else:
                    if len(rows) == most:
                        continue
                break
            room = left
            held |= docs
            used.update(books)
    return held


def padding(rows: DataFrame, multiple: int, pad: dict) -> DataFrame:
    """``rows`` and as many padding rows as make their number a multiple."""
    short = -rows.count() % multiple
    if not short:
        return rows
    return rows.unionByName(rows.sparkSession.createDataFrame([pad] * short, rows.schema))


def char_scores(docs: DataFrame, chars: DataFrame) -> DataFrame:
    """(doc_id, score): the sum over a document's distinct wanted characters of 1 / sqrt(df + 1).

    ``chars``: char, df. Documents without a wanted character are left out.
    """
    own = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("char"))
    return own.join(chars, "char").groupBy("doc_id").agg(F.sum(1 / F.sqrt(F.col("df") + 1)).alias("score"))


def coverage_pick(docs: list[dict], goals: tuple[int, ...], df: dict[str, int], limit: int, source_cap: int) -> list[str]:
    """Greedy rare-character coverage on slim rows (id, source, tokens, chars, score): for each goal, characters by rising df, best documents until each is covered that often, within the token limit and a cap per source."""
    have: Counter = Counter()
    size, per = 0, Counter()
    chosen: dict[str, None] = {}
    by_char: dict[str, list[dict]] = {}
    for d in sorted(docs, key=lambda d: (-d["score"], d["id"])):
        for c in set(d["chars"]):
            by_char.setdefault(c, []).append(d)
    for goal in goals:
        for c in sorted(df, key=lambda c: (df[c], c)):
            for d in by_char.get(c, ()):
                if have[c] >= goal:
                    break
                if d["id"] in chosen or size + d["tokens"] > limit or per[d["source"]] + d["tokens"] > source_cap:
                    continue
                chosen[d["id"]] = None
                size += d["tokens"]
                per[d["source"]] += d["tokens"]
                have.update(set(d["chars"]))
    return list(chosen)
