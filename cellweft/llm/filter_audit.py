"""How filters overlap: what each removes in every order of application, per part of a table.

For each part and each range of row numbers there is one sorted list of row numbers per
filter (the rows that fail it) and per mark (rows that are labelled). What a filter
removes after others is the difference of its list and the union of theirs. Unions and
differences come from merges that gallop: a list is skipped to the next number of interest by
doubling steps and a search in the last one. Ranges share no numbers, so sizes just add
up, and a part that holds all rows is still many short lists.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import materialize, table

FILTERS = "ABCDE"
RANGE = 1 << 16  # row numbers per range: the bound of a list
LARGEST = 2**63 - 1


def gallop(ids: list[int], x: int, at: int) -> int:
    """The first place from `at` on whose number is not below x."""
    step, end = 1, at
    while end < len(ids) and ids[end] < x:
        at, end, step = end + 1, end + step, 2 * step
    return bisect_left(ids, x, at, min(end, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted union: the list with the smallest head is copied up to the next head of the others."""
    heap = [(ids[0], i, 0) for i, ids in enumerate(lists) if ids]
    heapq.heapify(heap)
    out: list[int] = []
    while len(heap) > 1:
        x, i, at = heapq.heappop(heap)
        ids, limit = lists[i], heap[0][0]
        end = at + 1 if x == limit else gallop(ids, limit, at + 1)
        if x != limit:  # else another list gives this number
            out.extend(ids[at:end])
        if end < len(ids):
            heapq.heappush(heap, (ids[end], i, end))
    for _, i, at in heap:
        out.extend(lists[i][at:])
    return out


def difference(ids: list[int], less: list[int]) -> list[int]:
    """Sorted numbers of `ids` that are not in `less`: runs between two numbers of it are copied."""
    out, at, other = [], 0, 0
    while at < len(ids):
        other = gallop(less, ids[at], other)
        if other == len(less):
            return out + ids[at:]
        end = gallop(ids, less[other], at)
        out.extend(ids[at:end])
        at = end + (end < len(ids) and ids[end] == less[other])
    return out


def overlap(a: list[int], b: list[int]) -> int:
    """Numbers in both; the shorter list leads."""
    return len(a) - len(difference(a, b)) if len(a) <= len(b) else len(b) - len(difference(b, a))


def _audit_ranges(names: str, marks: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                failing = [row[f].tolist() for f in names]
                marked = [row[m].tolist() for m in marks]
                before: list[list[int]] = [[]]  # unions by set of filters
                for s in range(1, 1 << len(names)):
                    before.append(union([failing[i] for i in range(len(names)) if s >> i & 1]))
                for s, gone in enumerate(before):
                    for i, f in enumerate(names):
                        if not s >> i & 1:
                            removed = difference(failing[i], gone)
                            out.append((row["part"], f, s, row["n"], len(failing[i]), len(before[s | 1 << i]), len(removed), *[overlap(removed, m) for m in marked]))
            yield pd.DataFrame(out, columns=["part", "filter", "before", "n", "failing", "gone", "removed", *marks])

    return run


def posting_lists(rows: DataFrame, fails: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """One row per part and range of row numbers: part, n (rows) and a sorted list of row numbers per filter and mark.

    `rows` has a column part. It is written once, so that numbers are the same in every attempt of a task.
    """
    flags = rows.select("part", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in (fails | marks).items()])
    numbered = materialize(flags, "audit").withColumn("row", F.monotonically_increasing_id())
    lists = [F.array_sort(F.collect_list(F.when(F.col(k), F.col("row")))).alias(k) for k in (*fails, *marks)]
    return numbered.groupBy("part", F.shiftright("row", RANGE.bit_length() - 1).alias("range")).agg(F.count("*").alias("n"), *lists)


def interactions(lists: DataFrame, names: str, marks: tuple[str, ...]) -> DataFrame:
    """For every part, filter and set of filters applied before (bits in the order of `names`): n, failing, gone, removed and marks.

    failing: rows that fail the filter; gone: rows that the set and the filter remove
    together; removed: rows that only the filter removes now; marks: how many of these are marked.
    """
    schema = "part string, filter string, before int, n long, failing long, gone long, removed long" + "".join(f", {m} long" for m in marks)
    sizes = lists.mapInPandas(_audit_ranges(names, marks), schema)
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("n", "failing", "gone", "removed", *marks)])


def audit_filters(rows: DataFrame, fails: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, a count per mark, shapley.

    `rows` has a column part (string); `fails` gives a one-letter name and the failure
    condition of each filter, `marks` a name and condition of rows to be counted among the
    removed ones. Null conditions are false. shapley: rows that the filter removes, summed
    over all orders. Every row counts, repeats included. Other columns of `rows` are not
    looked at. A part has all its rows, zeros included; an empty table has none.
    """
    names, bit = "".join(fails), {f: 1 << i for i, f in enumerate(fails)}
    sums = interactions(posting_lists(rows, fails, marks), names, tuple(marks))
    plan = [("".join(o), k + 1, o[k], sum(bit[f] for f in o[:k])) for o in permutations(names) for k in range(len(names))]
    steps = rows.sparkSession.createDataFrame(plan, "filter_order string, step int, filter string, before int")
    of_filter = Window.partitionBy("part", "filter")
    last = F.col("before") == sum(bit.values()) - F.create_map(*[F.lit(x) for kv in bit.items() for x in kv])[F.col("filter")]
    unique = F.max(F.when(last, F.col("removed"))).over(of_filter)
    both = sums.withColumn("unique_fails", unique).join(F.broadcast(steps), ["filter", "before"])  # as many rows as orders times filters
    return both.select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", *marks, F.sum("removed").over(of_filter).alias("shapley"),
    )


def text_facts(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, lang): part, doc_id, words, distinct_words, capitals, chars, symbols, repeats.

    repeats: whether a smaller doc_id has the same text (by SHA-256). Of equal doc_ids
    none is smaller; a null doc_id is larger than all others. Null texts are empty ones, null
    lang is the part ''. The first doc_id of a text is found by a grouped minimum and
    brought back by a join on text and doc_id, so that a text of which there are many copies is no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        F.coalesce("lang", F.lit("")).alias("part"), "doc_id", F.coalesce("doc_id", F.lit(LARGEST)).cast("long").alias("_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), F.char_length(text).alias("chars"), text.rlike("[#$%&*|]").alias("symbols"),
    )
    facts = split.withColumns({"words": F.size("_words"), "distinct_words": F.size(F.array_distinct("_words"))}).drop("_words")
    facts = materialize(facts, "facts")
    first = facts.groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    return facts.join(first, ["_text", "_id"], "left").withColumn("repeats", F.col("_first").isNull()).drop("_text", "_id", "_first")


def label_marks(labels: DataFrame) -> DataFrame:
    """One row per doc_id of `labels`: whether any of its rows has quality 1, and toxic 1."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("_good"), one("toxic").alias("_toxic"))


def op11_filter_audit(spark, sf_dir):
    facts = text_facts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    rows = facts.join(label_marks(table(spark, sf_dir, "labels")), "doc_id", "left")
    fails = {
        "A": F.col("words") < 100,
        "B": 100 * F.col("distinct_words").cast("long") < 80 * F.col("words").cast("long"),
        "C": 100 * F.col("capitals").cast("long") > 10 * F.col("chars").cast("long"),
        "D": F.col("symbols"),
        "E": F.col("repeats"),
    }
    return audit_filters(rows, fails, {"good_lost": F.col("_good"), "toxic_lost": F.col("_toxic")})


SQL_OP11 = r"""
with d as (
    select coalesce(lang, '') part, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
        coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) over (partition by coalesce(text, '')) e
    from documents),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels where doc_id is not null group by doc_id),
m as (
    select part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * e::int mask,
        count(*) n, count(*) filter (good) g, count(*) filter (toxic) x
    from d left join l using (doc_id) group by all),
f(f, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
    select a.f || b.f || c.f || d.f || e.f filter_order, [a.b, b.b, c.b, d.b, e.b] bits
    from f a, f b, f c, f d, f e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, step, bits[step] b, coalesce(list_sum(bits[1:step - 1]), 0)::int p from o, (select unnest(range(1, 6))::int step)),
r as (
    select part, filter_order, step, b, coalesce(sum(n) filter (mask & (p | b) = 0), 0)::bigint kept,
        coalesce(sum(n) filter (mask & p = 0 and mask & b > 0), 0)::bigint removed, coalesce(sum(n) filter (mask & p > 0 and mask & b > 0), 0)::bigint redundant,
        coalesce(sum(n) filter (mask = b), 0)::bigint unique_fails, coalesce(sum(g) filter (mask & p = 0 and mask & b > 0), 0)::bigint good_lost,
        coalesce(sum(x) filter (mask & p = 0 and mask & b > 0), 0)::bigint toxic_lost
    from m, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, b))::bigint shapley from r
"""
