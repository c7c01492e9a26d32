"""Source divergence audit by joint count histograms (operator 11).

Per language, each source's distribution over the kept terms is compared with every other
source's and with the language's. A probability is an integer, 1 + floor(SCALE * (count +
ALPHA) / (N + ALPHA * V)), so all sums are exact.

The sum of f(p, q) over all terms of a pair of sources depends on the two counts of a term
alone. So each pair is a histogram of (count, count) combinations: terms are dealt in
buckets, a bucket tallies the combinations of its terms for all pairs at once, and the
tallies are added up. A pair's cells with a zero are implied and never counted term by
term: (c, 0) is what the first source's own histogram has at c less what the pair's tally
holds, (0, c) likewise, and (0, 0) is what then lacks of V. Then f is evaluated once per combination and
multiplied by how often it occurs.

A source, or a term, that holds much of the corpus comes as one count per task; a bucket
is cut by terms, whatever their sources. What grows with the square of the number of
sources of a language is the result itself.

Null text, language and source count as the empty string; a group without terms, and a
language without kept terms (V = 0), has value 0 in all its pairs and no terms; repeated
rows count as often as they stand; texts are read whole; an empty table gives nothing; ties
go by the item's UTF-8 bytes. Only the columns named are read, so others clash with nothing.
Counts are exact up to N + ALPHA * V of 9 * 10**15.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, join_checked, text_chunks
from paneflow.llm.wordhash import LOWER, buffers, named, row_of, runs

#: Bytes of terms: letters and all that is not ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
#: A term is kept where so many documents of the language hold it.
LEAST = 30
SCALE, ALPHA = 1_000_000_000, 5
#: Ranks of the part ``term``.
TOP = 50
#: Distinct (language, source, term) that a task gathers before it sends them on; cells that a bucket holds, about.
GATHERED, PER_BUCKET = 300_000, 50_000


def _batch_counts(batch: pa.RecordBatch):
    """Tables (lang, source, term, n, d) of the chunks of a batch: occurrences, and rows that hold the term."""
    for first, last, texts in text_chunks(batch, "text"):
        data, offs = buffers(texts)
        data = LOWER[data]
        starts, ends = runs(TERM[data], offs)
        if not len(starts):
            continue
        held = [batch.column(c).slice(first, last - first).dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in held)
        terms = named(data, starts, ends)
        row, code, width = row_of(np.searchsorted(starts, offs)), terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        group = lang * len(held[1].dictionary) + source
        key, n = np.unique(group[row] * width + code, return_counts=True)
        once = np.unique(row * width + code)
        d = np.bincount(np.searchsorted(key, group[once // width] * width + once % width), minlength=len(key))
        group = key // width
        yield pa.table({
            "lang": held[0].dictionary.take(pa.array(group // len(held[1].dictionary))),
            "source": held[1].dictionary.take(pa.array(group % len(held[1].dictionary))),
            "term": terms.dictionary.take(pa.array(key % width)).cast(pa.large_string()),
            "n": n.astype(np.int64), "d": d.astype(np.int64)})


def _gathered(batches):
    def summed(tables):
        return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")]).rename_columns(["lang", "source", "term", "n", "d"])

    def out(table):
        return table.select(["lang", "source", "term", "n", "d"]).cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])).combine_chunks().to_batches(max_chunksize=20_000)

    held, rows = [], 0
    for batch in batches:
        for table in _batch_counts(batch):
            held.append(table)
            rows += len(table)
        if rows > GATHERED:
            held = [summed(held)]
            rows = len(held[0])
            if rows > GATHERED // 2:
                yield from out(held[0])
                held, rows = [], 0
    if held:
        yield from out(summed(held))


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total, first: occurrences of each kept term in a source and in its language.

    ``first`` is 1 on one row per (lang, term). The cells are summed and the documents of a term counted
    after one shuffle, by language and term.
    """
    rows = docs.mapInArrow(_gathered, "lang string, source string, term string, n bigint, d bigint").repartition("lang", "term")
    cells = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    marked = cells.withColumns({"df": F.sum("d").over(term), "total": F.sum("n").over(term), "place": F.row_number().over(term.orderBy("source"))})
    return marked.where(F.col("df") >= least).select("lang", "source", "term", "n", "total", (F.col("place") == 1).cast("int").alias("first"))


def probability(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ALPHA) / (size + ALPHA * terms)), by long division in three steps of 1000; 1 where there are no terms."""
    whole = F.nullif(size + ALPHA * terms, F.lit(0).cast("long"))
    rest, out = count.cast("long") + ALPHA, F.lit(0).cast("long")
    for _ in range(3):
        moved = rest * 1000
        rest = moved % whole
        out = out * 1000 + F.call_function("div", moved, whole)
    return F.coalesce(out + 1, F.lit(1).cast("long"))


def _tally(table: pa.Table) -> pa.Table:
    """Of the cells of one bucket: how often each (count, count) occurs of each pair of sources, both above 0."""
    lang = table.column("lang")[0].as_py()
    names, source = np.unique(np.array(table.column("source").to_pylist(), dtype=object), return_inverse=True)
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    counts, value = np.unique(table.column("n").to_numpy(), return_inverse=True)
    counts, value = np.append(0, counts), value + 1
    order = np.argsort(source, kind="stable")
    source, term, value = source[order], term[order], value[order]
    bounds = np.searchsorted(source, np.arange(len(names) + 1))
    held = np.zeros(int(term.max()) + 1, dtype=np.int64)
    parts = []
    for a in range(len(names) - 1):
        own = slice(bounds[a], bounds[a + 1])
        held[term[own]] = value[own]
        rest = bounds[a + 1] + np.flatnonzero(held[term[bounds[a + 1] :]])
        key, m = np.unique((source[rest] * len(counts) + held[term[rest]]) * len(counts) + value[rest], return_counts=True)
        parts.append((np.full(len(key), a), key // len(counts) ** 2, counts[key // len(counts) % len(counts)], counts[key % len(counts)], m))
        held[term[own]] = 0
    a, b, ca, cb, m = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 5
    names = pa.array(names.tolist(), pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "ca": ca.astype(np.int64), "cb": cb.astype(np.int64), "m": m.astype(np.int64)})


def joint_histograms(cells: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """lang, a, b, ca, cb, m: how many terms have these counts in the two sources of each of ``pairs``, but those in neither."""
    dealt = cells.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    both = dealt.groupBy("lang", "bucket").applyInArrow(_tally, "lang string, a string, b string, ca bigint, cb bigint, m bigint")
    both = both.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    # (c, 0) and (0, c): the source's own histogram less what the pair has at c
    own = cells.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    every, zero = both, F.lit(0).cast("long")
    for side in "ab":
        ca, cb = (F.col("c"), zero) if side == "a" else (zero, F.col("c"))
        alone = pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side])
        met = both.select("lang", "a", "b", F.col(f"c{side}").alias("c"), (-F.col("m")).alias("m"))
        every = every.unionByName(alone.unionByName(met, allowMissingColumns=True).select("lang", "a", "b", ca.alias("ca"), cb.alias("cb"), "m"))
    every = every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    return every.where("m > 0")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: per source its distance to each other one, and its ``top`` terms above the language's share."""
    space = Workspace(docs.sparkSession, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    cells = space.table(term_counts(rows, least), "cells")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("terms"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("terms", F.lit(0)).cast("long").alias("first"))
    lang = Window.partitionBy("lang")
    groups = space.table(groups.select("lang", "source", "size", F.sum("size").over(lang).alias("all"), F.sum("first").over(lang).alias("terms")), "groups")
    a, b = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("na"), "terms"), groups.select("lang", F.col("source").alias("b"), F.col("size").alias("nb"))
    pairs = space.table(a.join(b, "lang").where("a < b"), "pairs")  # of sources of a language: the result has each of them twice
    tallied = joint_histograms(cells, pairs, 1 + cells.count() // PER_BUCKET)
    joined = join_checked(tallied, pairs, ["lang", "a", "b"])

    def gap(ca: Column, cb: Column) -> Column:
        return F.abs(probability(ca, F.col("na"), F.col("terms")) - probability(cb, F.col("nb"), F.col("terms")))

    sums = joined.groupBy("lang", "a", "b").agg(F.sum("m").alias("seen"), F.sum(F.col("m") * gap(F.col("ca"), F.col("cb"))).alias("part"))
    zero = F.lit(0).cast("long")
    value = F.coalesce("part", zero) + (F.col("terms") - F.coalesce("seen", zero)) * gap(zero, zero)
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    between = valued.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    p, q = probability(F.col("n"), F.col("size"), F.col("terms")), probability(F.col("total"), F.col("all"), F.col("terms"))
    above = join_checked(cells, groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    highest = above.withColumn("rank", rank).where(F.col("rank") <= top)
    return between.withColumn("rank", rank).unionByName(highest)
