"""How far the sources of a language differ in their terms, counted by digests and written out with strings at the end."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty
from partwright.session import cut_lineage

#: Terms of sources a task holds before it hands on what it has counted so far: bounds memory, not results.
HELD = 400_000
SCALE = 1_000_000_000
SMOOTH = 5
#: Every byte that is no term byte is a space, A-Z is lower-cased. Bytes of other characters are above 0x7F.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The maximal runs of ASCII letters and other characters beyond ASCII, only A-Z lower-cased, as UTF-8."""
    return text.encode().translate(TERM_BYTES).split()


def partial_counts(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """``lang, digest, term, df, sources, counts``: per language and term its documents, the sources that have it and its
    occurrences in each, summed per task as far as memory allows; a row without term names the sources a task meets.
    Written once; the columns are read apart."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[str, dict[str, Counter]] = {}
        documents: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            lang, term, df, sources, counts = [], [], [], [], []
            for g, own in occurrences.items():
                by: dict[bytes, tuple[list, list]] = {t: ([], []) for t in documents[g]}
                for s, found in sorted(own.items()):
                    for t, n in found.items():
                        of, ns = by[t]
                        of.append(s)
                        ns.append(n)
                lang += [g] * (len(by) + 1)
                term += [None, *by]
                df += [0, *documents[g].values()]
                sources += [sorted(own), *(of for of, _ in by.values())]
                counts += [[0] * len(own), *(ns for _, ns in by.values())]
            occurrences.clear()
            documents.clear()
            return pa.record_batch(
                [pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(df, pa.int64()), pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["lang", "term", "df", "sources", "counts"],
            )

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = terms(text)
                occurrences.setdefault(lang, {}).setdefault(source, Counter()).update(own)
                documents.setdefault(lang, Counter()).update(set(own))
            if sum(len(c) for own in occurrences.values() for c in own.values()) > HELD:
                yield rows()
        yield rows()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*named, text_or_empty("text").alias("text")).mapInArrow(count, "lang string, term string, df long, sources array<string>, counts array<long>")
    digest = F.xxhash64("term").bitwiseAND((1 << digest_bits) - 1 if digest_bits < 64 else -1)
    return cut_lineage(counted.select("lang", F.when(F.col("term").isNotNull(), digest).alias("digest"), "term", "df", "sources", "counts"))


def _by_term(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """One row per term of a language in at least ``least`` documents, with its count in every source that has it.

    Tasks have one row per term, so no key is hot: rows are dealt out by language and term once, both sums follow.
    """
    dealt = counts.repartition("lang", *keys).select("lang", *keys, F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "e"), "df")
    once = F.when(F.col("at") == 0, F.col("df")).otherwise(0)
    source = dealt.groupBy("lang", *keys, F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"), F.sum(once).alias("df"))
    item = F.struct("source", "n")
    return source.groupBy("lang", *keys).agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(item).alias("by")).where(F.col("df") >= least).drop("df")


def kept_terms(partial: DataFrame, least: int) -> DataFrame:
    """``lang, digest, split, total, by``: terms in at least ``least`` documents of their language.

    Sums are shuffled by fixed-width digests alone. The strings behind the digests that reach ``least`` are then read:
    where the smallest and the largest differ, several terms share the digest, and these are counted once more by
    string (``split``, else null). No term is lost: a shared digest has at least the documents of each of its terms.
    """
    counted = partial.where("digest is not null")
    merged = cut_lineage(_by_term(counted.drop("term"), ["digest"], least))
    known = counted.select("lang", "digest", "term").join(merged.select("lang", "digest"), ["lang", "digest"], "left_semi")
    extremes = known.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    shared = cut_lineage(extremes.where("low <> high").select("lang", "digest"))
    single = merged.join(shared, ["lang", "digest"], "left_anti").withColumn("split", F.lit(None).cast("string"))
    several = _by_term(counted.join(shared, ["lang", "digest"], "left_semi"), ["digest", "term"], least).withColumnRenamed("term", "split")
    columns = ["lang", "digest", "split", "total", "by"]
    return cut_lineage(single.select(*columns).unionByName(several.select(*columns)))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(count) + F.lit(SMOOTH).cast("decimal(19,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    bottom = wide(n) + wide(v) * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.call_function("div", top, bottom) + F.lit(1).cast("long")


def source_divergence(docs: DataFrame, least: int = 30, ranks: int = 50, digest_bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank`` from the columns ``lang, source, text``.

    Terms are the runs of ``terms``; those in at least ``least`` documents (rows) of a language are kept, and every
    source of it gives each of them a smoothed share (``_share``), as does the language as a whole. Part ``pair``: per
    source every other source of the language and the sum of the absolute differences of their shares over all kept
    terms. Part ``term``: per source its terms whose share exceeds that of the language, the ``ranks`` largest
    differences. Ranks are by value, largest first, then by item.

    Nulls are empty strings. Sources without terms take part. A language without kept terms has pairs of value 0. Texts
    of any length are read whole; rows that repeat are rows of their own. A table without rows gives none; further
    columns are ignored. ``digest_bits`` is for tests: results are the same for any.
    """
    partial = partial_counts(docs, digest_bits)
    kept = kept_terms(partial, least)

    # Per language its number of kept terms and their occurrences, per source its occurrences: small tables.
    v = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    own = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("n"))
    groups = partial.where("digest is null").select("lang", F.explode("sources").alias("source")).distinct().join(own, ["lang", "source"], "left").join(v, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_n", F.lit(0)).alias("all_n")))

    # Pairs: the shares of all sources side by side per term, as numbers in the order of the sources; sums of their
    # differences are formed before the shuffle. A source that lacks a term has the share of count 0.
    sides = cut_lineage(groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n", "v"))).alias("sides")))
    share = F.transform("sides", lambda s: _share(F.coalesce(F.element_at("counts", s["source"]), F.lit(0)), s["n"], s["v"]))
    shares = kept.select("lang", F.map_from_entries("by").alias("counts")).join(sides, "lang").select("lang", share.alias("p"))
    first = shares.select("lang", "p", F.posexplode("p").alias("i", "a"))
    second = first.select("lang", "i", "a", F.posexplode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("k", "b"))
    far = second.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("value")).join(sides, "lang")
    name = lambda at: F.col("sides")[F.col(at)]["source"]
    both = F.array(F.struct(name("i").alias("source"), name("j").alias("item")), F.struct(name("j").alias("source"), name("i").alias("item")))
    far = far.select("lang", F.inline(both), "value")
    names = groups.groupBy("lang").agg(F.collect_list("source").alias("names"))
    pairs = groups.select("lang", "source").join(names, "lang").select("lang", "source", F.explode("names").alias("item")).where("item <> source")
    met = pairs.join(far, ["lang", "source", "item"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = met.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))

    # Terms: the largest differences, ties with the last of them included, then their strings, then the ranks.
    each = kept.select("lang", "digest", "split", "total", F.explode("by").alias("b")).select("lang", F.col("b.source").alias("source"), "digest", "split", "total", F.col("b.n").alias("count"))
    valued = each.join(groups, ["lang", "source"])
    value = _share(F.col("count"), F.col("n"), F.col("v")) - _share(F.col("total"), F.col("all_n"), F.col("v"))
    valued = valued.select("lang", "source", "digest", "split", value.alias("value")).where("value > 0")
    top = valued.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= ranks).drop("_r")
    top = cut_lineage(top)
    wanted = top.where("split is null").select("lang", "digest").distinct()
    strings = partial.select("lang", "digest", "term").join(wanted, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.first("term").alias("term"))
    named = top.join(strings, ["lang", "digest"], "left")
    term = named.select("lang", "source", F.lit("term").alias("part"), F.coalesce("split", "term").alias("item"), "value")
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pair.unionByName(term)
