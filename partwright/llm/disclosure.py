"""Personal data in texts, and the terms that give protected values away, by information-theoretic sanitisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.common import text_or_empty
from partwright.session import cut_lineage

# The patterns of the kinds, in order. Each starts where the last match ended or where no character of its
# first run stands before it: the leftmost match always starts there, and long runs are tried once. The possessive
# quantifiers give what the plain ones would, without going back or deep.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every line with an ip, card or phone has.
NUMBERS = r"[0-9][\x20().0-9-]{5}"
TERM = r"[\p{L}\p{M}]+"
ORDER = [*KINDS, "term"]
#: A part of an ip: at most 255, leading zeros allowed.
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _holds(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        n = F.length(digits)
        doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
        return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _matches(kind: str, text: Column, pattern: str) -> Column:
    """All matches in order as ``kind, at, gap, hit``: ``gap`` is the number of characters since the last match."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.length).alias("gap"), hits.alias("hit"))
    return F.transform(both, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), z["gap"].alias("gap"), z["hit"].alias("hit")))


def _placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """``start`` and ``end`` (exclusive) of exploded matches, by running sums of gaps and lengths within a line."""
    order = Window.partitionBy(*keys, "kind").orderBy("at")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("line_start") + F.sum("gap").over(upto) + F.coalesce(F.sum(F.length("hit")).over(before), F.lit(0))
    return found.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length("hit")).cast("long"))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def private_spans(docs: DataFrame, alpha: float = 0.9, support: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, kind, start, end, value``: one row per span (code points, end exclusive) of each distinct
    document.

    Base kinds are matches of fixed patterns that pass their checks; no match crosses a line. They are the protected
    values. A term (a run of letters of any length) meets a value in a line that holds the term if the value stands there
    or in the line before or after it. It gives the value away if the pointwise mutual information of the two over all
    lines of the corpus (the term in the line, the value there or beside it) is at least ``alpha`` times the information
    of the value, and they meet in at least ``support`` lines of different wording (the lines beside them included), so
    that copies of one place prove nothing. Such terms are spans of kind ``term`` wherever they occur outside base spans
    in documents with the value; ``value`` is then the term.

    Lines of all documents count. Term frequencies are summed map-side before the shuffle, so a term or line of any
    frequency is one small row per task. Null texts are empty. Rows equal in id and text are one document here; a
    null id is allowed. Tables without rows give none; further columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    split = base.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"), "text")
    n, edge = F.size("lines") - 1, F.array(F.lit(""))
    beside = F.arrays_zip(F.col("lines").alias("line"), F.concat(edge, F.slice("lines", F.lit(1), n)).alias("above"), F.concat(F.slice("lines", F.lit(2), n), edge).alias("below"))
    lines = split.select("doc_id", "text_hash", F.posexplode(beside).alias("pos", "l"), "text").select("doc_id", "text_hash", "pos", "l.*", "text")
    likely = F.col("text").contains("@") | F.col("text").rlike(NUMBERS)
    own = ["doc_id", "text_hash", "pos"]
    line_start = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id", "text_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = lines.where(likely).drop("text").dropDuplicates(own).withColumn("line_start", line_start.cast("long"))
    held = cut_lineage(held)

    none = F.array().cast("array<struct<kind:string,at:int,gap:int,hit:string>>")
    numbers = F.col("line").rlike(NUMBERS)
    tests = {"email": F.col("line").contains("@"), "ip": numbers, "card": numbers, "phone": numbers & F.col("line").contains("+")}
    arrays = [F.when(tests[k], _matches(k, F.col("line"), p)).otherwise(none) for k, p in KINDS.items()]
    found = held.select(*own, "line", "line_start", F.explode(F.flatten(F.array(*arrays))).alias("m")).select(*own, "line", "line_start", "m.*")
    right = F.lit(False)
    for kind in KINDS:
        right = right | ((F.col("kind") == kind) & _holds(kind, F.col("hit")))
    spans = _placed(found, own).where(right)
    value = F.when(F.col("kind") == "email", F.lower("hit")).when(F.col("kind") == "ip", F.col("hit")).otherwise(F.regexp_replace("hit", "[^0-9]", ""))
    spans = cut_lineage(spans.withColumn("value", value).select(*own, "kind", "start", "end", "value"))

    # Lines at which a value and a term meet, of one wording or another.
    entity = F.xxhash64("kind", "value").alias("entity")
    around = F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1))
    at_lines = held.select(*own, F.xxhash64("above", "line", "below").alias("wording"), "line")
    near = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), around.alias("p"), entity).distinct()
    meets = cut_lineage(at_lines.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("pos") == F.col("p"))).select("entity", "wording", "line"))
    joint = meets.select("entity", "wording", F.explode(_terms(F.col("line"))).alias("term"))
    joint = joint.groupBy("entity", "term").agg(F.count("*").alias("both"), F.count_distinct("wording").alias("wordings")).where(F.col("wordings") >= support)
    joint = cut_lineage(joint.withColumn("t", F.xxhash64("term")))
    values = meets.groupBy("entity").agg(F.count("*").alias("with_value"))
    counted = base.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    with_term = counted.select(F.explode(F.transform(_terms(F.col("line")), lambda w: F.xxhash64(w))).alias("t")).groupBy("t").agg(F.count("*").alias("with_term"))
    total = base.agg(F.coalesce(F.sum(F.size(F.split("text", "\n", -1))), F.lit(0)).cast("double").alias("n")).first()["n"] or 1.0
    judged = joint.join(with_term, "t").join(values, "entity")
    shown = F.log(F.col("both") * F.lit(total) / (F.col("with_term") * F.col("with_value"))) >= F.lit(alpha) * F.log(F.lit(total) / F.col("with_value"))
    telling = cut_lineage(judged.where(shown & (F.col("with_value") < total)).select("entity", "term"))

    # Their places in the documents that have the value.
    doc = ["doc_id", "text_hash"]
    in_doc = spans.select(*doc, entity).distinct().join(telling, "entity").select(*doc, "term").distinct()
    wanted = in_doc.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("term").alias("terms"))
    read = held.join(wanted, held["doc_id"].eqNullSafe(F.col("d")) & (held["text_hash"] == F.col("h"))).where(F.arrays_overlap(_terms(F.col("line")), "terms"))
    at = read.select(*own, "line_start", "terms", F.explode(_matches("term", F.col("line"), TERM)).alias("m")).select(*own, "line_start", "terms", "m.*")
    at = _placed(at, own).where(F.array_contains("terms", F.lower("hit"))).select(*own, "kind", "start", "end", F.lower("hit").alias("value"))
    taken = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))
    clear = at.join(taken, at["doc_id"].eqNullSafe(taken["d"]) & (at["text_hash"] == taken["h"]) & (at["pos"] == taken["p"]) & (at["start"] < taken["e"]) & (at["end"] > taken["s"]), "left_anti")
    return spans.select(*doc, "kind", "start", "end", "value").unionByName(clear.select(*doc, "kind", "start", "end", "value"))


def _gathered(spans: DataFrame) -> DataFrame:
    """The spans of a document as one array by start, then kind."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind")).cast("int")
    item = F.struct("start", rank.alias("rank"), "end", "kind")
    return spans.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_list(item)).alias("spans"))


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text_hash, spans``: one row per input row; ``spans`` is an array of ``start, rank, end, kind`` by start
    and kind, empty where nothing was found. One document's spans are one value."""
    found = _gathered(private_spans(docs, id_col=id_col, text_col=text_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select("doc_id", "text_hash", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text``: every text with its base spans generalised to their kind (``[email]``) and its telling terms
    removed; of overlapping spans the one that starts first stands for both. One row per input row."""
    found = _gathered(private_spans(docs, id_col=id_col, text_col=text_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(met["text"], (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], gap, mark).alias("out"), s["end"].alias("at")))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(met["text"], (a["at"] + 1).cast("int"), F.length(met["text"]))))
    return met.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))
