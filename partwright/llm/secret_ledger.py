"""Secrets in every version of every text, found with a ledger of what has been scanned by which rule."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty
from partwright.session import cut_lineage, shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind. A new ``version`` makes every blob unseen for this rule.

    ``group`` of a match must have ``least`` characters, else the match is dropped. A text can only match if, in lower
    case, it holds one of ``needles`` (or, without any, matches the regular expression ``trigger`` as it is).
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needles: tuple[str, ...] = ()
    trigger: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules of the contract, in its order. Possessive quantifiers match what the plain ones would.
BASE_RULES = (
    Rule(
        "assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", group=2, least=6,
        needles=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]++", least=20, needles=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}+", least=24, trigger="[0-9a-f]{24}"),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]++ ){0,3}?PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]++-----END (?:[A-Z0-9]++ ){0,3}?PRIVATE KEY-----", needles=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", needles=("eyj",)),
    Rule("login", 1, r"://([^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/:@]++)@", group=1, needles=("://",)),
    Rule("service", 1, r"(?:gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", needles=("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "xox", "sk_live_", "aiza")),
)
RULES = (*BASE_RULES, *MORE_RULES)

SPAN = "array<struct<rule:string,start:bigint,end:bigint>>"
LEDGER = f"blob binary, rules array<string>, spans {SPAN}"


class Ledger:
    """A Parquet folder all executors reach: one row per blob and scan, with the rules of that scan and what they found.

    A batch of rows is one write, which Spark commits as a whole: pairs of blob and rule can't be there without their
    findings, and a batch that failed leaves its pairs unseen. Rows repeated by a retried batch change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(self.folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def append(self, batch: DataFrame) -> None:
        batch.write.mode("append").parquet(self.folder)

    def seen(self) -> DataFrame:
        """``seen_blob, seen_rules``: all rules a blob was scanned with."""
        return self.rows().groupBy(F.col("blob").alias("seen_blob")).agg(F.flatten(F.collect_set("rules")).alias("seen_rules"))

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """``found_blob, found``: per blob with any, the spans of the rules by start and rule order."""
        rank = F.array_position(F.array(*[F.lit(r.id) for r in rules]), F.col("s.rule")).cast("int")
        kind = F.substring_index("s.rule", "@", 1)
        span = self.rows().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(rank > 0)
        item = F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.end").alias("end"), kind.alias("kind"))
        return span.groupBy(F.col("blob").alias("found_blob")).agg(F.sort_array(F.collect_set(item)).alias("found"))


def content_address(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _scan(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``blob, rules, text``; a text without a trigger of any rule doesn't leave the JVM."""
    small_batches(todo.sparkSession)
    patterns = {r.id: (re.compile(r.pattern, re.ASCII), r.group, r.least) for r in rules}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for ids, text in zip(batch["rules"], batch["text"]):
                found = []
                for rule in ids if text else ():
                    pattern, group, least = patterns[rule]
                    found += [{"rule": rule, "start": m.start(), "end": m.end()} for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
                spans.append(found)
            yield pd.DataFrame({"blob": batch["blob"], "rules": batch["rules"], "spans": spans})

    low = todo.withColumn("_low", F.lower("text"))
    tests = [reduce(lambda a, b: a | b, [F.col("_low").contains(n) for n in r.needles]) if r.needles else F.col("text").rlike(r.trigger) for r in rules]
    likely = reduce(lambda a, b: a | b, tests)
    return low.select("blob", "rules", F.when(likely, F.col("text")).alias("text")).mapInPandas(find, LEDGER)


def addressed(versions: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The ids and the blob of every version, written once: numbers and addresses only."""
    return cut_lineage(versions.select(*id_cols, content_address(text_or_empty(text_col)).alias("blob")))


def scan_unseen(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], id_cols: list[str], text_col: str = "text", blobs: DataFrame | None = None) -> None:
    """Scan what is new in ``versions`` and enter it into the ledger.

    Of every blob with rules that have not seen it, one version (the smallest ids) hands in its text. Texts are joined
    to these few by ids and blob, so copies of one text spread; where little is new, Spark broadcasts that side and no
    text is shuffled.
    """
    blobs = addressed(versions, id_cols, text_col) if blobs is None else blobs
    current = F.array(*[F.lit(r.id) for r in rules])
    one = blobs.groupBy("blob").agg(F.min(F.struct(*id_cols)).alias("of"))
    new = one.join(ledger.seen(), F.col("blob") == F.col("seen_blob"), "left")
    new = new.select(
        F.col("blob").alias("new_blob"), *[F.col("of")[c].alias(f"new_{i}") for i, c in enumerate(id_cols)],
        F.array_except(current, F.coalesce("seen_rules", F.array().cast("array<string>"))).alias("rules"),
    ).where(F.size("rules") > 0)
    new = cut_lineage(new)
    text = versions.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(id_cols)], text_or_empty(text_col).alias("text"))
    on = content_address(F.col("text")) == F.col("new_blob")
    for i in range(len(id_cols)):
        on = on & F.col(f"own_{i}").eqNullSafe(F.col(f"new_{i}"))
    ledger.append(_scan(text.join(new, on).select(F.col("new_blob").alias("blob"), "rules", "text"), rules))


def secret_spans(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The id columns, ``blob`` and ``spans``: one row per input row, with everything its text holds.

    ``spans`` is an array of ``start, rank, end, kind`` (code points, end exclusive) by start and order of the rules,
    empty where nothing was found; matches of one rule don't overlap. ``ledger`` is a folder kept between runs: a text
    met before, under whatever path or version, is not scanned again unless a rule or its version is new. Without it a
    fresh ledger in the shared folder is used, and only copies within the input are spared.

    Null texts are empty texts. Rows may repeat ids and texts; null ids are kept. Any length of text is read whole. A
    table without rows gives none; columns other than the ids and the text are ignored.
    """
    id_cols = ["doc_id"] if id_cols is None else id_cols
    if len({r.kind for r in rules}) != len(rules):
        raise ValueError("one rule of each kind")
    book = Ledger(versions.sparkSession, ledger)
    blobs = addressed(versions, id_cols, text_col)
    scan_unseen(versions, book, rules, id_cols, text_col, blobs)
    # A table of its own, so that the join can be split where many versions share one blob.
    found = cut_lineage(book.findings(rules))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return blobs.join(found, F.col("blob") == F.col("found_blob"), "left").select(*id_cols, "blob", F.coalesce("found", none).alias("spans"))
