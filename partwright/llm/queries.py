"""One query per operator, on its whole table, with the SQL or brute-force form it is held against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.llm.common import table
from partwright.llm.disclosure import KINDS, span_report
from partwright.llm.divergence import source_divergence
from partwright.llm.filter_audit import filter_audit
from partwright.llm.html_text import extract_pages
from partwright.llm.line_dedup import line_dedup
from partwright.llm.mixing import mix_sources
from partwright.llm.near_dedup import near_duplicates
from partwright.llm.nearest import nearest
from partwright.llm.packing import pack
from partwright.llm.piecewise import fingerprint, likeness, with_next
from partwright.llm.quality import fit_quality, quality_scores
from partwright.llm.secret_ledger import BASE_RULES, secret_spans
from partwright.llm.tokens import stored_pieces, token_counts

#: Vocabulary file of the contracts; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary lies (on every machine of the cluster)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


LINES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


MIX_SQL = r"""
WITH z AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    0.05::DOUBLE + 0.95::DOUBLE * (length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D.,;:''-]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS quality,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370497::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER p, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT (SELECT level FROM v WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) AS best),
t AS (SELECT source, source_size, CASE WHEN best IS NULL THEN cap ELSE least(cap, weight * best) END AS target FROM v, b),
f AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT z.*, f.source_size, f.target, f.epochs,
    coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY -ln(u) / quality, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN f ON z.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN size > 0 AND epochs < 3 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""


@query("op5_source_mixing", MIX_SQL)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored_pieces(table(spark, sf_dir, "documents"), vocabulary_path()))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), budget=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * same >= 80 * (a.n + b.n - same)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""


@query("op10_hyperminhash_dedup", NEAR_SQL)
def op10_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Rows whose labels may be learned from: two thirds, by a checksum of the id.
TRAINING = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 <> 1"
HELD_OUT = "coalesce(crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1, false)"


@query("op1_quality_machine")
def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=F.expr(TRAINING))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many characters of the following one, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compared(texts: list[str], following: list[str]) -> dict[str, list]:
    new = [edited(t, f) for t, f in zip(texts, following)]
    own, changed = [fingerprint(t) for t in texts], [fingerprint(t) for t in new]
    beside = own[1:] + [fingerprint(following[-1])] if following[:-1] == texts[1:] else [fingerprint(t) for t in following]
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new], "fingerprint": own,
        "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, beside),
    }


@query("op9_piecewise_fingerprints")
def op9_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), _compared, schema)


@query("op4_adaptive_scan")
def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_disclosure")
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_report(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, FALSE) THEN 'E' ELSE '' END AS fails
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS own,
    len(list_filter(string_split(before, ''), lambda b: b <> '' AND contains(fails, b))) > 0 AS earlier, fails = f AS alone FROM c, s),
t AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM t
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SECRETS_SQL = r"""
WITH p AS (SELECT * FROM (VALUES
    ('assign', 1, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    ('access', 2, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 3, '[0-9a-f]+', 0, 24),
    ('pem', 4, '-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----', 0, 1),
    ('jwt', 5, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0, 1),
    ('login', 6, '://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@', 0, 1),
    ('service', 7, '(?:gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})', 0, 1)) v(kind, rank, pattern, grp, least)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, kind, rank, least, regexp_extract_all(text, pattern, 0) AS hits, string_split_regex(text, pattern) AS gaps,
    CASE grp WHEN 2 THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(text, pattern, 0) END AS kept FROM d, p),
e AS (SELECT doc_id, kind, rank, least, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(kept) AS kept, unnest(gaps[: len(hits)]) AS gap FROM h),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin FROM e),
r AS (SELECT doc_id, kind, rank, fin - length(hit) AS start, fin FROM s WHERE length(kept) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans,
    string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


@query("op12_secret_ledger", SECRETS_SQL)
def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(of_kind(*kinds)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
s AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
t AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM t),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - q.q AS value FROM s JOIN q ON s.lang = q.lang AND s.term = q.term WHERE s.c > 0 AND s.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
