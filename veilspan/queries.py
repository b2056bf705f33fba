"""The registered queries of the span engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import scalars
from .functions.contract import DEFAULT_ALLOWLIST, SpanError
from .operators import consistency, dictionary, merge, model_layer, names, patterns, raster, render, review, spans, tagger
from .plans import replies
from .plans.detect import detect, layer_report, layer_tallies
from .sources import sinks
from .sources.models import QuotesWord, Replies

#: Terms of the synthetic corpus that stand in for a list of known entities and for harmless terms.
KNOWN = [("than", "PERSON"), ("example", "ORG"), ("of the", "OTHER")]
ALLOWED = ["com", "with the"]
#: Texts with what the corpus lacks.
CASES = [
    (1, "SSN 123-45-6789 stands alone."),
    (2, "Run 123-45-6789 1234567890123 beyond a phone's digits."),
    (3, "Card 4111 1111 1111 1111 and amex 3782-822463-10005, wrong 4111 1111 1111 1112."),
    (4, "Codes CR-77120-AC, AB-CD, 12-34-56, X1-Y2-Z3 and \U0001f600 é AB-12."),
    (5, "At 2024-03-05 12:30 call 0413 552 760 or +61 413 552 760, mail Ana.Li@Mail.example.org."),
    (6, "First 0413\n552 760 over two lines. (02) 9999 8888! Then nothing"),
    (7, ""),
]
NOTE = (
    "Claimant: Ms. Anna Hartwell\nReference: CR-10442-AC\nShe can be reached at 0413 555 760, or as +61 413 555 760. Mail anna.h@mail.example.org.\n"
    "Post to 27 Riverbank Street, Newtown NSW 2042. Sent by her supervisor, Martin Sorvik, who asked for it. Anna has since agreed.\nChecked against Coastline Mutual, a partner."
)
REPLIES = [(1, 0, "Her manager, Bo Li, met Bo Li and Dr Bo.", '```json\n{"entities": [{"text": "Bo Li", "type": "person", "reason": " boss "}, {"text": "Bo Li", "type": "X"}, {"text": "Bo", "type": null, "reason": " "}, {"text": "Al", "type": "ORG"}]}\n```'), (2, 0, "nothing", "not json"), (3, 680, "the doctor Eve", '[{"text": "Eve", "type": "PERSON", "reason": "named"}]'), (3, 0, "Eve", "{}")]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def rows(spark: SparkSession, data: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(data, "doc_id long, text string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _family(matches, source: DataFrame) -> DataFrame:
    return source.select("doc_id", F.explode(matches("text")).alias("m")).select("doc_id", "m.start", "m.end", "m.text", "m.normalized_value")


def _hits(pattern: str, norm: str, keep: str = "true", source: str = "documents") -> str:
    return f'SELECT doc_id, s AS "start", e AS "end", v AS text, {norm} AS normalized_value FROM {O.hits(pattern, source)} WHERE {keep}'


PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages)"


@query(_hits(O.EMAIL, "lower(v)"))
def scan_email(spark, sf_dir):
    return _family(patterns.emails, docs(spark, sf_dir))


@query(_hits(O.PHONE, O.DIGITS, f"length({O.DIGITS}) BETWEEN 9 AND 15"))
def scan_phone(spark, sf_dir):
    return _family(patterns.phones, docs(spark, sf_dir))


@query(_hits(O.ACCOUNT, O.DIGITS, O.LUHN))
def scan_account_luhn(spark, sf_dir):
    return _family(patterns.accounts, docs(spark, sf_dir))


#: The documents and the cases that they lack.
BOTH = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {O.values(CASES)})"


@query(_hits(O.SSN, "CAST(NULL AS VARCHAR)", source=BOTH))
def scan_ssn(spark, sf_dir):
    return _family(patterns.ssns, docs(spark, sf_dir).union(rows(spark, CASES)))


@query(_hits(O.REFERENCE, "CAST(NULL AS VARCHAR)", "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')", BOTH))
def scan_reference(spark, sf_dir):
    return _family(patterns.references, docs(spark, sf_dir).union(rows(spark, CASES)))


@query(_hits(O.EMAIL, "lower(v)", source=PAGES))
def scan_pages_email(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _family(patterns.emails, pages)


def _layer(source: DataFrame) -> DataFrame:
    return patterns.detect_patterns(source).select("doc_id", "arrival", "id", "start", "end", "text", "type", "confidence", "source", "reason", "normalized_value")


def _layer_sql(source: str = "documents") -> str:
    return f"""SELECT doc_id, CAST(ord AS BIGINT) AS arrival, 'regex:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, type, 0.99::DOUBLE AS confidence, 'regex' AS source, reason, norm AS normalized_value FROM {O.layer(source)}"""


@query(_layer_sql())
def regex_layer(spark, sf_dir):
    return _layer(docs(spark, sf_dir))


@query(_layer_sql(BOTH))
def regex_layer_cases(spark, sf_dir):
    return _layer(docs(spark, sf_dir).union(rows(spark, CASES)))


@query(f"""SELECT doc_id, 'dict:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, type, 0.98::DOUBLE AS confidence FROM {O.terms(KNOWN)}""")
def gazetteer_scan(spark, sf_dir):
    return dictionary.detect_known(docs(spark, sf_dir), KNOWN).select("doc_id", "id", "start", "end", "text", "type", "confidence")


@query(f"""SELECT doc_id, 'dict:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, type, 0.98::DOUBLE AS confidence FROM {O.terms(KNOWN)}""")
def gazetteer_join(spark, sf_dir):
    table = spark.createDataFrame([(k, t, kind) for k, (t, kind) in enumerate(KNOWN)], "ord int, term string, type string")
    return dictionary.detect_known(docs(spark, sf_dir), table).select("doc_id", "id", "start", "end", "text", "type", "confidence")


#: Names in the business tables, and words and pairs of words of the benchmark, as these stand in the documents.
TERMS = r"""(SELECT DISTINCT term FROM (SELECT lower(c_name) AS term FROM customer UNION ALL SELECT lower(s_name) FROM supplier UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT lower(p_name) FROM part
  UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,} [a-z]{4,}')) FROM benchmark))"""


def _terms(spark, sf_dir) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names_ = [read(t).select(F.lower(c).alias("term")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("part", "p_name"))]
    words = [read("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).alias("term")) for p in ("[a-z]{7,}", "[a-z]{4,} [a-z]{4,}")]
    every = names_[0]
    for part in [*names_[1:], *words]:
        every = every.union(part)
    return every.distinct().select(F.xxhash64("term").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("ord"), "term", F.lit("ORG").alias("type"))


@query(f"""SELECT h.doc_id, 'dict:' || h.s || '-' || h.e AS id, h.s AS "start", h.e AS "end", h.v AS text, 'ORG' AS type, 0.98::DOUBLE AS confidence
FROM {O.phrases(TERMS)} h""")
def gazetteer_tables(spark, sf_dir):
    found = dictionary.detect_known(docs(spark, sf_dir), _terms(spark, sf_dir))
    return found.select("doc_id", "id", "start", "end", "text", "type", "confidence")


@query(f"""SELECT doc_id, s AS "start", e AS "end", v AS text, 'known non-sensitive entity on the dictionary allowlist' AS reason FROM {O.terms([(a, '') for a in ALLOWED])}""")
def allowlist_scan(spark, sf_dir):
    return dictionary.allow_ranges(docs(spark, sf_dir), ALLOWED)


def _detected(spark, sf_dir):
    return detect(docs(spark, sf_dir), KNOWN, ALLOWED, names=False)


FOUND = O.findings(KNOWN, ALLOWED)


@query(f'{FOUND} SELECT doc_id, s AS "start", e AS "end", source FROM kept')
def allowlist_suppress(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return merge.suppressed(d.candidates, d.ranges).select("doc_id", "start", "end", "source")


@query(f'{FOUND} SELECT doc_id, s AS "start", e AS "end", source, CAST(island AS BIGINT) AS island FROM isl')
def coalesce_spans(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return merge.clustered(merge.suppressed(d.candidates, d.ranges)).select("doc_id", "start", "end", "source", "island")


@query(f'{FOUND} SELECT doc_id, CAST(island AS BIGINT) AS island, s AS "start", e AS "end", v AS text, type FROM best')
def winner_pick(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return merge.winners(merge.clustered(merge.suppressed(d.candidates, d.ranges)))


@query(f"{FOUND} SELECT f.doc_id, CAST(f.island AS BIGINT) AS island, f.confidence, f.sources, w.reason, f.norm AS normalized_value FROM fact f JOIN why w USING (doc_id, island)")
def merge_facts(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return merge.facts(merge.clustered(merge.suppressed(d.candidates, d.ranges)))


@query(f"{FOUND} SELECT a.doc_id, a.s AS \"start\", b.s AS other FROM joined a JOIN joined b ON a.doc_id = b.doc_id AND a.key = b.key AND (a.s <> b.s OR a.e <> b.e)")
def link_duplicates(spark, sf_dir):
    return _detected(spark, sf_dir).findings.select("doc_id", "start", F.explode("linked").alias("o")).select("doc_id", "start", F.col("o.start").alias("other"))


@query(f"""{FOUND} SELECT doc_id, 'm:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, type, confidence, sources, reason, norm AS normalized_value, CAST({O.TIER} AS INTEGER) AS tier, CAST(links AS INTEGER) AS linked_count FROM found""")
def tiered_findings(spark, sf_dir):
    return _detected(spark, sf_dir).findings.drop("linked", "link_group").withColumn("linked_count", F.col("linked_count").cast("int"))


@query(f"SELECT doc_id, v AS text, {O.canonical(O.DIGITS)} AS subscriber, 'PHONE:' || {O.canonical(O.DIGITS)} AS link_key FROM {O.hits(O.PHONE)} WHERE length({O.DIGITS}) BETWEEN 9 AND 15")
def canonical_phone(spark, sf_dir):
    return scan_phone(spark, sf_dir).select("doc_id", "text", scalars.canonical_phone("text").alias("subscriber"), scalars.link_key(F.lit("PHONE"), "normalized_value").alias("link_key"))


@query(f"SELECT l.doc_id, l.s AS \"start\", {O.sentence('d.text', 'l.s', 'l.e')} AS sentence FROM {O.layer()} l JOIN documents d USING (doc_id)")
def sentence_context(spark, sf_dir):
    found = patterns.detect_patterns(docs(spark, sf_dir)).select("doc_id", "start", "end").join(docs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "start", scalars.sentence("text", F.col("start"), F.col("end")).alias("sentence"))


def _accepted(spark, sf_dir):
    return patterns.detect_patterns(docs(spark, sf_dir))


def _numbered(where: str = "true") -> str:
    return f"""WITH l AS (SELECT *, type || chr(1) || CASE WHEN type = 'PHONE' AND norm <> '' THEN {O.canonical('norm')} WHEN norm <> '' THEN norm ELSE lower(v) END AS identity FROM {O.layer()} WHERE {where}),
  f AS (SELECT *, min(s) OVER (PARTITION BY doc_id, identity) AS first FROM l),
  t AS (SELECT *, '[' || type || '_' || dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first, identity) || ']' AS token FROM f)"""


NUMBERED = _numbered()


@query(f'{NUMBERED} SELECT doc_id, s AS "start", token FROM t')
def token_numbering(spark, sf_dir):
    return render.tokens(_accepted(spark, sf_dir), "ANONYMIZE").select("doc_id", "start", "token")


@query(f"{NUMBERED} SELECT doc_id, token, type, count(*) AS occurrences, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(s), identity) AS INTEGER) AS ord FROM t GROUP BY doc_id, identity, token, type")
def legend(spark, sf_dir):
    return render.legend(_accepted(spark, sf_dir), "ANONYMIZE")


def _text_sql(token: str, where: str = "true") -> str:
    return f"""{_numbered(where)}, p AS (SELECT doc_id, s, e, {token} AS token, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) AS before FROM t)
    SELECT d.doc_id, coalesce(string_agg(substr(d.text, p.before + 1, p.s - p.before) || p.token, '' ORDER BY p.s), '') || substr(d.text, coalesce(max(p.e), 0) + 1) AS output_text
    FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""


@query(_text_sql("'[REDACTED]'"))
def redact_text(spark, sf_dir):
    return render.rendered(docs(spark, sf_dir), _accepted(spark, sf_dir), "REDACT").select("doc_id", "output_text")


@query(_text_sql("token"))
def anonymize_text(spark, sf_dir):
    return render.rendered(docs(spark, sf_dir), _accepted(spark, sf_dir), "ANONYMIZE").select("doc_id", "output_text")


@query(_text_sql("repeat('█', e - s)"))
def blackout_text(spark, sf_dir):
    return render.rendered(docs(spark, sf_dir), _accepted(spark, sf_dir), "REDACT", "blackout").select("doc_id", "output_text")


@query(_text_sql("token", "s % 2 = 0"))
def session_export(spark, sf_dir):
    """Texts with those of the session's spans taken out that were handed in by id."""
    own = _accepted(spark, sf_dir)
    submitted = own.where("start % 2 = 0").select("doc_id", F.col("start").alias("ord"), "id")
    chosen = spans.selected(submitted, own)
    spans.require_disjoint(chosen)
    return render.rendered(docs(spark, sf_dir), chosen, "ANONYMIZE").select("doc_id", "output_text")


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g') AS output_text FROM documents")
def redact_email(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = _family(patterns.emails, d).withColumn("type", F.lit("EMAIL"))
    return render.rendered(d, found, "REDACT").select("doc_id", "output_text")


def _items(spark, sf_dir):
    """The queue with every third decision made: those whose start is a multiple of three are accepted, of two dismissed."""
    found = _detected(spark, sf_dir).findings
    return found.withColumn("status", F.when(F.col("start") % 3 == 0, "accepted").when(F.col("start") % 2 == 0, "dismissed").otherwise("pending"))


STATUS = "CASE WHEN s % 3 = 0 THEN 'accepted' WHEN s % 2 = 0 THEN 'dismissed' ELSE 'pending' END"


@query(f"""{FOUND}, q AS (SELECT doc_id, {O.TIER} AS tier, {STATUS} AS status FROM found)
SELECT d.doc_id, count(q.tier) FILTER (q.tier = 1) AS tier1, count(q.tier) FILTER (q.tier = 2) AS tier2, count(q.tier) FILTER (q.tier = 3) AS tier3,
  count(q.tier) FILTER (status = 'accepted') AS accepted, count(q.tier) FILTER (status = 'dismissed') AS dismissed, count(q.tier) FILTER (status = 'pending') AS pending, count(q.tier) FILTER (q.tier = 1 AND status = 'pending') AS unresolved_high_risk
FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id""")
def queue_counts(spark, sf_dir):
    return review.counts(docs(spark, sf_dir), _items(spark, sf_dir))


@query(f"""{FOUND}, q AS (SELECT doc_id, count(*) AS open FROM found WHERE {O.TIER} = 1 AND {STATUS} = 'pending' GROUP BY doc_id)
SELECT d.doc_id, q.open IS NOT NULL AS gated, CAST(coalesce(q.open, 0) AS INTEGER) AS unresolved FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id""")
def export_gate(spark, sf_dir):
    out = review.export(docs(spark, sf_dir), _items(spark, sf_dir), "REDACT")
    return out.select("doc_id", "gated", F.when(F.col("gated"), F.size("unresolved")).otherwise(0).alias("unresolved"))


@query(f"""{FOUND}, q AS (SELECT doc_id, s, e, {O.TIER} AS tier FROM found)
SELECT doc_id, s AS "start", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier, s, e) AS INTEGER) AS place FROM q QUALIFY place <= 9""")
def jump_targets(spark, sf_dir):
    return review.jump_targets(_items(spark, sf_dir)).select("doc_id", "start", "place")


@query(f"""{FOUND}, q AS (SELECT doc_id, {O.TIER} AS tier, count(*) AS n FROM found GROUP BY ALL)
SELECT d.doc_id, CAST(t.tier AS INTEGER) AS tier, CAST(coalesce(q.n, 0) AS INTEGER) AS items FROM documents d CROSS JOIN (VALUES (1), (2), (3)) t(tier) LEFT JOIN q ON q.doc_id = d.doc_id AND q.tier = t.tier""")
def queue_by_tier(spark, sf_dir):
    return review.by_tier(docs(spark, sf_dir), _items(spark, sf_dir)).select("doc_id", "tier", F.size("items").alias("items"))


LAYERS = f"""{FOUND}, n AS (SELECT doc_id, source AS name, count(*) AS c FROM cand GROUP BY ALL), a AS (SELECT doc_id, count(*) AS c FROM allow GROUP BY doc_id),
layers AS (SELECT d.doc_id, l.name, l.status, coalesce(n.c, 0) AS count, CASE WHEN l.name = 'dictionary' THEN 'closed-world entities; ' || coalesce(a.c, 0) || ' allowlisted range(s)' ELSE l.detail END AS detail
FROM documents d CROSS JOIN (VALUES ('regex', 'ok', 'structured PII (phone/email/ID)'), ('dictionary', 'ok', ''), ('ner', 'skipped', 'switched off'), ('llm', 'skipped', 'disabled (offline/no key)')) l(name, status, detail)
LEFT JOIN n ON n.doc_id = d.doc_id AND n.name = l.name LEFT JOIN a ON a.doc_id = d.doc_id)"""


@query(f"{LAYERS} SELECT * FROM layers")
def layer_counts(spark, sf_dir):
    return _detected(spark, sf_dir).layers


@query(f"{LAYERS} SELECT doc_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error FROM layers GROUP BY doc_id")
def layer_tally(spark, sf_dir):
    return layer_tallies(layer_counts(spark, sf_dir))


WINDOWS = "(SELECT doc_id, CAST(k * 680 AS INTEGER) AS w_start, substr(text, k * 680 + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 680.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0))"
TRIGGERS = "|".join(model_layer.TRIGGERS)


@query(f"SELECT * FROM {WINDOWS}")
def text_windows(spark, sf_dir):
    return model_layer.text_windows(docs(spark, sf_dir))


@query(rf"SELECT doc_id, w_start FROM {WINDOWS} WHERE regexp_matches(lower(chunk), '(^|[^\p{{L}}\p{{N}}_])({TRIGGERS})([^\p{{L}}\p{{N}}_]|$)')")
def trigger_gate(spark, sf_dir):
    return model_layer.gated(model_layer.text_windows(docs(spark, sf_dir))).select("doc_id", "w_start")


#: The long words of a window, and the replies that a model gives in this corpus: of four kinds, by the document's id.
LONG = r"[a-z]{6,}"
WITH_REPLIES = rf"""WITH w AS (SELECT doc_id, w_start, chunk, regexp_extract_all(chunk, '{LONG}') AS l FROM {WINDOWS} WHERE regexp_matches(chunk, '{LONG}') AND doc_id % 4 < 3),
e AS (SELECT doc_id, w_start, chunk, 0 AS k, l[1] AS text, 'person' AS type, 'boss' AS reason FROM w UNION ALL SELECT doc_id, w_start, chunk, 1, l[1], 'X', NULL FROM w UNION ALL SELECT doc_id, w_start, chunk, 2, l[-1], NULL, ' ' FROM w)"""


def _replies(spark, sf_dir):
    """Windows with replies that quote their first and last long word: bare lists, objects, fenced objects, and no JSON."""
    windows = model_layer.text_windows(docs(spark, sf_dir)).withColumn("l", F.regexp_extract_all("chunk", F.lit(LONG), F.lit(0))).where(F.size("l") > 0)

    def entity(text, kind, reason):
        return F.struct(text.alias("text"), F.lit(kind).cast("string").alias("type"), F.lit(reason).cast("string").alias("reason"))

    listed = F.to_json(F.array(entity(F.element_at("l", 1), "person", " boss "), entity(F.element_at("l", 1), "X", None), entity(F.element_at("l", -1), None, " ")))
    whole = F.concat(F.lit('{"entities": '), listed, F.lit("}"))
    kind = F.col("doc_id") % 4
    reply = F.when(kind == 0, listed).when(kind == 1, whole).when(kind == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.concat(F.lit("I found "), listed))
    return windows.select("doc_id", "w_start", "chunk", reply.alias("reply")).unionByName(spark.createDataFrame([(-d, *r) for d, *r in REPLIES], "doc_id long, w_start int, chunk string, reply string"))


@query(f"{WITH_REPLIES} SELECT doc_id, text, type FROM e UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'Bo Li', 'person'), (-1, 'Bo Li', 'X'), (-1, 'Bo', NULL), (-1, 'Al', 'ORG'), (-3, 'Eve', 'PERSON')) t(doc_id, text, type)")
def llm_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("doc_id", F.explode(model_layer.parsed_entities("reply")).alias("e")).select("doc_id", "e.text", "e.type")


@query(f"""{WITH_REPLIES}, places AS (SELECT *, list_filter(range(1, 802), lambda i: substr(chunk, i, length(text)) = text) AS p FROM e),
first AS (SELECT doc_id, w_start, max(p[1]) FILTER (k = 0) AS a, max(p[2]) FILTER (k = 1) AS b FROM places GROUP BY ALL),
hits AS (SELECT doc_id, w_start, k, text, type, reason, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE list_filter(p, lambda x: x <> a AND x IS DISTINCT FROM b)[1] END AS place FROM places JOIN first USING (doc_id, w_start)),
found AS (SELECT doc_id, w_start, k, CAST(w_start + place - 1 AS INTEGER) AS s, CAST(w_start + place - 1 + length(text) AS INTEGER) AS e, text, CASE WHEN type = 'person' THEN 'PERSON' ELSE 'OTHER' END AS type, CASE WHEN reason = 'boss' THEN reason ELSE 'relational/implicit PII the earlier layers missed' END AS reason FROM hits WHERE place IS NOT NULL)
SELECT doc_id, s AS "start", e AS "end", text, type, reason FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY w_start, k) = 1
UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 13, 18, 'Bo Li', 'PERSON', 'boss'), (-1, 24, 29, 'Bo Li', 'OTHER', 'relational/implicit PII the earlier layers missed'),
  (-1, 37, 39, 'Bo', 'OTHER', 'relational/implicit PII the earlier layers missed'), (-3, 691, 694, 'Eve', 'PERSON', 'named')) t(doc_id, "start", "end", text, type, reason)""")
def llm_reanchor(spark, sf_dir):
    return model_layer.model_hits(_replies(spark, sf_dir)).select("doc_id", "start", "end", "text", "type", "reason")


#: A claim for the model layer that the name layer also makes.
NAMED = Replies({"supervisor": '{"entities": [{"text": "Martin Sorvik", "type": "PERSON", "reason": "named by role"}]}'})
CANDIDATE = """id, s AS "start", e AS "end", v AS text, type, confidence, source, reason, CAST(NULL AS VARCHAR) AS normalized_value"""
#: The documents, and a note as they hold no names.
WITH_NOTE = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {O.values([(-1, NOTE)])})"


def noted(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).union(rows(spark, [(-1, NOTE)]))


def _windows(source: str) -> str:
    return WINDOWS.replace("FROM documents", f"FROM {source}")


#: What the model layer makes of replies that quote a window's first long word.
QUOTED = rf"""SELECT DISTINCT doc_id, CAST(w_start + strpos(chunk, v) - 1 AS INTEGER) AS s, CAST(w_start + strpos(chunk, v) - 1 + length(v) AS INTEGER) AS e, v
FROM (SELECT *, regexp_extract(chunk, '{LONG}') AS v FROM {_windows(WITH_NOTE)} WHERE regexp_matches(lower(chunk), '(^|[^\p{{L}}\p{{N}}_])({TRIGGERS})([^\p{{L}}\p{{N}}_]|$)')) WHERE v <> ''"""


@query(f"""SELECT doc_id, 3298534883328 + CAST(s AS BIGINT) * 65536 + e - s AS arrival, 'llm:' || s || '-' || e AS {CANDIDATE} FROM (SELECT *, 'PERSON' AS type, 0.55::DOUBLE AS confidence, 'llm' AS source, 'quoted' AS reason FROM ({QUOTED}))""")
def llm_layer(spark, sf_dir):
    """Replies are asked for through a table of replies, so copies of a passage are asked once."""
    windows = model_layer.gated(model_layer.text_windows(noted(spark, sf_dir)))
    replied = replies.answered(windows, QuotesWord(LONG), replies.reply_table(spark, sinks.shared_folder(spark)))
    return model_layer.detect_with_model(noted(spark, sf_dir), replies=replied)


@query(f"""WITH q AS ({QUOTED}), f AS (SELECT * FROM {O.layer(WITH_NOTE)}), own AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = q.doc_id AND q.s < f.e AND f.s < q.e)),
m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM own),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, s AS "start", e AS "end", CAST(1 AS INTEGER) AS tier FROM f UNION ALL SELECT doc_id, s, e, CAST(3 AS INTEGER) FROM i QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY s, e) = 1""")
def soft_findings(spark, sf_dir):
    """Findings of patterns and of a model that quotes: those of the model alone are of the third tier."""
    d = noted(spark, sf_dir)
    found = patterns.detect_patterns(d).persist()
    hits = model_layer.detect_with_model(d, QuotesWord(LONG), covered=found)
    return merge.merge(found.unionByName(hits)).select("doc_id", "start", "end", "tier")


def _names_sql(source: str, allowed=()) -> str:
    return f"SELECT doc_id, 2199023255552 + CAST(ord AS BIGINT) AS arrival, 'ner:' || s || '-' || e AS {CANDIDATE} FROM (SELECT *, 'ner' AS source FROM {O.names_layer(source, allowed)})"


@query(_names_sql(WITH_NOTE, DEFAULT_ALLOWLIST))
def ner_layer(spark, sf_dir):
    d = noted(spark, sf_dir)
    return names.detect_names(d, dictionary.allow_ranges(d))


@query(_names_sql(WITH_NOTE))
def ner_layer_corpus(spark, sf_dir):
    return names.detect_names(noted(spark, sf_dir))


@query()
def ner_tagger_corpus(spark, sf_dir):
    """What a tagger finds in the documents, the conversations and the note; it learns from lessons and from lines of the documents."""
    own = docs(spark, sf_dir)
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((-2 - F.col("conv_id") * 1000 - F.col("turn")).cast("long").alias("doc_id"), "text")
    model = tagger.fit(tagger.lesson_sentences(spark).unionByName(tagger.plain_sentences(own)))
    return names.detect_names(own.union(talks).union(rows(spark, [(-1, NOTE)])), analyser=tagger.analyser(model)).select("doc_id", "start", "end", "text", "type", "confidence")


NOTE_FOUND = O.findings([], DEFAULT_ALLOWLIST, WITH_NOTE, names=True)


@query(f"""{NOTE_FOUND} SELECT doc_id, 'm:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, type, confidence, sources, reason, norm AS normalized_value, CAST({O.TIER} AS INTEGER) AS tier, CAST(links AS INTEGER) AS linked_count FROM found""")
def full_pipeline_note(spark, sf_dir):
    found = detect(noted(spark, sf_dir), client=NAMED).findings
    return found.drop("linked", "link_group").withColumn("linked_count", F.col("linked_count").cast("int"))


@query(f"""SELECT l.doc_id, 'llm:' || s || '-' || e AS id, s AS "start", e AS "end", v AS text, 'EMAIL' AS type, 0.55::DOUBLE AS confidence, 'llm' AS source, 'address' AS reason
FROM {O.layer()} l JOIN documents d ON d.doc_id = l.doc_id WHERE contains(v, '@') OR contains({O.model_sentence('d.text', 'l.s', 'l.e')}, '@')""")
def settled_disagreements(spark, sf_dir):
    client = Replies({"@": '{"is_pii": true, "type": "email", "reason": " address "}'}, '{"is_pii": false}')
    return model_layer.settle_disagreements(docs(spark, sf_dir), patterns.detect_patterns(docs(spark, sf_dir)), client)


@query(f"""SELECT doc_id, s AS "start", CASE WHEN p > 0 THEN substr(sentence, 1, p - 1) ELSE '… ' END AS before, v AS marked, CASE WHEN p > 0 THEN substr(sentence, p + length(v)) ELSE ' …' END AS after
FROM (SELECT *, strpos(sentence, v) AS p FROM (SELECT l.*, {O.sentence('d.text', 'l.s', 'l.e')} AS sentence FROM {O.layer()} l JOIN documents d ON d.doc_id = l.doc_id))""")
def highlighted_sentences(spark, sf_dir):
    found = patterns.detect_patterns(docs(spark, sf_dir)).select("doc_id", "start", "end", F.col("text").alias("value")).join(docs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "start", scalars.highlight(scalars.sentence("text", F.col("start"), F.col("end")), "value").alias("h")).select("doc_id", "start", "h.*")


def _points(units: str) -> str:
    """Code points that begin within so many UTF-16 units, of which the queries use fewer than 200."""
    return rf"len(list_filter(range(0, least(length(text), 200)), lambda i: i + length(regexp_replace(substr(text, 1, i), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) < {units}))"


@query(rf"""SELECT doc_id, least(a, b) AS "start", greatest(a, b) AS "end" FROM (SELECT doc_id, text, CAST({_points('doc_id * 7 % 90')} AS INTEGER) AS a, CAST({_points('doc_id * 13 % 110')} AS INTEGER) AS b FROM {BOTH})
WHERE a <> b AND regexp_matches(substr(text, least(a, b) + 1, abs(a - b)), '\S')""")
def selected_ranges(spark, sf_dir):
    """Selections made of each document's id, in UTF-16 units as screens give them."""
    both = docs(spark, sf_dir).union(rows(spark, CASES))
    anchor, focus = scalars.from_utf16("text", (F.col("doc_id") * 7 % 90).cast("int")), scalars.from_utf16("text", (F.col("doc_id") * 13 % 110).cast("int"))
    return both.select("doc_id", scalars.selected_range("text", anchor, focus).alias("r")).where("r is not null").select("doc_id", "r.start", "r.end")


def _log(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Actions of all kinds, sound and unsound ones, made of each finding's offsets; the log of every third document starts with an undo."""
    n, s, e = F.col("n").cast("long"), F.col("start"), F.col("end")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    added = F.concat(F.lit("manual:"), s, F.lit("-"), e + 2)

    def act(seq, kind, target=text, start=number, end=number):
        return F.struct(seq.alias("seq"), kind.alias("type"), target.alias("target_id"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("pii_type"))

    made = F.array(
        act(n * 5, F.when(s % 2 == 0, "accept").otherwise("dismiss"), F.col("id")),
        act(n * 5 + 1, F.when(e % 3 == 0, "undo")),
        act(n * 5 + 2, F.when(s % 5 == 0, "add_missed"), text, s, e + 2),
        act(n * 5 + 3, F.when(s % 7 < 2, "accept").when(s % 7 == 2, "fly").when(s % 7 == 3, "add_missed").when(s % 7 == 4, "undo"), F.when(s % 7 == 0, added).when(s % 7 == 1, "m:0-0")),
    )
    own = found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))).select("doc_id", F.explode(made).alias("a")).select("doc_id", "a.*")
    first = documents.where("doc_id % 3 = 0").select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("undo").alias("type"), text.alias("target_id"), number.alias("start"), number.alias("end"), text.alias("pii_type"))
    return own.where("type is not null").unionByName(first)


def _reviewed(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = merge.merge(patterns.detect_patterns(d)).persist()
    return d, found, _log(d, found)


@query(f"{O.REPLAYED} SELECT doc_id, x.id AS id, x.status AS status FROM (SELECT doc_id, unnest(items) AS x FROM final)")
def action_fold(spark, sf_dir):
    return review.queue(*_reviewed(spark, sf_dir)).select("doc_id", "id", "status")


@query(f"{O.REPLAYED} SELECT doc_id, seq, error FROM replay WHERE error IS NOT NULL")
def action_errors(spark, sf_dir):
    return review.action_errors(*_reviewed(spark, sf_dir))


@query(f"""{O.REPLAYED}, acc AS (SELECT doc_id, x.s AS s, x.e AS e FROM (SELECT doc_id, unnest(items) AS x FROM final) WHERE x.status = 'accepted'),
  p AS (SELECT doc_id, s, e, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS before FROM acc)
  SELECT d.doc_id, CASE WHEN max(CAST(p.s < p.before AS INTEGER)) = 1 THEN NULL ELSE
    coalesce(string_agg(substr(d.text, coalesce(p.before, 0) + 1, p.s - coalesce(p.before, 0)) || '[REDACTED]', '' ORDER BY p.s), '') || substr(d.text, coalesce(max(p.e), 0) + 1) END AS output_text
  FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.text""")
def review_preview(spark, sf_dir):
    d, found, log = _reviewed(spark, sf_dir)
    return review.preview(d, review.queue(d, found, log), "REDACT")[0].select("doc_id", "output_text")


@query(f"{O.REPLAYED} SELECT doc_id, seq FROM acts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) <= 2")
def recent_actions(spark, sf_dir):
    return review.recent_actions(_reviewed(spark, sf_dir)[2], 2).select("doc_id", "seq")


@query(f'{FOUND} SELECT doc_id, s AS "start", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {O.TIER}, s, e) AS INTEGER) AS place FROM found')
def ranked_findings(spark, sf_dir):
    return review.ordered(_detected(spark, sf_dir).findings).select("doc_id", "start", "place")


@query(f"""SELECT doc_id, s AS "start", CASE s % 4 WHEN 1 THEN e + 1000000 WHEN 2 THEN s - 1 ELSE e END AS "end", CASE s % 4 WHEN 0 THEN v WHEN 3 THEN v END AS text, CASE s % 4 WHEN 0 THEN NULL WHEN 3 THEN 'span_offset_mismatch' ELSE 'span_offsets_out_of_range' END AS error FROM {O.layer()}""")
def span_check(spark, sf_dir):
    """Claims made of the pattern layer's spans: every fourth is sound, the others end beyond the text or before they start, or claim another text."""
    d = docs(spark, sf_dir)
    kind = F.col("start") % 4
    end = F.when(kind == 1, F.col("end") + 1_000_000).when(kind == 2, F.col("start") - 1).otherwise(F.col("end"))
    claims = patterns.detect_patterns(d).select("doc_id", "start", end.alias("end"), F.when(kind == 0, F.col("text")).when(kind == 3, F.concat("text", F.lit("?"))).alias("text"))
    return spans.checked(claims, d).select("doc_id", "start", "end", "text", F.col("error.code").alias("error"))


@query(f"""SELECT doc_id, s AS "start", e AS "end", p AS previous_end FROM (SELECT doc_id, s, e, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS p FROM {O.candidates(KNOWN)}) WHERE s < p""")
def overlapping_spans(spark, sf_dir):
    return spans.overlapping(_detected(spark, sf_dir).candidates)


@query(f"""SELECT x.doc_id, x.id FROM (SELECT doc_id, 'regex:' || s || '-' || (e + s % 2) AS id FROM {O.layer()}) x WHERE NOT EXISTS (SELECT 1 FROM {O.layer()} l WHERE l.doc_id = x.doc_id AND 'regex:' || l.s || '-' || l.e = x.id)""")
def unknown_ids(spark, sf_dir):
    own = patterns.detect_patterns(docs(spark, sf_dir))
    return spans.unknown_ids(own.select("doc_id", F.concat(F.lit("regex:"), "start", F.lit("-"), F.col("end") + F.col("start") % 2).alias("id")), own)


@query(r"""SELECT page_id AS doc_id, CAST(0 AS INTEGER) AS page, CASE WHEN length(t) < 10 THEN 'raster' ELSE 'digital' END AS kind, CAST(length(t) AS INTEGER) AS extractable_chars
FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\s+|\s+\z', '', 'g') AS t FROM pages)""")
def page_kinds(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return raster.page_kinds(pages)


#: The documents as recognised words: every seventh is of no confidence; a line feed ends a line. With the words that are
#: kept and their offsets in the page's text.
WITH_PAGES = r"""WITH tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+|\n') AS w FROM documents)),
lines AS (SELECT *, count(*) FILTER (t = chr(10)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS line FROM tok),
kept AS (SELECT *, CASE WHEN lag(line) OVER o IS NULL THEN '' WHEN lag(line) OVER o <> line THEN chr(10) ELSE ' ' END AS sep FROM lines WHERE t <> chr(10) AND k % 7 <> 3 AND regexp_matches(t, '\S') WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
placed AS MATERIALIZED (SELECT doc_id, k, t, sep, line, CAST(sum(length(sep) + length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM kept),
page AS MATERIALIZED (SELECT doc_id, string_agg(sep || t, '' ORDER BY k) AS text FROM placed GROUP BY doc_id)"""


def _words(spark, sf_dir, only: DataFrame | None = None):
    """The placed words of all documents, or of those whose ids are in ``only``."""
    d = docs(spark, sf_dir)
    d = d if only is None else d.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    tokens = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+|\n"), F.lit(0))).alias("ord", "text"))
    line = F.count_if(F.col("text") == "\n").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    number = lambda c: c.cast("int")
    made = tokens.select("doc_id", F.lit(0).alias("page"), "ord", "text", F.when(F.col("ord") % 7 == 3, "-1").otherwise("90.5").alias("conf"), F.lit(1).alias("block"), F.lit(1).alias("par"), number(line).alias("line"), number(F.col("ord") * 10).alias("left"), number(line * 12).alias("top"), F.lit(8).alias("width"), F.lit(10).alias("height"))
    return raster.placed_words(made)


@query(f"{WITH_PAGES} SELECT doc_id, CAST(0 AS INTEGER) AS page, text FROM page")
def ocr_text(spark, sf_dir):
    return raster.page_texts(_words(spark, sf_dir))


@query(f"{WITH_PAGES} SELECT l.doc_id, CAST(p.k AS INTEGER) AS ord, CAST(10 * p.k AS INTEGER) AS x0, CAST(10 * p.k + 8 AS INTEGER) AS x1 FROM {O.layer('page')} l JOIN placed p ON p.doc_id = l.doc_id AND p.e - length(p.t) < l.e AND l.s < p.e")
def span_boxes(spark, sf_dir):
    """Words are exchanged for the page texts; a second time only those of pages that have spans."""
    found = patterns.detect_patterns(raster.page_texts(_words(spark, sf_dir))).withColumn("page", F.lit(0)).persist()
    return raster.span_boxes(found, _words(spark, sf_dir, found)).select("doc_id", "ord", "box.x0", "box.x1")


@query(f"""SELECT doc_id, s AS "start", e AS "end", v AS text FROM {O.hits('[0-9]{1,3}([.][0-9]{1,3}){3}')} h
WHERE NOT EXISTS (SELECT 1 FROM {O.layer()} l WHERE l.doc_id = h.doc_id AND h.s < l.e AND l.s < h.e)""")
def visible_ips(spark, sf_dir):
    d = docs(spark, sf_dir)
    return consistency.extra_formats(d, patterns.detect_patterns(d)).where("kind = 'IP'").select("doc_id", "start", "end", "text")


@query(f"""SELECT doc_id, v AS text, CAST(n AS INTEGER) AS occurrence, CASE WHEN len(g) > n THEN CAST(pos AS INTEGER) END AS "start", CASE WHEN len(g) > n THEN CAST(pos + length(v) AS INTEGER) END AS "end"
FROM (SELECT *, list_sum(list_transform(g[1:n], lambda x: length(x))) + (n - 1) * length(v) AS pos FROM (SELECT l.doc_id, l.v, 1 + l.s % 2 AS n, string_split(d.text, l.v) AS g FROM {O.layer()} l JOIN documents d USING (doc_id)))""")
def resolve_occurrences(spark, sf_dir):
    """The first or second place of each value of the pattern layer, which there may not be."""
    d = docs(spark, sf_dir)
    wanted = patterns.detect_patterns(d).select("doc_id", "text", (F.lit(1) + F.col("start") % 2).alias("occurrence"))
    return consistency.resolved_occurrences(d, wanted).select("doc_id", "text", "occurrence", "start", "end")


@query(f"""{FOUND}, w AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL)
SELECT w.doc_id, CAST(w.s AS INTEGER) AS "start", CAST(w.e AS INTEGER) AS "end", substr(d.text, w.s + 1, w.e - w.s) AS text, b.type FROM w JOIN best b ON b.doc_id = w.doc_id AND b.island = w.island JOIN documents d ON d.doc_id = w.doc_id""")
def wide_findings(spark, sf_dir):
    """Findings whose offsets are those of all candidates that overlap."""
    d = _detected(spark, sf_dir)
    return merge.merge(d.candidates, d.ranges, whole=docs(spark, sf_dir)).select("doc_id", "start", "end", "text", "type")


WORD = r"[\p{L}\p{N}_]{3,}"


@query(rf"""SELECT w.doc_id, w.s AS "start", w.e AS "end", w.v AS text FROM {O.hits(WORD)} w
SEMI JOIN (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(v, '{WORD}'))) AS part FROM {O.layer()}) p ON p.doc_id = w.doc_id AND p.part = lower(w.v)
WHERE NOT EXISTS (SELECT 1 FROM {O.layer()} l WHERE l.doc_id = w.doc_id AND w.s < l.e AND l.s < w.e)""")
def leaked_parts(spark, sf_dir):
    d = docs(spark, sf_dir)
    return consistency.leaked_parts(d, patterns.detect_patterns(d).persist())


SECOND = rf"""WITH l AS MATERIALIZED (SELECT * FROM {O.layer()}), p AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(v, '{WORD}'))) AS part FROM l),
c AS (SELECT w.doc_id, s, e, 'consistency' AS lens FROM {O.hits(WORD)} w JOIN p ON p.doc_id = w.doc_id AND p.part = lower(w.v) UNION ALL SELECT doc_id, s, e, 'format' FROM {O.hits(consistency.EXTRA_FORMATS["IP"])}
  UNION ALL SELECT doc_id, s, e, 'format' FROM {O.hits(consistency.EXTRA_FORMATS["URL"])} UNION ALL SELECT doc_id, s, e, 'format' FROM {O.hits(consistency.EXTRA_FORMATS["POLICY"])}
  UNION ALL SELECT doc_id, CAST(w_start + strpos(chunk, v) - 1 AS INTEGER), CAST(w_start + strpos(chunk, v) - 1 + length(v) AS INTEGER), 'semantic'
    FROM (SELECT *, regexp_extract(chunk, '{LONG}') AS v FROM {_windows("black")} WHERE regexp_matches(lower(chunk), '(^|[^\p{{L}}\p{{N}}_])({TRIGGERS})([^\p{{L}}\p{{N}}_]|$)')) WHERE v <> ''),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = c.doc_id AND c.s < l.e AND l.s < c.e)),
m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e, list_sort(list(DISTINCT lens)) AS lenses FROM i GROUP BY doc_id, island)
SELECT g.doc_id, CAST(row_number() OVER (PARTITION BY g.doc_id ORDER BY CASE WHEN list_contains(lenses, 'consistency') THEN 0 WHEN list_contains(lenses, 'format') THEN 1 ELSE 2 END, s) AS INTEGER) AS ord,
  CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", substr(d.text, s + 1, e - s) AS text, lenses, CASE WHEN lenses = ['semantic'] THEN 'review' ELSE 'suggest' END AS severity FROM g JOIN documents d ON d.doc_id = g.doc_id"""


@query(SECOND.replace("WITH l AS MATERIALIZED", f"WITH black AS MATERIALIZED ({_text_sql(chr(39) + chr(39)).replace('output_text', 'text').replace('p.token', 'repeat(chr(9608), p.e - p.s)')}), l AS MATERIALIZED"))
def second_looks(spark, sf_dir):
    """What formats, parts of hidden values and a quoting model still find once the pattern layer's spans are hidden."""
    d = docs(spark, sf_dir)
    return consistency.second_looks(d, patterns.detect_patterns(d).persist(), QuotesWord(LONG))


#: What is taken for true: spans of the note, and those of the documents' findings that don't start at a multiple of five, moved by up to three.
TRUTH = [("PERSON", "Anna Hartwell"), ("PERSON", "Martin Sorvik"), ("PERSON", "Anna has"), ("PHONE", "0413 555 760"), ("PHONE", "+61 413 555 760"), ("EMAIL", "anna.h@mail.example.org"), ("ADDRESS", "27 Riverbank Street, Newtown NSW 2042"), ("ID_NUMBER", "CR-10442-AC"), ("OTHER", "Claimant")]
TRUE_SPANS = [(-1, kind, NOTE.index(v), NOTE.index(v) + len(v)) for kind, v in TRUTH]


@query(f"""{NOTE_FOUND}, truth AS (SELECT doc_id, type, s + s % 4 AS s, e + s % 4 AS e FROM {O.layer()} WHERE s % 5 <> 0 UNION ALL SELECT * FROM (VALUES {', '.join(str(r) for r in TRUE_SPANS)}) v(doc_id, type, s, e)),
p AS (SELECT type, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = f.doc_id AND t.type = f.type AND t.s < f.e AND f.s < t.e)) AS r FROM found f GROUP BY type),
t AS (SELECT type, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE t.doc_id = f.doc_id AND t.type = f.type AND t.s < f.e AND f.s < t.e)) AS r FROM truth t GROUP BY type)
SELECT type, coalesce(p.n, 0) AS predicted, coalesce(t.n, 0) AS "true", p.r / p.n AS precision, t.r / t.n AS recall FROM p FULL JOIN t USING (type)""")
def score_against_labels(spark, sf_dir):
    moved = patterns.detect_patterns(docs(spark, sf_dir)).where("start % 5 <> 0").select("doc_id", "type", (F.col("start") + F.col("start") % 4).alias("start"), (F.col("end") + F.col("start") % 4).alias("end"))
    truth = moved.union(spark.createDataFrame(TRUE_SPANS, "doc_id long, type string, start int, end int"))
    return consistency.scored(detect(noted(spark, sf_dir)).findings, truth)


@query(f"""WITH l AS (SELECT *, type || ':' || CASE WHEN type = 'PHONE' THEN {O.canonical('norm')} ELSE norm END AS key FROM {O.layer()} WHERE norm <> '' AND s % 3 > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM l) SELECT doc_id, s AS "start", e AS "end", v AS text FROM n WHERE c >= 2""")
def repeated_values(spark, sf_dir):
    """Values that stand twice or more outside hidden spans, which are those that start at a multiple of three."""
    found = patterns.detect_patterns(docs(spark, sf_dir))
    return consistency.repeated_values(found, found.where("start % 3 = 0")).select("doc_id", "start", "end", "text")


@query(_text_sql("'[REDACTED]'"))
def exported_once(spark, sf_dir):
    """Redacted texts through the export sink, handed to it twice, as they are read back."""
    d = docs(spark, sf_dir)
    text = render.rendered(d, _accepted(spark, sf_dir), "REDACT")
    sink = sinks.export_sink(spark, sinks.shared_folder(spark))
    exports = text.select("doc_id", F.lit(False).alias("gated"), "output_text", F.array().cast("array<struct<ord:int,token:string,type:string,occurrences:bigint>>").alias("legend"), F.array().cast("array<struct<start:int,end:int,id:string>>").alias("unresolved"), "error")
    for _ in range(2):
        sinks.put_exports(sink, "all", exports)
    return sink.read().select("doc_id", "output_text")


@query(f"""{FOUND}, q AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({O.TIER} = 1) AS high FROM found GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM cand GROUP BY doc_id)
SELECT d.doc_id, 'REDACT' AS output_mode, CAST(4 AS INTEGER) AS layers, coalesce(c.n, 0)::BIGINT AS candidates, CAST(coalesce(q.n, 0) AS INTEGER) AS queue, coalesce(q.high, 0)::BIGINT AS tier1, coalesce(q.high, 0)::BIGINT AS unresolved_high_risk
FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id WHERE length(d.text) > 0""")
def review_state(spark, sf_dir):
    """The nested state of every review that has just begun, in numbers."""
    d = detect(docs(spark, sf_dir), KNOWN, ALLOWED, names=False, keep=True)
    whole = docs(spark, sf_dir).where("length(text) > 0")
    state = review.state(whole, review.queue(whole, d.findings.drop("linked")), d.layers, "REDACT")
    return state.select("doc_id", "output_mode", F.size("layers").alias("layers"), F.aggregate("layers", F.lit(0).cast("long"), lambda n, x: n + x["count"]).alias("candidates"), F.size(F.coalesce("queue", F.array())).alias("queue"), "counts.tier1", "counts.unresolved_high_risk")


@query(f"""{FOUND}, k AS (SELECT doc_id, s, e, {STATUS} AS status FROM found WHERE {STATUS} <> 'dismissed'),
g AS (SELECT d.doc_id, d.text, k.s, k.e, k.status, coalesce(lag(k.e) OVER (PARTITION BY d.doc_id ORDER BY k.s), 0) AS before FROM documents d JOIN k ON k.doc_id = d.doc_id),
last AS (SELECT d.doc_id, d.text, coalesce(max(k.e), 0) AS before FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.text),
parts AS (SELECT doc_id, s, e, 'span' AS kind, CASE WHEN status = 'accepted' THEN repeat('█', greatest(3, e - s)) ELSE substr(text, s + 1, e - s) END AS shown FROM g
  UNION ALL SELECT doc_id, before, s, 'text', substr(text, before + 1, s - before) FROM g WHERE before < s
  UNION ALL SELECT doc_id, before, CAST(length(text) AS INTEGER), 'text', substr(text, before + 1) FROM last WHERE before < length(text))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e, kind) AS INTEGER) AS ord, s AS "start", e AS "end", kind, shown FROM parts""")
def render_segments(spark, sf_dir):
    return render.segments(docs(spark, sf_dir), _items(spark, sf_dir), "REDACT")


@query(f"""{FOUND} SELECT doc_id, s AS "start", CASE WHEN confidence >= 0.95 THEN 'certain' WHEN confidence >= 0.8 THEN 'strong' WHEN confidence >= 0.6 THEN 'likely' ELSE 'weak' END AS word, round(0.35 + 0.65 * confidence, 6) AS opacity, CAST(links + 1 AS INTEGER) AS places FROM found""")
def confidence_display(spark, sf_dir):
    f = _detected(spark, sf_dir).findings
    return f.select("doc_id", "start", scalars.confidence_word("confidence").alias("word"), F.round(scalars.confidence_opacity("confidence"), 6).alias("opacity"), scalars.places(F.col("linked_count").cast("int")).alias("places"))


@query(f"""SELECT l.toxic, h.type, count(*) AS n FROM {O.layer()} h JOIN labels l USING (doc_id) GROUP BY l.toxic, h.type""")
def findings_by_label(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return patterns.detect_patterns(docs(spark, sf_dir)).join(labels, "doc_id").groupBy("toxic", "type").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the whole pipeline over the documents."""
    return detect(docs(spark, sf_dir)).findings.drop("link_group", "linked_count")


__all__ = ["ORACLE_SQL", "QUERIES", "SpanError", "flagship"]
