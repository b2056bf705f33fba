"""SQL for DuckDB that yields the rows of the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from collections.abc import Sequence

# The patterns in RE2's dialect.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s().\-]{7,}\d"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
ACCOUNT = r"\b\d[\d \-]{11,21}\d\b"
REFERENCE = r"\b[A-Z0-9]+(?:-[A-Z0-9]+)+\b"
STREET_TYPES = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Boulevard|Blvd|Way|Terrace|Tce|Crescent|Cres"
NAME = r"[A-Z][a-zà-öø-ÿ]+"
#: The name rules: type, reason, confidence, what stands before a match, the match, what stands after it.
NAME_RULES = [
    ("ADDRESS", "matched a full street address", 0.8, "", rf"\b\d{{1,5}}\s+[A-Z][A-Za-z]+(?:\s+[A-Za-z]+)*?\s+(?:{STREET_TYPES})\b[^\n]*?\b\d{{4}}\b", ""),
    ("PERSON", "took this for a person name", 0.85, r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? ", rf"{NAME}(?:[ -]{NAME}){{0,3}}", ""),
    ("PERSON", "took this for a person name", 0.75, r"\b(?:supervisor|manager|colleague|partner|spouse|wife|husband|mother|father|son|daughter|brother|sister|friend|landlord|tenant|assistant|director|officer|doctor|nurse), ", f"{NAME} {NAME}", ""),
    ("PERSON", "took this for a person name", 0.6, r"[.!?\n] ", NAME, " (?:has|said|asked|called|confirmed|told|wrote) "),
    ("ORG", "took this for an organisation", 0.7, "", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,3} (?:Mutual|Ltd|Limited|Inc|Pty|Bank|Group|Court|University)\b", ""),
]


def text_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def hits(pattern: str, source: str = "documents") -> str:
    """Every match with its offsets: doc_id, s, e, v."""
    p = text_literal(pattern)
    return f"""(SELECT doc_id, CAST(pos AS INTEGER) AS s, CAST(pos + length(v) AS INTEGER) AS e, v FROM (
      SELECT doc_id, m[k] AS v, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS pos
      FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM (
        SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p})))))"""


def terms(pairs: list[tuple[str, str]], source: str = "documents") -> str:
    """Every whole-word match of the terms: doc_id, ord, type, s, e, v."""
    if not pairs:
        return f"(SELECT doc_id, 0 AS ord, '' AS type, 0 AS s, 0 AS e, '' AS v FROM {source} WHERE false)"
    rows = ", ".join(f"({k}, {text_literal(t.lower())}, {text_literal(kind)})" for k, (t, kind) in enumerate(pairs))
    return f"""(SELECT doc_id, ord, type, CAST(pos AS INTEGER) AS s, CAST(pos + length(term) AS INTEGER) AS e, substr(text, CAST(pos AS BIGINT) + 1, length(term)) AS v FROM (
      SELECT doc_id, text, ord, type, term, list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(term) AS pos
      FROM (SELECT doc_id, text, ord, type, term, g, unnest(range(1, len(g))) AS k FROM (
        SELECT doc_id, text, ord, type, term, string_split(lower(text), term) AS g FROM {source}, (VALUES {rows}) AS t(ord, term, type) WHERE contains(lower(text), term))))
      WHERE NOT regexp_matches(CASE WHEN pos = 0 THEN ' ' ELSE substr(text, CAST(pos AS BIGINT), 1) END, '[\\p{{L}}\\p{{N}}_]')
        AND NOT regexp_matches(substr(text, CAST(pos AS BIGINT) + length(term) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""


def phrases(terms: str, source: str = "documents") -> str:
    """The same for a table of lower-case terms: doc_id, term, s, e, v."""
    return f"""(SELECT doc_id, term, CAST(pos AS INTEGER) AS s, CAST(pos + length(term) AS INTEGER) AS e, substr(text, CAST(pos AS BIGINT) + 1, length(term)) AS v FROM (
      SELECT doc_id, text, term, list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * length(term) AS pos
      FROM (SELECT doc_id, text, term, g, unnest(range(1, len(g))) AS k FROM (SELECT doc_id, text, term, string_split(low, term) AS g FROM (SELECT doc_id, text, lower(text) AS low FROM {source}) d JOIN {terms} t ON contains(low, term))))
      WHERE NOT regexp_matches(CASE WHEN pos = 0 THEN ' ' ELSE substr(text, CAST(pos AS BIGINT), 1) END, '[\\p{{L}}\\p{{N}}_]')
        AND NOT regexp_matches(substr(text, CAST(pos AS BIGINT) + length(term) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""


DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"""(length({DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({DIGITS})),
  lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({DIGITS}, CAST(length({DIGITS}) - i AS BIGINT), 1) AS INTEGER)
    ELSE CAST(substr({DIGITS}, CAST(length({DIGITS}) - i AS BIGINT), 1) AS INTEGER) * 2 - 9 * CAST(CAST(substr({DIGITS}, CAST(length({DIGITS}) - i AS BIGINT), 1) AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0)"""


def families(source: str = "documents") -> str:
    """The candidates of all pattern families: doc_id, s, e, v, type, reason, norm, prio."""
    return f"""(SELECT doc_id, s, e, v, 'EMAIL' AS type, 'email-address pattern' AS reason, lower(v) AS norm, 0 AS prio FROM {hits(EMAIL, source)}
    UNION ALL SELECT doc_id, s, e, v, 'PHONE', 'phone-number pattern', {DIGITS}, 1 FROM {hits(PHONE, source)} WHERE length({DIGITS}) BETWEEN 9 AND 15
    UNION ALL SELECT doc_id, s, e, v, 'ID_NUMBER', 'US SSN pattern (NNN-NN-NNNN)', NULL, 2 FROM {hits(SSN, source)}
    UNION ALL SELECT doc_id, s, e, v, 'ID_NUMBER', 'Luhn-valid account/card number', {DIGITS}, 2 FROM {hits(ACCOUNT, source)} WHERE {LUHN}
    UNION ALL SELECT doc_id, s, e, v, 'ID_NUMBER', 'alphanumeric reference/ID code', NULL, 3 FROM {hits(REFERENCE, source)} WHERE regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]'))"""


def layer(source: str = "documents") -> str:
    """The pattern layer's spans after greedy resolution: doc_id, s, e, v, type, reason, norm, ord."""
    return f"""(SELECT doc_id, x.s AS s, x.e AS e, x.v AS v, x.type AS type, x.reason AS reason, x.norm AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY x.s) - 1 AS ord FROM (
      SELECT doc_id, unnest(list_reduce(list_transform(l, lambda y: [y]), lambda kept, y: CASE WHEN len(list_filter(kept, lambda k: y[1].s < k.e AND k.s < y[1].e)) > 0 THEN kept ELSE list_concat(kept, y) END)) AS x FROM (
        SELECT doc_id, list_sort(list({{'p': prio, 'n': s - e, 's': s, 'e': e, 'v': v, 'type': type, 'reason': reason, 'norm': norm}})) AS l FROM {families(source)} GROUP BY doc_id)))"""


def values(rows: list[tuple[int, str]]) -> str:
    """Inline documents as a source."""
    return "(SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), {text_literal(t)})" for k, t in rows) + ") AS d(doc_id, text))"


def canonical(digits: str) -> str:
    return f"(CASE WHEN starts_with({digits}, '0') THEN substr({digits}, 2) WHEN starts_with({digits}, '61') THEN substr({digits}, 3) ELSE {digits} END)"


def names_layer(source: str = "documents", allowed: Sequence[str] = ()) -> str:
    """The name rules' spans after greedy resolution, without those that overlap an allowed term: doc_id, s, e, v, type, reason, confidence, ord."""
    found = " UNION ALL ".join(
        f"""SELECT doc_id, CAST(s + a AS INTEGER) AS s, CAST(e - b AS INTEGER) AS e, substr(v, a + 1, length(v) - a - b) AS v, '{kind}' AS type, 'name rules {reason}' AS reason, {confidence}::DOUBLE AS confidence
        FROM (SELECT *, length(regexp_extract(v, {text_literal(f"^(?:{lead})")})) AS a, length(regexp_extract(v, {text_literal(f"(?:{trail})$")})) AS b FROM {hits(f"{lead}(?:{pattern}){trail}", source)})"""
        for kind, reason, confidence, lead, pattern, trail in NAME_RULES
    )
    return f"""(SELECT doc_id, x.s AS s, x.e AS e, x.v AS v, x.type AS type, x.reason AS reason, x.confidence AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY x.s) - 1 AS ord FROM (
      SELECT doc_id, unnest(list_reduce(list_transform(l, lambda y: [y]), lambda kept, y: CASE WHEN len(list_filter(kept, lambda k: y[1].s < k.e AND k.s < y[1].e)) > 0 THEN kept ELSE list_concat(kept, y) END)) AS x FROM (
        SELECT doc_id, list_sort(list({{'n': s - e, 'c': -confidence, 's': s, 'e': e, 'v': v, 'type': type, 'reason': reason, 'confidence': confidence}})) AS l FROM ({found}) f
        WHERE NOT EXISTS (SELECT 1 FROM {terms([(a, "") for a in allowed], source)} r WHERE r.doc_id = f.doc_id AND f.s < r.e AND r.s < f.e) GROUP BY doc_id)))"""


def candidates(known: list[tuple[str, str]], source: str = "documents", names: str | None = None) -> str:
    """Pattern and dictionary candidates, and those of ``names`` (a names_layer): doc_id, arrival, s, e, v, type, confidence, source, reason, norm."""
    named = "" if names is None else f" UNION ALL SELECT doc_id, 2199023255552 + CAST(ord AS BIGINT), s, e, v, type, confidence, 'ner', reason, NULL FROM {names}"
    return f"""(SELECT doc_id, CAST(ord AS BIGINT) AS arrival, s, e, v, type, 0.99::DOUBLE AS confidence, 'regex' AS source, reason, norm FROM {layer(source)}
    UNION ALL SELECT doc_id, 1099511627776 + CAST(s AS BIGINT) * 65536 + ord, s, e, v, type, 0.98::DOUBLE, 'dictionary', 'exact match against the closed-world ' || type || ' list', NULL FROM {terms(known, source)}{named})"""


def findings(known: list[tuple[str, str]], allowed: Sequence[str], source: str = "documents", names: bool = False) -> str:
    """WITH clauses up to ``found``: the merged findings."""
    linkable = f"norm IS NOT NULL AND norm <> ''"
    return f"""WITH cand AS {candidates(known, source, names_layer(source, allowed) if names else None)}, allow AS {terms([(a, '') for a in allowed], source)},
    kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.doc_id = c.doc_id AND c.s < a.e AND a.s < c.e)),
    marked AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM kept),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, arrival ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY CASE WHEN source IN ('regex', 'dictionary') THEN 0 WHEN source = 'llm' THEN 1 ELSE 2 END, confidence DESC, s, e, arrival) AS n FROM isl) WHERE n = 1),
    fact AS (SELECT doc_id, island, max(confidence) AS confidence, list_sort(list(DISTINCT source)) AS sources, first(norm ORDER BY s, e, arrival) FILTER (WHERE {linkable}) AS norm FROM isl GROUP BY doc_id, island),
    why AS (SELECT doc_id, island, string_agg(r, ' | ' ORDER BY k) AS reason FROM (SELECT doc_id, island, '[' || source || '] ' || reason AS r, min(arrival_rank) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY s, e, arrival) AS arrival_rank FROM isl) GROUP BY ALL) GROUP BY doc_id, island),
    joined AS (SELECT b.doc_id, b.s, b.e, b.v, b.type, f.confidence, f.sources, w.reason, f.norm, CASE WHEN f.norm IS NOT NULL THEN b.type || ':' || CASE WHEN b.type = 'PHONE' THEN {canonical('f.norm')} ELSE f.norm END END AS key
      FROM best b JOIN fact f ON f.doc_id = b.doc_id AND f.island = b.island JOIN why w ON w.doc_id = b.doc_id AND w.island = b.island),
    found AS (SELECT *, (SELECT count(*) FROM joined o WHERE o.doc_id = j.doc_id AND o.key = j.key AND (o.s <> j.s OR o.e <> j.e)) AS links FROM joined j)"""


TIER = "CASE WHEN links > 0 OR list_contains(sources, 'regex') OR list_contains(sources, 'dictionary') THEN 1 WHEN sources = ['llm'] THEN 3 ELSE 2 END"


def sentence(text: str, s: str, e: str) -> str:
    return f"regexp_replace(regexp_extract(substr({text}, 1, {s}), '[^.!?\\n]*\\z') || substr({text}, {s} + 1, {e} - {s}) || regexp_extract(substr({text}, {e} + 1), '\\A[^.!?\\n]*'), '^\\s+|\\s+\\z', '', 'g')"


def model_sentence(text: str, s: str, e: str) -> str:
    return f"trim(regexp_extract(substr({text}, 1, {s}), '[^.\\n]*\\z') || substr({text}, {s} + 1, {e} - {s}) || regexp_extract(substr({text}, {e} + 1), '\\A[^.\\n]*[.\\n]?'), ' ' || chr(10))"


#: WITH clauses up to ``replay`` and ``final``: the review log of the registered queries, replayed one action a step with
#: a stack of what each changed. Items: id, s, e, key (what links them), status.
REPLAYED = f"""WITH RECURSIVE own AS MATERIALIZED (SELECT doc_id, s, e, 'm:' || s || '-' || e AS id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n,
    CASE WHEN norm <> '' THEN type || ':' || CASE WHEN type = 'PHONE' THEN {canonical('norm')} ELSE norm END END AS key FROM {layer()}),
  acts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM (
    SELECT doc_id, 5 * n AS seq, CASE WHEN s % 2 = 0 THEN 'accept' ELSE 'dismiss' END AS type, id AS target, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b FROM own
    UNION ALL SELECT doc_id, 5 * n + 1, 'undo', NULL, NULL, NULL FROM own WHERE e % 3 = 0
    UNION ALL SELECT doc_id, 5 * n + 2, 'add_missed', NULL, s, e + 2 FROM own WHERE s % 5 = 0
    UNION ALL SELECT doc_id, 5 * n + 3, CASE s % 7 WHEN 2 THEN 'fly' WHEN 3 THEN 'add_missed' WHEN 4 THEN 'undo' ELSE 'accept' END, CASE s % 7 WHEN 0 THEN 'manual:' || s || '-' || (e + 2) WHEN 1 THEN 'm:0-0' END, NULL, NULL FROM own WHERE s % 7 < 5
    UNION ALL SELECT doc_id, 0, 'undo', NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0)),
  replay AS (
    SELECT d.doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS seq, length(d.text) AS size, CAST(coalesce(i.items, []) AS STRUCT(id VARCHAR, s INTEGER, e INTEGER, key VARCHAR, status VARCHAR)[]) AS items,
      CAST([] AS STRUCT(kind VARCHAR, changes STRUCT(id VARCHAR, status VARCHAR)[])[]) AS stack, CAST(NULL AS VARCHAR) AS error
    FROM documents d LEFT JOIN (SELECT doc_id, list(struct_pack(id := id, s := s, e := e, key := key, status := 'pending') ORDER BY s) AS items FROM own GROUP BY doc_id) i USING (doc_id)
    UNION ALL
    SELECT doc_id, k + 1, seq, size,
      CASE WHEN error IS NOT NULL THEN items
        WHEN type = 'undo' AND top.kind = 'added' THEN list_filter(items, lambda x: x.id <> top.changes[1].id)
        WHEN type = 'undo' THEN list_transform(items, lambda x: struct_pack(id := x.id, s := x.s, e := x.e, key := x.key, status := coalesce(list_filter(top.changes, lambda c: c.id = x.id)[1].status, x.status)))
        WHEN type = 'add_missed' THEN list_append(items, struct_pack(id := 'manual:' || a || '-' || b, s := a, e := b, key := CAST(NULL AS VARCHAR), status := 'accepted'))
        ELSE list_transform(items, lambda x: struct_pack(id := x.id, s := x.s, e := x.e, key := x.key, status := CASE WHEN x.id = target OR x.key = tkey THEN CASE WHEN type = 'accept' THEN 'accepted' ELSE 'dismissed' END ELSE x.status END)) END,
      CASE WHEN error IS NOT NULL THEN stack WHEN type = 'undo' THEN stack[1:-2]
        WHEN type = 'add_missed' THEN list_append(stack, struct_pack(kind := 'added', changes := [struct_pack(id := 'manual:' || a || '-' || b, status := CAST(NULL AS VARCHAR))]))
        ELSE list_append(stack, struct_pack(kind := 'decided', changes := list_transform(list_filter(items, lambda x: x.id = target OR coalesce(x.key = tkey, false)), lambda x: struct_pack(id := x.id, status := x.status)))) END,
      error
    FROM (SELECT r.doc_id, r.k, r.size, r.items, r.stack, c.seq, c.type, c.target, c.a, c.b, r.stack[-1] AS top, list_filter(r.items, lambda x: x.id = c.target)[1].key AS tkey,
        CASE WHEN c.type IN ('accept', 'dismiss') THEN CASE WHEN len(list_filter(r.items, lambda x: x.id = c.target)) = 0 THEN 'unknown_item' END
          WHEN c.type = 'add_missed' THEN CASE WHEN c.a IS NULL OR c.b IS NULL THEN 'missing_selection' WHEN NOT (0 <= c.a AND c.a <= c.b AND c.b <= r.size) THEN 'span_offsets_out_of_range' END
          WHEN c.type = 'undo' THEN CASE WHEN len(r.stack) = 0 THEN 'nothing_to_undo' END ELSE 'unknown_action' END AS error
      FROM replay r JOIN acts c ON c.doc_id = r.doc_id AND c.k = r.k + 1)),
  final AS (SELECT doc_id, items FROM replay QUALIFY k = max(k) OVER (PARTITION BY doc_id))"""
