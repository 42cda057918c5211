"""SQL for DuckDB that says what the native operators' queries return, by ways of its own.

Documents without repeated ids are assumed here; the operators do not need that.
"""

from __future__ import annotations

#: Measurements by list functions, repeated windows by exploding them, and the rules as plain conditions.
QUALITY_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
         list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM t
),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(x, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim,
         CAST(length(regexp_replace(x, '[^0-9]+', '', 'g')) AS BIGINT) AS n_digits,
         CAST(length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
),
f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN n_repeat_words * 100 > n_words * 20 THEN 2 ELSE 0 END
    + CASE WHEN n_symbols * 100 > word_chars * 8 THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND n_dup_lines * 100 > n_lines * 40 THEN 8 ELSE 0 END
    + CASE WHEN word_chars >= 40 AND n_upper * 100 > word_chars * 60 THEN 16 ELSE 0 END
    + CASE WHEN n_exclaim * 100 > n_words * 60 THEN 32 ELSE 0 END
    + CASE WHEN n_digits * 100 > word_chars * 40 THEN 64 ELSE 0 END
    + CASE WHEN word_chars > n_words * 25 THEN 128 ELSE 0 END
    + CASE WHEN n_words >= 50 AND n_distinct_words * 100 < n_words * 10 THEN 256 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed % 256 = 0 AS kept, failed FROM f
"""

#: What each rule of the first policy does alone, counted over the documents.
QUALITY_ABLATION = f"""
WITH ledger AS ({QUALITY_RULES}),
rules AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'upper_case', 'exclamation', 'digits', 'long_words']) AS rule, unnest(generate_series(0, 7)) AS bit)
SELECT rule, CAST(bit AS INT) AS bit, count(*) FILTER (WHERE (failed >> bit) % 2 = 1) AS failed, count(*) FILTER (WHERE failed % 256 = (1 << bit)) AS failed_alone,
       count(*) AS documents, count(*) FILTER (WHERE failed % 256 = 0) AS kept
FROM ledger CROSS JOIN rules GROUP BY rule, bit
"""


def _matches(kind: str, order: int, pattern: str, valid: str, score: int, words: str) -> str:
    """Matches of one pattern with the pieces between them, numbered, and only valid ones kept; 20 hundredths more for a word close by."""
    return rf"""
SELECT doc_id, {order} AS o, '{kind}' AS kind, begin_at, begin_at + length(m) AS end_at, {score} + CASE WHEN regexp_matches(
    lower(substr(x, CAST(greatest(begin_at - 40, 0) AS BIGINT) + 1, CAST(begin_at + length(m) - greatest(begin_at - 40, 0) + 40 AS BIGINT))), '(^|[^\p{{L}}])({words})') THEN 20 ELSE 0 END AS score FROM (
  SELECT doc_id, x, m, sum(length(g) + coalesce(before, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS begin_at FROM (
    SELECT doc_id, x, i, m, g, lag(length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
      SELECT doc_id, x, unnest(ms) AS m, unnest(list_slice(regexp_split_to_array(x, '{pattern}'), 1, len(ms))) AS g, unnest(generate_series(1, len(ms))) AS i
      FROM (SELECT doc_id, x, regexp_extract_all(x, '{pattern}') AS ms FROM t) WHERE len(ms) > 0)))
WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT)
       ELSE (CAST(substr(reverse({_DIGITS}), CAST(i AS INT), 1) AS INT) * 2 - 1) % 9 + 1 END)) % 10 = 0"""

_COMPACT = "replace(m, ' ', '')"
_MOD_97 = f"""length({_COMPACT}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(
  string_split(substr({_COMPACT}, 5) || substr({_COMPACT}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''),
  lambda x: CAST(x AS BIGINT)), lambda a, x: (a * 10 + x) % 97) = 1"""

_KINDS = (
    _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 80, "mail|contact|write|address|kontakt|correo|courriel"),
    _matches("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255", 60, "ip|host|server|address|login"),
    _matches("card", 2, r"[0-9]([\x20-]?[0-9])+", _LUHN, 70, "card|visa|credit|debit|karte|tarjeta|carte"),
    _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 70, "phone|call|tel|mobile|fax|anruf|llamar"),
    _matches("iban", 4, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,}[A-Z0-9]", _MOD_97, 80, "iban|account|bank|konto|cuenta|compte"),
    _matches("secret", 5, r"(?i)(?:token|secret|password|passwd|api_?key|access_?key)[\x20\t]*[=:][\x20\t]*[\"'']?[A-Za-z0-9_+/-]{16,}", "true", 60, "login|auth|user"),
    _matches("local_phone", 6, r"\(?[0-9]+\)?[ .-][0-9]+[ .-][0-9]+", r"regexp_matches(m, '^(\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$')", 40, "phone|call|tel|mobile|fax|anruf|llamar"),
    _matches("national_id", 7, r"[0-9]+-[0-9]+-[0-9]+", "regexp_matches(m, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')", 40, "ssn|social|identity|passport|ausweis|pasaporte"),
)

#: The contract's patterns as they stand; where the operator masks separators, this takes groups.
PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS ({" UNION ALL ".join(_KINDS)}),
p AS (SELECT *, CAST(score AS VARCHAR) AS scored, kind || ':' || CAST(begin_at AS BIGINT) || ':' || CAST(end_at AS BIGINT) AS said FROM s WHERE o < 4 OR score >= 60),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
         count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
         string_agg(said, ',' ORDER BY begin_at, o) FILTER (WHERE o < 4) AS base, string_agg(said, ',' ORDER BY begin_at, o) AS spans, string_agg(scored, ',' ORDER BY begin_at, o) AS scores
  FROM p GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
