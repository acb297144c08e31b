"""DuckDB SQL for the queries that SQL can express: written from the definitions, not from the plans.
Nothing is imported from the operators: parameters and patterns are stated here once more."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"

_PM = {
    "symbols_pm": "1000 * n_symbols // greatest(n_words, 1)",
    "marks_pm": "1000 * n_marks // greatest(n_words, 1)",
    "repeats_pm": "1000 * n_repeat_words // greatest(n_words, 1)",
    "dup_lines_pm": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "upper_pm": "1000 * n_upper // greatest(word_chars, 1)",
}


_OF = {"symbols_pm": "n_words", "marks_pm": "n_words", "repeats_pm": "n_words", "dup_lines_pm": "n_lines", "upper_pm": "word_chars"}


def _op1() -> str:
    names, totals = list(_OF), ["n_lines", "n_words", "word_chars"]
    of = "CASE q.m " + " ".join(f"WHEN '{m}' THEN '{x}'" for m, x in _OF.items()) + " END"

    def level(x: str, keys: list[str]) -> str:
        k = "".join(f"{c}, " for c in keys)
        same = lambda a, b: "".join(f" AND {a}.{c} = {b}.{c}" for c in keys)
        return f"""
  {x}_h AS (SELECT {k}m, low, count(*) AS n FROM v GROUP BY ALL),
  {x}_c AS (SELECT *, sum(n) OVER (PARTITION BY {k}m ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {k}m) AS docs FROM {x}_h),
  {x}_q AS (SELECT {k}m, max(docs) AS docs, min(low) FILTER (2 * upto >= docs) AS q50, min(low) FILTER (4 * upto >= 3 * docs) AS q75 FROM {x}_c GROUP BY ALL),
  {x}_w AS (SELECT q.*, 8000 // greatest(d.q50, 1) AS w FROM {x}_q q JOIN {x}_q d ON d.m = {of}{same("q", "d")}),
  {x}_s AS (SELECT {"".join(f"w.{c}, " for c in keys)}w.m, w.docs, 2 * c.low + w AS cut, coalesce(sum(y.n), 0) AS held FROM {x}_w w JOIN {x}_h c ON c.m = w.m{same("c", "w")} AND c.low >= w.q75
           LEFT JOIN {x}_h y ON y.m = w.m{same("y", "w")} AND y.low > c.low AND y.low <= 2 * c.low + w.w GROUP BY ALL),
  {x} AS (SELECT {k}m, docs, min(cut) AS cut FROM {x}_s WHERE held * 500 < docs GROUP BY ALL)"""

    limits = ", ".join(f"max(cut) FILTER (m = '{m}') AS max_{m}" for m in names)
    passes = " AND ".join(f"{m} <= max_{m}" for m in names)
    return rf"""
  WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS l FROM d),
  x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
  y AS (SELECT doc_id, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM x WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM y WHERE c IS NOT NULL),
  p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT range AS k FROM range(3)) WHERE n > 1 GROUP BY doc_id),
  f AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
  m AS (SELECT *, {", ".join(f"CAST({e} AS BIGINT) AS {m}" for m, e in _PM.items())} FROM f),
  u AS (UNPIVOT (SELECT doc_id, lang, source, {", ".join(names)}, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in totals)} FROM m) ON {", ".join(names + totals)} INTO NAME m VALUE x),
  v AS (SELECT lang, source, m, x - x % CAST(pow(2, greatest(length(bin(x)) - 5, 0)) AS BIGINT) AS low FROM u),
  {level("o", ["lang", "source"])}, {level("b", ["lang"])}, {level("a", [])},
  t AS (SELECT lang, source, {limits} FROM (
        SELECT o.lang, o.source, o.m, CAST(CASE WHEN o.docs >= 100 THEN o.cut WHEN b.docs >= 100 THEN b.cut ELSE a.cut END AS BIGINT) AS cut FROM o JOIN b ON o.lang = b.lang AND o.m = b.m JOIN a ON o.m = a.m) GROUP BY ALL)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {passes} AS kept, {", ".join(names)}, {", ".join(f"max_{m}" for m in names)}
  FROM m JOIN t USING (lang, source)"""


def _op4() -> str:
    return """
  WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
  c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
  SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x"""


def _any_case(words: str) -> str:
    return "(" + "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in words) + ")"


_GIVES = r"""["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group whose length counts, least length), in the order of equal starts; the last three are weak.
_PATTERNS = {
    "assign": (_any_case("password|passwd|secret|token|api_?key") + _GIVES + "([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "ident": (_any_case("client_?id|access_?key_?id|account_?id|user_?name|login") + _GIVES + "([A-Za-z0-9+/_.@-]+)", 2, 3),
    "mixed": ("[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"""(https?|s3|jdbc:[a-z]+|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 8),
}
KINDS, STRONG, SCOPE = list(_PATTERNS), 3, 256


def _spans(kind: str) -> str:
    pattern, group, least = _PATTERNS[kind]
    p = pattern.replace("'", "''")
    more = " AND regexp_matches(g, '[0-9]') AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]')" if kind == "mixed" else ""
    return f"""
    SELECT doc_id, {KINDS.index(kind)} AS k, e - length(m) AS s, e FROM (
      SELECT doc_id, m[i] AS m, g[i] AS g, list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(b[1:i], lambda x: length(x))) AS e FROM (
        SELECT doc_id, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS b FROM d)))
    WHERE length(g) >= {least}{more}"""


def _op6() -> str:
    spans = " UNION ALL ".join(_spans(k) for k in KINDS)
    name = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    text = f"string_agg({name}, ',' ORDER BY s, k)"
    k = {n: i for i, n in enumerate(KINDS)}
    return f"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({spans}),
  f AS (SELECT a.doc_id, a.k, a.s, a.e, bool_or(b.k IN ({k["access"]}, {k["ident"]})) AS ident,
        bool_or(b.k IN ({k["assign"]}, {k["hex"]}, {k["mixed"]}) AND NOT (b.k = a.k AND b.s = a.s)) AS secret, bool_or(b.k < {STRONG} AND b.s < a.e AND b.e > a.s) AS over
        FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.k <> {k["endpoint"]} AND b.s <= a.s + {SCOPE} AND b.e >= a.s - {SCOPE} WHERE a.k >= {STRONG} GROUP BY ALL),
  z AS (SELECT doc_id, k, s, e FROM x WHERE k < {STRONG} UNION ALL
        SELECT doc_id, k, s, e FROM f WHERE CASE k WHEN {k["ident"]} THEN secret WHEN {k["mixed"]} THEN ident AND NOT over ELSE ident AND secret END),
  q AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {text} FILTER (k < {STRONG}) AS base, {text} AS spans FROM z GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM d LEFT JOIN q USING (doc_id)"""


def _op8() -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, j: " + step + ", i))"
    return f"""
  WITH k AS (SELECT {table} AS tbl),
  d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  b AS (SELECT doc_id, source, h, octet_length(encode(t)) + 1 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
  e AS (SELECT doc_id, source, h, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM b, k),
  r AS (SELECT * REPLACE (coalesce('=' || source, '') AS source), row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n, count(*) OVER (PARTITION BY source) AS total,
        CAST('0x' || substr(md5('interleave-1/' || coalesce('=' || source, '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS phase FROM e),
  p AS (SELECT *, row_number() OVER (ORDER BY (n - 1 + phase) / CAST(total AS DOUBLE), source, n) - 1 AS pos, count(*) OVER () AS everything FROM r),
  s AS (SELECT *, pos * 8 // everything AS shard FROM p)
  SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * everything + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


def _op9() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {0}) & 31 AS INTEGER) + 1, 1)"
    four = " || ".join(digit.format(s) for s in (15, 10, 5, 0))
    return f"""
  WITH d AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS f FROM d),
  c AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS vs FROM h)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(vs, lambda v: {four}), '') AS payload_digest,
         CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM c"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _op1(),
    "op4_embedding_dedup": _op4(),
    "op6_secret_scans": _op6(),
    "op8_sharding": _op8(),
    "op9_warc": _op9(),
}
