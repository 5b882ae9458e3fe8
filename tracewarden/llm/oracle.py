"""DuckDB texts of the corpus operators that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
  g AS (SELECT doc_id, string_agg(word, ' ') OVER x AS s, count(*) OVER x AS c FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
  s AS (SELECT DISTINCT doc_id, s FROM g WHERE c = 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT r.a AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a, n.n"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
  g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER x AS s, count(*) OVER x AS c FROM t WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
  k AS (SELECT *, c = 20 AND row_number() OVER (PARTITION BY c, s ORDER BY doc_id, pos) > 1 AS again FROM g),
  m AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM k),
  a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

FACTORS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
  t AS (SELECT doc_id, h, n, unnest(range(n)) AS pos FROM d),
  g AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS b, CASE WHEN pos + 50 <= n THEN substr(h, 2 * pos + 1, 100) END AS s FROM t),
  k AS (SELECT doc_id, pos, b, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM g),
  m AS (SELECT doc_id, pos, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k),
  q AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM m),
  a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM q GROUP BY doc_id)
  SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

_DIGIT = "(strpos('0123456789abcdef', substr(h || '0', {at}, 1)) - 1)"
_AT = "((5 * i) // 4 + {k})"
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM p)
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((16 * {_DIGIT.format(at=_AT.format(k=1))} + {_DIGIT.format(at=_AT.format(k=2))}) >> (3 - (5 * i) % 4)) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM m"""

_ESCAPED = "replace(text, chr(92), chr(92) || 's')"
for _mark in ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', chr(92) || '{'a' if _mark[0] == '<' else 'b'}{_mark[1:]}')"
_TURN_TOKENS = r"len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]')) + 2"
#: Windows of at most 512 tokens, with at most 128 tokens of the eight turns before, for conversations below 256 turns.
CHAT = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
  m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {_TURN_TOKENS} AS n, length({_ESCAPED}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length(role) END AS chars FROM c),
  l AS (SELECT conv_id, count(*) AS n_turns, list(n ORDER BY i) AS ns, list(chars ORDER BY i) AS cs, coalesce(min(i) FILTER (role = 'system'), 0) AS sys, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM m GROUP BY conv_id),
  w AS (SELECT conv_id, 0::BIGINT AS i, 0::HUGEINT AS used, 0::HUGEINT AS chars FROM l UNION ALL
    SELECT conv_id, i, CASE WHEN fits THEN used + n ELSE kept + n + list_sum(back) END, chars + CASE WHEN fits THEN here ELSE here + lead + list_sum(back_chars) END FROM (
      SELECT *, list_slice(ns, i - k, i - 1) || [0] AS back, list_slice(cs, i - k, i - 1) || [0] AS back_chars FROM (
        SELECT *, len(list_filter(range(1, 9), lambda k: i - k > sys AND list_sum(list_slice(ns, i - k, i - 1) || [0]) <= least(128, greatest(0, 512 - kept - n)))) AS k FROM (
          SELECT w.conv_id, w.i + 1 AS i, used, chars, ns, cs, sys, ns[w.i + 1] AS n, cs[w.i + 1] AS here, CASE WHEN sys BETWEEN 1 AND w.i THEN ns[sys] ELSE 0 END AS kept, CASE WHEN sys BETWEEN 1 AND w.i THEN cs[sys] ELSE 0 END AS lead, w.i > 0 AND used + ns[w.i + 1] <= 512 AS fits FROM w JOIN l ON l.conv_id = w.conv_id AND w.i < l.n_turns))))
  SELECT l.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, w.chars::BIGINT AS formatted_chars FROM l JOIN w ON w.conv_id = l.conv_id AND w.i = l.n_turns"""


def texts() -> dict[str, str]:
    return {"op4_signature_tree": JACCARD, "op5_fm_index": SUBSTRINGS, "op6_warc": WARC, "op8_lpf_dedup": FACTORS, "op13_chat_format": CHAT}
