"""SQL of the queries that SQL can express over whole tables."""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) c FROM r GROUP BY a) c ON c.a = d.doc_id
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i, CASE role WHEN 'system' THEN 'told' WHEN 'user' THEN 'asked' WHEN 'tool' THEN 'asked' WHEN 'assistant' THEN 'answered' END s FROM t),
f AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'begin') was, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i), 'begin') now FROM k),
x AS (SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 chars,
  (was || '>' || role) IN ('begin>system', 'begin>user', 'told>user', 'asked>assistant', 'answered>user', 'answered>tool') fine FROM f)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) turns_sha256, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) loss_sha256, CAST(sum(chars) AS BIGINT) formatted_chars, CAST(sum(CASE WHEN fine THEN 0 ELSE 1 END) AS BIGINT) n_rejected, arg_max(now, i) = 'answered' AS ends_well FROM x GROUP BY conv_id
"""


def secrets() -> str:
    """The scan as SQL: places by splitting, then a join of the parts of a text within the scope."""
    from tessera.llm import secret_scan as S

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = {**{k: (p, g, n) for k, (p, g, n) in S.STRONG.items()}, **{k: (p, 0, 0) for k, (p, _) in S.WEAK.items()}}
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{k}' kind, {S.KINDS.index(k)} rk, '{S.ROLE[k]}' part_role, {str(k in S.WEAK).lower()} weak, ms[i] m, regexp_extract(ms[i], {quoted(p)}, {g}) g, {n} need,
  CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) st
  FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) i, ms, gs FROM (SELECT doc_id, regexp_extract_all(t, {quoted(p)}) ms, string_split_regex(t, {quoted(p)}) gs FROM d WHERE regexp_matches(t, {quoted(p)})) q) r"""
        for k, (p, g, n) in patterns.items()
    )
    mixed = " AND ".join(f"regexp_matches(m, '{x}')" for x in S.MIXED)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), f AS ({found}), s AS (SELECT *, st + length(m) en FROM f WHERE length(g) >= need AND (kind <> 'opaque' OR {mixed})),
p AS (SELECT * FROM s WHERE NOT weak OR NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND NOT o.weak AND o.st <= s.st AND s.en <= o.en)),
l AS (SELECT w.doc_id, w.rk, w.st, w.part_role own, bool_or(c.part_role = 'identifier') i, bool_or(c.part_role = 'secret') s, bool_or(c.part_role = 'endpoint') e FROM p w JOIN p c ON c.doc_id = w.doc_id AND w.weak AND c.part_role <> w.part_role AND c.st <= w.en + {S.SCOPE} AND c.en >= w.st - {S.SCOPE} GROUP BY ALL),
k AS (SELECT * FROM l WHERE CASE own WHEN 'identifier' THEN s WHEN 'secret' THEN i OR e ELSE i AND s END),
a AS (SELECT p.*, kind || ':' || st || ':' || en txt, NOT weak OR EXISTS (SELECT 1 FROM k WHERE k.doc_id = p.doc_id AND k.rk = p.rk AND k.st = p.st) AS told FROM p),
o AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{x}') n_{x}" for x in S.STRONG)}, sha256(coalesce(string_agg(txt, ',' ORDER BY st, rk) FILTER (WHERE NOT weak), '')) base_sha256, coalesce(string_agg(txt, ',' ORDER BY st, rk) FILTER (WHERE told), '') spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in S.STRONG)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
