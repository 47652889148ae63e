"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import APART, MERGE, MIN_SIMILAR, notice_grams
from .quality_rules import HOST_LIMIT, MAX_PRIOR, MIN_PRIOR
from .warc import MIN_REVISIT

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_sql() -> str:
    text = lambda s: "NULL" if s is None else f"'{s}'"
    rows = ", ".join(f"({n}, {text(label)}, {base}, {grams}, {need}, '{letters}', {pos}, '{gram[0]}', '{gram[1]}')" for n, label, base, grams, need, letters, pos, gram in notice_grams())
    return f"""WITH t(template, label, base, grams, need, letters, t_pos, a, b) AS (VALUES {rows}),
 d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
 h AS (SELECT doc_id, template, pos, t_pos, pos - t_pos AS diagonal, substr(letters, t_pos + 1, 1) AS letter FROM p JOIN t USING (a, b)),
 n AS (SELECT DISTINCT template, label, base, grams, need, letters FROM t),
 v AS (SELECT doc_id, template, diagonal, count(*) AS own FROM h GROUP BY ALL),
 c AS (SELECT doc_id, template, x.diagonal, any_value(x.own) AS own, sum(y.own) AS around FROM v x JOIN v y USING (doc_id, template) WHERE abs(x.diagonal - y.diagonal) <= {MERGE} GROUP BY ALL),
 e AS (SELECT c.*, n.* EXCLUDE template FROM c JOIN n USING (template) WHERE CASE WHEN need < grams THEN around ELSE own END >= need),
 g AS (SELECT DISTINCT e.doc_id, e.template, e.diagonal, h.pos, h.letter FROM e JOIN h ON h.doc_id = e.doc_id AND h.template = e.template AND abs(h.diagonal - e.diagonal) <= {MERGE} AND h.pos >= e.diagonal AND h.pos < e.diagonal + e.grams WHERE e.need < e.grams),
 s AS (SELECT doc_id, template, diagonal, string_agg(letter, '' ORDER BY pos) AS seen FROM g GROUP BY ALL),
 q AS (SELECT e.*, CASE WHEN need < grams THEN 1 - levenshtein(seen, letters) / grams ELSE 1.0 END AS sim FROM e LEFT JOIN s USING (doc_id, template, diagonal)),
 k AS (SELECT * FROM q WHERE sim >= {MIN_SIMILAR}),
 f AS (SELECT * FROM k x WHERE need = grams OR NOT EXISTS (SELECT 1 FROM k y WHERE y.doc_id = x.doc_id AND y.template = x.template AND abs(y.diagonal - x.diagonal) <= {APART} AND (y.sim > x.sim OR y.sim = x.sim AND y.diagonal < x.diagonal))),
 r AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sim) AS score, count(*) AS n_spans FROM f GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN r USING (doc_id)"""


MARKS = "'[<\\[]\\\\*/?(?:s>|INST\\])'"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(20 + length(role) + length(text) + len(regexp_extract_all(role, {MARKS})) + len(regexp_extract_all(text, {MARKS}))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1) for k in range(32)], '')"
WARC = f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY h, n) END AS keep FROM p)
 SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM m"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(source, chr(0) || 'null') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM r) GROUP BY doc_id),
 m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l, coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
 q AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM q GROUP BY host), s AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM h),
 k AS (SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, {MAX_PRIOR}), {MIN_PRIOR}), {MAX_PRIOR}) AS k FROM s), z AS (SELECT host, round((f + m * k) / (n + k), 9) AS host_rate FROM h, k)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN host <> chr(0) || 'null' THEN host END AS host, host_rate, NOT base_failed AND host_rate <= {HOST_LIMIT} AS kept FROM q JOIN z USING (host)"""

EXACT = f"""WITH t AS (SELECT doc_id, {FOLD} AS t FROM documents), g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM t)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

FIM = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents), u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
 g AS (SELECT *, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS x FROM u), c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b FROM g),
 f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, coalesce(array_to_string(w[1 : a], ''), '') AS p, coalesce(array_to_string(w[a + 1 : b], ''), '') AS m, coalesce(array_to_string(w[b + 1 : n], ''), '') AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM f"""

def repair_sql() -> str:
    """Backward over the turns by recursion: f0 to f3 are what is cheapest from each state on, as (cost, edits, turns), which compare in that order."""
    table = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"  # CRC-32, a byte at a time
    to, kept = (2, 2, 3, 2), {0: ((0, 1), (1, 2)), 1: ((1, 2),), 2: ((2, 3),), 3: ((1, 2),)}
    turn = lambda s: "chr(10) || 'assistant:'" if to[s] == 3 else "chr(10) || 'user:'"
    then = lambda cost, letters, turns, at: f"struct_pack(c := {at}.c + {cost}, a := '{letters}' || {at}.a, p := {turns} || {at}.p)"
    ends = ", ".join(f"struct_pack(c := {c}, a := {a}, p := {p}) AS f{k}" for k, (c, a, p) in enumerate([(0, "''", "''"), (4, "'II'", f"{turn(1)} || {turn(2)}"), (2, "'I'", turn(2)), (0, "''", "''")]))

    def stepped(s: int) -> str:
        stays = [("2 + (fault = 3)::INT", "R", f"{turn(s)} || text", to[s], "TRUE"), *[("(fault = 3)::INT", "K", "chr(10) || role || ':' || text", t, f"code = {c}") for c, t in kept[s]]]
        found = [then(3, "D", "''", f"f{s}"), *[f"CASE WHEN fault NOT IN (1, 2) AND {ok} THEN {then(cost, letter, turns, f'f{t}')} END" for cost, letter, turns, t, ok in stays]]
        return f"list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)) AS g{s}"

    inserted = lambda s: f"least(g{s}, {then(2, 'I', turn(s), f'g{to[s]}')}, {then(4, 'II', f'{turn(s)} || {turn(to[s])}', f'g{to[to[s]]}')}) AS f{s}"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {table} AS t),
 x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS INT) + 1], a >> 8)), 4294967295) % 20 AS act FROM conversations, t),
 d AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy FROM x, unnest(range(CASE WHEN act = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE act <> 0),
 b AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k, coalesce(position(substr(role, 1, 1) IN 'sua'), 0) AS letter FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
 r AS MATERIALIZED (SELECT conv_id, turn, i, n, role, text, CASE WHEN role = '' OR letter = 0 THEN 3 ELSE letter - 1 END AS code, CASE WHEN body = '' THEN 1 WHEN k > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM b),
 f AS (SELECT conv_id, n AS i, {ends} FROM (SELECT conv_id, max(n) AS n FROM r GROUP BY conv_id) UNION ALL
  SELECT conv_id, i - 1, {', '.join(map(inserted, range(4)))} FROM (SELECT f.conv_id, f.i, {', '.join(map(stepped, range(4)))} FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i)),
 s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND NOT (before = 0 AND code = 1 OR before = 1 AND code = 2 OR before = 2 AND code = 1)) AS illegal
  FROM (SELECT *, lag(code) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(f0.c, 0) AS BIGINT) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(substr(f0.p, 2), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = 0"""


ORACLES: dict[str, str] = {"op1_license_scan": license_sql(), "op2_chat_format": CHAT, "op3_warc": WARC, "op5_quality_rules": QUALITY, "op6_exact_dedup": EXACT, "op12_conversation_repair": repair_sql(), "op13_fill_in_middle": FIM}
