"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"

# Words, lines and 5-word windows of each document; then hosts, their rates and a beta prior by moments.
ORACLE["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM hit, range(5) x(j) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(sum(base_failed::INT) AS BIGINT) AS k FROM f GROUP BY source),
s AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE / sum(n) AS mu, count(*) AS hosts, sum(k::DOUBLE * k / n) AS kk, sum(n::DOUBLE * n) AS nn FROM h),
v AS (SELECT mu, CASE WHEN n - nn / n > 0
                      THEN (greatest(0, kk - n * mu * mu) - (hosts - 1) * mu * (1 - mu)) / (n - nn / n) ELSE 0 END AS between_ FROM s),
p AS (SELECT mu, CASE WHEN between_ > 0 THEN least(greatest(mu * (1 - mu) / between_ - 1, 2), 1000) ELSE 1000 END AS strength FROM v),
bad AS (SELECT source FROM h, p WHERE (k + mu * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""



def _mixing() -> str:
    """Cells, eight rounds of raking, the budget's scale in closed form, draws by md5."""
    dims = ("source", "lang", "topic")
    share = "sum(tokens) OVER (PARTITION BY {d}) / sum(tokens) OVER ()"
    ctes = [rf"""
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, lang,
             CASE WHEN regexp_matches(t, '[Ll]icen[sc]e|[Cc]opyright|[Rr]ights reserved') THEN 'legal'
                  WHEN regexp_matches(t, '[0-9][0-9][0-9]|\[[A-Z]+\]') THEN 'records'
                  WHEN contains(t, '!!') THEN 'promotion' ELSE 'prose' END AS topic,
             CAST(greatest(1, len(list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM d),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM r GROUP BY ALL),
w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w, {", ".join(f"pow({share.format(d=d)}, 0.7) AS t_{d}" for d in dims)} FROM c)"""]
    for n in range(24):
        d = dims[n % 3]
        ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{n})")
    ctes.append("""
f AS (SELECT source, lang, topic, tokens, w / tokens AS f FROM w24),
s AS (SELECT *, sum(tokens) OVER up AS taken, sum(f * tokens) OVER () - sum(f * tokens) OVER up AS free, lead(f) OVER (ORDER BY f DESC, source, lang, topic) AS f_next,
             0.7 * sum(tokens) OVER () AS budget FROM f WINDOW up AS (ORDER BY f DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
k AS (SELECT budget / (SELECT sum(f * tokens) FROM f) AS scale, max(f) * budget / (SELECT sum(f * tokens) FROM f) <= 1 AS ok, -1.0 AS taken FROM s GROUP BY budget
      UNION ALL SELECT (budget - taken) / free, f_next * (budget - taken) / free <= 1, taken FROM s WHERE f_next IS NOT NULL AND budget > taken),
best AS (SELECT arg_min(scale, taken) AS scale FROM k WHERE ok)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, r.source, r.lang, r.topic, r.tokens, round(least(1.0, f.f * scale), 6) AS p,
       ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < least(1.0, f.f * scale) AS kept
FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.lang IS NOT DISTINCT FROM f.lang AND r.topic = f.topic, best
"""


ORACLE["op8_mixing"] = _mixing()


# All pairs of valid vectors; components by following links.
ORACLE["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = x LEFT JOIN n ON vec_id = a
"""

# Turns in order; digests of the turns themselves; characters of each window's new, system and repeated turns.
ORACLE["op6_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) x(k)),
e AS (SELECT *, row_number() OVER w AS rank,
             len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 4 AS tokens,
             12 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) + 1
               + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
             coalesce(max(CASE WHEN rank = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys_tokens,
             coalesce(max(CASE WHEN rank = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS sys_chars,
             rank = 1 AND role = 'system' AS is_system FROM e),
s AS (SELECT *, CASE WHEN is_system THEN 0 ELSE before_ - sys_tokens END AS start_, greatest(64, 512 - 128 - sys_tokens) AS room FROM p),
w AS (SELECT *, 2 * floor(start_ / room) + (floor(CASE WHEN is_system THEN 0 ELSE start_ + tokens - 1 END / room) > floor(start_ / room))::INT AS win FROM s),
f AS (SELECT conv_id, win, min(rank) AS first_, arg_min(start_, rank) AS first_start, any_value(sys_chars) AS sys_chars FROM w GROUP BY 1, 2),
h AS (SELECT f.conv_id, sum(w.chars) AS chars FROM f JOIN w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.rank BETWEEN f.first_ - 2 AND f.first_ - 1
      WHERE NOT w.is_system AND f.first_start - w.start_ <= 128 GROUP BY 1),
y AS (SELECT conv_id, sum(CASE WHEN first_ > 1 THEN sys_chars ELSE 0 END) AS chars FROM f GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank) AS turns,
             coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS loss FROM w GROUP BY 1)
SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(d.chars + y.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM d JOIN y ON d.conv_id IS NOT DISTINCT FROM y.conv_id LEFT JOIN h ON d.conv_id IS NOT DISTINCT FROM h.conv_id
"""


def _licenses() -> str:
    """Every distinct unit against every template, without pruning."""
    from . import licenses

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, [{', '.join(map(quote, licenses.bigrams_of(v)))}])" for k, v in licenses.TEMPLATES.items())
    return rf"""
WITH t(license, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'), [text])) AS unit FROM d),
g AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
      FROM (SELECT r, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u) WHERE len(w) > 1),
m AS (SELECT r, license, 2 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b))::DOUBLE AS dice FROM g, t
      WHERE 2 * len(list_intersect(g.b, t.b)) >= 0.8 * (len(g.b) + len(t.b))),
x AS (SELECT r, count(*) AS n, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
      FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, license, round(dice, 6) AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN x USING (r)
"""


ORACLE["op7_license_scans"] = _licenses()


def _repair() -> str:
    """The damage by a CRC of its own, a cost DP backwards over the rows that carries the least audit of each state, then the audit's letters one by one."""
    add = lambda c, letter, v: f"lpad(CAST(CAST(substr({v}, 1, 6) AS INTEGER) + {c} AS VARCHAR), 6, '0') || '{letter}' || substr({v}, 7)"
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def consumed(s):
        kept = " ".join(f"WHEN lower(code) = '{i}' THEN {add('more', 'K', f'v{to}')}" for i, to in keep[s])
        return f"least({add(3, 'D', f'v{s}')}, CASE WHEN code <> 'x' THEN {add('2 + more', 'R', f'v{after[s]}')} END, CASE {kept} END) AS b{s}"

    def inserted(s):
        one = after[s]
        return f"least(b{s}, {add(2, 'I', f'b{one}')}, {add(4, 'II', f'b{after[one]}')}) AS v{s}"

    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             UNNEST(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
q AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
             substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before_ FROM p),
f AS (SELECT *, CASE WHEN last_ = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_ NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM q),
r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS code, (fault = 'truncated')::INTEGER AS more FROM f),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before_ || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS pos, '000000' AS v0, '000004II' AS v1, '000002I' AS v2, '000000' AS v3 FROM c
       UNION ALL SELECT conv_id, pos, {', '.join(inserted(s) for s in range(4))} FROM (
         SELECT r.conv_id, r.pos, {', '.join(consumed(s) for s in range(4))} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1)),
best AS (SELECT conv_id, CAST(substr(v0, 1, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM dp WHERE pos = 1),
l AS (SELECT conv_id, UNNEST(range(1, length(audit) + 1)) AS i, audit FROM best),
e AS (SELECT conv_id, i, substr(audit, i, 1) AS edit, length(regexp_replace(substr(audit, 1, i), 'I', '', 'g')) AS pos,
             length(regexp_replace(substr(audit, 1, i - 1), 'D', '', 'g')) AS made FROM l),
g AS (SELECT e.*, r.role, r.text, r.initial FROM e LEFT JOIN r ON e.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos WHERE edit <> 'D'),
t AS (SELECT *, bool_or(made = 0 AND edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id) AS led FROM g),
w AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - led::INTEGER) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired
      FROM t GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""


ORACLE["op13_conversation_repair"] = _repair()
