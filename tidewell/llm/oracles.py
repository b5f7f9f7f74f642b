"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

import math

from . import quality, secrets

_TEXT = "coalesce(text, '')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS body, length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS head FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(head + body + 24) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP4_NEARDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, sym.b FROM reach r JOIN sym ON sym.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


def _op8(rules: tuple[quality.Rule, ...] = quality.RULES, min_docs: int = 100) -> str:
    chars = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
    log_gamma = math.log(quality.GAMMA)
    names = [r.metric for r in rules]
    bucket = lambda m: f"CASE WHEN {m} <= 0 THEN 0 ELSE CAST(floor(ln(CAST({m} AS DOUBLE)) / {log_gamma!r}) AS INTEGER) + 1 END"
    share = lambda part, whole, times, name: f"CAST(floor({part} * {times} / greatest({whole}, 1)) AS BIGINT) AS {name}"
    beyond = lambda part: f"greatest({part} - {quality.RARE} - n_words // 100, 0)"
    value = lambda b: f"(CASE WHEN {b} <= 0 THEN 0.0 ELSE pow({quality.GAMMA!r}, {b}) END)"
    spread = f"greatest({value('hi')} - {value('lo')}, {value('hi')} / {quality.FLAT})"
    above = " ".join(f"WHEN '{r.metric}' THEN {value('hi')} + {r.above} * {spread}" for r in rules)
    below = " ".join(f"WHEN '{r.metric}' THEN {value('lo')} - {r.below} * {spread}" for r in rules if r.below)
    fence = f"{{'above': CASE metric {above} END, 'below': CASE metric {below} END}}"
    level = lambda k, lang, source: f"SELECT {k} AS level, {lang} AS lang, {source} AS source, metric, bucket, sum(n) AS n FROM sk GROUP BY ALL"
    pick = lambda m: f"coalesce((SELECT fence FROM fe WHERE level = 0 AND fe.lang IS NOT DISTINCT FROM d.lang AND fe.source IS NOT DISTINCT FROM d.source AND metric = '{m}' AND total >= {min_docs}), (SELECT fence FROM fe WHERE level = 1 AND fe.lang IS NOT DISTINCT FROM d.lang AND metric = '{m}' AND total >= {min_docs}), (SELECT fence FROM fe WHERE level = 2 AND metric = '{m}'))"
    return rf"""
WITH d0 AS (SELECT doc_id, lang, source, {_TEXT} AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d0 WHERE len(w) > 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1) GROUP BY doc_id),
c AS (SELECT d0.doc_id, lang, source, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, {chars('[#*$%&|<>]+')} AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: length(x) <= 3)) AS n_short, {chars(chr(92) + 'p{Lu}+')} AS n_caps, {chars('[!?#*$%&|<>=~^_{}' + chr(92) + '[' + chr(92) + ']' + chr(92) * 2 + ']+')} AS n_marks,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d0) d0 LEFT JOIN rep ON rep.doc_id = d0.doc_id),
m AS (SELECT *, {share(beyond('n_marks'), 'word_chars', 10000, 'marks_bp')}, {share(beyond('n_dup_lines'), 'n_lines', 10000, 'dup_lines_bp')}, {share(beyond('n_stutters'), 'n_words', 10000, 'stutter_bp')}, {share('n_caps', 'word_chars', 10000, 'caps_bp')},
  {share('word_chars', 'n_words', 100, 'word_chars_avg')}, {share(f'greatest(n_short - {quality.FEW}, 0)', 'n_words', 10000, 'short_bp')}, {share('n_words', 'n_lines', 100, 'line_words_avg')} FROM c),
sk AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT lang, source, '{x}' AS metric, {bucket(x)} AS bucket FROM m WHERE n_words > 0" for x in names)}) GROUP BY ALL),
lv AS ({level(0, 'lang', 'source')} UNION ALL {level(1, 'lang', 'NULL')} UNION ALL {level(2, 'NULL', 'NULL')}),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM lv),
q AS (SELECT level, lang, source, metric, any_value(total) AS total, min(bucket) FILTER (WHERE upto * 100 >= total * {rules[0].low}) AS lo, min(bucket) FILTER (WHERE upto * 100 >= total * {rules[0].high}) AS hi FROM cum GROUP BY ALL),
fe AS (SELECT level, lang, source, metric, total, {fence} AS fence FROM q),
lim AS (SELECT d.lang, d.source, {', '.join(f'{pick(x)} AS f_{x}' for x in names)} FROM (SELECT DISTINCT lang, source FROM m) d),
j AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_filter([{', '.join(f"CASE WHEN {x} > f_{x}.above THEN '+{x}' WHEN {x} < f_{x}.below THEN '-{x}' END" for x in names)}], lambda x: x IS NOT NULL) AS r FROM m LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(r) = 0 AS kept, coalesce(array_to_string(r, ','), '') AS reasons FROM j
"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _op5(window: int = secrets.WINDOW) -> str:
    """Positions follow from the lengths of the matches and of what lies between them."""
    keyword = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = "(" + keyword + r")[" + "\"''" + r"]?\x20*[:=]\x20*[" + "\"''" + r"]?([A-Za-z0-9+/_.=-]+)"
    candidate = secrets.CANDIDATE % window

    def found(kind: int, pattern: str, keep: str, table: str = "d") -> str:
        second = f"regexp_extract_all(t, '{pattern}', 2)" if kind == 0 else "CAST([] AS VARCHAR[])"
        return f"""SELECT doc_id, {kind} AS kind, m[i] AS s, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, {second} AS g, string_split_regex(t, '{pattern}') AS p FROM {table} WHERE regexp_matches(t, '{pattern}'))) WHERE {keep}"""

    # RE2 has no possessive repetition, nor back references: runs are listed by character instead.
    allowed = " AND ".join(f"NOT regexp_matches(s, '{f.replace('*+', '*')}')" for f in secrets.ALLOWED)
    of_class = lambda n: "CASE " + " ".join(f"WHEN regexp_matches(s, '{c[1]}') THEN {c[3] if n else 3 + k}" for k, c in enumerate(secrets.CLASSES)) + " END"
    run = "|".join(f"{chr(92) if c == '+' else ''}{c}{{{secrets.FILLER}}}" for c in secrets.CLASSES[-1][2])
    masked = "t"
    for length, form in (secrets.HARMLESS | {secrets.FILLER * 100: run}).items():
        either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in form) if length < 100 else form
        masked = f"regexp_replace({masked}, '{either}', '{' ' * (length if length < 100 else secrets.FILLER)}', 'g')"
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    count = lambda k: f"count(*) FILTER (WHERE kind = {k}) AS n_{secrets.KINDS[k]}"
    return f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents),
bare AS (SELECT doc_id, {masked} AS t FROM d),
base AS ({found(0, assign, f"length(g[i]) >= {secrets.MIN_ASSIGN}")} UNION ALL {found(1, "AKIA[A-Z0-9]+", f"length(m[i]) >= {secrets.MIN_ACCESS}")} UNION ALL {found(2, "[0-9a-f]+", f"length(m[i]) >= {secrets.MIN_HEX}")}),
cand AS (SELECT row_number() OVER () AS c, * FROM ({found(9, candidate, "true", "bare")}) WHERE regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]') AND {allowed}),
ch AS (SELECT c, k, substr(s, CAST(k + o AS BIGINT), 1) AS x FROM (SELECT c, s, unnest(range(1, length(s) - {window} + 2)) AS k FROM cand), range(0, {window}) AS r(o)),
win AS (SELECT c, k, sum(n * log2(n)) AS w FROM (SELECT c, k, x, count(*) AS n FROM ch GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT g.doc_id, {of_class(0)} AS kind, g.a + min(k) - 1 AS a, g.a + max(k) - 1 + {window} AS b FROM win JOIN cand g USING (c) WHERE w <= (log2({window}) - {of_class(1)}) * {window} + 1e-9 GROUP BY g.doc_id, g.c, g.s, g.a),
spans AS (SELECT doc_id, kind, a, a + length(s) AS b FROM base UNION ALL SELECT doc_id, kind, a, b FROM hot),
txt AS (SELECT *, {names}[kind + 1] || ':' || a || ':' || b AS x FROM spans),
g AS (SELECT doc_id, {count(0)}, {count(1)}, {count(2)}, coalesce(string_agg(x, ',' ORDER BY a, kind, b) FILTER (WHERE kind < 3), '') AS base, string_agg(x, ',' ORDER BY a, kind, b) AS spans FROM txt GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


ORACLE_SQL = {"op2_chat": OP2_CHAT, "op5_secrets": _op5(), "op4_neardup": OP4_NEARDUP, "op8_quality": _op8()}
