"""DuckDB SQL that gives the rows of those corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item, w[i:i + least(len(w), 10) - 1] AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT k, item, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM hit WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.y, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) m USING (doc_id)
"""


def _op8() -> str:
    """The licence rules as one step of SQL each."""
    from rankweave.llm.licenses import CLOSE, CUES, END, INNER, LEAD, RULES, SENTENCES, STARTS, TAIL, UNKNOWN

    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, texts in SENTENCES.items() for s in texts) + "}"
    starts = " ".join(f"WHEN starts_with(x, '{start}') THEN '{i}'" for i, all_ in reversed(STARTS.items()) for start in reversed(all_))
    plain = lambda x: f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    quoted = END.replace("'", "''")
    steps, last = [], "ids"
    for k, (name, run) in enumerate(RULES):
        text = "".join(f"<{i}>" for i in run)
        steps.append(f"r{k} AS (SELECT k, replace(rest, '{text}', '|') AS rest, list_concat(names, list_transform(generate_series(1, CAST((length(rest) - length(replace(rest, '{text}', '|'))) / {len(text) - 1} AS BIGINT)), lambda i: '{name}')) AS names FROM {last})")
        last = f"r{k}"
    return rf"""
WITH known AS (SELECT unnest(map_keys(m)) AS s, unnest(map_values(m)) AS id FROM (SELECT {known} AS m)),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(text, '') AS text FROM documents),
bare AS (SELECT k, regexp_replace(regexp_replace(chr(10) || text || chr(10), '\r\n?', chr(10), 'g'), '{LEAD}', chr(10), 'g') AS text FROM d WHERE regexp_matches(text, '(?i){CUES}')),
cut AS (SELECT k, string_split_regex(regexp_replace(regexp_replace(text, '{CLOSE}', chr(10), 'g'), '{INNER}', '\1 ', 'g'), '{quoted}') AS parts FROM bare),
sent AS (SELECT k, i, s, {plain('s')} AS whole FROM (SELECT k, i, parts[i] AS s FROM (SELECT k, parts, unnest(generate_series(1, len(parts))) AS i FROM cut)) WHERE regexp_matches(s, '(?i){CUES}')),
wide AS (SELECT k, i, list_filter(list_transform(string_split(sent.s, chr(10)), lambda x: {plain('x')}), lambda x: x <> '') AS lines FROM sent LEFT JOIN known ON known.s = whole WHERE known.id IS NULL AND contains(sent.s, chr(10))),
tails AS (SELECT k, i, j, array_to_string(lines[j:], ' ') AS s FROM (SELECT k, i, lines, unnest(generate_series(greatest(len(lines) - {TAIL - 1}, 1), len(lines))) AS j FROM wide)),
firsts AS (SELECT k, i, min(j) AS j, arg_min(id, j) AS id FROM tails JOIN known USING (s) GROUP BY k, i),
heads AS (SELECT k, i, n, x FROM (SELECT k, i, unnest(lines) AS x, generate_subscripts(lines, 1) AS n FROM wide) LEFT JOIN firsts USING (k, i) WHERE firsts.j IS NULL OR n < firsts.j),
of_lines AS (SELECT k, i, n, coalesce(known.id, CASE {starts} END) AS id FROM heads LEFT JOIN known ON known.s = x UNION ALL SELECT k, i, j, id FROM firsts),
told AS (SELECT k, i, n, id FROM of_lines WHERE id IS NOT NULL
    UNION ALL SELECT k, i, 0, coalesce(known.id, CASE {starts} WHEN regexp_matches(x, '\blicen[sc]e') AND NOT regexp_matches(x, '^https? ') THEN '{UNKNOWN}' END)
    FROM (SELECT k, i, whole AS x FROM sent WHERE NOT EXISTS (SELECT 1 FROM of_lines o WHERE o.k = sent.k AND o.i = sent.i AND o.id IS NOT NULL)) LEFT JOIN known ON known.s = x),
ids AS (SELECT k, string_agg('<' || id || '>', '' ORDER BY i, n) AS rest, CAST([] AS VARCHAR[]) AS names FROM told WHERE id IS NOT NULL GROUP BY k),
{', '.join(steps)}
SELECT doc_id, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses,
    coalesce((SELECT string_agg(id, ',' ORDER BY i, n) FROM told WHERE told.k = d.k AND id IS NOT NULL), '') AS sentence_ids,
    CAST(coalesce((SELECT count(*) FROM told WHERE told.k = d.k AND id = '{UNKNOWN}'), 0) AS BIGINT) AS n_unknown
FROM d LEFT JOIN {last} USING (k)
"""


OP8 = _op8()


def _op6() -> str:
    from rankweave.llm.repetition import Limits

    limits = Limits()
    sizes = [n for n, _ in limits.gram_pct]
    word = r"[^\x20\x09-\x0D]+"
    chars = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN chars END), 0) AS c{n}" for n in sizes)
    within = " AND ".join(f"100 * coalesce(c{n}, 0) <= {pct} * total" for n, pct in limits.gram_pct)
    return rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{word}') AS ws FROM d),
l AS (SELECT k, line, row_number() OVER (PARTITION BY k, line ORDER BY i) AS nth FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '{word}')),
lines AS (SELECT k, count(*) AS n_dup, sum(list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda x: length(x)))) AS dup_chars FROM l WHERE nth > 1 GROUP BY k),
g AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT k, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, (SELECT unnest({[5, *sizes]}) AS n) WHERE len(ws) >= n)),
h AS (SELECT k, n, i FROM (SELECT k, n, i, count(*) OVER (PARTITION BY k, n, g) AS c FROM g) WHERE c > 1),
p AS (SELECT DISTINCT k, n, unnest(generate_series(i, i + n - 1)) AS p FROM h),
r AS (SELECT k, n, count(*) AS words, sum(length(ws[p])) AS chars FROM p JOIN w USING (k) GROUP BY k, n),
c AS (SELECT k, coalesce(max(CASE WHEN n = 5 THEN words END), 0) AS repeated, {chars} FROM r GROUP BY k),
t AS (SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS total, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols FROM w),
f AS (SELECT *, n < {limits.min_words} OR 100 * coalesce(repeated, 0) > {limits.repeat_words_pct} * n AS failed FROM t LEFT JOIN c USING (k) LEFT JOIN lines USING (k))
SELECT doc_id, n AS n_words, total AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words, failed AS base_failed,
    NOT failed AND {within} AND 100 * coalesce(dup_chars, 0) <= {limits.line_pct} * total AS kept,
    {', '.join(f'CAST(coalesce(c{n}, 0) AS BIGINT) AS chars_in_repeated_{n}grams' for n in sizes)}, CAST(coalesce(dup_chars, 0) AS BIGINT) AS dup_line_chars
FROM f
"""


OP6 = _op6()
