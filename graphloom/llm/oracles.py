"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

from graphloom.llm import licenses, quality_rules, url_filter

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _cases(host: str, path: str) -> tuple[str, str]:
    """CASE expressions of the rule and its verdict."""
    rule, verdict = [], []
    for kind, text in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        h, slash, rest = text.partition("/")
        when = f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{slash}{rest}') THEN"
        rule.append(f"{when} '{text}'")
        verdict.append(f"{when} '{kind}'")
    return f"CASE {' '.join(rule)} END", f"CASE {' '.join(verdict)} END"


def op2() -> str:
    host = _LOWER.format("coalesce(regexp_extract({0}, '://([^/?#]*)', 1), '')")
    path = "coalesce(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '')"
    rule, own = _cases("host", "path")
    return f"""
WITH RECURSIVE placed AS (
  SELECT page_id, {host.format("url")} AS host, {path.format("url")} AS path, regexp_extract(url, '^[^#]*') AS node, html FROM pages),
links AS (
  SELECT node AS a, regexp_extract(unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*>')), 'href="([^"#]*)', 1) AS b FROM placed
  UNION ALL
  SELECT node, regexp_extract(unnest(regexp_extract_all(html, '<meta[^>]*http-equiv="refresh"[^>]*>')), 'url=([^"#]*)', 1) FROM placed),
edges AS (SELECT a, b FROM links WHERE a <> b AND b LIKE '%://%' UNION SELECT b, a FROM links WHERE a <> b AND b LIKE '%://%'),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
members AS (SELECT a, {host.format("b")} AS host, {path.format("b")} AS path FROM reach),
alias AS (SELECT a, min({own}) AS verdict FROM members GROUP BY a)
SELECT p.page_id, p.host, p.path, {rule.replace("host", "p.host").replace("(path", "(p.path")} AS rule,
  coalesce({own.replace("host", "p.host").replace("(path", "(p.path")}, alias.verdict, 'allow') AS verdict,
  CASE WHEN {own.replace("host", "p.host").replace("(path", "(p.path")} IS NOT NULL THEN 'rule' WHEN alias.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM placed p LEFT JOIN alias ON alias.a = p.node"""


def op3() -> str:
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM docs WHERE len(w) > 0))),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.r = c.a JOIN sizes y ON y.r = c.b WHERE 100 * o >= 85 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.r = d.r
LEFT JOIN (SELECT reach.a, min(o.doc_id) AS low FROM reach JOIN docs o ON o.r = reach.b GROUP BY reach.a) m ON m.a = d.r"""


def op4() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality_rules.RULES.values()))
    any_of = lambda rules: " OR ".join(f"({quality_rules.RULES[r]})" for r in rules)
    return f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (
    SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2))),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_marks
  FROM docs LEFT JOIN repeated USING (r)),
judged AS (SELECT *, ({bits})::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {any_of(quality_rules.BASE)} AS base_failed, NOT ({any_of(quality_rules.BASE)} OR {any_of(quality_rules.POLICIES["v1"])}) AS kept, failed FROM judged"""


def op7() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{word}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (
    SELECT item, w, least(10, len(w)) AS s, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT s FROM windows),
grams AS (
  SELECT r, i, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (
    SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM docs, sizes WHERE len(w) >= s)),
hits AS (SELECT r, i, s, item FROM grams JOIN windows USING (s, g)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


def op10() -> str:
    forms = licenses.forms()
    words = ", ".join(f"({k}, '{w}')" for k, (_, form, _) in enumerate(forms) for w in form)
    names = ", ".join(f"({k}, '{name}', {len(form)}, {behind})" for k, (name, form, behind) in enumerate(forms))
    return f"""
WITH fw(k, word) AS (VALUES {words}), form(k, name, len, behind) AS (VALUES {names}), vocab AS (SELECT DISTINCT word FROM fw),
docs AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, lower(text) AS t FROM documents),
dfs AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(t, '{licenses.WORD}'))) AS word FROM docs) JOIN vocab USING (word) GROUP BY word),
idfs AS (SELECT word, ln((1 + (SELECT count(t) FROM docs)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf FROM vocab LEFT JOIN dfs USING (word)),
lengths AS (SELECT k, sqrt(sum(idf * idf)) AS size FROM fw JOIN idfs USING (word) GROUP BY k),
lines AS (SELECT r, string_split(t, chr(10)) AS ls FROM docs WHERE t IS NOT NULL),
spans AS (SELECT r, ls, s, unnest(range(1, {licenses.WINDOW} + 1)) AS n FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS s FROM lines)),
units AS (SELECT row_number() OVER () AS u, r, text FROM (
  SELECT r, array_to_string(ls[s:s + n - 1], chr(10)) AS text FROM spans UNION SELECT r, unnest(string_split_regex(t, '{licenses.BLANK_LINES}')) FROM docs
  UNION SELECT r, t FROM docs WHERE regexp_matches(split_part(path, '/', -1), '{licenses.NAMED}'))),
words AS (SELECT DISTINCT u, r, word FROM (SELECT u, r, unnest(regexp_extract_all(text, '{licenses.WORD}')) AS word FROM units) WHERE NOT regexp_matches(word, '{licenses._YEAR}')),
norms AS (SELECT u, sqrt(sum(coalesce(idf, (SELECT avg(idf) FROM idfs)) ** 2)) AS norm FROM words LEFT JOIN idfs USING (word) GROUP BY u),
cosines AS (SELECT w.r, w.u, f.k, round(sum(i.idf * i.idf) / (any_value(n.norm) * any_value(z.size)), 6) AS c FROM words w JOIN fw f USING (word) JOIN idfs i USING (word) JOIN norms n USING (u) JOIN lengths z USING (k) GROUP BY w.r, w.u, f.k),
own AS (SELECT r, name, c FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY behind, c DESC, len DESC, name) AS rank FROM cosines JOIN form USING (k) WHERE c >= {licenses.THRESHOLD}) WHERE rank = 1),
files AS (
  SELECT d.*, o.name AS own_license, o.c AS similarity, regexp_replace(path, '/?[^/]*$', '') AS dir, o.name IS NOT NULL AND regexp_matches(split_part(path, '/', -1), '{licenses.NAMED}') AS speaks
  FROM docs d LEFT JOIN own o USING (r)),
votes AS (SELECT dir, own_license, count(*) AS n FROM files WHERE speaks GROUP BY ALL),
held AS (SELECT dir AS licensed_by, own_license AS inherited FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, own_license) AS rank FROM votes) WHERE rank = 1),
near AS (
  SELECT r, licensed_by, inherited FROM (
    SELECT f.r, h.*, row_number() OVER (PARTITION BY f.r ORDER BY length(licensed_by) DESC) AS rank
    FROM files f JOIN held h ON h.licensed_by = f.dir OR starts_with(f.dir, h.licensed_by || '/') OR h.licensed_by = '' WHERE f.own_license IS NULL) WHERE rank = 1)
SELECT doc_id, path, own_license, similarity, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NOT NULL THEN CASE WHEN speaks THEN 'file' ELSE 'header' END WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, licensed_by
FROM files LEFT JOIN near USING (r)"""


def op10_tree() -> str:
    """op10 over paths of a tree with licence files."""
    plain = "concat_ws('/', source, lang, doc_id::VARCHAR || '.txt')"
    tree = "concat_ws('/', source, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END, CASE WHEN doc_id % 5 = 0 THEN 'LICENSE.' || doc_id::VARCHAR ELSE doc_id::VARCHAR || '.txt' END)"
    before, after = op10().split(plain)
    return before + tree + after
