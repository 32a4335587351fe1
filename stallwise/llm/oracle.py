"""The corpus queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

SPACE = r"[\x20\x09-\x0D]"
DOCUMENTS = "d AS (SELECT row_number() OVER () AS rid, * FROM documents)"

LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
ITEM_WORDS = (
    rf"list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH {DOCUMENTS},
w AS (SELECT rid, doc_id, {ITEM_WORDS} AS ws FROM d),
b AS (SELECT item_id, {ITEM_WORDS} AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s
       FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM bw),
lengths AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, lengths WHERE len(ws) >= n)),
hits AS (SELECT rid, n, s, item_id FROM dw JOIN windows USING (n, win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT coalesce(CAST(item_id AS VARCHAR), ''))) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""


def _rejected(rule: str) -> str:
    """Lower bound of a host's shrunk failure rate of a rule against the limit."""
    prior = f"""(SELECT {{m: m, k: least(greatest(coalesce(m * (1.0 - m) / nullif(v, 0.0) - 1.0, 1.0), 1.0), 1000.0)}}
                 FROM (SELECT avg({rule} / n) AS m, coalesce(var_samp({rule} / n), 0.0) AS v FROM h))"""
    rate = f"(({rule} + p.k * p.m) / (n + p.k))"
    return f"""(SELECT {rate} - 1.645 * sqrt({rate} * (1.0 - {rate}) / (n + p.k + 1.0)) > 0.5
                FROM (SELECT {prior} AS p))"""


def quality(tail: str) -> str:
    return f"""
WITH {DOCUMENTS},
w AS (SELECT rid, {WORDS} AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM d),
g AS (SELECT rid, s, ws[s:s + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS s FROM w)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 3)) AS p FROM twice) GROUP BY rid),
j AS (SELECT d.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS base,
             CAST(count(*) FILTER (100 * n_symbols > 10 * word_chars) AS DOUBLE) AS symbols,
             CAST(count(*) FILTER (100 * n_dup_lines > 30 * n_lines) AS DOUBLE) AS lines
      FROM f GROUP BY source),
v AS (SELECT source AS host, {" OR ".join(map(_rejected, ("base", "symbols", "lines")))} AS rejected FROM h),
judged AS (SELECT f.*, NOT base_failed AND NOT rejected AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host)
{tail}
"""


HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}')"


def _level(name: str, source: str, keys: str, parent: str) -> str:
    """Rates of one level shrunk towards the parent's rate ``r`` that ``source`` carries."""
    return f"""
{name}_k AS (SELECT least(greatest(coalesce(sum((bad - n * r) ** 2 / (n * r * (1.0 - r)) - 1.0) / nullif(sum(n - 1.0), 0.0),
                                            0.1), 1e-4), 0.5) AS spread FROM {source} WHERE n > 0),
{name} AS (SELECT {keys}, n, (bad + (1.0 / spread - 1.0) * r) / (n + (1.0 / spread - 1.0)) AS {parent},
                  1.0 / spread - 1.0 AS k FROM {source}, {name}_k)"""


URLS = f"""
WITH p AS (SELECT page_id, {HOST} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CAST(quality = 0 AS INTEGER)) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
             array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1.0) / (sum(n) + 10.0) FROM h) AS r
       FROM h GROUP BY suffix),
{_level("s1", "s0", "suffix", "suffix_rate")},
d0 AS (SELECT domain, suffix, sum(h.n) AS n, sum(bad) AS bad, any_value(suffix_rate) AS r
       FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
{_level("d1", "d0", "domain", "domain_rate")},
h0 AS (SELECT host, h.n, bad, domain_rate AS r FROM h JOIN d1 USING (domain)),
{_level("h1", "h0", "host", "bad_rate")},
b AS (SELECT host, bad_rate - 1.645 * sqrt(bad_rate * (1.0 - bad_rate) / (n + k + 1.0)) AS bound FROM h1),
rules(rule_host, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, host, path, max_by({{rule: rule_host || start, verdict: verdict}}, length(rule_host || start)) AS hit
         FROM (SELECT DISTINCT host, path, page_id FROM p) q LEFT JOIN rules
           ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, start)
         WHERE rule_host IS NOT NULL GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN b USING (host) LEFT JOIN fits f
  ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
"""

MIX = f"""
WITH {DOCUMENTS},
m AS (SELECT rid, doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
             md5(concat('20240607|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(source, ''), '|',
                        coalesce(text, ''))) AS digest FROM d),
t0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
t1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM t0),
t2 AS (SELECT *, 3 * source_size AS cap,
              coalesce(sum(3 * source_size) OVER o, 0) AS full_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
              sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights
       FROM t1 WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, (all_words - full_before) * weight > cap * (all_weights - weight_before) AS is_full FROM t2),
t4 AS (SELECT source, source_size,
              CASE WHEN is_full THEN CAST(cap AS DOUBLE)
                   ELSE CAST(all_words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) * weight
                        / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM t3),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - before))
          + greatest(0, least(size, floor(target) - source_size - before))
          + greatest(0, least(size, floor(target) - 2 * source_size - before)) AS BIGINT) AS taken
FROM c JOIN t4 ON c.source IS NOT DISTINCT FROM t4.source
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 AND count(*) OVER (PARTITION BY body) > 1
                                 THEN max(page_id) OVER (PARTITION BY body) END AS last FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
FROM q
"""

JACCARD = f"""
WITH RECURSIVE {DOCUMENTS},
w AS (SELECT doc_id, list_filter(string_split_regex({LOWERED}, '{SPACE}+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.id
                   WHERE reach.low < links.b),
low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN low ON low.id = doc_id
"""

def _step(best: str, cost: int, letter: str) -> str:
    """A path (nine digits of cost, then its edits; '~' for none) with one more edit."""
    longer = f"lpad(CAST(CAST(substr({best}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({best}, 10) || '{letter}'"
    return f"CASE WHEN {best} = '~' THEN '~' ELSE {longer} END"


def _row(best: str, role: str, cost: str, letter: str = "K") -> str:
    """A path that goes on with a row that stays."""
    longer = (
        f"lpad(CAST(CAST(substr({best}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({best}, 10) || '{letter}'"
    )
    return f"CASE WHEN {best} = '~' OR fault IN ('blank', 'duplicate') OR NOT ({role}) THEN '~' ELSE {longer} END"


_CUT = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_U, _S, _A = (f"initial = '{x}'" for x in "usa")
_BITS = (
    "flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8),"
    " lambda j: CAST((ascii(substr(k, CAST(i AS INT), 1)) >> CAST(j AS INT)) & 1 AS BIGINT))))"
)
_CRC32 = (
    f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}),"
    " lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT))"
)

# The cheapest edits row by row: the best path to each state (nothing, after s, after u, after a).
CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations),
kinds AS (SELECT *, {_CRC32} % 20 AS kind FROM keyed),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM kinds),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
           substr(role, 1, 1) AS initial
    FROM damaged),
judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM ordered),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM judged GROUP BY conv_id),
paths AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS x0, '~' AS x1, '000000005I' AS x2, '000000010II' AS x3
    FROM conversations
    UNION ALL
    SELECT conv_id, i, y0, y1, z2, least(y3, {_step("z2", 5, "I")})
    FROM (SELECT conv_id, i, y0, y1, y3,
                 least(y2, {_step("y0", 5, "I")}, {_step("y1", 5, "I")}, {_step("y3", 5, "I")}) AS z2
          FROM (SELECT p.conv_id, j.i, {_step("x0", 2, "D")} AS y0,
                       least({_step("x1", 2, "D")}, {_row("x0", _S, _CUT)}) AS y1,
                       least({_step("x2", 2, "D")}, {_row("x0", _U, _CUT)}, {_row("x1", _U, _CUT)}, {_row("x3", _U, _CUT)},
                             {_row("x0", "true", f"1 + {_CUT}", "R")}, {_row("x1", "true", f"1 + {_CUT}", "R")},
                             {_row("x3", "true", f"1 + {_CUT}", "R")}) AS y2,
                       least({_step("x3", 2, "D")}, {_row("x2", _A, _CUT)}, {_row("x2", "true", f"1 + {_CUT}", "R")}) AS y3
                FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1))),
best AS (
    SELECT p.conv_id, CAST(substr(least(x0, x3), 1, 9) AS BIGINT) AS cost, substr(least(x0, x3), 10) AS audit
    FROM paths p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(c.n, 0)),
letters AS (SELECT conv_id, p, substr(audit, CAST(p AS INT), 1) AS letter
            FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place
           FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
spoken AS (
    SELECT l.conv_id, l.p, l.letter, l.place, CASE WHEN l.letter = 'I' THEN '' ELSE j.text END AS text, j.role,
           max(CASE WHEN l.letter = 'K' AND l.place = 1 AND j.initial = 's' THEN 1 ELSE 0 END)
               OVER (PARTITION BY l.conv_id) AS led
    FROM placed l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i AND l.letter <> 'I'
    WHERE l.letter <> 'D'),
said AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user'
                                           ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS digest
    FROM spoken GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
     LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLE = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_warc": WARC,
    "op3_jaccard_join": JACCARD,
    "op4_quality_rules": quality(
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
    ),
    "op7_url_filter": URLS,
    "op9_mix": MIX,
    "op11_conversations": CONVERSATIONS,
}
