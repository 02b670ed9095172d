"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"


def quality_sql() -> str:
    """op5: measures, base verdict, failure bits and the v2 verdict."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(8) t(j) GROUP BY 1),
m AS (SELECT d.k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS n_lines,
  len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')))) AS n_kinds,
  coalesce(cover.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_caps, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_same_next,
  len(list_filter(w, lambda x: regexp_matches(x, '(!!|\?\?|###|\*\*\*|\$\$\$|%%%|&&&)$'))) AS n_marked
  FROM d LEFT JOIN cover ON cover.k = d.k),
f AS (SELECT *, CAST(n_lines - n_kinds AS BIGINT) AS n_dup_lines,
  CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (100 * (n_lines - n_kinds) > 30 * n_lines)::INT
  + 16 * (word_chars > 12 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (2 * n_caps > n_letters AND n_letters > 0)::INT
  + 128 * (10 * n_marked > 3 * n_words)::INT + 256 * (2 * n_same_next > n_words)::INT + 512 * (n_words < 1)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & (1 + 2 + 4 + 16 + 32 + 256) = 0 AS kept, failed FROM f
"""


def ablations_sql(rules: dict[str, int]) -> str:
    """What each of the rules (name, bit) rejects, alone rejects, and what would stay without it."""
    whole = sum(rules.values())
    return f"""
WITH masks AS (SELECT failed & {whole} AS m, count(*) AS n FROM ({quality_sql()}) GROUP BY 1),
r (rule, bit) AS (VALUES {", ".join(map(str, rules.items()))})
SELECT rule, CAST(sum(CASE WHEN m & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN m = bit THEN n ELSE 0 END) AS BIGINT) AS n_only,
CAST(sum(CASE WHEN m & ({whole} - bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS n_kept_without FROM masks, r GROUP BY rule
"""


def url_sql(rules: dict[str, str], rounds: int, damping: float = 0.85, threshold: float = 0.5) -> str:
    """op1: rules, then the ranks round by round over the graph of hosts. Pages' links must be relative or absolute with a scheme."""
    tests = []
    for rule in sorted(rules, key=len, reverse=True):
        name, slash, rest = rule.partition("/")
        tests.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash}{rest}') THEN '{rule}'")
    told = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items()) + " END"
    steps = ""
    for k in range(1, rounds + 1):
        steps += f""", r{k} AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (
SELECT f.dst AS host, r.good * f.fg * {damping} AS good, r.bad * f.fb * {damping} AS bad FROM r{k - 1} r JOIN flows f ON f.src = r.host
UNION ALL SELECT host, good, bad FROM r0) GROUP BY 1)"""
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, CASE {' '.join(tests)} END AS rule FROM h),
links AS (SELECT host AS src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT DISTINCT page_id, host, lower(unnest(regexp_extract_all(coalesce(html, ''), '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1))) AS dst FROM p WHERE host <> '') WHERE host <> dst GROUP BY 1, 2),
parts AS (SELECT DISTINCT string_split(host, '.') AS s FROM p WHERE host <> ''),
ties AS (SELECT DISTINCT array_to_string(s[k:], '.') AS a, array_to_string(s[k + 1:], '.') AS b FROM (SELECT s, unnest(range(1, len(s) - 1)) AS k FROM parts)),
edges AS (SELECT src, dst, sum(w) AS w FROM (FROM links UNION ALL SELECT a, b, 1.0::DOUBLE FROM ties UNION ALL SELECT b, a, 1.0::DOUBLE FROM ties) GROUP BY 1, 2),
flows AS (SELECT src, dst, sum(fg) AS fg, sum(fb) AS fb FROM (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS fg, 0.0::DOUBLE AS fb FROM edges
UNION ALL SELECT dst, src, 0.0::DOUBLE, w / sum(w) OVER (PARTITION BY dst) FROM edges) GROUP BY 1, 2),
per AS (SELECT host, count(*) AS n, count(*) FILTER ({told} = 'allow') AS yes, count(*) FILTER ({told} = 'block') AS no FROM p WHERE host <> '' GROUP BY 1),
seeds AS (SELECT host, CASE WHEN yes > 0 AND NOT 2 * no > n THEN n ELSE 0 END::DOUBLE AS good, CASE WHEN 2 * no > n THEN n ELSE 0 END::DOUBLE AS bad FROM per),
r0 AS (SELECT host, coalesce(good / nullif(sum(good) OVER (), 0), 0) AS good, coalesce(bad / nullif(sum(bad) OVER (), 0), 0) AS bad FROM seeds){steps},
z AS (SELECT host, coalesce(good / nullif(sum(good) OVER (), 0), 0) AS good, coalesce(bad / nullif(sum(bad) OVER (), 0), 0) AS bad FROM r{rounds})
SELECT page_id, p.host AS host, path, rule, coalesce({told}, CASE WHEN bad / nullif(good + bad, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
round(coalesce(good, 0), 8) AS trust, round(coalesce(bad, 0), 8) AS distrust FROM p LEFT JOIN z r ON r.host = p.host
"""


def merkle_sql(fields: tuple[str, ...], changed: str = "n_chars") -> str:
    """op11: leaves, levels pairwise upward by language and over languages, and the climb of each leaf with its claimed hash."""
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = " || ".join(map(told, fields))
    other = " || ".join(told(f"({c} + 1)" if c == changed else c) for c in fields)
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, lang, sha256({leaf}) AS leaf, sha256({other}) AS told,
  list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM documents),
x AS (SELECT doc_id, lang, leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN told ELSE leaf END AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM w),
up AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM x UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2),
sub AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank, count(*) OVER () AS m FROM up WHERE n = 1),
top AS (SELECT 0 AS level, rank AS pos, subroot AS h, m AS n FROM sub UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
nodes AS (SELECT lang, level, pos, h FROM up WHERE n > 1 UNION ALL SELECT s.lang, s.height + t.level, t.pos, t.h FROM sub s, top t WHERE t.n > 1),
climb AS (SELECT doc_id, x.lang, leaf, 0 AS level, pos, claimed AS f, '' AS proof, height, rank, subroot FROM x JOIN sub s ON s.lang IS NOT DISTINCT FROM x.lang
  UNION ALL SELECT doc_id, c.lang, leaf, c.level + 1, p // 2, sha256(CASE WHEN p % 2 = 1 THEN coalesce(b.h, '') || f ELSE f || coalesce(b.h, '') END), proof || coalesce(b.h, ''), height, rank, subroot
  FROM (SELECT *, CASE WHEN level = height THEN rank ELSE pos END AS p FROM climb) c JOIN nodes a ON a.lang IS NOT DISTINCT FROM c.lang AND a.level = c.level AND a.pos = c.p
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM c.lang AND b.level = c.level AND b.pos = xor(c.p, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM climb, (SELECT h AS root, (SELECT max(level) FROM top) AS crown FROM top WHERE n = 1) WHERE level = height + crown
"""
