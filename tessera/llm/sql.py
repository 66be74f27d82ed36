"""DuckDB SQL with the same rows as those queries that SQL can express."""

from .urls import SUFFIXES

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source,
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'reference'
      WHEN regexp_matches(source, '^src1[5-9]$') THEN 'forum' ELSE 'other' END AS domain,
    len([w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''])::BIGINT AS tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, 4 * sum(tokens)::HUGEINT AS cap FROM d GROUP BY ALL
), d_in AS (
  SELECT 0 AS root, domain, sum(cap)::HUGEINT AS cap, (SELECT sum(tokens)::HUGEINT FROM leaf) AS budget FROM leaf GROUP BY ALL
), d_out AS (
  SELECT domain, cap, CASE WHEN full_ THEN cap
      WHEN open_w > 0 THEN least(((budget - spent) * w) // open_w, cap) ELSE 0 END AS budget
  FROM (
    SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY root), 0) AS spent,
      coalesce(sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY root), 0) AS open_w
    FROM (
      SELECT *, cap * (all_w - before_w) <= (budget - before_cap) * w AS full_
      FROM (
        SELECT *, coalesce(sum(cap) OVER o, 0) AS before_cap, coalesce(sum(w) OVER o, 0) AS before_w, sum(w) OVER (PARTITION BY root) AS all_w
        FROM (SELECT *, (CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END)::HUGEINT AS w FROM d_in)
        WINDOW o AS (PARTITION BY root ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    )
  )
), l_in AS (
  SELECT l.domain, lang, l.cap, d_out.budget FROM (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL) AS l JOIN d_out USING (domain)
), l_out AS (
  SELECT domain, lang, cap, CASE WHEN full_ THEN cap
      WHEN open_w > 0 THEN least(((budget - spent) * w) // open_w, cap) ELSE 0 END AS budget
  FROM (
    SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain), 0) AS spent,
      coalesce(sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain), 0) AS open_w
    FROM (
      SELECT *, cap * (all_w - before_w) <= (budget - before_cap) * w AS full_
      FROM (
        SELECT *, coalesce(sum(cap) OVER o, 0) AS before_cap, coalesce(sum(w) OVER o, 0) AS before_w, sum(w) OVER (PARTITION BY domain) AS all_w
        FROM (SELECT *, (CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END)::HUGEINT AS w FROM l_in)
        WINDOW o AS (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    )
  )
), s_in AS (
  SELECT leaf.domain, leaf.lang, source, tokens, leaf.cap, l_out.budget FROM leaf JOIN l_out USING (domain, lang)
), s_out AS (
  SELECT domain, lang, source, tokens, cap, CASE WHEN full_ THEN cap
      WHEN open_w > 0 THEN least(((budget - spent) * w) // open_w, cap) ELSE 0 END AS budget
  FROM (
    SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY domain, lang), 0) AS spent,
      coalesce(sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY domain, lang), 0) AS open_w
    FROM (
      SELECT *, cap * (all_w - before_w) <= (budget - before_cap) * w AS full_
      FROM (
        SELECT *, coalesce(sum(cap) OVER o, 0) AS before_cap, coalesce(sum(w) OVER o, 0) AS before_w, sum(w) OVER (PARTITION BY domain, lang) AS all_w
        FROM (SELECT *, 1::HUGEINT AS w FROM s_in)
        WINDOW o AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    )
  )
), e AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM s_out
), p AS (
  SELECT d.*, epochs, rest, md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM d JOIN e USING (domain, lang, source)
), c AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, place) AS before
  FROM p
), n AS (
  SELECT doc_id, domain, lang, source, tokens, epochs + (rest > 0 AND before < rest)::INT AS copies FROM c
)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, unnest(generate_series(0, (copies - 1)::BIGINT))::INTEGER AS epoch FROM n WHERE copies > 0
"""

OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT rid, doc_id, text,
    [w FOR w IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF w <> ''] AS words,
    [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM d
), e AS (
  SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM s WHERE len(words) >= 3
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle FROM e
), r AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, shingle) > 1
), c AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), f AS (
  SELECT s.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN c USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 10 * word_chars < 25 * n_words OR 10 * word_chars > 150 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM b
"""

_SECOND = "|".join(f"({'|'.join(second.split())})[.]{country}" for country, second in SUFFIXES.items())

_STRENGTH = """
  SELECT '{level}' AS level, count(*) AS m, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k,
    sum(n::DOUBLE * n) AS nn, sum(k::DOUBLE * k / n) AS kk
  FROM (SELECT {level} AS key, sum(n) AS n, sum(k) AS k FROM h WHERE n > 0 GROUP BY 1)
"""

OP10 = rf"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), l AS (
  SELECT doc_id AS page_id, max(coalesce((quality = 0 OR toxic = 1)::INT, 0)) AS bad FROM labels GROUP BY 1
), c AS (
  SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS name,
    count(bad) AS n, coalesce(sum(bad), 0) AS k
  FROM p LEFT JOIN l USING (page_id) GROUP BY ALL
), g AS (
  SELECT *, string_split(name, '.') AS labels, regexp_matches(name, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\[.*\])$') AS address,
    CASE WHEN regexp_matches(name, '(^|[.])({_SECOND})$') THEN 2 ELSE 1 END AS width
  FROM c
), h AS (
  SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(labels[-width - 1:], '.') END AS domain,
    CASE WHEN address THEN name ELSE array_to_string(labels[-width:], '.') END AS suffix
  FROM g
), sums AS ({" UNION ALL ".join(_STRENGTH.format(level=x) for x in ("host", "domain", "suffix"))}
), anova AS (
  SELECT level, m, n, (kk - k * k / n) / (m - 1) AS b, (k - kk) / (n - m) AS w, (n - nn / n) / (m - 1) AS size FROM sums
), alike AS (
  SELECT level, CASE WHEN m < 2 OR n <= m OR b + (size - 1) * w <= 0 THEN 0 ELSE (b - w) / (b + (size - 1) * w) END AS rho FROM anova
), strength AS (
  SELECT level, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM alike
), one AS (
  SELECT (SELECT s FROM strength WHERE level = 'host') AS hs, (SELECT s FROM strength WHERE level = 'domain') AS ds,
    (SELECT s FROM strength WHERE level = 'suffix') AS ss, coalesce((SELECT k / n FROM sums WHERE level = 'host'), 0) AS rate
), sp AS (
  SELECT suffix, (sum(k) + any_value(ss) * any_value(rate)) / (sum(n) + any_value(ss)) AS sp FROM h, one GROUP BY 1
), dp AS (
  SELECT domain, (sum(k) + any_value(ds) * any_value(sp)) / (sum(n) + any_value(ds)) AS dp FROM h JOIN sp USING (suffix), one GROUP BY 1
), ab AS (
  SELECT host, greatest(k + hs * dp, 1e-3) AS a, greatest(n - k + hs * (1 - dp), 1e-3) AS b FROM h JOIN dp USING (domain), one
), ends AS (
  SELECT *, ln(a) - ln(b) AS peak, ln(a) - ln(b) - 8 * sqrt(1 / a + 1 / b) - 20 / a AS low, ln(a) - ln(b) + 8 * sqrt(1 / a + 1 / b) + 20 / b AS high FROM ab
), cuts AS (
  SELECT *, least(greatest(0, low), high) AS cut, -a * (greatest(-peak, 0) + ln(1 + exp(-abs(peak)))) - b * (greatest(peak, 0) + ln(1 + exp(-abs(peak)))) AS top FROM ends
), grid AS (
  SELECT *, side, unnest(range(65)) AS step, CASE side WHEN 0 THEN low ELSE cut END AS from_, CASE side WHEN 0 THEN cut ELSE high END AS to_ FROM cuts, (VALUES (0), (1)) AS sides(side)
), points AS (
  SELECT *, from_ + (to_ - from_) * step / 64 AS u FROM grid
), masses AS (
  SELECT host, side, sum((CASE WHEN step IN (0, 64) THEN 1 WHEN step % 2 = 1 THEN 4 ELSE 2 END)
    * exp(-a * (greatest(-u, 0) + ln(1 + exp(-abs(u)))) - b * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - top)) * any_value(to_ - from_) AS mass
  FROM points GROUP BY ALL
), hp AS (
  SELECT host, sum(mass) FILTER (side = 1) / sum(mass) AS chance FROM masses GROUP BY 1
), j AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    host <> '' AND hp.chance > 0.95 AS bad
  FROM p LEFT JOIN hp USING (host)
)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
  WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE CASE WHEN bad THEN 'block' ELSE 'allow' END END AS verdict
FROM j
"""


def _clustering(k: int = 16, rounds: int = 3) -> str:
    """Each round: all distances, the nearest centroid, floors of the means."""
    steps = [
        "x AS (SELECT row_number() OVER () AS rid, vec_id, [floor(64 * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM x WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT rid, vec_id, x.v, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x.v, c{i}.v)])::BIGINT AS d FROM x, c{i})")
        steps.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        steps.append(
            f"m{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j)::BIGINT[] AS v FROM (SELECT c, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) t(j) GROUP BY ALL) GROUP BY c), "
            f"c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"
        )
    last = rounds
    return f"""WITH {', '.join(steps)}
      SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (c)"""


OP11 = _clustering()

OP13 = r"""
WITH w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), g AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, range(1, 4) t(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
), c AS MATERIALIZED (
  SELECT *, str_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10
), o AS MATERIALIZED (
  SELECT lang, phrase, f AS a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT o.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM o JOIN f AS x ON x.lang = o.lang AND x.phrase = o.head JOIN f AS y ON y.lang = o.lang AND y.phrase = o.rest
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, (row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase))::BIGINT AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 50 * a QUALIFY rank <= 2000
"""
