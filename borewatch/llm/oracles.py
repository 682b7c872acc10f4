"""SQL for the queries that SQL can express, with every constant written out."""

OP1 = r"""
WITH read AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN count(*) OVER (PARTITION BY doc_id, coalesce(text, '')) > 512
      THEN row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) ELSE 0 END AS copy_no
  FROM documents
), counted AS (
  SELECT *, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS n,
    len(regexp_extract_all(body, '[0-9#*$%&|<>@^~_=+\\/{}\[\]]')) AS odd,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(body) || ':' || copy_no), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM read
), keyed AS (
  SELECT *, -ln(u) / CASE WHEN n = 0 THEN 0.01::DOUBLE
    ELSE greatest((n - odd)::DOUBLE / n * ((n - odd)::DOUBLE / n), 0.01::DOUBLE) END AS k
  FROM counted
), sources AS (
  SELECT source, sum(size)::DOUBLE AS s,
    [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
  FROM keyed GROUP BY source
), ordered AS (
  SELECT *, 1.5 * sum(s) OVER () AS budget,
    coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_before,
    sum(w) OVER (ORDER BY 2 * s / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sources
), cut AS (
  SELECT *, (budget - cut_before) / w_left * w >= 2 * s AS is_cut FROM ordered
), targets AS (
  SELECT source, s, CASE WHEN is_cut THEN 2 * s ELSE
    (budget - sum(CASE WHEN is_cut THEN 2 * s ELSE 0 END) OVER ())
    / sum(CASE WHEN is_cut THEN 0 ELSE w END) OVER () * w END AS target
  FROM cut
), summed AS (
  SELECT keyed.*, s, target,
    sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id, md5(body) ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed JOIN targets ON keyed.source IS NOT DISTINCT FROM targets.source
), copied AS (
  SELECT *, ((CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END)
    + CASE WHEN upto - size / 2.0::DOUBLE < target - (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END) * s THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM summed
)
SELECT doc_id, source, size, s::BIGINT AS source_size, target, copies * size AS taken, copies FROM copied
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT least.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, least.vec_id = component_id AS kept
FROM least LEFT JOIN counts ON counts.vec_id = least.vec_id
"""

OP6 = r"""
WITH p AS (
  SELECT page_id, url,
    lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule,
  CASE
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?casino([.\-][^/?#]*)?([/?#]|$)') THEN 'casino'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?free-bets([.\-][^/?#]*)?([/?#]|$)') THEN 'free-bets'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?poker([.\-][^/?#]*)?([/?#]|$)') THEN 'poker'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?slots([.\-][^/?#]*)?([/?#]|$)') THEN 'slots'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?adult([.\-][^/?#]*)?([/?#]|$)') THEN 'adult'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?porn([.\-][^/?#]*)?([/?#]|$)') THEN 'porn'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?cheap-pills([.\-][^/?#]*)?([/?#]|$)') THEN 'cheap-pills'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?viagra([.\-][^/?#]*)?([/?#]|$)') THEN 'viagra'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?ads-track([.\-][^/?#]*)?([/?#]|$)') THEN 'ads-track'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?spam-farm([.\-][^/?#]*)?([/?#]|$)') THEN 'spam-farm'
    WHEN regexp_matches(lower(url), '://([^/?#]*[.\-])?doubleclick([.\-][^/?#]*)?([/?#]|$)') THEN 'doubleclick'
    WHEN regexp_matches(lower(url), '[?&]aff(iliate)?_id=[0-9]+') THEN 'affiliate-link'
    WHEN regexp_matches(lower(url), '[?&]phpsessid=[0-9a-f]+') THEN 'session-link'
    WHEN regexp_matches(lower(url), '/(cart|checkout)/(add|step)[/?]') THEN 'cart'
    WHEN regexp_matches(lower(url), '/search\?([^#]*&)?q=') THEN 'search-page'
    WHEN regexp_matches(lower(url), '\.(zip|rar|7z)([?#]|$)') THEN 'archive'
  END AS found
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN found IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN found END AS pattern
FROM ruled
"""

OP11 = """
WITH read AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other_id,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM read a JOIN read b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT alike
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""

#: crc32 bit by bit over the decimal digits; paths are texts of one MD5 for each turn.
OP12 = """
WITH turns AS (
  SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
    strlen(coalesce(text, ''))::BIGINT AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS own
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, count(*) AS n, c - c % 5 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda crc, b: list_reduce(
        list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))
    ), 4294967295) % 9 AS h
  FROM turns GROUP BY c
), plan AS (
  SELECT ids.*, least(ids.h, coalesce(b.n, 0)) AS taken FROM ids LEFT JOIN ids b ON ids.base = b.c
), rebuilt AS (
  SELECT plan.c, own AS pos, mark, size FROM plan JOIN turns ON turns.c = plan.base AND own < taken
  UNION ALL
  SELECT plan.c, own - h + taken, mark, size FROM plan JOIN turns ON turns.c = plan.c AND own >= h
), prefixes AS (
  SELECT c, pos + 1 AS depth, size,
    string_agg(mark, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path,
    count(*) OVER (PARTITION BY c) AS n_turns
  FROM rebuilt
  UNION ALL
  SELECT ids.c, 0, 0, '', count(r.c) FROM ids LEFT JOIN rebuilt r ON r.c = ids.c GROUP BY ids.c
), nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth
), kids AS (
  SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), marked AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path
), above AS (
  SELECT unnest(generate_series(0, depth)) AS top, * FROM marked
), totals AS (
  SELECT left(path, 32 * top::INT) AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM above GROUP BY 1
)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children,
  t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM marked m JOIN totals t ON t.path = m.path
LEFT JOIN nodes p ON m.depth > 0 AND p.path = left(m.path, 32 * (m.depth - 1)::INT)
"""

ORACLES = {"op1_mix": OP1, "op5_vectors": OP5, "op6_urls": OP6, "op11_hard_negatives": OP11, "op12_prefix_trie": OP12}
