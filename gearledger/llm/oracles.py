"""The same questions as SQL for another engine, stated plainly over whole tables."""

from __future__ import annotations

from . import conversations as C
from . import decontamination as D
from . import licenses as L
from . import mixing as M
from . import neardup as N
from . import substrings as S
from . import topk as K

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word_list(text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def mixing(documents: str = "documents") -> str:
    cycle = f"[{', '.join(map(str, M.CYCLE))}]"
    return f"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{M.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT >> 2 AS cell
  FROM {documents}
), totals AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source
), weighed AS (
  SELECT *, {cycle}[((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {len(M.CYCLE)} + 1)::INT]::BIGINT AS w,
         {M.MAX_EPOCHS} * s AS cap FROM totals
), filled AS (
  SELECT *, (sum(s) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wrest
  FROM weighed
), level AS (
  -- The first source, by cap per weight, that its share does not fill: everything after it stays below its cap too.
  SELECT rest, wrest, cap::DOUBLE / w AS ratio FROM filled WHERE w::HUGEINT * rest <= cap::HUGEINT * wrest
  ORDER BY cap / w LIMIT 1
), targets AS (
  SELECT source, s, CASE WHEN w::HUGEINT * rest > cap::HUGEINT * wrest THEN cap::DOUBLE ELSE (w * rest)::DOUBLE / wrest END AS target
  FROM (SELECT source, s, w, cap, (SELECT rest FROM level) AS rest, (SELECT wrest FROM level) AS wrest FROM weighed)
), needs AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM targets
), cells AS (
  SELECT source, cell, sum(size)::BIGINT AS n FROM sized GROUP BY source, cell
), run AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cells
)
SELECT d.doc_id, d.size, t.s AS source_size, t.target,
       d.size * (t.whole + CASE WHEN 2 * r.before + r.n <= 2 * (t.target - t.whole * t.s) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized d
JOIN needs t ON d.source IS NOT DISTINCT FROM t.source
JOIN run r ON d.source IS NOT DISTINCT FROM r.source AND d.cell = r.cell
"""


def top_k(embeddings: str = "embeddings") -> str:
    return f"""
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({K.SCALE} * x::DOUBLE)) AS v FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), asked AS (
  SELECT DISTINCT vec_id AS query_id, v FROM points WHERE vec_id % {K.EVERY} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT a.query_id, p.vec_id,
               CASE WHEN len(p.v) = 0 THEN 0 ELSE list_inner_product(a.v, p.v) END::BIGINT AS score
        FROM asked a JOIN points p ON p.vec_id <> a.query_id AND len(p.v) = len(a.v))
) WHERE rank <= {K.K}
"""


def decontamination(documents: str = "documents", benchmark: str = "benchmark") -> str:
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {word_list()} AS w FROM {documents}
), items AS (
  SELECT item_id::VARCHAR AS item, w, least(len(w), {D.WINDOW}) AS n
  FROM (SELECT item_id, {word_list()} AS w FROM {benchmark}) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.r, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.t = p.t
), per_doc AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT r, i, n FROM hits) h, range(0, {D.WINDOW}) t(k) WHERE k < h.n GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(p.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(p.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN per_doc p USING (r) LEFT JOIN covered c USING (r)
"""


def licenses(documents: str = "documents") -> str:
    half = L.BLOCK // 2
    starts = ", ".join(
        f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = {quoted(word)}" for k, word in enumerate(p.split()))
        + ")"
        for p, _ in L.PHRASES
    )
    templates = ", ".join(
        f"({number}, {quoted(label)}, [{', '.join(map(quoted, sorted(set(text.split()))))}])"
        for number, (label, text) in enumerate(L.TEMPLATES)
    )
    names = "[" + ", ".join(quoted(label) for _, label in L.PHRASES) + "]"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {word_list()} AS w FROM {documents}
), facts AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, [{starts}] AS starts FROM docs
), blocks AS (
  SELECT r, w[i * {half} + 1 : i * {half} + {L.BLOCK}] AS b
  FROM (SELECT r, w, unnest(range(0, greatest(0, (len(w) + {half - 1}) // {half} - 2) + 1)) AS i FROM docs)
), templates(number, label, tokens) AS (VALUES {templates}),
met AS (
  SELECT r, label, len(list_intersect(tokens, b)) AS shared, len(tokens) AS size FROM blocks, templates
  WHERE 100 * len(list_intersect(tokens, b)) >= {L.CONTAINED} * len(tokens)
), more AS (
  SELECT r, list(DISTINCT label) AS labels, max(shared::DOUBLE / size) AS best FROM met GROUP BY r
), named AS (
  SELECT f.*, flatten(starts) AS every, coalesce(m.labels, []::VARCHAR[]) AS more, m.best,
         list_filter({names}, lambda x, i: len(starts[i]) > 0) AS base
  FROM facts f LEFT JOIN more m USING (r)
)
SELECT doc_id, n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM named
"""


def near_duplicates(documents: str = "documents") -> str:
    k = N.SHINGLE
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i : i + {k - 1}], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), common AS (
  SELECT x.r AS a, y.r AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes u ON u.r = a JOIN sizes v ON v.r = b WHERE 100 * shared >= {N.THRESHOLD} * (u.n + v.n - shared)
), reach AS (
  SELECT r AS a, r AS b FROM docs
  UNION
  SELECT x.a, l.b FROM reach x JOIN links l ON l.a = x.b
), least AS (
  SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = b GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id IS NOT DISTINCT FROM l.component_id AS kept
FROM docs d LEFT JOIN sizes s USING (r) JOIN least l USING (r)
"""


def substrings(documents: str = "documents") -> str:
    n = S.LENGTH
    return f"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM {documents}
), grams AS (
  SELECT doc_id, p, md5(x[2 * p + 1 : 2 * p + {2 * n}]) AS g
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {n - 1})) AS p FROM docs WHERE len(x) >= {2 * n})
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM grams) WHERE k > 1
), marked AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {n} THEN 0 ELSE 1 END AS fresh FROM later)
), spans AS (
  SELECT doc_id, s, min(p) AS a, max(p) + {n} AS b FROM marked GROUP BY doc_id, s
), gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x[2 * a + 1 : coalesce(2 * b, len(x))], '' ORDER BY a) AS k FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def prefix_trie(conversations: str = "conversations") -> str:
    bit = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"""
WITH turns AS (
  SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM {conversations} WHERE conv_id IS NOT NULL
), original AS (
  SELECT conv_id, list(turn ORDER BY p) AS turns FROM turns GROUP BY conv_id
), lead AS (
  SELECT conv_id, turns, xor(crc, 4294967295) % {C.BORROWED} AS h FROM (
    SELECT conv_id, turns,
           list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                       lambda crc, c: list_transform([xor(crc, c)], lambda x: {bit})[1]) AS crc
    FROM original)
), rebuilt AS (
  SELECT l.conv_id, list_concat(coalesce(b.turns[1 : l.h], []), l.turns[l.h + 1 :]) AS turns
  FROM lead l LEFT JOIN original b ON b.conv_id = l.conv_id - l.conv_id % {C.HUNDRED}
), members AS (
  SELECT conv_id, turns, d, turns[1 : d] AS path FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '')) AS ends_sha256
  FROM members GROUP BY path, d
), families AS (
  SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), known AS (
  SELECT n.*, coalesce(f.n_children, 0) AS n_children,
         CASE WHEN d > 0 THEN (n_convs - 1) * length(n.path[d].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN families f ON f.path = n.path
), below AS (
  SELECT path[1 : k] AS path, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, d + 1)) AS k FROM known) GROUP BY 1
)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN below b ON b.path = k.path LEFT JOIN known p ON k.d > 0 AND p.path = k.path[1 : k.d - 1]
"""
