"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann_forest import op9_hash_prefix_forest
from .context_tree import op6_context_tree_weighting
from .fingerprints import op3_chroma_fingerprints
from .language import op12_byte_convolutions
from .mixing import op8_mixing
from .ngram_join import op7_ngram_jaccard_join
from .packing import op1_bm25_packing
from .sharding import op2_hypergeometric_shards
from .spelling import op11_spelling_neighbourhoods
from .template_removal import op4_template_removal
from .token_alignment import op13_pair_keys
from .token_files import op5_wavelet_files
from .toxicity import op10_string_kernel_toxicity

QUERIES = {
    "op1_bm25_packing": op1_bm25_packing,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_template_removal": op4_template_removal,
    "op5_wavelet_files": op5_wavelet_files,
    "op6_context_tree_weighting": op6_context_tree_weighting,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_hash_prefix_forest": op9_hash_prefix_forest,
    "op10_string_kernel_toxicity": op10_string_kernel_toxicity,
    "op11_spelling_neighbourhoods": op11_spelling_neighbourhoods,
    "op12_byte_convolutions": op12_byte_convolutions,
    "op13_pair_keys": op13_pair_keys,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)),
l2 AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reach) AS (SELECT a, a FROM l2 UNION SELECT r.node, l2.b FROM r JOIN l2 ON r.reach = l2.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN c ON doc_id = node""",
    "op11_spelling_neighbourhoods": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
d AS (SELECT w, doc_id || ':' || w AS s, count(*) AS n FROM r GROUP BY doc_id, w),
b AS (SELECT w, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM d),
h AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, crc),
m AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, left(word, i::INTEGER - 1) || substr(word, i::INTEGER + 1) AS cut, left(word, i::INTEGER - 1) || '*' || substr(word, i::INTEGER + 1) AS hole FROM i),
p AS (SELECT DISTINCT x.word AS a, x.n AS an, v.word AS b, v.n AS bn FROM x JOIN v ON x.cut = v.word),
e AS (SELECT a AS word, b AS near, bn AS near_n FROM p UNION ALL SELECT b, a, an FROM p UNION ALL SELECT x.word, y.word, y.n FROM x JOIN x y ON x.hole = y.hole AND x.word <> y.word),
g AS (SELECT word, count(*) AS n_near, min({{'n': -near_n, 'near': near}}) AS best FROM e GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * v.n THEN best.near END AS form, CASE WHEN -best.n >= 2 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN g USING (word)),
way(word, goal, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.goal WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(goal, step) AS root FROM way GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN z USING (word)""",
}
