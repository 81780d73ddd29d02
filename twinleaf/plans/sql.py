"""DuckDB statements with the rows of the registered queries."""

from __future__ import annotations

from twinleaf.functions.cascade import RULES
from twinleaf.functions.constants import CLEANING, STOP_WORDS
from twinleaf.operators.tagging import ENTITY_WORDS, NUMERIC


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = "[" + ", ".join(map(_quoted, STOP_WORDS)) + "]"
PAIRS = r"""pairs AS (
  SELECT a.conv_id * 100 + a.turn AS id, a.conv_id * 100 + a.turn AS qid1, a.conv_id * 100 + a.turn + 1 AS qid2,
    regexp_replace(a.text, '[^ -~]+', ' ', 'g') AS question1,
    regexp_replace(b.text, '[^ -~]+', ' ', 'g') AS question2,
    (a.role = 'user')::INT AS is_duplicate
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
TOK = PAIRS + rf""", tok0 AS (
  SELECT *, list_filter(regexp_split_to_array(question1, '\s+'), lambda w: w <> '') AS w1,
    list_filter(regexp_split_to_array(question2, '\s+'), lambda w: w <> '') AS w2 FROM pairs),
tok1 AS (SELECT *, list_transform(w1, lambda w: lower(w)) AS q1w, list_transform(w2, lambda w: lower(w)) AS q2w FROM tok0),
tok AS (SELECT *, list_distinct(q1w) AS s1, list_distinct(q2w) AS s2,
    list_filter(list_distinct(q1w), lambda w: NOT list_contains({STOPS}, w)) AS n1,
    list_filter(list_distinct(q2w), lambda w: NOT list_contains({STOPS}, w)) AS n2 FROM tok1)"""
GRAPH = """gp AS (
  SELECT DISTINCT a.l_orderkey AS id, a.l_partkey AS u, b.l_partkey AS v
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
e AS (SELECT u, v FROM gp UNION SELECT v, u FROM gp),
deg AS (SELECT u AS node, count(*) AS degree FROM e GROUP BY u)"""
SCORED = r"""words AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[^ -~]+', ' ', 'g'), ' +'), lambda w: w <> '')) AS s FROM documents),
scored AS (
  SELECT a.doc_id AS id, quality::INT AS y,
    round(least(greatest(len(list_intersect(a.s, b.s)) / greatest(len(list_distinct(list_concat(a.s, b.s))), 1), 0.01), 0.99), 6)::DOUBLE AS p,
    (CASE WHEN quality = 1 THEN 0.472 ELSE 1.309 END)::DOUBLE AS w
  FROM words a JOIN words b ON b.doc_id = a.doc_id + 1 JOIN labels l ON l.doc_id = a.doc_id)"""
TAGGED = TOK + r""", qs AS (SELECT qid1 AS qid, w1 AS w FROM tok UNION SELECT qid2, w2 FROM tok), words0 AS (SELECT qid, unnest(w) AS text, unnest(range(len(w))) AS pos FROM qs),
tagged AS (SELECT qid, pos::INT AS pos, lower(text) AS word, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN 'CARDINAL'
    WHEN regexp_matches(text, '^[A-Z]') AND length(text) % 3 = 0 THEN 'PERSON'
    WHEN regexp_matches(text, '^[A-Z]') AND length(text) % 3 = 1 THEN 'GPE' ELSE '' END AS ent_type FROM words0),
votes AS (SELECT word, ent_type, round(count(*) - CASE WHEN ent_type = '' THEN 0.1 ELSE 0 END, 6)::DOUBLE AS votes FROM tagged GROUP BY word, ent_type),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY votes DESC, ent_type) AS rank FROM votes)"""
VECS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
v AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
z AS (SELECT vec_id, a, b, list_transform(list_zip(a, b), lambda t: t[1] - t[2]) AS d FROM v)"""
SIDES = PAIRS + ", qs AS (SELECT id, 1 AS side, question1 AS question FROM pairs UNION ALL SELECT id, 2, question2 FROM pairs)"
#: A run up to and with a sign after which a letter is lowered, or the rest.
_PIECE = "[^.?!)''\"]*[.?!)''\"]|[^.?!)''\"]+$"
_STARTS = f"{SIDES}, ps AS (SELECT id, side, question, unnest(regexp_extract_all(question, '{_PIECE}')) AS p, unnest(range(len(regexp_extract_all(question, '{_PIECE}')))) AS k FROM qs), ls AS (SELECT id, side, coalesce((SELECT string_agg(lower(regexp_extract(p, '^\\s*.')) || substr(p, length(regexp_extract(p, '^\\s*.')) + 1), '' ORDER BY k) FROM ps WHERE ps.id = qs.id AND ps.side = qs.side), '') AS cleaned FROM qs)"
UNIQ = "list_distinct(list_concat({0}, {1}))"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {a} = 0 THEN 0 WHEN {b} = 0 THEN NULL ELSE {b} / {a} END, 6)::DOUBLE"


def _features() -> dict[str, str]:
    inter = "len(list_intersect(q1w, q2w))"
    j1, j2, m1, m2 = (f"length(array_to_string({x}, ''))" for x in ("q1w", "q2w", "n1", "n2"))
    chars1, chars2 = ("list_distinct(string_split(question1, ''))", "list_distinct(string_split(question2, ''))")
    return {
        "b1_word_match": "round(CASE WHEN len(n1) = 0 OR len(n2) = 0 THEN 0 ELSE 2 * len(list_intersect(n1, n2)) / (len(n1) + len(n2)) END, 6)::DOUBLE",
        "b2_jaccard": f"round({inter} / greatest(len({UNIQ.format('q1w', 'q2w')}), 1), 6)::DOUBLE",
        "b3_common_words": inter,
        "b4_total_unique_words": f"len({UNIQ.format('q1w', 'q2w')})",
        "b5_total_unq_words_stop": f"len({UNIQ.format('n1', 'n2')})",
        "b6_wc_diff": "abs(len(q1w) - len(q2w))",
        "b7_wc_ratio": _ratio("len(q1w)", "len(q2w)"),
        "b8_wc_diff_unique": "abs(len(s1) - len(s2))",
        "b9_wc_ratio_unique": _ratio("len(s1)", "len(s2)"),
        "b10_wc_diff_unq_stop": "abs(len(n1) - len(n2))",
        "b11_wc_ratio_unique_stop": _ratio("len(n1)", "len(n2)"),
        "b12_same_start": "CASE WHEN len(q1w) > 0 AND len(q2w) > 0 THEN (q1w[1] = q2w[1])::BIGINT END",
        "b13_char_diff": f"abs({j1} - {j2})",
        "b14_char_ratio": _ratio(j1, j2),
        "b15_char_diff_unq_stop": f"abs({m1} - {m2})",
        "l1_diff_len": "abs(length(question1) - length(question2))",
        "l2_diff_len_word": "abs(len(w1) - len(w2))",
        "l3_diff_len_char": r"abs(length(regexp_replace(question1, '\s.', '', 'g')) - length(regexp_replace(question2, '\s.', '', 'g')))",
        "e1_jaccard_distance": f"round(1 - len(list_intersect(w1, w2)) / greatest(len({UNIQ.format('w1', 'w2')}), 1), 6)::DOUBLE",
        "e2_levenshtein": "round(coalesce(levenshtein(question1, question2) / nullif(greatest(length(question1), length(question2)), 0), 0), 6)::DOUBLE",
        "e4_sorensen": f"round(1 - coalesce(2 * len(list_intersect({chars1}, {chars2})) / nullif(len({chars1}) + len({chars2}), 0), 0), 6)::DOUBLE",
        "u5_in_row_sets": f"(len(s1) - {inter}) * 10000 + {inter}",
    }


def _clean() -> str:
    out = r"array_to_string(qw, ' ')"
    for pattern, to in CLEANING:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return out


#: The rules that look around, in forms without that; the first is needed twice, as its matches may share a digit.
PLAIN = {
    r"(?<=[0-9]),(?=[0-9])": [(r"([0-9]),([0-9])", r"\1\2")] * 2,
    r"(?i)(?<=[0-9])rs ": [(r"(?i)([0-9])(rs )", r"\1 rs ")],
    r"(?i) rs(?=[0-9])": [(r"(?i) rs([0-9])", r" rs \1")],
}


def _ruled() -> str:
    out = "' ' || cleaned || ' '"
    for pattern, to in [*[x for p, t in RULES for x in PLAIN.get(p, [(p, t.replace("$1", r"\1"))])], (r"([()\[\]{}<>'\"])", r" \1 "), (" s ", " "), (r"\s+", " ")]:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return f"trim({out})"


def _grams(n: int) -> str:
    return PAIRS + rf""", txt AS (
  SELECT id, 1 AS side, regexp_replace(lower(question1), '\s+', ' ', 'g') AS t FROM pairs
  UNION ALL SELECT id, 2, regexp_replace(lower(question2), '\s+', ' ', 'g') FROM pairs),
g AS (SELECT id, side, substr(t, i, {n}) AS gram, count(*) AS c FROM (SELECT id, side, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM txt) GROUP BY ALL),
voc AS (SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 5),
ab AS (SELECT id, gram, df, sum(CASE WHEN side = 1 THEN c ELSE 0 END) AS a, sum(CASE WHEN side = 2 THEN c ELSE 0 END) AS b FROM g JOIN voc USING (gram) GROUP BY ALL)"""


def _weights(one: str, two: str) -> str:
    return f"""WITH {TOK}, cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_concat(q1w, q2w)) AS word FROM tok) GROUP BY word),
wt AS (SELECT word, CASE WHEN n < 2 THEN 0 ELSE 1.0::DOUBLE / (n + 10000) END AS weight FROM cnt),
x AS (SELECT id, unnest({one}) AS word, {two} AS other FROM tok UNION ALL SELECT id, unnest({two}), {one} FROM tok),
s AS (SELECT id, sum(CASE WHEN list_contains(other, word) THEN weight ELSE 0 END) / nullif(sum(weight), 0) AS value FROM x JOIN wt USING (word) GROUP BY id)
SELECT tok.id, round(coalesce(value, 0), 6)::DOUBLE AS value FROM tok LEFT JOIN s USING (id)"""


GRAMS2 = _grams(2)


def features() -> dict[str, str]:
    """Each pair feature over ``tok``."""
    return _features()


FIVE = ("b1_word_match", "b2_jaccard", "b4_total_unique_words", "b6_wc_diff", "l1_diff_len")


def statements() -> dict[str, str]:
    f = _features()
    long = {"b1", "b2", "b7", "b9", "b11", "b14", "e1", "e2", "e4"}
    out = {k: f"WITH {TOK} SELECT id, {v if k.split('_')[0] in long else f'({v})::BIGINT'} AS value FROM tok" for k, v in f.items()}
    feat = f"{TOK}, feat AS (SELECT id, is_duplicate AS y, " + ", ".join(f"({f[k]})::DOUBLE AS {k}" for k in FIVE) + " FROM tok)"
    p = f"WITH {PAIRS} SELECT "
    out |= {
        "flagship": f"WITH {TOK} SELECT is_duplicate, count(*) AS pairs, round(avg({f['b2_jaccard']}), 6) AS mean_jaccard, round(avg({f['b4_total_unique_words']}), 6) AS mean_union, round(avg({f['b6_wc_diff']}), 6) AS mean_diff FROM tok GROUP BY 1",
        "s1_fill_nulls": p + "id, CASE WHEN length(question1) > 50 THEN question1 ELSE 'nan' END AS question1 FROM pairs",
        "s12_json_sink": p + "is_duplicate, '{\"n\":' || count(*) || '}' AS record FROM pairs GROUP BY 1",
        "s18_histogram": f"WITH {TOK} SELECT floor({f['b2_jaccard']} * 20)::BIGINT AS bin, count(*) AS rows FROM tok GROUP BY 1",
        "p3_abs_difference": p + "id, abs(qid1 - qid2) AS value FROM pairs",
        "p5_filter_label": p + "id, question1 FROM pairs WHERE is_duplicate = 1",
        "p7_stop_words": f"WITH {TOK} SELECT id, array_to_string(list_filter(list_filter(q1w, lambda w, i: list_position(q1w, w) = i), lambda w: NOT list_contains({STOPS}, w)), ' ') AS kept FROM tok",
        "p9_class_weight": p + "id, (CASE WHEN is_duplicate = 1 THEN 0.472 ELSE 1.309 END)::DOUBLE AS w, -1 AS constant FROM pairs",
        "p12_flip": p + "id, qid1, qid2, 0 AS mirrored FROM pairs UNION ALL SELECT id, qid2, qid1, 1 FROM pairs",
        "j1_feature_attach": f"WITH {TOK} SELECT id, is_duplicate, ({f['b4_total_unique_words']})::BIGINT AS unique_words, ({f['b6_wc_diff']})::BIGINT AS wc_diff FROM tok",
        "j3_kcore_lookup": f"WITH {PAIRS}, k AS (SELECT DISTINCT lower(question1) AS q, length(question1) % 7 AS k FROM pairs WHERE length(question1) % 2 = 0) SELECT id, coalesce(a.k, 0)::BIGINT AS kcores1, coalesce(b.k, 0)::BIGINT AS kcores2 FROM pairs LEFT JOIN k a ON a.q = lower(question1) LEFT JOIN k b ON b.q = lower(question2)",
        "b16_tfidf_wm": _weights("s1", "s2"),
        "b17_tfidf_wm_stops": _weights("n1", "n2"),
        "b18_word_weight": f"WITH {TOK} SELECT word, round(1e6 * CASE WHEN count(*) < 2 THEN 0 ELSE 1.0::DOUBLE / (count(*) + 10000) END, 6)::DOUBLE AS weight FROM (SELECT unnest(list_concat(q1w, q2w)) AS word FROM tok) GROUP BY word",
        "a1_word_counts": f"WITH {TOK} SELECT word, count(*) AS n FROM (SELECT unnest(list_concat(q1w, q2w)) AS word FROM tok) GROUP BY word",
        "a2_degree": f"WITH {GRAPH} SELECT node, degree FROM deg",
        "a3_adjacency": f"WITH {GRAPH} SELECT u, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbours FROM e GROUP BY u",
        "j6_neighbour_lookup": f"WITH {GRAPH} SELECT id, gp.u, gp.v, a.degree AS degree_u, b.degree AS degree_v FROM gp JOIN deg a ON a.node = gp.u JOIN deg b ON b.node = gp.v",
        "j7_second_order": f"""WITH {GRAPH}, hop AS (SELECT DISTINCT a.u, b.v AS x FROM e a JOIN e b ON a.v = b.u)
SELECT id, u, v, (SELECT count(*) FROM hop p JOIN hop q ON p.x = q.x WHERE p.u = gp.u AND q.u = gp.v AND p.x <> gp.u AND p.x <> gp.v) AS common2 FROM gp""",
        "j8_common_neighbours": f"WITH {GRAPH}, n AS (SELECT u, list(v) AS ns FROM e GROUP BY u) SELECT id, gp.u, gp.v, len(list_intersect(a.ns, b.ns))::BIGINT AS common FROM gp JOIN n a ON a.u = gp.u JOIN n b ON b.u = gp.v",
        "a4_document_frequency": f"WITH {TOK}, q AS (SELECT question1 AS q, s1 AS s FROM tok UNION SELECT question2, s2 FROM tok), o AS (SELECT q, any_value(s) AS s FROM q GROUP BY q) SELECT term, count(*) AS df FROM (SELECT unnest(s) AS term FROM o) GROUP BY term HAVING count(*) >= 3",
        "a5_correlation": f"WITH {feat} SELECT " + ", ".join(f"round(corr(y, {k}), 6) AS {k}" for k in FIVE) + " FROM feat",
        "a6_weighted_ctr": f"WITH {SCORED} SELECT round(sum(y * w) / sum(w), 6) AS ctr FROM scored",
        "a7_describe": f"WITH {feat} " + " UNION ALL ".join(f"SELECT '{k}' AS feature, count({k}) AS n, round(avg({k}), 6) AS mean, round(stddev_samp({k}), 6) AS std, min({k}) AS least, max({k}) AS most FROM feat" for k in FIVE),
        "a8_variance": f"WITH {feat} SELECT " + ", ".join(f"round(var_pop({k}), 6) AS {k}" for k in FIVE) + " FROM feat",
        "a10_score_share": f"WITH {SCORED} SELECT y, round(sum(p) / (SELECT sum(p) FROM scored), 6) AS share FROM scored GROUP BY y",
        "a11_fold_mean_logit": f"WITH {SCORED}, f AS (SELECT *, ntile(10) OVER (PARTITION BY y ORDER BY id) - 1 AS fold FROM scored) SELECT fold::INT AS fold, round(avg(ln(p / (1 - p))), 6) AS logit FROM f GROUP BY 1",
        "a9_entity_votes": f"WITH {TAGGED} SELECT word, ent_type, votes FROM votes",
        "w3_best_types": f"WITH {TAGGED} SELECT word, rank::INT AS rank, ent_type FROM ranked WHERE rank = 1 OR rank = 2 AND votes > 3",
        "j10_token_types": f"WITH {TAGGED} SELECT t.qid, t.pos, t.word, coalesce(r.ent_type, '') AS ent_type FROM tagged t LEFT JOIN ranked r ON r.word = t.word AND r.rank = 1",
        "a13_first_per_qid": f"WITH {PAIRS}, b AS (SELECT qid1 AS qid, question1 AS question, 1 AS side FROM pairs UNION ALL SELECT qid2, question2, 2 FROM pairs) SELECT qid, question FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY side, question) = 1",
        "w1_stratified_folds": f"WITH {SCORED}, f AS (SELECT *, ntile(10) OVER (PARTITION BY y ORDER BY id) - 1 AS fold FROM scored) SELECT y, fold::INT AS fold, count(*) AS rows, sum(id)::BIGINT AS ids FROM f GROUP BY 1, 2",
        "w4_id_gaps": "SELECT l_orderkey, previous FROM (SELECT l_orderkey, lag(l_orderkey, 1, -1) OVER (ORDER BY l_orderkey) AS previous FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE l_orderkey - previous > 1",
        "w5_false_positives": f"WITH {SCORED} SELECT id, y, p FROM scored WHERE y = 0 ORDER BY p DESC, id DESC LIMIT 100",
        "w5_false_negatives": f"WITH {SCORED} SELECT id, y, p FROM scored WHERE y = 1 ORDER BY p, id LIMIT 100",
        "w7_holdout": p + "id FROM pairs WHERE ('0x' || left(md5((id + 31)::VARCHAR), 8))::BIGINT % 100 = 0",
        "u1_union_all": p + "id, question1, NULL::INT AS is_duplicate FROM pairs UNION ALL SELECT id, NULL, is_duplicate FROM pairs",
        "u2_union_distinct": p + "question1 AS question FROM pairs UNION SELECT question2 FROM pairs",
        "c1_clean": f"WITH {TOK}, qs AS (SELECT id, 1 AS side, q1w AS qw FROM tok UNION ALL SELECT id, 2, q2w FROM tok) SELECT id, side, {_clean()} AS cleaned FROM qs",
        "c4_lower_starts": f"WITH {_STARTS} SELECT id, side, cleaned FROM ls",
        "c3_rules": f"WITH {_STARTS} SELECT id, side, {_ruled()} AS cleaned FROM ls",
        "c7_collapse_spaces": f"WITH {SIDES} SELECT id, side, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS cleaned FROM qs",
        "n2_n3_word_combine": f"WITH {TOK} SELECT id, (len(s1) + len(s2) - 2 * len(list_intersect(s1, s2)))::BIGINT AS diff_terms, len(list_intersect(s1, s2))::BIGINT AS shared_terms FROM tok",
        "n8_n9_trigram_tfidf": f"""WITH {_grams(3)}, n AS (SELECT 2 * count(*) AS n FROM pairs),
x AS (SELECT id, a * (ln((1 + n.n) / (1 + df)) + 1) AS x, b * (ln((1 + n.n) / (1 + df)) + 1) AS y FROM ab, n),
s AS (SELECT id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM x GROUP BY id)
SELECT id, round(CASE WHEN xx > 0 AND yy > 0 THEN 1 - xy / sqrt(xx * yy) ELSE 0 END, 6)::DOUBLE AS cosine,
  round(CASE WHEN xx > 0 AND yy > 0 THEN sqrt(greatest(2 - 2 * xy / sqrt(xx * yy), 0)) ELSE 1 END, 6)::DOUBLE AS euclidean FROM s""",
        "d2_distances": f"""WITH {VECS} SELECT vec_id, round(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine,
  round(list_sum(list_transform(d, lambda x: abs(x))), 6) AS cityblock, round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) AS euclidean,
  round(pow(list_sum(list_transform(d, lambda x: pow(abs(x), 3))), 1.0 / 3), 6) AS minkowski,
  round(list_sum(list_transform(list_zip(a, b), lambda t: coalesce(abs(t[1] - t[2]) / nullif(abs(t[1]) + abs(t[2]), 0), 0))), 6) AS canberra,
  round(list_sum(list_transform(d, lambda x: abs(x))) / list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1] + t[2]))), 6) AS braycurtis FROM z""",
        "d4_moments": f"""WITH {VECS}, m AS (SELECT vec_id, a, list_avg(a) AS mu FROM v), c AS (SELECT vec_id, list_avg(list_transform(a, lambda x: pow(x - mu, 2))) AS m2,
  list_avg(list_transform(a, lambda x: pow(x - mu, 3))) AS m3, list_avg(list_transform(a, lambda x: pow(x - mu, 4))) AS m4 FROM m)
SELECT vec_id, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM c""",
        "d7_normalized": f"WITH {VECS} SELECT vec_id, round(sqrt(list_sum(list_transform(a, lambda x: pow(x / sqrt(list_dot_product(a, a)), 2)))), 6) AS norm, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first FROM v",
        "v3_squared_distance": f"WITH {VECS} SELECT vec_id, round(list_sum(list_transform(d, lambda x: x * x)), 6) AS value FROM z",
        "v5_symmetrized": f"WITH {VECS} SELECT vec_id, (2 * len(a))::BIGINT AS size, round(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] + t[2]) / 2)) + list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) / 2)), 6) AS total, round(list_sum(list_transform(list_zip(a, b), lambda t, i: i * (t[1] + t[2]) / 2)) + list_sum(list_transform(list_zip(a, b), lambda t, i: (i + len(a)) * (t[1] - t[2]) / 2)), 6) AS turned FROM v",
        "m1_logit": f"WITH {SCORED} SELECT id, round(ln(p / (1 - p)), 6) AS logit, round(0.5 * p / (0.5 * p + 2 * (1 - p)), 6)::DOUBLE AS rescaled FROM scored",
        "q1_log_loss": f"WITH {SCORED}, l AS (SELECT -(y * ln(p) + (1 - y) * ln(1 - p)) AS l, w FROM scored) SELECT 'plain' AS kind, round(avg(l), 6) AS log_loss FROM l UNION ALL SELECT 'weighted', round(sum(l * w) / sum(w), 6) FROM l",
        "q2_auc": f"""WITH {SCORED}, x AS (SELECT a.w * b.w AS w, CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END AS h FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0)
SELECT 'plain' AS kind, round(avg(h), 6)::DOUBLE AS auc FROM x UNION ALL SELECT 'weighted', round(sum(w * h) / sum(w), 6)::DOUBLE FROM x""",
        "q3_roc_curve": f"WITH {SCORED}, t AS (SELECT DISTINCT p FROM scored) SELECT t.p, round(sum((s.p >= t.p AND y = 1)::INT) / sum((y = 1)::INT), 6)::DOUBLE AS tpr, round(sum((s.p >= t.p AND y = 0)::INT) / sum((y = 0)::INT), 6)::DOUBLE AS fpr FROM t, scored s GROUP BY t.p",
        "q4_reliability": f"WITH {SCORED}, r AS (SELECT *, ((row_number() OVER (ORDER BY p, id) - 1) // ((SELECT count(*) FROM scored) // 20 + 1))::BIGINT AS bin FROM scored) SELECT bin, round(sum(p * w) / sum(w), 6) AS mean_p, round(sum(y * w) / sum(w), 6) AS mean_y, count(*) AS rows FROM r GROUP BY bin",
    }
    auc = "(SELECT avg(CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END) FROM (SELECT {0} AS v FROM feat WHERE y = 1) a, (SELECT {0} AS v FROM feat WHERE y = 0) b)"
    out |= {
        "p1_projection": p + "id, qid1, qid2, is_duplicate FROM pairs",
        "p2_drop": p + "id, qid1, is_duplicate FROM pairs",
        "p6_label_comprehension": f"WITH {SCORED} SELECT id, p FROM scored WHERE y = 0",
        "p8_gram_length_filter": f"WITH {_grams(2)} SELECT gram, df FROM voc",
        "p13_row_number_key": p + "id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS row FROM pairs",
        "j5_d1_sentence_vectors": f"""WITH {TOK}, wd AS (SELECT DISTINCT unnest(list_concat(q1w, q2w)) AS word FROM tok), rk AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS r FROM wd WHERE regexp_matches(word, '^[a-z]+$')),
vc AS (SELECT word, embedding FROM rk JOIN embeddings ON vec_id = r % (SELECT count(*) FROM embeddings)),
sd AS (SELECT id, 1 AS side, q1w AS w FROM tok UNION ALL SELECT id, 2, q2w FROM tok),
ex AS (SELECT id, side, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM (SELECT id, side, unnest(w) AS word FROM sd) JOIN vc USING (word)),
sm AS (SELECT id, side, k, sum(x) AS x FROM ex GROUP BY id, side, k), nm AS (SELECT id, side, sqrt(sum(x * x)) AS norm, sum(x) AS total, sum(x * (k + 1)) AS turned FROM sm GROUP BY id, side)
SELECT id, side, round(norm, 6) AS norm, round(total / nullif(norm, 0), 6) AS unit_total, round(turned / nullif(norm, 0), 6) AS unit_turned FROM sd LEFT JOIN nm USING (id, side)""",
        "d6_missing_defaults": f"WITH {VECS} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1.0::DOUBLE ELSE round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) END AS euclidean, CASE WHEN vec_id % 3 = 0 THEN 0.0::DOUBLE ELSE round(list_sum(a), 6) END AS total FROM z",
        "j9_prediction_text": f"WITH {SCORED}, t AS (SELECT id, p FROM scored WHERE y = 0 ORDER BY p DESC, id DESC LIMIT 20) SELECT t.id, t.p, length(text) AS length FROM t JOIN documents ON doc_id = t.id",
        "a12_row_sums": f"WITH {_grams(2)} SELECT id, side, sum(c)::BIGINT AS grams FROM g GROUP BY id, side",
        "u3_vertical_stack": f"WITH {TOK} SELECT id, 1 AS side, len(s1) AS terms FROM tok UNION ALL SELECT id, 2, len(s2) FROM tok",
        "u4_horizontal_stack": f"WITH {VECS} SELECT vec_id, len(list_concat(a, b)) AS size, round(list_sum(list_concat(a, b)), 6) AS total, round(list_sum(list_transform(list_concat(a, b), lambda x, i: x * i)), 6) AS turned FROM v",
        "v4_euclid_cosine": f"WITH {VECS} SELECT vec_id, round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 6) AS euclidean, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9), 6) AS cosine FROM z",
        "n7_tfidf_norms": f"WITH {_grams(3)}, n AS (SELECT 2 * count(*) AS n FROM pairs) SELECT id, side, round(sqrt(sum(pow(c * (ln((1 + n.n) / (1 + df)) + 1), 2))), 6) AS norm FROM g JOIN voc USING (gram), n GROUP BY id, side",
        "q6_feature_quality": f"WITH {feat} " + " UNION ALL ".join(f"SELECT '{k}' AS feature, round({auc.format(k)}, 6)::DOUBLE AS auc, round(corr(y, {k}), 6) AS corr FROM feat" for k in FIVE),
    }
    kinds = "CASE ent_type " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in ENTITY_WORDS.items()) + " END"
    lengths = ", ".join(rf"length(question{k}) AS len_q{k}, len(w{k}) AS len_word_q{k}, length(regexp_replace(question{k}, '\s.', '', 'g')) AS len_char_q{k}" for k in "12")
    out |= {
        "l1_l2_l3_lengths": f"WITH {TOK} SELECT id, {lengths} FROM tok",
        "p10_constant_columns": p + "id AS test_id, -1 AS qid1, -1 AS qid2 FROM pairs",
        "p4_multi_output": f"WITH {TOK} SELECT id, ({f['b3_common_words']})::BIGINT AS common, ({f['b4_total_unique_words']})::BIGINT AS either FROM tok",
        "j2_concat_columns": f"WITH {TOK} SELECT id, len(s1) || ',' || len(s2) AS row FROM tok",
        "w6_sorted_scores": f"WITH {SCORED} SELECT id, p, row_number() OVER (ORDER BY p, id) - 1 AS rank FROM scored",
        "n1_char_counts": f"WITH {_grams(2)} SELECT id, side, gram, c AS count FROM g JOIN voc USING (gram)",
        "n4_stacked_counts": f"WITH {TOK} SELECT id, side, term, count(*) AS count FROM (SELECT id, 1 AS side, unnest(q1w) AS term FROM tok UNION ALL SELECT id, 2, unnest(q2w) FROM tok) GROUP BY ALL",
        "c8_entity_words": f"WITH {TAGGED} SELECT qid, pos, {kinds} AS entity, ent_type IN ({', '.join(map(_quoted, sorted(NUMERIC)))}) AS numeric FROM tagged",
    }
    for n, name in ((1, "n5_n6_unigram_jaccard"), (2, "n5_n6_bigram_jaccard"), (3, "n5_n6_trigram_jaccard")):
        out[name] = f"WITH {_grams(n)} SELECT id, round(sum(least(a, b)) / sum(a + b), 6)::DOUBLE AS all_jaccard, round(sum(least(a, b)) / sum(greatest(a, b)), 6)::DOUBLE AS jaccard_max FROM ab GROUP BY id"
    return out
