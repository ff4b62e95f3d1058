"""DuckDB SQL of the queries, on views of the driver tables."""

from __future__ import annotations

from foliospark.functions import tokens
from foliospark.functions.scalars import PARTS_OF_SPEECH
from foliospark.plans.queries import ASKED, FIRST, STOP, TAGGED, THESAURUS, WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _split(column: str, delimiters: str) -> str:
    seen = "".join(dict.fromkeys(delimiters))
    return f"list_filter(string_split(translate({column}, {_text(seen)}, {_text(' ' * len(seen))}), ' '), lambda t: t <> '')"


def _exploded(table: str, key: str, column: str, delimiters: str) -> str:
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, l[i] AS token FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, {_split(column, delimiters)} AS l FROM {table}))"


def _values(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) v({names}))"


_STOP = ", ".join(_text(w) for w in STOP)
_TOKENS = f"SELECT doc_id, unnest({_split('text', tokens.TITLE)}) AS token FROM documents"
POSTINGS = f"post AS (SELECT lower(token) AS term, doc_id, count(*) AS tf FROM ({_TOKENS}) GROUP BY ALL)"
INDEX = f"""{POSTINGS},
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lens AS (SELECT d.doc_id, coalesce(sum(p.tf), 0)::BIGINT AS token_count, max(p.tf) AS max_tf FROM documents d LEFT JOIN post p USING (doc_id) GROUP BY d.doc_id),
meta AS (SELECT count(*)::DOUBLE AS n, sum(token_count) / count(*) AS avgdl FROM lens),
wts AS (SELECT doc_id, sqrt(sum(pow(tf * (ln(n) - ln(df)), 2))) / max(tf) AS vsm_weight FROM post JOIN vocab USING (term) CROSS JOIN meta GROUP BY doc_id),
ranks AS (SELECT doc_id, 1.0::DOUBLE / (doc_id % 97 + 1) / (SELECT n FROM meta) AS pagerank FROM documents)"""


def _terms(rows=ASKED) -> str:
    """Query terms with df and idf, merged."""
    return f"""q AS (SELECT a.query_id, a.term, a.weight, coalesce(df, 0) AS df, ln(n / (1 + coalesce(df, 0))) AS idf
FROM (SELECT query_id, term, sum(weight) AS weight FROM {rows if isinstance(rows, str) else _values(rows, 'query_id, pos, term, weight')} GROUP BY ALL) a LEFT JOIN vocab USING (term) CROSS JOIN meta)"""


BM25 = """bm25 AS (SELECT p.query_id, doc_id, part + c AS score FROM
(SELECT query_id, doc_id, sum(idf * (tf * weight * 3.0 / (tf * weight + 2.0 * (0.25 + 0.75 * token_count / avgdl)))) AS part FROM post JOIN q USING (term) JOIN lens USING (doc_id) CROSS JOIN meta GROUP BY ALL) p
JOIN (SELECT query_id, sum(idf) AS c FROM q GROUP BY ALL) USING (query_id))"""
VSM = """vec AS (SELECT query_id, term, weight / max(weight) OVER (PARTITION BY query_id) * idf AS qw FROM q),
norms AS (SELECT query_id, sqrt(sum(qw * qw)) AS norm FROM vec GROUP BY ALL),
vsm AS (SELECT query_id, doc_id, CASE WHEN vsm_weight * norm = 0 THEN 'nan'::DOUBLE ELSE dot / (vsm_weight * norm) END AS score FROM
(SELECT q.query_id, doc_id, sum(qw * (tf * weight / max_tf) * idf) AS dot FROM post JOIN q USING (term) JOIN vec ON vec.query_id = q.query_id AND vec.term = q.term JOIN lens USING (doc_id) GROUP BY ALL) JOIN norms USING (query_id) JOIN wts USING (doc_id))"""


def _normal(model: str, out: str = "scored") -> str:
    return f"""{out} AS (SELECT s.query_id, doc_id, score / best AS score FROM {model} s JOIN
(SELECT query_id, CASE WHEN greatest(max(score) FILTER (WHERE NOT isnan(score)), 0) = 0 THEN 1 ELSE greatest(max(score) FILTER (WHERE NOT isnan(score)), 0) END AS best FROM {model} GROUP BY ALL) USING (query_id))"""


def _blend(source: str, weight: float, out: str) -> str:
    if not weight:
        return f"{out} AS (SELECT * FROM {source})"
    return f"""{out} AS (SELECT query_id, doc_id, score * {1 - weight} + pagerank / max(pagerank) OVER (PARTITION BY query_id) * {weight} AS score FROM {source} JOIN ranks USING (doc_id))"""


def _top(source: str, k: int | None, out: str = "ranked") -> str:
    limit = f" QUALIFY rank <= {k}" if k else ""
    return f"{out} AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM {source}){limit})"


def _search(model: str, k: int | None, rows=ASKED, weight: float = 0.0) -> str:
    return f"WITH {INDEX}, {_terms(rows)}, {BM25 if model == 'bm25' else VSM}, {_normal(model)}, {_blend('scored', weight, 'mixed')}, {_top('mixed', k)}"


_JUDGED = f"judged AS (SELECT a.query_id, doc_id, quality AS relevance FROM labels CROSS JOIN (SELECT DISTINCT query_id FROM {_values(ASKED, 'query_id, pos, term, weight')}) a)"
_TOTAL = "total AS (SELECT query_id, sum(CASE WHEN relevance = 1 THEN 1 ELSE 0 END)::BIGINT AS relevant FROM judged GROUP BY ALL)"


def _metrics(source: str, out: str) -> str:
    return f"""{out} AS (SELECT t.query_id, CASE WHEN relevant = 0 THEN 'nan'::DOUBLE ELSE coalesce(precision, 0) / relevant END AS avep,
CASE WHEN relevant = 0 THEN 'nan'::DOUBLE ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, relevant + 1), lambda i: ln(2) / ln(i + 1))) END AS ndcg FROM total t LEFT JOIN
(SELECT query_id, sum(found / place) FILTER (WHERE rel = 1) AS precision, sum(ln(2) / ln(place + 1)) FILTER (WHERE rel = 1) AS dcg FROM
(SELECT query_id, rel, place, sum(rel) OVER (PARTITION BY query_id ORDER BY place) AS found FROM
(SELECT r.query_id, CASE WHEN relevance = 1 THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, r.doc_id) AS place FROM {source} r JOIN judged j ON j.query_id = r.query_id AND j.doc_id = r.doc_id)) GROUP BY ALL) m USING (query_id))"""


_EVAL = f"{_search('vsm', None)}, {_JUDGED}, {_TOTAL}, {_metrics('ranked', 'metric')}"

LINES = """lines AS (SELECT l_orderkey, l_partkey AS id, lead(l_partkey) OVER w AS other, l_returnflag, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)),
outs AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, k) - 1 AS pos, other FROM lines WHERE l_returnflag = 'R' AND other IS NOT NULL),
ins AS (SELECT other AS id, row_number() OVER (PARTITION BY other ORDER BY id, pos) - 1 AS pos, id AS other FROM outs WHERE id % 7 <> 0),
nodes AS (SELECT p_partkey AS id FROM part), few AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25),
edges AS (SELECT DISTINCT id AS src, other AS dst FROM outs WHERE id <> other AND other IN (SELECT id FROM nodes) AND id IN (SELECT id FROM nodes))"""


def _degrees(lists: str, out: str) -> str:
    return f"""{out} AS (SELECT n.id, coalesce(r, 0)::BIGINT AS raw, (coalesce(r, 0) - coalesce(l, 0) - coalesce(p, 0))::BIGINT AS true_, coalesce(l, 0)::BIGINT AS loops, coalesce(p, 0)::BIGINT AS repeats FROM nodes n LEFT JOIN
(SELECT id, count(*) AS r, sum((id = other)::INT) AS l, sum((id <> other AND nth > 1)::INT) AS p FROM (SELECT id, other, row_number() OVER (PARTITION BY id, other ORDER BY pos) AS nth FROM {lists} WHERE other IN (SELECT id FROM nodes)) GROUP BY id) USING (id))"""


def _histogram(lists: str, column: str) -> str:
    return f"WITH {LINES}, {_degrees(lists, 'deg')} SELECT {column} AS degree, count(*) AS documents FROM deg GROUP BY ALL"


def _pagerank(rounds: int, threshold: float | None = None) -> str:
    """So many rounds; with a threshold, scores stay as they are once no score has moved by more than that."""
    stop = [f"(SELECT max(moved) FROM pr{i}) <= {threshold}" if threshold and i else "false" for i in range(rounds)]
    steps = ["pr0 AS (SELECT n.id, coalesce(d, 0) AS degree, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS pr, 0.0::DOUBLE AS moved FROM nodes n LEFT JOIN (SELECT src AS id, count(*) AS d FROM edges GROUP BY src) USING (id))"]
    for i in range(rounds):
        steps.append(
            f"pr{i + 1} AS MATERIALIZED (SELECT id, degree, CASE WHEN {stop[i]} THEN old ELSE new END AS pr, CASE WHEN {stop[i]} THEN 0 ELSE abs(new - old) END AS moved FROM "
            f"(SELECT p.id, p.degree, p.pr AS old, 0.85 * ((SELECT coalesce(sum(pr), 0) FROM pr{i} WHERE degree = 0) / (SELECT count(*) FROM nodes) + coalesce(g, 0)) + 0.15 / (SELECT count(*) FROM nodes) AS new FROM pr{i} p "
            f"LEFT JOIN (SELECT dst AS id, sum(pr / degree) AS g FROM edges JOIN pr{i} s ON s.id = src GROUP BY dst) USING (id)))"
        )
    return f"WITH {LINES}, {', '.join(steps)} SELECT id, round(pr, 10) AS pagerank FROM pr{rounds}"


# The suffixes of the published algorithm, written down here once more so that each copy tests the other.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# stems: `w` is the word so far, `s` its letters as c and v

_SHAPE = "list_reduce(list_prepend('', string_split(w, '')), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR x = 'y' AND a <> '' AND right(a, 1) = 'c' THEN 'v' ELSE 'c' END)"
_DOUBLE = "(length(w) > 1 AND right(w, 1) = w[-2:-2] AND right(s, 1) = 'c')"


def _m(cut: int) -> str:
    """The measure of the word without its last letters."""
    return f"len(regexp_extract_all(left(s, length(w) - {cut}), 'v+c+'))"


def _cvc(cut: int) -> str:
    return f"(length(w) - {cut} > 2 AND right(left(s, length(w) - {cut}), 3) = 'cvc' AND right(left(w, length(w) - {cut}), 1) NOT IN ('w', 'x', 'y'))"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _swapped(table, least: int, more: str = "true") -> str:
    parts = (f"WHEN ends_with(w, '{end}') THEN CASE WHEN {_m(len(end))} > {least} AND {more if end == 'ion' else 'true'} THEN {_cut(len(end))} || '{new}' ELSE w END" for end, new in sorted(table, key=lambda x: -len(x[0])))
    return f"CASE {' '.join(parts)} ELSE w END"


def _stems(source: str) -> str:
    """CTEs; the last, stems, has (token, term): every distinct token of `source` and its stem in lower case."""
    st = f"right({_cut(3)}, 1) IN ('s', 't')"
    ed, ing = (f"(NOT ends_with(w, 'eed') AND ends_with(w, '{e}') AND contains(left(s, length(w) - {len(e)}), 'v'))" for e in ("ed", "ing"))
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1)} ELSE w END AS w",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m(3)} > 0 THEN {_cut(1)} ELSE w END WHEN {ed} THEN {_cut(2)} WHEN {ing} THEN {_cut(3)} ELSE w END AS w, {ed} OR {ing} AS was",
        f"CASE WHEN NOT was THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' WHEN {_DOUBLE} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_cut(1)} WHEN {_m(0)} = 1 AND {_cvc(0)} THEN w || 'e' ELSE w END AS w",
        f"CASE WHEN ends_with(w, 'y') AND contains(left(s, length(w) - 1), 'v') THEN {_cut(1)} || 'i' ELSE w END AS w",
        f"{_swapped(STEP2, 0)} AS w",
        f"{_swapped(STEP3, 0)} AS w",
        f"{_swapped([(e, '') for e in STEP4], 1, st)} AS w",
        f"CASE WHEN ends_with(w, 'e') AND ({_m(1)} > 1 OR {_m(1)} = 1 AND NOT {_cvc(1)}) THEN {_cut(1)} ELSE w END AS w",
        f"CASE WHEN {_m(0)} > 1 AND {_DOUBLE} AND right(w, 1) = 'l' THEN {_cut(1)} ELSE w END AS w",
    ]
    out = [f"p0 AS (SELECT DISTINCT token, token AS w, false AS was FROM ({source}))"]
    for i, step in enumerate(steps):
        was = "" if " AS was" in step else ", was"
        out.append(f"p{i + 1} AS (SELECT token, {step}{was} FROM (SELECT *, {_SHAPE} AS s FROM p{i}))")
    return ", ".join(out) + f", stems AS (SELECT token, lower(CASE WHEN length(token) > 3 AND length(w) >= 3 THEN w ELSE token END) AS term FROM p{len(steps)})"


_COUNTERS = """SELECT count(*) AS documents, sum((o.raw = 0)::INT)::BIGINT AS sinks, sum((o.true_ = 0)::INT)::BIGINT AS sinks_true, sum(i.true_)::BIGINT AS in_edges_true, sum(i.raw)::BIGINT AS in_edges, sum(o.true_)::BIGINT AS out_edges_true, sum(o.raw)::BIGINT AS out_edges,
sum(i.repeats)::BIGINT AS duplicate_in_edges, sum((i.repeats > 0)::INT)::BIGINT AS docs_duplicate_in, sum(o.repeats)::BIGINT AS duplicate_out_edges, sum((o.repeats > 0)::INT)::BIGINT AS docs_duplicate_out,
sum((i.loops > 0)::INT)::BIGINT AS docs_self_in, sum(i.loops)::BIGINT AS self_in_edges, sum((o.loops > 0)::INT)::BIGINT AS docs_self_out, sum(o.loops)::BIGINT AS self_out_edges,
(SELECT count(*) FROM outs x WHERE other IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM ins y WHERE y.id = x.other AND y.other = x.id)) AS inconsistent_in_edges,
(SELECT count(*) FROM ins x WHERE other IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM outs y WHERE y.id = x.other AND y.other = x.id)) AS inconsistent_out_edges
FROM o JOIN i USING (id)"""

_NEAR = "SELECT w.vec_id AS word, v.vec_id AS near, CAST(row_number() OVER (PARTITION BY w.vec_id ORDER BY {sim} DESC, v.vec_id) AS INTEGER) AS rank, {sim} AS similarity FROM embeddings w JOIN embeddings v ON v.vec_id <> w.vec_id WHERE {where} QUALIFY rank <= 3"
_SIM = "list_cosine_similarity(w.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_CLASS = "CASE " + " ".join(f"WHEN tag IN ({', '.join(_text(t) for t in tags)}) THEN {_text(name)}" for name, tags in PARTS_OF_SPEECH.items()) + " END"
_BENCH_TOKENS = f"SELECT item_id AS query_id, pos, token FROM ({_exploded('benchmark', 'item_id', 'text', tokens.QUERY)})"


def _wordnet(tagged: str, thesaurus: str) -> str:
    """CTEs; the last, cands, has the candidates."""
    return f"""kept AS (SELECT *, {_CLASS} AS class FROM {tagged} WHERE lower(token) NOT IN ({_STOP})),
th AS (SELECT *, row_number() OVER (PARTITION BY pos, lemma, sense ORDER BY rank) AS n FROM {thesaurus} WHERE lower(word) NOT IN ({_STOP}) QUALIFY n <= 3),
cands AS (SELECT query_id, pos, 0 AS cand, token AS term, 1.0::DOUBLE AS weight FROM kept UNION ALL
SELECT query_id, kept.pos, CAST(row_number() OVER (PARTITION BY query_id, kept.pos ORDER BY sense, n) AS INTEGER), word, 0.5::DOUBLE FROM kept JOIN th ON th.pos = class AND lemma = token)"""


_FEW_WORDNET = _wordnet(_values(TAGGED, "query_id, pos, token, tag"), _values(THESAURUS, "pos, lemma, sense, rank, word"))
_WORDNET = f"tok AS MATERIALIZED ({_BENCH_TOKENS}), " + _wordnet(
    "(SELECT *, ['NN', 'VBD', 'JJ', 'RB', 'IN'][length(token) % 5 + 1] AS tag FROM tok)",
    """(SELECT ['noun', 'verb', 'adjective', 'adverb'][length(lemma) % 4 + 1] AS pos, lemma, sense, tok.pos - a AS rank, token AS word
FROM (SELECT query_id, pos AS a, token AS lemma, row_number() OVER (PARTITION BY token ORDER BY query_id, pos) AS sense FROM tok WHERE pos < 4) JOIN tok USING (query_id) WHERE tok.pos > a AND tok.pos <= a + 5)""",
)
_CAPPED = f"""SELECT query_id, CAST(pos * 2 + m - 1 AS INTEGER) AS pos, lower(term) AS term, weight FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY cand) AS m FROM
(SELECT *, first_value(lower(term)) OVER w AS head, row_number() OVER w AS n FROM cands WHERE lower(term) NOT IN ({_STOP}) AND NOT contains(term, ' ') WINDOW w AS (PARTITION BY query_id, pos ORDER BY cand)) WHERE n = 1 OR term <> head) WHERE m <= 2"""
_BENCH = f"SELECT item_id AS query_id, 0 AS pos, lower(token) AS term, 1.0::DOUBLE AS weight FROM ({_exploded('benchmark', 'item_id', 'text', tokens.QUERY)}) WHERE lower(token) NOT IN ({_STOP})"
_H, _M, _S, _MS = "3600000000000", "60000000000", "1000000000::BIGINT", "1000000::BIGINT"


def _half(x: str, digits: int = 0) -> str:
    return f"CAST(CAST(floor({x} * {10**digits} + 0.5) / {10**digits} AS {'DOUBLE' if digits else 'BIGINT'}) AS VARCHAR)"


_DURATION = f"""CASE WHEN ns > {_H} THEN CAST(ns // {_H} AS VARCHAR) || 'h ' || {_half(f'(ns % {_H} / {_M})')} || 'm' WHEN ns > {_M} THEN CAST(ns // {_M} AS VARCHAR) || 'm ' || {_half(f'(ns % {_M} / {_S})')} || 's'
WHEN ns > 20 * {_S} THEN {_half(f'(ns / {_S})')} || 's' WHEN ns > 2 * {_S} THEN {_half(f'(ns / {_S})', 1)} || 's' WHEN ns > 100 * {_MS} THEN {_half(f'(ns / {_S})', 2)} || 's'
WHEN ns > 20 * {_MS} THEN {_half(f'(ns / {_MS})')} || 'ms' WHEN ns > 2 * {_MS} THEN {_half(f'(ns / {_MS})', 1)} || 'ms' ELSE {_half(f'(ns / {_MS})', 2)} || 'ms' END"""

_GRID = [("vsm", 0.0), ("vsm", 0.25), ("bm25", 0.0), ("bm25", 0.25)]
_GRID_PARTS = ", ".join(f"{_blend('s_' + m, w, f'b{i}')}, {_top(f'b{i}', None, f'r{i}')}, {_metrics(f'r{i}', f'm{i}')}" for i, (m, w) in enumerate(_GRID))
_GLOVE = f"""kept AS (SELECT query_id, pos, term AS token FROM {_values(ASKED, 'query_id, pos, term, weight')} WHERE lower(term) NOT IN ({_STOP})),
named AS (SELECT coalesce(word, 'w' || vec_id) AS word, embedding::DOUBLE[] AS e FROM embeddings LEFT JOIN (SELECT unnest({list(WORDS)}) AS word, unnest(range({len(WORDS)})) AS vec_id) USING (vec_id)),
near AS (SELECT a.word, b.word AS other, row_number() OVER (PARTITION BY a.word ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.word) AS rank FROM named a JOIN named b ON a.word <> b.word WHERE a.word IN (SELECT token FROM kept) QUALIFY rank <= 3),
cands AS (SELECT query_id, pos, 0 AS cand, token AS term, 1.0::DOUBLE AS weight FROM kept UNION ALL SELECT query_id, pos, rank, other, 0.5::DOUBLE FROM kept JOIN near ON word = token WHERE lower(other) NOT IN ({_STOP}))"""


def _grid(name: str, wanted: str) -> str:
    """Four runs of one expansion, whose terms are `wanted`."""
    runs = " UNION ALL ".join(f"SELECT '{name}' AS expansion, '{'okapi' if m == 'bm25' else m}' AS model, {w}::DOUBLE AS pagerank_weight, query_id, round(avep, 9) AS avep, round(ndcg, 9) AS ndcg FROM m{i}" for i, (m, w) in enumerate(_GRID))
    return f"SELECT * FROM (WITH {wanted}{INDEX}, {_terms('wanted') if wanted else _terms()}, {VSM}, {BM25}, {_normal('vsm', 's_vsm')}, {_normal('bm25', 's_bm25')}, {_JUDGED}, {_TOTAL}, {_GRID_PARTS} {runs})"


def _said(ns: str) -> str:
    return _DURATION.replace("ns ", f"{ns} ").replace("(ns", f"({ns}").replace("CAST(ns", f"CAST({ns}")


_F4 = "CASE WHEN isnan({0}) THEN 'NaN' ELSE CAST(round({0}, 4) AS VARCHAR) END"
_REPORT = f"""WITH r AS (SELECT o_orderkey::VARCHAR AS query, o_orderkey::BIGINT AS place, round(o_totalprice * 1000)::BIGINT AS ns, o_custkey AS results,
CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 97 + 1) / 128 END AS avep, CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 31 + 1) / 32 END AS ndcg FROM orders),
a AS (SELECT sum(ns)::BIGINT AS total, sum(ns)::BIGINT // count(*) AS mean, least(sum(results)::BIGINT, 1000000) AS rate, sum(ns)::BIGINT // sum(results)::BIGINT * least(sum(results)::BIGINT, 1000000) AS per_rate, min(ns) AS least, max(ns) AS most,
(SELECT query FROM r ORDER BY ns, query LIMIT 1) AS quickest, (SELECT query FROM r ORDER BY ns DESC, query DESC LIMIT 1) AS slowest FROM r),
f AS (SELECT * FROM r WHERE NOT isnan(avep)),
l AS (SELECT 0 AS section, 0::BIGINT AS place, ['-> Evaluation options:', 'Retrieval model: Okapi BM25+', 'Query expansion: none', 'Pagerank weight (documents): 0.25', ''] AS lines
UNION ALL SELECT 1, place, ['Query: ' || query, 'Search time: ' || {_said('ns')}, 'Results: ' || results, 'Average precision: ' || {_F4.format('avep')}, 'nDCG: ' || {_F4.format('ndcg')}, ''] FROM r
UNION ALL SELECT 2, 0, ['------------------------------------------------', '-> Summary', '', '[Average precision]', 'Average: ' || {_F4.format('avg(avep)')}, 'Min: ' || {_F4.format('min(avep)')}, 'Max: ' || {_F4.format('max(avep)')}, ''] FROM f
UNION ALL SELECT 3, 0, ['[nDCG]', 'Average: ' || {_F4.format('avg(ndcg)')}, 'Min: ' || {_F4.format('min(ndcg)')}, 'Max: ' || {_F4.format('max(ndcg)')}, ''] FROM f
UNION ALL SELECT 4, 0, ['-> Search time', 'Total: ' || {_said('total')}, 'Average per query: ' || {_said('mean')}, 'Average per ' || rate || ' results: ' || {_said('per_rate')}, 'Min: ' || {_said('least')} || ' for query: ' || quickest, 'Max: ' || {_said('most')} || ' for query: ' || slowest, '', '-> Total time: 1m 30s'] FROM a)
SELECT section, place, CAST(i - 1 AS INTEGER) AS n, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)"""
_SESSION = f"SELECT query_id, 0 AS pos, lower(unnest({_split('query', tokens.QUERY)})) AS term, 1.0::DOUBLE AS weight FROM (VALUES (1, 'thing, erble (zzzz)'), (2, 'de la')) v(query_id, query)"

SQL: dict[str, str] = {
    "tokenize_abstract": _exploded("documents", "doc_id", "text", tokens.TITLE),
    "tokenize_authors": _exploded("customer", "c_custkey", "c_name", tokens.AUTHORS),
    "tokenize_venue": _exploded("supplier", "s_suppkey", "s_name", tokens.VENUE),
    "tokenize_journal": _exploded("part", "p_partkey", "p_name", tokens.JOURNAL),
    "tokenize_entities": _exploded("part", "p_partkey", "p_type", tokens.ENTITIES),
    "tokenize_default": _exploded("documents", "doc_id", "source", tokens.PLAIN),
    "tokenize_query": _exploded("benchmark", "item_id", "text", tokens.QUERY),
    "stopword_filter": f"SELECT lower(token) AS term, count(*) AS n FROM ({_TOKENS}) WHERE lower(token) NOT IN ({_STOP}) GROUP BY ALL",
    "stem_terms": f"WITH {_stems(_TOKENS)} SELECT token, term FROM stems",
    "term_pipeline": f"WITH {_stems(_TOKENS)} SELECT term, doc_id, count(*) AS tf FROM ({_TOKENS}) JOIN stems USING (token) WHERE lower(token) NOT IN ({_STOP}) GROUP BY ALL",
    "query_terms": f"SELECT item_id AS query_id, pos, lower(token) AS term, 1.0::DOUBLE AS weight FROM ({_exploded('benchmark', 'item_id', 'text', tokens.QUERY)}) WHERE lower(token) NOT IN ({_STOP})",
    "index_fields": f"SELECT lower(token) AS term, doc_id, count(*) AS tf FROM ({_TOKENS} UNION ALL SELECT doc_id, unnest({_split('lang', tokens.PLAIN)}) FROM documents UNION ALL SELECT doc_id, unnest({_split('source', tokens.PLAIN)}) FROM documents) GROUP BY ALL",
    "term_frequency": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM post",
    "merged_postings": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM post",
    "merged_vocabulary": f"WITH {INDEX} SELECT term, df FROM vocab",
    "merged_stats": f"WITH {INDEX} SELECT d.doc_id, token_count, max_tf, round(vsm_weight, 9) AS vsm_weight FROM documents d LEFT JOIN lens USING (doc_id) LEFT JOIN wts USING (doc_id)",
    "merged_topk": f"{_search('bm25', 10, f'({_BENCH})')} SELECT query_id, doc_id, score, rank FROM ranked",
    "postings_blocks": f"WITH {POSTINGS} SELECT term, count(*) AS df, true AS bounded, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post GROUP BY term",
    "doc_length": f"WITH {INDEX} SELECT doc_id, token_count FROM lens",
    "document_frequency": f"WITH {INDEX} SELECT term, df FROM vocab",
    "index_meta": f"WITH {INDEX} SELECT n::BIGINT AS documents, round(avgdl, 9) AS avgdl FROM meta",
    "max_tf": f"WITH {INDEX} SELECT doc_id, max_tf FROM lens",
    "vsm_doc_weight": f"WITH {INDEX} SELECT d.doc_id, round(vsm_weight, 9) AS vsm_weight FROM documents d LEFT JOIN wts USING (doc_id)",
    "postings_list": f"WITH {POSTINGS} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM post GROUP BY term",
    "postings_offset": f"WITH {INDEX} SELECT term, df, CAST(coalesce(sum(df * 8) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM vocab",
    "vocabulary_sorted": f"WITH {INDEX} SELECT term, df FROM vocab",
    "vocabulary_ranked": f"WITH {INDEX} SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS place FROM vocab",
    "merge_query_terms": f"SELECT query_id, lower(token) AS term, count(*)::DOUBLE AS weight, min(pos) AS pos FROM ({_BENCH_TOKENS}) WHERE lower(token) NOT IN ({_STOP}) GROUP BY ALL",
    "query_df_lookup": f"WITH {INDEX}, {_terms()} SELECT query_id, term, df FROM q",
    "postings_lookup": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM post WHERE term IN ('thing', 'erble', 'zzzz')",
    "existential": f"WITH {INDEX}, {_terms()} SELECT DISTINCT query_id, doc_id, 1.0::DOUBLE AS score FROM post JOIN q USING (term)",
    "vsm_scores": f"WITH {INDEX}, {_terms()}, {VSM}, {_normal('vsm')} SELECT query_id, doc_id, round(score, 9) AS score FROM scored",
    "vsm_topk": f"{_search('vsm', 10)} SELECT query_id, doc_id, score, rank FROM ranked",
    "bm25_scores": f"WITH {INDEX}, {_terms()}, {BM25}, {_normal('bm25')} SELECT query_id, doc_id, round(score, 9) AS score FROM scored",
    "bm25_top10": f"{_search('bm25', 10, FIRST)} SELECT doc_id, score, rank FROM ranked",
    "total_results": f"WITH {INDEX}, {_terms()} SELECT query_id, count(DISTINCT doc_id) AS total FROM post JOIN q USING (term) GROUP BY ALL",
    "pagerank_blend": f"{_search('bm25', 20, ASKED, 0.25)} SELECT query_id, doc_id, score, rank FROM ranked",
    "late_projection": f"{_search('bm25', 10)} SELECT query_id, rank, doc_id, lang, source, n_chars FROM ranked JOIN documents USING (doc_id)",
    "result_range": f"{_search('bm25', 12)} SELECT query_id, doc_id, rank FROM ranked WHERE rank - 1 BETWEEN 5 AND 20",
    "batch_topk": f"{_search('bm25', 10, f'({_BENCH})')} SELECT query_id, doc_id, score, rank FROM ranked",
    "citation_edges": f"WITH {LINES} SELECT src, dst FROM edges",
    "pagerank_10": _pagerank(10),
    "pagerank_converged": _pagerank(60, 1e-8),
    "out_degree": f"WITH {LINES} SELECT src AS id, count(*) AS degree FROM edges GROUP BY ALL",
    "degree_hist_out": _histogram("outs", "raw"),
    "degree_hist_out_true": _histogram("outs", "true_"),
    "degree_hist_in": _histogram("ins", "raw"),
    "degree_hist_in_true": _histogram("ins", "true_"),
    "edge_stats": f"WITH {LINES}, {_degrees('outs', 'o')}, {_degrees('ins', 'i')} {_COUNTERS}",
    "inconsistent_edges": f"WITH {LINES} SELECT id, other FROM outs x WHERE other IN (SELECT id FROM nodes) AND NOT EXISTS (SELECT 1 FROM ins y WHERE y.id = x.other AND y.other = x.id)",
    "not_found_stats": f"WITH {LINES}, si AS (SELECT DISTINCT id, other FROM ins WHERE id IN (SELECT id FROM few) AND other NOT IN (SELECT id FROM few)), so AS (SELECT DISTINCT id, other FROM outs WHERE id IN (SELECT id FROM few) AND other NOT IN (SELECT id FROM few)) SELECT (SELECT count(*) FROM few) AS documents, (SELECT count(*) FROM si) AS total_in, (SELECT count(DISTINCT other) FROM si) AS unique_in, (SELECT count(*) FROM so) AS total_out, (SELECT count(DISTINCT other) FROM so) AS unique_out",
    "not_found_hist": f"WITH {LINES}, m AS (SELECT f.id, count(DISTINCT x.other) AS missing FROM few f LEFT JOIN (SELECT * FROM outs WHERE other NOT IN (SELECT id FROM few)) x USING (id) GROUP BY ALL) SELECT missing AS degree, count(*) AS documents FROM m GROUP BY ALL",
    "adjacency_dump": f"WITH {LINES} SELECT n.id, coalesce(string_agg(x.other::VARCHAR, ' ' ORDER BY x.pos), '') AS line FROM nodes n LEFT JOIN (SELECT * FROM outs WHERE other IN (SELECT id FROM nodes)) x USING (id) GROUP BY n.id",
    "average_precision": f"{_EVAL} SELECT query_id, round(avep, 9) AS avep FROM metric",
    "ndcg": f"{_EVAL} SELECT query_id, round(ndcg, 9) AS ndcg FROM metric",
    "eval_summary": f"{_EVAL} SELECT metric, round(avg(v), 9) AS average, round(min(v), 9) AS least, round(max(v), 9) AS most FROM (SELECT 'avep' AS metric, avep AS v FROM metric UNION ALL SELECT 'ndcg', ndcg FROM metric) WHERE isfinite(v) GROUP BY metric",
    "eval_grid": " UNION ALL ".join(_grid(n, w) for n, w in (("none", ""), ("glove", f"{_GLOVE}, wanted AS ({_CAPPED}), "), ("wordnet", f"{_FEW_WORDNET}, wanted AS ({_CAPPED}), "))),
    "eval_report": _REPORT,
    "eval_timing": "WITH r AS (SELECT o_orderkey::VARCHAR AS query, round(o_totalprice * 1000)::BIGINT AS ns, o_custkey AS results FROM orders), a AS (SELECT sum(ns)::BIGINT AS total, count(*) AS n, sum(results)::BIGINT AS results, min(ns) AS least, max(ns) AS most FROM r) SELECT total, total // n AS mean, least(results, 1000000) AS rate, CASE WHEN results = 0 THEN total ELSE total // results * least(results, 1000000) END AS per_rate, (SELECT query FROM r ORDER BY ns, query LIMIT 1) AS quickest, least, (SELECT query FROM r ORDER BY ns DESC, query DESC LIMIT 1) AS slowest, most FROM a",
    "glove_nearest": f"SELECT word, near, rank, round(similarity, 5) AS similarity FROM ({_NEAR.format(sim=_SIM, where='w.vec_id < 100 AND w.vec_id % 5 = 0')})",
    "glove_nearest_all": f"SELECT word, near, rank, round(similarity, 5) AS similarity FROM ({_NEAR.format(sim=_SIM, where='w.vec_id % 20 = 0')})",
    "glove_expand": f"WITH q AS (SELECT * FROM (VALUES (1, 0, 'w3'), (1, 2, 'unknown'), (2, 0, 'w40')) v(query_id, pos, token)), n AS ({_NEAR.format(sim=_SIM, where='w.vec_id IN (3, 40)')}) SELECT query_id, pos, 0 AS cand, token AS term, 1.0::DOUBLE AS weight FROM q UNION ALL SELECT query_id, pos, rank, 'w' || near, 0.5::DOUBLE FROM q JOIN n ON 'w' || word = token",
    "wordnet_expand": f"WITH {_WORDNET} SELECT query_id, pos, cand, term, weight FROM cands",
    "expansion_cap": f"WITH {_WORDNET} {_CAPPED}",
    "expanded_search": f"WITH {_WORDNET}, wanted AS ({_CAPPED}), " + _search("bm25", 10, "wanted").removeprefix("WITH ") + " SELECT query_id, doc_id, score, rank FROM ranked",
    "char_histogram": "SELECT property, ch, count(*) AS cnt FROM (SELECT 'text' AS property, unnest(string_split(text, '')) AS ch FROM documents UNION ALL SELECT 'lang', unnest(string_split(lang, '')) FROM documents) WHERE ch <> '' GROUP BY ALL",
    "json_reader": "SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS title, 0 AS year, '' AS venue, lang AS fields, 0 AS n_authors FROM documents WHERE doc_id % 10 <> 3",
    "json_reader_whole": "SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS text FROM documents",
    "json_props": "SELECT event_type, count(*) AS n, count(props) AS parsed FROM events GROUP BY ALL",
    "author_strings": "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS names, string_agg('[' || s_suppkey || ', ' || (s_suppkey + 1) || ']', ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY ALL",
    "doc_record_size": "SELECT doc_id, CAST(16 + strlen(coalesce(text, '')) + strlen(source) + 2 + strlen(lang) AS BIGINT) AS bytes FROM documents",
    "duration_format": f"SELECT o_orderkey, ns, {_DURATION} AS shown FROM (SELECT o_orderkey, CAST(pow(2.0, o_orderkey % 44) * 1000 + o_custkey * 1000003 AS BIGINT) AS ns FROM orders)",
    "dense_ids": "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS doc_id FROM orders",
    "session_search": f"WITH wanted AS ({_SESSION}), " + _search("bm25", None, "wanted").removeprefix("WITH ").replace("round(score, 9) AS score", "score") + " SELECT query_id, r.doc_id, rank, lang, round(score, 6) AS score FROM ranked r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 10",
}


def _graph_report() -> str:
    """The lines of files out of the queries' own SQL."""
    counters = [
        ("documents", "Documents"), ("sinks", "Sinks"), ("sinks_true", "Sinks +(self references)"), ("in_edges_true", "In edges -(self references + multiple same references)"), ("in_edges", "In edges"),
        ("out_edges_true", "Out edges -(self references + multiple same references)"), ("out_edges", "Out edges"), ("duplicate_in_edges", "Duplicate In edges -(self references)"), ("docs_duplicate_in", "Documents with duplicate In edges -(self references)"),
        ("duplicate_out_edges", "Duplicate Out edges -(self references)"), ("docs_duplicate_out", "Documents with duplicate Out edges -(self references)"), ("docs_self_in", "Self referencing documents via In edges"), ("self_in_edges", "Self referencing In edges"),
        ("docs_self_out", "Self referencing documents via Out edges"), ("self_out_edges", "Self referencing Out edges"), ("inconsistent_in_edges", "In edges which are not listed in the Out edges of the source node"), ("inconsistent_out_edges", "Out edges which are not listed in the In edges of the source node"),
    ]
    parts = [f"SELECT 'citations_stats' AS file, i::BIGINT AS n, l[i + 1] AS line FROM (SELECT [{', '.join(f'{_text(label + chr(58) + chr(32))} || {name}' for name, label in counters)}] AS l FROM ({SQL['edge_stats']})), range({len(counters)}) r(i)"]
    both = " -(self references + multiple same references)"
    hists = [("in_edges", "In edges", SQL["degree_hist_in"]), ("out_edges", "Out edges", SQL["degree_hist_out"]), ("in_edges_true", f"In edges{both}", SQL["degree_hist_in_true"]), ("out_edges_true", f"Out edges{both}", SQL["degree_hist_out_true"])]
    none = "not found {} edges -(multiple same references)"
    for side, lists in (("In", "ins"), ("Out", "outs")):
        hists.append((f"{side.lower()}_edges_not_found", none.format(side), f"WITH {LINES} SELECT n AS degree, count(*) AS documents FROM (SELECT nodes.id, count(DISTINCT other) FILTER (WHERE other NOT IN (SELECT id FROM nodes)) AS n FROM nodes LEFT JOIN {lists} USING (id) GROUP BY ALL) GROUP BY n"))
    for name, head, sql in hists:
        parts.append(f"SELECT '{name}', -1, 'Number of {head} | Number of documents' UNION ALL SELECT '{name}', degree, degree || ' ' || documents FROM ({sql})")
    return " UNION ALL ".join(parts)


SQL["graph_report"] = _graph_report()
