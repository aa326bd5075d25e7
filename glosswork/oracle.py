"""SQL for DuckDB with the same rows as the registered queries.

Common table expressions build on one another: pages, ranges, candidates, shortlist and so on.
"""

from __future__ import annotations

from glosswork import config
from glosswork.functions import patterns as P
from glosswork.functions import scoring as S

D = config.density("balanced")
WORD = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*"
q = lambda text: "'" + text.replace("'", "''") + "'"
ci = lambda pattern: q("(?i)" + pattern)
hit = lambda text, pattern: f"regexp_matches({text}, {ci(pattern)})"
count = lambda text, pattern: f"len(regexp_extract_all({text}, {ci(pattern)}))"
listed = lambda values: "[" + ", ".join(map(q, values)) + "]"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda t: length(t) > 1 AND NOT list_contains({listed(P.STOPWORDS)}, t))"


def trim(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')"


def citations(text: str) -> str:
    return f"({count(text, P.CITATION_SQUARE)} + {count(text, P.CITATION_YEAR)})"


def reference_like(text: str) -> str:
    return f"({hit(trim(text), P.REFERENCE_HEADING)} OR ({citations(text)} >= 1 AND (regexp_matches({trim(text)}, {q(P.REFERENCE_ENTRY)}) OR {hit(text, P.REFERENCE_PAGES)})))"


def readable(text: str, low: int, high: int, most: int) -> str:
    return f"(length({trim(text)}) BETWEEN {max(1, low)} AND {high} AND regexp_matches({text}, '[\\p{{L}}\\p{{N}}]') AND {words(text)} <= {most} AND NOT {hit(trim(text), P.CAPTION)} AND {citations(text)} < 2 AND NOT {reference_like(text)})"


def choose(key: str, values: dict, otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {otherwise} END"


def score(text: str, kind: str, focus: str = "balanced") -> str:
    when = lambda test, delta: f"CASE WHEN {test} THEN {delta} ELSE 0 END"
    parts = [choose(kind, config.section_weights(focus), "NULL")] + [when(hit(text, p), d) for p, d in (*P.POSITIVE, *P.NEGATIVE)]
    parts += [
        when(f"{kind} = 'references' OR {reference_like(text)}", -12), when(f"{words(text)} > 30", -3), when(f"{words(text)} > 22", -1), when(hit(text, P.FIRST_PERSON), 1), when(hit(text, P.NUMERIC), 1),
        when(f"NOT regexp_matches({text}, '[\\p{{L}}\\p{{N}}]')", -3), when(f"{citations(text)} >= 2", -3), when(f"{count(text, P.PRONOUNS)} >= 2", -2),
    ]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


def reason(text: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {hit(text, p)} THEN '{name}'" for name, p in P.REASONS) + f" ELSE {choose(kind, P.SECTION_REASONS, q('background'))} END"


def bonus(why: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {why} = '{name}' AND {kind} IN ({', '.join(map(q, kinds))}) THEN {value}::DOUBLE" for name, (kinds, value) in S.ALIGNMENT.items()) + " ELSE 0::DOUBLE END"


def dedup(text: str) -> str:
    return rf"{trim(rf'''regexp_replace(regexp_replace(lower({text}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}% ]', '', 'g')''')}"


def cap(kind: str, budget: str) -> str:
    part = lambda least, share: f"greatest({least}, CAST(ceil({budget} * {share}::DOUBLE) AS INTEGER))"
    return f"CASE WHEN {kind} = 'results' THEN {part(2, 0.35)} WHEN {kind} = 'methods' THEN {part(1, 0.25)} WHEN {kind} IN ('discussion', 'abstract') THEN {part(1, 0.2)} WHEN {kind} = 'references' THEN 0 ELSE {part(1, 0.15)} END"


def kind_of(title: str) -> str:
    normal = trim(rf"regexp_replace(regexp_replace(lower({title}), {q(P.HEADING_PREFIX)}, ''), '\s+', ' ', 'g')")
    tests = " ".join("WHEN " + " OR ".join(f"contains({normal}, {q(t)})" for t in terms) + f" THEN '{kind}'" for kind, terms in P.SECTION_TERMS)
    return f"CASE {tests} ELSE 'other' END"


PAGES = """
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents
), pages AS (
  SELECT doc_id, CAST(k // 20 AS INTEGER) AS page_index, string_agg(line, chr(10) ORDER BY k) AS text FROM lines GROUP BY ALL
)"""


def heads(pages: str = "pages") -> str:
    return rf"""
head_lines AS (
  SELECT doc_id, page_index, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {pages}
), head_places AS (
  SELECT *, {trim('line')} AS title, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id, page_index ORDER BY k ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS INTEGER) AS start FROM head_lines
), heads AS (
  SELECT doc_id, page_index, start, CAST(start + length(line) AS INTEGER) AS "end", title, {kind_of('title')} AS kind FROM head_places
  WHERE length(title) BETWEEN 1 AND 90 AND NOT regexp_matches(title, '[{P.ASCII_END}{P.CJK_END}]$') AND regexp_matches(title, {q(P.HEADING_LINE)}) AND regexp_matches(title, '[\p{{L}}\p{{N}}]')
    AND len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 12
    AND ({kind_of('title')} <> 'other' OR len(list_filter(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> ''), lambda w: NOT regexp_matches(w, '^[\p{{Lu}}\p{{N}}][\p{{L}}\p{{N}}-]*$'))) = 0)
)"""


def ranges(most: int, pages: str = "pages", key: str = "doc_id, page_index") -> str:
    start = P.SENTENCE_START.replace("'", "''")
    marks = ", ".join(map(q, P.SPLIT_MARKS))
    connector = q(P.SPLIT_CONNECTORS + "$")
    return rf"""
marked AS (
  SELECT {key}, regexp_replace(regexp_replace(regexp_replace(text, '([.!?])(\s+)([{start}])', '\1' || chr(1) || '\2\3', 'g'), '([.!?])(\s*)$', '\1' || chr(1) || '\2'), '(\n)([-*0-9])', '\1' || chr(1) || '\2', 'g') AS m FROM {pages}
), cut AS (
  SELECT {key}, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS k FROM marked
), placed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k ROWS UNBOUNDED PRECEDING) - length(piece) AS INTEGER) AS start, length(piece) AS n FROM cut
), longs AS (
  SELECT *, list_filter(range(16, n + 1), lambda e: substr(piece, e, 1) IN ({marks}) OR regexp_matches(substr(piece, 1, e), {connector})) AS points,
    list_filter(range(16, n + 1), lambda e: substr(piece, e, 1) IN ({marks}) OR regexp_matches(substr(piece, e, 1), '\s')) AS blanks FROM placed WHERE n > {most}
), steps AS (
  SELECT {key}, k, n, points, blanks, 0::BIGINT AS pos FROM longs
  UNION ALL
  SELECT {key}, k, n, points, blanks, coalesce(list_max(list_filter(points, lambda e: e - pos BETWEEN 16 AND {most})), list_max(list_filter(blanks, lambda e: e >= pos + 16 AND e <= least(n, pos + {most}))), least(n, pos + {most}))
  FROM steps WHERE n - pos > {most}
), parts AS (
  SELECT {key}, k, pos, coalesce(lead(pos) OVER (PARTITION BY {key}, k ORDER BY pos), n) AS till FROM steps
), ranges AS (
  SELECT {key}, piece, start, CAST(start + n AS INTEGER) AS "end" FROM placed WHERE n BETWEEN 1 AND {most}
  UNION ALL
  SELECT {', '.join('p.' + c.strip() for c in key.split(','))}, substr(l.piece, p.pos + 1, p.till - p.pos), CAST(l.start + p.pos AS INTEGER), CAST(l.start + p.till AS INTEGER)
  FROM parts p JOIN longs l USING ({key}, k) WHERE p.till - p.pos >= 16
)"""


def trimmed(key: str = "doc_id, page_index") -> str:
    front = r"""regexp_replace(piece, '^[\s"''(\[{]+', '')"""
    body = rf"""regexp_replace({front}, '[\s"'')\]}}]+$', '')"""
    return f"""
trimmed AS (
  SELECT {key}, {body} AS text, CAST(start + length(piece) - length({front}) AS INTEGER) AS start, CAST(start + length(piece) - length({front}) + length({body}) AS INTEGER) AS "end" FROM ranges WHERE {body} <> ''
)"""


def candidates(d: config.Density = D, focus: str = "balanced") -> str:
    return f"""
readable AS (
  SELECT * FROM trimmed WHERE {readable('text', d.min_chars, d.max_chars, d.max_words)}
), sectioned AS (
  SELECT r.*, h.title AS section_title, coalesce(h.kind, 'other') AS section_kind
  FROM readable r LEFT JOIN heads h ON h.doc_id = r.doc_id AND h.page_index = r.page_index AND h.start <= r.start
  QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.page_index, r.start ORDER BY h.start DESC NULLS LAST) = 1
), scored AS (
  SELECT *, {score('text', 'section_kind', focus)} AS heuristic_score FROM sectioned WHERE section_kind <> 'references'
), candidates AS (
  SELECT *, 'P' || (page_index + 1) || '-C' || row_number() OVER (PARTITION BY doc_id, page_index ORDER BY start) AS id, {reason('text', 'section_kind')} AS reason FROM scored WHERE heuristic_score >= 2
)"""


def shortlist(d: config.Density = D) -> str:
    return f"""
keyed AS (
  SELECT *, {dedup('text')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY heuristic_score DESC, page_index, start) AS place FROM candidates
), walk AS (
  SELECT doc_id, 0::BIGINT AS place, []::VARCHAR[] AS seen, []::INTEGER[] AS used, false AS taken FROM (SELECT DISTINCT doc_id FROM keyed)
  UNION ALL
  SELECT k.doc_id, k.place, CASE WHEN t.ok THEN list_append(w.seen, k.key) ELSE w.seen END, CASE WHEN t.ok THEN list_append(w.used, k.page_index) ELSE w.used END, t.ok
  FROM walk w JOIN keyed k ON k.doc_id = w.doc_id AND k.place = w.place + 1,
  LATERAL (SELECT len(w.seen) < {d.shortlist_size} AND k.key <> '' AND NOT list_contains(w.seen, k.key) AND len(list_filter(w.used, lambda p: p = k.page_index)) < {d.shortlist_per_page} AS ok) t
), shortlist AS (
  SELECT k.*, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.place) AS rank FROM keyed k JOIN walk w ON w.doc_id = k.doc_id AND w.place = k.place AND w.taken
)"""


CANDIDATES, SHORTLIST = candidates(), shortlist()


def lexical(method: str, items: str, query: str, key: str = "doc_id", item: str = "id") -> str:
    """scores(key, item, lexical_score) of items (key, item, text) and query (key, term, qtf)."""
    if method == "bm25":
        raw = f"""
raw AS (
  SELECT p.{key}, p.{item}, sum(qt.qtf * ln(1 + (p.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / greatest(p.avgdl, 1)))) AS raw
  FROM post p JOIN dfs d USING ({key}, term) JOIN {query} qt USING ({key}, term) GROUP BY ALL
)"""
    else:
        raw = f"""
qw AS (
  SELECT qt.{key}, qt.term, qt.qtf * (ln((c.n + 1)::DOUBLE / (coalesce(d.df, 0) + 1)) + 1) AS qw FROM {query} qt JOIN (SELECT {key}, count(*) AS n FROM {items} GROUP BY 1) c USING ({key}) LEFT JOIN dfs d USING ({key}, term)
), qn AS (
  SELECT {key}, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1
), raw AS (
  SELECT {key}, {item}, sum(w * qw) / (max(qnorm) * sqrt(sum(w * w))) AS raw
  FROM (SELECT p.{key}, p.{item}, p.term, p.tf * (ln((p.n + 1)::DOUBLE / (d.df + 1)) + 1) AS w FROM post p JOIN dfs d USING ({key}, term)) LEFT JOIN qw USING ({key}, term) LEFT JOIN qn USING ({key})
  GROUP BY ALL HAVING sum(w * qw) IS NOT NULL
)"""
    return f"""
toks AS (
  SELECT {key}, {item}, {tokens('text')} AS toks FROM {items}
), sized AS (
  SELECT *, len(toks) AS dl, count(*) OVER (PARTITION BY {key}) AS n, avg(len(toks)) OVER (PARTITION BY {key}) AS avgdl FROM toks
), post AS (
  SELECT {key}, {item}, dl, n, avgdl, term, count(*) AS tf FROM (SELECT {key}, {item}, dl, n, avgdl, unnest(toks) AS term FROM sized) GROUP BY ALL
), dfs AS (
  SELECT {key}, term, count(*) AS df FROM post GROUP BY ALL
), {raw}, scores AS (
  SELECT i.{key}, i.{item}, coalesce(CASE WHEN max(raw) OVER (PARTITION BY i.{key}) > 0 THEN coalesce(raw, 0) / max(raw) OVER (PARTITION BY i.{key}) END, 0) AS lexical_score FROM {items} i LEFT JOIN raw USING ({key}, {item})
)"""


NO_PAPERS = "SELECT doc_id, NULL::VARCHAR AS title, NULL::VARCHAR[] AS keywords FROM pages WHERE false"


def doc_query(papers: str = NO_PAPERS) -> str:
    """queries(doc_id, query), each document's pseudo-query, and query(doc_id, term, qtf), its terms."""
    return f"""
cand_terms AS (
  SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM candidates) GROUP BY ALL
), top AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(term) DESC, term COLLATE de, term) AS rank FROM cand_terms
), top_lists AS (
  SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM top WHERE rank <= 24 GROUP BY 1
), papers AS (
  {papers}
), title_lists AS (
  SELECT doc_id, string_agg(title, ' ' ORDER BY k) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, start) AS k FROM heads WHERE kind <> 'references') WHERE k <= 12 GROUP BY 1
), lead_lists AS (
  SELECT doc_id, string_agg(text, ' ' ORDER BY k) AS leads FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY heuristic_score DESC, page_index, start) AS k FROM candidates WHERE section_kind IN ('abstract', 'introduction')) WHERE k <= 6 GROUP BY 1
), queries AS (
  SELECT d.doc_id, array_to_string(list_filter([coalesce(array_to_string(keywords[1:10], ' '), ''), {trim("coalesce(title, '')")}, coalesce(titles, ''), coalesce(leads, ''), coalesce(terms, '')], lambda x: x <> ''), ' ') AS query
  FROM (SELECT DISTINCT doc_id FROM candidates) d LEFT JOIN papers USING (doc_id) LEFT JOIN title_lists USING (doc_id) LEFT JOIN lead_lists USING (doc_id) LEFT JOIN top_lists USING (doc_id)
), query AS (
  SELECT doc_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest({tokens('query')}) AS term FROM queries) GROUP BY ALL
)"""


DOC_QUERY = doc_query()

CHAIN = f"WITH RECURSIVE {PAGES}, {heads()}, {ranges(D.max_chars)}, {trimmed()}, {CANDIDATES}"
SHORT = f"{CHAIN}, {SHORTLIST}"


def ranked(method: str, neural: bool = False, short: str = "", query: str = "") -> str:
    final = "h * 0.30::DOUBLE + lexical_score * 0.10::DOUBLE + neural_score * 0.60::DOUBLE + bonus" if neural else "h * 0.68::DOUBLE + lexical_score * 0.32::DOUBLE + bonus"
    extra = f", {NEURAL}" if neural else ""
    join = "JOIN neural USING (doc_id, id)" if neural else ""
    return f"""{short or SHORT}, {query or DOC_QUERY}, {lexical(method, 'shortlist', 'query')}{extra}, blended AS (
  SELECT s.*, lexical_score, {bonus('s.reason', 's.section_kind')} AS bonus, {'neural_score, ' if neural else ''}
    CASE WHEN max(heuristic_score) OVER (PARTITION BY s.doc_id) > 0 THEN greatest(0, least(1, heuristic_score / max(heuristic_score) OVER (PARTITION BY s.doc_id))) ELSE 0 END AS h
  FROM shortlist s JOIN scores USING (doc_id, id) {join}
), ranked AS (
  SELECT *, {final} AS final_score FROM blended
), ordered AS (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY doc_id ORDER BY round(final_score, 12) DESC, heuristic_score DESC, round(lexical_score, 12) DESC, page_index, start) AS rank FROM ranked WHERE final_score >= 0.24
)"""


#: Logits of the registered neural query: a function of length and place.
NEURAL = """
logits AS (
  SELECT doc_id, id, 1 / (1 + exp(-(((length(text) * 7 + start * 3) % 100) / 25.0::DOUBLE - 2))) AS p FROM shortlist
), neural AS (
  SELECT doc_id, id, CASE WHEN max(p) OVER (PARTITION BY doc_id) - min(p) OVER (PARTITION BY doc_id) < 1e-8 THEN 0.5
    ELSE (p - min(p) OVER (PARTITION BY doc_id)) / (max(p) OVER (PARTITION BY doc_id) - min(p) OVER (PARTITION BY doc_id)) END AS neural_score FROM logits
)"""

def final(d: config.Density = D, least: int = 0) -> str:
    return f"""
counts AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS pages FROM pages WHERE {trim('text')} <> '' GROUP BY 1
), rows AS (
  SELECT o.*, least({d.most_budget}, greatest({d.least_budget}, {d.budget_per_page} * greatest(1, c.pages))) AS budget FROM ordered o JOIN counts c USING (doc_id) WHERE section_kind <> 'references' AND heuristic_score >= {least}
), capped AS (
  SELECT *, {cap('section_kind', 'budget')} AS cap, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS go FROM rows
), fold AS (
  SELECT doc_id, 0::BIGINT AS go, []::VARCHAR[] AS seen, []::INTEGER[] AS used, []::VARCHAR[] AS kinds, false AS taken FROM (SELECT DISTINCT doc_id FROM capped)
  UNION ALL
  SELECT c.doc_id, c.go, CASE WHEN t.ok THEN list_append(f.seen, c.key) ELSE f.seen END, CASE WHEN t.ok THEN list_append(f.used, c.page_index) ELSE f.used END, CASE WHEN t.ok THEN list_append(f.kinds, c.section_kind) ELSE f.kinds END, t.ok
  FROM fold f JOIN capped c ON c.doc_id = f.doc_id AND c.go = f.go + 1,
  LATERAL (SELECT len(f.seen) < c.budget AND c.key <> '' AND NOT list_contains(f.seen, c.key) AND len(list_filter(f.used, lambda p: p = c.page_index)) < {d.max_per_page}
    AND len(list_filter(f.kinds, lambda s: s = c.section_kind)) < c.cap AS ok) t
), final AS (
  SELECT c.* FROM capped c JOIN fold f ON f.doc_id = c.doc_id AND f.go = c.go AND f.taken
)"""


FINAL = final()

#: Pages with a heading and a telling sentence before the text of a document's page: all kinds of sections and phrases, on every document.
HEADINGS = ("Abstract", "1 Introduction", "Related Work", "2 Methods", "3 Results", "Discussion", "Conclusion", "References", "Further Remarks")
TELLING = (
    "We propose a novel pipeline and show that accuracy improves by 5 % on this benchmark.", "However, the limitation remains unclear and these failures persist over time.",
    "Prior work left a gap in evaluation that motivates the present problem.", "The architecture yields significant gains in recall, precision and training time.",
    "Figure 3 shows what they, it and these such things mean to the former and the latter.", "As shown in [3] the method outperforms (Foo et al. 2020) by far.",
    "Our work presents evidence, findings and results on a dataset of 12 k items.", "Despite the risk, a trade-off bounds the scope of the protocol.",
)
PAPER_PAGES = PAGES.replace("pages AS (", "plain AS (") + f""", pages AS (
  SELECT doc_id, page_index, {listed(HEADINGS)}[(doc_id * 3 + page_index) % {len(HEADINGS)} + 1] || chr(10) || {listed(TELLING)}[(doc_id * 7 + page_index) % {len(TELLING)} + 1] || chr(10) || text AS text FROM plain
)"""
PAPERS = "SELECT doc_id, '  Notes on ' || (doc_id % 7) || ' things ' AS title, [coalesce(lang, ''), 'deep nets', 'x' || (doc_id % 5)] AS keywords FROM documents"
DENSE = config.density("dense")
PAPER_SHORT = f"WITH RECURSIVE {PAPER_PAGES}, {heads()}, {ranges(DENSE.max_chars)}, {trimmed()}, {candidates(DENSE, 'caveats-first')}, {shortlist(DENSE)}"

#: Selections in the manner of documents: benchmark passages, their own sentences and queries.
_KEYED = "item_id"
QUICK = f"""WITH RECURSIVE sel AS (SELECT item_id, text FROM benchmark), {ranges(D.quick_max_chars, 'sel', _KEYED)}, {trimmed(_KEYED)}, cands AS (
  SELECT *, start AS id, {score('text', q('other'))} AS h0, {reason('text', q('other'))} AS reason FROM trimmed WHERE {readable('text', D.quick_min_chars, D.quick_max_chars, D.quick_max_words)}
), good AS (
  SELECT * FROM cands WHERE h0 >= 2
), own AS (
  SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM sel) GROUP BY ALL
), tops AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, length(term) DESC, term COLLATE de, term) AS place FROM own
), query AS (
  SELECT item_id, term, 1 AS qtf FROM tops WHERE place <= 10
), {lexical('bm25', 'good', 'query', _KEYED)}, blended AS (
  SELECT g.*, greatest(0, least(1, h0 / max(h0) OVER (PARTITION BY item_id))) * 0.72::DOUBLE + lexical_score * 0.28::DOUBLE AS final FROM good g JOIN scores USING (item_id, id)
), ordered AS (
  SELECT *, greatest(0, least(1, final)) AS confidence, {dedup('text')} AS key, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 12) DESC, h0 DESC, start) AS rank FROM blended WHERE final >= 0.22
), firsts AS (
  SELECT * FROM ordered WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY rank) = 1
), places AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM firsts
)"""
