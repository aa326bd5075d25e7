"""Registered queries of single parts of the engine, with their SQL: small operators on tables and on inline rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glosswork import oracle
from glosswork.functions import patterns as P
from glosswork.functions import scoring as S
from glosswork.functions import text as X
from glosswork.operators import align, annotations, geometry, neural, prefs, rank, responses, segment
from glosswork.queries import INLINE_PAGES, _inline, query
from glosswork.sources import pages as G
from glosswork.streaming.documents import requests_once

q = oracle.q


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def text_digests(spark, sf_dir):
    return G.read_documents(spark, sf_dir).select("doc_id", X.sha256(F.coalesce("text", F.lit(""))).alias("sha"))


_BOXES = "'[[' || CAST(item_id AS VARCHAR) || ',0.5,' || CAST(item_id + 1 AS VARCHAR) || ',12.25],[1,2,3,4]]'"


@query(f"""WITH r AS (SELECT item_id % 7 AS item, CASE WHEN item_id % 3 > 0 THEN item_id % 2 END AS page, CASE WHEN item_id % 2 = 0 THEN 's' || item_id END AS sort, text, CASE WHEN item_id % 5 > 0 THEN {_BOXES} ELSE '[]' END AS boxes FROM benchmark, (VALUES (0), (1)) AS t(k))
SELECT DISTINCT item || '::' || coalesce(page, 0) || '::' || coalesce(sort, 'no-sort-index') || '::no-annotation-key::' || text || '::' || boxes AS request_key FROM r""")
def requests_in_flight(spark, sf_dir):
    """Each request of two alike, by its key."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    i = F.col("item_id")
    boxes = F.when(i % 5 > 0, F.array(F.array(i.cast("double"), F.lit(0.5), (i + 1).cast("double"), F.lit(12.25)), F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])))
    key = annotations.request_key(i % 7, F.when(i % 3 > 0, i % 2), F.when(i % 2 == 0, F.concat(F.lit("s"), i.cast("string"))), F.lit(None).cast("string"), F.col("text"), boxes)
    return requests_once(rows.withColumn("request_key", key)).select("request_key")


@query("SELECT item_id % 5 AS doc_id, count(*) FILTER (WHERE length(text) % 3 > 0) AS succeeded, count(*) FILTER (WHERE length(text) % 3 = 0) AS failed FROM benchmark GROUP BY 1")
def run_counts(spark, sf_dir):
    """How many of the attempted rows were done; here those whose text has a length not divisible by three."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((F.col("item_id") % 5).alias("doc_id"), F.col("item_id").alias("id"), "text")
    return annotations.run_counts(rows, rows.filter(F.length("text") % 3 > 0))


PAYLOADS = (
    """(1, '{"key":"K1","type":"note","color":"#aaa","text":"t","comment":"[x]","tags":["a",1,"b"],"position":{"pageIndex":3,"rects":[[5,6,1,2],[1,2,3],[0.12345,2,3,4.5678]]},"pageLabel":"iv","sortIndex":"0|1"}'), """
    """(2, '{"key":"","type":7,"text":null,"tags":"a","position":{"pageIndex":"2"},"pageLabel":"","sortIndex":5}'), (3, '{}'), (4, '{"key":"K4","comment":3,"position":{"rects":[[1,"2",3,4],[9,8,7,6]]}}')"""
)


def _field(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN j ->> '{path}' END"


@query(f"""WITH a AS (SELECT id, raw, CAST(raw AS JSON) AS j FROM (VALUES {PAYLOADS}) AS t(id, raw)), boxes AS (
  SELECT id, unnest(from_json(coalesce(j -> '$.position.rects', '[]'), '["JSON"]')) AS r, generate_subscripts(from_json(coalesce(j -> '$.position.rects', '[]'), '["JSON"]'), 1) AS k FROM a), numbers AS (
  SELECT id, k, list_transform(from_json(r, '["JSON"]'), lambda x: CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(x AS DOUBLE) END) AS n FROM boxes), good AS (
  SELECT id, list([round(least(n[1], n[3]), 3), round(least(n[2], n[4]), 3), round(greatest(n[1], n[3]), 3), round(greatest(n[2], n[4]), 3)] ORDER BY k) AS rects FROM numbers WHERE len(list_filter(n[1:4], lambda x: x IS NOT NULL)) = 4 GROUP BY id)
SELECT a.id, coalesce(nullif({_field('$.key')}, ''), 'highlight_' || substr(sha256(raw), 1, 16)) AS key, coalesce(nullif({_field('$.type')}, ''), 'highlight') AS type, coalesce(nullif({_field('$.color')}, ''), '{S.DEFAULT_COLOUR}') AS color, coalesce({_field('$.text')}, '') AS text, coalesce({_field('$.comment')}, '') AS comment,
  CASE WHEN json_type(j, '$.tags') = 'ARRAY' THEN list_transform(list_filter(from_json(j -> '$.tags', '["JSON"]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE []::VARCHAR[] END AS tags,
  CAST(CASE WHEN json_type(j, '$.position.pageIndex') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(j ->> '$.position.pageIndex' AS DOUBLE) ELSE 0 END AS INTEGER) AS page_index, coalesce(rects, []::DOUBLE[][]) AS rects, nullif({_field('$.pageLabel')}, '') AS page_label, nullif({_field('$.sortIndex')}, '') AS sort_index
FROM a LEFT JOIN good USING (id)""")
def annotation_payloads(spark, sf_dir):
    """JSON annotations with fields of right and wrong types."""
    return annotations.payloads(_inline(spark, PAYLOADS, "id, raw"))


LABELS = "('result', 'Results'), ('Method note', NULL), (NULL, 'Intro'), ('', 'Intro'), ('', ''), (NULL, NULL), ('caveat', ''), ('claim of background', 'x'), ('RESULT', NULL)"


@query(f"""SELECT why, title, CASE {' '.join(f"WHEN contains(lower(coalesce(why, '')), '{part}') THEN '{value}'" for part, value in S.COLOURS)} ELSE '{S.DEFAULT_COLOUR}' END AS color,
  CASE WHEN length(why) > 0 THEN '[' || why || ']' WHEN length(title) > 0 THEN '[' || title || ']' ELSE '' END AS comment, CASE WHEN length(why) > 0 THEN '[' || why || ']' ELSE '' END AS own_comment FROM (VALUES {LABELS}) AS t(why, title)""")
def colours_and_comments(spark, sf_dir):
    rows = _inline(spark, LABELS, "why, title")
    return rows.select("why", "title", S.colour(F.col("why")).alias("color"), S.comment(F.col("why"), F.col("title")).alias("comment"), S.comment(F.col("why")).alias("own_comment"))


TITLES = "(1, ' A title ', 'x', 'y'), (2, '  ', 'own ', 'y'), (3, NULL, NULL, ' props'), (4, NULL, '', ' ')"


@query(f"SELECT id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), '')) AS title FROM (VALUES {TITLES}) AS t(id, a, b, c)")
def paper_titles(spark, sf_dir):
    return _inline(spark, TITLES, "id, a, b, c").select("id", G.paper_title(*[F.col(c).cast("string") for c in "abc"]).alias("title"))


_FULL = '{"modelId":"m","assetVersion":"1","releaseTag":"r","assetFileName":"a","packageDirectoryName":"p","vocabFileName":"v"'
MANIFESTS = f"(1, '{_FULL}}}'), (2, '{_FULL},\"pluginMinVersion\":\"2\"}}'), (3, '{_FULL},\"pluginMinVersion\":3}}'), (4, '{_FULL[:-3]}\"}}'), (5, '{{\"modelId\":5}}'), (6, 'no json'), (7, '[]')"


@query(f"""WITH a AS (SELECT id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM (VALUES {MANIFESTS}) AS t(id, raw))
SELECT id, coalesce({' AND '.join(f"json_type(j, '$.{k}') = 'VARCHAR' AND (j ->> '$.{k}') <> ''" for k in G.MANIFEST)} AND (json_type(j, '$.pluginMinVersion') IS NULL OR json_type(j, '$.pluginMinVersion') = 'VARCHAR' AND (j ->> '$.pluginMinVersion') <> ''), false) AS valid FROM a""")
def model_manifests(spark, sf_dir):
    return G.manifests(_inline(spark, MANIFESTS, "id, raw")).select("id", "valid")


METADATA = """(1, '{"bundledSha256":"ab12"}'), (2, '{"bundledSha256":""}'), (3, '{"bundledSha256":7}'), (4, 'x'), (5, '{}')"""


@query(f"""WITH a AS (SELECT id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM (VALUES {METADATA}) AS t(id, raw)) SELECT id, nullif({_field('$.bundledSha256')}, '') AS bundled_sha256 FROM a""")
def sidecar_metadata(spark, sf_dir):
    return G.sidecar_metadata(_inline(spark, METADATA, "id, raw"))


@query("""WITH i AS (SELECT item_id, item_id % 9 AS page, text AS s, length(text) AS n, CASE WHEN item_id % 11 = 0 THEN -1 ELSE 12 END AS h FROM benchmark), bad AS (SELECT DISTINCT page FROM i WHERE item_id % 13 = 5), c AS (
  SELECT item_id, page, n, h, unnest(string_split(s, '')) AS char, generate_subscripts(string_split(s, ''), 1) - 1 AS unit FROM i)
SELECT page AS doc_id, item_id AS item_index, CAST(unit AS INTEGER) AS unit, char, [round(10 + unit * (500::DOUBLE / n), 6), round(700 - 0.25::DOUBLE * CASE WHEN h > 0 THEN h ELSE 8 END, 6), round(10 + unit * (500::DOUBLE / n) + 500::DOUBLE / n, 6), round(700 + 0.75::DOUBLE * CASE WHEN h > 0 THEN h ELSE 8 END, 6)] AS rect
FROM c WHERE page NOT IN (SELECT page FROM bad)""")
def item_positions(spark, sf_dir):
    """Glyph rects of text items; pages with an item without a usable width give none."""
    i = F.col("item_id")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        (i % 9).alias("doc_id"), F.lit(0).alias("page_index"), i.alias("item_index"), F.col("text").alias("str"), F.array(*[F.lit(float(x)) for x in (1, 0, 0, -8, 10, 700)]).alias("transform"),
        F.when(i % 13 == 5, F.lit(float("nan"))).otherwise(500.0).alias("width"), F.when(i % 11 == 0, -1.0).otherwise(12.0).alias("height"),
    )
    return G.item_positions(rows).select("doc_id", "item_index", "unit", "char", F.transform("rect", lambda x: F.round(x, 6)).alias("rect"))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM benchmark), c AS (
  SELECT item_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS k FROM b), m AS (
  SELECT *, CAST(sum(CASE WHEN c <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY k) - 1 AS INTEGER) AS glyph FROM c)
SELECT item_id AS doc_id, CAST(0 AS INTEGER) AS page_index, string_agg(c, '' ORDER BY k) AS text, list(glyph ORDER BY k) AS char_mapping FROM m GROUP BY item_id""")
def glyph_page_text(spark, sf_dir):
    """Text and glyph mapping of pages given as glyphs, blanks of which are flags of the glyphs before."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w", "word"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    glyphs = words.select("item_id", "w", "words", F.length("word").alias("n"), F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("k", "c"))
    last = (F.col("k") == F.col("n") - 1) & (F.col("w") < F.col("words") - 1)
    chars = glyphs.select(
        F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), (F.row_number().over(Window.partitionBy("item_id").orderBy("w", "k")) - 1).alias("char_index"), "c", F.lit(None).cast("string").alias("u"), F.array(*[F.lit(1.0)] * 4).alias("rect"),
        (last & (F.col("w") % 5 > 0)).alias("space_after"), (last & (F.col("w") % 5 == 0)).alias("line_break_after"), F.lit(None).cast("boolean").alias("paragraph_break_after"),
    )
    return G.page_text(G.char_positions(chars, line_breaks=False))


PAGE_LABELS = "(1, 3, '9', 1), (2, NULL, ' 12a', 1), (3, NULL, 'iv', 7), (4, -1, '0', NULL), (5, NULL, '+5', NULL), (6, NULL, NULL, -2)"


@query(rf"""WITH a AS (SELECT *, TRY_CAST(nullif(regexp_extract(coalesce(label, ''), '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS n FROM (VALUES {PAGE_LABELS}) AS t(id, page, label, reader))
SELECT id, CAST(CASE WHEN n > 0 THEN n - 1 END AS INTEGER) AS label_page, CAST(coalesce(CASE WHEN page >= 0 THEN page END, CASE WHEN n > 0 THEN n - 1 END, CASE WHEN reader >= 0 THEN reader END) AS INTEGER) AS page_of FROM a""")
def page_labels(spark, sf_dir):
    rows = _inline(spark, PAGE_LABELS, "id, page, label, reader")
    return rows.select("id", align.page_label_index(F.col("label")).alias("label_page"), align.page_of(F.col("page"), F.col("label"), F.col("reader")).cast("int").alias("page_of"))


@query("""WITH a AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '00002|000' || (100 + item_id) || '|00700' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE '1|abc|2' END AS base, item_id % 30 - 3 AS span FROM benchmark), n AS (
  SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 100 + item_id ELSE 0 END + greatest(0, span) AS place FROM a)
SELECT item_id, '00003|' || lpad(CAST(place AS VARCHAR), 6, '0') || '|00012' AS sort_index FROM n""")
def fallback_sort_indexes(spark, sf_dir):
    i = F.col("item_id")
    base = F.when(i % 4 == 0, F.concat(F.lit("00002|000"), (100 + i).cast("string"), F.lit("|00700"))).when(i % 4 == 1, "x").when(i % 4 == 3, "1|abc|2")
    rects = F.array(F.array(*[F.lit(x) for x in (0.0, 12.9, 1.0, 20.0)]))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", geometry.fallback_sort_index(base, F.lit(3), i % 30 - 3, rects).alias("sort_index"))


VERSIONS = "('1.0.0'), ('1.0.0-alpha.1'), ('1.0.0-alpha'), ('1.0.0-2'), ('1.0.0-10'), ('0.9.12'), ('1.0.0-beta.2+build'), ('bad'), ('10.0.0'), ('2.0.0-rc.1'), ('2.0.0-rc.1.x'), ('1.0')"


@query(r"""WITH v AS (SELECT version, regexp_extract(version, '^\s*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$', ['a', 'b', 'c', 'pre']) AS m FROM (VALUES """ + VERSIONS + r""") AS t(version)), k AS (
  SELECT version, lpad(m.a, 12, '0') || lpad(m.b, 12, '0') || lpad(m.c, 12, '0') || CASE WHEN m.pre = '' THEN '1' ELSE '0' || array_to_string(list_transform(string_split(m.pre, '.'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN '0' || lpad(p, 12, '0') ELSE '1' || p END), chr(1)) END AS key FROM v WHERE m.a <> '')
SELECT version, CAST(dense_rank() OVER (ORDER BY key) AS INTEGER) AS place FROM k""")
def version_order(spark, sf_dir):
    rows = _inline(spark, VERSIONS, "version").withColumn("key", prefs.version_key(F.col("version"))).filter("key is not null")
    return rows.select("version", F.dense_rank().over(Window.orderBy("key")).alias("place"))


SCRIPTS = "(1, '深度学习 beats 3D models'), (2, 'ab漢字cd ひらがなカタカナ 한국어 x'), (3, 'สวัสดีครับ hello ລາວ'), (4, 'state-of-the-art can''t 5 ab'), (5, 'မြန်မာ ខ្មែរ and 模型a')"
_CJK, _SEA = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}", r"\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}"
_RUN = rf"[{_CJK}][{_CJK}\p{{M}}]*|[{_SEA}][{_SEA}\p{{M}}]*"


@query(rf"""WITH t AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(text), '{_RUN}|[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda w: NOT regexp_matches(w, '^[a-z0-9]') OR length(w) > 1 AND NOT list_contains({oracle.listed(P.STOPWORDS)}, w))) AS term FROM (VALUES {SCRIPTS}) AS t(id, text)) SELECT id, term, count(*) AS n FROM t GROUP BY ALL""")
def script_tokens(spark, sf_dir):
    """Runs of scripts without blanks are one token each."""
    rows = _inline(spark, SCRIPTS, "id, text").select("id", F.explode(X.tokens(F.lower(X.nfkc(F.col("text"))))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").alias("n"))


_SHIFTS = "[{'o': 3, 's': 1}, {'o': 10, 's': -2}, {'o': 20, 's': 4}]"


@query(f"""WITH a AS (SELECT CAST(o AS INTEGER) AS start, CAST(o + len AS INTEGER) AS "end" FROM range(0, 30, 2) AS t(o), (VALUES (1), (4), (12)) AS l(len)), s AS (
  SELECT start, "end", coalesce(list_filter({_SHIFTS}, lambda d: d.o <= start)[-1].s, 0) AS x, coalesce(list_filter({_SHIFTS}, lambda d: d.o <= "end")[-1].s, 0) AS y FROM a)
SELECT start, "end", x AS shift, CASE WHEN "end" - y > start - x THEN start - x END AS low, CASE WHEN "end" - y > start - x THEN "end" - y END AS high FROM s""")
def offset_shifts(spark, sf_dir):
    """Offsets of normalised text back in the original, by an as-of look-up of shifts."""
    rows = spark.range(0, 30, 2).select(F.col("id").cast("int").alias("start"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(12))).alias("n")).select("start", (F.col("start") + F.col("n")).alias("end"))
    diffs = F.expr("array(named_struct('offset', 3, 'shift', 1), named_struct('offset', CAST(NULL AS INT), 'shift', 9), named_struct('offset', 10, 'shift', -2), named_struct('offset', 20, 'shift', 4))")
    at = align.original_range(diffs, F.col("start"), F.col("end"))
    return rows.select("start", "end", align.shift_at(diffs, F.col("start")).alias("shift"), at["start"].alias("low"), at["end"].alias("high"))


_MESSY = "replace(replace(text, ' ', '  '), 'e', '(  e ') || ' ,  (x ) ' || chr(8217) || chr(173)"


@query(rf"""SELECT item_id, regexp_replace(regexp_replace(trim(regexp_replace(replace(replace({_MESSY}, chr(8217), chr(39)), chr(173), ''), '\s+', ' ', 'g')), '([(\[{{]) ', '\1', 'g'), ' ([)\]}},.;:!?])', '\1', 'g') AS normal FROM benchmark""")
def normal_texts(spark, sf_dir):
    """The form in which texts are matched: of benchmark passages with doubled blanks, brackets, curly quotes and soft hyphens."""
    messy = F.concat(F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("e"), F.lit("(  e ")), F.lit(" ,  (x ) ’­"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", align.normal_text(messy)["text"].alias("normal"))


@query("""WITH p AS (SELECT item_id, text, unnest(range(0, length(text)))::INTEGER AS s FROM benchmark), h AS (SELECT item_id, s FROM p WHERE substr(text, s + 1, 2) = 'er'), d AS (
  SELECT item_id, s, CASE WHEN s < 90 AND s + 2 > 60 THEN 0 ELSE least(abs(s + 2 - 60), abs(s - 90)) END AS gap, abs((s + 1) - 75) AS centre, abs(s - 60) AS first FROM h)
SELECT item_id, s AS start, CAST(row_number() OVER (PARTITION BY item_id ORDER BY gap, centre, first, s) AS INTEGER) AS place FROM d QUALIFY place <= 24""")
def substring_places(spark, sf_dir):
    """Where two letters occur in a passage, nearest to a window first, 24 at most."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = rows.select("item_id", F.posexplode(align.substring_starts(F.col("text"), F.lit("er"), F.lit(60), F.lit(90))).alias("k", "start"))
    return found.select("item_id", "start", (F.col("k") + 1).alias("place"))


@query("""WITH c AS (SELECT item_id, length(text) AS n, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS k FROM benchmark), m AS (
  SELECT item_id, n, k, CASE WHEN c <> ' ' THEN sum(CASE WHEN c <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY k) - 1 END AS glyph FROM c)
SELECT item_id, CAST(min(k) FILTER (WHERE glyph BETWEEN 5 AND 20) AS INTEGER) AS start, CAST(max(k) FILTER (WHERE glyph BETWEEN 5 AND 20) + 1 AS INTEGER) AS "end", CAST(min_by(glyph, k) FILTER (WHERE glyph IS NOT NULL AND k >= 12) AS INTEGER) AS next, CAST(max_by(glyph, k) FILTER (WHERE glyph IS NOT NULL AND k <= 12) AS INTEGER) AS last FROM m GROUP BY item_id""")
def glyph_windows(spark, sf_dir):
    """From windows of glyphs to windows of text, and from offsets to the nearest glyphs; blanks have no glyph."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    before = X.prefix_sums(F.transform(chars, lambda c: (c != " ").cast("int")))
    mapping = F.zip_with(chars, before, lambda c, n: F.when(c != " ", n))
    rows = X.bound(rows, mapping=mapping)
    window = align.text_window(F.col("mapping"), F.length("text"), F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")))
    return rows.select("item_id", window["start"].alias("start"), window["end"].alias("end"), align.nearest_char(F.col("mapping"), F.lit(12), True).alias("next"), align.nearest_char(F.col("mapping"), F.lit(12), False).alias("last"))


_RULES = " || chr(10) || ".join(q(x) for x in responses.SELECTION_RULES)


@query(f"""SELECT item_id, 'paper_title: ' || CASE WHEN item_id % 2 = 0 THEN 'T' || item_id ELSE 'unknown' END || chr(10) || 'section_title: unknown' || chr(10) || 'before_context: b' || chr(10) || 'selection_text: ' || text || chr(10) || 'after_context: ' || chr(10) || 'Task: return up to 3 short worth-reading spans from selection_text only.' || chr(10) || {_RULES} AS prompt,
  CASE WHEN item_id % 3 = 0 THEN 'own' ELSE 'base' || {q(responses.FOCUS['results-first'])} END AS system FROM benchmark""")
def selection_prompts(spark, sf_dir):
    i = F.col("item_id")
    title = F.when(i % 2 == 0, F.concat(F.lit(" T"), i.cast("string"), F.lit(" "))).otherwise(" ")
    prompt = responses.selection_prompt(title, F.lit(None).cast("string"), F.lit("b"), F.col("text"), F.lit(""))
    system = responses.system_prompt("base", F.when(i % 3 == 0, "own").when(i % 3 == 1, "base"), "results-first")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", prompt.alias("prompt"), system.alias("system"))


REPLIES = (
    """(1, '{"choices":[{"message":{"content":" plain "}}]}'), (2, '{"choices":[{"message":{"content":[{"text":"a"},{"content":"b"},"c",{"x":1}]}}]}'), (3, '{"choices":[{"text":"old"}]}'), """
    """(4, '{"output_text":"out"}'), (5, '{"choices":[]}'), (6, 'broken'), (7, '{"choices":[{"message":{"content":{"text":"one"}}}]}')"""
)


@query(f"""WITH a AS (SELECT id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM (VALUES {REPLIES}) AS t(id, raw)), c AS (SELECT id, coalesce(j -> '$.choices[0].message.content', j -> '$.choices[0].text', j -> '$.output_text') AS c FROM a)
SELECT id, coalesce(trim(CASE json_type(c) WHEN 'VARCHAR' THEN c ->> '$' WHEN 'ARRAY' THEN array_to_string(list_transform(from_json(c, '["JSON"]'), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' ELSE coalesce(x ->> '$.text', x ->> '$.content', '') END), '') WHEN 'OBJECT' THEN coalesce(c ->> '$.text', c ->> '$.content', '') END), '') AS content FROM c""")
def message_contents(spark, sf_dir):
    return _inline(spark, REPLIES, "id, raw").select("id", responses.message_content_column("raw").alias("content"))


HIGHLIGHTS = (
    """(1, '{"highlights":[{"text":"","start":2,"end":5,"reason":"claim","confidence":0.5},{"text":"own","start":0,"end":3},{"text":"x","start":"0","end":3},{"start":9,"end":90}]}', 'abcdefghijkl'), """
    """(2, '{"highlights":[{"text":" ","start":5,"end":5}]}', 'abc'), (3, '{}', 'abc'), (4, 'no', 'abc')"""
)


@query(f"""WITH a AS (SELECT id, source, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM (VALUES {HIGHLIGHTS}) AS t(id, raw, source)), e AS (
  SELECT id, source, unnest(from_json(j -> '$.highlights', '["JSON"]')) AS x, generate_subscripts(from_json(j -> '$.highlights', '["JSON"]'), 1) - 1 AS rank FROM a WHERE (j -> '$.highlights') IS NOT NULL), n AS (
  SELECT *, CASE WHEN json_type(x, '$.start') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(x ->> '$.start' AS INTEGER) END AS s, CASE WHEN json_type(x, '$.end') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(x ->> '$.end' AS INTEGER) END AS f FROM e), t AS (
  SELECT *, CASE WHEN trim(coalesce(x ->> '$.text', '')) <> '' THEN x ->> '$.text' ELSE substr(source, greatest(0, least(s, length(source))) + 1, greatest(0, least(f, length(source)) - greatest(0, least(s, length(source))))) END AS text FROM n WHERE s IS NOT NULL AND f IS NOT NULL)
SELECT id AS selection_id, CAST(rank AS INTEGER) AS rank, text, s AS start, f AS "end", (x ->> '$.reason') AS reason, CAST(x ->> '$.confidence' AS DOUBLE) AS confidence FROM t WHERE trim(text) <> ''""")
def span_coercion(spark, sf_dir):
    rows = responses.spans(_inline(spark, HIGHLIGHTS, "selection_id, json, source"))
    return rows.select("selection_id", "rank", "text", "start", "end", "reason", "confidence")


@query("""SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN 'external' ELSE 'local' END AS origin, CAST(k AS INTEGER) AS id FROM benchmark, (VALUES (0), (1)) AS t(k)""")
def external_or_local(spark, sf_dir):
    """Rows of an external scorer where it answered, else the local ones."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("id"))
    return responses.with_fallback(rows.filter("doc_id % 3 = 0").withColumn("origin", F.lit("external")), rows.withColumn("origin", F.lit("local"))).select("doc_id", "origin", "id")


@query("""SELECT item_id AS doc_id, CAST(k AS INTEGER) AS id, length(text) / 100.0::DOUBLE + k AS score FROM benchmark, (VALUES (0), (1), (2)) AS t(k) WHERE item_id % 4 > 1""")
def pluggable_scores(spark, sf_dir):
    """Scores of a plugged-in function; where it fails or gives another number of scores, the document has none."""

    def scorer(asked: str, texts: list[str]) -> list[float]:
        if asked == "0":
            raise ValueError(asked)
        return [len(t.split("|", 1)[1]) / 100 + int(t.split("|", 1)[0]) for t in texts][: 2 if asked == "1" else None]

    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("id", F.explode(F.array(*map(F.lit, range(3)))))
    rows = rows.select(F.col("item_id").alias("doc_id"), "id", F.concat_ws("|", F.col("id").cast("string"), "text").alias("text"))
    asked = rows.select("doc_id", (F.col("doc_id") % 4).cast("string").alias("query")).distinct()
    return rank.scored_by(rows, asked, scorer)


GLYPHS = "(1, array(1.0D, 2.0D, 5.0D, 9.0D), array(0.0D, 3.0D, 6.0D, 8.0D), 0), (2, array(5.0D, 9.0D, 1.0D, 2.0D), array(0.0D, 3.0D, 6.0D, 8.0D), 90), (3, array(1.0D, 2.0D, 5.0D, 9.0D), CAST(NULL AS array<double>), 0), (4, array(1.0D, 2.0D), array(0.0D, 3.0D, 6.0D, 8.0D), 0), (5, array(1.0D, 2.0D, 5.0D, 9.0D), array(0.0D, 3.0D, 6.0D, 8.0D), CAST(NULL AS int))"


@query("""WITH t AS (SELECT * FROM (VALUES (1, [1.0::DOUBLE, 2, 5, 9], [0.0::DOUBLE, 3, 6, 8], 0), (2, [5, 9, 1, 2], [0, 3, 6, 8], 90), (3, [1, 2, 5, 9], NULL, 0), (4, [1, 2], [0, 3, 6, 8], 0), (5, [1, 2, 5, 9], [0, 3, 6, 8], NULL)) AS t(id, r, i, rotation)), n AS (
  SELECT id, rotation, CASE WHEN len(r) >= 4 THEN [least(r[1], r[3]), least(r[2], r[4]), greatest(r[1], r[3]), greatest(r[2], r[4])] END AS r, CASE WHEN len(i) >= 4 THEN [least(i[1], i[3]), least(i[2], i[4]), greatest(i[1], i[3]), greatest(i[2], i[4])] END AS i FROM t)
SELECT id, CASE WHEN r IS NULL OR i IS NULL THEN r WHEN rotation IN (90, 270) THEN [i[1], r[2], i[3], r[4]] ELSE [r[1], i[2], r[3], i[4]] END AS rect FROM n""")
def glyph_rects(spark, sf_dir):
    rows = _inline(spark, GLYPHS, "id, r, i, rotation")
    return rows.select("id", geometry.highlight_rect(F.col("r"), F.col("i"), F.col("rotation")).alias("rect"))


@query("""WITH g AS (SELECT item_id, unnest(range(0, length(text)))::INTEGER AS k, length(text) AS n FROM benchmark), r AS (
  SELECT item_id, k, k // 40 AS line, (k % 40) * 6.0::DOUBLE AS x, 700.0::DOUBLE - (k // 40) * 14.0::DOUBLE AS y FROM g WHERE k BETWEEN 30 AND n - 6)
SELECT item_id, CAST(line - min(line) OVER (PARTITION BY item_id) AS INTEGER) AS line, min(x) AS x1, min(y) + 1 AS y1, max(x) + 6 AS x2, min(y) + 9 AS y2 FROM r GROUP BY item_id, r.line""")
def glyph_lines(spark, sf_dir):
    """One rect a line for glyphs 30 to the sixth from the end, 40 a line, with narrower inline rects."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    x, y = lambda k: (k % 40) * 6.0, lambda k: 700.0 - F.floor(k / 40) * 14.0
    glyph = lambda k: F.struct(F.array(x(k), y(k), x(k) + 6.0, y(k) + 10.0).alias("rect"), F.array(x(k), y(k) + 1.0, x(k) + 6.0, y(k) + 9.0).alias("inline_rect"), F.lit(0).alias("rotation"), (k % 40 == 39).alias("line_break_after"))
    glyphs = F.transform(F.sequence(F.lit(0), F.length("text") - 1), glyph)
    out = rows.select("item_id", F.posexplode(geometry.line_rects_column(glyphs, F.lit(30), F.length("text") - 6)).alias("line", "r"))
    return out.select("item_id", "line", *[F.col("r")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_VOCABULARY = [neural.PAD, neural.UNKNOWN, neural.START, neural.SEPARATOR, *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), ".", ","]


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[.,]|[^\\s.,!?;:()\\[\\]{}"''%&*/@#_-]+|[!?;:()\\[\\]{}"''%&*/@#_-]') AS words FROM benchmark), p AS (
  SELECT item_id, flatten(list_transform(words, lambda w: CASE WHEN regexp_matches(w, '^[a-z]{1,100}$') THEN list_transform(range(1, length(w) + 1), lambda k: CAST(unicode(substr(w, k, 1)) - 97 + CASE WHEN k = 1 THEN 4 ELSE 30 END AS INTEGER)) WHEN w = '.' THEN [56] WHEN w = ',' THEN [57] ELSE [1] END)) AS b FROM w), i AS (
  SELECT item_id, list_concat([2, 23, 37, 34, 21, 34, 48, 50, 41, 49, 48, 3]::INTEGER[], b, [3]::INTEGER[]) AS ids, len(b) AS n FROM p)
SELECT item_id, list_concat(ids, list_transform(range(0, 512 - len(ids)), lambda x: 0::INTEGER)) AS input_ids, list_transform(range(0, 512), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END::INTEGER) AS attention_mask, list_transform(range(0, 512), lambda x: CASE WHEN x >= 12 AND x < len(ids) THEN 1 ELSE 0 END::INTEGER) AS token_type_ids FROM i""".replace("\\\\", "\\"))
def pair_encoding(spark, sf_dir):
    """Benchmark passages encoded as pairs with a small vocabulary of letters."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pair = neural.encode_pairs(F.lit("the results"), F.col("text"), {t: i for i, t in enumerate(_VOCABULARY)})
    return rows.select("item_id", pair.alias("x")).select("item_id", "x.*")


@query(f"""WITH pages AS (SELECT * FROM (VALUES {INLINE_PAGES}) AS t(doc_id, page_index, text)), {oracle.heads()} SELECT doc_id, page_index, start, "end", title, kind FROM heads""")
def inline_headings(spark, sf_dir):
    """Headings of inline pages."""
    return segment.headings(_inline(spark, INLINE_PAGES, "doc_id, page_index, text"))


@query("""WITH c AS (SELECT doc_id, line, k, 'h' || (k % 3) AS id FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents))
SELECT doc_id, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS INTEGER) AS start, CAST(length(line) AS INTEGER) AS n FROM c""")
def line_offsets(spark, sf_dir):
    """Offsets of the lines of whole documents, by prefix sums."""
    rows = X.bound(G.read_documents(spark, sf_dir), lines=F.split(F.coalesce("text", F.lit("")), "\n", -1)).select("doc_id", "lines")
    starts = X.prefix_sums(F.transform("lines", lambda x: F.length(x) + 1)).alias("start")
    out = rows.select("doc_id", F.explode(F.arrays_zip("lines", starts)).alias("x"))
    return out.select("doc_id", F.col("x.start").cast("int").alias("start"), F.length("x.lines").alias("n"))
