"""SQL of the registered queries, in DuckDB's dialect; written from their definitions, not from the plans."""

from __future__ import annotations

TYPES = "['title','text','image','table','formula','header','footer','page_number','caption','list','code','reference']"

#: All Unicode white space as a class for regular expressions.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)"

BOXES = f"""{LINES},
boxes AS (
  SELECT doc_id, ln AS pos, {TYPES}[ln % 12 + 1] AS block_type, (doc_id * 37 + ln * 191) % 600 AS x1, (doc_id * 13 + ln * 83) % 900 AS y1,
    (doc_id * 37 + ln * 191) % 600 + 100 + (ln * 53 + doc_id) % 300 AS x2, (doc_id * 13 + ln * 83) % 900 + 30 + (ln * 29) % 120 AS y2,
    (50 + (doc_id * 7 + ln * 31) % 50) / CAST(100 AS DOUBLE) AS confidence, line AS content FROM lines)"""

PAGES = """pages AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || repeat(chr(1), CAST(doc_id % 5 * 2 * (length(text) // 100) AS BIGINT)) || chr(57344) || chr(8203)
      WHEN doc_id % 11 = 0 THEN text || '漢字文' ELSE text END AS text,
    text AS whole, (doc_id % 10) / CAST(20 AS DOUBLE) AS image_ratio, CASE WHEN doc_id % 13 = 0 THEN 'CMMI10' ELSE 'Arial' END AS font FROM documents)"""

SPANS = f"""{LINES},
spans AS (
  SELECT doc_id, ln, line, CASE WHEN ln % 4 = 3 THEN 'Times' WHEN doc_id % 13 = 0 THEN 'CMMI10' ELSE 'Arial' END AS font,
    CAST(100 + (ln * 53 + doc_id) % 300 AS DOUBLE) AS width FROM lines)"""


def inter(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def size(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def iou(a: str, b: str) -> str:
    return f"(CASE WHEN {inter(a, b)} = 0 THEN CAST(0 AS DOUBLE) ELSE {inter(a, b)} / CAST({size(a)} + {size(b)} - {inter(a, b)} AS DOUBLE) END)"


def cont(a: str, b: str) -> str:
    return f"(CASE WHEN {inter(a, b)} = 0 THEN CAST(0 AS DOUBLE) ELSE {inter(a, b)} / CAST(least({size(a)}, {size(b)}) AS DOUBLE) END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


INVALID = "(CASE WHEN length(text) = 0 THEN 0 ELSE (length(regexp_replace(text, '[\\n\\r\\t ]', '', 'g')) - length(regexp_replace(regexp_replace(text, '[\\n\\r\\t ]', '', 'g'), '[\\p{Cc}\\p{Cf}\\p{Co}]', '', 'g'))) / CAST(length(text) AS DOUBLE) END)"
CJK = "(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]', '', 'g'))) / CAST(length(text) AS DOUBLE) END)"
COHERENT = f"least(CAST(1 AS DOUBLE), len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) / CAST(greatest(len(regexp_extract_all(text, '[^{WS}]+')), 1) AS DOUBLE))"

METRICS = f"""{PAGES}, {SPANS},
fonts AS (
  SELECT doc_id, count(DISTINCT font) AS font_count, CASE WHEN count(*) FILTER (length(line) > 0) > 1 THEN var_pop(width / length(line)) FILTER (length(line) > 0) ELSE 0 END AS width_variance,
    bool_or(lower(font) LIKE '%cmmi%') AS has_formula FROM spans GROUP BY doc_id),
metrics AS (
  SELECT p.*, length({strip('text')}) AS char_count, {INVALID} AS invalid_ratio, {CJK} AS cjk_ratio, font_count, width_variance, has_formula, {COHERENT} AS coherence FROM pages p JOIN fonts USING (doc_id)),
scored AS (
  SELECT *, greatest(0, least(1, (1 - invalid_ratio * 5 - CASE WHEN font_count > 20 THEN 0.2 ELSE 0 END - CASE WHEN width_variance > 50 THEN CAST(0.2 AS DOUBLE) ELSE 0 END) * coherence)) AS quality_score FROM metrics)"""

CLASSIFIED = f"""{METRICS},
classified AS (
  SELECT *, CASE WHEN char_count < 20 OR invalid_ratio > 0.05 OR quality_score < 0.7 THEN 'scanned' WHEN image_ratio > 0.3 OR has_formula THEN 'mixed' ELSE 'native' END AS page_type FROM scored)"""

PAGED = f"""{LINES},
typed AS (
  SELECT doc_id, line, ln, ['text', 'table', 'formula', 'title'][(doc_id + (ln + 1) // 8) % 4 + 1] AS kind, (doc_id + ln) % 5 = 4 AS wide FROM lines),
paged AS (
  SELECT doc_id, ln // 8 + 1 AS page_number, ln AS pos, CASE WHEN ln % 17 = 16 THEN 'reference' ELSE kind END AS block_type, 0 AS x1, (ln % 8) * 375 + 5 AS y1, 600 AS x2,
    CASE WHEN doc_id % 9 = 0 AND ln % 8 = 0 THEN 2995 ELSE (ln % 8) * 375 + 375 END AS y2, ln % 8 AS reading_order,
    CASE WHEN kind = 'table' THEN '| a | b |' || CASE WHEN wide THEN ' c |' ELSE '' END || chr(10) || '| --- | --- |' || CASE WHEN wide THEN ' --- |' ELSE '' END || chr(10) || '| ' || ln || ' | ' || doc_id || ' |' || CASE WHEN wide THEN ' x |' ELSE '' END
      WHEN doc_id % 2 = 1 AND line LIKE '%.' THEN left(line, length(line) - 1) ELSE line END AS content
  FROM typed)"""

FIRST_LINE = "split_part({}, chr(10), 1)"


def columns(x: str) -> str:
    first = FIRST_LINE.format(strip(x))
    return f"(length({first}) - length(replace({first}, '|', '')) - 1)"


def data_lines(x: str) -> str:
    return f"list_filter(string_split({strip(x)}, chr(10)), lambda s: {strip('s')} <> '')"


def joined_tables(a: str, b: str) -> str:
    lines = data_lines(b)
    return f"array_to_string(list_concat({data_lines(a)}, CASE WHEN len({lines}) > 2 AND regexp_full_match({lines}[2], '\\|[\\s\\-|:]+\\|') THEN list_slice({lines}, 3, len({lines})) ELSE {lines} END), chr(10))"


PAIRING = f"""
pairs AS (
  SELECT a.doc_id, a.block_type, a.page_number AS page1, a.pos AS pos1, b.pos AS pos2, a.content AS content1, b.content AS content2
  FROM paged a JOIN paged b ON a.doc_id = b.doc_id AND b.page_number = a.page_number + 1 AND a.block_type = b.block_type AND a.y2 > 2700 AND b.y1 < 300),
kinds AS (
  SELECT *, CASE WHEN block_type = 'table' AND {columns('content1')} = {columns('content2')} THEN 'table'
    WHEN block_type = 'text' AND {rstrip('content1')} <> '' AND right({rstrip('content1')}, 1) NOT IN ('.', '。', '!', '！', '?', '？') THEN 'paragraph'
    WHEN block_type = 'formula' THEN 'formula' END AS merge_type FROM pairs),
merging AS (
  SELECT *, CASE merge_type WHEN 'table' THEN {joined_tables('content1', 'content2')} WHEN 'paragraph' THEN {rstrip('content1')} || ' ' || {lstrip('content2')}
    ELSE {rstrip('content1')} || chr(10) || {lstrip('content2')} END AS content FROM kinds WHERE merge_type IS NOT NULL),
used AS (SELECT doc_id, pos1 AS pos FROM merging UNION SELECT doc_id, pos2 FROM merging),
merged AS (
  SELECT p.doc_id, p.page_number, p.pos, p.block_type, p.y2 - p.y1 AS height, p.reading_order, m.content, 0 AS o, m.pos1 AS sa, m.pos2 AS sb FROM paged p JOIN merging m ON p.doc_id = m.doc_id AND p.pos = m.pos1
  UNION ALL SELECT p.doc_id, p.page_number, p.pos, p.block_type, p.y2 - p.y1, p.reading_order, p.content, 1, p.pos, 0 FROM paged p ANTI JOIN used u ON p.doc_id = u.doc_id AND p.pos = u.pos)"""


PAIRS = f"{PAGED}, {PAIRING}"

#: As PAIRS, over what is left of each page once overlapping blocks have gone, in order of their upper edges.
DEDUPLICATED_PAIRS = f"""{PAGED.replace('paged AS', 'raw AS')},
hits AS (
  SELECT a.doc_id, a.page_number, list([a.pos, b.pos, CASE WHEN length(a.content) >= length(b.content) THEN 1 ELSE 0 END] ORDER BY a.pos, b.pos) AS arr
  FROM raw a JOIN raw b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.pos < b.pos AND {cont('a', 'b')} > 0.6 GROUP BY a.doc_id, a.page_number),
gone AS (
  SELECT doc_id, unnest(list_reduce(list_prepend([]::BIGINT[], arr), lambda acc, v: CASE WHEN list_contains(acc, v[1]) OR list_contains(acc, v[2]) THEN acc ELSE list_append(acc, CASE WHEN v[3] = 1 THEN v[2] ELSE v[1] END) END)) AS pos FROM hits),
paged AS (
  SELECT r.* REPLACE (row_number() OVER (PARTITION BY r.doc_id, page_number ORDER BY y1, r.pos) - 1 AS reading_order) FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos),
{PAIRING}"""


def assembled(blocks: str) -> str:
    """CTEs from blocks (doc_id, page_number, pos, block_type, height, reading_order, content, o, sa, sb) to docs (doc_id, markdown)."""
    return f"""
titles AS (SELECT doc_id, min(height) FILTER (block_type = 'title') AS least, max(height) FILTER (block_type = 'title') AS most FROM {blocks} GROUP BY doc_id),
body AS (
  SELECT b.*, {strip('content')} AS text, least, most, coalesce(lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, o, sa, sb), 0) AS before
  FROM {blocks} b JOIN titles USING (doc_id) WHERE block_type <> 'reference'),
pieces AS (
  SELECT *, CASE WHEN page_number <> before THEN CASE WHEN before > 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) ELSE '' END AS turn,
    CASE WHEN text = '' THEN '' WHEN block_type = 'title' THEN repeat('#', CASE WHEN least = most THEN 2 WHEN (height - least) / CAST(most - least AS DOUBLE) > 0.75 THEN 1
        WHEN (height - least) / CAST(most - least AS DOUBLE) > 0.5 THEN 2 WHEN (height - least) / CAST(most - least AS DOUBLE) > 0.25 THEN 3 ELSE 4 END) || ' ' || text
      WHEN block_type = 'formula' AND text NOT LIKE '$$%' THEN '$$' || chr(10) || text || chr(10) || '$$' ELSE text END AS md FROM body),
bodies AS (
  SELECT doc_id, string_agg(turn || CASE WHEN md = '' THEN '' ELSE '<!-- Source: page ' || page_number || ', block ' || reading_order || ' -->' || chr(10) || md || chr(10) || chr(10) END, '' ORDER BY page_number, reading_order, o, sa, sb) AS markdown FROM pieces GROUP BY doc_id),
refs AS (
  SELECT doc_id, chr(10) || chr(10) || '## References' || chr(10) || chr(10) || string_agg(content || chr(10) || chr(10), '' ORDER BY page_number, reading_order, o, sa, sb) AS refs FROM {blocks} WHERE block_type = 'reference' GROUP BY doc_id),
docs AS (
  SELECT t.doc_id, {rstrip("coalesce(markdown, '') || coalesce(refs, '')")} || chr(10) AS markdown FROM titles t LEFT JOIN bodies USING (doc_id) LEFT JOIN refs USING (doc_id))"""
