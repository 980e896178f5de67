"""DuckDB SQL of the catalogue engine over the synthetic books, stage by stage as common table expressions."""

from __future__ import annotations

from lexiloom.operators import lint
from lexiloom.rules import RULES
from lexiloom.sources import synthetic

_EDGE, _BACK = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-')"


def word(x: str, w: str) -> str:
    return f"regexp_matches({x}, '(?i){_EDGE}{w}{_BACK}')"


def at(x: str, w: str) -> str:
    return f"length(string_split_regex({x}, '(?i){_EDGE}{w}{_BACK}')[1])"


def language(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in RULES.french_words)
    return rf"CASE WHEN regexp_matches(regexp_replace({x}, '[\x00-\x7F]', '', 'g'), '\p{{L}}') OR starts_with(upper({x}), 'SAUCE ') OR list_has_any(string_split({fold(x)}, '-'), [{words}]) THEN 'fr' ELSE 'en' END"


def holds(name: str, wanted: str) -> str:
    return f"contains('-' || {name} || '-', '-' || {wanted} || '-')"


STAGES = {
    "lines": synthetic.SQL.strip(),
    "marked": rf"""marked AS (
  SELECT *, sum(head::INTEGER) OVER s AS entry_no, coalesce(last_value(CASE WHEN chapter THEN {word("coalesce(ahead, '')", "SAUCES?")} END IGNORE NULLS) OVER s, false) AS inside FROM (
    SELECT *, regexp_matches(text, '^\d{{1,4}}—.+$') AS head, regexp_matches(trim(text, {_BLANK}), '^CHAPTER\s+[IVXL]+$') AS chapter,
      first_value(nullif(trim(trim(text, {_BLANK}), '='), '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM lines)
  WINDOW s AS (PARTITION BY source_id ORDER BY idx))""",
    "chapters": f"""chapters AS (
  SELECT source_id, idx AS start_idx, coalesce(lead(idx) OVER (PARTITION BY source_id ORDER BY idx), n)::INTEGER AS end_idx, coalesce(ahead, '') AS title, {word("coalesce(ahead, '')", "SAUCES?")} AS kept
  FROM (SELECT *, max(idx) OVER (PARTITION BY source_id) + 1 AS n FROM marked) WHERE chapter)""",
    "mothers": rf"""said AS (
  SELECT source_id, trim(name, {_BLANK}) AS name FROM (
    SELECT source_id, unnest(string_split_regex(regexp_extract(string_agg(text, chr(10) ORDER BY idx), '(?is)basic sauces?:\s*(.+?)\.', 1), ',|\band\b')) AS name FROM lines GROUP BY source_id)
  WHERE trim(name, {_BLANK}) <> ''),
mothers AS (SELECT DISTINCT source_id, {fold("name")} AS concept FROM said WHERE {fold("name")} <> '')""",
    "entries": rf"""entries AS (
  SELECT source_id, max(CASE WHEN head THEN regexp_extract(text, '^(\d+)—', 1)::INTEGER END) AS entry, max(CASE WHEN head THEN idx END) AS idx,
    max(CASE WHEN head THEN trim(regexp_extract(text, '^\d+—(.+)$', 1), {_BLANK}) END) AS title, bool_or(head AND inside) AS inside,
    trim(coalesce(string_agg(CASE WHEN NOT head THEN text END, chr(10) ORDER BY idx), ''), {_BLANK}) AS body
  FROM marked WHERE entry_no > 0 GROUP BY source_id, entry_no)""",
    "kept": rf"""kept AS (
  SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY idx) - 1)::INTEGER AS seq FROM entries
  WHERE ({word("title", "SAUCE")} AND NOT regexp_matches(title, '(?i),\s*SAUCE{_BACK}') AND (NOT {word("title", "WITH")} OR {at("title", "SAUCE")} < {at("title", "WITH")}))
    OR (inside AND EXISTS (SELECT 1 FROM mothers m WHERE m.source_id = entries.source_id AND list_contains(string_split({fold("title")}, '-'), m.concept))))""",
    "terms": rf"""terms AS (
  SELECT source_id, seq, entry, (row_number() OVER (PARTITION BY source_id, seq ORDER BY i) - 1)::INTEGER AS pos, surface, {language("surface")} AS language, {fold("surface")} AS concept FROM (
    SELECT source_id, seq, entry, i, trim(string_split_regex(title, '(?i)\s+OR\s+')[i], ' .,—') AS surface FROM kept, unnest(range(1, len(string_split_regex(title, '(?i)\s+OR\s+')) + 1)) AS t(i)) WHERE surface <> '')""",
    "unfoldable": rf"""unfoldable AS (
  SELECT source_id, name AS surface FROM said WHERE {fold("name")} = '' UNION SELECT source_id, surface FROM terms WHERE concept = ''
  UNION SELECT source_id, title FROM entries WHERE inside AND {fold("title")} = '')""",
    "draft": f"""draft AS (SELECT k.*, coalesce(t.concept, {fold("title")}) AS concept FROM kept k LEFT JOIN terms t ON k.source_id = t.source_id AND k.seq = t.seq AND t.pos = 0)""",
    "names": """every_name AS (
  SELECT d.source_id, d.seq, d.entry, t.pos, t.concept AS name, d.concept FROM draft d JOIN terms t ON d.source_id = t.source_id AND d.seq = t.seq
  UNION ALL SELECT source_id, seq, entry, 0, concept, concept FROM draft d WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.source_id = d.source_id AND t.seq = d.seq)),
names AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, name ORDER BY seq, pos) AS rn FROM every_name WHERE name <> '') WHERE rn = 1),
places AS (SELECT source_id, entry, max(seq) AS place FROM draft GROUP BY ALL)""",
    "asked": """asked AS (SELECT source_id, concept AS wanted FROM mothers UNION SELECT source_id, name FROM names
  UNION SELECT source_id, split_part(name, '-', 1) FROM names UNION SELECT source_id, 'nowhere-named' FROM names)""",
    "candidates": f"""base_hit AS (
  SELECT m.source_id, m.concept, coalesce(min(CASE WHEN n.name = m.concept THEN n.entry END), arg_min(n.entry, p.place * 1000 + n.pos)) AS key_entry
  FROM mothers m LEFT JOIN names n ON m.source_id = n.source_id AND {holds("n.name", "m.concept")} LEFT JOIN places p ON n.source_id = p.source_id AND n.entry = p.entry GROUP BY ALL),
candidates AS (
  SELECT source_id, name, entry AS key_entry, NULL::VARCHAR AS key_concept, concept AS records, false AS base, seq, pos FROM names n
    WHERE NOT EXISTS (SELECT 1 FROM mothers m WHERE m.source_id = n.source_id AND m.concept = n.name)
  UNION ALL SELECT b.source_id, b.concept, key_entry, CASE WHEN key_entry IS NULL THEN b.concept END, b.concept, true, n.seq, n.pos FROM base_hit b LEFT JOIN names n ON b.source_id = n.source_id AND b.concept = n.name)""",
    "statements": f"""segs AS (
  SELECT source_id, seq, entry, (row_number() OVER (PARTITION BY source_id, seq ORDER BY i) - 1)::INTEGER AS seg, string_split({fold("s")}, '-') AS words FROM (
    SELECT source_id, seq, entry, i, string_split_regex(split_part(body, chr(10) || chr(10), 1), '[.!?;:]')[i] AS s FROM draft, unnest(range(1, len(string_split_regex(split_part(body, chr(10) || chr(10), 1), '[.!?;:]')) + 1)) AS t(i))
  WHERE regexp_matches(s, '[a-zA-Z0-9]')),
widths AS (SELECT DISTINCT source_id, len(string_split(name, '-')) AS width FROM candidates),
grams AS (SELECT g.source_id, seq, entry, seg, (st - 1)::INTEGER AS start, (st - 1 + width)::INTEGER AS stop, width, array_to_string(words[st:st + width - 1], '-') AS gram
  FROM segs g JOIN widths w ON g.source_id = w.source_id, unnest(range(1, len(words) - width + 2)) AS t(st)),
own AS (SELECT source_id, seq, concept AS name FROM terms UNION SELECT source_id, seq, {fold("title")} FROM draft),
statements AS (
  SELECT g.source_id, g.seq, g.entry, seg, start, stop, g.width, c.name, coalesce('entry ' || key_entry, 'base ' || key_concept) AS key, records, base, coalesce(c.seq, 2147483647) AS cseq, coalesce(c.pos, 0) AS cpos
  FROM grams g JOIN candidates c ON g.source_id = c.source_id AND g.gram = c.name
  WHERE (c.key_entry IS NULL OR c.key_entry <> g.entry)
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.source_id = g.source_id AND o.seq = g.seq AND (o.name = c.key_concept OR (NOT c.base AND {holds("o.name", "c.name")}))))""",
    "live": """live AS (SELECT * FROM statements s WHERE NOT EXISTS (
  SELECT 1 FROM statements c WHERE c.source_id = s.source_id AND c.seq = s.seq AND c.seg = s.seg AND c.start <= s.start AND s.stop <= c.stop AND c.width > s.width AND c.key <> s.key))""",
    "stated": """stated AS (
  SELECT source_id, seq, coalesce(min(CASE WHEN base THEN records END), arg_min(records, cseq::BIGINT * 1000 + cpos)) AS parent FROM live GROUP BY ALL HAVING count(DISTINCT key) = 1),
parents AS (SELECT d.source_id, d.entry, arg_max(coalesce(s.parent, ''), d.seq) AS parent FROM draft d LEFT JOIN stated s ON d.source_id = s.source_id AND d.seq = s.seq GROUP BY ALL)""",
    "cyclic": """reached AS (SELECT source_id, records, arg_max(key_entry, coalesce(seq, 2147483647)::BIGINT * 1000 + coalesce(pos, 0)) AS target FROM candidates WHERE key_entry IS NOT NULL GROUP BY ALL),
steps AS (SELECT p.source_id, p.entry, r.target FROM parents p JOIN reached r ON p.source_id = r.source_id AND p.parent = r.records),
walk AS (SELECT source_id, entry AS origin, target AS here FROM steps UNION SELECT w.source_id, w.origin, s.target FROM walk w JOIN steps s ON w.source_id = s.source_id AND w.here = s.entry),
cyclic AS (SELECT DISTINCT source_id, origin AS entry FROM walk WHERE origin = here)""",
    "catalogue": """catalogue AS (
  SELECT d.source_id, d.seq, d.title, d.concept, d.body, d.entry, d.idx + 1 AS line, CASE WHEN c.entry IS NULL THEN nullif(p.parent, '') END AS parent
  FROM draft d JOIN parents p ON d.source_id = p.source_id AND d.entry = p.entry LEFT JOIN cyclic c ON d.source_id = c.source_id AND d.entry = c.entry)""",
    "found": f"""questions AS (SELECT source_id, wanted FROM asked UNION SELECT source_id, parent FROM catalogue WHERE parent IS NOT NULL UNION SELECT source_id, concept FROM catalogue UNION SELECT source_id, concept FROM mothers),
exact AS (SELECT a.source_id, a.wanted, n.seq FROM questions a JOIN names n ON a.source_id = n.source_id AND a.wanted = n.name),
loose AS (
  SELECT a.source_id, a.wanted, n.seq, CASE WHEN m.concept IS NOT NULL THEN 0 ELSE len(string_split(n.name, '-')) END AS by_width, p.place, n.pos
  FROM questions a JOIN names n ON a.source_id = n.source_id AND {holds("n.name", "a.wanted")} JOIN places p ON n.source_id = p.source_id AND n.entry = p.entry
  LEFT JOIN mothers m ON m.source_id = a.source_id AND m.concept = a.wanted
  WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.source_id = a.source_id AND e.wanted = a.wanted)),
ranked AS (SELECT source_id, wanted, seq, 1 AS rank FROM exact UNION ALL
  SELECT source_id, wanted, seq, (row_number() OVER (PARTITION BY source_id, wanted ORDER BY by_width, place, seq, pos))::INTEGER FROM loose),
best AS (SELECT source_id, wanted, seq FROM ranked WHERE rank = 1)""",
    "children": """children AS (
  SELECT q.source_id, q.wanted, c.seq FROM questions q JOIN catalogue c ON q.source_id = c.source_id AND c.parent = q.wanted
  UNION SELECT t.source_id, t.wanted, c.seq FROM best t JOIN best u ON t.source_id = u.source_id AND t.seq = u.seq JOIN catalogue c ON c.source_id = u.source_id AND c.parent = u.wanted)""",
    "tree": """labels AS (SELECT source_id, seq, string_agg(DISTINCT language, '/' ORDER BY language) AS languages FROM terms GROUP BY ALL),
edges AS (SELECT h.source_id, h.wanted, c.seq, c.title, c.concept, coalesce(l.languages, '') AS languages FROM children h JOIN catalogue c ON h.source_id = c.source_id AND h.seq = c.seq LEFT JOIN labels l ON l.source_id = c.source_id AND l.seq = c.seq),
nodes AS (
  SELECT e.source_id, m.concept AS root, [e.seq] AS path, [m.concept] AS seen, title, languages, e.concept, e.concept <> m.concept AS open FROM mothers m JOIN edges e ON m.source_id = e.source_id AND m.concept = e.wanted
  UNION ALL SELECT n.source_id, root, list_append(path, e.seq), list_append(seen, n.concept), e.title, e.languages, e.concept, NOT list_contains(list_append(seen, n.concept), e.concept)
  FROM nodes n JOIN edges e ON n.source_id = e.source_id AND n.concept = e.wanted WHERE n.open)""",
    "up": """hop AS (SELECT c.source_id, c.seq, b.seq AS target FROM catalogue c JOIN best b ON c.source_id = b.source_id AND c.parent = b.wanted),
up AS (SELECT source_id, seq, [seq, target] AS path FROM hop
  UNION ALL SELECT u.source_id, u.seq, list_append(path, h.target) FROM up u JOIN hop h ON u.source_id = h.source_id AND u.path[-1] = h.seq WHERE NOT list_contains(u.path[1:len(u.path) - 1], u.path[-1]))""",
}


DIAGNOSTICS = """SELECT l.source_id, coalesce(e.n, 0) AS entries, coalesce(k.n, 0) AS kept,
  CASE WHEN u.source_id IS NOT NULL THEN 'unfoldable' WHEN e.n IS NULL THEN 'no_entries' WHEN k.n IS NULL THEN 'none_kept' ELSE 'ok' END AS status
FROM (SELECT DISTINCT source_id FROM lines) l LEFT JOIN (SELECT source_id, count(*) AS n FROM entries GROUP BY ALL) e ON l.source_id = e.source_id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM kept GROUP BY ALL) k ON l.source_id = k.source_id LEFT JOIN (SELECT DISTINCT source_id FROM unfoldable) u ON l.source_id = u.source_id"""

#: Lines as they come back from a file: one that holds line ends of its own is several.
READ_BACK = rf"""SELECT source_id, (place - 1)::INTEGER AS idx, (place + 3)::INTEGER AS file_line, text FROM (
  SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY idx, i) AS place, parts[i] AS text
  FROM (SELECT source_id, idx, string_split_regex(text, '{synthetic.SQL_LINE_END}') AS parts FROM lines), unnest(range(1, len(parts) + 1)) AS t(i))"""

STATUSES = rf"""SELECT doc_id::VARCHAR AS source_id, CASE doc_id % 7 WHEN 0 THEN 'not_utf8' WHEN 1 THEN 'no_start' WHEN 2 THEN 'no_end' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 7 > 3 THEN len(string_split_regex(coalesce(text, ''), '{synthetic.SQL_LINE_END}')) ELSE 0 END AS lines FROM documents"""

DAMAGED = """SELECT c.source_id, CASE WHEN seq % 7 > 0 THEN seq END AS seq, CASE seq % 7 WHEN 0 THEN 'not a row of the right form' WHEN 1 THEN 'a field is missing'
  WHEN 2 THEN 'a term has no surface or no known language' WHEN 3 THEN 'a parent folds to nothing' ELSE 'a reference cannot be opened' END AS reason
FROM catalogue c WHERE seq % 7 < 5 AND (seq % 7 <> 2 OR EXISTS (SELECT 1 FROM terms t WHERE t.source_id = c.source_id AND t.seq = c.seq))"""

_NUMBERED = rf"""split AS (SELECT doc_id::VARCHAR AS path, string_split_regex(text, '{synthetic.SQL_LINE_END}') AS parts FROM page),
line AS (SELECT path, i AS number, parts[i] AS line FROM split, unnest(range(1, len(parts) + 1)) AS t(i) WHERE i < len(parts) OR parts[i] <> '')"""

PROSE = rf"""WITH page AS (SELECT doc_id, text FROM documents), {_NUMBERED},
fenced AS (SELECT *, regexp_matches(line, '{lint.FENCE}') AS fence FROM line),
inner_code AS (SELECT *, sum(fence::INTEGER) OVER (PARTITION BY path ORDER BY number) % 2 = 1 AS inside FROM fenced),
masked AS (
  SELECT path, number, CASE WHEN fence THEN '' ELSE regexp_replace(regexp_replace(line, '`[^`]*`', 'CODE', 'g'), '\]\([^)]*\)', ']', 'g') END AS masked
  FROM inner_code WHERE fence OR NOT (inside OR regexp_matches(line, '{lint.TABLE_ROW}'))),
opened AS (SELECT *, trim(masked, {_BLANK}) AS clean, trim(masked, {_BLANK}) = '' OR regexp_matches(masked, '{lint.LIST_ITEM}') AS opens FROM masked),
placed AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY path ORDER BY number) AS unit FROM opened),
units AS (SELECT path, unit::BIGINT AS unit, string_agg(clean, ' ' ORDER BY number) AS prose FROM placed WHERE clean <> '' GROUP BY ALL),
sentences AS (SELECT path, unit, list_filter(string_split_regex(s, '\s+'), lambda w: w <> '') AS ws FROM (SELECT path, unit, unnest(string_split_regex(prose, '[.!?]+[*_`)\]"'']*(?:\s|$)')) AS s FROM units))
SELECT path, unit, 'semicolon' AS rule, '' AS detail FROM units WHERE contains(prose, ';')
UNION ALL SELECT path, unit, 'em dashes', (length(prose) - length(replace(prose, '—', '')))::VARCHAR FROM units WHERE length(prose) - length(replace(prose, '—', '')) > {lint.MAX_DASHES}
UNION ALL SELECT path, unit, 'praise', w FROM units, (SELECT unnest([{", ".join(f"'{w}'" for w in lint.PRAISE)}]) AS w) WHERE regexp_matches(prose, '(?i){_EDGE}' || w || '{_BACK}')
UNION ALL SELECT path, unit, 'long sentence', len(ws) || ': ' || array_to_string(ws[1:8], ' ') FROM sentences WHERE len(ws) > {lint.MAX_WORDS}"""

FENCES = f"""WITH page AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || chr(10) || '```' || chr(10) || 'code' ELSE text END AS text FROM documents), {_NUMBERED}
SELECT path FROM line GROUP BY path HAVING count(*) FILTER (regexp_matches(line, '{lint.FENCE}')) % 2 = 1"""

TERMS = f"""WITH page AS (SELECT doc_id, text FROM documents), {_NUMBERED},
hit AS (SELECT path, number::INTEGER AS number, trim(line, {_BLANK}) AS line, len(regexp_extract_all(line, '(?i)License'))::INTEGER AS hits FROM line WHERE regexp_matches(line, '(?i)License')),
allowed AS (SELECT doc_id::VARCHAR AS path FROM documents WHERE source = 'src0')
SELECT 'banned' AS kind, path, number, line, hits FROM hit WHERE path NOT IN (SELECT path FROM allowed)
UNION ALL SELECT 'allowed', path, NULL, NULL, sum(hits)::INTEGER FROM hit WHERE path IN (SELECT path FROM allowed) GROUP BY path
UNION ALL SELECT 'stale', path, NULL, NULL, 0 FROM allowed WHERE path NOT IN (SELECT path FROM hit)"""

#: The recipe of ``synthetic.spoilt`` on the lines of sound books.
FAULTY = """spoilt AS (
  SELECT source_id || '/headless' AS source_id, idx, text FROM sound WHERE NOT regexp_matches(text, '^\\d{1,4}—')
  UNION ALL SELECT source_id || '/plain', idx, replace(replace(text, 'SAUCE', 'DISH'), 'sauce', 'dish') FROM sound
  UNION ALL SELECT source_id || '/nameless', idx, text FROM sound UNION ALL SELECT source_id || '/nameless', (max(idx) + 1)::INTEGER, '9999—SAUCE OR ***' FROM sound GROUP BY source_id)"""


def sql(upto: str, select: str, other_lines: str | None = None) -> str:
    """The stages up to the named one, then the question; ``other_lines`` makes a table ``spoilt`` of the lines, here ``sound``, to start from."""
    names = list(STAGES)
    stages = [STAGES[n] for n in names[: names.index(upto) + 1]]
    if other_lines:
        stages[0] = stages[0].replace("lines AS (", "sound AS (")
        stages[1:1] = [other_lines, "lines AS (SELECT * FROM spoilt)"]
    return "WITH RECURSIVE " + ",\n".join(stages) + "\n" + select
