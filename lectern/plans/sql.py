"""SQL pieces that the oracles share: the same inputs and column functions for DuckDB."""

from __future__ import annotations

SPACE = r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BLANKS = "(" + " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)) + ")"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}''-]*"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{WORD}')) AS BIGINT)"


def pause(x: str) -> str:
    last = f"right({trim(x)}, 1)"
    return f"CASE WHEN {last} IN ('.', '!', '?') THEN 0.35 WHEN {last} IN (':', ';') THEN 0.25 ELSE 0.12 END"


def seconds(w: str) -> str:
    return f"(CAST({w} AS DOUBLE) / 165.0 * 60)"


def normalize(x: str) -> str:
    """The tables hold no characters that compatibility forms or the fixed maps would change, but quotes and dashes."""
    for pattern, put in (
        (r"[\x{2018}\x{2019}\x{201a}\x{201b}\x{2032}]", "''"), (r"[\x{201c}\x{201d}\x{201e}\x{201f}\x{2033}]", '"'), (r"[\x{2010}-\x{2015}]", "-"), (r"\x{2026}", "..."),
        (r"[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "), (r"[\x{200b}-\x{200d}\x{feff}\x{00ad}]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{2500}-\x{257f}]", ""),
        (r"\r\n?", "\\n"), (r"\t", " "), (r"([a-z])-\n([a-z])", r"\1\2"), (r"([^\n.!?:;\"'')\]])\n([a-z(\"''])", r"\1 \2"), (r"([^\n.!?:;\"'')\]])\n([a-z(\"''])", r"\1 \2"),
        (r" {2,}", " "), (r" +\n", "\\n"), (r"\n[ \t]+", "\\n"), (r"\n{3,}", "\\n\\n"),
    ):
        put = "'" + put.replace("\\n", "' || chr(10) || '") + "'" if "\\n" in put else f"'{put}'"
        x = f"regexp_replace({x}, '{pattern}', {put}, 'g')"
    return trim(x)


def pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), CAST(greatest({n}, length(CAST({x} AS VARCHAR))) AS INTEGER), '0')"


def timecode(t: str, sep: str) -> str:
    ms = f"greatest(0, CAST(floor(({t}) * 1000 + 0.5) AS BIGINT))"
    return f"{pad(f'({ms} // 3600000)', 2)} || ':' || {pad(f'({ms} // 60000 % 60)', 2)} || ':' || {pad(f'({ms} // 1000 % 60)', 2)} || '{sep}' || {pad(f'({ms} % 1000)', 3)}"


def clock(t: str) -> str:
    s = f"greatest(0, CAST(floor({t}) AS BIGINT))"
    return f"CASE WHEN {s} >= 3600 THEN CAST({s} // 3600 AS VARCHAR) || ':' || {pad(f'({s} % 3600 // 60)', 2)} || ':' || {pad(f'({s} % 60)', 2)} ELSE CAST({s} // 60 AS VARCHAR) || ':' || {pad(f'({s} % 60)', 2)} END"


def wrap(x: str) -> str:
    """Two lines at the last blank up to the middle, or the next blank if that lies left of a quarter."""
    head = f"substring({x}, 1, length({x}) // 2 + 1)"
    left = f"(CASE WHEN contains({head}, ' ') THEN length({head}) - instr(reverse({head}), ' ') ELSE -1 END)"
    tail = f"substring({x}, length({x}) // 2 + 1)"
    right = f"(CASE WHEN contains({tail}, ' ') THEN length({x}) // 2 + instr({tail}, ' ') - 1 ELSE -1 END)"
    cut = f"(CASE WHEN {left} < length({x}) * 0.25 THEN {right} ELSE {left} END)"
    return f"CASE WHEN length({x}) <= 42 OR {cut} <= 0 THEN {x} ELSE substring({x}, 1, {cut}) || chr(10) || substring({x}, {cut} + 2) END"


LINES = """
raw_lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM raw_lines)
"""

CUES = LINES + ", cues AS (SELECT doc_id AS track_id, line_no AS cue_no, CAST(line_no * 2 AS DOUBLE) AS start, CAST(line_no * 2 AS DOUBLE) + 1.8::DOUBLE AS stop, line AS body FROM raw_lines)"

PASSAGES = (
    LINES
    + f""",
inked AS (SELECT * FROM lines WHERE regexp_matches(line, '[^{SPACE}]')),
counted AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS passage_index, line AS body, start, CAST(start + length(line) AS INTEGER) AS stop, {words("line")} AS words FROM inked),
passages AS (SELECT *, 'sec-' || (passage_index // 5) AS section_id, 'Section ' || (passage_index // 5 + 1) AS section_title, {seconds("words")} + {pause("body")} AS est_seconds FROM counted),
timed AS (SELECT *, sum(est_seconds) OVER (PARTITION BY doc_id ORDER BY passage_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cue_end FROM passages)
"""
)

PAGES = """
page_lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1) // 4 AS page_no, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""

EVENTS = "ev AS (SELECT user_id AS session, event_id, CAST(floor(event_id / 7 % 5) AS INTEGER) AS epoch, ts, value AS elapsed, event_type = 'error' AS resumed, event_type FROM events)"


def sentences(source: str, abbreviations: tuple[str, ...]) -> str:
    """CTEs up to ``spans`` (doc_id, start, stop): the sentences of ``source`` (doc_id, body)."""
    known = ", ".join(f"'{a}'" for a in abbreviations)
    return rf"""
found AS (SELECT doc_id, regexp_extract_all(body, '(?s).*?(?:[.!?]+["'')\]]*(?:[{SPACE}]+|$)|\n{{2,}})|.+$') AS l FROM {source}),
cut AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM found),
ended AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS stop, regexp_extract({trim("piece")}, '([\p{{L}}.]+)\.$', 1) AS word FROM cut),
short AS (SELECT *, word <> '' AND (regexp_replace(lower(word), '\.$', '') IN ({known}) OR regexp_matches(word, '^\p{{Lu}}$')) AS abbreviated FROM ended),
opening AS (SELECT *, CASE WHEN coalesce(lag(abbreviated) OVER (PARTITION BY doc_id ORDER BY i), FALSE) THEN 0 ELSE 1 END AS opens FROM short),
joined AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM opening),
spans AS (SELECT doc_id, CAST(min(stop - length(piece)) AS INTEGER) AS start, max(stop) AS stop FROM joined GROUP BY doc_id, n HAVING bool_or(regexp_matches(piece, '[^{SPACE}]')))
"""


def units(source: str, most: int) -> str:
    """CTE ``units`` (doc_id, a, b, whole_start): ``spans`` of ``source`` (doc_id, body) in pieces of at most ``most`` characters."""

    def cut(a: str) -> str:
        window = f"substring(body, {a} + 1, {most})"
        clause = rf"length(regexp_extract({window}, '(?s)^(.*)[;:,)\-]', 1))"
        blank = f"CASE WHEN contains({window}, ' ') THEN {most} - instr(reverse({window}), ' ') ELSE 0 END"
        return f"CASE WHEN stop - {a} <= {most} THEN stop WHEN {clause} >= {most // 2} THEN {a} + {clause} + 1 ELSE {a} + greatest({blank}, {most // 2}) END"

    return f"""
pieces AS (
  SELECT s.doc_id, s.start AS whole_start, s.start AS a, CAST({cut("s.start")} AS INTEGER) AS b, s.stop FROM spans s JOIN {source} d ON d.doc_id = s.doc_id
  UNION ALL
  SELECT p.doc_id, p.whole_start, p.b, CAST({cut("p.b")} AS INTEGER), p.stop FROM pieces p JOIN {source} d ON d.doc_id = p.doc_id WHERE p.b < p.stop),
units AS (SELECT doc_id, a, b, whole_start FROM pieces WHERE a < b)
"""


def packed(source: str, most: int, least: int, abbreviations: tuple[str, ...]) -> str:
    """CTEs (for WITH RECURSIVE) up to ``packed``: the passages of ``source`` (doc_id, body) under the literal paragraph rule."""
    gap = "substring(body, greatest(0, before - 4) + 1, a + 2 - greatest(0, before - 4))"
    return f"""{sentences(source, abbreviations)}, {units(source, most)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM units),
seamed AS (SELECT u.*, coalesce(regexp_matches({gap}, '\\n[{SPACE}]*\\n[{SPACE}]*$'), FALSE) AS seam FROM numbered u JOIN {source} d ON d.doc_id = u.doc_id),
greedy AS (
  SELECT doc_id, i, a AS first, a, b, 0 AS part FROM seamed WHERE i = 1
  UNION ALL
  SELECT u.doc_id, u.i, CASE WHEN {(opens := f"g.b - g.first + u.b - u.a > {most} OR u.seam AND g.b - g.first >= {least}")} THEN u.a ELSE g.first END, u.a, u.b,
    g.part + CASE WHEN {opens} THEN 1 ELSE 0 END FROM greedy g JOIN seamed u ON u.doc_id = g.doc_id AND u.i = g.i + 1),
held AS (SELECT doc_id, part, min(a) AS first, max(b) AS last, list({{'a': a, 'b': b}}) AS l FROM greedy GROUP BY 1, 2),
bodies AS (SELECT h.*, substring(d.body, first + 1, last - first) AS whole FROM held h JOIN {source} d ON d.doc_id = h.doc_id),
trimmed AS (SELECT doc_id, part, l, {trim("whole")} AS body, first + length(whole) - length(regexp_replace(whole, '^[{SPACE}]+', '')) AS start FROM bodies),
placed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS passage_index, body, CAST(start AS INTEGER) AS start, CAST(start + length(body) AS INTEGER) AS stop, l FROM trimmed WHERE body <> ''),
packed AS (SELECT *, {words("body")} AS words, {seconds(words("body"))} + {pause("body")} AS est_seconds,
  CAST(len(list_filter(l, lambda x: greatest(0, x.a - start) < least(length(body), x.b - start))) AS INTEGER) AS sentences FROM placed)
"""


def word_tokens(abbreviations: tuple[str, ...]) -> str:
    """CTEs (for WITH RECURSIVE, after PASSAGES) up to ``word_tokens``: the paced word tokens of passages that hold no line ends."""
    known = ", ".join(f"'{a}'" for a in abbreviations)
    closers = "[\"'')\\]]*$"
    letters = r"[\p{L}\p{Nl}\p{No}]"

    def cut(a: str) -> str:
        window = f"substring(word, {a} + 1, even + 1)"
        hyphen = f"CASE WHEN contains({window}, '-') THEN length({window}) - instr(reverse({window}), '-') ELSE -1 END"
        return f"CASE WHEN length(word) - {a} <= even THEN length(word) WHEN {hyphen} >= greatest(2, even // 2) THEN {a} + {hyphen} + 1 ELSE {a} + even END"

    return rf"""
chunks AS (SELECT doc_id, passage_index, start AS base, generate_subscripts(l, 1) AS k, unnest(l) AS chunk, len(l) AS n FROM (SELECT *, regexp_extract_all(body, '[{SPACE}]*[^{SPACE}]+') AS l FROM passages)),
worded AS (SELECT doc_id, passage_index, base, k, k = n AS final, regexp_replace(chunk, '^[{SPACE}]+', '') AS word,
  sum(length(chunk)) OVER (PARTITION BY doc_id, passage_index ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM chunks),
signed AS (SELECT *, CAST(base + stop - length(word) AS INTEGER) AS at, regexp_matches(word, '[0-9]') AND NOT regexp_matches(word, '{letters}{{3,}}') AS numeric_word,
  regexp_matches(word, '[.!?]{closers}') AS stops, regexp_matches(word, '[,;:]{closers}') AS clause, regexp_extract(word, '([\p{{L}}\p{{Nl}}\p{{No}}.]+)\.$', 1) AS short FROM worded),
said AS (SELECT *, stops AND NOT numeric_word AND NOT (short <> '' AND (regexp_replace(lower(short), '\.$', '') IN ({known}) OR regexp_matches(short, '^\p{{Lu}}$'))) AS sentence,
  CASE WHEN length(word) <= 16 THEN length(word) ELSE (length(word) + (length(word) + 11) // 12 - 1) // ((length(word) + 11) // 12) END AS even FROM signed),
parts AS (
  SELECT doc_id, passage_index, k, 0 AS a, CAST({cut("0")} AS INTEGER) AS b, word, even FROM said
  UNION ALL SELECT doc_id, passage_index, k, b, CAST({cut("b")} AS INTEGER), word, even FROM parts WHERE b < length(word)),
word_tokens AS (
  SELECT p.doc_id, p.passage_index, CAST(row_number() OVER (PARTITION BY p.doc_id, p.passage_index ORDER BY p.k, p.a) - 1 AS INTEGER) AS token_no, substring(p.word, p.a + 1, p.b - p.a) AS body,
    substring(p.word, p.a + 1, p.b - p.a) || CASE WHEN p.b = length(p.word) THEN '' ELSE '-' END AS display, CAST(s.at + p.a AS INTEGER) AS start, CAST(s.at + p.b AS INTEGER) AS stop,
    p.b = length(p.word) AND s.sentence AS ends_sentence, p.b = length(p.word) AND s.clause AS ends_clause, p.b = length(p.word) AND s.final AS ends_paragraph, s.numeric_word, p.b < length(p.word) AS continued
  FROM parts p JOIN said s ON s.doc_id = p.doc_id AND s.passage_index = p.passage_index AND s.k = p.k)
"""


def pivot(display: str) -> str:
    """The letter to fixate, a little left of the middle of the first run of letters and digits."""
    lead = rf"(CASE WHEN regexp_matches({display}, '[\p{{L}}\p{{N}}]') THEN length(regexp_extract({display}, '^[^\p{{L}}\p{{N}}]*')) ELSE 0 END)"
    core = rf"length(regexp_extract(substring({display}, {lead} + 1), '^[\p{{L}}\p{{N}}]*'))"
    return f"CAST(least(length({display}) - 1, {lead} + CASE WHEN {core} <= 1 THEN 0 WHEN {core} <= 5 THEN 1 WHEN {core} <= 9 THEN 2 WHEN {core} <= 13 THEN 3 ELSE 4 END) AS INTEGER)"


def weight(t: str = "") -> str:
    """The dwell weight of a row of ``word_tokens``."""
    return f"""(1 + CASE WHEN length({t}display) > 8 THEN least(0.6::DOUBLE, (length({t}display) - 8) * 0.04::DOUBLE) ELSE 0 END)
   * CASE WHEN {t}ends_paragraph THEN 2.6::DOUBLE WHEN {t}ends_sentence THEN 2.1::DOUBLE WHEN {t}ends_clause THEN 1.45::DOUBLE ELSE 1 END
   * CASE WHEN {t}numeric_word THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN {t}continued THEN 0.8::DOUBLE ELSE 1 END"""


def plain_parts(source: str, most: int = 12_000) -> str:
    """CTEs (for WITH RECURSIVE) up to ``plain_parts``: ``source`` (doc_id, body) without two headings, in blocks cut at blank lines."""

    def cut(a: str) -> str:
        window = f"substring(body, {a} + 1, {most + 2})"
        gap = f"length(regexp_extract({window}, '(?s)^(.*)\\n\\n', 1))"
        return f"CASE WHEN length(body) - {a} <= {most} THEN length(body) WHEN {gap} > {most // 2} THEN {a} + {gap} ELSE {a} + {most} END"

    return f"""
blocks AS (
  SELECT doc_id, 0 AS part_no, 0 AS a, CAST({cut("0")} AS INTEGER) AS b, body FROM {source} WHERE body <> ''
  UNION ALL SELECT doc_id, part_no + 1, b, CAST({cut("b")} AS INTEGER), body FROM blocks WHERE b < length(body)),
plain_parts AS (
  SELECT doc_id, CAST(part_no AS INTEGER) AS part_no, CASE WHEN length(body) <= {most} THEN NULL ELSE 'Part ' || (part_no + 1) END AS title, substring(body, a + 1, b - a) AS body FROM blocks
  UNION ALL SELECT doc_id, 0, NULL, '' FROM {source} WHERE body = '')
"""
