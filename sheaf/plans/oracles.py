"""The registered queries as SQL for DuckDB.

Written from the rules, not from the operators: where an operator uses a closed form
or one regular expression, the SQL walks step by step (recursive CTEs), and bytes are
handled as hexadecimal pairs.
"""

from __future__ import annotations

from sheaf.functions import constants
from sheaf.functions.constants import (
    DEFAULT_IGNORE_PATTERNS,
    DEFAULT_MAX_FILE_SIZE,
    LANGUAGE_BY_EXTENSION,
    LANGUAGE_BY_SHEBANG,
    SPACE_CLASS,
)
from sheaf.plans import queries as q

_WORD = f"'[^{SPACE_CLASS}]+'"

# White space and line feeds in bytes written as "XX " pairs.
_PAIR_SPACE = (
    "(?:(?:09|0A|0B|0C|0D|20|C2 85|C2 A0|E1 9A 80|E2 80 8[0-9A]|E2 80 A[89F]|E2 81 9F|E3 80 80) )"
)


def _rows(*values: tuple) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in values)


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {_WORD})) AS BIGINT)"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def _pairs(hexed: str) -> str:
    return f"regexp_replace({hexed}, '(..)', '\\1 ', 'g')"


def _pair_newlines(pairs: str) -> str:
    return f"CAST((length({pairs}) - length(replace({pairs}, '0A ', ''))) / 3 AS BIGINT)"


_FILES_RAW = """
files_raw AS (
  SELECT doc_id,
    concat(CASE doc_id % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/pkg/'
             WHEN 2 THEN 'src/node_modules/' WHEN 3 THEN '' ELSE 'vendor/' END,
           lang, '_', CAST(doc_id AS VARCHAR),
           CASE doc_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.MD'
             WHEN 3 THEN '.tar.js' WHEN 4 THEN '' ELSE '.xyz' END) AS path,
    CASE WHEN doc_id % 6 = 4
         THEN concat('#!/usr/bin/env ',
                     CASE WHEN doc_id % 4 = 0 THEN 'python' ELSE 'bash' END, chr(10), text)
         ELSE text END AS content
  FROM documents)"""

FILES = f"""{_FILES_RAW},
files AS (
  SELECT doc_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS size, content
  FROM files_raw)"""

COMMENTED = """
commented AS (
  SELECT doc_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '\\.\\n', concat(chr(10), chr(10), chr(10)), 'g'),
      ' the ', '/*', 'g'), ' and ', '*/', 'g'), ' of ', ' // ', 'g') AS content
  FROM documents)"""

COMMENTED_FILES = f"""{_FILES_RAW},{COMMENTED},
files AS (
  SELECT doc_id, path, CAST(octet_length(encode(c.content)) AS BIGINT) AS size, c.content
  FROM files_raw JOIN commented c USING (doc_id))"""

BINARIES = """
binaries AS (
  SELECT doc_id,
    CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[aeiou ]', chr(1), 'g')
         ELSE text END AS content
  FROM documents)"""

MIXED_FILES = f"""{_FILES_RAW},{COMMENTED},{BINARIES},
files AS (
  SELECT doc_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS size, content
  FROM (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN b.content ELSE c.content END AS content
        FROM files_raw JOIN commented c USING (doc_id) JOIN binaries b USING (doc_id)))"""

PATHS = """
paths AS (
  SELECT path FROM (
    SELECT rtrim(regexp_extract(url, '^https?://([^?#]+)', 1), '/') AS path FROM pages)
  WHERE path <> '')"""

SELECTED = """
selected AS (
  SELECT user_id AS doc_id FROM events GROUP BY user_id HAVING count(*) % 2 = 1)"""


def _ignored(source: str, patterns: tuple[str, ...]) -> str:
    """ignored(path): paths of which some leading part matches a glob or 'dir/*'."""
    return f"""
patterns(pattern) AS (VALUES {_rows(*[(p,) for p in patterns])}),
parts_above AS (
  SELECT path, array_to_string(parts[1:n], '/') AS part
  FROM (SELECT path, string_split(path, '/') AS parts,
               unnest(range(1, len(string_split(path, '/')) + 1)) AS n
        FROM (SELECT DISTINCT path FROM {source}))),
ignored AS (
  SELECT DISTINCT path FROM parts_above, patterns
  WHERE (part GLOB pattern
         AND length(replace(part, '/', '')) - length(part)
           = length(replace(pattern, '/', '')) - length(pattern))
     OR (ends_with(pattern, '/*') AND starts_with(path, left(pattern, length(pattern) - 1))))"""


_EXTENSIONS = f"extensions(ext, lang) AS (VALUES {_rows(*LANGUAGE_BY_EXTENSION.items())})"
_SHEBANGS = f"shebangs(name, lang) AS (VALUES {_rows(*LANGUAGE_BY_SHEBANG.items())})"


def _languages(source: str) -> str:
    """languages(path, language) of a table with path and content."""
    return f"""
{_EXTENSIONS},
{_SHEBANGS},
by_shebang AS (
  SELECT path, arg_max(lang, (length(name), -ascii(name))) AS lang
  FROM {source}, shebangs
  WHERE starts_with(content, '#!') AND contains(string_split(content, chr(10))[1], name)
  GROUP BY path),
languages AS (
  SELECT f.path, coalesce(e.lang, s.lang, 'unknown') AS language
  FROM {source} f
  LEFT JOIN extensions e
    ON e.ext = lower(regexp_extract(f.path, '(\\.[^./]*)$', 1))
  LEFT JOIN by_shebang s ON s.path = f.path)"""


def _stripped(source: str) -> str:
    """stripped(doc_id, content): the line state machine, one line per step."""
    cut = lambda text, mark: f"left({text}, instr({text}, '{mark}') - 1)"
    return f"""
lines AS (
  SELECT doc_id, i, rtrim(line, chr(13)) AS line, regexp_extract(line, '^[ \\t]*') AS indent
  FROM (SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS i,
               len(pieces) AS n
        FROM (SELECT doc_id, string_split(content, chr(10)) AS pieces FROM {source}))
  WHERE NOT (i = n AND line = '')),
steps AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, false AS opened, 'none' AS kind, '' AS text
  FROM (SELECT DISTINCT doc_id FROM lines)
  UNION ALL
  SELECT doc_id, i,
    CASE WHEN blank OR swallowed THEN opened ELSE contains(a, '/*') END,
    CASE WHEN blank THEN 'blank' WHEN swallowed OR {_trim("c")} = '' THEN 'gone' ELSE 'code' END,
    c
  FROM (
    SELECT *, CASE WHEN contains(b, '//') THEN concat(indent, {_trim(cut("b", "//"))}) ELSE b END AS c
    FROM (
      SELECT *,
        CASE WHEN contains(a, '/*') THEN concat(indent, {_trim(cut("a", "/*"))}) ELSE a END AS b
      FROM (
        SELECT s.doc_id, l.i, s.opened, l.indent,
          {_trim("l.line")} = '' AS blank,
          s.opened AND NOT contains(l.line, '*/') AS swallowed,
          CASE WHEN s.opened AND contains(l.line, '*/')
               THEN concat(l.indent, {_trim("substr(l.line, instr(l.line, '*/') + 2)")})
               ELSE l.line END AS a
        FROM steps s JOIN lines l ON l.doc_id = s.doc_id AND l.i = s.i + 1)))),
printed AS (
  SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM steps WHERE kind IN ('blank', 'code')),
stripped AS (
  SELECT d.doc_id, coalesce(k.content, '') AS content
  FROM {source} d LEFT JOIN (
    SELECT doc_id,
      rtrim(concat(CASE WHEN arg_min(kind, i) = 'blank' THEN chr(10) ELSE '' END,
                   string_agg(CASE WHEN kind = 'blank' THEN '' ELSE text END, chr(10) ORDER BY i)),
            chr(10)) AS content
    FROM printed WHERE NOT (kind = 'blank' AND before IS NOT DISTINCT FROM 'blank')
    GROUP BY doc_id) k USING (doc_id))"""


def _windows(source: str, key: str, size: int, overlap: int) -> str:
    """chunks of a table with key and content: windows found one after the other."""
    return f"""
bytes AS (
  SELECT {key}, {_pairs("hex(encode(content))")} AS pairs,
         CAST(octet_length(encode(content)) AS BIGINT) AS n
  FROM {source} WHERE content <> ''),
windows AS (
  SELECT {key}, n, CAST(0 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS pos, n <= {size} AS last FROM bytes
  UNION ALL
  SELECT {key}, n, idx + 1, next, n - next <= {overlap}
  FROM (SELECT *, pos + greatest(1, least({size}, n - pos) - {overlap}) AS next
        FROM windows WHERE NOT last)
  WHERE next < n),
cut AS (
  SELECT {key}, idx, pos, left(pairs, 3 * pos) AS head,
    CASE WHEN last THEN substr(pairs, 3 * pos + 1) ELSE substr(pairs, 3 * pos + 1, 3 * {size}) END AS raw
  FROM windows JOIN bytes USING ({key})),
chunks AS (
  SELECT {key}, CAST(idx AS INTEGER) AS chunk_idx, pos AS start,
    concat(replace(regexp_replace(regexp_replace(raw, '^{_PAIR_SPACE}+', ''),
                                  '{_PAIR_SPACE}+$', ''), ' ', ''), '0A') AS content_hex,
    1 + {_pair_newlines("head")} AS start_line,
    1 + {_pair_newlines("concat(head, left(raw, length(raw) - 3))")} AS end_line,
    CAST(len(regexp_extract_all(regexp_replace(raw, '{_PAIR_SPACE}+', '_', 'g'), '[^_]+')) AS BIGINT)
      AS token_count
  FROM cut)"""


_CHUNK_COLUMNS = "chunk_idx, start, content_hex, start_line, end_line, token_count"
_SEGMENTS = "regexp_extract_all({0}, '<[^>]*>\\n?|[^\\n]*\\n|[^\\n]+')"


def _packs(source: str, key: str, column: str, size: int, tokens: int) -> str:
    """Packs of a table's segments: one segment per step."""
    segments = _SEGMENTS.format(column)
    return _with(
        f"""
segments AS (
  SELECT {key}, i, segment, CAST(octet_length(encode(segment)) AS BIGINT) AS size,
         {_tokens("segment")} AS tokens
  FROM (SELECT {key}, unnest(s) AS segment, generate_subscripts(s, 1) AS i
        FROM (SELECT {key}, {segments} AS s FROM {source}))),
steps AS (
  SELECT {key}, i, segment, CAST(0 AS BIGINT) AS pack, size AS held, tokens AS held_tokens
  FROM segments WHERE i = 1
  UNION ALL
  SELECT {key}, i, segment, pack + CASE WHEN closes THEN 1 ELSE 0 END,
    CASE WHEN closes THEN size ELSE held + size END,
    CASE WHEN closes THEN tokens ELSE held_tokens + tokens END
  FROM (SELECT s.{key}, g.i, g.segment, g.size, g.tokens, s.pack, s.held, s.held_tokens,
               s.held >= {size} OR s.held_tokens + g.tokens > {tokens} AS closes
        FROM steps s JOIN segments g ON g.{key} = s.{key} AND g.i = s.i + 1)),
packed AS (
  SELECT {key}, pack, string_agg(segment, '' ORDER BY i) AS content,
         CAST(sum({_tokens("segment")}) AS BIGINT) AS token_count
  FROM steps GROUP BY {key}, pack),
placed AS (
  SELECT *,
    coalesce(string_agg(content, '') OVER (PARTITION BY {key} ORDER BY pack
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS head
  FROM packed)""",
        recursive=True,
    ) + f"""
SELECT {key}, CAST(pack AS INTEGER) AS chunk_idx,
  CAST(octet_length(encode(head)) AS BIGINT) AS start,
  hex(encode(content)) AS content_hex,
  CAST(len(string_split(head, chr(10))) AS BIGINT) AS start_line,
  CAST(len(string_split(concat(head, left(content, length(content) - 1)), chr(10))) AS BIGINT)
    AS end_line,
  token_count
FROM placed"""


def _fuzzy(queries: tuple[str, ...]) -> str:
    patterns = [(text, "(?is)" + ".*?".join("\\" + c if c == "." else c for c in text)) for text in queries]
    return _with(
        PATHS,
        f"queries(query, pattern) AS (VALUES {_rows(*patterns)})",
        """
hits AS (
  SELECT query, path, regexp_extract(path, pattern) AS found
  FROM paths, queries WHERE regexp_matches(path, pattern)),
ranked AS (
  SELECT query, path, CAST(length(found) AS BIGINT) AS span,
    CAST(instr(path, found) - 1 AS BIGINT) AS start,
    row_number() OVER (PARTITION BY query
      ORDER BY length(found), instr(path, found), length(path), path) AS rank
  FROM hits)""",
    )


def _aligned(query: str) -> str:
    """scored(path, score): the best of all ways to find the letters, one letter more a step."""
    separators = constants.ALIGN_SEPARATORS.replace("'", "''")
    return _with(
        PATHS,
        f"letters(i, letter) AS (VALUES {_rows(*enumerate(query.lower()))})",
        f"""
chars AS (
  SELECT path, place, path[place + 1] AS c,
    CASE WHEN place = 0 THEN {constants.ALIGN_START} ELSE 0 END
    + CASE WHEN place > 0 AND contains('{separators}', path[place]) THEN {constants.ALIGN_AFTER_SEPARATOR} ELSE 0 END
    + CASE WHEN place > 0 AND regexp_matches(path[place:place + 1], '^\\p{{Ll}}\\p{{Lu}}$')
           THEN {constants.ALIGN_CAMEL_CASE} ELSE 0 END AS gain
  FROM (SELECT path, unnest(range(length(path))) AS place FROM (SELECT DISTINCT path FROM paths))),
ways AS (
  SELECT path, 0 AS i, place,
    gain - least({constants.ALIGN_LEADING_GAP} * place, {constants.ALIGN_MOST_LEADING_GAP}) AS score
  FROM chars JOIN letters ON i = 0 AND lower(c) = letter
  UNION ALL
  SELECT w.path, w.i + 1, c.place,
    w.score + c.gain + CASE WHEN c.place = w.place + 1 THEN {constants.ALIGN_ADJACENT} ELSE 0 END
  FROM ways w JOIN chars c ON c.path = w.path AND c.place > w.place
    JOIN letters l ON l.i = w.i + 1 AND lower(c.c) = l.letter),
scored AS (
  SELECT path, CAST(max(score) - {constants.ALIGN_UNMATCHED} * (length(path) - {len(query)}) AS BIGINT) AS score
  FROM ways WHERE i = {len(query) - 1} GROUP BY path)""",
        recursive=True,
    )


_LINES = """
lines AS (
  SELECT doc_id, i - 1 AS line_no, line, n
  FROM (SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS i,
               len(pieces) AS n
        FROM (SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents)))"""

_MATCH = f"contains(lower(line), '{q.LINE_QUERY.lower()}')"

_TREE = """
nodes AS (
  SELECT DISTINCT parts[1:n] AS parts
  FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n
        FROM paths)),
tree AS (
  SELECT '.' AS root, '' AS path, CAST(-1 AS BIGINT) AS depth, '.' AS line
  UNION ALL
  SELECT '.', array_to_string(parts, '/'), CAST(len(parts) - 1 AS BIGINT),
    concat(repeat('  ', len(parts) - 1), '├── ', parts[len(parts)])
  FROM nodes)"""
_NODES = f"{PATHS},{_TREE}"


def _tree_ignored(patterns: tuple[str, ...]) -> str:
    """Paths that the tree leaves out, of ``paths``."""
    return f"""
patterns(pattern) AS (VALUES {_rows(*[(p,) for p in patterns])}),
names AS (SELECT path, unnest(string_split(path, '/')) AS name FROM (SELECT DISTINCT path FROM paths)),
tree_ignored AS (
  SELECT path FROM names, patterns WHERE contains(pattern, '*') AND name GLOB pattern
  UNION
  SELECT path FROM paths, patterns WHERE NOT contains(pattern, '*') AND contains(path, pattern))"""


_WRITTEN = _with(FILES) + f"""
SELECT path, md5(content) AS content_md5 FROM files"""

_CONTEXT = (
    _with(FILES, "paths AS (SELECT path FROM files)", _TREE)
    + "SELECT '/work & <tree>' AS cwd, line, count(*) AS n FROM tree GROUP BY line"
)

_KEPT = f"""
kept AS (
  SELECT * FROM files
  WHERE size <= {DEFAULT_MAX_FILE_SIZE} AND path NOT IN (SELECT path FROM ignored))"""

_ANY_SIZE = """
kept AS (SELECT * FROM files WHERE path NOT IN (SELECT path FROM ignored))"""


def _is_binary(content: str) -> str:
    head = _pairs(f"left(hex(encode({content})), 1024)")
    bad = "'(?:0[0-8EF]|1[0-9A-F]|7F|8[0-46-9A-F]|9[0-9A-F]|AD) '"
    return f"coalesce(len(regexp_extract_all({head}, {bad})) / nullif(length({head}) / 3, 0) > 0.3, false)"


ORACLES: dict[str, str] = {
    "tokens_by_file": _with(
        FILES, _ignored("files", DEFAULT_IGNORE_PATTERNS), _KEPT, _languages("kept")
    )
    + f"""
SELECT doc_id, path, language, {_tokens("content")} AS token_count
FROM kept JOIN languages USING (path)""",
    "tree_scan": f"""
SELECT concat('lang=', lang) AS directory,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size,
  CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS content_bytes,
  CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS newlines,
  CAST(sum({_tokens("text")}) AS BIGINT) AS token_count,
  CAST(0 AS BIGINT) AS errors
FROM documents GROUP BY lang""",
    "size_filter": _with(FILES) + f"SELECT doc_id, path, size FROM files WHERE size <= {q.MAX_SIZE}",
    "file_cap": _with(FILES)
    + f"SELECT path, size, md5(content) AS content_md5 FROM files ORDER BY path LIMIT {q.CAP}",
    "scan_ignore_filter": _with(FILES, _ignored("files", q.SCAN_PATTERNS))
    + "SELECT doc_id, path FROM files WHERE path NOT IN (SELECT path FROM ignored)",
    "incremental_scan": f"""
SELECT doc_id, concat('docs/', source, '.py') AS path,
  CAST(octet_length(encode(text)) AS BIGINT) AS size, {_is_binary("text")} AS is_binary,
  'python' AS language, {_tokens("text")} AS token_count
FROM documents""",
    "binary_flag": _with(BINARIES)
    + f"SELECT doc_id, {_is_binary('content')} AS is_binary FROM binaries",
    "processable_gate": _with(BINARIES)
    + f"""
SELECT doc_id, size, is_binary,
  CASE WHEN NOT is_binary AND size > 0 THEN md5(content) END AS content_md5
FROM (SELECT *, CAST(octet_length(encode(content)) AS BIGINT) AS size,
             {_is_binary("content")} AS is_binary FROM binaries)""",
    "language_detection": _with(FILES, _languages("files"))
    + """
SELECT doc_id, path, CASE WHEN doc_id % 9 = 0 THEN 'known' ELSE language END AS language
FROM files JOIN languages USING (path)""",
    "comment_stripping": _with(COMMENTED, _stripped("commented"), recursive=True)
    + "SELECT doc_id, content FROM stripped",
    "document_tokens": f"SELECT doc_id, {_tokens('text')} AS token_count FROM documents",
    "conversation_tokens": f"SELECT conv_id, turn, {_tokens('text')} AS token_count FROM conversations",
    "document_lines": """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM documents""",
    "overlapping_chunks": _with(
        "texts AS (SELECT doc_id, text AS content FROM documents)",
        _windows("texts", "doc_id", q.CHUNK, q.OVERLAP),
        recursive=True,
    )
    + f"SELECT doc_id, {_CHUNK_COLUMNS} FROM chunks",
    "markup_segments": f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS segment_idx, rtrim(segment, chr(10)) AS segment,
  CAST(octet_length(encode(segment)) AS BIGINT) AS size
FROM (SELECT page_id, unnest(s) AS segment, generate_subscripts(s, 1) AS i
      FROM (SELECT page_id, {_SEGMENTS.format("html")} AS s FROM pages))""",
    "budget_packing": _packs("pages", "page_id", "html", q.CHUNK, q.TOKENS),
    "budget_packing_lines": _packs(
        f"(WITH {COMMENTED} SELECT * FROM commented)", "doc_id", "content", 4 * q.CHUNK, q.TOKENS
    ),
    "overlap_tail": f"""
SELECT doc_id,
  replace(CASE WHEN contains(tail, '0A ') THEN substr(tail, instr(tail, '0A ') + 3) ELSE tail END,
          ' ', '') AS tail_hex
FROM (SELECT doc_id, {_pairs(f"right(hex(encode(text)), {2 * q.CHUNK})")} AS tail FROM documents)""",
    "path_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed')",
    "fuzzy_search": _fuzzy((q.FUZZY_QUERY,))
    + f"SELECT path, span, start FROM ranked WHERE rank <= {q.TOP}",
    "fuzzy_search_many": _fuzzy(q.FUZZY_QUERIES)
    + f"SELECT query, path, span, start, rank FROM ranked WHERE rank <= {q.TOP}",
    "line_search": _with(_LINES) + f"SELECT doc_id, line_no, line FROM lines WHERE {_MATCH}",
    "match_stats": _with(_LINES)
    + f"""
SELECT doc_id, count(*) AS line_count, count(*) FILTER (WHERE {_MATCH}) AS match_count,
  min(line_no) FILTER (WHERE {_MATCH}) AS first_match
FROM lines GROUP BY doc_id""",
    "line_preview": _with(
        _LINES,
        "shown AS (SELECT * FROM lines WHERE line_no < n - 1 AND line_no < 1000)",
        f"""
found AS (
  SELECT doc_id, coalesce(min(line_no) FILTER (WHERE {_MATCH}), 0) AS current
  FROM shown GROUP BY doc_id)""",
    )
    + f"""
SELECT doc_id, line_no + 1 AS line_no, line, line_no = current AS is_current, {_MATCH} AS is_match
FROM shown JOIN found USING (doc_id) WHERE line_no >= current - 5""",
    "selection_state": """
SELECT user_id, count(*) AS toggles, count(*) % 2 = 1 AS is_selected FROM events GROUP BY user_id""",
    "selection_from_stream": """
SELECT user_id, count(*) AS toggles, count(*) % 2 = 1 AS is_selected FROM events GROUP BY user_id""",
    "latest_writes": """
SELECT CAST(user_id AS VARCHAR) AS path, props AS content
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM events)
WHERE n = 1 AND event_type <> 'error'""",
    "selected_contents": _with(FILES, SELECTED)
    + """
SELECT doc_id, path, md5(content) AS content_md5 FROM files
WHERE doc_id IN (SELECT doc_id FROM selected)""",
    "tree_ignore_filter": _with(
        PATHS,
        _tree_ignored(q.TREE_PATTERNS),
    )
    + "SELECT path FROM paths WHERE path NOT IN (SELECT path FROM tree_ignored)",
    "directory_tree": _with(_NODES) + "SELECT root, path, depth, line FROM tree",
    "rendered_tree": _with(_NODES) + "SELECT line, count(*) AS n FROM tree GROUP BY line",
    "xml_bundle": _WRITTEN,
    "json_bundle": _WRITTEN,
    "yaml_bundle": _WRITTEN,
    "xml_context": _CONTEXT,
    "json_context": _CONTEXT,
    "yaml_context": _CONTEXT,
    "context_bundle": _with(
        COMMENTED_FILES,
        _ignored("files", DEFAULT_IGNORE_PATTERNS),
        SELECTED,
        f"{_ANY_SIZE.strip()[:-1]} AND doc_id IN (SELECT doc_id FROM selected))",
        _languages("kept"),
        _stripped("kept"),
        recursive=True,
    )
    + f"""
SELECT k.path, k.size, {_is_binary("k.content")} AS is_binary,
  CASE WHEN NOT {_is_binary("k.content")} AND k.size > 0 THEN language END AS language,
  md5(CASE WHEN {_is_binary("k.content")} THEN '' ELSE s.content END) AS content_md5
FROM kept k JOIN languages USING (path) JOIN stripped s USING (doc_id)""",
    "context_bundle_chunks": _with(
        COMMENTED_FILES,
        _ignored("files", DEFAULT_IGNORE_PATTERNS),
        _ANY_SIZE,
        _stripped("kept"),
        f"""
long AS (
  SELECT k.path, s.content FROM kept k JOIN stripped s USING (doc_id)
  WHERE k.size > 1000 AND NOT {_is_binary("k.content")})""",
        _windows("long", "path", 1000, 100),
        recursive=True,
    )
    + f"SELECT path, {_CHUNK_COLUMNS} FROM chunks",
}
ORACLES["buffer_from_stream"] = ORACLES["latest_writes"]
for _format in ("xml", "json", "yaml"):
    ORACLES[f"{_format}_document"] = f"""
SELECT row_number() OVER (ORDER BY path) - 1 AS position, path, content_md5 FROM ({_WRITTEN})"""
ORACLES["walked_tree"] = (
    _with(
        FILES,
        """
placed AS (
  SELECT concat('d', doc_id % 30) AS folder,
    concat('d', doc_id % 30, '/', list_last(string_split(path, '/'))) AS path
  FROM files),
everything AS (SELECT path FROM placed UNION SELECT folder FROM placed)""",
        _tree_ignored(q.WALK_PATTERNS).replace("FROM paths", "FROM everything"),
        "paths AS (SELECT path FROM everything WHERE path NOT IN (SELECT path FROM tree_ignored))",
        _TREE,
    )
    + "SELECT path, depth, line FROM tree"
)
ORACLES["aligned_search"] = (
    _aligned(q.FUZZY_QUERY)
    + f"""
SELECT path, score FROM paths JOIN scored USING (path)
ORDER BY score DESC, length(path), path LIMIT {q.TOP}"""
)
ORACLES["ordered_bundle"] = f"""
SELECT row_number() OVER (ORDER BY path) - 1 AS position, * FROM ({ORACLES["context_bundle"]})"""
ORACLES["tree_source"] = (
    _with(FILES)
    + f"""
SELECT path, size, md5(content) AS content_md5 FROM files
WHERE starts_with(path, 'src/') AND size <= {q.MAX_SIZE}"""
)
ORACLES["tree_stream"] = (
    _with(
        MIXED_FILES,
        _ignored("files", DEFAULT_IGNORE_PATTERNS),
        _ANY_SIZE,
        _languages("kept"),
        _stripped("kept"),
        recursive=True,
    )
    + f"""
SELECT path, size, is_binary,
  CASE WHEN looked_into THEN language END AS language,
  CASE WHEN looked_into THEN {_tokens("content")} END AS token_count,
  CASE WHEN looked_into THEN md5(content) END AS content_md5
FROM (
  SELECT k.path, k.size, {_is_binary("k.content")} AS is_binary, language, s.content,
    NOT {_is_binary("k.content")} AND k.size > 0 AS looked_into
  FROM kept k JOIN languages USING (path) JOIN stripped s USING (doc_id))"""
)
ORACLES["file_part_counts"] = f"""
SELECT doc_id, line_count, token_count
FROM ({ORACLES["document_lines"]}) JOIN ({ORACLES["document_tokens"]}) USING (doc_id)"""
ORACLES["file_part_search"] = ORACLES["line_search"]
ORACLES["file_part_stripping"] = ORACLES["comment_stripping"]
ORACLES["listed_bundle"] = f"SELECT path, content_md5 FROM ({ORACLES['context_bundle']})"
ORACLES["listed_tree"] = (
    _with(
        COMMENTED_FILES,
        "all_paths AS (SELECT path FROM files)",
        _tree_ignored(DEFAULT_IGNORE_PATTERNS).replace("FROM paths", "FROM all_paths"),
        "paths AS (SELECT path FROM all_paths WHERE path NOT IN (SELECT path FROM tree_ignored))",
        _TREE,
    )
    + "SELECT 'files' AS cwd, line, count(*) AS n FROM tree GROUP BY line"
)
