"""Common table expressions that the reference SQL of the queries starts with."""

LANG = r"nullif(lower(regexp_replace(language, '^[\s.]+|[\s.]+$', '', 'g')), '')"
BLOCKS = f"b AS (SELECT DISTINCT ON (ordinal) * EXCLUDE (loaded_at) REPLACE ({LANG} AS language) FROM blocks ORDER BY ordinal)"
ITEMS = f"i AS (SELECT DISTINCT ON (ordinal) * EXCLUDE (loaded_at) REPLACE ({LANG} AS language) FROM items ORDER BY ordinal)"
FILES = f"f AS (SELECT DISTINCT ON (ordinal) * EXCLUDE (loaded_at) REPLACE ({LANG} AS language) FROM source_files ORDER BY ordinal)"
NODES = f"{BLOCKS}, n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ordinal DESC) = 1)"
EDGES = "e AS (SELECT src, dst, edge_type, reference_name FROM edges WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY list_position(['type_reference', 'import', 'parent'], edge_type), reference_name NULLS FIRST, edge_type) = 1)"
EVENTS = "ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_type AS tool_name, CAST(user_id AS VARCHAR) AS user_id, value / 10 AS execution_time, event_type <> 'error' AS success, ts, props FROM events)"
MESSAGES = r"m AS (SELECT doc_id AS conv_id, unnest(range(1, len(l) + 1)) AS turn, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split_regex(text, '\r?\n'), lambda x: x <> '') AS l FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL))"
STRIP = r"regexp_replace(regexp_replace({}, '^[\s\v\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ''), '[\s\v\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '')"
NAMES = "k AS (SELECT DISTINCT scan_id, item_id, unnest([name, qualified_name]) AS key FROM n), ki AS (SELECT DISTINCT * FROM k WHERE key IS NOT NULL)"


def lines(col: str) -> str:
    """Number of lines of a text, as ``functions.text.n_lines`` counts them."""
    p = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    end = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]\z"
    return f"CASE WHEN {col} = '' THEN 0 ELSE len(regexp_extract_all({col}, '{p}')) + CASE WHEN regexp_matches({col}, '{end}') THEN 0 ELSE 1 END END"


def w(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def wr(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "
