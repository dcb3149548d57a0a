"""SQL for the registered queries, over the given tables alone.

Written for a dialect with RE2 patterns, lists and lambdas. The expressions are
the plainest that give the same answer, not translations of the Spark plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from speechloom import fixed_values as fv
from speechloom.plans import parameters as pm
from speechloom.sources.views import RECORD_HEADER

ORACLE: dict[str, str] = {}

SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def lit(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def listed(values: Sequence) -> str:
    return ", ".join(lit(v) for v in values)


def rows(values: Sequence[Sequence]) -> str:
    return ", ".join(f"({listed(v)})" for v in values)


def sql(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = f"WITH {', '.join(ctes)} {body}" if ctes else body


def folded(c: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"translate({c}, '{upper}', '{lower}')"


def has(c: str, phrase: str) -> str:
    return f"contains({folded(c)}, {lit(phrase.lower())})"


def stripped(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def split_space(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[{SPACE}]+'), lambda x: x <> '')"


def word_list(c: str, min_chars: int = 1) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{{min_chars},}}')"


def pairs(c: str, sep: str = " ") -> str:
    return f"list_transform(range(1, len({c})), lambda i: {c}[i] || '{sep}' || {c}[i + 1])"


# ------------------------------------------------------------------- views

_DATE = (
    "cast((1873 + 2 * (doc_id % 77) + (doc_id // 77) % 2) * 10000"
    " + (1 + doc_id % 12) * 100 + 1 + doc_id % 28 AS integer)"
)
SPEECHES = f"""speeches AS (
  SELECT cast(d.doc_id AS varchar) AS speech_id, d.text AS speech, {_DATE.replace('doc_id', 'd.doc_id')} AS "date",
    d.doc_id AS speakerid, 'Speaker ' || d.lang AS speaker, 1 AS is_mapped,
    CASE WHEN (d.doc_id // 7) % 5 IN (0, 1) THEN 'D' WHEN (d.doc_id // 7) % 5 IN (2, 3) THEN 'R'
      ELSE 'Unknown' END AS party,
    d.source AS state_x, d.lang AS lastname, 'Speaker' AS firstname,
    cast(43 + d.doc_id % 77 AS integer) AS congress_session,
    CASE l.quality WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_procedure
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SPEAKER_MAP = """speaker_map AS (
  SELECT speakerid, cast(speakerid AS varchar) AS speech_id, split_part(name, '#', 2) AS lastname,
    split_part(name, '#', 1) AS firstname, n_name AS state, party
  FROM (
    SELECT c_custkey AS speakerid, c_name AS name, c_nationkey AS n_nationkey,
      CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'D'
           WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'R' ELSE 'I' END AS party
    FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'I' FROM supplier)
  JOIN nation USING (n_nationkey))"""

JOINED = f"""joined AS (
  SELECT cast(d.doc_id AS varchar) AS speech_id, d.text AS speech, {_DATE} AS "date",
    d.source AS state_x, m.speakerid, m.lastname, m.firstname, m.state AS state_y, m.party
  FROM documents d LEFT JOIN speaker_map m ON m.speech_id = cast(d.doc_id AS varchar))"""

BUILT = """built AS (
  SELECT *, cast(speakerid IS NOT NULL AS integer) AS is_mapped,
    trim(coalesce(firstname, '') || ' ' || coalesce(lastname, '')) AS speaker,
    cast(43 + cast(speech_id AS bigint) % 77 AS integer) AS congress_session FROM joined)"""

_RAW = [SPEAKER_MAP, JOINED, BUILT]

STANDARD = """standard AS (
  SELECT speech_id, coalesce(speech, '[No Text]') AS speech, "date", coalesce(speakerid, -1) AS speakerid,
    speaker, is_mapped, coalesce(party, 'Unknown') AS party, coalesce(state_x, 'Unknown') AS state_x,
    coalesce(lastname, 'Unknown') AS lastname, coalesce(firstname, 'Unknown') AS firstname,
    congress_session FROM built)"""

REPAIR = """repaired AS (
  SELECT speech_id, coalesce(speech, '[No Text]') AS speech, coalesce("date", 0) AS "date",
    coalesce(party, 'Unknown') AS party, coalesce(state_x, 'Unknown') AS state_x,
    coalesce(lastname, 'Unknown') AS lastname, coalesce(firstname, 'Unknown') AS firstname,
    congress_session FROM built)"""

# ------------------------------------------------- sources, sinks, sessions

_LINE = (
    "regexp_replace(regexp_replace(text, '[\\r\\n|]', ' ', 'g'), '[^\\x{00}-\\x{FF}]', '?', 'g')"
)
sql(
    "session_read",
    f"""SELECT cast(doc_id AS varchar) AS speech_id,
      CASE WHEN lang <> 'es' AND {_LINE} NOT IN ({listed(fv.MISSING_MARKERS)}) THEN {_LINE} END AS speech
    FROM documents WHERE lang <> 'de'""",
)
sql(
    "session_join",
    "SELECT speech_id, speech, \"date\", state_x, speakerid, lastname, firstname, state_y, party FROM joined",
    *_RAW[:2],
)
sql(
    "session_join_repeated",
    f"""SELECT s.speech_id, speech, "date", s.state AS state_x, speakerid, lastname, firstname, state_y, party
    FROM (SELECT a.speech_id, speech, "date", d.state
      FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN '{pm.HOT_ID}' ELSE cast(doc_id AS varchar) END AS speech_id,
          text AS speech FROM documents) a
      LEFT JOIN (SELECT CASE WHEN doc_id % {pm.REPEATED_DESCR} = 0 THEN '{pm.HOT_ID}'
          ELSE cast(doc_id AS varchar) END AS speech_id, {_DATE} AS "date", source AS state FROM documents) d
      ON a.speech_id = d.speech_id) s
    LEFT JOIN (SELECT speakerid, CASE WHEN speakerid % {pm.REPEATED_SPEAKERS} = 0 THEN '{pm.HOT_ID}'
        ELSE speech_id END AS speech_id, lastname, firstname, state AS state_y, party FROM speaker_map) m
    ON s.speech_id = m.speech_id""",
    SPEAKER_MAP,
)
sql(
    "speaker_build",
    "SELECT speech_id, speakerid, is_mapped, speaker, congress_session FROM built",
    *_RAW,
)
sql("standardize", "SELECT * FROM standard", *_RAW, STANDARD)
sql("standardize_repair", "SELECT * FROM repaired", *_RAW, REPAIR)
sql(
    "match_rate",
    """SELECT congress_session, count(*) AS n_rows, round(avg(is_mapped) * 100, 6) AS match_rate
    FROM standard GROUP BY congress_session""",
    *_RAW,
    STANDARD,
)
sql(
    "load_sessions",
    f"""SELECT cast(d.doc_id AS varchar) AS speech_id,
      CASE WHEN lang = 'es' THEN '[No Text]' ELSE {_LINE} END AS speech, {_DATE} AS "date",
      coalesce(m.speakerid, -1) AS speakerid,
      trim(coalesce(m.firstname, '') || ' ' || coalesce(m.lastname, '')) AS speaker,
      cast(m.speakerid IS NOT NULL AS integer) AS is_mapped, coalesce(m.party, 'Unknown') AS party,
      d.source AS state_x, coalesce(m.lastname, 'Unknown') AS lastname,
      coalesce(m.firstname, 'Unknown') AS firstname, cast(43 + doc_id % 77 AS integer) AS congress_session
    FROM documents d LEFT JOIN speaker_map m ON m.speech_id = cast(d.doc_id AS varchar)
    WHERE lang <> 'de'
      AND doc_id % 77 IN (SELECT speakerid % 77 FROM speaker_map)""",
    SPEAKER_MAP,
)
sql(
    "replace_session",
    f"""SELECT * FROM speeches WHERE congress_session <> {pm.REPAIRED_SESSION}
    UNION ALL BY NAME
    SELECT *, NULL::bigint AS speakerid, NULL::varchar AS speaker, NULL::integer AS is_mapped,
      NULL::integer AS is_procedure
    FROM repaired WHERE congress_session = {pm.REPAIRED_SESSION}""",
    SPEECHES,
    *_RAW,
    REPAIR,
)
sql(
    "append_speeches",
    """SELECT congress_session, count(*) AS n_speeches, count(is_procedure) AS n_labelled,
      cast(sum(length(speech)) AS bigint) AS n_chars FROM speeches GROUP BY congress_session""",
    SPEECHES,
)

NEWEST = """newest AS (
  SELECT * FROM (
    SELECT cast(conv_id AS varchar) AS speech_id, text AS speech, 20200101 AS "date", role AS speaker,
      CASE role WHEN 'user' THEN 'D' WHEN 'assistant' THEN 'R' ELSE 'Unknown' END AS party,
      119 AS congress_session,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r
    FROM conversations) WHERE r = 1)"""


def _upserted(label: str) -> str:
    return f"""SELECT * FROM speeches WHERE speech_id NOT IN (SELECT speech_id FROM newest)
    UNION ALL
    SELECT speech_id, speech, "date", NULL, speaker, NULL, party, NULL, NULL, NULL, congress_session, {label}
    FROM newest"""


sql("upsert_speeches", _upserted("NULL"), SPEECHES, NEWEST)
sql("upsert_table", _upserted("NULL"), SPEECHES, NEWEST)
_OF_NOBODY = """SELECT NULL, text, 20200101, NULL, role, NULL,
      CASE role WHEN 'user' THEN 'D' WHEN 'assistant' THEN 'R' ELSE 'Unknown' END, NULL, NULL, NULL, 119, NULL
    FROM conversations WHERE turn % 3 = 0"""
sql(
    "upsert_without_id",
    _upserted("NULL") + " UNION ALL " + _OF_NOBODY,
    SPEECHES,
    NEWEST.replace("FROM conversations)", "FROM conversations WHERE turn % 3 <> 0)"),
)
sql(
    "upsert_keep_labels",
    _upserted(
        "(SELECT max(s.is_procedure) FROM speeches s WHERE s.speech_id = newest.speech_id)"
    ),
    SPEECHES,
    NEWEST,
)
BUCKETED = f"""bucketed AS (
  SELECT * REPLACE (CASE WHEN speakerid % 3 = 0 THEN '{pm.HOT_ID}' ELSE speech_id END AS speech_id)
  FROM speeches)"""
sql(
    "upsert_bucketed",
    """SELECT * FROM bucketed WHERE speech_id NOT IN (SELECT speech_id FROM winners)
    UNION ALL
    SELECT speech_id, speech, 20200101, NULL, role, NULL,
      CASE role WHEN 'user' THEN 'D' WHEN 'assistant' THEN 'R' ELSE 'Unknown' END, NULL, NULL, NULL, 119,
      (SELECT max(b.is_procedure) FROM bucketed b WHERE b.speech_id = new.speech_id)
    FROM (SELECT speech_id, speech, role FROM winners
      UNION ALL SELECT NULL, text, role FROM conversations WHERE turn % 3 = 0) AS new""",
    SPEECHES,
    BUCKETED,
    """winners AS (
      SELECT * FROM (
        SELECT cast(conv_id AS varchar) AS speech_id, text AS speech, role,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text) DESC) AS r
        FROM conversations WHERE turn % 3 <> 0) WHERE r = 1)""",
)
sql(
    "label_bucketed",
    """SELECT speakerid, b.speech_id, coalesce(new_label, is_procedure) AS is_procedure
    FROM bucketed b LEFT JOIN (
      SELECT cast(vec_id AS varchar) AS speech_id, max(label % 2) AS new_label FROM embeddings GROUP BY 1) n
    ON b.speech_id = n.speech_id""",
    SPEECHES,
    BUCKETED,
)
sql(
    "session_account",
    f"""SELECT cast(43 + doc_id % 77 AS integer) AS congress_session, count(*) AS n_lines,
      count(*) FILTER (lang = 'es') AS n_padded, count(*) FILTER (lang = 'de') AS n_dropped,
      cast(coalesce(sum(length(doc_id || '|' || {_LINE} || '|extra')) FILTER (lang = 'de'), 0) AS bigint) AS dropped_chars
    FROM documents GROUP BY 1""",
)
sql(
    "dropped_lines",
    f"""SELECT cast(43 + doc_id % 77 AS integer) AS congress_session, doc_id || '|' || {_LINE} || '|extra' AS line
    FROM documents WHERE lang = 'de'""",
)
sql(
    "config_terms",
    f"""SELECT term, 'Category ' || arg_max(item_id, item_id) % {pm.CONFIG_CATEGORIES} AS category
    FROM (SELECT item_id, replace(unnest({word_list('text')}), '_', ' ') AS term FROM benchmark) GROUP BY term""",
)
sql(
    "csv_round_trip",
    """SELECT speech_id, nullif(speech, '') AS speech, "date", state_x, speakerid, lastname, firstname,
      state_y, party FROM joined""",
    *_RAW[:2],
)
sql(
    "lexicon_load",
    f"""SELECT replace(term, '_', ' ') AS term, arg_max(role, conv_id * 100000 + turn) AS category
    FROM (SELECT conv_id, turn, role, unnest({pairs('words', '_')}) AS term
      FROM (SELECT *, {word_list('text', 2)} AS words FROM conversations))
    GROUP BY 1""",
)
sql(
    "procedural_terms",
    f"""SELECT DISTINCT term FROM (
      SELECT lower({stripped("split_part(line, '|', 1)")}) AS term
      FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE term <> ''""",
)
sql(
    "lexicon_merge",
    f"""SELECT DISTINCT lang AS list_name, term FROM (
      SELECT lang, unnest({word_list('text', 2)}) AS term FROM documents WHERE lang <> '{pm.MERGED_LIST}')
    UNION ALL
    SELECT DISTINCT '{pm.MERGED_LIST}', term FROM (
      SELECT unnest({word_list('text', 2)}) AS term FROM benchmark)""",
)
ORACLE["lexicon_files"] = ORACLE["lexicon_merge"]

ENTRIES = f"""entries(section, list_name, description, "position", term) AS (VALUES {rows(pm.LEXICON)})"""
_TERM_WORDS = f"array_to_string({word_list("replace(term, '_', ' ')")}, ' ')"
HITS = f"""hits AS (
  SELECT term, count(*) AS speech_hits
  FROM (SELECT term, {_TERM_WORDS} AS plain FROM (SELECT DISTINCT lower(term) AS term FROM entries)) e
  JOIN (SELECT ' ' || array_to_string({word_list('text')}, ' ') || ' ' AS body FROM documents) d
    ON plain <> '' AND contains(body, ' ' || plain || ' ') GROUP BY term)"""
sql("lexicon_hits", "SELECT term, speech_hits FROM hits", ENTRIES, HITS)
sql(
    "lexicon_summary",
    """SELECT section, upper(list_name) AS list_name,
      CASE WHEN section = 'policy' THEN coalesce(max(description), 'N/A') END AS description,
      count(*) AS n_terms,
      CASE WHEN section = 'policy' AND count(*) > 10 THEN
          array_to_string(list(e.term ORDER BY "position")[1:5], ', ') || ' ... '
          || array_to_string(list(e.term ORDER BY "position")[-5:], ', ')
        WHEN section = 'policy' THEN array_to_string(list(e.term ORDER BY "position"), ', ')
        ELSE array_to_string(list(e.term ORDER BY "position")[1:8], ', ')
          || CASE WHEN count(*) > 8 THEN '...' ELSE '' END END AS preview,
      cast(coalesce(sum(speech_hits), 0) AS bigint) AS speech_hits
    FROM entries e LEFT JOIN hits h ON h.term = lower(e.term) GROUP BY section, list_name""",
    ENTRIES,
    HITS,
)


def _profile(name: str, ddl: str) -> str:
    columns = [c.split(" ") for c in ddl.split(", ")]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, {i + 1} AS \"position\","
        f" '{c}' AS column_name, '{t}' AS column_type, count(*) - count({c}) AS n_nulls FROM {name}"
        for i, (c, t) in enumerate(columns)
    )


sql("table_profile", " UNION ALL ".join(_profile(n, d) for n, d in pm.PROFILED_TABLES.items()))

sql(
    "table_distincts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c.split(' ')[0]}' AS column_name,"
        f" count(DISTINCT {c.split(' ')[0]}) AS n_distinct FROM {n}"
        for n, d in pm.PROFILED_TABLES.items()
        for c in d.split(", ")
    ),
)

# ------------------------------------------------------------------ ingest

_PACKAGE = (
    "'CREC-' || (1995 + page_id % 25) || '-0' || (1 + page_id % 9) || '-1' || (page_id % 10)"
)
_NAME = (
    "CASE page_id % 2 WHEN 0 THEN 'Last' || page_id || ', First' ELSE 'First Last' || page_id END"
)
GRANULES = f"""granules AS (
  SELECT page_id, url, {_PACKAGE} AS package_id,
    {_PACKAGE} || '-pt1-Pg' || CASE page_id % 5 WHEN 1 THEN 'S' WHEN 2 THEN 'E' WHEN 3 THEN 'D' ELSE 'H' END
      || page_id || CASE WHEN page_id % 17 = 0 THEN '-FrontMatter' ELSE '' END AS granule_id,
    CASE WHEN page_id % 4 <> 0 THEN cast(104 + page_id % 13 AS varchar) END AS package_congress,
    CASE WHEN page_id % 29 <> 0 AND page_id % 8 <> 0 THEN cast(90 + page_id % 13 AS varchar) ELSE '0' END
      AS granule_congress,
    page_id % 3 <> 0 AS has_member,
    CASE WHEN page_id % 23 = 0 THEN NULL
      WHEN page_id % 19 = 0 THEN '<html><body>[House] Page 5 ok</body></html>'
      ELSE CASE WHEN page_id % 7 = 2 THEN {lit(RECORD_HEADER)} ELSE '' END
        || CASE WHEN page_id % 6 = 0 THEN 'Mr. SMITH of Texas. ' ELSE '' END || html END AS html
  FROM pages)"""


def visible(c: str) -> str:
    out = c
    for pattern in (
        r"(?is)<!--.*?-->",
        r"(?is)<script[^>]*>.*?</script>",
        r"(?is)<style[^>]*>.*?</style>",
    ):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"),
                         ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def cleaned(c: str) -> str:
    out = squeezed(c)
    for pattern, ignore_case in fv.BOILERPLATE_PATTERNS:
        out = f"regexp_replace({out}, '{'(?i)' if ignore_case else ''}{pattern}', '', 'g')"
    out = f"trim(regexp_replace({out}, '{fv.DANGLING_START_PATTERN}', ''))"
    return f"trim(regexp_replace({out}, '{fv.DANGLING_PAIR_PATTERN}', '', 'g'))"


def outcomes(source: str = "granules") -> str:
    return f"""outcomes AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'SUCCESS' WHEN reason IN ('{fv.NOT_FLOOR}',
    '{fv.MATTER}', '{fv.EMPTY}') THEN 'SKIP' ELSE 'ERROR' END AS status
  FROM (SELECT *, CASE
      WHEN NOT regexp_matches(granule_id, 'Pg[HS]') THEN '{fv.NOT_FLOOR}'
      WHEN contains(granule_id, 'FrontMatter') THEN '{fv.MATTER}'
      WHEN page_id % 29 = 0 THEN '{fv.NO_METADATA}' WHEN page_id % 31 = 0 THEN '{fv.NO_LINK}'
      WHEN html IS NULL THEN '{fv.NO_TEXT}'
      WHEN length(text) < {fv.MIN_GRANULE_CHARS} THEN '{fv.EMPTY}' END AS reason
    FROM (SELECT *, {cleaned(visible('html'))} AS text FROM {source})))"""


def titled(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, ' '),"
        " lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


_OPENING = fv.OPENING_NAME_PATTERN


def opened(c: str) -> tuple[str, str, str]:
    """Title, name and whether there is one, of the words a text opens with."""
    name = f"regexp_extract(substring({c}, 1, 50), '{_OPENING}', 2)"
    name = f"regexp_replace(trim({name}), '\\s+of\\s+[A-Za-z]+$', '')"
    return f"regexp_extract(substring({c}, 1, 50), '{_OPENING}', 1)", name, f"{name} <> ''"


_TITLE, _OPEN_NAME, _NAMED = opened("text")
SPEECH_ROWS = f"""rows_of AS (
  SELECT granule_id AS speech_id, text AS speech,
    cast(replace(substring(package_id, 6), '-', '') AS integer) AS "date",
    CASE WHEN has_member THEN page_id ELSE -1 END AS speakerid,
    CASE WHEN has_member AND page_id % 2 = 0 THEN 'First Last' || page_id
      WHEN has_member THEN 'First Last' || page_id
      WHEN {_NAMED} THEN {titled(f"{_TITLE} || ' ' || {_OPEN_NAME}")} ELSE 'Unknown Speaker' END AS speaker,
    cast(has_member AS integer) AS is_mapped,
    CASE WHEN NOT has_member THEN 'Unknown' ELSE
      CASE page_id % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 3 THEN 'I' ELSE 'Unknown' END END AS party,
    CASE WHEN has_member THEN 'S' || (page_id % 50) ELSE 'Unknown' END AS state_x,
    CASE WHEN has_member THEN 'Last' || page_id
      WHEN {_NAMED} THEN {titled(f"string_split({_OPEN_NAME}, ' ')[-1]")} ELSE 'Unknown' END AS lastname,
    CASE WHEN has_member THEN 'First' ELSE 'Unknown' END AS firstname,
    cast(coalesce(package_congress, granule_congress) AS integer) AS congress_session, status
  FROM outcomes)"""

sql(
    "granule_filter",
    f"""SELECT granule_id, CASE WHEN reason IS NULL THEN 'KEEP' ELSE 'SKIP' END AS status, reason
    FROM (SELECT granule_id, CASE
      WHEN NOT (contains(granule_id, 'PgH') OR contains(granule_id, 'PgS')) THEN '{fv.NOT_FLOOR}'
      WHEN contains(granule_id, 'FrontMatter') THEN '{fv.MATTER}' END AS reason FROM granules)""",
    GRANULES,
)
sql("html_to_text", f"SELECT page_id, {visible('html')} AS text FROM pages")
sql("clean_text", f"SELECT granule_id, {cleaned(visible('html'))} AS text FROM granules", GRANULES)
sql(
    "ghost_filter",
    """SELECT granule_id, cast(length(text) AS integer) AS n_chars, status, reason FROM outcomes
    WHERE status = 'SUCCESS' OR reason = 'Empty/Header Only'""",
    GRANULES,
    outcomes(),
)
sql(
    "metadata_flatten",
    """SELECT page_id, CASE WHEN page_id % 8 IN (5, 7) THEN 'Unknown' ELSE url END AS flat FROM pages""",
)
sql(
    "speaker_parse",
    """SELECT c_custkey,
      CASE c_nationkey % 4 WHEN 0 THEN split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1)
        WHEN 1 THEN replace(c_name, '#', ' of ') WHEN 2 THEN c_name
        ELSE 'Jr ' || split_part(c_name, '#', 1) END AS speaker,
      CASE c_nationkey % 4 WHEN 0 THEN split_part(c_name, '#', 1) WHEN 1 THEN split_part(c_name, '#', 2)
        WHEN 2 THEN 'Unknown' ELSE split_part(c_name, '#', 1) END AS lastname,
      CASE c_nationkey % 4 WHEN 0 THEN split_part(c_name, '#', 2) WHEN 1 THEN split_part(c_name, '#', 1)
        WHEN 2 THEN 'Unknown' ELSE 'Jr' END AS firstname
    FROM customer""",
)
_T, _N, _IS = opened("opening")
sql(
    "speaker_fallback",
    f"""SELECT conv_id, turn,
      CASE WHEN {_IS} THEN {titled(f"{_T} || ' ' || {_N}")} ELSE 'Unknown Speaker' END AS speaker,
      CASE WHEN {_IS} THEN {titled(f"string_split({_N}, ' ')[-1]")} ELSE 'Unknown' END AS lastname,
      'Unknown' AS firstname
    FROM (SELECT *, CASE role WHEN 'user' THEN 'Mr. USER of user. '
      WHEN 'assistant' THEN 'The ASSISTANT pro tempore: ' ELSE '' END || text AS opening FROM conversations)""",
)
sql(
    "bioguide_num",
    """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN -1 ELSE cast(split_part(c_name, '#', 2) AS bigint) END
      AS number FROM customer""",
)
sql(
    "package_date",
    """SELECT granule_id, CASE WHEN page_id % 11 = 0 THEN 0
      ELSE cast(replace(substring(package_id, 6), '-', '') AS integer) END AS "date" FROM granules""",
    GRANULES,
)
sql(
    "congress_coalesce",
    "SELECT granule_id, coalesce(package_congress, granule_congress) AS congress FROM granules",
    GRANULES,
)
sql(
    "resume_antijoin",
    f"""SELECT DISTINCT package_id FROM granules
    WHERE package_id NOT IN (SELECT package_id FROM granules WHERE contains(url, '{pm.DONE_URL_PART}'))
    ORDER BY package_id""",
    GRANULES,
)
sql(
    "ingest_audit",
    """SELECT package_id, count(*) FILTER (status = 'SUCCESS') AS saved,
      count(*) FILTER (status = 'SKIP') AS skipped, count(*) FILTER (status = 'ERROR') AS errors
    FROM outcomes GROUP BY package_id""",
    GRANULES,
    outcomes(),
)
sql(
    "ingest_reasons",
    "SELECT status, reason, count(*) AS n_granules FROM outcomes GROUP BY status, reason",
    GRANULES,
    outcomes(),
)
sql(
    "ingest_errors",
    """SELECT package_id, granule_id, granule_id || ' - ' || reason AS message FROM outcomes
    WHERE status = 'ERROR'""",
    GRANULES,
    outcomes(),
)
sql(
    "granule_speeches",
    "SELECT * EXCLUDE (status) FROM rows_of WHERE status = 'SUCCESS'",
    GRANULES,
    outcomes(),
    SPEECH_ROWS,
)
sql(
    "ingest_stream",
    "SELECT * EXCLUDE (status) FROM rows_of WHERE status = 'SUCCESS'",
    GRANULES,
    f"""revised AS (SELECT * REPLACE (CASE WHEN contains(url, '{pm.REVISED_URL_PART}')
      THEN html || '{pm.REVISED_TEXT}' ELSE html END AS html) FROM granules)""",
    outcomes("revised"),
    SPEECH_ROWS,
)

# --------------------------------------------------------------- denoising

sql(
    "keyword_purge",
    f"""SELECT speech_id, is_procedure AS old_label, CASE WHEN is_procedure IS NULL
      AND length(speech) < {fv.PURGE_MAX_CHARS}
      AND regexp_matches(lower(speech), {lit('|'.join(pm.PURGE_PHRASES))}) THEN 1 ELSE is_procedure END
      AS new_label FROM speeches""",
    SPEECHES,
)
sql(
    "zero_shot_rule",
    f"""SELECT cast(event_id AS varchar) AS speech_id, CASE WHEN event_type = 'error'
      AND value / (value + 5) > {fv.CONFIDENCE_THRESHOLD} THEN 1 ELSE 0 END AS is_procedure FROM events""",
)
_PHRASES_USED = " + ".join(
    f"cast(contains(lower(speech), {lit(p)}) AS integer)" for p in pm.PURGE_PHRASES
)
sql(
    "score_batch",
    f"""SELECT speech_id, CASE WHEN p > 0.5 THEN '{fv.PROCEDURE_LABEL}' ELSE '{fv.DEBATE_LABEL}' END
      AS top_label, round(greatest(p, 1 - p), 6) AS score,
      CASE WHEN p > {fv.CONFIDENCE_THRESHOLD} THEN 1 ELSE 0 END AS is_procedure
    FROM (SELECT speech_id, 1 / (1 + exp(-(-1.0::double + 1.5::double * ({_PHRASES_USED})))) AS p
      FROM speeches WHERE is_procedure IS NULL)""",
    SPEECHES,
)
_PURGED = " OR ".join(f"regexp_matches(lower(speech), {lit(p)})" for p in pm.PURGE_PHRASES)
sql(
    "label_speeches",
    f"""SELECT speech_id, party, congress_session, CASE WHEN is_procedure IS NOT NULL THEN is_procedure
      WHEN length(speech) < {fv.PURGE_MAX_CHARS} AND ({_PURGED}) THEN 1
      WHEN 1 / (1 + exp(-(-1.0::double + 1.5::double * ({_PHRASES_USED})))) > {fv.CONFIDENCE_THRESHOLD}
        THEN 1 ELSE 0 END AS is_procedure
    FROM speeches""",
    SPEECHES,
)
_MODEL = f"""weak AS (
  SELECT speech_id, speech, row_number() OVER () AS row, party, congress_session, CASE WHEN is_procedure IS NOT NULL THEN is_procedure
    WHEN length(speech) < {fv.PURGE_MAX_CHARS} AND ({_PURGED}) THEN 1 END AS label FROM speeches
), tokens AS (
  SELECT row, label, unnest({word_list("speech", 2)}) AS term FROM weak
), counts AS (
  SELECT term, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tokens
  WHERE label IS NOT NULL AND term NOT IN ({listed(pm.STOP_WORDS)}) GROUP BY term
), totals AS (SELECT sum(n0)::double + count(*) AS all0, sum(n1)::double + count(*) AS all1 FROM counts
), model AS (
  SELECT term, ln((n1 + 1.0::double) / (n0 + 1.0::double)) - ln((SELECT all1 FROM totals) / (SELECT all0 FROM totals)) AS weight,
    n0 + n1 AS n FROM counts
), prior AS (
  SELECT ln((count(*) FILTER (label = 1) + 1.0::double) / (count(*) FILTER (label = 0) + 1.0::double)) AS weight
  FROM weak WHERE speech IS NOT NULL
), scored AS (
  SELECT w.row, w.speech_id, 1 / (1 + exp(-((SELECT weight FROM prior) + coalesce(sum(m.weight), 0)))) AS p
  FROM weak w LEFT JOIN tokens t ON t.row = w.row LEFT JOIN model m ON m.term = t.term
  WHERE w.label IS NULL GROUP BY w.row, w.speech_id)"""
sql(
    "train_classifier",
    f"""SELECT speech_id, CASE WHEN p > 0.5 THEN '{fv.PROCEDURE_LABEL}' ELSE '{fv.DEBATE_LABEL}' END AS top_label,
      round(greatest(p, 1 - p), 6) AS score, CASE WHEN p > {fv.CONFIDENCE_THRESHOLD} THEN 1 ELSE 0 END AS is_procedure
    FROM scored""",
    SPEECHES,
    _MODEL,
)
sql(
    "classifier_terms",
    f"""SELECT term, round(weight, 6) AS weight, n FROM model
    ORDER BY abs(round(weight, 6)) DESC, n DESC, term LIMIT {pm.MODEL_TERMS}""",
    SPEECHES,
    _MODEL,
)
sql(
    "label_by_model",
    f"""SELECT w.speech_id, w.party, w.congress_session,
      coalesce(w.label, CASE WHEN p > {fv.CONFIDENCE_THRESHOLD} THEN 1 ELSE 0 END) AS is_procedure
    FROM weak w LEFT JOIN scored USING (row)""",
    SPEECHES,
    _MODEL,
)
_FEW = f"nullif(cast(speakerid % {pm.REPEATED_IDS} AS varchar), '0')"
sql(
    "label_speeches_repeated",
    f"""SELECT speakerid, id AS speech_id, coalesce(label, max(CASE WHEN label IS NULL AND id IS NOT NULL THEN scored END) OVER (PARTITION BY id))
      AS is_procedure
    FROM (SELECT speakerid, {_FEW} AS id, CASE WHEN is_procedure IS NOT NULL THEN is_procedure
        WHEN length(speech) < {fv.PURGE_MAX_CHARS} AND ({_PURGED}) THEN 1 END AS label,
        CASE WHEN 1 / (1 + exp(-(-1.0::double + 1.5::double * ({_PHRASES_USED})))) > {fv.CONFIDENCE_THRESHOLD} THEN 1 ELSE 0 END AS scored
      FROM speeches)""",
    SPEECHES,
)
sql(
    "apply_labels",
    """SELECT speech_id, congress_session, party, coalesce(label % 2, is_procedure) AS is_procedure
    FROM speeches LEFT JOIN embeddings ON cast(vec_id AS varchar) = speech_id""",
    SPEECHES,
)
sql(
    "label_progress",
    f"""SELECT total, done, total - done AS remaining, round(done / total * 100, 6) AS percent,
      round((total - done) / {fv.ROWS_PER_MINUTE}, 6) AS minutes_left,
      round((total - done) / {fv.ROWS_PER_MINUTE} / 60, 6) AS hours_left,
      round((total - done) / {fv.ROWS_PER_MINUTE} / 60 / 24, 6) AS days_left
    FROM (SELECT count(speech_id) AS total, count(is_procedure) AS done FROM speeches)""",
    SPEECHES,
)
_INTRO = f"substring({stripped('lower(speech)')}, 1, {fv.INTRO_CHARS})"


def intro_ok(phrases: Sequence[str]) -> str:
    named = " OR ".join(f"contains({_INTRO}, {lit(p)})" for p in phrases)
    return f"(length(speech) >= {fv.SUBSTANTIVE_MIN_CHARS} AND NOT ({named}))"


sql(
    "intro_substantive",
    f"SELECT speech_id, {intro_ok(pm.INTRO_PHRASES)} AS is_substantive FROM speeches",
    SPEECHES,
)


def judged_speeches(noise: str) -> str:
    return f"""judged AS (
  SELECT *, coalesce(len(words) >= {fv.BIGRAM_MIN_WORDS} AND
    len(list_filter({pairs('words')}, lambda b: {noise})) / len(words) < {fv.BIGRAM_NOISE_SHARE}, false)
    AS is_substantive
  FROM (SELECT *, {split_space('lower(speech)')} AS words FROM speeches))"""


JUDGED = judged_speeches(f"b IN ({listed(pm.NOISE_BIGRAMS)})")
sql("bigram_substantive", "SELECT speech_id, is_substantive FROM judged", SPEECHES, JUDGED)
def _against_table(speech_id: str) -> str:
    return f"""SELECT speech_id, coalesce(max(len) >= {fv.BIGRAM_MIN_WORDS}
      AND count(noise.bigram) / max(len) < {fv.BIGRAM_NOISE_SHARE}, false) AS is_substantive
    FROM (SELECT n, speech_id, len(words) AS len,
        unnest(CASE WHEN len(words) > 1 THEN {pairs('words')} ELSE [''] END) AS bigram
      FROM (SELECT row_number() OVER () AS n, {speech_id} AS speech_id,
          {split_space('lower(speech)')} AS words FROM speeches)) s
    LEFT JOIN noise ON noise.bigram = s.bigram GROUP BY n, speech_id"""


_NOISE = f"""noise AS (SELECT DISTINCT unnest({pairs('words')}) AS bigram
      FROM (SELECT {word_list('text')} AS words FROM benchmark))"""
_REPEATED_ID = f"nullif(cast(speakerid % {pm.REPEATED_IDS} AS varchar), '0')"
sql("bigram_substantive_table", _against_table("speech_id"), SPEECHES, _NOISE)
sql("bigram_substantive_config", _against_table("speech_id"), SPEECHES, _NOISE)
sql("bigram_substantive_repeated", _against_table(_REPEATED_ID), SPEECHES, _NOISE)
sql(
    "quality_sample",
    f"""SELECT speech_id, speech, party, "date", congress_session FROM (
      SELECT *, {intro_ok(fv.INTRO_PHRASES)} AS passes FROM (
        SELECT *, md5('{pm.SEED}|' || speech_id) AS draw FROM speeches
        WHERE length(speech) > {fv.QUALITY_MIN_CHARS} ORDER BY draw, speech_id LIMIT {fv.QUALITY_BATCH}))
    ORDER BY passes DESC, CASE WHEN NOT passes THEN length(speech) END DESC NULLS LAST, draw, speech_id
    LIMIT 1""",
    SPEECHES,
)
sql(
    "label_badge",
    """SELECT speech_id, speaker, CASE is_procedure WHEN 1 THEN 'PROCEDURE' WHEN 0 THEN 'DEBATE'
        ELSE 'UNCERTAIN' END AS badge,
      cast("date" AS varchar) AS "date", party, congress_session || 'th' AS session, state_x AS state,
      speech AS transcript FROM speeches""",
    SPEECHES,
)

# ------------------------------------------------------------------ corpus

_CARD = 'speech_id, "date", speaker, party, state_x, speech, congress_session, is_procedure'
sql("speech_by_id", f"SELECT {_CARD} FROM speeches WHERE speech_id = '{pm.SPEECH_ID}'", SPEECHES)
sql(
    "speeches_by_id",
    f"""SELECT {_CARD} FROM speeches
    WHERE speech_id IN (SELECT cast(item_id AS varchar) FROM benchmark)""",
    SPEECHES,
)


def trend(where: str) -> str:
    return f"""SELECT cast("date" // 10000 AS integer) AS "year", party,
      CASE party WHEN 'D' THEN 'Democrat' ELSE 'Republican' END AS party_name, count(*) AS mention_count
    FROM speeches WHERE party IN ('D', 'R') AND {where} GROUP BY ALL ORDER BY "year", party"""


sql("phrase_trend", trend(f"is_procedure = 0 AND {has('speech', pm.PHRASE)}"), SPEECHES)
sql("phrase_trend_indexed", trend(has("speech", pm.RARE_PHRASE)), SPEECHES)
sql(
    "phrase_trend_indexed_wildcard",
    trend(f"{folded('speech')} LIKE '%{pm.RARE_WILDCARD.lower()}%'"),
    SPEECHES,
)
sql("phrase_trend_all", trend(has("speech", pm.PHRASE)), SPEECHES)
sql(
    "phrase_trend_wildcard",
    trend(f"{folded('speech')} LIKE '%{pm.WILDCARD.lower()}%'"),
    SPEECHES,
)
sql(
    "partisan_share",
    f"""SELECT congress_session, count(*) FILTER (party = 'D') AS "D_count",
      count(*) FILTER (party = 'R') AS "R_count", count(*) AS total,
      round(count(*) FILTER (party = 'R') / count(*), 6) AS rep_share
    FROM speeches WHERE party IN ('D', 'R') AND is_procedure = 0 AND {has('speech', pm.PHRASE)}
    GROUP BY congress_session ORDER BY congress_session""",
    SPEECHES,
)
sql(
    "session_browse",
    f"""SELECT {_CARD} FROM speeches WHERE congress_session = {pm.SESSION} AND is_procedure = 0
    ORDER BY speech_id LIMIT 20""",
    SPEECHES,
)
sql(
    "any_phrase_trend",
    f"""SELECT congress_session, count(*) AS mention_count FROM speeches
    WHERE {' OR '.join(has('speech', p) for p in pm.ANY_PHRASES)}
    GROUP BY congress_session ORDER BY congress_session""",
    SPEECHES,
)
HITS_OF = f"hits AS (SELECT * FROM judged WHERE is_substantive AND {has('speech', pm.PHRASE)})"
_HIT = [SPEECHES, JUDGED, HITS_OF]
_STATS = """count(*) FILTER (party = 'D') AS "D", count(*) FILTER (party = 'R') AS "R",
      count(*) FILTER (party IN ('D', 'R')) AS total,
      round(count(*) FILTER (party = 'R') / nullif(count(*) FILTER (party IN ('D', 'R')), 0), 6) AS rep_share"""
PIVOT = f"pivoted AS (SELECT congress_session, {_STATS} FROM hits GROUP BY congress_session)"
sql("session_party_pivot", "SELECT * FROM pivoted", *_HIT, PIVOT)
sql(
    "compare_phrases",
    f"""SELECT phrase, congress_session, {_STATS}
    FROM judged JOIN (VALUES ('{pm.PHRASE}'), ('{pm.OTHER_PHRASE}')) p(phrase)
      ON contains({folded('speech')}, phrase)
    WHERE is_substantive GROUP BY phrase, congress_session""",
    SPEECHES,
    JUDGED,
)
sql(
    "polarized_sessions",
    """SELECT *, round(abs(rep_share - 0.5), 6) AS gap FROM pivoted
    ORDER BY gap DESC NULLS LAST, congress_session LIMIT 5""",
    *_HIT,
    PIVOT,
)
sql(
    "available_sessions",
    "SELECT DISTINCT congress_session FROM hits ORDER BY congress_session DESC",
    *_HIT,
)
sql(
    "speech_gallery",
    f"""SELECT congress_session, cast("rank" AS integer) AS "rank", speech_id, party, relevance,
      replace(speech, '{pm.PHRASE}', '**{pm.PHRASE.upper()}**') AS highlighted
    FROM (SELECT *, row_number() OVER (PARTITION BY congress_session ORDER BY relevance DESC, speech_id)
        AS "rank"
      FROM (SELECT *, cast(len(regexp_extract_all(speech, '{pm.PHRASE}')) AS integer) AS relevance
        FROM hits))
    WHERE "rank" <= 5""",
    *_HIT,
)
sql(
    "party_label",
    """SELECT speech_id, party, CASE party WHEN 'D' THEN 'Democrat' WHEN 'R' THEN 'Republican' END
      AS party_name FROM speeches""",
    SPEECHES,
)

# ------------------------------------------------------------------- terms


def top_words(table: str, text: str, group: str, groups, stops, min_chars: int, k: int) -> str:
    return f"""SELECT {group}, word, n, cast(r AS integer) AS "rank" FROM (
      SELECT {group}, word, count(*) AS n,
        row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, word) AS r
      FROM (SELECT {group}, unnest({word_list(text, min_chars)}) AS word FROM {table}
        WHERE {group} IN ({listed(groups)}))
      WHERE word NOT IN ({listed(stops)}) GROUP BY {group}, word) WHERE r <= {k}"""


_STOPS = fv.CONGRESS_STOPWORDS + fv.STANDARD_STOPWORDS
sql("top_words", top_words("speeches", "speech", "party", "DR", _STOPS, 3, 10), SPEECHES)
sql(
    "top_words_strict",
    top_words(
        "speeches", "speech", "party", "DR", fv.STRICT_STOPWORDS + fv.STRICT_PROCEDURAL, 4, 15
    ),
    SPEECHES,
)
sql("top_words_by_role", top_words("conversations", "text", "role", pm.ROLES, _STOPS, 3, 10))
sql(
    "vocab_counts",
    f"""SELECT word, "D", "R", "D" + "R" AS total FROM (
      SELECT v.word, i, count(*) FILTER (party = 'D') AS "D", count(*) FILTER (party = 'R') AS "R"
      FROM (VALUES {rows(list(enumerate(pm.VOCABULARY)))}) v(i, word)
      LEFT JOIN (SELECT party, unnest({word_list('speech', 2)}) AS word FROM speeches
        WHERE party IN ('D', 'R')) t ON t.word = v.word GROUP BY v.word, i)
    ORDER BY total DESC, i LIMIT 15""",
    SPEECHES,
)


def kept(text: str, stops: Sequence[str]) -> str:
    return f"list_filter({word_list(text, 2)}, lambda w: w NOT IN ({listed(sorted(set(stops)))}))"


def tfidf(words: str, terms: str, max_df: float = 1.0, min_df: int = 1, text="speech", where="true"):
    return [
        SPEECHES,
        f"""docs AS (SELECT row_number() OVER () AS doc, party, {terms} AS terms
          FROM (SELECT party, {words} AS words FROM (
            SELECT party, {text} AS speech FROM speeches WHERE party IN ('D', 'R'))
          WHERE {where}))""",
        """tf AS (SELECT doc, party, term, count(*) AS tf
          FROM (SELECT doc, party, unnest(terms) AS term FROM docs) GROUP BY ALL)""",
        "sizes AS (SELECT party, count(*) AS n FROM docs GROUP BY party)",
        f"""idf AS (SELECT party, term, ln((1 + n) / (1 + df)) + 1 AS idf
          FROM (SELECT party, term, count(*) AS df FROM tf GROUP BY party, term) JOIN sizes USING (party)
          WHERE df >= {min_df} AND df <= {max_df}::double * n)""",
        "weights AS (SELECT doc, party, term, tf * idf AS w FROM tf JOIN idf USING (party, term))",
        "lengths AS (SELECT doc, sqrt(sum(w * w)) AS l FROM weights GROUP BY doc)",
        """scores AS (SELECT party, term, round(sum(w / l), 6) AS score
          FROM weights JOIN lengths USING (doc) GROUP BY party, term)""",
    ]


def top_terms(k: int) -> str:
    return f"""SELECT party, term, score, cast(r AS integer) AS "rank" FROM (
      SELECT *, row_number() OVER (PARTITION BY party ORDER BY score DESC, term) AS r FROM scores)
    WHERE r <= {k}"""


_BIGRAM_STOPS = pm.STOP_WORDS + fv.BIGRAM_NOISE_WORDS
_FINAL_STOPS = _BIGRAM_STOPS + fv.BOILERPLATE_BIGRAMS + fv.STATE_STOPWORDS
sql("tfidf_unigram", top_terms(10), *tfidf(kept("speech", pm.STOP_WORDS), "words", 0.7, 5))
# Ids play no part: the answer is the same where they repeat or are missing.
ORACLE["tfidf_unigram_repeated"] = ORACLE["tfidf_unigram"]
sql("tfidf_bigram", top_terms(10), *tfidf(kept("speech", _BIGRAM_STOPS), pairs("words"), 0.5, 10))
sql("tfidf_bigram_final", top_terms(12), *tfidf(kept("speech", _FINAL_STOPS), pairs("words"), 0.4, 5))
_DEEP = "lower(speech)"
for _phrase in fv.DEEP_CLEAN_PHRASES:
    _DEEP = f"replace({_DEEP}, '{_phrase}', '')"
_NO_NUMBERS = r"regexp_replace(speech, '\b[0-9]+\b', '', 'g')"
sql(
    "deep_clean_tfidf",
    top_terms(10),
    *tfidf(
        # bare numbers are whole words, so dropping the words drops the numbers
        f"list_filter({kept('speech', pm.STOP_WORDS + fv.DEEP_CLEAN_STOPWORDS)},"
        " lambda w: NOT regexp_matches(w, '^[0-9]+$'))",
        pairs("words"),
        0.3,
        10,
        text=_DEEP,
        where=f"{squeezed(_NO_NUMBERS)} <> ''",
    ),
)
ORACLE["deep_clean_tfidf_repeated"] = ORACLE["deep_clean_tfidf"]
_VOCABULARY = [(t, c) for c, ts in pm.CATEGORIES.items() for t in ts]
_VOCABULARY_SCORES = tfidf(
    kept("speech", pm.STOP_WORDS),
    f"list_filter(list_concat(words, {pairs('words')}),"
    f" lambda t: t IN ({listed([t for t, _ in _VOCABULARY])}))",
)
sql(
    "vocab_tfidf",
    f"""SELECT party, term, category, score, cast(r AS integer) AS "rank" FROM (
      SELECT p.party, v.term, category, coalesce(score, 0.0) AS score,
        row_number() OVER (PARTITION BY p.party ORDER BY coalesce(score, 0.0) DESC, i) AS r
      FROM (VALUES ('D'), ('R')) p(party)
      CROSS JOIN (VALUES {rows([(i, t, c) for i, (t, c) in enumerate(_VOCABULARY)])}) v(i, term, category)
      LEFT JOIN scores s ON s.party = p.party AND s.term = v.term) WHERE r <= 10""",
    *_VOCABULARY_SCORES,
)
sql(
    "vocab_tfidf_categories",
    f"""SELECT p.party, category, count(*) AS n_terms, round(sum(coalesce(score, 0.0)), 4) AS score
      FROM (VALUES ('D'), ('R')) p(party)
      CROSS JOIN (VALUES {rows([(i, t, c) for i, (t, c) in enumerate(_VOCABULARY)])}) v(i, term, category)
      LEFT JOIN scores s ON s.party = p.party AND s.term = v.term GROUP BY p.party, category""",
    *_VOCABULARY_SCORES,
)


def context(hits: str) -> str:
    phrase = pm.PHRASE.split()
    n, w = len(phrase), fv.CONTEXT_WINDOW
    starts = (
        f"list_filter(range(1, len(words) - {n} + 2),"
        f" lambda i: words[i : i + {n - 1}] = [{listed(phrase)}])"
    )
    return f"""SELECT word, count(*) AS n FROM (
      SELECT unnest(flatten(list_transform({starts}, lambda i: list_concat(
        words[greatest(i - {w}, 1) : i - 1], words[i + {n} : i + {n + w - 1}])))) AS word FROM {hits})
    WHERE length(word) >= {fv.CONTEXT_MIN_CHARS}
      AND word NOT IN ({listed(pm.CONTEXT_STOP_WORDS + fv.CONTEXT_STOPWORDS)})
    GROUP BY word ORDER BY n DESC, word LIMIT 10"""


sql(
    "context_words",
    context(
        f"(SELECT * FROM hits ORDER BY md5('{pm.SEED}|' || speech_id), speech_id LIMIT {fv.CONTEXT_SAMPLE})"
    ),
    *_HIT,
)
sql("context_words_all", context("hits"), *_HIT)

# ---------------------------------------------------------------- entities

WORDS = """words AS (
  SELECT speech_id, regexp_extract_all(speech, '[\\p{L}\\p{N}_]+') AS words FROM speeches)"""
TAGGED = f"""tagged AS (
  SELECT speech_id, cast(i AS integer) AS "position", array_to_string(words[i + 1 : i + n], ' ') AS ent_text, label
  FROM (SELECT speech_id, words, unnest(range(0, len(words))) AS i FROM words) w
  JOIN (SELECT *, parts[1] AS first, len(parts) AS n, array_to_string(parts, ' ') AS whole
    FROM (SELECT term, label, {word_list('term')} AS parts FROM (VALUES {rows(pm.GAZETTEER)}) v(term, label))) g
    ON g.first = lower(words[i + 1]) AND lower(array_to_string(words[i + 1 : i + n], ' ')) = g.whole)"""
KEPT = f"""kept AS (
  SELECT t.*, p.category, lower(ent_text) NOT IN ({listed(pm.ENTITY_STOPS)}) AND
    (p.category IS NOT NULL OR label IN ({listed(fv.STANDARD_ENTITY_LABELS)})) AS keep
  FROM tagged t LEFT JOIN (SELECT array_to_string({word_list('term')}, ' ') AS term, category
    FROM (VALUES {rows(pm.POLICY_TERMS)}) v(term, category)) p ON p.term = lower(ent_text))"""
_ENT = [SPEECHES, WORDS, TAGGED, KEPT]
sql("entity_tag", "SELECT * FROM tagged", *_ENT[:3])
sql(
    "entity_denoise",
    'SELECT speech_id, "position", ent_text, label FROM kept WHERE keep',
    *_ENT,
)
sql(
    "entity_table",
    f"""SELECT speech_id, "position", ent_text AS entity, coalesce(category, label) AS type,
      CASE WHEN category IS NULL THEN '{fv.MODEL_SOURCE}' ELSE '{fv.POLICY_SOURCE}' END AS source
    FROM kept WHERE keep ORDER BY speech_id, source DESC, "position", entity""",
    *_ENT,
)
sql(
    "entity_stats",
    """SELECT speech_id, count(*) AS n_entities, count(*) FILTER (keep) AS n_kept
    FROM kept GROUP BY speech_id""",
    *_ENT,
)

ORACLE["ingest_stream_json"] = ORACLE["ingest_stream_folded"] = ORACLE["ingest_stream"]
