"""The queries' results in SQL over the supplied tables."""

from __future__ import annotations

from logtide.operators.classify import SIGNAL_WORDS

ORACLES: dict[str, str] = {}

# --- functions, as SQL text -----------------------------------------------------


def fold(x: str) -> str:
    ascii_only = rf"regexp_replace({x}, '[^\x00-\x7F]', '', 'g')"
    return rf"regexp_replace({ascii_only}, '[ \t\x0B\f\r\x1c-\x1f]+', ' ', 'g')"


def clean(x: str) -> str:
    for pattern, to in (
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IPADDRESS"), (r"https?://\S+|www\.\S+", "URL"),
        ("[^a-zA-Z0-9]", " "), (r"\d+", ""), ("([a-z])([A-Z])", r"\1 \2"),
        ("([A-Z])([A-Z][a-z])", r"\1 \2"), (" +", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"lower(trim({x}))"


def digits(x: str) -> str:
    return f"length(regexp_replace({x}, '[^0-9]', '', 'g'))"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^a-zA-Z]', '', 'g'))"


def tokens(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def mask(x: str) -> str:
    for pattern, to in (
        (r"\b(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))\b", "<:ID:>"),
        (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "<:IP:>"),
        (r"\b([0-9a-f]{6,} ?){3,}\b", "<:SEQ:>"), (r"\b([0-9A-F]{4} ?){4,}\b", "<:SEQ:>"),
        (r"\b(0x[a-f0-9A-F]+)\b", "<:HEX:>"), (r"\b([\-\+]?\d+)\b", "<:NUM:>"),
        ('(executed cmd )(".+?")', r"\1<:CMD:>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def scores(x: str, words: dict[str, list[str]]) -> tuple[str, str]:
    """(label, score) of the rule classifier."""
    hits = {k: "(" + " + ".join(f"contains({x}, '{w}')::INT" for w in v) + ")" for k, v in words.items()}
    most = f"greatest({', '.join(hits.values())})"
    total = " + ".join(hits.values())
    label = "CASE " + " ".join(f"WHEN {h} = {most} THEN '{k}'" for k, h in hits.items()) + " END"
    return label, f"CASE WHEN {total} = 0 THEN 0.0 ELSE {most} / ({total}) END"


def utc(x: str) -> str:
    return f"strftime(make_timestamp(CAST(floor({x}) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


def us(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


# --- inputs -----------------------------------------------------------------------

MESSAGE = """CASE event_type WHEN 'click' THEN 'request served from cache'
 WHEN 'view' THEN 'response slow, latency above target'
 WHEN 'purchase' THEN 'session started for user' WHEN 'signup' THEN 'disk full on storage volume'
 WHEN 'error' THEN 'connection failed with exception' END"""
KIND = "(list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type))"
SIGNAL = """CASE event_type WHEN 'click' THEN 'traffic' WHEN 'view' THEN 'latency'
 WHEN 'purchase' THEN 'information' WHEN 'signup' THEN 'saturation' WHEN 'error' THEN 'error' END"""
FAULTS = """CASE event_type WHEN 'click' THEN 'application' WHEN 'view' THEN 'io'
 WHEN 'purchase' THEN 'other' WHEN 'signup' THEN 'io' WHEN 'error' THEN 'network,application' END"""
MOMENT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
FILE = "'app-' || (user_id % 8) || '.log'"

WITH_LINES = f"""WITH ev AS (SELECT *, {FILE} AS file_name, {MOMENT} AS ts_text,
  {MOMENT} || ' [' || event_type || '] app[' || user_id || ']: ' || {MESSAGE} || ' value=' ||
  CAST(value AS DECIMAL(18,2)) || ' props ' || props AS line FROM events),
event_lines AS (SELECT file_name, event_id * 4 AS line_seq, line AS value, event_type, 0 AS pos FROM ev
  UNION ALL SELECT file_name, event_id * 4 + 1, '  at frame ' || (event_id % 7), event_type, 1 FROM ev WHERE event_type = 'error'
  UNION ALL SELECT file_name, event_id * 4 + 2, 'caused by code ' || (user_id % 13), event_type, 2 FROM ev WHERE event_type = 'error'),
document_lines AS (SELECT source || '.txt' AS file_name, doc_id * 100000 + i - 1 AS line_seq, parts[i] AS value
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)))
"""
WITH_LABELLED = f"""WITH lab AS (SELECT event_id, {FILE} AS file_name, epoch_us(ts) / 1e6 AS epoch,
  {MESSAGE} || ' by ' || user_id AS text, {MESSAGE} AS clean_text,
  {KIND} * 1000 + user_id % 40 AS template_id, {MESSAGE} || ' by <*>' AS template, user_id, event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, {SIGNAL} AS golden_signal, {FAULTS} AS faults,
  split_part({FAULTS}, ',', 1) AS fault FROM events)
"""

# --- sources ------------------------------------------------------------------------

ORACLES["line_scan"] = WITH_LINES + "SELECT file_name, value FROM event_lines"
ORACLES["archive_lines"] = """SELECT doc_id, i - 1 AS line_seq, parts[i] AS value
 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
       FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
 WHERE i < len(parts) OR parts[i] <> ''"""
ORACLES["file_stats"] = WITH_LINES + r"""SELECT file_name, count(*) AS num_lines,
 count(*) FILTER (WHERE regexp_replace(value, '\s+', '', 'g') = '') AS num_blank FROM document_lines GROUP BY 1"""
ORACLES["input_stats"] = WITH_LINES + """SELECT sum(strlen(value) + 1) AS total_size_bytes,
 count(*) AS num_log_lines_total, 0 AS num_log_lines_whitespaces FROM event_lines"""
_SUFFIXES = "['.log', '.txt', '.log.1', '.log2', '.txt.-3', '.csv', '.xml.bak', '.tsv', '']"
ORACLES["file_selection"] = f"""SELECT 'f' || page_id || suffix AS name,
 suffix IN ('.log', '.txt', '.log.1', '.log2', '.txt.-3') AS processed,
 suffix NOT IN ('.csv', '.xml.bak', '.tsv') AS by_name
 FROM (SELECT page_id, {_SUFFIXES}[page_id % 9 + 1] AS suffix FROM pages)"""
ORACLES["json_split"] = "SELECT event_id AS line_seq, event_id % 5 IN (0, 1) AS is_json FROM events"
_JSON_TEXT = "event_type || ' by user ' || user_id"
ORACLES["json_flatten"] = f"""
SELECT event_id AS line_seq, 'time' AS key, {MOMENT} AS value FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'message', {_JSON_TEXT} FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'props_k', json_extract_string(props, '$.k') FROM events WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'meta_time', CAST((epoch_us(ts) // 1000) AS VARCHAR) FROM events WHERE event_id % 5 = 1
UNION ALL SELECT event_id, 'body_message', {_JSON_TEXT} FROM events WHERE event_id % 5 = 1
UNION ALL SELECT event_id, 'body_deep_user', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 5 = 1"""
ORACLES["json_records"] = f"""SELECT event_id AS line_seq,
 CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) ELSE (epoch_us(ts) // 1000) * 1000 END AS epoch_us, t AS text,
 {clean('t')} AS clean_text, {digits('t')} AS digit_count, {digits('t')} + {letters('t')} + 1 AS char_count,
 {tokens('t')} AS token_count FROM (SELECT *, {_JSON_TEXT} AS t FROM events) WHERE event_id % 5 IN (0, 1)"""
ORACLES["json_discarded"] = f"""SELECT event_id AS line_seq, '  {{"meta": {{"time": ' || (epoch_us(ts) // 1000) ||
 '}}, "body": {{"message": "' || {_JSON_TEXT} || '", "deep": {{"user": ' || user_id || '}}}}}}' AS value
 FROM events WHERE event_id % 5 = 1"""
ORACLES["unquoted_csv"] = WITH_LABELLED + rf"SELECT template_id, text || chr(10) || '\end' AS text, {us('epoch')} AS epoch_us FROM lab"
ORACLES["json_time"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) * 1000
 ELSE epoch_us(ts) END AS epoch_us FROM events"""

# --- scalar functions -----------------------------------------------------------------

ORACLES["ascii_fold"] = WITH_LINES + f"SELECT file_name, line_seq, {fold('value')} AS folded FROM document_lines"
ORACLES["clean_text"] = WITH_LINES + f"SELECT file_name, line_seq, {clean(fold('value'))} AS clean_text FROM document_lines"
ORACLES["char_counts"] = WITH_LINES + f"""SELECT file_name, line_seq, {digits('t')} AS digits,
 {letters('t')} AS letters, {tokens('t')} AS tokens FROM (SELECT *, {fold('value')} AS t FROM document_lines)"""

_ORDERS = "(SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)"


def _order(name: str, text: str, moment: str = "epoch_us(t)", valid: str = "true") -> None:
    ORACLES[name] = f"""SELECT o_orderkey AS line_seq, CASE WHEN {valid} THEN {text} END AS ts_text,
 CASE WHEN {valid} THEN {moment} END AS epoch_us FROM {_ORDERS}"""


_CLOCK = "(epoch_us(t) - epoch_us(date_trunc('day', t)))"
_order("ts_iso", "strftime(t, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")
_order("ts_space", "strftime(t, '%Y-%m-%d %H:%M:%S') || ',250'", "epoch_us(t) + 250000")
_order("ts_us", "strftime(t, '%m/%d/%y %H:%M:%S')")
_order("ts_us_year", "strftime(t, '%-m/%-d/%Y, %-H:%-M:%-S') || ' AM'")
_order("ts_day_first", "strftime(t, '%d.%m.%Y %H:%M:%S')")
_order("ts_apache", "strftime(t, '%d/%b/%Y:%H:%M:%S')")
_order(
    "ts_syslog", "strftime(t, '%b %d %H:%M:%S')",
    f"epoch_us(make_timestamp(1900, month(t), CASE WHEN month(t) = 2 THEN least(day(t), 28) ELSE day(t) END, 0, 0, 0)) + {_CLOCK}",
    "NOT (month(t) = 2 AND day(t) = 29)",
)
_order("ts_weekday", "'Mon ' || strftime(t, '%b %d %H:%M:%S %Y')")
_order("ts_dashed", "strftime(t, '%Y-%m-%d-%H.%M.%S.%f')")
_order("ts_packed", "strftime(t, '%Y%m%dT%H%M%S') || '.125UTC'", "epoch_us(t) + 125000")
_order("ts_clock", "strftime(t, '%H:%M:%S') || ',500'", f"epoch_us(TIMESTAMP '1900-01-01') + {_CLOCK} + 500000")
_order("ts_hex", "lower(printf('%x', CAST(epoch(t) AS BIGINT)))")
_order("ts_zone", "strftime(t, '%Y-%m-%d %H:%M:%S') || ' JST'", "epoch_us(t) - 32400000000")
_order("ts_offset", "strftime(t, '%Y-%m-%d %H:%M:%S') || '+0530'", "epoch_us(t) - 19800000000")
_order(
    "ts_day_of_year", "'20' || strftime(t, '%y%j %H:%M:%S') || '.5'",
    f"epoch_us(make_timestamp(2000 + year(t) % 100, 1, 1, 0, 0, 0)) + (dayofyear(t) - 1) * 86400000000 + {_CLOCK} + 500000",
)
_order(
    "ts_epoch", "CAST(CAST(epoch(t) AS BIGINT) + 600000000 AS VARCHAR)", "epoch_us(t) + 600000000000000",
    "epoch(t) + 600000000 BETWEEN 1420070400 AND 1464739200",
)
_order("ts_source_zone", "strftime(t, '%Y/%m/%d-%H:%M:%S')", "epoch_us(t) - 32400000000")
_order("ts_loose", "strftime(t, '%Y-%m-%d %H:%M:%S')", valid=f"{_CLOCK} > 0")
# Of the forms, in the order of their list: date and time as ISO, with slashes, without year, in brackets (a time to the
# main patterns already), time alone, with weekday, and those that a shorter span overlaps from the left. All others are none.
_TODAY = f"epoch_us(TIMESTAMP '1996-06-01') + {_CLOCK}"
_SAME_YEAR = f"epoch_us(make_timestamp(1996, month(t), day(t), 0, 0, 0)) + {_CLOCK}"
ORACLES["ts_loose_forms"] = f"""SELECT o_orderkey AS line_seq, CASE WHEN {_CLOCK} > 0 THEN CASE o_orderkey % 14
 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' WHEN 1 THEN strftime(t, '%Y/%m/%d %H:%M:%S')
 WHEN 2 THEN strftime(t, '%b %d %H:%M:%S') WHEN 4 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN strftime(t, '%H:%M:%S.%g')
 WHEN 9 THEN strftime(t, '%a, %d %b %Y %H:%M:%S') || ' GMT' WHEN 12 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
 WHEN 13 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') END END AS ts_text, CASE WHEN {_CLOCK} > 0 THEN CASE o_orderkey % 14
 WHEN 0 THEN epoch_us(t) WHEN 1 THEN epoch_us(t) WHEN 2 THEN {_SAME_YEAR} WHEN 4 THEN epoch_us(t) WHEN 6 THEN {_TODAY} WHEN 9 THEN epoch_us(t)
 WHEN 12 THEN epoch_us(t) WHEN 13 THEN epoch_us(t) END END AS epoch_us FROM {_ORDERS}"""
ORACLES["ts_pattern_hits"] = "SELECT 2 AS pattern_index, count(*) AS hits FROM events"

ORACLES["display_values"] = WITH_LABELLED + f"""SELECT event_id AS id, {utc('epoch')} AS utc,
 {utc('epoch + 19800')} AS "local", CASE WHEN b >= 1e9 THEN printf('%.1f GB', b / 1e9)
 WHEN b >= 1e6 THEN printf('%.1f MB', b / 1e6) WHEN b >= 1e3 THEN printf('%.1f KB', b / 1e3) ELSE b || ' B' END AS size,
 format('{{:,}}', b) AS "grouped", CASE WHEN event_id = 0 THEN 0 ELSE round(log10(event_id + 1), 2) END AS scaled,
 file_name AS base, text || '&#13;&#10;next => Fault-Categories: ' || fault || ' => Golden-Signal: ' || golden_signal AS line
 FROM (SELECT *, event_id * 977 AS b FROM lab)"""
ORACLES["text_preview"] = """SELECT doc_id, CASE WHEN length(text) < 500 THEN text
 ELSE substring(text, 1, 400) || '...' END AS preview, replace(text, chr(10), '</br>') AS breaks FROM documents"""
ORACLES["escape_tags"] = r"""SELECT page_id, array_to_string(list_transform(
 regexp_extract_all(regexp_replace(regexp_replace(html, '(?i)</?script>', '', 'g'), '(<br\s*/?>\s*)+', '<br>', 'g'),
 '<[^>]+>|[^<]+|<'), lambda p: CASE WHEN lower(p) IN ('<br>', '<br/>', '</br>') THEN p
 ELSE replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END), '') AS escaped FROM pages"""
ORACLES["strip_tags"] = "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS stripped FROM pages"
ORACLES["bracket_tokens"] = WITH_LINES + """SELECT line_seq,
 CASE pos WHEN 0 THEN event_type || '|app' ELSE '' END AS tokens FROM event_lines"""
ORACLES["distinct_tokens"] = "SELECT DISTINCT event_type AS token FROM events UNION SELECT 'app'"

# --- records ----------------------------------------------------------------------------


def _counts(x: str, ts: str) -> str:
    rest = f"replace({x}, {ts}, '')"
    return (
        f"{digits(rest)} AS digit_count, {digits(rest)} + {letters(rest)} + 1 AS char_count,"
        f" {tokens(x)} AS token_count"
    )


WITH_RECORDS = WITH_LINES + f""", parsed AS (SELECT l.file_name, l.line_seq // 4 * 4 AS head, l.pos, t AS text,
  {clean('t')} AS clean_text, {_counts('t', 'ev.ts_text')}, epoch_us(ev.ts) AS epoch_us, ev.ts_text
  FROM (SELECT *, {fold('value')} AS t FROM event_lines) l JOIN ev ON ev.event_id = l.line_seq // 4),
recs AS (SELECT file_name, head AS line_seq, any_value(epoch_us) AS epoch_us, any_value(ts_text) AS ts_text,
  string_agg(text, chr(10) ORDER BY pos) AS text, string_agg(clean_text, chr(10) ORDER BY pos) AS clean_text,
  CAST(sum(digit_count) AS BIGINT) AS digit_count, CAST(sum(char_count) AS BIGINT) AS char_count,
  CAST(sum(token_count) AS BIGINT) AS token_count FROM parsed GROUP BY 1, 2),
docs AS (SELECT file_name, line_seq, t AS text, {digits('t')} AS digit_count,
  {digits('t')} + {letters('t')} + 1 AS char_count, {tokens('t')} AS token_count
  FROM (SELECT *, {fold('value')} AS t FROM document_lines))
"""
ORACLES["segment_records"] = WITH_RECORDS + "SELECT * FROM recs"
ORACLES["untimed_lines"] = WITH_RECORDS + "SELECT * FROM docs"
ORACLES["numeric_ratio"] = WITH_RECORDS + "SELECT file_name, line_seq FROM recs WHERE digit_count / char_count < 0.3"
ORACLES["time_range"] = WITH_LABELLED + """SELECT event_id FROM lab
 WHERE epoch >= (SELECT max(epoch) FROM lab) - 7 * 86400"""
ORACLES["interval_filter"] = """SELECT event_id FROM events
 WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-13'"""
_DOC_STATS = f"""WITH d AS (SELECT doc_id, text, {tokens('text')} AS n FROM documents),
 s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd, count(*) AS c FROM d) """
ORACLES["corpus_stats"] = _DOC_STATS + """SELECT c AS num_records, round(m, 6) AS mean_tokens,
 round(sd, 6) AS sd_tokens, (SELECT min(doc_id) FROM d) * 1.0 AS min_epoch, (SELECT max(doc_id) FROM d) * 1.0 AS max_epoch FROM s"""
ORACLES["truncate_long"] = _DOC_STATS + """SELECT doc_id, CASE WHEN n > floor(m + 2 * sd)
 THEN substring(text, 1, CAST(floor(m + 2 * sd) AS INT)) ELSE text END AS truncated_log,
 round((n - m) / sd, 6) AS z_score FROM d, s"""
ORACLES["truncation_count"] = _DOC_STATS + "SELECT count(*) AS num_truncated FROM d, s WHERE (n - m) / sd > 2"
WITH_BUILT = WITH_RECORDS + """, kept AS (SELECT * FROM recs WHERE digit_count / char_count < 0.65),
 built AS (SELECT file_name, line_seq, epoch_us, ts_text, text, token_count, 0 AS section FROM kept
  UNION ALL SELECT file_name, line_seq, m, strftime(make_timestamp(m), '%Y-%m-%d %H:%M:%S'), text, token_count, 2
  FROM docs, (SELECT max(epoch_us) AS m FROM kept)),
 bound AS (SELECT CAST(floor(avg(token_count) + 2 * stddev_samp(token_count)) AS INT) AS b FROM built)
"""
ORACLES["build_records"] = WITH_BUILT + """SELECT file_name, line_seq, epoch_us, ts_text,
 CASE WHEN token_count > b THEN substring(text, 1, b) ELSE text END AS truncated_log FROM built, bound"""

ORACLES["json_section"] = WITH_RECORDS + f""", js AS (SELECT 'nested.json.log' AS file_name, event_id AS line_seq,
  (epoch_us(ts) // 1000) * 1000 AS epoch_us, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ts_text, t AS text,
  {digits('t')} AS digit_count, {digits('t')} + {letters('t')} + 1 AS char_count, {tokens('t')} AS token_count
  FROM (SELECT *, {_JSON_TEXT} AS t FROM events)),
 kept AS (SELECT * FROM (SELECT 0 AS section, file_name, line_seq, epoch_us, ts_text, text, digit_count, char_count, token_count FROM recs
  UNION ALL SELECT 1, file_name, line_seq, epoch_us, ts_text, text, digit_count, char_count, token_count FROM js)
  WHERE digit_count / char_count < 0.65),
 built AS (SELECT section, file_name, line_seq, epoch_us, ts_text, text, token_count FROM kept
  UNION ALL SELECT 2, file_name, line_seq, m, strftime(make_timestamp(m), '%Y-%m-%d %H:%M:%S'), text, token_count
  FROM docs, (SELECT max(epoch_us) AS m FROM kept)),
 bound AS (SELECT CAST(floor(avg(token_count) + 2 * stddev_samp(token_count)) AS INT) AS b FROM built)
 SELECT section, file_name, line_seq, epoch_us, ts_text,
 CASE WHEN token_count > b THEN substring(text, 1, b) ELSE text END AS truncated_log FROM built, bound"""

# --- templates ----------------------------------------------------------------------------

ORACLES["mask_variables"] = WITH_LINES + f"""SELECT file_name, line_seq, {mask(fold('value'))} AS masked FROM
 (SELECT file_name, line_seq, value FROM event_lines UNION ALL SELECT file_name, line_seq, value FROM document_lines)"""
ORACLES["exact_templates"] = WITH_LINES + rf"""SELECT trim(regexp_replace({mask(fold('value'))}, '[_\s]+', ' ', 'g')) AS template,
 count(*) AS occurrences FROM document_lines GROUP BY 1"""
# Learning one shape after the other: each step takes the next shape of every leaf, finds the template with most equal
# tokens (of equals the one with more wildcards, then the older) and changes it, or adds one.
WITH_LEARNED = WITH_BUILT.replace("WITH ", "WITH RECURSIVE ", 1) + rf""",
 logs AS MATERIALIZED (SELECT section, file_name, line_seq, log, trim(regexp_replace({mask('log')}, '[_\s]+', ' ', 'g')) AS shape FROM
  (SELECT *, CASE WHEN token_count > b THEN substring(text, 1, b) ELSE text END AS log FROM built, bound)),
 shapes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY length, lead ORDER BY since) AS i FROM (
  SELECT shape, string_split(shape, ' ') AS words, CASE WHEN shape = '' THEN 0 ELSE len(string_split(shape, ' ')) END AS length,
   CASE WHEN regexp_matches(split_part(shape, ' ', 1), '\d|^<\*>$') THEN '<*>' ELSE split_part(shape, ' ', 1) END AS lead,
   count(*) AS n, min((section, file_name, line_seq)) AS since FROM logs GROUP BY shape)),
 learn AS (
  SELECT DISTINCT length, lead, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS t, CAST(0 AS BIGINT) AS hit FROM shapes
  UNION ALL
  SELECT length, lead, i, CASE WHEN best.e >= 0.4 * length THEN
    list_transform(t, lambda x, k: CASE WHEN k = -best.k THEN list_transform(range(1, length + 1), lambda q:
     CASE WHEN x[q] = words[q] THEN x[q] ELSE '<*>' END) ELSE x END)
   ELSE list_append(t, words) END, CASE WHEN best.e >= 0.4 * length THEN -best.k ELSE len(t) + 1 END
  FROM (SELECT s.length, s.lead, s.i, s.words, t, list_reverse_sort(list_transform(t, lambda x, k: {{
     'e': len(list_filter(range(1, s.length + 1), lambda q: x[q] = s.words[q] AND x[q] <> '<*>')),
     'w': len(list_filter(x, lambda z: z = '<*>')), 'k': -k}}))[1] AS best
    FROM learn l JOIN shapes s ON s.length = l.length AND s.lead = l.lead AND s.i = l.i + 1)),
 last_ AS (SELECT length, lead, arg_max(t, i) AS t FROM learn GROUP BY 1, 2),
 assigned AS (SELECT shape, array_to_string(last_.t[hit], ' ') AS template, n, since FROM learn
  JOIN shapes USING (length, lead, i) JOIN last_ USING (length, lead)),
 tmpl AS (SELECT template, CAST(sum(n) AS BIGINT) AS occurrences, row_number() OVER (ORDER BY min(since), template) AS template_id
  FROM assigned GROUP BY template)
"""
ORACLES["mine_templates"] = WITH_LEARNED + """SELECT file_name, line_seq, template_id, template
 FROM logs JOIN assigned USING (shape) JOIN tmpl USING (template)"""
ORACLES["extract_templates"] = WITH_LEARNED + "SELECT template_id, template, occurrences FROM tmpl"
ORACLES["template_variables"] = WITH_LEARNED + r"""SELECT template_id, len(string_split(template, '<*>')) - 1 AS var_count,
 to_json(CASE WHEN flat = '' OR template = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(
  list_filter(range(1, least(len(w), len(s)) + 1), lambda q: s[q] = '<*>'),
  lambda q: CASE WHEN q = len(s) THEN array_to_string(w[q:], ' ') ELSE w[q] END) END) AS variables
 FROM (SELECT *, string_split(flat, ' ') AS w, string_split(trim(regexp_replace(template, '[_\s]+', ' ', 'g')), ' ') AS s
  FROM (SELECT *, trim(regexp_replace(log, '[_\s]+', ' ', 'g')) AS flat FROM logs JOIN assigned USING (shape) JOIN tmpl USING (template)))"""
ORACLES["extract_variables"] = WITH_LABELLED + """SELECT event_id, CASE WHEN template_id % 2 = 0
 THEN w[1] || '|' || w[2] || '|' || array_to_string(w[4:], ' ') ELSE CAST(user_id AS VARCHAR) END AS variables,
 CASE WHEN template_id % 2 = 0 THEN 3 ELSE 1 END AS var_count
 FROM (SELECT *, string_split(text, ' ') AS w FROM lab)"""
ORACLES["match_templates"] = f"SELECT event_id, {MESSAGE} || ' by <:NUM:>' AS template FROM events"
_STAMP = "<:NUM:><:NUM:><:NUM:> <:NUM:>:<:NUM:>:<:NUM:>.<:NUM:>"
_TAIL = 'value=<:NUM:>.<:NUM:> props {"k": <:NUM:>}'
# In the event logs two pairs of event types share a token count and enough of
# their tokens to fall together.
WITH_MINED = WITH_BUILT + f""", mined AS (SELECT built.*, ev.event_type, ev.event_id, CASE
  WHEN event_type IN ('click', 'purchase') THEN '{_STAMP} ' || CASE WHEN both_a THEN '<*> app[<:NUM:>]: <*> <*> <*> <*>'
    ELSE '[' || event_type || '] app[<:NUM:>]: ' || {MESSAGE} END || ' {_TAIL}'
  WHEN event_type IN ('view', 'signup') THEN '{_STAMP} ' || CASE WHEN both_b THEN '<*> app[<:NUM:>]: <*> <*> <*> <*> <*>'
    ELSE '[' || event_type || '] app[<:NUM:>]: ' || {MESSAGE} END || ' {_TAIL}'
  ELSE '{_STAMP} [error] app[<:NUM:>]: connection failed with exception {_TAIL} at frame <:NUM:> caused by code <:NUM:>'
  END AS template FROM (SELECT * FROM built WHERE section = 0) built JOIN ev ON ev.event_id = built.line_seq // 4,
  (SELECT count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'purchase')) = 2 AS both_a,
          count(DISTINCT event_type) FILTER (WHERE event_type IN ('view', 'signup')) = 2 AS both_b FROM events)),
 tmpl AS (SELECT template, count(*) AS occurrences, row_number() OVER (ORDER BY min((file_name, line_seq))) AS template_id
  FROM mined GROUP BY template)
"""
ORACLES["event_templates"] = WITH_MINED + "SELECT template_id, template, occurrences FROM tmpl"
# Signals are voted over the files of a template: most files, then the first file.
ORACLES["event_store"] = WITH_MINED + f""", r AS (SELECT template_id, file_name,
  first({SIGNAL} ORDER BY line_seq) AS sig FROM mined JOIN tmpl USING (template) GROUP BY 1, 2),
 v AS (SELECT template_id, first(sig ORDER BY votes DESC, since, sig) AS golden_signal FROM
  (SELECT template_id, sig, count(*) AS votes, min(file_name) AS since FROM r GROUP BY 1, 2) GROUP BY 1),
 f AS (SELECT template_id, first(text ORDER BY file_name, line_seq) AS rep_log,
  first(event_type ORDER BY file_name, line_seq) AS kind FROM mined JOIN tmpl USING (template) GROUP BY 1)
 SELECT template_id, template, len(string_split(template, '<*>')) - 1 AS var_count, golden_signal, occurrences AS occurrence_count,
 CASE kind WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Storage' WHEN 'click' THEN 'Web' WHEN 'view' THEN 'Web' ELSE 'Other' END AS component,
 rep_log FROM tmpl JOIN v USING (template_id) JOIN f USING (template_id)"""
ORACLES["event_template_rows"] = WITH_MINED + """SELECT file_name, line_seq, template_id, template,
 CASE WHEN template LIKE '%> <*> app%' THEN to_json([
   split_part(text, ' ', 3), split_part(text, ' ', 5), split_part(text, ' ', 6), split_part(text, ' ', 7), split_part(text, ' ', 8)]
   || CASE WHEN event_type IN ('view', 'signup') THEN [split_part(text, ' ', 9)] ELSE [] END)
 ELSE '[]' END AS variables FROM mined JOIN tmpl USING (template)"""
ORACLES["template_summary"] = WITH_MINED + f""", s AS (SELECT template_id, file_name,
  first(text ORDER BY line_seq) AS text, first({SIGNAL} ORDER BY line_seq) AS golden_signal, count(*) AS d_tid_count
  FROM mined JOIN tmpl USING (template) GROUP BY 1, 2)
 SELECT template_id, file_name, replace(text, chr(10), '</br>') AS text, golden_signal, d_tid_count,
 round(d_tid_count / (SELECT count(*) FROM mined) * 100, 4) AS coverage FROM s"""

ORACLES["event_windows"] = WITH_MINED + f""", x AS (SELECT *, epoch_us // 30000000 AS win,
  first({SIGNAL} = 'information') OVER (PARTITION BY template_id, file_name ORDER BY line_seq) AS info
  FROM mined JOIN tmpl USING (template))
 SELECT win, first(epoch_us ORDER BY file_name, line_seq) AS epoch_us, count(*) AS n, bool_and(info) AS all_info,
 coalesce(array_to_string(list_sort(list(DISTINCT template_id) FILTER (WHERE NOT info)), ' '), '') AS error_tids
 FROM x GROUP BY win"""

# --- tags and labels --------------------------------------------------------------------------

_TAG = """CASE WHEN pos = 0 AND event_type = 'error' THEN 'Error' WHEN pos = 0 AND event_type = 'signup' THEN 'Storage'
 WHEN pos = 0 AND event_type IN ('click', 'view') THEN 'Web' ELSE 'Other' END"""
ORACLES["match_tag"] = WITH_LINES + f"SELECT line_seq, {_TAG} AS tag FROM event_lines"
ORACLES["component_tags"] = WITH_LINES + f"""SELECT line_seq, length(value) % 50 AS template_id,
 first({_TAG}) OVER (PARTITION BY length(value) % 50 ORDER BY file_name, line_seq) AS component FROM event_lines"""
WITH_REPS = WITH_LABELLED + """, reps AS (SELECT template_id, file_name, count(*) AS n, arg_min(text, event_id) AS text,
  arg_min(ts_text, event_id) AS ts_text, arg_min(clean_text, event_id) AS rep_text, any_value(golden_signal) AS golden_signal,
  any_value(faults) AS faults, any_value(fault) AS fault FROM lab GROUP BY 1, 2)
"""
ORACLES["representatives"] = WITH_REPS + "SELECT template_id, file_name, n, text, ts_text, rep_text FROM reps"
_label, _score = scores("t", SIGNAL_WORDS)
ORACLES["classify_rules"] = WITH_LINES + f"""SELECT file_name, line_seq, {_label} AS label, round({_score}, 6) AS score
 FROM (SELECT *, lower({fold('value')}) AS t FROM document_lines)"""
ORACLES["classify_callable"] = WITH_REPS + """SELECT template_id, file_name,
 CASE WHEN length(rep_text) % 2 = 1 THEN 'latency' ELSE 'error' END AS label,
 CASE WHEN length(rep_text) % 2 = 1 THEN 0.75 ELSE 0.625 END AS score FROM reps"""
ORACLES["fault_categories"] = WITH_REPS + "SELECT template_id, file_name, golden_signal, 1.0 AS score, faults FROM reps"
ORACLES["signal_spread"] = WITH_LABELLED + """SELECT event_id, golden_signal,
 CASE WHEN golden_signal <> 'information' THEN template_id END AS error_tid, faults FROM lab"""
ORACLES["non_info"] = WITH_LABELLED + "SELECT event_id, golden_signal FROM lab WHERE golden_signal <> 'information'"
ORACLES["weighted_vote"] = """SELECT template_id, label, round(m, 6) AS mean_score, votes FROM
 (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY m DESC, votes DESC, label) AS r FROM
 (SELECT user_id % 40 AS template_id, event_type AS label, avg(floor(value)) AS m, count(*) AS votes
  FROM events GROUP BY 1, 2)) WHERE r = 1"""
ORACLES["template_signal_vote"] = WITH_REPS + """, v AS (SELECT template_id % 5 AS template_id, golden_signal,
  count(*) AS votes, min(file_name) AS since, any_value(fault) AS fault FROM reps GROUP BY 1, 2)
 SELECT template_id, first(golden_signal ORDER BY votes DESC, since, golden_signal) AS golden_signal,
 first(fault ORDER BY since, golden_signal) AS fault_category FROM v GROUP BY 1"""
ORACLES["signal_distribution"] = WITH_LABELLED + "SELECT golden_signal, count(*) AS occurrences FROM lab GROUP BY 1"

# --- windows --------------------------------------------------------------------------------------


def _with_windows(seconds: int) -> str:
    return WITH_LABELLED + f""", items AS (SELECT *, CAST(floor(epoch / {seconds}) AS BIGINT) AS win FROM lab),
 w AS (SELECT win, first(epoch ORDER BY file_name, event_id) AS epoch, count(*) AS n,
  bool_and(golden_signal = 'information') AS all_info, list_sort(list(DISTINCT template_id)) AS tids,
  list_sort(coalesce(list(DISTINCT template_id) FILTER (WHERE golden_signal <> 'information'), [])) AS error_tids
  FROM items GROUP BY win),
 sets AS (SELECT error_tids, min(win) AS since FROM w WHERE NOT all_info GROUP BY 1),
 roots AS (SELECT a.error_tids, first(b.since ORDER BY len(b.error_tids) DESC, b.since) AS root_id,
  first(b.error_tids ORDER BY len(b.error_tids) DESC, b.since) AS root_tids
  FROM sets a JOIN sets b ON list_has_all(b.error_tids, a.error_tids) GROUP BY 1),
 merged AS (SELECT root_id, min(epoch) AS start_epoch, max(epoch) + {seconds} AS end_epoch, count(*) AS num_windows,
  CAST(sum(n) AS BIGINT) AS n, any_value(root_tids) AS error_tids
  FROM w JOIN roots USING (error_tids) WHERE NOT all_info GROUP BY 1)
"""


_W = _with_windows(1800)
ORACLES["tumbling_windows"] = _W + f"""SELECT win, {us('epoch')} AS epoch_us, n, all_info,
 array_to_string(tids, ' ') AS tids, array_to_string(error_tids, ' ') AS error_tids FROM w"""
ORACLES["normal_windows"] = _W + f"""SELECT win, {utc('epoch')} AS start_ts, {utc('epoch + 1800')} AS end_ts, n,
 array_to_string(tids, ' ') AS tids FROM w WHERE all_info"""
ORACLES["window_counts"] = _W + """SELECT count(*) FILTER (WHERE all_info) AS normal_windows,
 count(*) FILTER (WHERE NOT all_info) AS anomalous_windows FROM w"""
ORACLES["merge_windows"] = _W + "SELECT win, root_id FROM w JOIN roots USING (error_tids) WHERE NOT all_info"
ORACLES["anomalies"] = _W + f"""SELECT root_id, {utc('start_epoch')} AS start_ts, {utc('end_epoch')} AS end_ts,
 num_windows, n, array_to_string(error_tids, ' ') AS error_tids, 'Anomaly' AS list_result FROM merged"""
_ITEMS = _with_windows(30) + """, placed AS (SELECT i.*, r.root_id, m.start_epoch, m.end_epoch,
  i.text || ' => Fault-Categories: ' || i.fault || ' => Golden-Signal: ' || i.golden_signal AS text_output
  FROM items i JOIN w USING (win) JOIN roots r ON r.error_tids = w.error_tids JOIN merged m USING (root_id)
  WHERE NOT w.all_info)
"""
ORACLES["anomaly_items"] = _ITEMS + f"""SELECT event_id, win, root_id, text_output, {us('start_epoch')} AS start_us,
 {us('end_epoch')} AS end_us FROM placed"""
ORACLES["anomaly_documents"] = _ITEMS + f"""SELECT root_id, {utc('start_epoch')} || ' -- ' || {utc('end_epoch')} AS duration,
 text_output AS logs, file_name AS files, golden_signal AS gs, template_id AS "templateIds" FROM placed"""


def _preview(unique: bool, coloured: bool, count: int | None) -> str:
    sql = WITH_LABELLED + """, items AS (SELECT *, CAST(floor(epoch / 21600) AS BIGINT) AS win,
  golden_signal IN ('latency', 'error', 'availability', 'saturation', 'traffic') AS c FROM lab),
 shown AS (SELECT *, row_number() OVER (PARTITION BY win, template_id, c ORDER BY file_name, event_id) AS turn FROM items),
 chosen AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY file_name, event_id) AS place FROM shown WHERE true"""
    # In this data a template has one signal, so uncoloured ones never use up.
    sql += " AND c" if coloured else ""
    sql += " AND (turn = 1 OR NOT c)" if unique else ""
    limit = f" WHERE place <= {count}" if count else ""
    return sql + f") SELECT win, event_id, template_id, text FROM chosen{limit}"


ORACLES["window_preview"] = _preview(True, True, 5)
ORACLES["window_preview_signals"] = _preview(False, True, 5)
ORACLES["window_preview_unique"] = _preview(True, False, 5)
ORACLES["window_preview_all"] = _preview(True, True, None)

# --- summary, timeline ----------------------------------------------------------------------------

WITH_SUMMARY = WITH_REPS + """, summ AS (SELECT template_id, file_name, text, golden_signal AS gs, n AS d_tid_count,
  round(n / (SELECT count(*) FROM lab) * 100, 4) AS coverage FROM reps)
"""
ORACLES["summary_table"] = WITH_SUMMARY + "SELECT * FROM summ"
ORACLES["summary_filter"] = WITH_SUMMARY + "SELECT * FROM summ WHERE gs = 'latency' AND file_name = 'app-3.log'"
ORACLES["stat_cards"] = WITH_SUMMARY + """SELECT count(*) AS total, count(*) FILTER (WHERE gs = 'error') AS errors,
 count(*) FILTER (WHERE gs = 'latency') AS latency, count(*) FILTER (WHERE gs = 'information') AS information FROM summ"""
ORACLES["file_choices"] = WITH_LABELLED + "SELECT DISTINCT file_name, file_name AS base FROM lab"
ORACLES["analysis_result"] = WITH_REPS + """SELECT template_id, text AS log_line, golden_signal,
 fault AS fault_category, n AS occurrences, file_name FROM reps"""
ORACLES["analysis_totals"] = WITH_LABELLED + """SELECT count(*) AS total_log_lines,
 count(DISTINCT template_id) AS templates_found, count(DISTINCT file_name) AS files FROM lab"""
_BIN = "CASE WHEN span <= 3000 THEN 30 " + " ".join(
    f"WHEN ceil(span / {c}) <= 100 THEN {c}" for c in (60, 300, 900, 1800, 3600, 21600, 86400)
) + " ELSE CAST(ceil(span / 100 / 3600) * 3600 AS BIGINT) END"
_BIN_NAME = "CASE b " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in {
        30: "30 sec", 60: "1 min", 300: "5 min", 900: "15 min", 1800: "30 min", 3600: "1 hour", 21600: "6 hours", 86400: "1 day",
    }.items()
) + " ELSE (b // 3600) || ' hours' END"
WITH_TIMELINE = WITH_LABELLED + f""", f AS (SELECT file_name, m, {_BIN} AS b, span, sigs FROM
  (SELECT file_name, min(epoch) AS m, max(epoch) - min(epoch) AS span, list(DISTINCT golden_signal) AS sigs FROM lab GROUP BY 1)),
 grid AS (SELECT file_name, m, b, bin_idx, unnest(sigs) AS signal FROM
  (SELECT *, unnest(range(0, CAST(floor(span / b) AS BIGINT) + 1)) AS bin_idx FROM f)),
 cnt AS (SELECT file_name, CAST(floor((epoch - m) / b) AS BIGINT) AS bin_idx, golden_signal AS signal, count(*) AS c
  FROM lab JOIN f USING (file_name) GROUP BY 1, 2, 3),
 tl AS (SELECT file_name, b AS bin_seconds, {_BIN_NAME} AS bin_name, bin_idx, m + bin_idx * b AS start, signal, coalesce(c, 0) AS count
  FROM grid LEFT JOIN cnt USING (file_name, bin_idx, signal))
"""
ORACLES["signal_timeline"] = WITH_TIMELINE + f"""SELECT file_name, bin_seconds, bin_name, bin_idx, {us('start')} AS bin_start,
 CASE WHEN bin_seconds >= 86400 THEN strftime(make_timestamp({us('start')}), '%Y-%m-%d')
  WHEN bin_seconds >= 3600 THEN strftime(make_timestamp({us('start')}), '%Y-%m-%d %H:%M')
  ELSE strftime(make_timestamp({us('start')}), '%m-%d %H:%M') END AS label, signal, count,
 round(log10(count + 1), 2) AS scaled FROM tl"""
ORACLES["timeline_documents"] = WITH_TIMELINE + """SELECT file_name, bin_seconds, count(DISTINCT bin_idx) AS bins,
 CAST(sum(count) AS BIGINT) AS records FROM tl GROUP BY 1, 2"""
ORACLES["temporal_evolution"] = WITH_LABELLED + f""", x AS (SELECT * FROM lab WHERE golden_signal <> 'information'),
 s AS (SELECT min(epoch) AS m, greatest(floor((max(epoch) - min(epoch)) / 30), 1) AS width FROM x),
 y AS (SELECT golden_signal, CAST(floor((epoch - m) / width) AS BIGINT) AS bin_idx, m, width FROM x, s)
 SELECT b.bin_idx, {us('any_value(b.m) + b.bin_idx * any_value(b.width)')} AS start_epoch, """ + ", ".join(
    f"count(*) FILTER (WHERE golden_signal = '{s}') AS {s}" for s in ("error", "availability", "latency", "saturation", "traffic")
) + """ FROM (SELECT unnest(range(0, (SELECT max(bin_idx) + 1 FROM y))) AS bin_idx, m, width FROM s) b
 LEFT JOIN y ON y.bin_idx = b.bin_idx GROUP BY b.bin_idx"""

# --- causality --------------------------------------------------------------------------------------

WITH_SERIES = WITH_LABELLED + """, x AS (SELECT template_id, epoch FROM lab WHERE golden_signal <> 'information'),
 s0 AS (SELECT min(epoch) AS mn, max(epoch) AS mx, (max(epoch) - min(epoch)) / 1000 AS step FROM x),
 s AS (SELECT *, greatest(floor(step), 1) AS stride, step * 5 AS width,
  CAST(floor((mx - mn - step * 5) / greatest(floor(step), 1)) AS BIGINT) AS last FROM s0),
 r AS (SELECT template_id, last, greatest(CAST(floor((epoch - mn - width) / stride) AS BIGINT) + 1, 0) AS low,
  least(CAST(floor((epoch - mn) / stride) AS BIGINT), last) AS high FROM x, s),
 c AS (SELECT template_id, last, k, count(*) AS c FROM
  (SELECT template_id, last, unnest(range(low, high + 1)) AS k FROM r WHERE low <= high) GROUP BY 1, 2, 3),
 kept AS (SELECT template_id, any_value(last) AS last FROM c GROUP BY 1
  HAVING count(DISTINCT c) + CASE WHEN count(*) < any_value(last) + 1 THEN 1 ELSE 0 END > 3)
"""
ORACLES["template_series"] = WITH_SERIES + "SELECT template_id, k, c AS count FROM c JOIN kept USING (template_id)"
ORACLES["series_diff"] = WITH_SERIES + """, grid AS (SELECT template_id, unnest(range(0, last + 1)) AS k FROM kept),
 v AS (SELECT grid.template_id, grid.k, coalesce(c.c, 0) AS c FROM grid LEFT JOIN c ON c.template_id = grid.template_id AND c.k = grid.k),
 d AS (SELECT template_id, k, lead(c) OVER (PARTITION BY template_id ORDER BY k) - c AS diff FROM v)
 SELECT template_id, k, diff FROM d WHERE diff <> 0"""

# The regressors of a test are one, x at lags 1 to p and y at lags 1 to p; the last row and column of a system are x
# itself. Eliminating the regressors one after another leaves the sum of squares of the fit in the last corner: after
# p + 1 of them of x alone, after 2 p + 1 of both. A regressor that depends on those before it is passed over.
_Z = "sqrt(stat / 2)"
_ERFC = f"""(CASE WHEN {_Z} < 2 THEN 1 - 2 / sqrt(pi()) * exp(-stat / 2) * {_Z} * list_sum(list_transform(range(0, 60),
  lambda n: exp(n * ln(greatest(2 * stat, 1e-300)) + lgamma(n + 1) - lgamma(2 * n + 2))))
 ELSE exp(-stat / 2) / sqrt(pi()) / list_reduce([{_Z}] || list_transform(range(0, 80), lambda k: (80 - k) / 2.0),
  lambda a, k: {_Z} + k / a) END)"""
_MORE = "sqrt(2 * stat / pi()) * exp(-stat / 2)"
_P_VALUE = f"""CASE WHEN stat <= 0 THEN 1.0 ELSE CASE p WHEN 1 THEN {_ERFC} WHEN 2 THEN exp(-stat / 2)
 WHEN 3 THEN {_ERFC} + {_MORE} WHEN 4 THEN exp(-stat / 2) * (1 + stat / 2) ELSE {_ERFC} + {_MORE} * (1 + stat / 3) END END"""
WITH_PAIRS = WITH_SERIES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 grid AS (SELECT template_id, unnest(range(0, last + 1)) AS k FROM kept),
 v AS (SELECT grid.template_id, grid.k, coalesce(c.c, 0) AS c FROM grid LEFT JOIN c ON c.template_id = grid.template_id AND c.k = grid.k),
 d AS (SELECT template_id, k, CAST(lead(c) OVER (PARTITION BY template_id ORDER BY k) - c AS DOUBLE) AS diff FROM v),
 z AS (SELECT template_id, list(diff ORDER BY k) AS z, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY 1 HAVING count(DISTINCT diff) > 1),
 first_in AS (SELECT template_id, min(epoch) AS since FROM
  (SELECT template_id, epoch, greatest(CAST(floor((epoch - mn - width) / stride) AS BIGINT) + 1, 0) AS low,
   least(CAST(floor((epoch - mn) / stride) AS BIGINT), last) AS high FROM x, s) WHERE low <= high GROUP BY 1),
 lagged AS MATERIALIZED (SELECT template_id, p, k, n - p AS places, z[p - k + 1 : n - k] AS part FROM z,
  (SELECT unnest(range(1, 6)) AS p), (SELECT unnest(range(0, 6)) AS k) WHERE k <= p AND n > 16),
 sound AS (SELECT template_id, any_value(since) AS since FROM lagged JOIN first_in USING (template_id)
  GROUP BY 1 HAVING bool_and(k = 0 OR list_min(part) < list_max(part))),
 pairs AS (SELECT a.template_id AS x, b.template_id AS y FROM sound a JOIN sound b ON (a.since, a.template_id) < (b.since, b.template_id)),
 own AS (SELECT a.template_id AS t, a.p, a.k, b.k AS l, list_dot_product(a.part, b.part) AS m FROM lagged a JOIN lagged b USING (template_id, p)),
 sums AS (SELECT template_id AS t, p, k, list_sum(part) AS m, places FROM lagged),
 cross_ AS (SELECT x, y, a.p, a.k, b.k AS l, list_dot_product(a.part, b.part) AS m FROM pairs
  JOIN lagged a ON a.template_id = x JOIN lagged b ON b.template_id = y AND b.p = a.p WHERE b.k > 0),
 cells AS (
  SELECT x, y, p, CASE k WHEN 0 THEN 2 * p + 1 ELSE k END AS i, CASE l WHEN 0 THEN 2 * p + 1 ELSE l END AS j, m FROM pairs JOIN own ON t = x
  UNION ALL SELECT x, y, p, p + k, p + l, m FROM pairs JOIN own ON t = y WHERE k > 0 AND l > 0
  UNION ALL SELECT x, y, p, CASE k WHEN 0 THEN 2 * p + 1 ELSE k END, p + l, m FROM cross_
  UNION ALL SELECT x, y, p, p + l, CASE k WHEN 0 THEN 2 * p + 1 ELSE k END, m FROM cross_
  UNION ALL SELECT x, y, p, 0, CASE k WHEN 0 THEN 2 * p + 1 ELSE k END, m FROM pairs JOIN sums ON t = x
  UNION ALL SELECT x, y, p, CASE k WHEN 0 THEN 2 * p + 1 ELSE k END, 0, m FROM pairs JOIN sums ON t = x
  UNION ALL SELECT x, y, p, 0, p + k, m FROM pairs JOIN sums ON t = y WHERE k > 0
  UNION ALL SELECT x, y, p, p + k, 0, m FROM pairs JOIN sums ON t = y WHERE k > 0
  UNION ALL SELECT x, y, p, 0, 0, places FROM pairs JOIN sums ON t = x WHERE k = 0),
 systems AS (SELECT x, y, p, 2 * p + 2 AS w, list(m ORDER BY i, j) AS m FROM cells GROUP BY 1, 2, 3),
 steps AS (
  SELECT x, y, p, w, 0 AS s, m, list_transform(range(0, w), lambda i: m[i * w + i + 1]) AS scale FROM systems
  UNION ALL
  SELECT x, y, p, w, s + 1, CASE WHEN m[s * w + s + 1] <= 1e-9 * scale[s + 1] THEN m ELSE
   list_transform(m, lambda e, q: e - m[((q - 1) // w) * w + s + 1] * m[s * w + (q - 1) % w + 1] / m[s * w + s + 1]) END, scale
  FROM steps WHERE s < w - 1),
 tests AS (SELECT x, y, p, any_value(places) AS places, max(m[w * w]) FILTER (WHERE s = p + 1) AS alone, max(m[w * w]) FILTER (WHERE s = w - 1) AS joint
  FROM steps JOIN (SELECT DISTINCT t, p, places FROM sums) q USING (p) WHERE q.t = x GROUP BY 1, 2, 3),
 lags AS (SELECT x, y, p, joint, places * (alone - joint) / joint AS stat FROM tests),
 best AS (SELECT x AS first_id, y AS second_id, min(pv) AS least, list(pv ORDER BY p) AS ps FROM
  (SELECT x, y, p, joint, {_P_VALUE} AS pv FROM lags) GROUP BY 1, 2
  HAVING min(pv) < 0.05 AND min(joint) > 0 ORDER BY least, first_id, second_id LIMIT 10)
"""
ORACLES["granger_pairs"] = WITH_PAIRS + """SELECT first_id, second_id, round(least, 6) AS min_p,
 array_to_string(list_transform(ps, lambda q: printf('%.4f', q)), ' ') AS p_values FROM best"""
ORACLES["causal_graph"] = WITH_PAIRS + """, nodes AS (SELECT template_id, first(text ORDER BY file_name, event_id) AS label,
  min(golden_signal) AS gs FROM lab GROUP BY 1)
 SELECT second_id AS source, first_id AS target, label, gs FROM best JOIN nodes ON template_id = second_id"""

# --- store and explorer -------------------------------------------------------------------------------

WITH_STORE = WITH_REPS + """, st AS (SELECT template_id, any_value(template) AS template, 1 AS var_count,
  any_value(golden_signal) AS golden_signal, any_value(fault) AS fault_category, count(*) AS occurrence_count,
  'Web' AS component, first(text ORDER BY file_name, event_id) AS rep_log, count(DISTINCT file_name) AS file_count FROM lab GROUP BY 1)
"""
ORACLES["log_store_templates"] = WITH_STORE + "SELECT * FROM st"
ORACLES["template_file_maps"] = WITH_REPS + """SELECT template_id, piece, string_agg(file_name || '=' || n, ',' ORDER BY file_name) AS file_sources
 FROM (SELECT *, (row_number() OVER (PARTITION BY template_id ORDER BY file_name) - 1) // 3 AS piece FROM reps) GROUP BY 1, 2"""
ORACLES["template_files"] = WITH_REPS + "SELECT template_id, file_name AS file_source, n FROM reps"
ORACLES["log_store_entries"] = WITH_LABELLED + """SELECT template_id, CAST(floor(epoch) AS BIGINT) AS timestamp,
 '["' || user_id || '"]' AS variables, file_name AS file_source, text AS original_text,
 row_number() OVER (ORDER BY file_name, event_id) - 1 AS entry_id FROM lab"""
ORACLES["log_store_day"] = WITH_LABELLED + """SELECT template_id, count(*) AS n, CAST(floor(max(epoch)) AS BIGINT) AS latest
 FROM lab WHERE ts_text LIKE '2024-01-10%' GROUP BY 1"""
ORACLES["store_totals"] = WITH_LABELLED + "SELECT count(DISTINCT template_id) AS total_templates, count(*) AS total_entries FROM lab"
ORACLES["explore_facets"] = WITH_LABELLED + """SELECT 'golden_signal' AS facet, golden_signal AS value, count(*) AS n FROM lab GROUP BY 2
 UNION ALL SELECT 'file_source', file_name, count(*) FROM lab GROUP BY 2
 UNION ALL SELECT 'fault_category', fault, count(*) FROM lab GROUP BY 2"""
_ENTRY = "template_id, CAST(floor(epoch) AS BIGINT) AS timestamp, file_name AS file_source, text AS original_text"
ORACLES["explore_search"] = WITH_LABELLED + f"""SELECT {_ENTRY} FROM lab WHERE text LIKE '%latency%'
 AND golden_signal = 'latency' AND file_name IN ('app-1.log', 'app-2.log')"""
ORACLES["explore_variable"] = WITH_LABELLED + f"SELECT {_ENTRY} FROM lab WHERE template_id = 2017 AND user_id = 17"
ORACLES["explore_templates"] = WITH_STORE + """SELECT template_id, template, occurrence_count FROM st
 WHERE template LIKE '%disk%' AND golden_signal = 'saturation'"""
ORACLES["explore_page"] = WITH_LABELLED + f"""SELECT event_id AS entry_id, {_ENTRY} FROM lab
 WHERE floor(epoch) <= epoch(TIMESTAMP '2024-01-20') ORDER BY floor(epoch) DESC, file_name, event_id LIMIT 100"""
ORACLES["matched_interval"] = WITH_LABELLED + """SELECT event_id AS row_id, test_ids, train_ids, text AS truncated_text,
 '%Y-%m-%d %H:%M:%S' AS format FROM lab JOIN (SELECT text, min(event_id) AS test_ids FROM lab GROUP BY 1) USING (text)
 JOIN (SELECT text, max(event_id) AS train_ids FROM lab GROUP BY 1) USING (text)
 WHERE epoch BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-15')"""
ORACLES["matcher_files"] = WITH_LABELLED + """SELECT text AS truncated_text, min(template_id) AS test_ids FROM lab GROUP BY 1"""


def _chunks(limit: int) -> str:
    """Chunks of the document lines: rows above half the limit alone, the others cut at every further half."""
    half = limit // 2
    return WITH_LINES + f""", sized AS (SELECT file_name, line_seq, value, strlen(value) + 1 AS row_bytes FROM document_lines),
 summed AS (SELECT *, row_bytes > {half} AS alone,
  coalesce(sum(CASE WHEN row_bytes > {half} THEN 1 ELSE 0 END) OVER w, 0) AS after,
  coalesce(sum(CASE WHEN row_bytes > {half} THEN 0 ELSE row_bytes END) OVER w, 0) AS small
  FROM sized WINDOW w AS (ORDER BY file_name, line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 chunked AS (SELECT file_name, line_seq, value, CAST(row_bytes AS BIGINT) AS row_bytes, CAST(after AS BIGINT) AS after, alone,
  CASE WHEN alone THEN 0 ELSE CAST(small // {half} AS BIGINT) END AS piece FROM summed)
"""


ORACLES["chunk_by_bytes"] = _chunks(1024) + "SELECT file_name, line_seq, after, alone, piece, row_bytes FROM chunked"
ORACLES["chunk_files"] = _chunks(64 * 1024) + """SELECT after || '-' || CAST(alone AS INT) || '-' || piece AS part, count(*) AS rows,
 CAST(sum(row_bytes) AS BIGINT) AS bytes, max(sha256(file_name || '|' || line_seq || '|' || value)) AS largest FROM chunked GROUP BY 1"""
ORACLES["report_size"] = _chunks(64 * 1024) + """SELECT count(DISTINCT (after, alone, piece)) AS no_of_chunks, count(*) AS no_of_windows FROM chunked"""
ORACLES["run_metrics"] = WITH_LINES + r"""SELECT 'num_log_lines_total' AS name, count(*) * 1.0 AS value FROM document_lines
 UNION ALL SELECT 'num_log_lines_whitespaces', count(*) FILTER (WHERE regexp_replace(value, '\s+', '', 'g') = '') * 1.0 FROM document_lines
 UNION ALL SELECT 'num_log_lines_processed', count(*) * 2.0 FROM events"""


def _cut(source: str, order: str, size: str, limit: int, name: str) -> str:
    """Rows of ``source`` with the chunk they fall in, as in ``_chunks``."""
    half = limit // 2
    return f"""{name}_summed AS (SELECT *, {size} > {half} AS alone,
  coalesce(sum(CASE WHEN {size} > {half} THEN 1 ELSE 0 END) OVER w, 0) AS after,
  coalesce(sum(CASE WHEN {size} > {half} THEN 0 ELSE {size} END) OVER w, 0) AS small
  FROM {source} WINDOW w AS (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 {name} AS (SELECT * EXCLUDE (small), CASE WHEN alone THEN 0 ELSE CAST(small // {half} AS BIGINT) END AS piece FROM {name}_summed)"""


_PART = "printf('%012d-%d-%012d', CAST(after AS BIGINT), CAST(alone AS INT), CAST(piece AS BIGINT)) AS part, document"
ORACLES["report_templates"] = WITH_STORE + """, docs AS (SELECT template_id, to_json({'template_id': template_id, 'template': template,
  'golden_signal': golden_signal, 'fault_category': fault_category, 'occurrence_count': occurrence_count,
  'component': component, 'rep_log': rep_log}) AS document FROM st),
 """ + _cut("docs", "template_id", "(strlen(document) + 1)", 4096, "cut") + f" SELECT {_PART} FROM cut"
ORACLES["report_timeline"] = WITH_TIMELINE + f""", labels AS (SELECT *, CASE
  WHEN bin_seconds >= 86400 THEN strftime(make_timestamp({us('start')}), '%Y-%m-%d')
  WHEN bin_seconds >= 3600 THEN strftime(make_timestamp({us('start')}), '%Y-%m-%d %H:%M')
  ELSE strftime(make_timestamp({us('start')}), '%m-%d %H:%M') END AS label FROM tl),
 bins AS (SELECT file_name, bin_seconds, bin_name, bin_idx, label,
  list({{'signal': signal, 'count': count}} ORDER BY signal) AS counts FROM labels GROUP BY ALL),
 docs AS (SELECT file_name, to_json({{'file_name': file_name, 'bin_seconds': bin_seconds, 'bin_name': bin_name,
  'bins': list({{'bin_idx': bin_idx, 'label': label, 'counts': counts}} ORDER BY bin_idx)}}) AS document
  FROM bins GROUP BY file_name, bin_seconds, bin_name),
 """ + _cut("docs", "file_name", "(strlen(document) + 1)", 64 * 1024, "cut") + f" SELECT {_PART} FROM cut"
ORACLES["report_anomalies"] = _ITEMS + ", " + _cut(
    "placed", "start_epoch, root_id, win, file_name, event_id", "strlen(text_output)", 16 * 1024, "pieces"
) + f""", docs AS (SELECT root_id, after AS a1, alone AS a2, piece AS a3, to_json({{'root_id': root_id,
  'duration': {utc('any_value(start_epoch)')} || ' -- ' || {utc('any_value(end_epoch)')},
  'logs': list(text_output ORDER BY win, file_name, event_id), 'files': list(file_name ORDER BY win, file_name, event_id),
  'gs': list(golden_signal ORDER BY win, file_name, event_id), 'templateIds': list(template_id ORDER BY win, file_name, event_id)}}) AS document
  FROM pieces GROUP BY 1, 2, 3, 4),
 """ + _cut("docs", "root_id, a1, a2, a3", "(strlen(document) + 1)", 64 * 1024, "cut") + f" SELECT {_PART} FROM cut"
ORACLES["normal_window_lines"] = _with_windows(30) + f"""SELECT win, {utc('w.epoch')} AS start_ts, {utc('w.epoch + 30')} AS end_ts,
 event_id, template_id, text FROM items JOIN w USING (win) WHERE all_info"""
ORACLES["component_totals"] = WITH_LINES + f""", t AS (SELECT length(value) % 50 AS template_id,
  first({_TAG} ORDER BY file_name, line_seq) AS component, count(*) AS n FROM event_lines GROUP BY 1)
 SELECT component, count(*) AS templates, CAST(sum(n) AS BIGINT) AS records FROM t GROUP BY 1"""
ORACLES["interval_from_text"] = """SELECT event_id FROM events
 WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'"""
ORACLES["glob_scan"] = WITH_LINES + "SELECT file_name, value FROM event_lines WHERE regexp_matches(file_name, '^app-[0-4].log$')"
ORACLES["debug_outputs"] = WITH_LABELLED.replace("WITH ", WITH_LINES + ", ", 1) + """SELECT 'matcher_output' AS name, template_id, count(*) AS n FROM lab GROUP BY 2
 UNION ALL SELECT 'processed_logs', 0, count(*) FROM lab UNION ALL SELECT 'none_logs', 0, count(*) FROM document_lines
 UNION ALL SELECT 'json_discarded', 0, count(*) FROM events"""
ORACLES["annotated_lines"] = WITH_LABELLED + """SELECT event_id, text, fault, golden_signal AS signal,
 CASE WHEN event_id > 0 THEN round(log10(event_id), 6) ELSE 0 END AS height FROM lab"""
