"""The engine's queries over the tables in a folder, and the SQL that says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import clean, features, gnn, graph, learn, metrics, runs, serving, split
from ..sources import files
from ..sources.shared import fresh_path, stored
from . import examples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROUND = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column) -> Column:
    return F.round(c, ROUND)


# --- hand-made features -------------------------------------------------------

_CHARS = {"n_" + k: v for k, v in features.COUNTED.items()}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Characters that are neither ASCII nor white space.
_OUTSIDE = r"[^\x00-\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_count(chars: str) -> str:
    out = "t"
    for c in chars:
        out = f"replace({out}, {_sql_text(c)}, '')"
    return f"CAST(length(t) - length({out}) AS DOUBLE)"


_DOCS = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _like(pattern: str) -> str:
    return f"CAST(length(t) - length(regexp_replace(t, {_sql_text(pattern)}, '', 'g')) AS DOUBLE)"


@query("SELECT doc_id, CAST(length(t) AS DOUBLE) AS length, " + ", ".join(f"{_like(p)} AS {n}" for n, p in (("alpha", r"\p{L}"), ("digit", "[0-9]"), ("space", r"[\x20\x09-\x0D]"), ("upper", r"\p{Lu}"), ("lower", r"\p{Ll}"))) + ", " + ", ".join(f"{_sql_count(v)} AS {k}" for k, v in _CHARS.items()) + f" FROM {_DOCS}")
def manual_char_counts(spark, sf_dir):
    f = features.manual_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(f[k].alias(k) for k in ("length", "alpha", "digit", "space", "upper", "lower", *_CHARS)))


@query(rf"""
WITH d AS (SELECT doc_id, t, length(t) AS n, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {_DOCS}),
c AS (SELECT *, {_like(r'\p{L}')} AS a, {_like('[0-9]')} AS g, {_like(r'[\x20\x09-\x0D]')} AS s, {_like(r'\p{Lu}')} AS u, {_like(r'\p{Ll}')} AS l FROM d)
SELECT doc_id, CAST(len(w) AS DOUBLE) AS num_tokens, round(CASE WHEN len(w) > 0 THEN n / len(w)::DOUBLE ELSE 0 END, 6) AS avg_token_len,
  CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS max_token_len,
  round(CASE WHEN l > 0 THEN u / l ELSE u END, 6) AS upper_lower_ratio, round(CASE WHEN a > 0 THEN g / a ELSE g END, 6) AS digit_alpha_ratio,
  round(CASE WHEN n > 0 THEN (n - a - g - s) / n ELSE 0 END, 6) AS special_ratio FROM c""")
def manual_ratios(spark, sf_dir):
    f = features.manual_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", f["num_tokens"].alias("num_tokens"), r(f["avg_token_len"]).alias("avg_token_len"), f["max_token_len"].alias("max_token_len"), *(r(f[k]).alias(k) for k in ("upper_lower_ratio", "digit_alpha_ratio", "special_ratio")))


def _sql_words() -> str:
    parts = [f"CAST({' OR '.join(f'contains(lower(t), {_sql_text(w)})' for w in words)} AS INT)::DOUBLE AS has_{name}" for name, words in features.WORDS.items()]
    return ", ".join([*parts, f"CAST(regexp_matches(t, {_sql_text(features.ADDRESS)}) AS INT)::DOUBLE AS has_ip"])


@query(f"SELECT doc_id, {_sql_words()} FROM {_DOCS}")
def manual_keywords(spark, sf_dir):
    f = features.manual_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(f[k].alias(k) for k in f if k.startswith("has_")))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n), e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM p GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0) + 0.0, 6) AS entropy FROM documents LEFT JOIN e USING (doc_id)""")
def char_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (r(features.entropy(F.coalesce("text", F.lit("")))) + 0.0).alias("entropy"))


_TOKENS = """SELECT DISTINCT token FROM (SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS token FROM documents
UNION ALL SELECT unnest(string_split(p_name || ' <path>\\.' || lower(p_brand) || ' /' || p_type || ' <int_ip>:<port> a>b >> <sid> "' || p_size || '" <url>', ' ')) FROM part) WHERE token <> ''"""


def _tokens(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("token"))
    made = F.concat(F.col("p_name"), F.lit(" <path>\\."), F.lower("p_brand"), F.lit(" /"), F.col("p_type"), F.lit(' <int_ip>:<port> a>b >> <sid> "'), F.col("p_size").cast("string"), F.lit('" <url>'))
    return words.unionByName(table(spark, sf_dir, "part").select(F.explode(F.split(made, " ")).alias("token"))).where("token <> ''").distinct()


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_sql_text(w)})" for w in words) + ")"


def _flag(x: str, name: str) -> str:
    return f"CAST({x} AS INT)::DOUBLE AS {name}"


_REPLACED = "contains(token, '<') AND contains(token, '>')"


# a token's own characters, in its row: nothing is grouped over all tokens
_TOKEN_ENTROPY = "list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)::DOUBLE) * log2((length(token) - length(replace(token, c, ''))) / length(token)::DOUBLE)))"


@query(f"""WITH t AS ({_TOKENS}), e AS (SELECT token, round({_TOKEN_ENTROPY} + 0.0, 6) + 0.0 AS entropy FROM t) SELECT token, entropy, round(ln(1 + length(token)), 6) AS log_len,
{_flag("starts_with(token, '-') OR starts_with(token, '/')", 'is_arg')}, {_flag("starts_with(token, '.') AND length(token) < 6", 'is_extension')}, {_flag("contains(token, '.exe')", 'is_exe')},
{_flag("contains(token, '|') OR (contains(token, '<') AND NOT contains(token, '>')) OR (contains(token, '>') AND NOT contains(token, '<')) OR contains(token, '>>') OR contains(token, '<<') OR contains(token, '&')", 'redirects')},
round(ln(1 + length(token) - length(regexp_replace(token, '[\\^`%$+&;]', '', 'g'))), 6) AS log_hostile, round(ln(1 + length(token) - length(regexp_replace(token, '["'']', '', 'g'))), 6) AS log_quotes,
{_flag(_REPLACED, 'was_replaced')}, {_flag(_REPLACED + ' AND ' + _any('token', features.PATH_TAGS), 'is_path')}, {_flag(_REPLACED + " AND contains(token, '_ip>')", 'is_ip')}, {_flag(_REPLACED + " AND contains(token, '<PID>')", 'is_pid')},
{_flag(_REPLACED + ' AND ' + _any('token', features.SECRET_TAGS), 'is_hash')}, {_flag(_REPLACED + " AND contains(token, '<url>')", 'is_url')}, {_flag(_REPLACED + ' AND ' + _any('token', ('<date>', '<timestamp>')), 'is_date')} FROM e""")
def token_features(spark, sf_dir):
    f = features.token_features(F.col("token"))
    return _tokens(spark, sf_dir).select("token", *((r(c) + 0.0 if k.startswith(("log", "entropy")) else c).alias(k) for k, c in f.items()))


@query(rf"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN 1 - (length(text) - length(regexp_replace(text, {_sql_text(_OUTSIDE)}, '', 'g'))) / length(text)::DOUBLE END, 6) AS share FROM documents WHERE length(text) > 0 AND 1 - (length(text) - length(regexp_replace(text, {_sql_text(_OUTSIDE)}, '', 'g'))) / length(text)::DOUBLE >= 0.95")
def ascii_ratio_filter(spark, sf_dir):
    return clean.mostly_ascii(table(spark, sf_dir, "documents"), "text", 0.95).select("doc_id", r(features.ascii_share(F.col("text"))).alias("share"))


# --- rules as expressions -----------------------------------------------------

_COMMANDS = r"""SELECT o_orderkey AS id, concat('cmd.exe /c wmic process ', o_custkey, ' get --port ', o_custkey % 9000, ' /duration ', o_orderkey % 60, ' port = "', o_orderkey, '" metric=', o_custkey,
' -eq ', o_orderkey, ' ProcessId=', o_custkey, ' chcp ', o_orderkey % 2000, ' PrOcess ', o_orderkey, ' findstr :', o_custkey, ' a', o_orderkey, '@mail.example.org http://h', o_custkey, '.example.com/x?y=', o_orderkey, ' ',
md5(CAST(o_orderkey AS VARCHAR)), ' ', sha256(CAST(o_orderkey AS VARCHAR)), ' S-1-5-21-', o_orderkey, '-', o_custkey, ' wscript CurDate=', 10000000 + o_orderkey, ' /try:', o_orderkey % 9, ' ', 1000000000 + o_orderkey, ' {', substr(md5('g' || o_orderkey), 1, 8), '-1111-2222-3333-', substr(md5('h' || o_orderkey), 1, 12), '} kill-port ', o_custkey, ' ', lpad(CAST(o_orderkey AS VARCHAR), 32, '7')) AS c FROM orders"""


def _commands(spark, sf_dir) -> DataFrame:
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    s, lit = (lambda x: x.cast("string")), F.lit
    parts = [
        lit("cmd.exe /c wmic process "), c, lit(" get --port "), s(u % 9000), lit(" /duration "), s(k % 60), lit(' port = "'), o, lit('" metric='), c, lit(" -eq "), o, lit(" ProcessId="), c, lit(" chcp "), s(k % 2000),
        lit(" PrOcess "), o, lit(" findstr :"), c, lit(" a"), o, lit("@mail.example.org http://h"), c, lit(".example.com/x?y="), o, lit(" "), F.md5(o), lit(" "), F.sha2(o, 256), lit(" S-1-5-21-"), o, lit("-"), c,
        lit(" wscript CurDate="), s(k + 10000000), lit(" /try:"), s(k % 9), lit(" "), s(k + 1000000000), lit(" {"), F.substring(F.md5(F.concat(lit("g"), o)), 1, 8), lit("-1111-2222-3333-"), F.substring(F.md5(F.concat(lit("h"), o)), 1, 12), lit("} kill-port "), c, lit(" "), F.lpad(o, 32, "7"),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(*parts).alias("c"))


def _sub(pattern: str, template: str, gate: str | None = None):
    """A replacement as SQL, under a condition on the text (t) as it is before."""

    def apply(text: str) -> str:
        out = f"regexp_replace({text}, {_sql_text(pattern)}, {_sql_text(template)}, 'g')"
        return out if gate is None else f"CASE WHEN {gate.replace('{t}', text)} THEN {out} ELSE {text} END"

    return apply


def _rule_query(name: str, rules: list[str], *steps) -> None:
    """The rules as expressions, against what they say written out by hand for an engine without look-around."""

    def f(spark, sf_dir):
        return _commands(spark, sf_dir).select("id", native.apply(F.col("c"), *rules).alias("command"))

    out = "c"
    for step in steps:
        out = step(out)
    f.__name__ = name
    query(f"WITH t AS ({_COMMANDS}) SELECT id, {out} AS command FROM t")(f)


_PORT_GATE, _WMIC_GATE, _SCRIPT_GATE = "contains({t}, ' --port')", "contains(lower({t}), 'wmic')", "contains(lower({t}), 'wscript') OR contains(lower({t}), 'vbs')"
_rule_query("rule_redact_email", ["email"], _sub(r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "<email>"))
_rule_query("rule_redact_url", ["url", "url_port"], _sub(r"""(?i)https?://[^\s"'<>]+""", "<url>"), _sub("<url>:([0-9]+)", "<url>:<port>"))
# 32 digits without a letter are no MD5: they are marked before, and the mark is taken off behind
_rule_query("rule_redact_hashes", ["sha256", "md5"], _sub(r"\b[0-9A-Fa-f]{64}\b", "<sha256>"), _sub(r"\b([0-9]{32})\b", r"\1_"), _sub(r"\b[0-9A-Fa-f]{32}\b", "<md5>"), _sub(r"\b([0-9]{32})_", r"\1"))
_rule_query("rule_redact_guid", ["guid"], _sub(r"""["']?\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\}?["']?""", "<guid>"))
_rule_query("rule_redact_sid", ["sid"], _sub(r"(?i)(^|[^a-z])S-1-[0-9]+(?:-[0-9]+)+", r"\1<SID>"))
_rule_query("rule_redact_timestamp", ["timestamp"], _sub(r"\b(?:[0-9]{10}|[0-9]{13})\b", "<timestamp>"))
_rule_query(
    "rule_gated_ports",
    ["port_option", "port_option_equals", "kill_port", "findstr_port", "port_equals"],
    _sub(r"""(\s--port\s)["']?[0-9]+["']?""", r"\1<port>", _PORT_GATE),
    _sub(r"""(\s--port=)["']?[0-9]+["']?""", r"\1<port>", _PORT_GATE),
    _sub(r"\skill-port [0-9]+", " kill-port <port>", "contains({t}, ' kill-port ')"),
    _sub(r"""(?i)(findstr\s["']?:)[0-9]+""", r"\1<n>", "contains(lower({t}), 'findstr')"),
    _sub(r"""(?i)(\blistenport\s*=\s*|\bport\s*=\s*|-UniversalPort\s)["']?[0-9]+["']?""", r"\1<port>"),
)
_rule_query(
    "rule_wmic",
    ["wmic_process", "wmic_interface", "process_id", "compare", "code_page", "metric", "duration"],
    _sub(r"(?i)\bprocess\s[0-9]+\b", "process <PID>", _WMIC_GATE),
    _sub(r"(?i)\binterfaceindex\s*=\s*[0-9]+", "InterfaceIndex=<id>", _WMIC_GATE),
    _sub(r"""(?i)\b(?:processid|idprocess)\s*!?=?\s*["']?[0-9]+["']?""", "ProcessId <PID>"),
    _sub(r"(?i)(-(?:eq|ne|lt|gt|le|ge|id)\s)[0-9]+", r"\1<PID>"),
    _sub(r"(?i)\bchcp\s[0-9]+", "chcp <code>"),
    _sub(r"""(?i)(\bmetric\s*=\s*)["']?[0-9]+["']?""", r"\1<n>"),
    _sub(r"\s/duration [0-9]+", " /duration <s>", "contains({t}, ' /duration ')"),
)
_rule_query("rule_wscript", ["current_date", "tries"], _sub(r"(?i)\bcurdate=[0-9]{8}\b", "CurDate=<date>", _SCRIPT_GATE), _sub("(?i)/try:[0-9]+", "/try:1", _SCRIPT_GATE))


# --- paths --------------------------------------------------------------------

_PATHS = r"""SELECT p_partkey AS id, concat('C:\Tools\', p_brand, '\', CASE p_partkey % 3 WHEN 0 THEN 'sub\' WHEN 1 THEN '' ELSE 'a\b\' END, CASE p_partkey % 7 WHEN 0 THEN 'run.exe' WHEN 1 THEN 'data.123' WHEN 2 THEN 'x.extension9' WHEN 3 THEN 'note.txt@v2' WHEN 4 THEN concat('job', p_partkey) WHEN 5 THEN CAST(p_partkey AS VARCHAR) ELSE 'a.Bat' END) AS path FROM part"""


def _paths(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    folder = F.when(k % 3 == 0, "sub\\").when(k % 3 == 1, "").otherwise("a\\b\\")
    name = F.when(k % 7 == 0, "run.exe").when(k % 7 == 1, "data.123").when(k % 7 == 2, "x.extension9").when(k % 7 == 3, "note.txt@v2").when(k % 7 == 4, F.concat(F.lit("job"), k.cast("string"))).when(k % 7 == 5, k.cast("string")).otherwise("a.Bat")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("C:\\Tools\\"), "p_brand", F.lit("\\"), folder, name).alias("path"))


_SHORT = r"""CASE WHEN contains(name, '.') THEN CASE WHEN ext = 'exe' THEN name WHEN regexp_full_match(ext, '[0-9]+') THEN '' WHEN length(ext) > 8 THEN '.<ext>' ELSE '.' || ext END
WHEN NOT keep THEN '' WHEN regexp_full_match(name, '[0-9]+') THEN '<n>' WHEN regexp_matches(name, '^([0-9]{10}|[0-9]{13})([^0-9A-Za-z_]|$)') THEN '<timestamp>' ELSE regexp_replace(name, '(.+?)[0-9]+', '\1', 'g') END"""


@query(rf"""WITH p AS ({_PATHS}), n AS (SELECT id, string_split(path, '\')[-1] AS name FROM p), e AS (SELECT id, name, string_split(string_split(name, '.')[-1], '@')[1] AS ext FROM n),
a AS (SELECT *, true AS keep FROM e), b AS (SELECT *, false AS keep FROM e) SELECT id, {_SHORT} AS short, keep FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def normalize_filename(spark, sf_dir):
    name = F.element_at(F.split("path", r"\\"), -1)
    both = F.array(*(F.struct(native.short_name(name, keep).alias("short"), F.lit(keep).alias("keep")) for keep in (True, False)))
    return _paths(spark, sf_dir).select("id", F.inline(both))


@query(rf"""WITH p AS ({_PATHS}), n AS (SELECT id, string_split(path, '\')[3:] AS parts FROM p), e AS (SELECT id, parts, parts[-1] AS name, string_split(string_split(parts[-1], '.')[-1], '@')[1] AS ext, false AS keep FROM n)
SELECT id, array_to_string(list_filter(['<C>', CASE WHEN len(parts) > 1 THEN lower(parts[1]) ELSE '' END, CASE WHEN len(parts) > 2 THEN '<path>' ELSE '' END, lower({_SHORT})], lambda x: x <> ''), '\') AS tagged FROM e""")
def combine_path(spark, sf_dir):
    parts = F.split("path", r"\\")
    parts = F.slice(parts, 3, F.size(parts))
    return _paths(spark, sf_dir).select("id", native.tagged("<C>", parts, keep_first=True).alias("tagged"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\.([A-Za-z0-9]{1,5})(?:[?#].*)?$', 1) AS ext FROM pages""")
def url_host_path_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1).alias("ext"))


@query(r"""WITH t AS (SELECT p_partkey AS id, concat('  """ + '"""' + r"""cmd  /c  ""', p_brand, '""  >', p_size, '   ', p_type, '"') AS c FROM part), s AS (SELECT id, regexp_replace(trim(c), '[ \t]{2,}', ' ', 'g') AS c FROM t),
q AS (SELECT id, c, length(regexp_extract(c, '^"*')) AS l, length(regexp_extract(c, '"*$')) AS k FROM s), u AS (SELECT id, CASE WHEN (l >= 3 AND k >= 1) OR (l >= 1 AND k >= 3) THEN substr(c, 2, length(c) - 2) ELSE c END AS c FROM q)
SELECT id, trim(regexp_replace(c, '""([^\s"]+)""', '"\1"', 'g')) AS c FROM u""")
def preprocess_ops(spark, sf_dir):
    made = F.concat(F.lit('  """cmd  /c  ""'), "p_brand", F.lit('""  >'), F.col("p_size").cast("string"), F.lit("   "), "p_type", F.lit('"'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), native.reduce_quotes(made).alias("c"))


_SPLIT_COMMANDS = r"""SELECT c_custkey AS id, string_split(CASE c_custkey % 6 WHEN 0 THEN concat('run.exe /c copy a', c_custkey, '.txt b') WHEN 1 THEN concat('<int_ip> -x ', c_custkey, ' a b c') WHEN 2 THEN '%a = b c d e' WHEN 3 THEN concat('tool ', c_mktsegment, ' x.y1234567 z') WHEN 4 THEN 'a b c' ELSE concat('cmd /c type <windows> ', c_name) END, ' ') AS w FROM customer"""


@query(rf"""WITH t AS ({_SPLIT_COMMANDS}), f AS (SELECT *, len(list_filter(w[2:], lambda x: (length(x) - length(replace(x, '.', '')) = 1 AND (length(string_split(x, '.')[2]) + 1 < 6 OR regexp_matches(string_split(x, '.')[1], '[\\/]$')))
 OR regexp_matches(x, '[.](exe|ps1|bat|cmd|js|py|vbs)$') OR regexp_matches(x, '<path>|<users>|<programfiles>|<windows>|<tmp>|<c>|<programdata>'))) > 0 AS has_file FROM t)
SELECT id, array_to_string(w, ' ') AS command FROM f WHERE (len(w) >= 6 OR (len(w) >= 4 AND NOT has_file)) AND NOT regexp_matches(w[1], '^\\*([0-9]|<int_ip>|<ext_ip>|<host>)') AND w[1] NOT IN ('//', 'x') AND NOT starts_with(w[1], '//--') AND NOT (len(w) >= 3 AND w[2] = '=' AND regexp_matches(w[1], '^[%$]'))""")
def valid_command_filter(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    made = F.when(k % 6 == 0, F.concat(F.lit("run.exe /c copy a"), s, F.lit(".txt b"))).when(k % 6 == 1, F.concat(F.lit("<int_ip> -x "), s, F.lit(" a b c"))).when(k % 6 == 2, "%a = b c d e").when(k % 6 == 3, F.concat(F.lit("tool "), "c_mktsegment", F.lit(" x.y1234567 z"))).when(k % 6 == 4, "a b c").otherwise(F.concat(F.lit("cmd /c type <windows> "), "c_name"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.split(made, " ").alias("w"))
    return rows.where(clean.valid_tokens(F.col("w"))).select("id", F.array_join("w", " ").alias("command"))


# --- unique table, labels, split ---------------------------------------------


@query("SELECT concat('ship ', l_returnflag, ' ', l_linestatus, ' ', l_suppkey) AS cmd_json, CAST(sum(l_quantity) AS DOUBLE) AS total_occurrences FROM lineitem GROUP BY 1")
def dedupe_sum_occurrences(spark, sf_dir):
    made = F.concat(F.lit("ship "), "l_returnflag", F.lit(" "), "l_linestatus", F.lit(" "), F.col("l_suppkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(made.alias("tree"), F.array().cast("array<string>").alias("tokens"), F.lit(True).alias("valid"), F.col("l_quantity").alias("total_occurrences"))
    return clean.unique_table(rows).select("cmd_json", F.col("total_occurrences").cast("double").alias("total_occurrences"))


@query("SELECT DISTINCT event_type || ' ' || props AS cmd_json FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL")
def distinct_commands(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" "), "props").alias("tree"), F.array().cast("array<string>").alias("tokens"), F.lit(True).alias("valid"))
    return clean.unique_table(rows).select("cmd_json")


_LABELLED = "SELECT text AS command_line, toxic AS label FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT md5(command_line) AS digest, label FROM ({_LABELLED})")
def union_labeled(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("text", "command_line")
    return split.labelled(rows.where("toxic = 1"), rows.where("toxic = 0")).select(F.md5("command_line").alias("digest"), "label")


@query("SELECT toxic AS label, count(*) AS n, sum(count(*)) OVER () / (2.0::DOUBLE * count(*)) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf_dir):
    return split.class_weights(table(spark, sf_dir, "labels"), "toxic")


@query("""SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id) <= round(0.3::DOUBLE * count(*) OVER (PARTITION BY toxic)) AS is_test FROM labels""")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return split.stratified_split(rows, "doc_id", 42, 0.3).select("doc_id", "label", "is_test")


# --- trees and graphs ---------------------------------------------------------

_TURNS = "SELECT conv_id AS graph_id, turn AS idx, CASE WHEN turn = 0 THEN -1 WHEN turn % 2 = 1 THEN 0 ELSE turn - 1 END AS parent FROM conversations"
_EDGES = f"""WITH n AS ({_TURNS}), s AS (SELECT *, coalesce(lag(idx) OVER (PARTITION BY graph_id, parent ORDER BY idx), parent) AS prev FROM n), e AS (
SELECT graph_id, parent AS src, idx AS dst, 0 AS type FROM s WHERE parent >= 0 UNION ALL SELECT graph_id, prev, idx, 1 FROM s WHERE parent >= 0 UNION ALL SELECT graph_id, idx, parent, 2 FROM s WHERE parent >= 0
UNION ALL SELECT graph_id, idx, prev, 3 FROM s WHERE parent >= 0 UNION ALL SELECT graph_id, idx, idx, 4 FROM s)"""


def _turn_nodes(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), t.alias("idx"), F.when(t == 0, -1).when(t % 2 == 1, 0).otherwise(t - 1).alias("parent"), t.alias("pos"))


@query(f"{_EDGES} SELECT graph_id, src, dst, type FROM e")
def tree_edges(spark, sf_dir):
    return graph.edges(_turn_nodes(spark, sf_dir))


@query(f"{_EDGES} SELECT graph_id, src, dst, CASE type WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS type FROM e WHERE type IN (1, 3, 4)")
def edge_ablation(spark, sf_dir):
    return graph.ablate(graph.edges(_turn_nodes(spark, sf_dir)), "self_loops_sequential")


@query(f"""{_EDGES}, d AS (SELECT graph_id, idx, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT graph_id, dst AS idx, 1 AS i, 0 AS o FROM e UNION ALL SELECT graph_id, src, 0, 1 FROM e) GROUP BY ALL)
SELECT graph_id, idx, in_degree, out_degree, in_degree + out_degree AS degree, round((in_degree + out_degree)::DOUBLE / max(in_degree + out_degree) OVER (PARTITION BY graph_id), 6) AS degree_share FROM d""")
def degree_features(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    return graph.degree_features(nodes, graph.edges(nodes)).withColumn("degree_share", r(F.col("degree_share")))


_PLACES = "SELECT 'world' AS node, NULL AS parent UNION ALL SELECT r_name, 'world' FROM region UNION ALL SELECT r_name || '/' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || '/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _places(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.concat("r_name", F.lit("/"), "n_name")
    rows = spark.createDataFrame([("world", None)], "node string, parent string").unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("node"), F.lit("world").alias("parent")))
    rows = rows.unionByName(nation.select(place.alias("node"), F.col("r_name").alias("parent")))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.unionByName(people.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), place.alias("parent")))


@query(f"""WITH RECURSIVE l AS ({_PLACES}), d AS (SELECT node, 0 AS depth, [node] AS path FROM l WHERE parent IS NULL UNION ALL SELECT l.node, d.depth + 1, list_append(d.path, l.node) FROM l JOIN d ON l.parent = d.node),
s AS (SELECT a AS node, count(*) AS subtree FROM (SELECT unnest(path) AS a FROM d) GROUP BY a) SELECT node, depth, subtree FROM d JOIN s USING (node)""")
def depth_subtree(spark, sf_dir):
    return graph.depth_and_subtree(_places(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN contains(text, '.ps') THEN 0 ELSE -1 END AS rule_label, CASE WHEN contains(text, '.ps') THEN 0 ELSE CAST(length(text) % 2 AS INT) END AS pred FROM documents WHERE text IS NOT NULL")
def rule_label_override(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("pred", (F.length("text") % 2).cast("int"))
    rows = rows.withColumn("rule_label", graph.rule_label(F.split("text", " ")))
    return metrics.with_rule_label(rows).select("doc_id", "rule_label", "pred")


# --- evaluation ---------------------------------------------------------------

_PREDICTED = """SELECT l.doc_id, l.toxic AS label, CAST(regexp_matches(lower(coalesce(text, '')), 'idiot|stupid|trash|moron') OR l.doc_id % 17 = 0 AS INT) AS pred, source FROM labels l JOIN documents USING (doc_id)"""
_CELLS = "count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn"


def predicted(spark, sf_dir) -> DataFrame:
    hit = F.lower(F.coalesce("text", F.lit(""))).rlike("idiot|stupid|trash|moron") | (F.col("doc_id") % 17 == 0)
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("toxic").alias("label"), hit.cast("int").alias("pred"), "source")


_SAFE = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
_F1 = {"malware": _SAFE("2 * tp", "2 * tp + fp + fn"), "clean": _SAFE("2 * tn", "2 * tn + fn + fp")}
_METRICS = f"""round({_SAFE('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round((({_F1['malware']}) + ({_F1['clean']})) / 2, 6) AS f1_macro,
round((({_F1['malware']}) * (tp + fn) + ({_F1['clean']}) * (tn + fp)) / (tp + tn + fp + fn), 6) AS f1_weighted, round({_F1['malware']}, 6) AS f1_malware, round({_SAFE('tp', 'tp + fp')}, 6) AS precision_malware,
round({_SAFE('tp', 'tp + fn')}, 6) AS recall_malware, round({_SAFE('fp', 'fp + tn')}, 6) AS fpr, tp, tn, fp, fn"""
_RATES = ("accuracy", "f1_macro", "f1_weighted", "f1_malware", "precision_malware", "recall_malware", "fpr")


@query(f"WITH p AS ({_PREDICTED}), c AS (SELECT {_CELLS} FROM p) SELECT {_METRICS} FROM c")
def confusion_metrics(spark, sf_dir):
    return metrics.metrics(predicted(spark, sf_dir)).select(*(r(F.col(c)).alias(c) for c in _RATES), "tp", "tn", "fp", "fn")


@query(f"WITH p AS ({_PREDICTED}), c AS (SELECT source, {_CELLS} FROM p GROUP BY source) SELECT source, {_METRICS} FROM c")
def metrics_by_source(spark, sf_dir):
    return metrics.metrics(predicted(spark, sf_dir), ["source"]).select("source", *(r(F.col(c)).alias(c) for c in _RATES), "tp", "tn", "fp", "fn")


@query(f"""WITH p AS ({_PREDICTED}), c AS (SELECT {_CELLS} FROM p), k AS (
SELECT 'malware' AS class, {_SAFE('tp', 'tp + fp')} AS p, {_SAFE('tp', 'tp + fn')} AS r, {_F1['malware']} AS f, (tp + fn)::DOUBLE AS s FROM c UNION ALL SELECT 'clean', {_SAFE('tn', 'tn + fn')}, {_SAFE('tn', 'tn + fp')}, {_F1['clean']}, (tn + fp)::DOUBLE FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM k UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s) FROM k
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s) FROM k""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(predicted(spark, sf_dir)).select("class", *(r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH p AS ({_PREDICTED}) SELECT label, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM p GROUP BY label")
def confusion_pivot(spark, sf_dir):
    return metrics.confusion_matrix(predicted(spark, sf_dir))


@query(f"WITH p AS ({_PREDICTED}) SELECT doc_id, kind, rank FROM (SELECT doc_id, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rank FROM p WHERE label <> pred)")
def fp_fn_ranked(spark, sf_dir):
    return metrics.errors(predicted(spark, sf_dir), "doc_id").select("doc_id", "kind", "rank")


_LOGITS = "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, label % 2 AS y FROM embeddings"
_LSE = "greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))"


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"), (F.col("label") % 2).alias("y"))


@query(f"WITH l AS ({_LOGITS}), p AS (SELECT vec_id, y, CASE WHEN y = 1 THEN b ELSE a END - ({_LSE}) AS lp FROM l) SELECT vec_id, round(-lp * pow(1 - exp(lp), 2), 6) + 0.0 AS loss FROM p")
def focal_loss_values(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", (r(metrics.focal((F.col("a"), F.col("b")), F.col("y"))) + 0.0).alias("loss"))


@query(f"WITH l AS ({_LOGITS}), p AS (SELECT vec_id, y, a - ({_LSE}) AS p0, b - ({_LSE}) AS p1 FROM l) SELECT vec_id, round(0.9 * -(CASE WHEN y = 1 THEN 2.0 * p1 ELSE 0.5 * p0 END) + 0.05 * -(0.5 * p0 + 2.0 * p1), 6) + 0.0 AS loss FROM p")
def weighted_ce_values(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", (r(metrics.cross_entropy((F.col("a"), F.col("b")), F.col("y"), (0.5, 2.0), 0.1)) + 0.0).alias("loss"))


@query(rf"""WITH t AS (SELECT p_partkey AS id, concat(p_name, ' "', p_type, '" x"', p_brand, ' z', '"y "" "', p_size) AS t FROM part)
SELECT id, array_to_string(list_transform(regexp_extract_all(t, '"[^"]*"|\S+'), lambda x: CASE WHEN length(x) >= 2 AND starts_with(x, '"') AND ends_with(x, '"') THEN x[2:-2] ELSE x END), '|') AS tokens FROM t""")
def plain_split(spark, sf_dir):
    """Quotes that open a token, stand inside one, are empty, or are never closed."""
    parts = [F.col("p_name"), F.lit(' "'), F.col("p_type"), F.lit('" x"'), F.col("p_brand"), F.lit(" z"), F.lit('"y "" "'), F.col("p_size").cast("string")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(native.plain_split(F.concat(*parts)), "|").alias("tokens"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source FROM documents")
def csv_in_splits(spark, sf_dir):
    """The documents as CSV, texts with line breaks and quotes, read back in splits."""
    path = fresh_path(spark, "documents-csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    rows.write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    back = files.read_csv(spark, path, schema="doc_id long, text string, lang string, source string")
    return back.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source")


# --- runs ---------------------------------------------------------------------

_RUNS = "SELECT event_id, event_type AS model, 'k' || (user_id % 4) AS feature_config, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'ce' END AS loss_type, value AS f1_malware, value * 0.5 AS fpr FROM events"


def _events(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.concat(F.lit("k"), (u % 4).cast("string")).alias("feature_config"), F.when(u % 5 == 0, None).otherwise("ce").alias("loss_type"), F.col("value").alias("f1_malware"), (F.col("value") * 0.5).alias("fpr"))


@query(f"WITH r AS ({_RUNS}) SELECT model, " + ", ".join(f"max(f1_malware) FILTER (WHERE feature_config = 'k{i}') AS k{i}" for i in range(4)) + " FROM r GROUP BY model")
def pivot_best(spark, sf_dir):
    return runs.best_of(_events(spark, sf_dir), "f1_malware", "model", "feature_config", [f"k{i}" for i in range(4)])


_STATS = ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(coalesce(stddev_pop({v}), 0), 6) AS {v}_std" for v in ("f1_malware", "fpr"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(F.col(c)).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in df.columns))


@query(f"WITH r AS ({_RUNS}) SELECT feature_config, model, loss_type, {_STATS} FROM r GROUP BY ALL")
def mean_std_by_config(spark, sf_dir):
    return _rounded(runs.mean_std(_events(spark, sf_dir), ["f1_malware", "fpr"]))


@query(f"WITH r AS ({_RUNS}) SELECT {_STATS} FROM r")
def mean_std_overall(spark, sf_dir):
    return _rounded(runs.mean_std(_events(spark, sf_dir), ["f1_malware", "fpr"], []))


_LEVELS = [["feature_config", "model", "loss_type"], ["feature_config", "loss_type"], ["model"], []]


@query(f"WITH r AS ({_RUNS}) SELECT feature_config, model, loss_type, CAST(GROUPING_ID(feature_config, model, loss_type) AS INTEGER) AS level, {_STATS.replace(', 6)', ', 9)')} FROM r GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(x) + ')' for x in _LEVELS)})")
def mean_std_levels(spark, sf_dir):
    """Groups by all keys, some, and none in one plan; rows without a loss are a group of their own at each level that has it."""
    out = runs.mean_std_levels(_events(spark, sf_dir), ["f1_malware", "fpr"], ["feature_config", "model", "loss_type"], _LEVELS)
    return out.select(*(F.round(c, 9).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in out.columns))


_HISTORY = "SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) - 1 AS epoch, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) % 97 AS DOUBLE) END AS f1_malware, CAST(floor(value * 7) % 89 AS DOUBLE) AS f1_macro FROM events"


@query(f"""WITH RECURSIVE h AS ({_HISTORY}),
w AS (
  SELECT run, epoch, f1_malware, f1_macro, coalesce(f1_malware > -1, false) AS better, coalesce(f1_malware, -1) AS best, CASE WHEN f1_malware IS NULL THEN NULL ELSE epoch END AS best_epoch, CASE WHEN f1_malware IS NULL THEN 1 ELSE 0 END AS since_best, f1_macro AS best_macro, 0 AS flat, 0.001::DOUBLE AS rate_after FROM h WHERE epoch = 0
  UNION ALL
  SELECT h.run, h.epoch, h.f1_malware, h.f1_macro, coalesce(h.f1_malware > w.best, false), greatest(w.best, coalesce(h.f1_malware, -1)), CASE WHEN h.f1_malware > w.best THEN h.epoch ELSE w.best_epoch END, CASE WHEN h.f1_malware > w.best THEN 0 ELSE w.since_best + 1 END,
    greatest(w.best_macro, h.f1_macro), CASE WHEN h.f1_macro > w.best_macro OR w.flat + 1 > 3 THEN 0 ELSE w.flat + 1 END, CASE WHEN NOT h.f1_macro > w.best_macro AND w.flat + 1 > 3 THEN w.rate_after / 2 ELSE w.rate_after END
  FROM w JOIN h ON h.run = w.run AND h.epoch = w.epoch + 1)
SELECT run, epoch, better, best_epoch, since_best, flat, rate_after, CAST(min(CASE WHEN since_best >= 5 THEN epoch END) OVER (PARTITION BY run) AS INTEGER) AS ends FROM w""")
def training_course(spark, sf_dir):
    """Best epoch, plateaus, rates and stop of many runs by windows; in SQL as a loop over the epochs, as training goes."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    history = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), (F.row_number().over(order) - 1).alias("epoch"), F.when(F.col("event_id") % 17 != 0, (F.floor("value") % 97).cast("double")).alias("f1_malware"), (F.floor(F.col("value") * 7) % 89).cast("double").alias("f1_macro")
    )
    return runs.training_course(history, ["run"]).select("run", "epoch", "better", "best_epoch", "since_best", "flat", "rate_after", "ends")


@query(f"WITH r AS (SELECT * FROM ({_RUNS}) ORDER BY event_id DESC NULLS LAST LIMIT 200) SELECT model, {_STATS} FROM r GROUP BY model")
def sort_limit_then_group(spark, sf_dir):
    return _rounded(runs.mean_std(_events(spark, sf_dir), ["f1_malware", "fpr"], ["model"], "event_id", 200))


@query(f"WITH r AS ({_RUNS}) SELECT event_id, CASE WHEN f1_malware IS NULL THEN '' ELSE printf('%.4f', f1_malware) END AS cell, CAST(event_id AS VARCHAR) AS whole FROM r")
def formatted_cells(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", runs.cell(F.col("f1_malware")).alias("cell"), runs.cell(F.col("event_id"), whole=True).alias("whole"))


_RUN_PATHS = "SELECT o_orderkey AS id, concat('runs/2025-', o_orderkey % 12, '/0.', 1 + o_orderkey % 4, '/seed', o_custkey % 50, '/', CASE o_orderkey % 2 WHEN 0 THEN 'semantic' ELSE 'all' END, '/all/org_model_', o_custkey % 3, '/semantic_only/', CASE o_orderkey % 3 WHEN 0 THEN 'RGCN' WHEN 1 THEN 'GCN' ELSE 'GIN' END, '_', CASE o_orderkey % 2 WHEN 0 THEN 'ce' ELSE 'focal' END, CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '_model.pt' END) AS path FROM orders"
_PARSED_RUNS = f"""WITH p AS ({_RUN_PATHS}), s AS (SELECT id, path, string_split(path, '/') AS x FROM p), m AS (SELECT *, regexp_replace(x[9], '_model[.]pt$', '') AS stem FROM s),
r AS (SELECT id, path, x[2] AS timestamp, CAST(x[3] AS DOUBLE) AS test_size, CAST(substr(x[4], 5) AS INT) AS seed, x[5] AS feature_type, x[6] AS edge_ablation, regexp_replace(x[7], '^([^_]*)_', '\\1/') AS embedder, x[8] AS feature_config,
string_split(stem, '_')[1] AS model, regexp_extract(stem, '^[^_]*_(.*)$', 1) AS loss, array_to_string(x[1:8], '/') AS run_dir FROM m)"""


def _run_paths(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s, lit = (lambda x: x.cast("string")), F.lit
    path = F.concat(lit("runs/2025-"), s(k % 12), lit("/0."), s(1 + k % 4), lit("/seed"), s(c % 50), lit("/"), F.when(k % 2 == 0, "semantic").otherwise("all"), lit("/all/org_model_"), s(c % 3), lit("/semantic_only/"), F.when(k % 3 == 0, "RGCN").when(k % 3 == 1, "GCN").otherwise("GIN"), lit("_"), F.when(k % 2 == 0, "ce").otherwise("focal"), F.when(k % 11 == 0, ".txt").otherwise("_model.pt"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), path.alias("path"))


def _parsed_runs(spark, sf_dir):
    return _run_paths(spark, sf_dir).select("id", "path", *(c.alias(n) for n, c in runs.parse_run_path(F.col("path")).items()))


@query(f"{_PARSED_RUNS} SELECT * FROM r")
def run_path_parse(spark, sf_dir):
    return _parsed_runs(spark, sf_dir)


@query(f"{_PARSED_RUNS} SELECT id, path FROM r WHERE seed = 7 AND feature_type = 'all' AND model IN ('RGCN', 'GIN') AND regexp_matches(lower(model), '^(rg|gi)')")
def run_lookup(spark, sf_dir):
    return runs.lookup(_parsed_runs(spark, sf_dir), ["RGCN", "GIN"], ["rg", "gi"], seed=7, feature_type="all").select("id", "path")


@query(f"{_PARSED_RUNS} SELECT run_dir, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, array_to_string(list_sort(list(DISTINCT loss)), ',') AS losses FROM r GROUP BY run_dir")
def run_sets(spark, sf_dir):
    return runs.run_sets(_parsed_runs(spark, sf_dir)).select("run_dir", F.array_join("models", ",").alias("models"), F.array_join("losses", ",").alias("losses"))


@query(f"{_PARSED_RUNS} SELECT path FROM r WHERE seed = 7 ORDER BY path LIMIT 1")
def run_first(spark, sf_dir):
    return runs.first_run(runs.lookup(_parsed_runs(spark, sf_dir), seed=7)).select("path")


_MODELS = {
    "gcn": "total * 128 + 3 * (128 + 256) + 33154", "sage": "2 * total * 128 + 3 * (128 + 256) + 33154", "gat": "total * 128 + 3 * (256 + 128 + 256) + 33154",
    "rgcn": "6 * total * 128 + 3 * (128 + 256) + 33154", "gin": "total * 128 + 3 * (128 + 256 + 128 * 128 + 128 + 256) + 384 * 128 + 128 + 258",
}


@query("SELECT vec_id, " + ", ".join(f"CAST({x} AS INTEGER) AS {m}" for m, x in _MODELS.items()) + " FROM (SELECT vec_id, len(embedding) + 2 * 128 AS total FROM embeddings)")
def parameter_counts(spark, sf_dir):
    """Sizes of three-layer models over vectors as wide as each row's."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *(runs.parameters(m, F.size("embedding")).cast("int").alias(m) for m in _MODELS))


# --- vectors ------------------------------------------------------------------


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) SELECT label, dim, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(sum(v), 4) AS total FROM e GROUP BY ALL""")
def mean_max_pool(spark, sf_dir):
    return learn.pool(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", r(F.col("mean")).alias("mean"), r(F.col("max")).alias("max"), F.round("total", 4).alias("total"))


@query("""WITH k AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT o_custkey % n AS dst, o_orderkey % n AS src FROM orders, k), v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) SELECT dst, dim, round(avg(v), 6) AS mean FROM e JOIN v ON src = vec_id GROUP BY ALL""")
def message_pass_mean(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    edge_rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("dst"), (F.col("o_orderkey") % n).alias("src"))
    return learn.message_mean(edge_rows, vectors.select(F.col("vec_id").alias("node"), F.col("embedding").alias("x"))).select("dst", "dim", r(F.col("mean")).alias("mean"))


_WORD = r"[\p{L}\p{N}_]{2,}"
_VOCABULARY = 50_000


def _tfidf_sql(terms: str) -> str:
    """Weights of the most frequent terms; terms: a query of doc_id and term."""
    return f"""WITH w AS ({terms}), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
v AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY sum(tf) DESC, term) AS k FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf * (ln((1 + n) / (1.0::DOUBLE + df)) + 1) AS w FROM t JOIN v USING (term), n WHERE k <= {_VOCABULARY})
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM x"""


_WORDS = f"SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents"


@query(_tfidf_sql(f"SELECT doc_id, unnest(flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [1, 2, 3]])) AS term FROM ({_WORDS})"))
def tfidf_word_topk(spark, sf_dir):
    """Runs of one to three words, the 50,000 most frequent."""
    docs = table(spark, sf_dir, "documents")
    return learn.tfidf_rows(docs, "doc_id", learn.word_grams(F.coalesce("text", F.lit("")), 1, 3), _VOCABULARY).select("doc_id", "term", r(F.col("tfidf")).alias("tfidf"))


# --- what SQL cannot say: rows only, tests hold them against goldens and plain versions ------


def _examples_sql(rows: list[tuple], answer: str) -> str:
    """Hand-written answers, for each nation's number."""
    values = ", ".join("(" + ", ".join(map(_sql_text, (str(k), *r))) + ")" for k, r in enumerate(rows))
    width = len(rows[0])
    names = "k, " + ("rule, given, answer" if width == 3 else "given, answer")
    return f"SELECT CAST(k AS INT) AS k, CAST(n_nationkey AS INT) AS nation, replace(answer, '{{n}}', CAST(10 + n_nationkey AS VARCHAR)) AS {answer} FROM (VALUES {values}) AS t({names}), nation"


def _examples(spark, sf_dir, rows: list[tuple]) -> DataFrame:
    number = (F.col("n_nationkey") + 10).cast("string")
    given = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], "k int, " + ("rule string, " if len(rows[0]) == 3 else "") + "given string")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), number.alias("number"))
    return given.crossJoin(nation).withColumn("given", F.replace("given", F.lit("{n}"), F.col("number")))  # a table of examples by one of 25 rows


@query(_examples_sql(examples.RULES, "rewritten"))
def rule_examples(spark, sf_dir):
    """Each rule alone, on a text of its own."""
    return _examples(spark, sf_dir, examples.RULES).select("k", "nation", clean.one_rule(F.col("rule"), F.col("given")).alias("rewritten"))


@query(_examples_sql(examples.COMMANDS, "tree"))
def parser_examples(spark, sf_dir):
    """Cleaning, rules, splitting, payloads and recursion together."""
    return clean.parsed(_examples(spark, sf_dir, examples.COMMANDS), "given").select("k", "nation", "tree")


_PARSED_TREE = """["cmd.exe", "/c", "wmic", "process", "<pid>", "get", "--port", "<port>", "/duration", "<s>", "port", "=", "<port>", "metric=<n>", "-eq", "<pid>", "processid", "<pid>", "chcp", "<code>", "process", "<pid>", "findstr", ":<n>", "<email>", "<url>", "<md5>", "<sha256>", "<sid>", "wscript", "curdate=<date>", ["/try", "<n>"], "<timestamp>", "<guid>", "kill-port", "<port>", "<token>"]"""
_PARSED_TOKENS = "cmd.exe /c wmic process <pid> get --port <port> /duration <s> port = <port> metric=<n> -eq <pid> processid <pid> chcp <code> process <pid> findstr :<n> <email> <url> <md5> <sha256> <sid> wscript curdate=<date> /try <n> <timestamp> <guid> kill-port <port> <token>"


@query(f"SELECT o_orderkey AS id, {_sql_text(_PARSED_TREE)} AS tree, {_sql_text(_PARSED_TOKENS)} AS tokens, true AS valid, 39 AS n_nodes FROM orders")
def parse_commands(spark, sf_dir):
    """All numbers, names and digests of the commands become tags, so they all have one tree."""
    return clean.parsed(_commands(spark, sf_dir).withColumnRenamed("c", "command_line")).select("id", "tree", F.array_join("tokens", " ").alias("tokens"), "valid", F.size("nodes").alias("n_nodes"))


@query("SELECT o_orderkey AS id, concat('cmd.exe it''s ', o_orderkey, ' a,b ', o_custkey) AS text FROM orders")
def unique_tables_read_back(spark, sf_dir):
    """Trees as text, back to their leaves."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    made = F.concat(F.lit("('cmd.exe', (\"it's\", ('"), k, F.lit("',)), 'a,b', '"), c, F.lit("')"))
    return clean.read_back(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), made.alias("command_line"))).select("id", "text")


_POSITIONS = f"""WITH RECURSIVE l AS ({_PLACES}), d AS (SELECT node, parent, 0 AS depth, [node] AS path FROM l WHERE parent IS NULL UNION ALL SELECT l.node, l.parent, d.depth + 1, list_append(d.path, l.node) FROM l JOIN d ON l.parent = d.node),
s AS (SELECT a AS node, count(*) AS subtree FROM (SELECT unnest(path) AS a FROM d) GROUP BY a)
SELECT node AS idx, round(depth / (SELECT max(depth) FROM d)::DOUBLE, 6) AS depth_share, (subtree = 1)::INT::DOUBLE AS is_leaf, (parent IS NULL)::INT::DOUBLE AS is_root, round(ln(1 + subtree), 6) AS log_subtree FROM d JOIN s USING (node)"""


@query(_POSITIONS)
def positional_features(spark, sf_dir):
    links = _places(spark, sf_dir)
    nodes = graph.depth_and_subtree(links).join(links, "node").select(F.lit(1).alias("graph_id"), F.col("node").alias("idx"), F.when(F.col("parent").isNull(), -1).otherwise(0).alias("parent"), "depth", "subtree")
    return graph.positional_features(nodes).select("idx", r(F.col("depth_share")).alias("depth_share"), "is_leaf", "is_root", r(F.col("log_subtree")).alias("log_subtree"))


_GRAM_TEXT = "SELECT c_custkey AS doc_id, lower(c_name || '  ' || c_mktsegment || ' x') AS t FROM customer"


def _gram_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit("  "), "c_mktsegment", F.lit(" x")).alias("t"))


@query(f"WITH d AS ({_GRAM_TEXT}), s AS (SELECT doc_id, regexp_replace(t, '\\s+', ' ', 'g') AS t FROM d) SELECT doc_id, array_to_string(flatten([list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n)) for n in [3, 4, 5]]), '|') AS grams FROM s")
def char_grams(spark, sf_dir):
    return _gram_text(spark, sf_dir).select("doc_id", F.array_join(learn.char_grams(F.col("t"), 3, 5), "|").alias("grams"))


@query(f"WITH d AS ({_GRAM_TEXT}), w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), lambda x: ' ' || x || ' ') AS w FROM d) SELECT doc_id, array_to_string(flatten(list_transform(w, lambda x: flatten([list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n)) for n in [3, 4, 5]]))), '|') AS grams FROM w")
def char_grams_inside_words(spark, sf_dir):
    return _gram_text(spark, sf_dir).select("doc_id", F.array_join(learn.char_grams(F.col("t"), 3, 5, True), "|").alias("grams"))


@query(f"WITH t AS ({_tfidf_sql(f'SELECT doc_id, unnest(w) AS term FROM ({_WORDS})')}) SELECT count(*) AS stored, count(DISTINCT doc_id) AS rows_used, count(DISTINCT term) AS columns_used, round(count(*) / (count(DISTINCT doc_id) * count(DISTINCT term))::DOUBLE, 9) AS density, round(count(*) / count(DISTINCT doc_id)::DOUBLE, 6) AS per_row FROM t")
def tfidf_matrix_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    m = learn.tfidf_rows(docs, "doc_id", learn.word_grams(F.coalesce("text", F.lit("")), 1, 1), _VOCABULARY)
    return learn.matrix_stats(m, "doc_id").select("stored", "rows_used", "columns_used", F.round("density", 9).alias("density"), r(F.col("per_row")).alias("per_row"))


@query("WITH d AS (SELECT doc_id, toxic AS label, ln(1 + length(coalesce(text, ''))) AS a, length(coalesce(text, ''))::DOUBLE AS b, doc_id % 3 AS k FROM documents JOIN labels USING (doc_id)), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM d WHERE k > 0) SELECT doc_id, round((a - ma) / sa, 6) + 0.0 AS a, round((b - mb) / sb, 6) + 0.0 AS b FROM d, s WHERE k = 0")
def scaled_features(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit(""))).cast("double")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.log1p(n).alias("a"), n.alias("b"))
    out = learn.scale(rows.where("doc_id % 3 > 0"), [rows.where("doc_id % 3 = 0")], ["a", "b"])[1]
    return out.select("doc_id", *((r(F.col(c)) + 0.0).alias(c) for c in ("a", "b")))


@query("""SELECT p_partkey AS id, CASE WHEN n BETWEEN 31 AND 33 OR n IN (36, 48) THEN '["powershell.exe", "-enc", "<payload>"]' ELSE concat('["powershell.exe", "-enc", ["get-item", "', replace(p_name, ' ', '", "'), '"]]') END AS tree
FROM (SELECT *, CAST(ceil(8 * (9 + length(p_name)) / 3.0::DOUBLE) AS INT) AS n FROM part)""")
def decode_payloads(spark, sf_dir):
    """UTF-16 in Base64. The rules run before payloads are read, so what is as long as a token of theirs (31 to 33, 36 or 48 characters) is one."""
    made = F.concat(F.lit("powershell.exe -enc "), F.base64(F.encode(F.concat(F.lit("Get-Item "), "p_name"), "UTF-16LE")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("command_line"))
    return clean.parsed(rows).select("id", "tree")


@query()
def logistic_manual(spark, sf_dir):
    """The features are computed once, into a table; scaling, weights, fit and test read that."""
    f = features.manual_features(F.col("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = stored(table(spark, sf_dir, "documents").join(split.stratified_split(labels, "doc_id", 42, 0.3), "doc_id").select("doc_id", "label", "is_test", *(c.alias(k) for k, c in f.items())), "manual-features")
    train, test = learn.scale(rows.where("not is_test"), [rows.where("is_test")], list(f))
    model = learn.logistic(train, list(f))
    return metrics.metrics(model.transform(test).select("label", F.col("prediction").cast("int").alias("pred")))


@query()
def graph_forward(spark, sf_dir):
    """A forward pass of a full-size model over all features."""
    model = gnn.Model("rgcn", runs.input_width(serving.SEMANTIC_WIDTH, True, True)).start(7)
    return serving.infer_commands(_commands(spark, sf_dir), "id", model, "all", command="c").select("graph_id", "pred")
