"""The registered queries of the routing engine, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway import table_queries
from sluiceway.functions.expressions import prifilt
from sluiceway.operators import detect, detect_index, enrich, expect, replay, siem
from sluiceway.operators.targets import TARGETS
from sluiceway.plans.routing import evaluate
from sluiceway.sources.config import parse_config
from sluiceway.sources.messages import MESSAGES_SQL, event_messages, read_lines, structured_data, with_properties
from sluiceway.sources.ndjson import read_line_array, read_ndjson
from sluiceway.sources.ordered import first_messages, read_ordered_lines
from sluiceway.sources.tree import load_tree, overlaid, tree_findings
from sluiceway.staging import folder
from sluiceway.streaming.route import deliveries, route_lines

CONFIG = """
module(load="imudp")
input(type="imudp" port="514" ruleset="main")
input(type="imtcp" port="6601" ruleset="tcp")
lookup_table(name="teams" file="teams.json")
template(name="perhost" type="string" string="/var/log/%hostname%/%programname%.log")
ruleset(name="main") {
  set $.team = lookup("teams", $programname);
  if $programname == "kernel" then { action(type="omfile" file="/var/log/kern.log") stop }
  if $.team == "security" then action(type="omfwd" target="siem" port="514" protocol="tcp")
  else if $syslogseverity < 4 then action(type="omfile" dynafile="perhost")
  if $msg contains "9" then call audit
}
ruleset(name="tcp") {
  if $syslogfacility-text startswith "local" then stop
  if re_match($msg, "value=[0-9]$") then action(type="omfile" file="/var/log/short.log")
}
ruleset(name="audit") {
  if $hostname == "host3" then stop
  action(type="omfile" file="/var/log/audit.log")
}
"""
LOOKUPS = {"teams.json": '{"version": 1, "nomatch": "none", "table": [{"index": "sshd", "value": "security"}, {"index": "sudo", "value": "security"}, {"index": "nginx", "value": "web"}]}'}
OVERLAY = CONFIG.replace('target="siem"', 'target="siem2"').replace('$msg contains "9"', '$msg contains "8"')
SELECTORS = """
kern.*;mail.err /var/log/kern.log
*.=debug /var/log/debug.log
auth,authpriv.warning @@loghost:601
*.info;mail.none -/var/log/messages
"""
RULES = """
title: Login errors
level: high
detection:
  selection: {programname: sshd, message|contains: ["1", "2"]}
  condition: selection
---
title: Any of two
level: low
detection:
  sel_a: {host|endswith: ["3", "7"]}
  sel_b: {severity: [0, 1]}
  other: {image: cron}
  condition: 1 of sel_* and not other
---
title: Windows only
logsource: {product: windows}
detection: {selection: {programname: sshd}}
"""

_M = f"WITH m AS ({MESSAGES_SQL}), p AS (SELECT *, CAST(regexp_extract(rawmsg, '^<([0-9]+)>', 1) AS INT) AS pri FROM m),\n"
_FACILITY = "CASE WHEN pri // 8 >= 16 THEN 'local' ELSE 'x' END"
#: The configuration above, by hand.
_ROUTED = _M + """
f AS (SELECT *, pri % 8 AS sev, pri // 8 AS fac, CASE WHEN transport = 'udp' AND port = 514 THEN 'main' WHEN transport = 'tcp' AND port = 6601 THEN 'tcp' END AS ruleset,
  programname IN ('sshd', 'sudo') AS sec, contains(msg, '{needle}') AS nine FROM p),
o AS (
  SELECT idx, 1 AS k, 'omfile' AS kind, '/var/log/kern.log' AS target FROM f WHERE ruleset = 'main' AND programname = 'kernel'
  UNION ALL SELECT idx, 2, 'omfwd', '{siem}:514/tcp' FROM f WHERE ruleset = 'main' AND sec
  UNION ALL SELECT idx, 3, 'omfile', '/var/log/' || hostname || '/' || programname || '.log' FROM f WHERE ruleset = 'main' AND programname <> 'kernel' AND NOT sec AND sev < 4
  UNION ALL SELECT idx, 4, 'omfile', '/var/log/audit.log' FROM f WHERE ruleset = 'main' AND programname <> 'kernel' AND nine AND hostname <> 'host3'
  UNION ALL SELECT idx, 5, 'omfile', '/var/log/short.log' FROM f WHERE ruleset = 'tcp' AND fac < 16 AND regexp_matches(msg, 'value=[0-9]$')),
"""


def _routed(needle: str = "9", siem: str = "siem") -> str:
    return _ROUTED.format(needle=needle, siem=siem)


def _both() -> str:
    """Relations a and b: idx, o (the outputs in order, null if none), s (the signature) under both configurations."""
    side = lambda routed: f"""{routed} x AS (SELECT idx, string_agg(kind || ':' || target, ',' ORDER BY kind || ':' || target) AS o FROM o GROUP BY 1)
SELECT f.*, x.o, CASE WHEN ruleset IS NULL THEN 'unmatched' ELSE 'rs=' || ruleset || '|' || coalesce(x.o, '') END AS s FROM f LEFT JOIN x USING (idx)"""  # noqa: E731
    return f"WITH a AS ({side(_routed())}), b AS ({side(_routed('8', 'siem2'))})\n"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(event_messages(spark, sf_dir), parse_config(CONFIG, LOOKUPS))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.compare(event_messages(spark, sf_dir), parse_config(CONFIG, LOOKUPS), parse_config(OVERLAY, LOOKUPS))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    wire = F.concat(F.lit("<"), F.col("pri_number"), F.lit(">Jan  2 03:04:05 "), F.col("hostname"), F.lit(" "), F.col("programname"), F.lit("["), F.col("user_id"), F.lit("]: "), F.col("msg"))
    return m.select("idx", m["props.pri"].alias("pri_number"), "hostname", "programname", "user_id", "msg").select("idx", wire.alias("value"))


def _wire5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    parts = (F.lit("<"), m["props.pri"], F.lit(">1 2024-01-02T03:04:05Z "), "hostname", F.lit(" "), "programname", F.lit(" "), "user_id", F.lit(' - [ex@1 kind="'), "event_type", F.lit('" q="a\\"b"] '), "msg")
    return m.select("idx", F.concat(*parts).alias("value"))


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(spark, sf_dir).select("idx", F.concat(F.lit("Jan  2 03:04:05 "), "hostname", F.lit(" "), "programname", F.lit(": "), "msg").alias("value"))


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    whole = F.to_json(F.struct("transport", F.when(m["user_id"] % 2 == 0, m["port"]).alias("port"), "programname", "msg"))
    return m.select("idx", F.when(F.col("event_type") == "view", F.concat(F.lit("!"), whole)).otherwise(whole).alias("value"))


_KIND = {"sshd": "linux:secure", "sudo": "linux:messages", "nginx": "haproxy:access", "kernel": "pan:threat", "cron": "other"}


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(*(F.lit(x) for kv in _KIND.items() for x in kv))
    rows = event_messages(spark, sf_dir).select("idx", pairs[F.col("programname")].alias("tag"))
    return siem.retag(rows, "tag", siem.retag_map(siem.value_map(spark), ("splunk", "sourcetype"), ("datadog", "ddsource")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the column `event`, by pivot names."""
    named = {"src_endpoint.hostname": "hostname", "service.name": "programname", "metadata.log_name": "event_type", "custom.note": "msg"}
    return event_messages(spark, sf_dir).withColumn("event", F.create_map(*(x for k, c in named.items() for x in (F.lit(k), F.col(c)))))


_NOTE = """'{"custom.note":"' || msg || '"}'"""
_FLAT = lambda host, service, log: f"""'{{"{host}":"' || hostname || '","{service}":"' || programname || '","{log}":"' || event_type || '","unmapped":' || {_NOTE} || '}}'"""
#: The lines of the stores, by hand.
_LINES = {
    "generic": """'{"unmapped":{"src_endpoint.hostname":"' || hostname || '","service.name":"' || programname || '","metadata.log_name":"' || event_type || '","custom.note":"' || msg || '"}}'""",
    "splunk": _FLAT("host", "source", "sourcetype"), "datadog": _FLAT("hostname", "service", "ddsource"), "loki": _FLAT("host", "service", "job"), "microsoft-sentinel": _FLAT("Computer", "ProcessName", "Type"),
    "sumo-logic": _FLAT("_sourceHost", "_sourceName", "_sourceCategory"),
    "elastic-ecs": f"""'{{"host":{{"hostname":"' || hostname || '"}},"service":{{"name":"' || programname || '"}},"event":{{"dataset":"' || event_type || '"}},"unmapped":' || {_NOTE} || '}}'""",
    "graylog-gelf": """'{"version":"1.1","host":"' || hostname || '","facility":"' || programname || '","short_message":"' || event_type || '","_unmapped":"{\\"custom.note\\":\\"' || msg || '\\"}"}'""",
    "chronicle-udm": """'{"metadata":{"product_name":"sluiceway","event_type":"' || event_type || '"},"principal":{"hostname":"' || hostname || '","application":"' || programname || '"},"additional":{"fields":[{"key":"custom.note","value":{"string_value":"' || msg || '"}}]}}'""",
    "qradar-leef": "'LEEF:2.0|sluiceway|unknown|0|0||srcHost=' || hostname || chr(9) || 'cat=' || programname || chr(9) || 'metadataLogName=' || event_type || chr(9) || 'customNote=' || replace(msg, '=', '\\=')",
    "arcsight-cef": "'CEF:0|sluiceway|unknown|0|0|event|5|shost=' || hostname || ' app=' || programname || ' metadataLogName=' || event_type || ' customNote=' || replace(msg, '=', '\\=')",
}

STATE = """
set $.a = $programname;
set $.a = $.a & "!";
set $!n = $msg;
if $hostname == "host1" then unset $.a;
if $syslogfacility < 4 then unset $!n;
set $.b = $.a & "?";
"""
JSON_ROUTES = """
template(name="by_k" type="string" string="/var/log/k%$!k%.log")
action(type="mmjsonparse")
ruleset(name="json") { action(type="mmjsonparse") set $.ok = $parsesuccess; action(type="omfile" dynafile="by_k") }
global(defaultruleset="json")
"""
STRUCTURED = """
ruleset(name="sd") { if $!x1_kind == "click" or $!x1_kind == "error" then action(type="omfile" file="/var/log/%$!x1_kind%-%$!x1_on%.log") }
global(defaultruleset="sd")
"""
def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_messages(spark, sf_dir).select(F.col("facility").cast("long").alias("fac"), F.col("severity").cast("long").alias("sev")).distinct()
    specs = {"a": "security.*", "b": "*.info;mail.none", "c": "KERN,mail.!=error", "d": "*.!Warning", "e": "console,solaris-cron.=alert;cron.*"}
    return rows.select("fac", "sev", *(prifilt(x, F.col("fac"), F.col("sev")).alias(k) for k, x in specs.items()))


def _json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir).drop("props", "facility", "severity")
    return with_properties(m.withColumn("msg", F.when(m["event_type"] == "click", F.concat(F.lit("@cee: "), "body")).when(m["event_type"] == "view", F.col("body")).otherwise(F.col("msg"))))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.lit('<34>1 - h app - - [x1 kind="'), "event_type", F.lit('" on="'), "hostname", F.lit('"][y] '), "msg")
    return event_messages(spark, sf_dir).select("idx", F.concat(*parts).alias("value"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of lines that differ in blanks, tags and parts that are missing."""
    c = lambda *parts: F.concat(*(F.lit(x) if x not in ("hostname", "programname", "msg") else F.col(x) for x in parts))
    forms = [
        c("<34>Oct 1 22:14:15  ", "hostname", " ", "programname", "[7]: ", "msg"), c("<34>Oct  1 22:14:15 ", "hostname", " no tag here"), c("\t Oct 11 22:14:15 ", "hostname", " ", "programname", ": ", "msg", " \r"),
        c("Oct 1 22:14:15 ", "hostname", " ", "programname", " 1.4: ", "msg"), c("<34>1  2024-01-02T03:04:05Z ", "hostname", " ", "programname", " 7 ID9 - \ufeff", "msg"), c("<34>", "msg"),
    ]
    pick = F.element_at(F.array(*forms), (F.col("idx") % 6 + 1).cast("int"))
    return event_messages(spark, sf_dir).select("idx", pick.alias("value")).union(spark.createDataFrame([(-1, " \t ")], "idx long, value string"))


#: The configuration above as a tree, and an overlay that replaces one of its files.
_HEAD, _RULES = CONFIG.split('ruleset(name="main")', 1)
TREE = {
    "/etc/router.conf": _HEAD + 'include(file="rules.d/*.conf")\ninclude(file="gone.conf")\n$IncludeConfig none.d/*.conf\n',
    "/etc/rules.d/10-main.conf": 'ruleset(name="main")' + _RULES.split('ruleset(name="tcp")')[0] + 'include(file="../router.conf")\n',
    "/etc/rules.d/20-rest.conf": 'ruleset(name="tcp")' + _RULES.split('ruleset(name="tcp")')[1], "/etc/rules.d/notes.txt": "not read", "/srv/tables/teams.json": LOOKUPS["teams.json"],
}
PREFIXED = """
kern.*;*.<= action(type="omfile"
  file="/skipped")
kern.* action(type="omfile"
  file="/var/log/kern.log")
*.=debug /var/log/debug.log
"""

TAGGING = """
input(type="imudp" port="514" ruleset="tag")
ruleset(name="tag") {
  if $programname == "sshd" then { set $!sourcetype = "secure"; action(type="omfile" file="/a") stop }
  set $!sourcetype = $programname;
  if $syslogseverity < 2 then call late
}
ruleset(name="late") { unset $!sourcetype; action(type="omfile" file="/late") }
"""
TAG_RULES = """
title: Secure
detection: {selection: {sourcetype: secure}}
---
title: Scheduled
detection: {selection: {sourcetype: cron, msg|contains: '1'}}
---
title: Never
detection: {selection: {sourcetype: none}}
"""


def _tag_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = parse_config(TAGGING), parse_config(TAGGING.replace('"sshd"', '"sudo"').replace("< 2", "< 0"))
    return detect.routed_fire_deltas(event_messages(spark, sf_dir), detect.parse_rules(TAG_RULES), before, after)


def _tree(changed: dict[str, str] | None = None):
    return load_tree(overlaid(TREE, changed or {}), "/etc/router.conf")


def _nation_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """A tree with a file for each nation (a fixed table) of three regions, and a pattern for each region."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey").collect()
    regions = sorted({n.n_regionkey for n in nations})
    files = {"/etc/router.conf": "".join(f'include(file="{n.n_name}.conf")\n' for n in nations) + "".join(f"$IncludeConfig r{r}/*.conf\n" for r in regions)}
    return files | {f"/etc/{n.n_name}.conf": 'include(file="router.conf")\n' for n in nations if n.n_regionkey >= 2} | {f"/etc/r{r}/all.conf": "" for r in regions if r >= 2}


def _line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_messages(spark, sf_dir)
    body = F.when(m["event_type"] == "view", F.to_json(F.struct("msg"))).otherwise(F.concat(F.lit("[1, null, "), F.to_json(F.array("msg", "programname")).substr(F.lit(2), F.lit(1 << 20))))
    return m.select("idx", body.alias("value"))


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is to be in main, to be written to kern.log, and to belong to the security team; and one message that is not there."""
    out = "array(named_struct('kind', 'omfile', 'path_contains', 'kern', 'target', NULL, 'port', NULL, 'protocol', NULL))"
    asked = event_messages(spark, sf_dir).select("idx").union(spark.createDataFrame([(-1,)], "idx long")).selectExpr(
        "concat('t', idx) AS test", "idx", "'main' AS ruleset", "CAST(NULL AS BOOLEAN) AS stopped", "false AS dropped", f"{out} AS outputs", "CAST(NULL AS MAP<STRING, STRING>) AS structured", "map('team', 'security') AS locals")
    return expect.checks(_evaluated(spark, sf_dir), asked)


_ASKED = """w AS (SELECT idx, ruleset IS NOT DISTINCT FROM 'main' AS a, ruleset IS NOT NULL AS b, ruleset IS NOT DISTINCT FROM 'main' AND programname = 'kernel' AS c, ruleset IS NOT DISTINCT FROM 'main' AND sec AS d FROM f
  UNION ALL SELECT -1, false, false, false, false),
"""

_TAGGED = """t AS (SELECT *, transport = 'udp' AND port = 514 AS here FROM p),
r AS (SELECT 0 AS rule_ord, 'Secure' AS title, count(*) FILTER (here AND programname = 'sshd') AS baseline, count(*) FILTER (here AND programname = 'sudo') AS overlay FROM t
  UNION ALL SELECT 1, 'Scheduled', count(*) FILTER (here AND programname = 'cron' AND contains(msg, '1') AND pri % 8 >= 2), count(*) FILTER (here AND programname = 'cron' AND contains(msg, '1')) FROM t
  UNION ALL SELECT 2, 'Never', 0, 0)
"""


JOINED = """
template(name="by_segment" type="string" string="/var/log/%$.segment%.log")
ruleset(name="main") {
  set $.segment = lookup("segments", $!user);
  if $.segment == "BUILDING" then action(type="omfwd" target="sink" port="514" protocol="udp") else action(type="omfile" dynafile="by_segment")
  if lookup("segments", $!next) == $.segment then action(type="omfile" file="/same")
}
global(defaultruleset="main")
"""
PATTERNS = """
ruleset(name="main") {
  if $msg =~ $programname then action(type="omfile" file="/hit")
  set $.found = re_extract($msg, $programname, 0, 0, "none");
  set $.part = field($msg, $hostname, 2);
}
global(defaultruleset="main")
"""
ODD_JSON = """
ruleset(name="main") { action(type="mmjsonparse") set $.ok = $parsesuccess; }
global(defaultruleset="main")
"""
RULE = {
    "title": "{p_name}", "level": "{p_brand}",
    "detection": {"sel_word": {"msg|contains": ["{word}", "{p_name}"]}, "sel_pair": {"msg|i|contains|all": ["{upper}", "{p_type}"]}, "other": {"programname": "{lang}"}, "condition": "1 of sel_* and not other"},
}
_SYLLABLES = "th er on an re he in ed nd ha".split()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the fields user and next, through lookups in the table of customers."""
    table = enrich.lookup_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_mktsegment", "c_custkey", "none")
    user = lambda k: (F.col("user_id") + k).cast("string")
    rows = event_messages(spark, sf_dir).withColumn("structured", F.create_map(F.lit("user"), user(0), F.lit("next"), user(1)))
    return evaluate(rows, enrich.bound(parse_config(JOINED), segments=table))


def _dealt_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the host of their number; the first part of a host counts.  The table is dealt, as if it were large; a host is a hot key."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("host", F.concat(F.lit("host"), F.col("p_partkey") % 25))
    table = enrich.lookup_table(parts.filter("p_partkey % 25 <> 3"), "host", "p_name", "p_partkey", "none", limit=0)
    config = parse_config('ruleset(name="main") { set $.part = lookup("hosts", $hostname); }\nglobal(defaultruleset="main")')
    return evaluate(event_messages(spark, sf_dir), enrich.bound(config, hosts=table))


def _pattern_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages; a word of the text gives a pattern, every other one of them none that is valid."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = F.regexp_replace(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(3)), "[^a-zA-Z]", "")
    pattern = F.element_at(F.array(F.concat(F.lit("("), word), F.concat(F.lit("^"), word), F.concat(F.substring(word, 1, 2), F.lit(".")), F.concat(F.lit("["), word)), (F.col("doc_id") % 4 + 1).cast("int"))
    return with_properties(docs.select(F.col("doc_id").alias("idx"), F.lit("udp").alias("transport"), F.lit(514).alias("port"), F.coalesce("text", F.lit("")).alias("msg"), pattern.alias("programname"), F.lit("e").alias("hostname")))


def _odd_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that is whole, broken, followed by more, or repeats a key."""
    forms = ['{"a":"x","a":"#"}', '{"a":"#"} more', "{'a':1}", "[1]", '  {"a":1.50,"b":null,"c":{"d":[1,"q"]},"e":true,"f":1e3}', '@cee: {"a":"#"}', '{"a":"#"', '{"n":{"b":1,"b":2},"":"#"}', '{"a":"#"}]']
    pick = F.element_at(F.array(*map(F.lit, forms)), (F.col("idx") % len(forms) + 1).cast("int"))
    m = event_messages(spark, sf_dir).drop("props", "facility", "severity")
    out = evaluate(with_properties(m.withColumn("msg", F.replace(pick, F.lit("#"), F.col("hostname")))), parse_config(ODD_JSON))
    at = lambda k: F.try_element_at("fields", F.lit(k)).alias(k or "none")
    return out.select("idx", F.try_element_at("vars", F.lit("ok")).alias("ok"), *map(at, ("a", "b", "c", "e", "f", "n", "")))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, of which some have a number where a text belongs."""
    m = event_messages(spark, sf_dir)
    whole = F.to_json(F.struct("transport", "port", "programname", "hostname", F.when(F.col("event_type") != "purchase", F.col("msg")).alias("msg")))
    line = F.when(F.col("event_type") == "purchase", F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"msg":'), "user_id", F.lit("}"))).otherwise(whole)
    return with_properties(read_ndjson(m.select("idx", line.alias("value")))[0])


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of messages, written as a file for each type of event and read in the order of files and lines."""
    lines = _lines(spark, sf_dir).join(event_messages(spark, sf_dir).select("idx", "event_type"), "idx")
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    lines.repartition("event_type").sortWithinPartitions("event_type", "idx").select("value", "event_type").write.partitionBy("event_type").text(path)
    return read_ordered_lines(spark, path)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, _SYLLABLES)), (F.floor(F.col("p_partkey") / 10**k) % 10 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("p_size") % 4 + 1).cast("int"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"word": F.concat(pick(0), pick(1), pick(2)), "upper": F.upper(F.concat(pick(2), pick(1))), "lang": lang})
    return detect_index.templated_rules(parts, "p_partkey", RULE)


def _doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_properties(docs.select(F.col("doc_id").alias("idx"), F.lit("udp").alias("transport"), F.lit(514).alias("port"), F.col("text").alias("msg"), F.col("lang").alias("programname"), F.col("source").alias("hostname")))


_FIRED = f"""WITH s AS (SELECT {_SYLLABLES!r} AS s),
r AS (SELECT *, s[p_partkey % 10 + 1] || s[p_partkey // 10 % 10 + 1] || s[p_partkey // 100 % 10 + 1] AS word, s[p_partkey // 100 % 10 + 1] || s[p_partkey // 10 % 10 + 1] AS pair, ['en', 'de', 'fr', 'es'][p_size % 4 + 1] AS no FROM part, s),
h AS (SELECT p_partkey AS rule_ord, doc_id AS idx FROM r JOIN documents d ON (contains(d.text, word) OR contains(d.text, p_name) OR contains(lower(d.text), pair) AND contains(lower(d.text), lower(p_type))) AND coalesce(d.lang, '') <> no),
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "replay_per_output": (lambda s, d: replay.per_output(_evaluated(s, d), None), _routed() + "x AS (SELECT 1) SELECT kind, target, count(*) AS n FROM o GROUP BY ALL"),
    "replay_top_outputs": (lambda s, d: replay.per_output(_evaluated(s, d)), _routed() + "x AS (SELECT 1) SELECT kind, target, n FROM (SELECT kind, target, count(*) AS n, min(idx) AS i FROM o GROUP BY ALL ORDER BY n DESC, i LIMIT 10)"),
    "replay_outcomes": (lambda s, d: replay.outcomes(_evaluated(s, d)), _routed() + """
d AS (SELECT DISTINCT idx FROM o) SELECT count(*) AS total, count(*) AS processed, count(d.idx) AS delivered, count(*) FILTER (WHERE ruleset IS NULL) AS no_input_match,
  count(*) FILTER (WHERE ruleset IS NOT NULL AND d.idx IS NULL) AS no_output, CAST(0 AS BIGINT) AS errors FROM f LEFT JOIN d ON d.idx = f.idx"""),
    "replay_per_ruleset": (lambda s, d: replay.per_ruleset(_evaluated(s, d)), _routed() + "x AS (SELECT 1) SELECT ruleset, count(*) AS n FROM f WHERE ruleset IS NOT NULL GROUP BY 1"),
    "replay_top_programs": (lambda s, d: replay.top_values(event_messages(s, d), F.col("programname")), _M + """
x AS (SELECT programname AS key, count(*) AS n, min(idx) AS i FROM p GROUP BY 1) SELECT key, n, floor(n * 1000.0 / (SELECT count(*) FROM p) + 0.5) / 10 AS pct FROM x ORDER BY n DESC, i LIMIT 10"""),
    "replay_samples": (lambda s, d: replay.samples(_evaluated(s, d)), _routed() + """
b AS (SELECT CASE WHEN ruleset IS NULL THEN 'unmatched' WHEN idx NOT IN (SELECT idx FROM o) THEN 'no_output' END AS bucket, idx, programname, hostname, substr(msg, 1, 200) AS msg FROM f)
SELECT bucket, idx, programname, hostname, msg, CASE bucket WHEN 'unmatched' THEN 'no input matched' ELSE 'ruleset ran but no outputs' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY idx) AS k FROM b WHERE bucket IS NOT NULL) WHERE k <= 5"""),
    "diff_output_deltas": (lambda s, d: replay.output_deltas(_compared(s, d)), f"""
WITH a AS ({_routed()} x AS (SELECT 1) SELECT kind, target, count(*) AS n FROM o GROUP BY ALL), b AS ({_routed("8", "siem2")} x AS (SELECT 1) SELECT kind, target, count(*) AS n FROM o GROUP BY ALL)
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.target, b.target) AS target, coalesce(a.n, 0) AS baseline, coalesce(b.n, 0) AS overlay, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM a FULL JOIN b ON a.kind = b.kind AND a.target = b.target"""),
    "diff_route_changes": (lambda s, d: replay.route_changes(_compared(s, d)), _both() + "SELECT idx, a.s AS baseline, b.s AS overlay FROM a JOIN b USING (idx) WHERE a.s <> b.s"),
    "diff_route_samples": (lambda s, d: replay.route_change_samples(_compared(s, d)), _both() + """
SELECT idx, a.programname, a.hostname, substr(a.msg, 1, 200) AS msg, coalesce(a.o, '') AS baseline_outputs, coalesce(b.o, '') AS overlay_outputs FROM a JOIN b USING (idx) WHERE a.s <> b.s ORDER BY idx LIMIT 10"""),
    "diff_moves": (lambda s, d: replay.moves(_compared(s, d)), _both() + """
SELECT count(*) AS changed, count(*) FILTER (WHERE a.o IS NULL AND b.o IS NOT NULL) AS moved_to_delivered, count(*) FILTER (WHERE a.o IS NOT NULL AND b.o IS NULL) AS moved_to_unmatched FROM a JOIN b USING (idx) WHERE a.s <> b.s"""),
    "diff_ruleset_deltas": (lambda s, d: replay.ruleset_deltas(replay.compare(event_messages(s, d), parse_config(CONFIG, LOOKUPS), parse_config(CONFIG.replace('port="6601" ruleset="tcp"', 'port="6601" ruleset="main"'), LOOKUPS))), _M + """
x AS (SELECT CASE WHEN transport = 'udp' AND port = 514 THEN 'main' WHEN transport = 'tcp' AND port = 6601 THEN 'tcp' END AS r FROM p WHERE transport = 'tcp' AND port = 6601 OR transport = 'udp' AND port = 514)
SELECT ruleset, CAST(sum(a) AS BIGINT) AS baseline, CAST(sum(b) AS BIGINT) AS overlay, CAST(sum(b) - sum(a) AS BIGINT) AS delta FROM (SELECT r AS ruleset, 1 AS a, 0 AS b FROM x UNION ALL SELECT 'main', 0, 1 FROM x) GROUP BY 1"""),
    "properties_pri": (lambda s, d: event_messages(s, d).select("idx", F.col("facility").cast("long").alias("facility"), F.col("severity").cast("long").alias("severity"), F.col("props.syslogseverity-text").alias("name")), _M + """
x AS (SELECT 1) SELECT idx, CAST(pri // 8 AS BIGINT) AS facility, CAST(pri % 8 AS BIGINT) AS severity, ['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'][pri % 8 + 1] AS name FROM p"""),
    "decode_3164": (lambda s, d: read_lines(_lines(s, d)).select("idx", "format", "pri", "hostname", "programname", "procid", "syslogtag", "msg"), _M + """
x AS (SELECT 1) SELECT idx, 'rfc3164' AS format, CAST(pri AS VARCHAR) AS pri, hostname, programname, CAST(user_id AS VARCHAR) AS procid, programname || '[' || user_id || ']:' AS syslogtag, msg FROM p"""),
    "lookup_set_unset": (lambda s, d: _evaluated(s, d).select("idx", F.coalesce(F.try_element_at("vars", F.lit("team")), F.lit("")).alias("team")), _routed() + """
x AS (SELECT 1) SELECT idx, CASE WHEN ruleset IS DISTINCT FROM 'main' THEN '' WHEN sec THEN 'security' WHEN programname = 'nginx' THEN 'web' ELSE 'none' END AS team FROM f"""),
    "sigma_fires": (lambda s, d: detect.fires(event_messages(s, d), detect.parse_rules(RULES)), _M + """
x AS (SELECT count(*) FILTER (WHERE programname = 'sshd' AND (contains(msg, '1') OR contains(msg, '2'))) AS a,
  count(*) FILTER (WHERE (hostname LIKE '%3' OR hostname LIKE '%7' OR pri % 8 < 2) AND programname <> 'cron') AS b FROM p)
SELECT 0 AS rule_ord, 'Login errors' AS title, 'high' AS level, a AS n FROM x UNION ALL SELECT 1, 'Any of two', 'low', b FROM x UNION ALL SELECT 2, 'Windows only', '', 0 FROM x"""),
    "sigma_diff": (lambda s, d: detect.fires_delta(event_messages(s, d), detect.parse_rules(RULES), detect.parse_rules(RULES.replace('["1", "2"]', '["2"]').replace("other: {image: cron}", "other: {image: [cron, sudo]}"))), _M + """
h AS (SELECT programname = 'sshd' AND (contains(msg, '1') OR contains(msg, '2')) AS a, programname = 'sshd' AND contains(msg, '2') AS a2, (hostname LIKE '%3' OR hostname LIKE '%7' OR pri % 8 < 2) AND programname <> 'cron' AS b, programname <> 'sudo' AS c FROM p),
x AS (SELECT 0 AS rule_ord, 'Login errors' AS title, count(*) FILTER (WHERE a) AS baseline, count(*) FILTER (WHERE a2) AS overlay FROM h
  UNION ALL SELECT 1, 'Any of two', count(*) FILTER (WHERE b), count(*) FILTER (WHERE b AND c) FROM h UNION ALL SELECT 2, 'Windows only', 0, 0)
SELECT *, overlay - baseline AS delta, CASE WHEN baseline = 0 THEN CASE WHEN overlay = 0 THEN 0.0 ELSE 100.0 END ELSE floor((overlay - baseline) * 1000.0 / baseline + 0.5) / 10 END::DOUBLE AS pct FROM x"""),
    "legacy_selectors": (lambda s, d: replay.per_output(evaluate(event_messages(s, d), parse_config(SELECTORS, {})), None), _M + """
f AS (SELECT pri // 8 AS fac, pri % 8 AS sev FROM p), o AS (
  SELECT 'omfile' AS kind, '/var/log/kern.log' AS target FROM f WHERE fac = 0 OR fac = 2 AND sev <= 3
  UNION ALL SELECT 'omfile', '/var/log/debug.log' FROM f WHERE sev = 7
  UNION ALL SELECT 'omfwd', 'loghost:601/tcp' FROM f WHERE fac IN (4, 10) AND sev <= 4
  UNION ALL SELECT 'omfile', '/var/log/messages' FROM f WHERE sev <= 6 AND fac <> 2)
SELECT kind, target, count(*) AS n FROM o GROUP BY ALL"""),
    "decode_5424": (lambda s, d: read_lines(_wire5424(s, d)).select("idx", "format", "pri", "hostname", "programname", "procid", "msg", F.try_element_at(structured_data(F.col("sd")), F.lit("ex@1_kind")).alias("kind"), F.try_element_at(structured_data(F.col("sd")), F.lit("ex@1_q")).alias("q")), _M + """
x AS (SELECT 1) SELECT idx, 'rfc5424' AS format, CAST(pri AS VARCHAR) AS pri, hostname, programname, CAST(user_id AS VARCHAR) AS procid, msg, event_type AS kind, 'a"b' AS q FROM p"""),
    "decode_received": (lambda s, d: read_lines(_received(s, d)).select("idx", "format", "hostname", "programname", "syslogtag", "msg", F.substring("rawmsg", 1, 7).alias("head")), _M + """
x AS (SELECT 1) SELECT idx, 'received' AS format, hostname, programname, programname || ':' AS syslogtag, msg, '<13>Jan' AS head FROM p"""),
    "ndjson_messages": (lambda s, d: read_ndjson(_json_lines(s, d))[0].select("idx", "transport", F.col("port").cast("long").alias("port"), "programname", "msg"), _M + """
x AS (SELECT 1) SELECT idx, transport, CAST(CASE WHEN user_id % 2 = 0 THEN port ELSE 514 END AS BIGINT) AS port, programname, msg FROM p WHERE event_type <> 'view'"""),
    "ndjson_diagnostics": (lambda s, d: read_ndjson(_json_lines(s, d))[1].select("idx", "message"), _M + """
x AS (SELECT 1) SELECT idx, 'not a JSON object' AS message FROM p WHERE event_type = 'view'"""),
    "line_deliveries": (lambda s, d: deliveries(route_lines(_lines(s, d), parse_config(SELECTORS, {}))).groupBy("kind", "target").agg(F.count("*").alias("n"), F.countDistinct("msg").alias("texts")), _M + """
f AS (SELECT msg, pri // 8 AS fac, pri % 8 AS sev FROM p), o AS (
  SELECT 'omfile' AS kind, '/var/log/kern.log' AS target, msg FROM f WHERE fac = 0 OR fac = 2 AND sev <= 3
  UNION ALL SELECT 'omfile', '/var/log/debug.log', msg FROM f WHERE sev = 7
  UNION ALL SELECT 'omfwd', 'loghost:601/tcp', msg FROM f WHERE fac IN (4, 10) AND sev <= 4
  UNION ALL SELECT 'omfile', '/var/log/messages', msg FROM f WHERE sev <= 6 AND fac <> 2)
SELECT kind, target, count(*) AS n, count(DISTINCT msg) AS texts FROM o GROUP BY ALL"""),
    "sigma_samples": (lambda s, d: detect.fired_samples(event_messages(s, d), detect.parse_rules(RULES)), _M + """
h AS (SELECT 0 AS rule_ord, idx FROM p WHERE programname = 'sshd' AND (contains(msg, '1') OR contains(msg, '2'))
  UNION ALL SELECT 1, idx FROM p WHERE (hostname LIKE '%3' OR hostname LIKE '%7' OR pri % 8 < 2) AND programname <> 'cron')
SELECT rule_ord, idx FROM (SELECT *, row_number() OVER (PARTITION BY rule_ord ORDER BY idx) AS k FROM h) WHERE k <= 5"""),
    "retag_values": (lambda s, d: _tagged(s, d).groupBy("tag", "retagged", "lossy").agg(F.count("*").alias("n")), _M + """
x AS (SELECT CASE programname WHEN 'sshd' THEN 'linux:secure' WHEN 'sudo' THEN 'linux:messages' WHEN 'nginx' THEN 'haproxy:access' WHEN 'kernel' THEN 'pan:threat' ELSE 'other' END AS tag FROM p)
SELECT tag, CASE tag WHEN 'linux:secure' THEN 'ssh' WHEN 'linux:messages' THEN 'syslog' WHEN 'haproxy:access' THEN 'nginx' ELSE tag END AS retagged, tag IN ('pan:threat', 'other') AS lossy, count(*) AS n FROM x GROUP BY ALL"""),
    **{f"render_{name.replace('-', '_')}": (lambda s, d, t=target: _events(s, d).select("idx", siem.render(t).alias("line")), _M + "x AS (SELECT 1) SELECT idx, " + _LINES[name] + " AS line FROM p") for name, target in TARGETS.items()},
    "render_cef_header": (lambda s, d: _events(s, d).select("idx", siem.render_cef(TARGETS["arcsight-cef"], F.lit("ac|me"), F.lit("logger"), F.lit("1"), F.col("programname"), F.col("event_type"), F.col("severity") + 5).alias("line")), _M + """
x AS (SELECT 1) SELECT idx, 'CEF:0|ac\\|me|logger|1|' || programname || '|' || event_type || '|' || least(pri % 8 + 5, 10) || '|shost=' || hostname || ' app=' || programname || ' metadataLogName=' || event_type || ' customNote=' || replace(msg, '=', '\\=') AS line FROM p"""),
    "prifilt_matrix": (lambda s, d: _priorities(s, d), _M + """
q AS (SELECT DISTINCT CAST(pri // 8 AS BIGINT) AS fac, CAST(pri % 8 AS BIGINT) AS sev FROM p)
SELECT fac, sev, fac = 13 AS a, sev <= 6 AND fac <> 2 AS b, fac IN (0, 2) AND sev <> 3 AS c, sev > 4 AS d, fac IN (14, 15) AND sev = 1 OR fac = 9 AS e FROM q"""),
    "default_fallback": (lambda s, d: replay.per_ruleset(evaluate(event_messages(s, d), parse_config('global(defaultruleset="tcp")\n' + CONFIG, LOOKUPS)), None), _M + """
x AS (SELECT 1) SELECT CASE WHEN transport = 'udp' AND port = 514 THEN 'main' ELSE 'tcp' END AS ruleset, count(*) AS n FROM p GROUP BY 1"""),
    "forced_ruleset": (lambda s, d: replay.per_output(evaluate(event_messages(s, d), parse_config(CONFIG, LOOKUPS), force="tcp"), None), _M + """
x AS (SELECT 1) SELECT 'omfile' AS kind, '/var/log/short.log' AS target, count(*) AS n FROM p WHERE pri // 8 < 16 AND regexp_matches(msg, 'value=[0-9]$')"""),
    "set_unset_state": (lambda s, d: evaluate(event_messages(s, d), parse_config(STATE)).select("idx", F.try_element_at("vars", F.lit("a")).alias("a"), F.try_element_at("vars", F.lit("b")).alias("b"), F.try_element_at("fields", F.lit("n")).alias("n")), _M + """
x AS (SELECT idx, CASE WHEN hostname = 'host1' THEN NULL ELSE programname || '!' END AS a, pri // 8 < 4 AS low, msg FROM p)
SELECT idx, a, coalesce(a, '') || '?' AS b, CASE WHEN NOT low THEN msg END AS n FROM x"""),
    "json_parse_merge": (lambda s, d: evaluate(_json_bodies(s, d), parse_config(JSON_ROUTES)).select("idx", F.try_element_at("fields", F.lit("k")).alias("k"), F.try_element_at("vars", F.lit("ok")).alias("ok"), F.col("outputs")[0]["path"].alias("path")), _M + """
x AS (SELECT idx, event_type, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract_string(body, '$.k') AS VARCHAR) END AS k FROM p)
SELECT idx, k, CASE WHEN k IS NULL THEN 'FAIL' ELSE 'OK' END AS ok, '/var/log/k' || coalesce(k, '') || '.log' AS path FROM x"""),
    "structured_routes": (lambda s, d: replay.per_output(evaluate(with_properties(read_lines(_structured(s, d))), parse_config(STRUCTURED)), None), _M + """
x AS (SELECT 1) SELECT 'omfile' AS kind, '/var/log/' || event_type || '-' || hostname || '.log' AS target, count(*) AS n FROM p WHERE event_type IN ('click', 'error') GROUP BY ALL"""),
    "decode_variants": (lambda s, d: read_lines(_variants(s, d)).select("idx", "format", "hostname", "programname", "procid", "msgid", "syslogtag", "msg"), _M + """
x AS (SELECT *, CAST(idx % 6 AS INT) AS k, programname AS g FROM p) SELECT idx, ['rfc3164', 'rfc3164', 'received', 'received', 'rfc5424', 'unknown'][k + 1] AS format, CASE WHEN k < 5 THEN hostname END AS hostname,
  CASE WHEN k IN (0, 2, 3, 4) THEN g END AS programname, CASE WHEN k IN (0, 4) THEN '7' END AS procid, CASE WHEN k = 4 THEN 'ID9' END AS msgid,
  CASE k WHEN 0 THEN g || '[7]:' WHEN 2 THEN g || ':' WHEN 3 THEN g || ' 1.4:' WHEN 4 THEN g || '[7]:' END AS syslogtag, CASE WHEN k = 1 THEN 'no tag here' ELSE msg END AS msg FROM x"""),
    "replay_top_hostnames": (lambda s, d: replay.top_values(event_messages(s, d), F.col("hostname")), _M + """
x AS (SELECT hostname AS key, count(*) AS n, min(idx) AS i FROM p GROUP BY 1) SELECT key, n, floor(n * 1000.0 / (SELECT count(*) FROM p) + 0.5) / 10 AS pct FROM x ORDER BY n DESC, i LIMIT 10"""),
    "tree_per_output": (lambda s, d: replay.per_output(evaluate(event_messages(s, d), _tree()[0]), None), _routed() + "x AS (SELECT 1) SELECT kind, target, count(*) AS n FROM o GROUP BY ALL"),
    "tree_overlay_deltas": (lambda s, d: replay.output_deltas(replay.compare(event_messages(s, d), _tree()[0], _tree({"/etc/rules.d/20-rest.conf": 'ruleset(name="audit") { stop }'})[0])), _routed() + """
x AS (SELECT kind, target, count(*) AS baseline, count(*) FILTER (k < 4) AS overlay FROM o GROUP BY ALL)
SELECT kind, target, baseline, overlay, overlay - baseline AS delta FROM x"""),
    "tree_findings": (lambda s, d: tree_findings(s, load_tree(_nation_files(s, d), "/etc/router.conf")[1]).select("code", "severity", "name"), """
SELECT 'W_INCLUDE_MISSING' AS code, 'warning' AS severity, n_name || '.conf' AS name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'I_INCLUDE_EMPTY_GLOB', 'info', 'r' || r_regionkey || '/*.conf' FROM region WHERE r_regionkey < 2"""),
    "prefixed_actions": (lambda s, d: replay.per_output(evaluate(event_messages(s, d), parse_config(PREFIXED)), None), _M + """
x AS (SELECT 'omfile' AS kind, '/var/log/kern.log' AS target FROM p WHERE pri // 8 = 0 UNION ALL SELECT 'omfile', '/var/log/debug.log' FROM p WHERE pri % 8 = 7)
SELECT kind, target, count(*) AS n FROM x GROUP BY ALL"""),
    "line_arrays": (lambda s, d: read_line_array(_line_arrays(s, d))[0].withColumn("row", F.col("row").cast("long")), _M + """
x AS (SELECT 1) SELECT idx, CAST(3 AS BIGINT) AS "row", msg AS value FROM p WHERE event_type <> 'view' UNION ALL SELECT idx, 4, programname FROM p WHERE event_type <> 'view'"""),
    "line_array_diagnostics": (lambda s, d: read_line_array(_line_arrays(s, d))[1].withColumn("row", F.col("row").cast("long")), _M + """
x AS (SELECT 1) SELECT idx, k AS "row", 'not a string' AS message FROM p, (VALUES (CAST(1 AS BIGINT)), (2)) AS t(k) WHERE event_type <> 'view'"""),
    "config_test_checks": (lambda s, d: _checks(s, d).groupBy("name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")), _routed() + _ASKED + """
x AS (SELECT unnest(['ruleset', 'dropped', 'outputsContains', 'localVars.team']) AS name, unnest([a, b, c, d]) AS passed FROM w UNION ALL SELECT 'message', false)
SELECT name, count(*) AS n, count(*) FILTER (passed) AS passed FROM x GROUP BY 1"""),
    "config_test_results": (lambda s, d: expect.results(_checks(s, d)).select("test", "passed", F.concat_ws(",", "failures").alias("failures")), _routed() + _ASKED + """
x AS (SELECT 1) SELECT 't' || idx AS test, a AND b AND c AND d AS passed,
  concat_ws(',', CASE WHEN NOT b THEN 'dropped' END, CASE WHEN NOT d THEN 'localVars.team' END, CASE WHEN idx < 0 THEN 'message' END, CASE WHEN NOT c THEN 'outputsContains' END, CASE WHEN NOT a THEN 'ruleset' END) AS failures FROM w"""),
    "config_test_summary": (lambda s, d: expect.summary(expect.results(_checks(s, d))), _routed() + _ASKED + """
x AS (SELECT a AND b AND c AND d AS passed FROM w) SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM x"""),
    "routed_fire_deltas": (_tag_deltas, _M + _TAGGED + """
SELECT *, overlay - baseline AS delta, CASE WHEN baseline = 0 THEN CASE WHEN overlay = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE floor(CAST((overlay - baseline) * 1000 AS DOUBLE) / baseline + 0.5) / 10 END AS pct FROM r"""),
    "regression_gate": (lambda s, d: detect.regression_gate(_tag_deltas(s, d)), _M + _TAGGED + "SELECT count(*) FILTER (overlay < baseline) AS regressions, count(*) FILTER (overlay < baseline) = 0 AS passed FROM r"),
    "route_gate": (lambda s, d: replay.route_gate(_compared(s, d), most_pct=0.0), _both() + """
SELECT count(*) FILTER (a.s <> b.s) AS changed, count(*) AS processed, count(*) FILTER (a.s <> b.s) * 100.0::DOUBLE / count(*) AS pct, count(*) FILTER (a.s <> b.s) = 0 AS passed FROM a JOIN b USING (idx)"""),
    "lookup_join_broadcast": (lambda s, d: replay.per_output(_segments(s, d), None), _M + """
s AS (SELECT p.*, coalesce(a.c_mktsegment, 'none') AS seg, coalesce(b.c_mktsegment, 'none') AS nxt FROM p LEFT JOIN customer a ON a.c_custkey = user_id LEFT JOIN customer b ON b.c_custkey = user_id + 1),
o AS (SELECT CASE seg WHEN 'BUILDING' THEN 'omfwd' ELSE 'omfile' END AS kind, CASE seg WHEN 'BUILDING' THEN 'sink:514/udp' ELSE '/var/log/' || seg || '.log' END AS target FROM s UNION ALL SELECT 'omfile', '/same' FROM s WHERE seg = nxt)
SELECT kind, target, count(*) AS n FROM o GROUP BY ALL"""),
    "lookup_join_dealt": (lambda s, d: _dealt_hosts(s, d).select("idx", "hostname", F.try_element_at("vars", F.lit("part")).alias("part")), _M + """
t AS (SELECT 'host' || (p_partkey % 25) AS host, arg_min(p_name, p_partkey) AS part FROM part WHERE p_partkey % 25 <> 3 GROUP BY 1) SELECT idx, hostname, coalesce(t.part, 'none') AS part FROM p LEFT JOIN t ON host = hostname"""),
    "dynamic_patterns": (lambda s, d: evaluate(_pattern_messages(s, d), parse_config(PATTERNS)).select("idx", (F.size("outputs") > 0).alias("hit"), F.try_element_at("vars", F.lit("found")).alias("found"), F.try_element_at("vars", F.lit("part")).alias("part")), """
WITH w AS (SELECT doc_id AS idx, coalesce(text, '') AS msg, doc_id % 4 AS k, regexp_replace(split_part(coalesce(text, ''), ' ', 3), '[^a-zA-Z]', '', 'g') AS w FROM documents)
SELECT idx, CASE k WHEN 1 THEN starts_with(msg, w) WHEN 2 THEN regexp_matches(msg, substr(w, 1, 2) || '.') ELSE false END AS hit,
  CASE WHEN k = 1 AND starts_with(msg, w) THEN w WHEN k = 2 AND regexp_matches(msg, substr(w, 1, 2) || '.') THEN regexp_extract(msg, substr(w, 1, 2) || '.') ELSE 'none' END AS found, split_part(msg, 'e', 2) AS part FROM w"""),
    "json_parse_odd": (_odd_json, _M + """
x AS (SELECT idx, idx % 9 AS k, hostname AS h FROM p)
SELECT idx, CASE WHEN k IN (0, 4, 5, 7) THEN 'OK' ELSE 'FAIL' END AS ok, CASE WHEN k IN (0, 5) THEN h WHEN k = 4 THEN '1.5' END AS a, CASE WHEN k = 4 THEN '' END AS b, CASE WHEN k = 4 THEN '{"d":[1,"q"]}' END AS c, CASE WHEN k = 4 THEN 'true' END AS e, CASE WHEN k = 4 THEN '1000' END AS f,
  CASE WHEN k = 7 THEN '{"b":2}' END AS n, CASE WHEN k = 7 THEN h END AS "none" FROM x"""),
    "replay_errors": (lambda s, d: replay.outcomes(evaluate(_faulty(s, d), parse_config(CONFIG, LOOKUPS))), _M + """
x AS (SELECT event_type = 'purchase' AS bad, CASE WHEN transport = 'udp' AND port = 514 THEN 1 WHEN transport = 'tcp' AND port = 6601 THEN 2 ELSE 0 END AS r, regexp_matches(msg, 'value=[0-9]$') AS short FROM p)
SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (NOT bad AND (r = 1 OR r = 2 AND short)) AS delivered, count(*) FILTER (NOT bad AND r = 0) AS no_input_match, count(*) FILTER (NOT bad AND r = 2 AND NOT short) AS no_output, count(*) FILTER (bad) AS errors FROM x"""),
    "replay_error_samples": (lambda s, d: replay.samples(evaluate(_faulty(s, d), parse_config(CONFIG, LOOKUPS))).filter("bucket = 'error'"), _M + """
x AS (SELECT 1) SELECT 'error' AS bucket, idx, programname, hostname, CAST(NULL AS VARCHAR) AS msg, 'msg is not a string' AS reason FROM p WHERE event_type = 'purchase' ORDER BY idx LIMIT 5"""),
    "diff_errors": (lambda s, d: replay.route_changes(replay.compare(_faulty(s, d), parse_config(CONFIG, LOOKUPS), parse_config(OVERLAY.replace('"siem2"', '"siem"').replace('file="/var/log/short.log"', 'file="/short"'), LOOKUPS))).filter("baseline LIKE '%short%' OR baseline = 'error'"), _M + """
x AS (SELECT 1) SELECT idx, 'rs=tcp|omfile:/var/log/short.log' AS baseline, 'rs=tcp|omfile:/short' AS overlay FROM p WHERE transport = 'tcp' AND port = 6601 AND event_type <> 'purchase' AND regexp_matches(msg, 'value=[0-9]$')"""),
    "replay_capped": (lambda s, d: replay.top_values(first_messages(read_lines(_ordered(s, d)), 5000), F.col("programname"), None), _M + """
o AS (SELECT programname, row_number() OVER (ORDER BY event_type, idx) AS idx FROM p), c AS (SELECT * FROM o WHERE idx <= 5000)
SELECT programname AS key, count(*) AS n, floor(count(*) * 1000.0 / (SELECT count(*) FROM c) + 0.5) / 10 AS pct FROM c GROUP BY 1"""),
    "ordered_lines": (lambda s, d: read_lines(_ordered(s, d)).select("idx", "hostname", "msg"), _M + "x AS (SELECT 1) SELECT row_number() OVER (ORDER BY event_type, idx) AS idx, hostname, msg FROM p"),
    "indexed_fires": (lambda s, d: detect_index.indexed_fires(_doc_messages(s, d), _rules(s, d)), _FIRED + """
n AS (SELECT rule_ord, count(*) AS n FROM h GROUP BY 1) SELECT p_partkey AS rule_ord, p_name AS title, p_brand AS level, coalesce(n.n, 0) AS n FROM part LEFT JOIN n ON n.rule_ord = p_partkey"""),
    "indexed_samples": (lambda s, d: detect_index.indexed_samples(_doc_messages(s, d), _rules(s, d)), _FIRED + """
x AS (SELECT 1) SELECT rule_ord, idx FROM h QUALIFY row_number() OVER (PARTITION BY rule_ord ORDER BY idx) <= 5"""),
    **table_queries.QUERIES,
    "trace_events": (lambda s, d: replay.trace_events(evaluate(event_messages(s, d), parse_config(TAGGING), trace=True)).withColumn("step", F.col("step").cast("long")), _M + """
t AS (SELECT *, programname = 'sshd' AS ssh, pri % 8 < 2 AS low FROM p WHERE transport = 'udp' AND port = 514),
e AS (SELECT idx, unnest(CASE WHEN ssh THEN [0, 1, 2, 3, 4, 5] WHEN low THEN [0, 1, 2, 6, 7, 8, 9, 10] ELSE [0, 1, 2, 6, 7] END) AS k, ssh, low, programname FROM t)
SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY k) AS step,
  ['input_selected', 'ruleset_entered', 'condition_eval', 'set', 'action', 'stop', 'set', 'condition_eval', 'call', 'unset', 'action'][k + 1] AS type,
  CASE k WHEN 0 THEN 'tag' WHEN 1 THEN 'tag' WHEN 2 THEN CAST(ssh AS VARCHAR) WHEN 3 THEN '$!sourcetype=secure' WHEN 4 THEN 'omfile /a' WHEN 5 THEN '' WHEN 6 THEN '$!sourcetype=' || programname
    WHEN 7 THEN CAST(low AS VARCHAR) WHEN 8 THEN 'late' WHEN 9 THEN '$!sourcetype' ELSE 'omfile /late' END AS message FROM e"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items()}
