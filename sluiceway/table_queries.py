"""Queries over catalogs, graphs, trees, names and tags that Spark derives from the given tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.functions.distance import alignment_distance
from sluiceway.operators import catalog, graph, siem, tags, trees
from sluiceway.sources.streams import reassembled

Query = tuple[Callable[[SparkSession, str], DataFrame], str]

#: Bytes of a segment of the streams made from events.
SEGMENT = 64

#: Views over the tables, in SQL of both engines: the catalogs of 25 configurations.
VIEWS = {
    "defined": """
SELECT config, kind, name, bool_or(size > 20) AS reached, bool_or(size > 9) AS loaded FROM (
  SELECT concat('n', CAST(p_partkey % 25 AS STRING)) AS config, CASE WHEN p_size % 4 < 2 THEN 'ruleset' WHEN p_size % 4 = 2 THEN 'template' ELSE 'lookup' END AS kind,
    concat(replace(p_name, ' ', '_'), CASE p_size % 3 WHEN 0 THEN '' ELSE CAST(p_size AS STRING) END) AS name, p_size AS size FROM part) GROUP BY config, kind, name""",
    "uses": """
SELECT DISTINCT concat('n', CAST(l_suppkey % 25 AS STRING)) AS config, CASE l_returnflag WHEN 'A' THEN 'ruleset' WHEN 'N' THEN 'template' ELSE 'lookup' END AS kind,
  CASE WHEN l_linenumber = 1 THEN '<input>' WHEN l_linenumber = 2 THEN '<default>' ELSE concat('rs', CAST(l_linenumber AS STRING)) END AS src,
  CASE l_linenumber WHEN 3 THEN concat(substr(p_name, 2, 1), substr(p_name, 1, 1), replace(substr(p_name, 3), ' ', '_')) WHEN 4 THEN upper(replace(p_name, ' ', '')) WHEN 5 THEN reverse(p_name) ELSE replace(p_name, ' ', '_') END AS name
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "inputs": "SELECT concat('n', CAST(s_nationkey AS STRING)) AS config, CASE s_suppkey % 4 WHEN 0 THEN 'imudp' WHEN 1 THEN 'imtcp' WHEN 2 THEN 'imfile' ELSE 'own' END AS type FROM supplier",
    "modules": "SELECT DISTINCT concat('n', CAST(c_nationkey AS STRING)) AS config, CASE c_custkey % 5 WHEN 0 THEN 'imudp' WHEN 1 THEN 'imtcp' WHEN 2 THEN 'omkafka' WHEN 3 THEN 'omelasticsearch' ELSE 'imfile' END AS name FROM customer WHERE c_acctbal < 500",
    "actions": """
SELECT concat('n', CAST(k % 25 AS STRING)) AS config, CAST(ord AS INT) AS ord, driver,
  CASE WHEN driver = 'omfile' AND x < 2 THEN concat('/log/', CAST(k % 40 AS STRING)) END AS file, CASE WHEN driver = 'omfile' AND x = 2 THEN 'shape' END AS dynafile,
  CASE WHEN driver = 'omfwd' THEN concat('h', CAST(k % 10 AS STRING)) END AS target, CASE WHEN driver = 'omfwd' AND x = 0 THEN '514' END AS port, CASE WHEN driver = 'omfwd' AND x < 2 THEN 'tcp' END AS protocol,
  CASE WHEN driver = 'splunk' AND x = 0 THEN 's' END AS sourcetype, CASE WHEN driver = 'omelasticsearch' AND x = 0 THEN 'd' END AS dataset, CASE WHEN driver = 'datadog' AND x < 2 THEN 'v' END AS service, CASE WHEN driver = 'sumologic' AND x = 1 THEN 'c' END AS category,
  CASE WHEN driver = 'loki' AND x > 0 THEN CASE x WHEN 1 THEN 'job=a, who=$!user' ELSE 'job=b' END END AS labels, CASE WHEN driver = 'gelf' THEN CASE x WHEN 0 THEN '_ok=1' WHEN 1 THEN '_ok=1,bad=2' ELSE 'host=x,worse=1' END END AS fields,
  CASE WHEN driver = 'sentinel' THEN CASE x WHEN 0 THEN 'Syslog' WHEN 1 THEN '1bad' ELSE 'Mine_CL' END END AS "table", CASE WHEN driver = 'chronicle' AND x < 2 THEN CASE x WHEN 0 THEN 'ODD' ELSE 'GENERIC_EVENT' END END AS event_type,
  CASE WHEN driver = 'leef' AND x < 2 THEN 'v' END AS vendor, CASE WHEN driver = 'leef' AND x = 0 THEN 'p' END AS product, CASE WHEN driver = 'leef' AND x = 0 THEN '1' END AS version, CASE WHEN driver = 'leef' AND x = 0 THEN 'e' END AS eventid,
  CASE WHEN driver = 'cef' THEN CASE x WHEN 0 THEN '11' WHEN 1 THEN 'high' ELSE '5' END END AS severity
FROM (SELECT o_orderkey AS ord, o_custkey AS k, o_custkey % 3 AS x,
  CASE o_orderkey % 13 WHEN 0 THEN 'omfile' WHEN 1 THEN 'omfwd' WHEN 2 THEN 'splunk' WHEN 3 THEN 'omelasticsearch' WHEN 4 THEN 'datadog' WHEN 5 THEN 'sumologic' WHEN 6 THEN 'loki' WHEN 7 THEN 'gelf' WHEN 8 THEN 'sentinel'
    WHEN 9 THEN 'chronicle' WHEN 10 THEN 'leef' WHEN 11 THEN 'cef' ELSE 'omkafka' END AS driver FROM orders) o""",
    "sets": """
SELECT concat('n', CAST(s_nationkey AS STRING)) AS config, CAST(s_suppkey AS INT) AS ord, '$!' AS space, CASE s_suppkey % 5 WHEN 0 THEN 'sourcetype' WHEN 1 THEN 'event_type' WHEN 2 THEN 'ddsource' WHEN 3 THEN 'Service' ELSE 'other' END AS name,
  CASE WHEN s_acctbal > 1000 THEN concat('t', CAST(s_suppkey % 2 AS STRING)) END AS lookup FROM supplier""",
    "statements": """
SELECT concat('n', CAST(l_suppkey % 25 AS STRING)) AS config, replace(p_name, ' ', '_') AS ruleset, l_orderkey * 8 + l_linenumber AS id, CAST(NULL AS BIGINT) AS parent, 'body' AS branch, max(l_partkey) AS ord, CASE max(l_returnflag) WHEN 'A' THEN 'Action' WHEN 'N' THEN 'Set' ELSE 'Stop' END AS kind
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY config, ruleset, id""",
    # A line of an order hangs below the line of half its number: a then branch if it is even, an else branch if it is odd.
    "nested": """
SELECT concat('c', CAST(l.o % 100 AS STRING)) AS config, concat('r', CAST(l.o AS STRING)) AS ruleset, l.o * 8 + l.n AS id, CASE WHEN p.n IS NOT NULL THEN p.o * 8 + p.n END AS parent,
  CASE WHEN p.n IS NULL THEN 'body' WHEN l.n % 2 = 0 THEN 'then' ELSE 'else' END AS branch, l.n AS ord,
  CASE WHEN EXISTS (SELECT 1 FROM x q WHERE q.o = l.o AND q.h = l.n) THEN 'If' WHEN l.f = 'A' THEN 'Action' WHEN l.f = 'N' THEN 'Set' ELSE 'Call' END AS kind
FROM x l LEFT JOIN x p ON p.o = l.o AND p.n = l.h""",
    # A user's events as one stream: a third by octet count, the others by line; fin is where a message ends.
    "wire": """
SELECT user_id, text, framed, sum(length(framed)) OVER (PARTITION BY user_id ORDER BY event_id) AS fin FROM (
  SELECT user_id, event_id, text, CASE WHEN event_id % 3 = 0 THEN concat(CAST(length(text) AS STRING), ' ', text) ELSE concat(text, chr(10)) END AS framed
  FROM (SELECT user_id, event_id, concat('<', CAST(event_id % 192 AS STRING), '>', coalesce(event_type, ''), ' ', coalesce(props, '')) AS text FROM events WHERE user_id IS NOT NULL) e) e""",
    "edges": """
SELECT l_linestatus AS graph, CASE l_returnflag WHEN 'A' THEN concat('o', CAST(l_orderkey AS STRING)) WHEN 'R' THEN concat('p', CAST(l_partkey AS STRING)) ELSE concat('s', CAST(l_suppkey AS STRING)) END AS src,
  CASE l_returnflag WHEN 'A' THEN concat('p', CAST(l_partkey AS STRING)) WHEN 'R' THEN concat('s', CAST(l_suppkey AS STRING)) ELSE concat('o', CAST(l_orderkey AS STRING)) END AS dst FROM lineitem""",
    "seeds": "SELECT graph, concat('o', CAST(o_orderkey AS STRING)) AS node FROM orders JOIN (SELECT DISTINCT l_linestatus AS graph FROM lineitem) g ON o_orderstatus = graph WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000",
    # Orders feed customers, customers their nations, nations one another in a ring.
    "feeds": """
SELECT 'all' AS graph, concat('o', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst FROM orders UNION ALL SELECT 'all', concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM customer
  UNION ALL SELECT 'all', concat('n', CAST(n_nationkey AS STRING)), concat('n', CAST((n_nationkey + 1) % 5 AS STRING)) FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'all', concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation""",
    "tags": "SELECT event_id, concat(event_type, '.host', CAST(user_id % 50 AS STRING), '.', CAST(CAST(floor(value) AS INT) % 20 AS STRING)) AS tag FROM events",
    "patterns": """
SELECT p_partkey AS ord, p_brand AS route, CASE p_size % 8 WHEN 0 THEN concat('click.host', CAST(p_size AS STRING), '*') WHEN 1 THEN concat('error.host', CAST(p_size AS STRING), '.', CAST(p_partkey % 20 AS STRING)) WHEN 2 THEN concat('view.host', CAST(p_size AS STRING), '.**') WHEN 3 THEN concat('purchase.host', CAST(p_size AS STRING), '.*')
  WHEN 4 THEN concat('click.*', CAST(p_size AS STRING)) WHEN 5 THEN concat('signup.host', CAST(p_size AS STRING), '.**') WHEN 6 THEN 'error.host1.**' ELSE concat('vi', CAST(p_partkey AS STRING), '*') END AS pattern FROM part WHERE p_size < 48 UNION ALL SELECT -1, 'all', '*'""",
    "words": "SELECT DISTINCT 'all' AS config, 'part' AS kind, CASE p_partkey % 4 WHEN 0 THEN concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3)) WHEN 1 THEN concat(substr(p_name, 1, 2), substr(p_name, 4), 'x') WHEN 2 THEN reverse(p_name) ELSE upper(p_name) END AS name FROM part",
    "names": "SELECT DISTINCT 'all' AS config, 'part' AS kind, p_name AS name FROM part",
    "entries": """
SELECT CASE p_size % 3 WHEN 0 THEN 'types' WHEN 1 THEN 'categories' ELSE 'teams' END AS "table", CAST(p_partkey AS STRING) AS key, CASE p_size % 6 WHEN 0 THEN 'linux:secure' WHEN 1 THEN 'authentication' WHEN 2 THEN 'security' WHEN 3 THEN 'odd' WHEN 4 THEN 'web' ELSE p_name END AS value FROM part""",
    # Lines of documents stand for those of configuration files.
    "files": "SELECT doc_id, text FROM documents",
}
_SOURCES = ("part", "lineitem", "supplier", "customer", "orders", "nation", "events", "documents")
_LINES = "SELECT l_orderkey AS o, l_linenumber AS n, CAST(floor(l_linenumber / 2) AS INT) AS h, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2, 3"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "nested":
        return _nested(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    text = VIEWS[name].replace('"table"', "`table`")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES if t in text}
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} {t}", text)
    return spark.sql(text, **tables)


def _nested(lineitem: DataFrame) -> DataFrame:
    """The view of that name, in one shuffle by order in place of joins of the lines with themselves: a line meets its parent, and what hangs below it, under their common number."""
    kind = "CASE max(f) WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
    lines = lineitem.selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_returnflag AS f").repartition("o").groupBy("o", "n").agg(F.expr(kind).alias("kind"))
    half = "CAST(floor(n / 2) AS INT)"
    ends = lines.selectExpr("o", "n", "kind", f"inline(array(struct(n AS at, true AS own), struct({half} AS at, false AS own)))")
    at = Window.partitionBy("o", "at")
    met = ends.select("o", "n", "kind", "own", F.max("own").over(at).alias("above"), F.min("own").over(at).alias("alone"), F.expr("o IS NOT NULL AND at IS NOT NULL").alias("known"))
    ends = met.groupBy("o", "n").agg(F.max("kind").alias("kind"), F.bool_or(F.expr("known AND NOT own AND above")).alias("hung"), F.bool_or(F.expr("known AND own AND NOT alone")).alias("inner"))
    return ends.selectExpr(
        "concat('c', CAST(o % 100 AS STRING)) AS config", "concat('r', CAST(o AS STRING)) AS ruleset", "o * 8 + n AS id", f"CASE WHEN hung THEN o * 8 + {half} END AS parent",
        "CASE WHEN NOT hung THEN 'body' WHEN n % 2 = 0 THEN 'then' ELSE 'else' END AS branch", "n AS ord", "CASE WHEN inner THEN 'If' WHEN kind = 1 THEN 'Action' WHEN kind = 2 THEN 'Set' ELSE 'Call' END AS kind",
    )


def _with(*names: str) -> str:
    """The views, for DuckDB."""
    return "WITH RECURSIVE " + ", ".join(([f"x AS ({_LINES})"] if "nested" in names else []) + [f"{n} AS ({VIEWS[n]})" for n in names]) + ",\n"


_PARAMS = "file dynafile target port protocol sourcetype dataset service category labels fields table event_type vendor product version eventid severity".split()


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalogs as catalog.RELATIONS has them."""
    rel = {k: view(spark, sf_dir, k) for k in ("uses", "defined", "inputs", "modules", "actions", "sets", "statements")}
    pairs = F.filter(F.array(*(F.struct(F.lit("eventID" if p == "eventid" else p).alias("key"), F.col(f"`{p}`").alias("value")) for p in _PARAMS)), lambda e: e["value"].isNotNull())
    rel["actions"] = rel["actions"].select("config", "ord", "driver", F.map_from_entries(pairs).alias("params"))
    return rel


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = relations(spark, sf_dir)
    return catalog.general_findings(rel).unionByName(catalog.store_findings(rel))


_GENERAL = _with("defined", "uses", "inputs", "modules", "actions", "sets", "statements") + """
lost AS (SELECT u.* FROM uses u ANTI JOIN defined d USING (config, kind, name)),
place AS (SELECT config, driver, CASE WHEN driver = 'omfile' THEN coalesce('dyna(' || dynafile || ')', file) WHEN driver = 'omfwd' THEN target || ':' || coalesce(port, '?') || '/' || coalesce(protocol, '?') END AS name FROM actions),
tails AS (SELECT config, ruleset AS name, arg_max(kind, ord * 1000000000 + id) AS kind FROM statements GROUP BY 1, 2),
general AS (
  SELECT config, CASE WHEN src = '<default>' THEN 'V_UNDEFINED_DEFAULT_RULESET' ELSE 'V_UNDEFINED_' || upper(kind) END AS code, 'warning' AS severity, name FROM lost
  UNION ALL SELECT config, 'V_RSYSLOG_TEMPLATE_UNDEFINED', 'error', name FROM lost WHERE kind = 'template' AND src NOT LIKE '<%'
  UNION ALL SELECT config, 'V_RSYSLOG_DEFAULT_RULESET_UNDEFINED', 'error', name FROM lost WHERE src = '<default>'
  UNION ALL SELECT config, 'V_DEAD_RULESET', 'info', name FROM defined WHERE kind = 'ruleset' AND NOT reached
  UNION ALL SELECT d.config, 'V_UNUSED_' || upper(d.kind), 'info', d.name FROM defined d ANTI JOIN uses u USING (config, kind, name) WHERE d.kind <> 'ruleset'
  UNION ALL SELECT config, 'V_LOOKUP_NOT_LOADED', 'warning', name FROM defined WHERE kind = 'lookup' AND NOT loaded
  UNION ALL SELECT d.config, 'V_SILENT_DROP', 'warning', d.name FROM defined d LEFT JOIN tails t ON t.config = d.config AND t.name = d.name WHERE d.kind = 'ruleset' AND coalesce(t.kind, 'Set') = 'Set'
    AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.config = d.config AND u.name = d.name AND u.kind = 'ruleset' AND u.src NOT LIKE '<%')
  UNION ALL SELECT config, 'V_CONFLICTING_OUTPUT', 'info', name FROM place WHERE name IS NOT NULL GROUP BY config, driver, name HAVING count(*) > 1
  UNION ALL SELECT config, 'V_MODULE_MISSING', 'error', name FROM (SELECT DISTINCT config, type AS name FROM inputs WHERE type LIKE 'im%' UNION SELECT config, driver FROM actions WHERE driver IN ('omkafka', 'omelasticsearch')) n ANTI JOIN modules m USING (config, name)),
up AS (SELECT config, list(DISTINCT lower(name)) AS up FROM sets GROUP BY 1),
a AS (SELECT actions.*, coalesce(up, []) AS up FROM actions LEFT JOIN up USING (config)),
stores AS (
  SELECT config, 'SIEM_SPLUNK_MISSING_SOURCETYPE' AS code, 'warning' AS severity, driver AS name, ord FROM a WHERE driver = 'splunk' AND sourcetype IS NULL AND NOT list_contains(up, 'sourcetype')
  UNION ALL SELECT config, 'SIEM_ECS_MISSING_EVENT_DATASET', 'info', driver, ord FROM a WHERE driver = 'omelasticsearch' AND dataset IS NULL
  UNION ALL SELECT config, 'SIEM_DATADOG_MISSING_SERVICE', 'warning', driver, ord FROM a WHERE driver = 'datadog' AND service IS NULL AND NOT list_contains(up, 'service')
  UNION ALL SELECT config, 'SIEM_SUMO_MISSING_SOURCE_CATEGORY', 'warning', driver, ord FROM a WHERE driver = 'sumologic' AND category IS NULL
  UNION ALL SELECT config, 'SIEM_LOKI_HIGH_CARDINALITY_LABEL', 'warning', driver, ord FROM a WHERE driver = 'loki' AND contains(labels, '$!user') UNION ALL SELECT config, 'SIEM_LOKI_NO_LABELS', 'info', driver, ord FROM a WHERE driver = 'loki' AND labels IS NULL
  UNION ALL SELECT config, 'SIEM_GELF_CUSTOM_FIELD_PREFIX', 'warning', driver, ord FROM a WHERE driver = 'gelf' AND (contains(fields, 'bad') OR contains(fields, 'worse'))
  UNION ALL SELECT config, 'SIEM_SENTINEL_INVALID_TABLE_NAME', 'error', driver, ord FROM a WHERE "table" = '1bad' UNION ALL SELECT config, 'SIEM_UDM_UNKNOWN_EVENT_TYPE', 'warning', driver, ord FROM a WHERE event_type = 'ODD'
  UNION ALL SELECT config, 'SIEM_LEEF_HEADER_INCOMPLETE', 'info', driver, ord FROM a WHERE driver = 'leef' AND product IS NULL UNION ALL SELECT config, 'SIEM_CEF_SEVERITY_OUT_OF_RANGE', 'warning', driver, ord FROM a WHERE severity IN ('11', 'high')),
"""
_KINDS = """
x AS (SELECT config, kind FROM defined UNION ALL SELECT config, 'inputs' FROM inputs UNION ALL SELECT config, 'modules' FROM modules UNION ALL SELECT config, 'actions' FROM actions UNION ALL SELECT config, 'sets' FROM sets)
SELECT config, kind, count(*) AS n FROM x GROUP BY 1, 2"""
_TREE = _with("nested") + """
d AS (SELECT config, id, 0 AS depth FROM nested WHERE parent IS NULL UNION ALL SELECT n.config, n.id, d.depth + 1 FROM nested n JOIN d ON d.config = n.config AND d.id = n.parent),
way AS (SELECT config, id, id AS top FROM nested UNION ALL SELECT w.config, w.id, n.parent FROM way w JOIN nested n ON n.config = w.config AND n.id = w.top WHERE n.parent IS NOT NULL),
key AS (SELECT w.config, w.id, string_agg(CASE n.branch WHEN 'else' THEN '1' ELSE '0' END || lpad(CAST(n.ord AS VARCHAR), 3, '0'), '' ORDER BY d.depth) AS k FROM way w JOIN nested n ON n.config = w.config AND n.id = w.top JOIN d ON d.config = n.config AND d.id = n.id GROUP BY 1, 2),
size AS (SELECT config, top AS id, count(*) AS size FROM way GROUP BY 1, 2),
tail AS (SELECT *, row_number() OVER (PARTITION BY config, parent, branch ORDER BY ord DESC, id DESC) AS t FROM nested WHERE parent IS NOT NULL),
fails AS (SELECT config, id, parent FROM nested n WHERE kind = 'Set' OR kind = 'If' AND (SELECT count(DISTINCT branch) FROM nested q WHERE q.config = n.config AND q.parent = n.id) < 2
  UNION SELECT n.config, n.id, n.parent FROM fails f JOIN tail t ON t.config = f.config AND t.id = f.id AND t.t = 1 JOIN nested n ON n.config = t.config AND n.id = t.parent),
"""

QUERIES: dict[str, Query] = {
    "catalog_findings": (lambda s, d: _findings(s, d).groupBy("config", "code", "severity").agg(F.countDistinct("name").alias("names")), _GENERAL + """
f AS (SELECT config, code, severity, name FROM general UNION ALL SELECT config, code, severity, name FROM stores) SELECT config, code, severity, count(DISTINCT name) AS names FROM f GROUP BY 1, 2, 3"""),
    "catalog_suggestions": (lambda s, d: catalog.suggestions(view(s, d, "uses").join(view(s, d, "defined"), ["config", "kind", "name"], "left_anti"), view(s, d, "defined")), _with("defined", "uses") + """
lost AS (SELECT DISTINCT config, kind, name FROM uses u ANTI JOIN defined d USING (config, kind, name)),
p AS (SELECT l.config, l.kind, l.name, d.name AS suggestion, damerau_levenshtein(lower(l.name), lower(d.name)) AS far FROM lost l JOIN defined d ON d.config = l.config AND d.kind = l.kind AND d.name <> l.name)
SELECT config, kind, name, suggestion FROM p WHERE far <= least(CASE WHEN length(name) <= 3 THEN 1 WHEN length(name) <= 7 THEN 2 ELSE 3 END, greatest(1, floor(length(name) * 0.4))) QUALIFY row_number() OVER (PARTITION BY config, kind, name ORDER BY far, suggestion) = 1"""),
    "store_findings": (lambda s, d: catalog.store_findings(relations(s, d)).groupBy("config", "code", "severity", "name").agg(F.count("*").alias("n")), _GENERAL + """
z AS (SELECT 1) SELECT config, code, severity, name, count(*) AS n FROM stores GROUP BY 1, 2, 3, 4"""),
    "validation_summary": (lambda s, d: catalog.validation_summary(_findings(s, d).select("config", "code", "severity", "name").distinct()), _GENERAL + """
f AS (SELECT config, code, severity, name FROM general UNION SELECT config, code, severity, name FROM stores)
SELECT config, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(DISTINCT code) AS codes FROM f GROUP BY 1"""),
    "catalog_counts": (lambda s, d: catalog.catalog_counts(relations(s, d)), _with("defined", "inputs", "modules", "actions", "sets") + _KINDS),
    "inferred_stores": (lambda s, d: catalog.infer_stores(relations(s, d)).groupBy("config", "store").agg(F.count("*").alias("n")), _with("actions") + """
n AS (SELECT config, CASE driver WHEN 'splunk' THEN 'splunk' WHEN 'omelasticsearch' THEN 'elastic-ecs' WHEN 'datadog' THEN 'datadog' WHEN 'sumologic' THEN 'sumo-logic' WHEN 'loki' THEN 'loki' WHEN 'gelf' THEN 'graylog-gelf' WHEN 'sentinel' THEN 'microsoft-sentinel'
  WHEN 'chronicle' THEN 'chronicle-udm' WHEN 'leef' THEN 'qradar-leef' WHEN 'cef' THEN 'arcsight-cef' END AS store FROM actions) SELECT config, store, count(*) AS n FROM n WHERE store IS NOT NULL GROUP BY 1, 2"""),
    "inferred_taxonomies": (lambda s, d: catalog.infer_taxonomies(relations(s, d)), _with("sets") + """
t AS (SELECT config, lookup, ord, CASE lower(name) WHEN 'sourcetype' THEN 'sourcetype' WHEN 'event_type' THEN 'ecs.event.type' WHEN 'ddsource' THEN 'ddsource' END AS taxonomy FROM sets WHERE lookup IS NOT NULL)
SELECT config, lookup AS "table", arg_min(taxonomy, ord) AS taxonomy FROM t WHERE taxonomy IS NOT NULL GROUP BY 1, 2"""),
    "statement_intervals": (lambda s, d: trees.intervals(view(s, d, "nested")).select("config", "ruleset", "id", "depth", "pre", "last", "terminal"), _TREE + """
p AS (SELECT n.config, n.ruleset, n.id, d.depth, row_number() OVER (PARTITION BY n.config, n.ruleset ORDER BY key.k, n.id) AS pre, size.size FROM nested n JOIN d USING (config, id) JOIN key USING (config, id) JOIN size USING (config, id))
SELECT p.config, p.ruleset, p.id, CAST(p.depth AS BIGINT) AS depth, p.pre, CAST(p.pre + p.size - 1 AS BIGINT) AS last, f.id IS NULL AS terminal FROM p LEFT JOIN (SELECT DISTINCT config, id FROM fails) f USING (config, id)"""),
    "silent_drops": (lambda s, d: _silent_drops(s, d), _TREE + """
top AS (SELECT *, row_number() OVER (PARTITION BY config, ruleset ORDER BY ord DESC, id DESC) AS t FROM nested WHERE parent IS NULL), f AS (SELECT DISTINCT config, id FROM fails)
SELECT t.config, 'V_SILENT_DROP' AS code, t.ruleset, t.id, NULL AS branch FROM top t JOIN f USING (config, id) WHERE t.t = 1 AND NOT EXISTS (SELECT 1 FROM nested c WHERE c.kind = 'Call' AND c.config = t.config AND c.ruleset <> t.ruleset AND c.id % 7 = t.id % 7)
UNION ALL SELECT t.config, 'V_SILENT_DROP_BRANCH', t.ruleset, t.id, t.branch FROM tail t JOIN f USING (config, id) WHERE t.t = 1"""),
    "reached_nodes": (lambda s, d: graph.reached(view(s, d, "edges"), view(s, d, "seeds")), _with("edges", "seeds") + """
r AS (SELECT graph, node FROM seeds UNION SELECT r.graph, e.dst FROM r JOIN edges e ON e.graph = r.graph AND e.src = r.node) SELECT graph, node FROM r"""),
    "leading_nodes": (lambda s, d: graph.reached(graph.reversed_edges(view(s, d, "edges")), view(s, d, "seeds")), _with("edges", "seeds") + """
r AS (SELECT graph, node FROM seeds UNION SELECT r.graph, e.src FROM r JOIN edges e ON e.graph = r.graph AND e.dst = r.node) SELECT graph, node FROM r"""),
    "dead_nodes": (lambda s, d: graph.dead_nodes(view(s, d, "edges").select("graph", F.explode(F.array("src", "dst")).alias("node")), view(s, d, "edges"), view(s, d, "seeds")), _with("edges", "seeds") + """
r AS (SELECT graph, node FROM seeds UNION SELECT r.graph, e.dst FROM r JOIN edges e ON e.graph = r.graph AND e.src = r.node) SELECT graph, src AS node FROM edges UNION SELECT graph, dst FROM edges EXCEPT SELECT graph, node FROM r"""),
    "feeding_sources": (lambda s, d: graph.feeding_sources(view(s, d, "feeds"), _nodes(s, d, "r"), _nodes(s, d, "c")), _with("feeds") + """
r AS (SELECT DISTINCT dst AS sink, dst AS node FROM feeds WHERE dst LIKE 'r%' UNION SELECT r.sink, f.src FROM r JOIN feeds f ON f.dst = r.node WHERE r.node NOT LIKE 'c%') SELECT 'all' AS graph, sink, node AS source FROM r WHERE node LIKE 'c%'"""),
    "tag_routes": (lambda s, d: tags.counted_tags(view(s, d, "tags"), view(s, d, "patterns").groupBy("pattern", "route", "ord").agg(F.count("*").alias("times"))).select("pattern", "route", "ord", (F.col("n") * F.col("times")).alias("n")), _with("tags", "patterns") + """
m AS (SELECT p.* FROM tags t JOIN patterns p ON CASE WHEN p.pattern LIKE '%*' THEN starts_with(t.tag, left(p.pattern, -1)) ELSE t.tag = p.pattern END) SELECT pattern, route, ord, count(*) AS n FROM m GROUP BY ALL"""),
    "tag_routes_dotted": (lambda s, d: tags.routed_tags(view(s, d, "tags"), view(s, d, "patterns"), True).select("event_id", F.size("routes").cast("long").alias("n"), F.element_at("routes", -1).alias("last")), _with("tags", "patterns") + """
m AS (SELECT t.event_id, p.ord, p.route FROM tags t JOIN patterns p ON p.pattern IN ('*', '**', t.tag) OR p.pattern LIKE '%.**' AND (t.tag = left(p.pattern, -3) OR starts_with(t.tag, left(p.pattern, -2))))
SELECT event_id, count(*) AS n, arg_max(route, (ord, route)) AS last FROM m GROUP BY 1"""),
    "stream_messages": (lambda s, d: _stream_messages(view(s, d, "wire")), _with("wire") + f"""
z AS (SELECT 1) SELECT user_id, CAST((fin - 1) // {SEGMENT} AS BIGINT) AS segment, text FROM wire"""),
    "nearest_names": (lambda s, d: catalog.suggestions(view(s, d, "words"), view(s, d, "names")), _with("words", "names") + """
p AS (SELECT w.name, n.name AS suggestion, damerau_levenshtein(lower(w.name), lower(n.name)) AS far FROM words w JOIN names n ON n.name <> w.name)
SELECT 'all' AS config, 'part' AS kind, name, suggestion FROM p WHERE far <= least(CASE WHEN length(name) <= 3 THEN 1 WHEN length(name) <= 7 THEN 2 ELSE 3 END, greatest(1, floor(length(name) * 0.4))) QUALIFY row_number() OVER (PARTITION BY name ORDER BY far, suggestion) = 1"""),
    "name_distances": (lambda s, d: view(s, d, "words").select("name").join(view(s, d, "names").select(F.col("name").alias("known")), F.substring("name", -1, 1) == F.substring("known", -1, 1)).select("name", "known", alignment_distance(F.col("name"), F.col("known")).cast("long").alias("far")), _with("words", "names") + """
z AS (SELECT 1) SELECT w.name, n.name AS known, damerau_levenshtein(w.name, n.name) AS far FROM words w JOIN names n ON right(w.name, 1) = right(n.name, 1)"""),
    "retag_lookup_entries": (lambda s, d: _retagged(s, d)[0], _with("entries") + """z AS (SELECT 1) SELECT "table", key, value, "table" <> 'teams' AS lossy FROM entries"""),
    "retag_lookup_losses": (lambda s, d: _retagged(s, d)[1], _with("entries") + """
z AS (SELECT 1) SELECT "table", CASE "table" WHEN 'types' THEN 'sourcetype' ELSE 'ecs.event.category' END AS taxonomy, count(*) AS n, count(*) AS n_lossy FROM entries WHERE "table" <> 'teams' GROUP BY ALL"""),
    "config_search": (lambda s, d: catalog.search(_lines(s, d), "THAN", limit=5000), """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(l) AS value, unnest(range(1, len(l) + 1)) AS line FROM l)
SELECT doc_id, min(line) AS line, substr(trim(arg_min(value, line)), 1, 200) AS snippet FROM e WHERE contains(lower(value), 'than') GROUP BY 1 ORDER BY 1 LIMIT 5000"""),
}


def _silent_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls go to the rulesets of the same configuration whose top has an equal remainder by 7."""
    nested = view(spark, sf_dir, "nested")
    numbered = trees.intervals(nested)
    tops = numbered.filter("parent IS NULL").select("config", "ruleset", (F.col("id") % 7).alias("r")).distinct()
    return trees.silent_drops(tops, numbered, _called(nested, numbered))


def _called(nested: DataFrame, numbered: DataFrame) -> DataFrame:
    """config, ruleset of those that another ruleset calls, each once: two callers in a place tell whether one of them is another."""
    calls = nested.filter("kind = 'Call'").groupBy("config", (F.col("id") % 7).alias("r")).agg(F.min("ruleset").alias("least"), F.max("ruleset").alias("most"))
    last = numbered.filter("parent IS NULL").groupBy("config", "ruleset").agg((F.max_by("id", F.struct("ord", "id")) % 7).alias("r"))
    return last.join(calls, ["config", "r"]).filter("least <> ruleset OR most <> ruleset").select("config", "ruleset")


def _stream_messages(wire: DataFrame) -> DataFrame:
    """The streams cut into segments of equal size, wherever messages end in them, and framed again."""
    start = F.col("fin") - F.length("framed")
    pieces = wire.select("user_id", "framed", start.alias("start"), F.explode(F.sequence(F.floor(start / SEGMENT), F.floor((F.col("fin") - 1) / SEGMENT))).alias("segment"))
    first = F.greatest(F.col("segment") * SEGMENT - F.col("start"), F.lit(0))
    size = (F.col("segment") + 1) * SEGMENT - F.col("start") - first
    part = F.struct("start", F.substr("framed", (first + 1).cast("int"), size.cast("int")).alias("text"))
    segments = pieces.groupBy("user_id", "segment").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"])).cast("binary").alias("text"))
    return reassembled(segments, "user_id", ["segment"], "text").withColumn("text", F.col("text").cast("string"))


def _nodes(spark: SparkSession, sf_dir: str, letter: str) -> DataFrame:
    """The nodes of one letter at either end of an edge: what nothing feeds may be a source too."""
    return view(spark, sf_dir, "feeds").select("graph", F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").startswith(letter)).distinct()


def _retagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """No two stores share a taxonomy, so a table's words find none in the other store's."""
    kinds = spark.createDataFrame([("types", "sourcetype"), ("categories", "ecs.event.category")], "table string, taxonomy string")
    return siem.retag_lookup(view(spark, sf_dir, "entries"), kinds, siem.value_map(spark), "splunk", "datadog")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long") + 1)
