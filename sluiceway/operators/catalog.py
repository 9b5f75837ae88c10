"""Checks over a configuration's catalog: references, reachability, conflicts, silent drops, outputs of event stores.

The catalog is a few small relations (uses, definitions, inputs, actions), made
on the driver as rows; the checks are joins, filters and groupings over them, so
many configurations can be checked in one job: each relation has a `config`
column that all joins keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.distance import deletions, edit_distance
from sluiceway.model import Action, Call, CallRuleset, Config, If, Lit, Set, Stop
from sluiceway.operators.targets import GELF_RESERVED, TARGETS
from sluiceway.operators.trees import STATEMENTS, intervals, silent_drops
from sluiceway.staging import written

FINDING = "config string, code string, severity string, name string, message string"

# Inputs and actions that a module of their own name must be loaded for, and those built in.
INPUT_MODULES = ("imudp imtcp imptcp imrelp imuxsock imjournal imklog imfile imkafka imhttp imhiredis immark imsolaris imrabbitmq imgssapi imdiag").split()
OUTPUT_MODULES = (
    "omkafka omelasticsearch omhttp omhttpfs ommongodb ommysql ompostgresql omrelp omudpspoof omprog omsnmp omhiredis omclickhouse omazureeventhubs omamqp1 omrabbitmq mmjsonparse mmnormalize mmpstrucdata mmgrok"
).split()
# What the stores' checks know.
HIGH_CARDINALITY = "user username uid trace_id span_id request_id session_id order_id customer_id ip src_ip dest_ip host_ip pid".split()
STANDARD_TABLES = ("Syslog", "SecurityEvent", "CommonSecurityLog", "AzureActivity", "SigninLogs", "AuditLogs")
CUSTOM_TABLE = "^[A-Za-z][A-Za-z0-9]{1,44}_CL$"
MORE_EVENT_TYPES = ("GENERIC_EVENT", "STATUS_HEARTBEAT", "STATUS_STARTUP", "STATUS_SHUTDOWN", "SETTING_MODIFICATION")
TAXONOMY_FIELDS = {
    "sourcetype": "sourcetype", "event_category": "ecs.event.category", "event.category": "ecs.event.category", "event_type": "ecs.event.type", "event.type": "ecs.event.type", "ddsource": "ddsource", "category": "generic", "log_class": "generic",
}


def statements(body: tuple) -> Iterator[object]:
    for s in body:
        yield s
        if isinstance(s, If):
            yield from statements(s.then)
            yield from statements(s.other)


def _calls(e: object) -> Iterator[Call]:
    if isinstance(e, Call):
        yield e
    for a in getattr(e, "args", ()):
        yield from _calls(a)


def references(config: Config) -> list[tuple[str, str, str]]:
    """(kind, from, name) of every use of a ruleset, template or lookup table."""
    out = [("ruleset", "<input>", i.ruleset) for i in config.inputs if i.ruleset]
    if config.default:
        out.append(("ruleset", "<default>", config.default))
    for name, body in config.rulesets.items():
        for s in statements(body):
            if isinstance(s, CallRuleset):
                out.append(("ruleset", name, s.name))
            if isinstance(s, Action):
                out += [("template", name, s.param(k)) for k in ("template", "dynafile") if s.param(k)]
            for c in _calls(getattr(s, "test", None) or getattr(s, "value", None)):
                kind = {"lookup": "lookup", "exec_template": "template"}.get(c.name)
                if kind and c.args and isinstance(c.args[0], Lit):
                    out.append((kind, name, str(c.args[0].value)))
    return out


def statement_rows(config: Config) -> list[tuple]:
    """ruleset, id, parent, branch, ord, kind of each statement, see operators.trees."""
    out: list[tuple] = []

    def walk(name: str, body: tuple, parent: int | None, branch: str) -> None:
        for k, s in enumerate(body):
            here, nested = len(out), isinstance(s, If)
            kind = {"CallRuleset": "Call"}.get(type(s).__name__, type(s).__name__)
            out.append((name, here, parent, branch, k, "If" if nested else kind))
            if nested:
                walk(name, s.then, here, "then")
                walk(name, s.other, here, "else")

    for name, body in config.rulesets.items():
        walk(name, body, None, "body")
    return out


def edges(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(a, b) for kind, a, b in references(config) if kind == "ruleset"] or [], "src string, dst string")


def reachable(config: Config) -> set[str]:
    """Rulesets that inputs, the default or calls from these lead to; a configuration has a bounded number of them."""
    out: dict[str, set[str]] = {}
    for kind, a, b in references(config):
        if kind == "ruleset":
            out.setdefault(a, set()).add(b)
    seen, front = set(), {b for a in ("<input>", "<default>") for b in out.get(a, ())}
    while front:
        seen |= front
        front = {b for a in front for b in out.get(a, ())} - seen
    return seen


#: The relations of a catalog.
RELATIONS = {
    "uses": "config string, kind string, src string, name string", "defined": "config string, kind string, name string, reached boolean, loaded boolean",
    "inputs": "config string, type string", "modules": "config string, name string", "actions": "config string, ord int, driver string, params map<string,string>", "sets": "config string, ord int, space string, name string, lookup string", "statements": STATEMENTS,
}


def relations(spark: SparkSession, configs: dict[str, Config]) -> dict[str, DataFrame]:
    """The catalogs of configurations as tables, see RELATIONS."""
    rows: dict[str, list[tuple]] = {k: [] for k in RELATIONS}
    for c, config in configs.items():
        live = reachable(config)
        rows["uses"] += [(c, *u) for u in references(config)]
        rows["defined"] += [(c, "ruleset", n, n in live, True) for n in config.rulesets]
        rows["defined"] += [(c, "template", n, True, True) for n in config.templates]
        rows["defined"] += [(c, "lookup", n, True, n not in config.lookups or config.lookups[n].loaded) for n in {*config.lookup_files, *config.lookups}]
        rows["inputs"] += [(c, i.type.lower()) for i in config.inputs]
        rows["modules"] += [(c, m.lower()) for m in config.modules]
        rows["statements"] += [(c, *r) for r in statement_rows(config)]
        for body in config.rulesets.values():
            for s in statements(body):
                if isinstance(s, Action):
                    rows["actions"].append((c, len(rows["actions"]), (s.param("type") or s.kind).lower(), dict(s.params)))
                if isinstance(s, Set) and s.value is not None:
                    table = s.value.args[0].value if isinstance(s.value, Call) and s.value.name == "lookup" and s.value.args and isinstance(s.value.args[0], Lit) else None
                    rows["sets"].append((c, len(rows["sets"]), s.space, s.name, table))
    return {k: spark.createDataFrame(v, RELATIONS[k]) for k, v in rows.items()}


def _finding(rows: DataFrame, code: object, severity: str, message: object, name: object = "name") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("config", text(code).alias("code"), F.lit(severity).alias("severity"), F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), text(message).alias("message"))


def general_findings(rel: dict[str, DataFrame]) -> DataFrame:
    """References, dead code, files, conflicts, silent drops, modules: see FINDING."""
    # Written, as each check reads them, else they were made anew for each.
    uses, defined, actions = written(rel["uses"]), written(rel["defined"]), written(rel["actions"])
    lost = uses.join(defined, ["config", "kind", "name"], "left_anti")
    near = suggestions(lost.select("config", "kind", "name").distinct(), defined)
    lost = written(lost.join(near, ["config", "kind", "name"], "left"))
    hint = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("; did you mean "), "suggestion", F.lit("?"))).otherwise("")
    code = F.when(F.col("src") == "<default>", "V_UNDEFINED_DEFAULT_RULESET").otherwise(F.concat(F.lit("V_UNDEFINED_"), F.upper("kind")))
    found = [_finding(lost, code, "warning", F.concat("kind", F.lit(" is not defined"), hint))]
    found.append(_finding(lost.filter("kind = 'template' AND src NOT LIKE '<%'"), "V_RSYSLOG_TEMPLATE_UNDEFINED", "error", F.concat(F.lit("an action names a template that is not defined"), hint)))
    found.append(_finding(lost.filter("src = '<default>'"), "V_RSYSLOG_DEFAULT_RULESET_UNDEFINED", "error", F.concat(F.lit("the default ruleset is not defined"), hint)))
    found.append(_finding(defined.filter("kind = 'ruleset' AND NOT reached AND name <> '_default_legacy'"), "V_DEAD_RULESET", "info", "no input, default or call leads here"))
    unused = defined.filter("kind <> 'ruleset'").join(uses, ["config", "kind", "name"], "left_anti")
    found.append(_finding(unused, F.concat(F.lit("V_UNUSED_"), F.upper("kind")), "info", "nothing uses it"))
    found.append(_finding(defined.filter("kind = 'lookup' AND NOT loaded"), "V_LOOKUP_NOT_LOADED", "warning", "its file was not found"))
    called = uses.filter("kind = 'ruleset' AND src NOT LIKE '<%'").select("config", F.col("name").alias("ruleset"))
    drops = silent_drops(defined.filter("kind = 'ruleset'").select("config", F.col("name").alias("ruleset")), intervals(rel["statements"]), called)
    found.append(_finding(drops.filter("code = 'V_SILENT_DROP'"), "V_SILENT_DROP", "warning", "a path ends without an action, stop or call", "ruleset"))
    found.append(_finding(drops.filter("code = 'V_SILENT_DROP_BRANCH'"), "V_SILENT_DROP_BRANCH", "info", F.concat(F.lit("the "), "branch", F.lit(" branch that ends with statement "), F.col("id").cast("string"), F.lit(" has no action, stop or call there")), "ruleset"))
    p = lambda k: F.try_element_at("params", F.lit(k))
    place = F.when(F.col("driver") == "omfile", F.coalesce(F.concat(F.lit("dyna("), p("dynafile"), F.lit(")")), p("file"))).when((F.col("driver") == "omfwd") & p("target").isNotNull(), F.concat(p("target"), F.lit(":"), F.coalesce(p("port"), F.lit("?")), F.lit("/"), F.coalesce(p("protocol"), F.lit("?"))))
    twice = actions.withColumn("name", place).filter("name IS NOT NULL").groupBy("config", "driver", "name").agg(F.count("*").alias("n")).filter("n > 1")
    found.append(_finding(twice, "V_CONFLICTING_OUTPUT", "info", F.concat(F.col("n").cast("string"), F.lit(" actions write here"))))
    needed = rel["inputs"].filter(F.col("type").isin(INPUT_MODULES)).select("config", F.col("type").alias("name")).union(actions.filter(F.col("driver").isin(OUTPUT_MODULES)).select("config", F.col("driver").alias("name"))).distinct()
    found.append(_finding(needed.join(rel["modules"], ["config", "name"], "left_anti"), "V_MODULE_MISSING", "error", "used without loading its module"))
    return reduce(DataFrame.unionByName, found).distinct()


def infer_stores(rel: dict[str, DataFrame]) -> DataFrame:
    """actions with store: the event store that an action's driver belongs to."""
    drivers = [(d, t.name) for t in TARGETS.values() for d in t.drivers]
    spark = rel["actions"].sparkSession
    return rel["actions"].join(F.broadcast(spark.createDataFrame(drivers, "driver string, store string")), "driver")  # some 40 drivers


def infer_taxonomies(rel: dict[str, DataFrame]) -> DataFrame:
    """config, table, taxonomy: what a lookup table's words mean, by the structured field that first takes them."""
    fields = F.create_map(*(F.lit(x) for kv in TAXONOMY_FIELDS.items() for x in kv))
    named = rel["sets"].filter("space = '$!' AND lookup IS NOT NULL").withColumn("taxonomy", F.try_element_at(fields, F.lower("name")))
    return named.filter("taxonomy IS NOT NULL").groupBy("config", F.col("lookup").alias("table")).agg(F.min_by("taxonomy", "ord").alias("taxonomy"))


def store_findings(rel: dict[str, DataFrame]) -> DataFrame:
    """What outputs to event stores lack or say wrongly: see FINDING.

    Objects among the parameters are given as members written name=value, joined by commas.
    The outputs are read once; each becomes the findings that it has.
    """
    outputs = infer_stores(rel)
    upstream = rel["sets"].filter("space = '$!'").groupBy("config").agg(F.collect_set(F.lower("name")).alias("set_names"))  # names written in one configuration
    rows = outputs.join(upstream, "config", "left").withColumn("name", F.coalesce(F.try_element_at("params", F.lit("name")), F.col("driver")))
    has = lambda *keys: reduce(lambda a, b: a | b, (F.map_contains_key("params", F.lit(k)) for k in keys))
    upset = lambda *names: F.coalesce(F.arrays_overlap("set_names", F.array(*(F.lit(n.lower()) for n in names))), F.lit(False))
    p = lambda *keys: F.coalesce(*(F.try_element_at("params", F.lit(k)) for k in keys))
    members = lambda k: F.filter(F.split(F.coalesce(p(k), F.lit("")), ",\\s*"), lambda x: F.length(x) > 0)
    found: list[Column] = []
    shape, none = "array<struct<code:string,severity:string,message:string>>", F.array()

    def each(store: str, code: str, severity: str, items: Column, message: str = "") -> None:
        """A finding for each item of an output."""
        of = F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(F.lit(message), x).alias("message")))
        found.append(F.coalesce(F.when(F.col("store") == store, of), none.cast(shape)))

    def one(store: str, code: str, severity: str, test: Column, message: str, shown: Column | None = None) -> None:
        each(store, code, severity, F.when(test, F.array(F.lit("") if shown is None else shown)), message)

    one("splunk", "SIEM_SPLUNK_MISSING_SOURCETYPE", "warning", ~has("sourcetype", "Sourcetype", "SOURCETYPE") & ~upset("sourcetype"), "no sourcetype")
    one("elastic-ecs", "SIEM_ECS_MISSING_EVENT_DATASET", "info", ~has("event.dataset", "event_dataset", "dataset") & ~upset("event_dataset", "event.dataset"), "no event.dataset")
    one("datadog", "SIEM_DATADOG_MISSING_SERVICE", "warning", ~has("service") & ~upset("service"), "no service")
    one("sumo-logic", "SIEM_SUMO_MISSING_SOURCE_CATEGORY", "warning", ~has("_sourceCategory", "_sourcecategory", "sourceCategory", "sourcecategory", "category") & ~upset("_sourceCategory", "sourceCategory"), "no source category")
    dear = lambda label: F.get(F.filter(F.array(*map(F.lit, HIGH_CARDINALITY)), lambda f: F.contains(label, F.concat(F.lit("$!"), f)) | F.contains(label, F.concat(F.lit("$"), f)) | F.contains(label, F.concat(F.lit("%"), f, F.lit("%")))), F.lit(0))
    each("loki", "SIEM_LOKI_HIGH_CARDINALITY_LABEL", "warning", F.array_compact(F.transform(members("labels"), dear)), "a label comes from ")
    one("loki", "SIEM_LOKI_NO_LABELS", "info", F.size(members("labels")) == 0, "no labels")
    own = F.filter(F.transform(members("fields"), lambda x: F.substring_index(x, "=", 1)), lambda x: ~x.isin(list(GELF_RESERVED)) & ~x.startswith("_"))
    each("graylog-gelf", "SIEM_GELF_CUSTOM_FIELD_PREFIX", "warning", own, "a field of its own needs an underscore: ")
    tables = F.array_compact(F.array(*(p(k) for k in ("table", "Table", "stream", "Stream", "table_name"))))
    each("microsoft-sentinel", "SIEM_SENTINEL_INVALID_TABLE_NAME", "error", F.filter(tables, lambda t: (F.length(t) > 0) & ~F.rlike(t, F.lit(CUSTOM_TABLE)) & ~t.isin(list(STANDARD_TABLES))), "no standard table and no name of an own one: ")
    known = [w[0] for w in TARGETS["chronicle-udm"].words["udm.event_type"]] + list(MORE_EVENT_TYPES)
    event = p("event_type", "metadata.event_type")
    one("chronicle-udm", "SIEM_UDM_UNKNOWN_EVENT_TYPE", "warning", (F.length(event) > 0) & ~event.isin(known), "event type that is not known: ", event)
    lacking = F.array_compact(F.array(*(F.when(~has(k, k[0].upper() + k[1:], k.lower()), k) for k in ("vendor", "product", "version", "eventID"))))
    one("qradar-leef", "SIEM_LEEF_HEADER_INCOMPLETE", "info", F.size(lacking) > 0, "header lacks ", F.array_join(lacking, ", "))
    level = p("severity", "Severity", "sev")
    number = level.try_cast("double")
    one("arcsight-cef", "SIEM_CEF_SEVERITY_OUT_OF_RANGE", "warning", level.isNotNull() & (number.isNull() | (number < 0) | (number > 10)), "severity is not in 0..10: ", level)
    return rows.select("config", "name", F.inline(F.flatten(F.array(*found)))).select("config", "code", "severity", "name", "message")


def validate(spark: SparkSession, config: Config) -> DataFrame:
    """code, severity, name, message of each finding in one configuration."""
    rel = relations(spark, {"": config})
    return general_findings(rel).unionByName(store_findings(rel)).drop("config")


def validation_summary(findings: DataFrame) -> DataFrame:
    """config, errors, warnings, infos, and how many of each code."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("config").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), F.countDistinct("code").alias("codes"))


def catalog_counts(rel: dict[str, DataFrame]) -> DataFrame:
    """config, kind, n: how many definitions of each kind, inputs, actions and assignments."""
    kinds = [rel["defined"].select("config", "kind")] + [rel[k].select("config", F.lit(k).alias("kind")) for k in ("inputs", "modules", "actions", "sets")]
    return reduce(DataFrame.unionByName, kinds).groupBy("config", "kind").agg(F.count("*").alias("n"))


def edit_limit(name: Column) -> Column:
    """How far a suggestion may be from a name."""
    # Edits by the length of the name, and their share of it.
    by_length = F.when(F.length(name) <= 3, 1).when(F.length(name) <= 7, 2).otherwise(3)
    return F.least(by_length, F.greatest(F.lit(1), F.floor(F.length(name) * 0.4).cast("int")))


def suggestions(words: DataFrame, defined: DataFrame) -> DataFrame:
    """config, kind, name, suggestion: the nearest defined name of the same kind, in either case, if it is near enough.

    A swap of neighbours counts as one edit.  Only names that share what is left
    after a few deletions meet, so catalogs of any size can be searched; of names
    equally near the first in the alphabet counts.  A null or empty name has none.
    """
    names = defined.filter(F.length("name") > 0).select("config", "kind", F.col("name").alias("known")).distinct()
    asked = words.filter(F.length("name") > 0).select("config", "kind", "name").distinct()
    left = asked.select("*", F.inline(deletions(F.lower("name"), 3))).filter(F.col("k") <= edit_limit(F.col("name"))).drop("k")
    right = names.select("*", F.inline(deletions(F.lower("known"), 3))).withColumnRenamed("k", "dropped")
    met = left.join(right, ["config", "kind", "v"]).filter((F.col("dropped") <= edit_limit(F.col("name"))) & (F.abs(F.length("name") - F.length("known")) <= edit_limit(F.col("name"))))
    # Written, else the distances would be taken before the distinct, for each deletion that two names share.
    pairs = written(met.select("config", "kind", "name", "known").distinct().filter("known <> name"))
    # A swap is two edits of the plain distance at most.
    close = pairs.filter(F.levenshtein(F.lower("name"), F.lower("known"), 6) >= 0)
    near = close.withColumn("far", edit_distance(F.lower("name"), F.lower("known"))).filter(F.col("far") <= edit_limit(F.col("name")))
    best = near.groupBy("config", "kind", "name").agg(F.min(F.struct("far", "known")).alias("best"))
    return best.select("config", "kind", "name", F.col("best.known").alias("suggestion"))


def search(lines: DataFrame, query: str, regex: bool = False, case: bool = False, limit: int = 500) -> DataFrame:
    """doc_id, line, snippet: the first line of each file that holds the query, files in their order."""
    text = F.col("value") if case else F.lower("value")
    hit = F.col("value").rlike(("" if case else "(?i)") + query) if regex else text.contains(query if case else query.lower())
    first = lines.filter(hit).groupBy("doc_id").agg(F.min("line").alias("line"), F.min_by(F.substring(F.trim("value"), 1, 200), "line").alias("snippet"))
    return first.orderBy("doc_id").limit(limit)
