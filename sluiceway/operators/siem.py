"""Vocabulary translation through a pivot, and rendering of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.targets import GELF_RESERVED, SELF, TARGETS, UDM_GROUPS, Target

VALUE_MAP = "siem string, taxonomy string, ord int, native string, category_uid int, class_uid int, activity_id int"


def retag_map(value_map: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """native, retagged: the target's word for each word of the source.

    The first target entry, in its order, of the same class and a compatible
    activity, whatever its category; else of the same category.  Both sides are small dimension tables.
    """
    side = lambda s: value_map.filter((F.col("siem") == s[0]) & (F.col("taxonomy") == s[1]))
    a, b = side(source).alias("a"), side(target).alias("b")
    agree = F.col("a.activity_id").isNull() | F.col("b.activity_id").isNull() | (F.col("a.activity_id") == F.col("b.activity_id"))
    found = lambda rank, on: a.join(b, on).select(F.col("a.native").alias("native"), F.col("b.native").alias("retagged"), F.lit(rank).alias("rank"), F.col("b.ord").alias("ord"))
    pairs = found(0, (F.col("a.class_uid") == F.col("b.class_uid")) & agree).union(found(1, F.col("a.category_uid") == F.col("b.category_uid")))
    return pairs.groupBy("native").agg(F.min_by("retagged", F.struct("rank", "ord")).alias("retagged"))


def value_map(spark: SparkSession) -> DataFrame:
    """The words of all known stores, as rows of VALUE_MAP."""
    return spark.createDataFrame([r for t in TARGETS.values() for r in t.rows()], VALUE_MAP)


def retag(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with retagged and lossy; a word without translation stays and is lossy."""
    joined = rows.join(mapping.withColumnRenamed("native", column), column, "left")
    return joined.withColumns({"lossy": F.col("retagged").isNull(), "retagged": F.coalesce("retagged", column)})


def retag_lookup(entries: DataFrame, taxonomies: DataFrame, values: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Lookup tables in the target's words, and per table how many words had none.

    entries: table, key, value; taxonomies: table, taxonomy (tables without one
    pass as they are); values: rows of VALUE_MAP.  Returns table, key, value,
    lossy, and table, taxonomy, n, n_lossy.  A word keeps its own form where it
    has no translation; with equal source and target nothing changes.
    """
    tagged = entries.join(F.broadcast(taxonomies), "table", "left")  # one row a table
    if source == target:
        done = tagged.withColumn("lossy", F.lit(False))
    else:
        names = values.select("taxonomy").distinct()
        maps = [retag_map(values, (source, r["taxonomy"]), (target, r["taxonomy"])).withColumn("taxonomy", F.lit(r["taxonomy"])) for r in names.collect()]  # a handful of taxonomies
        whole = reduce(DataFrame.unionByName, maps)
        joined = tagged.join(F.broadcast(whole.withColumnRenamed("native", "value")), ["taxonomy", "value"], "left")  # at most one row a word of the vocabularies
        done = joined.withColumn("lossy", F.col("taxonomy").isNotNull() & F.col("retagged").isNull()).withColumn("value", F.coalesce("retagged", "value"))
    counts = done.filter("taxonomy IS NOT NULL").groupBy("table", "taxonomy").agg(F.count("*").alias("n"), F.count_if("lossy").alias("n_lossy"))
    return done.select("table", "key", "value", "lossy"), counts


def native_fields(target: Target) -> Column:
    """The field `event`, a map of pivot names to values, as entries name, native, value (native null if unmapped)."""
    to = F.create_map(*(F.lit(x) for kv in target.fields.items() for x in kv)) if target.fields else F.create_map().cast("map<string,string>")
    return F.transform(F.map_entries("event"), lambda e: F.struct(e["key"].alias("name"), F.try_element_at(to, e["key"]).alias("native"), e["value"].alias("value")))


def _camel(key: Column) -> Column:
    """Dots and underscores fall, the letter after them becomes large."""
    parts = F.filter(F.split(F.regexp_replace(key, r"[._]+(?=.)", "\n"), "\n"), lambda p, i: (i == 0) | (p != ""))
    first_kept = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))))
    return F.array_join(first_kept, "")


def _pairs(target: Target, escaped, sep: str) -> Column:
    return F.array_join(F.transform(native_fields(target), lambda e: F.concat(_camel(F.coalesce(e["native"], e["name"])), F.lit("="), escaped(e["value"]))), sep)


def render_cef(target: Target, vendor: Column, product: Column, version: Column, event_id: Column, name: Column, severity: Column) -> Column:
    """A CEF line of the column `event`; null header slots get placeholders, severity is rounded and held to 0..10, 5 if missing."""
    head = lambda c, d: F.regexp_replace(F.coalesce(c.cast("string"), F.lit(d)), r"([\\|])", r"\\$1")
    level = F.floor(F.least(F.greatest(F.coalesce(F.nanvl(severity.cast("double"), F.lit(5.0)), F.lit(5.0)), F.lit(0.0)), F.lit(10.0)) + 0.5).cast("string")
    body = _pairs(target, lambda v: F.regexp_replace(v, "([\\\\=\n])", r"\\$1"), " ")
    line = F.concat_ws("|", F.lit("CEF:0"), head(vendor, SELF), head(product, "unknown"), head(version, "0"), head(event_id, "0"), head(name, "event"), level)
    return F.when(F.size("event") > 0, F.concat_ws("|", line, body)).otherwise(line)


def render_leef(target: Target, vendor: Column, product: Column, version: Column, event_id: Column) -> Column:
    """A LEEF 2.0 line of the column `event`, with tabs between fields; the delimiter's slot is empty, as tab is the default."""
    or_ = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    body = _pairs(target, lambda v: F.regexp_replace(v, "([\\\\\t=\n])", r"\\$1"), "\t")
    line = F.concat_ws("|", F.lit("LEEF:2.0"), or_(vendor, SELF), or_(product, "unknown"), or_(version, "0"), or_(event_id, "0"), F.lit(""))
    return F.when(F.size("event") > 0, F.concat_ws("|", line, body)).otherwise(line)


def _json(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":|\}$', "")


def _member(name: Column, value: Column) -> Column:
    return F.concat(_json(name), F.lit(":"), value)


def render_gelf(target: Target) -> Column:
    """A GELF 1.1 object of the column `event`: reserved names as they are, others with an underscore, unmapped ones as one text."""
    rows = native_fields(target)
    reserved = lambda k: k.isin(list(GELF_RESERVED))
    key = lambda e: F.coalesce(e["native"], e["name"])
    known = F.filter(rows, lambda e: reserved(key(e)) | e["native"].isNotNull() | e["name"].isin(list(target.passthrough)))
    prefixed = lambda k: F.when(reserved(k) | k.startswith("_"), k).otherwise(F.concat(F.lit("_"), F.replace(k, F.lit("."), F.lit("_"))))
    members = F.transform(known, lambda e: _member(prefixed(key(e)), _json(e["value"])))
    absent = lambda name, value: F.when(~F.exists(known, lambda e: key(e) == name), F.array(_member(F.lit(name), F.lit(value)))).otherwise(F.array().cast("array<string>"))
    rest = F.filter(rows, lambda e: ~(reserved(key(e)) | e["native"].isNotNull() | e["name"].isin(list(target.passthrough))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(rest, lambda e: _member(e["name"], _json(e["value"]))), ","), F.lit("}"))
    unmapped = F.when(F.size(rest) > 0, F.array(_member(F.lit("_unmapped"), _json(text)))).otherwise(F.array().cast("array<string>"))
    everything = F.concat(F.array(F.lit('"version":"1.1"')), members, absent("host", '"_unknown"'), absent("short_message", '""'), unmapped)
    return F.concat(F.lit("{"), F.array_join(everything, ","), F.lit("}"))


def _leaf(target: Target, name: str) -> tuple[Column, Column]:
    """Whether the column `event` has a value for a native name, and the first such value.

    Nearly every native name comes from one pivot name: then it is looked up as a key.
    """
    keys = [k for k, n in target.fields.items() if n == name] + ([name] if name in target.passthrough and name not in target.fields else [])
    if len(keys) == 1:
        return F.map_contains_key("event", F.lit(keys[0])), F.try_element_at("event", F.lit(keys[0]))
    same = F.filter(F.map_entries("event"), lambda e: e["key"].isin(keys))
    return F.size(same) > 0, F.get(same, F.lit(0))["value"]


def _nested(leaves: dict[str, tuple[Column, Column]]) -> Column:
    """A JSON object of native names (whether it is there, its value), nested at their dots; absent ones are left out."""

    def nest(items: dict[str, str]) -> Column:
        heads: dict[str, dict[str, str]] = {}
        for path, name in items.items():
            head, _, rest = path.partition(".")
            heads.setdefault(head, {})[rest] = name
        fields = [(leaves[v[""]][1] if set(v) == {""} else nest({k: n for k, n in v.items() if k})).alias(h) for h, v in heads.items()]
        return F.when(reduce(Column.__or__, (leaves[n][0] for n in items.values())), F.struct(*fields))

    return nest({n: n for n in leaves})


def render_json(target: Target) -> Column:
    """A JSON object of the column `event`, nested at the dots of the target's names; names without mapping go under unmapped."""
    rows = native_fields(target)
    passed = F.transform(rows, lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["native"], F.when(e["name"].isin(list(target.passthrough)), e["name"])).alias("native"), e["value"].alias("value")))
    names = list(dict.fromkeys([*target.fields.values(), *target.passthrough]))
    rest = F.filter(passed, lambda e: e["native"].isNull())
    unmapped = F.when(F.size(rest) > 0, F.map_from_entries(F.transform(rest, lambda e: F.struct(e["name"], e["value"]))))
    shown = _nested({n: _leaf(target, n) for n in names}) if names else F.lit(None).cast("struct<_:string>")
    body = F.coalesce(F.to_json(shown), F.lit("{}"))
    more = F.when(F.size(rest) > 0, F.concat(F.lit('"unmapped":'), F.to_json(unmapped)))
    inner = F.regexp_replace(body, r"(?s)^\{|\}$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner, F.lit("")), more), F.lit("}"))


def render_udm(target: Target) -> Column:
    """A UDM object of the column `event`: names of a known group are nested, the others become additional.fields."""
    rows = native_fields(target)
    grouped = F.transform(rows, lambda e: F.struct(e["name"].alias("name"), F.when(F.substring_index(e["native"], ".", 1).isin(list(UDM_GROUPS)), e["native"]).alias("native"), e["value"].alias("value")))
    names = ["metadata.product_name", "metadata.event_type", *(n for n in target.fields.values() if n.partition(".")[0] in UDM_GROUPS)]
    leaves = {n: _leaf(target, n) for n in dict.fromkeys(names)}
    for name, value in (("metadata.product_name", SELF), ("metadata.event_type", "GENERIC_EVENT")):
        there, own = leaves[name]
        leaves[name] = F.col("event").isNotNull(), F.when(there, own).otherwise(F.lit(value))
    rest = F.filter(grouped, lambda e: e["native"].isNull())
    fields = F.transform(rest, lambda e: F.struct(e["name"].alias("key"), F.struct(e["value"].alias("string_value")).alias("value")))
    more = F.when(F.size(rest) > 0, F.concat(F.lit('"additional":'), F.to_json(F.struct(fields.alias("fields")))))
    inner = F.regexp_replace(F.to_json(_nested(leaves)), r"(?s)^\{|\}$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", inner, more), F.lit("}"))


def render(target: Target) -> Column:
    """The column `event` in the target's own form, headers by default."""
    null = F.lit(None).cast("string")
    forms = {"json": render_json, "passthrough": render_json, "gelf": render_gelf, "udm": render_udm, "cef": lambda t: render_cef(t, *[null] * 6), "leef": lambda t: render_leef(t, *[null] * 4)}
    return forms[target.form](target)
