"""Nulls, ties, repeated rows, empty tables and odd names of the parts that work at any size."""

import json
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sluiceway import table_queries
from sluiceway.functions.distance import alignment_distance, edit_distance
from sluiceway.functions.jsontext import json_object, repeated_keys, shown_members
from sluiceway.operators import catalog, detect, detect_index, enrich, graph, replay, siem, tags, trees
from sluiceway.operators.targets import TARGETS
from sluiceway.plans.routing import evaluate
from sluiceway.sources.config import parse_config
from sluiceway.sources.messages import with_properties
from sluiceway.sources.ndjson import read_ndjson
from sluiceway.sources.ordered import first_messages, read_ordered_lines


def messages(spark, rows, schema="idx long, programname string, hostname string, msg string"):
    return with_properties(spark.createDataFrame(rows, schema).withColumns({"transport": F.lit("udp"), "port": F.lit(514)}))


# --- JSON ---


def test_strict_json_equals_the_parser_of_python(spark):
    texts = ['{"a":"x","a":"y"}', '{"a":1} t', "{'a':1}", "[1]", "{}", '{"a":[1,{"b":null}]}', '{"a":NaN}', '{"a":1,}', '{"":"e"}', "", " ", None, '{"a":"\\u00e9"} ', '{"a":1}]', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1},"b":2', "null", '{"a":"b', '{"a":1}, "x"']
    with repeated_keys(spark):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", shown_members(json_object(F.col("t"))).alias("m"))
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"
    got = {r.k: r.m for r in df.collect()}

    def plain(text):
        try:
            value = json.loads(text or "", parse_constant=lambda _: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None
        show = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        return {k: show(v) for k, v in value.items()} if isinstance(value, dict) else None

    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_fields_of_messages_that_are_no_text_are_faults(spark):
    lines = ['{"msg":"a","programname":null}', '{"msg":5}', '{"hostname":["x"],"msg":"a"}', '{"msg":"a","structured":{"k":1,"k":2},"port":"9","transport":"tcp"}', "nope", '{"msg":true,"simTime":1000}']
    rows, bad = read_ndjson(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "`a.b` int, value string"))
    got = {r["a.b"]: r for r in rows.collect()}
    assert {k: r.fault for k, r in got.items()} == {0: None, 1: "msg is not a string", 2: "hostname is not a string", 3: None, 5: "msg is not a string"}
    assert got[3].structured == {"k": "2"} and (got[3].port, got[3].transport) == (514, "tcp") and [r["a.b"] for r in bad.collect()] == [4]
    assert read_ndjson(spark.createDataFrame([], "value string"))[0].collect() == []


def test_a_message_that_fails_is_an_error_only(spark):
    df = messages(spark, [(1, "a", "h", "x"), (2, "a", "h", "x"), (3, None, None, None)]).withColumn("fault", F.when(F.col("idx") == 2, "odd"))
    config = parse_config('ruleset(name="r") { if $msg == "x" then action(type="omfile" file="/a") }\nglobal(defaultruleset="r")')
    out = evaluate(df, config)
    r = replay.outcomes(out).first()
    assert (r.total, r.delivered, r.no_output, r.no_input_match, r.errors) == (3, 1, 1, 0, 1)
    assert {(s.bucket, s.idx, s.reason) for s in replay.samples(out).collect()} == {("error", 2, "odd"), ("no_output", 3, "ruleset ran but no outputs")}
    both = replay.compare(df, config, parse_config('ruleset(name="q") { stop }\nglobal(defaultruleset="q")'))
    assert {x.idx: x.baseline for x in both.collect()}[2] == "error" and [x.idx for x in replay.route_changes(both).orderBy("idx").collect()] == [1, 3]


@pytest.mark.parametrize("pattern, hit", [("[", False), ("(", False), ("", False), (None, False), ("h.l+o", True), ("^x", False), ("(?<a", False), ("*", False), ("\\", False)])
def test_patterns_of_messages(spark, pattern, hit):
    df = messages(spark, [(1, pattern, "h", "hello"), (2, pattern, "h", None)])
    text = 'ruleset(name="r") { if $msg =~ $programname then action(type="omfile" file="/a") if re_match($msg, $programname) then action(type="omfile" file="/b") set $.x = re_extract($msg, $programname, 0, 0, "none"); }\nglobal(defaultruleset="r")'
    out = {r.idx: r for r in evaluate(df, parse_config(text)).collect()}
    assert [o.path for o in out[1].outputs] == (["/a", "/b"] if hit else []) and out[1].error is None
    assert out[1].vars["x"] == ("hello" if hit else "" if not pattern else "none") and out[2].outputs == []


def test_field_and_replace_with_values_of_messages(spark):
    df = messages(spark, [(1, ",", "h", "a,b.c"), (2, ".", "h", "a,b.c"), (3, "", "h", "a,b")])
    text = 'ruleset(name="r") { set $.f = field($msg, $programname, 2); set $.g = replace($msg, $programname, "-"); }\nglobal(defaultruleset="r")'
    assert {r.idx: (r.vars["f"], r.vars["g"]) for r in evaluate(df, parse_config(text)).collect()} == {1: ("b.c", "a-b.c"), 2: ("c", "a,b-c"), 3: ("a,b", "a-,-b")}


# --- lookups ---


@pytest.mark.parametrize("limit", [enrich.BROADCAST_BYTES, 0])
def test_lookups_of_any_size(spark, limit):
    rows = [("k1", "first", 2), ("k1", "second", 3), ("k1", "tie b", 1), ("k1", "tie a", 1), (None, "none", 1), ("k2", None, 1), ("", "blank", 1), ("k9", "late", None), ("k9", "early", 7)]
    table = enrich.lookup_table(spark.createDataFrame(rows, "k string, v string, `at` int"), "k", "v", "at", "miss", limit)
    config = enrich.bound(parse_config('ruleset(name="r") { if $.none == "" then set $.x = lookup("t", $programname); set $.y = lookup("t", $.x); }\nglobal(defaultruleset="r")'), t=table)
    keys = ["k1", "k2", "", None, "k9", "other"] + ["k1"] * 300
    df = messages(spark, [(n, k, "h", "m") for n, k in enumerate(keys)]).repartition(3)
    got = {r.idx: r.vars["x"] for r in evaluate(df, config).collect()}
    want = {"k1": "tie a", "k2": "", "": "blank", None: "blank", "k9": "early", "other": "miss"}
    assert got == {n: want[k] for n, k in enumerate(keys)} and len(got) == len(keys)


def test_lookup_join_cuts_the_chain(spark):
    big = enrich.lookup_table(spark.range(1000).selectExpr("id AS k", "id * 2 AS v"), "k", "v", "k", limit=0)
    df = messages(spark, [(n, str(n), "h", "m") for n in range(50)])
    out = evaluate(df, enrich.bound(parse_config('ruleset(name="r") { set $.x = lookup("t", $programname); }\nglobal(defaultruleset="r")'), t=big))
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert enrich.hot_keys(spark.range(1000).selectExpr("IF(id < 400, 'hot', CAST(id AS STRING)) AS k"), "k") == ["hot"]


# --- detection by an index ---

RULES = """
title: Words
detection: {selection: {msg|contains: [alpha, Beta]}}
---
title: Folded
detection: {selection: {msg|i|contains: [BETA], programname: [sshd, cron]}, other: {hostname|endswith: "9"}, condition: selection and not other}
---
title: Pattern
detection: {selection: {msg|re: "g[a-m]+a$"}, bad: {msg|re: "("}, condition: selection or bad}
---
title: Not
detection: {selection: {msg|contains: alpha}, condition: not selection}
---
title: All
detection: {a_one: {msg|contains|all: [al, pha]}, a_two: {programname|startswith: ss}, b: [gamma, {hostname: h3}], condition: (all of a_* or 1 of b*) and not (a_two and b)}
---
title: Never
detection: {selection: {msg: []}}
---
title: Elsewhere
logsource: {product: windows}
detection: {selection: {msg|contains: a}}
---
title: Structured
detection: {selection: {user: "x", kind|startswith: k}}
---
title: Empty value
detection: {selection: {msg|contains: ["", zzz]}, programname: {programname: null}, condition: selection and not programname}
"""


def test_index_fires_what_columns_fire(spark):
    r = random.Random(2)
    words = ["alpha", "Beta", "beta", "gamma", "al", "pha", "", None, "GAMMA", "x", "zzz"]
    rows = [(n, r.choice(["sshd", "cron", "su", None]), r.choice(["h3", "h9", None]), None if (a := r.choice(words)) is None else f"{a} {r.choice(words) or ''}{r.choice(words) or ''}", r.choice([{}, {"kind": "k1"}, {"kind": None}])) for n in range(400)]
    df = messages(spark, rows, "idx long, programname string, hostname string, msg string, structured map<string,string>")
    rules = detect.parse_rules(RULES)
    key = lambda x: (x.rule_ord, x.title, x.level, x.n)
    frame = detect_index.rule_frame(spark, rules)
    want = sorted(map(key, detect.fires(df, rules).collect()))
    assert sum(n > 0 for *_, n in want) >= 6
    assert sorted(map(key, detect_index.indexed_fires(df, frame).collect())) == want
    firsts = lambda d: sorted(map(tuple, d.select("rule_ord", "idx").collect()))
    assert firsts(detect_index.indexed_samples(df, frame)) == firsts(detect.fired_samples(df, rules))


def test_index_in_several_passes_and_without_rules(spark, monkeypatch):
    df = messages(spark, [(n, "p", "h", f"word{n % 7} and more") for n in range(60)])
    rules = detect_index.templated_rules(spark.range(10), "id", {"title": "t{id}", "detection": {"selection": {"msg|contains": "word{id} "}}})
    want = sorted((n % 7, n) for n in range(60))
    assert sorted(tuple(r) for r in detect_index.fired(df, rules).select("rule_ord", "idx").collect()) == want
    monkeypatch.setattr(detect_index, "PASS_CHARS", 16)
    monkeypatch.setattr(detect_index, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in detect_index.fired(df, rules).select("rule_ord", "idx").collect()) == want
    assert detect_index.fired(df, rules.limit(0)).collect() == [] and detect_index.fired(df.limit(0), rules).collect() == []


def test_rules_share_their_parts(spark):
    """The pairs of messages and parts do not grow with rules that say the same; shared, overlapping and folded parts count each message once."""
    df = messages(spark, [(n, "p" if n % 3 else "q", "h", f"Word{n % 5} tail{n % 4} {'WORD1' * (n % 2)}") for n in range(120)])
    template = {"title": "t{id}", "detection": {"a": {"msg|contains": ["Word{w}", "tail{v}"]}, "b": {"msg|i|contains|all": ["word{w}", "WORD1"]}, "no": {"programname": "q"}, "condition": "1 of a or b and not no"}}
    rows = lambda n: spark.range(n).selectExpr("id", "id % 5 AS w", "id % 3 AS v")
    held = [detect_index._held(df, detect_index.templated_rules(rows(n), "id", template))[0].count() for n in (15, 300)]
    assert held[0] == held[1] > 0
    fires = lambda w, v, n: f"Word{w}" in (m := f"Word{n % 5} tail{n % 4} {'WORD1' * (n % 2)}") or f"tail{v}" in m or (f"word{w}" in m.lower() and "word1" in m.lower() and n % 3 > 0)
    found = {k: [n for n in range(120) if fires(k % 5, k % 3, n)] for k in range(40)}
    rules = detect_index.templated_rules(rows(40), "id", template)
    assert {r.rule_ord: r.n for r in detect_index.indexed_fires(df, rules).collect()} == {k: len(v) for k, v in found.items()}
    assert sorted(map(tuple, detect_index.indexed_samples(df, rules).select("rule_ord", "idx").collect())) == sorted((k, n) for k, v in found.items() for n in v[:5])


def test_plan_does_not_grow_with_the_rules(spark):
    df = messages(spark, [(1, "p", "h", "m")])
    size = lambda n: len(detect_index.fired(df, detect_index.templated_rules(spark.range(n), "id", {"title": "t", "detection": {"selection": {"msg|contains": "w{id}"}}}))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(5) - size(500)) < 200


# --- trees ---


def flat(spark, rows):
    return spark.createDataFrame(rows, trees.STATEMENTS)


def test_intervals_of_deep_and_odd_trees(spark):
    chain = [("c", "deep", k, k - 1 if k else None, "then", 0, "If") for k in range(12)]
    rows = chain + [("c", "r", 100, None, "body", 1, "If"), ("c", "r", 101, 100, "then", 0, "Set"), ("c", "r", 102, 100, "then", 0, "Stop"), ("c", "r", 103, 100, "else", 0, "Action"), ("c", "r", 104, None, "body", 0, "Set")]
    rows += [("d", "r", 100, None, "body", 0, "Call"), ("c", "lost", 200, 999, "then", 0, "Set"), ("c", "loop", 300, 301, "then", 0, "If"), ("c", "loop", 301, 300, "then", 0, "If")]
    got = {(r.config, r.id): (r.depth, r["pre"], r["last"], r.terminal) for r in trees.intervals(flat(spark, rows)).collect()}
    assert got[("c", 0)] == (0, 1, 12, False) and got[("c", 11)] == (11, 12, 12, False)
    assert [got[("c", k)] for k in (104, 100, 101, 102, 103)] == [(0, 1, 1, False), (0, 2, 5, True), (1, 3, 3, False), (1, 4, 4, True), (1, 5, 5, True)]
    assert got[("d", 100)] == (0, 1, 1, True) and not {200, 300, 301} & {k for _, k in got}
    assert trees.intervals(flat(spark, [])).collect() == []


def test_a_round_meets_only_what_is_not_placed_yet(spark, monkeypatch):
    met, real = [], trees.written

    def counted(df):
        met.append(real(df))
        return met[-1]

    monkeypatch.setattr(trees, "written", counted)
    chain = [("c", "deep", k, k - 1 if k else None, "then", 0, "If") for k in range(6)]
    assert [x.count() for x in trees.leveled(flat(spark, chain))] == [1] * 6
    assert [x.count() for x in met] == [6, 5, 4, 3, 2, 1]


def test_intervals_of_any_tree(spark):
    r, rows = random.Random(7), []
    for k in range(90):
        up = r.choice([None] + [x[2] for x in rows if x[0] == f"c{k % 3}"][-20:])
        ruleset = f"r{k % 2}" if up is None else next(x[1] for x in rows if x[2] == up)
        rows.append((f"c{k % 3}", ruleset, k, up, "body" if up is None else r.choice(["then", "else", "then", None]), r.choice([0, 1, 2, None]), r.choice(["If", "Set", "Stop", "Action", None])))
    rows += [("c0", "r0", 900, 901, "then", 0, "If"), ("c0", "r0", 901, 900, "then", 0, "If"), ("c0", "r0", 902, None, None, None, "Set")]
    low = lambda v: (v is not None, v)
    order = lambda x: ((x[4] is not None, x[4] == "else"), low(x[5]), x[2])
    want = {}

    def walk(x, depth, pre):
        below = sorted((y for y in rows if y[3] == x[2]), key=order)
        ends, next_ = {}, pre + 1
        for y in below:
            last, ends[y[4]] = walk(y, depth + 1, next_)
            next_ = last + 1
        simple = None if x[6] is None else x[6] in trees.TERMINAL
        whole = bool(ends.get("then") and ends.get("else")) if x[6] == "If" else simple
        want[x[2]] = (depth, pre, next_ - 1, whole)
        return next_ - 1, whole

    for place in {(x[0], x[1]) for x in rows}:
        at = 1
        for x in sorted((x for x in rows if x[3] is None and (x[0], x[1]) == place), key=order):
            at = walk(x, 0, at)[0] + 1
    assert {x.id: (x.depth, x["pre"], x["last"], x.terminal) for x in trees.intervals(flat(spark, rows)).collect()} == want


def test_lines_meet_their_parents_in_one_reading(spark, tmp_path):
    """As the SQL of the view has it, for lines without numbers, and for what hangs below itself, too."""
    lines = [(o, n, f) for o in (1, 2) for n, f in ((1, "A"), (2, "N"), (2, "A"), (4, None), (5, "R"), (7, "N"), (None, "A"), (0, "A"), (-3, "N"), (-2, "A"))] + [(3, 3, "A"), (3, 1, None), (3, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    nested = table_queries.view(spark, str(tmp_path), "nested")
    assert nested._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    columns = "config, ruleset, id, parent, branch, ord, kind"
    want = duckdb.sql(table_queries._with("nested").replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'") + f"z AS (SELECT 1) SELECT {columns} FROM nested").fetchall()
    assert sorted(map(repr, map(tuple, nested.select(*columns.split(", ")).collect()))) == sorted(map(repr, want))


def test_branches_that_drop(spark):
    config = parse_config("""
    ruleset(name="a") { if $msg == "1" then { set $.x = "1"; } else { stop } }
    ruleset(name="b") { if $msg == "1" then { if $msg == "2" then stop } stop }
    ruleset(name="empty") { }
    ruleset(name="helper") { set $.x = "1"; }
    ruleset(name="main") { call helper }
    """)
    rel = catalog.relations(spark, {"": config})
    drops = [(r.code, r.name) for r in catalog.general_findings(rel).filter("code LIKE 'V_SILENT%'").collect()]
    assert sorted(drops) == [("V_SILENT_DROP", "a"), ("V_SILENT_DROP", "empty"), ("V_SILENT_DROP_BRANCH", "a"), ("V_SILENT_DROP_BRANCH", "b")]


# --- graphs ---


def test_reached_equals_a_walk(spark):
    r = random.Random(4)
    edges = [(r.choice("ab"), r.randint(0, 40), r.randint(0, 40)) for _ in range(70)] + [("a", 50, 50), ("a", 51, 52), ("a", 52, 51), ("b", None, 3), (None, 1, 2)]
    seeds = [("a", 1), ("a", 1), ("b", 7), ("a", 51), ("c", 9), ("a", None)]
    frame = spark.createDataFrame([(g, None if a is None else str(a), str(b)) for g, a, b in edges], "graph string, src string, dst string")
    start = spark.createDataFrame([(g, None if n is None else str(n)) for g, n in seeds], "graph string, node string")
    out = defaultdict(set)
    for g, a, b in edges:
        if g is not None and a is not None:
            out[(g, a)].add((g, b))

    def walk(out, nodes):
        seen, todo = set(), list(nodes)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        return {(g, str(n)) for g, n in seen}

    valid = {s for s in seeds if s[1] is not None}
    assert {tuple(x) for x in graph.reached(frame, start).collect()} == walk(out, valid)
    back = defaultdict(set)
    for (g, a), ends in out.items():
        for _, b in ends:
            back[(g, b)].add((g, a))
    assert {tuple(x) for x in graph.reached(graph.reversed_edges(frame), start).collect()} == walk(back, valid)
    assert graph.reached(frame.limit(0), start.limit(0)).collect() == []


def test_edges_go_to_the_steps_without_a_shuffle(spark, monkeypatch):
    """Repeated edges are followed, but found nodes count once; rows are told apart by node before graph."""
    plans, real = [], graph.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(graph, "written", seen)
    frame = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("h", "c", "d")] * 50, "graph string, src string, dst string")
    start = spark.createDataFrame([("g", "a")], "graph string, node string")
    assert sorted(map(tuple, graph.reached(frame, start).collect())) == [("g", "a"), ("g", "b"), ("g", "c")]
    assert "Exchange" not in plans[0] and "Aggregate" not in plans[0]
    assert all("hashpartitioning(node#" in p or "hashpartitioning(next#" in p for p in plans[1:]) and not any("hashpartitioning(graph#" in p for p in plans)
    assert [tuple(r) for r in graph.feeding_sources(frame, spark.createDataFrame([("g", "c")], "graph string, node string"), start).collect()] == [("g", "c", "a")]


def test_sources_of_sinks(spark):
    edges = [("g", "s1", "t1"), ("g", "t1", "t2"), ("g", "t2", "t1"), ("g", "t2", "k1"), ("g", "s2", "k1"), ("g", "s0", "s1"), ("g", "s3", "k2"), ("h", "s1", "k1")]
    frame = spark.createDataFrame(edges, "graph string, src string, dst string")
    node = lambda *names: spark.createDataFrame([("g", n) for n in names], "graph string, node string")
    got = {(r.sink, r.source) for r in graph.feeding_sources(frame, node("k1", "k2", "k3", "s1"), node("s0", "s1", "s2", "s3")).collect()}
    assert got == {("k1", "s1"), ("k1", "s2"), ("k2", "s3"), ("s1", "s1")}


# --- tags and names ---


@pytest.mark.parametrize("dotted", [False, True])
def test_tag_patterns(spark, dotted):
    names = ["app", "app.x", "app.x.y", "apple", "", None, "*", "app.*", "db"]
    patterns = ["app.*", "app*", "*", "", None, "app", "app.**", "**", "app.x", "*.x", "a*p.x", "app.x.**"]

    def fits(tag, p):
        p = p or ""
        if tag is None:
            return False
        if dotted:
            return p in ("*", "**", tag) or p.endswith(".**") and (tag == p[:-3] or tag.startswith(p[:-2]))
        return p == "" or tag.startswith(p[:-1]) if p.endswith("*") or not p else tag == p

    left = spark.createDataFrame([(k, t) for k, t in enumerate(names)], "`a.b` int, tag string")
    right = spark.createDataFrame([(k, p) for k, p in enumerate(patterns)], "ord int, pattern string").withColumn("route", F.col("ord"))
    df = tags.matched_tags(left, right, dotted)
    assert sorted((r["a.b"], r.ord) for r in df.collect()) == sorted((i, j) for i, t in enumerate(names) for j, p in enumerate(patterns) if fits(t, p))
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    assert {r["a.b"]: r.routes for r in tags.routed_tags(left, right, dotted).collect()} == {i: [j for j, p in enumerate(patterns) if fits(t, p)] or None for i, t in enumerate(names)}
    assert tags.matched_tags(left, right.limit(0)).collect() == [] and tags.matched_tags(left.limit(0), right).collect() == []


def plain_distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_nearest_names_equal_all_pairs(spark):
    r = random.Random(5)
    known = ["main_audit", "Main", "ab", "a", "", None, "sshd", "a" * 30, "ca", "abc"] + ["".join(r.choice("abc_") for _ in range(r.randint(1, 9))) for _ in range(60)]
    asked = ["mani_aduit", "ssdh", "ac", "b", "", None, "MAIN", "a" * 27, "ba"] + ["".join(r.choice("abc_") for _ in range(r.randint(1, 10))) for _ in range(60)]
    frame = lambda names: spark.createDataFrame([("c", "k", n) for n in names], "config string, kind string, name string")
    want = {}
    for a in filter(None, asked):
        limit = min(1 if len(a) <= 3 else 2 if len(a) <= 7 else 3, max(1, int(len(a) * 0.4)))
        near = sorted((plain_distance(a.lower(), k.lower()), k) for k in filter(None, known) if k != a)
        if near[0][0] <= limit:
            want[a] = near[0][1]
    assert {x.name: x.suggestion for x in catalog.suggestions(frame(asked), frame(known)).collect()} == want and want["mani_aduit"] == "main_audit"
    pairs = spark.createDataFrame([(a, b) for a in asked for b in known if a is not None and b is not None], "a string, b string")
    for distance in (alignment_distance, edit_distance):
        assert all(x.d == plain_distance(x.a, x.b) for x in pairs.select("a", "b", distance(F.col("a"), F.col("b")).alias("d")).collect())
    assert catalog.suggestions(frame([]), frame([])).collect() == []


# --- order of lines ---


def test_lines_in_order_over_files_and_stretches(spark, tmp_path):
    want = []
    for name, n in (("a.log", 4000), ("b.log", 0), ("c.log", 1), ("d/e.log", 3000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [f"{name} {k}" if k % 50 else "" for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = read_ordered_lines(spark, str(tmp_path))
        rows = sorted((r.idx, r.value) for r in df.collect())
        assert rows == list(enumerate(want, 1)) and df.rdd.getNumPartitions() > 4
        assert sorted(r.idx for r in first_messages(df, 4100).collect()) == list(range(1, 4101))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# --- growth ---


def test_tags_are_counted_by_distinct_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(["a.b", "a.c", "b", None][n % 4],) for n in range(40)], "tag string")
    patterns = spark.createDataFrame([(p, k) for k, p in enumerate(["a.*", "a.*", "a.b", "*", "", None, "z*", "b"])], "pattern string, ord int")
    want = sorted((r.pattern or "", r.ord, r["count"]) for r in tags.matched_tags(rows, patterns).groupBy("pattern", "ord").count().collect())
    met, plain = [], tags.matched_tags
    monkeypatch.setattr(tags, "matched_tags", lambda *a: met.append(plain(*a).count()) or plain(*a))
    assert sorted((r.pattern or "", r.ord, r.n) for r in tags.counted_tags(rows, patterns).collect()) == want
    assert met == [2 + 1 + 3 + 3 + 3 + 1]


def test_a_source_that_nothing_feeds(spark, tmp_path):
    """A customer without orders feeds its nation, and the region of that, as the SQL says."""
    tables = {
        "orders": ("o_orderkey long, o_custkey long", [(1, 10)]), "customer": ("c_custkey long, c_nationkey int", [(10, 0), (11, 7)]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (7, 1)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.sink, r.source) for r in table_queries.QUERIES["feeding_sources"][0](spark, str(tmp_path)).collect()}
    assert got == {("r0", "c10"), ("r1", "c11")}


def test_rulesets_do_not_meet_all_their_callers(spark, tmp_path):
    """Orders 4200k + 600 call (remainder 1 by 7) what orders 4200k are; the ruleset of order 50 has no caller."""
    lines = [(4200 * k, 1, "N") for k in range(40)] + [(4200 * k + 600, n, "R") for k in range(40) for n in (1, 3)] + [(50, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    nested = table_queries.view(spark, str(tmp_path), "nested")
    called = table_queries._called(nested, trees.intervals(nested))
    assert called.count() == called.distinct().count() == 40
    drops = table_queries.QUERIES["silent_drops"][0](spark, str(tmp_path)).collect()
    assert sorted((r.code, r.ruleset) for r in drops) == sorted([("V_SILENT_DROP", "r50")] + [("V_SILENT_DROP", f"r{4200 * k + 600}") for k in range(40)])


def test_outputs_are_read_once_for_all_checks_of_stores(spark):
    config = parse_config('ruleset(name="r") { action(type="loki" labels="a=$!user, b=%pid%") action(type="gelf" fields="host=x,bad=2,_ok=1,worse=3") action(type="leef" vendor="v") action(type="cef" severity="high") action(type="splunk") }')
    found = catalog.store_findings(catalog.relations(spark, {"": config}))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
    assert sorted((r.code, r.message) for r in found.collect()) == [
        ("SIEM_CEF_SEVERITY_OUT_OF_RANGE", "severity is not in 0..10: high"), ("SIEM_GELF_CUSTOM_FIELD_PREFIX", "a field of its own needs an underscore: bad"), ("SIEM_GELF_CUSTOM_FIELD_PREFIX", "a field of its own needs an underscore: worse"),
        ("SIEM_LEEF_HEADER_INCOMPLETE", "header lacks product, version, eventID"), ("SIEM_LOKI_HIGH_CARDINALITY_LABEL", "a label comes from pid"), ("SIEM_LOKI_HIGH_CARDINALITY_LABEL", "a label comes from user"), ("SIEM_SPLUNK_MISSING_SOURCETYPE", "no sourcetype"),
    ]


def test_names_of_a_store_are_keys_that_are_looked_up(spark):
    """Only what has no name there is searched for, not each name in turn."""
    for name, most in (("chronicle-udm", 40), ("elastic-ecs", 40)):
        df = spark.createDataFrame([({"time": "1", "odd": None, "metadata.product.name": None},), (None,), ({},)], "event map<string,string>").select(siem.render(TARGETS[name]).alias("line"))
        assert df._jdf.queryExecution().analyzed().toString().count("lambdafunction(") <= most
        lines = [r.line for r in df.collect()]
        assert '"odd"' in lines[0] or "additional" in lines[0]
