from sluiceway.operators import expect
from sluiceway.plans.routing import evaluate
from sluiceway.sources.config import parse_config
from sluiceway.sources.messages import with_properties
from sluiceway.sources.ndjson import read_line_array
from sluiceway.sources.tree import included, load_tree


def test_files_come_once_in_reading_order():
    files = {"/a": 'include(file="/d/*.conf")\ninclude(file="x")\ninclude(file="x")\n', "/d/2.conf": "$IncludeConfig /a\n", "/d/1.conf": 'include(file="sub/n")', "/d/sub/n": "", "/d/sub/m.conf": ""}
    paths, notes = included(files, "/a")
    assert paths == ["/a", "/d/1.conf", "/d/sub/n", "/d/2.conf"]
    assert [(n[0], n[2]) for n in notes] == [("W_INCLUDE_MISSING", "x")]
    assert included({}, "/a")[1][0][:2] == ("E_ENTRYPOINT_MISSING", "error")


def test_lookup_files_are_found_by_their_end():
    table = 'lookup_table(name="t" file="/etc/tables/t.json")\nlookup_table(name="u" file="u.json")\n'
    config, notes = load_tree({"/e": table, "/x/t.json": '{"a": "1"}', "/y/tables/t.json": '{"a": "2"}'}, "/e")
    assert config.lookups["t"].entries == {"a": "2"} and not config.lookups["u"].loaded
    assert [n[0] for n in notes] == ["I_LOOKUP_ELSEWHERE", "W_LOOKUP_MISSING"]


def test_selectors_come_before_other_top_level_tests():
    config = parse_config('if prifilt("mail.*") then action(type="omfile" file="/b")\nmail.* /a\n')
    assert [s.then[0].param("file") for s in config.rulesets["_default_legacy"]] == ["/a", "/b"]


def test_expectations(spark):
    rows = with_properties(spark.createDataFrame([(1, "udp", 514, "m", "<34>m")], "idx long, transport string, port int, msg string, rawmsg string"))
    done = evaluate(rows, parse_config('input(type="imudp" port="514" ruleset="r")\nruleset(name="r") { set $!k = "v"; action(type="omfwd" target="h" port="9" protocol="tcp") stop }'))
    out = lambda **k: (k.get("kind"), k.get("path_contains"), k.get("target"), k.get("port"), k.get("protocol"))
    asked = [
        ("nothing", 1, None, None, None, None, None, None), ("all", 1, "r", True, False, [out(target="h", port=9)], {"k": "v"}, {}),
        ("wrong", 1, "q", False, None, [out(port=8), out()], {"k": "w", "none": "x"}, {"none": "y"}), ("absent", 2, "r", None, None, [out()], None, None), ("null id", None, None, None, None, None, None, None),
    ]
    got = {r.test: (r.passed, r.failures) for r in expect.results(expect.checks(done, spark.createDataFrame(asked, expect.EXPECTED))).collect()}
    assert got == {
        "nothing": (True, []), "all": (True, []), "wrong": (False, ["localVars.none", "outputsContains", "ruleset", "stopped", "structured.k", "structured.none"]),
        "absent": (False, ["message", "outputsContains", "ruleset"]), "null id": (False, ["message"]),
    }
    assert expect.summary(expect.results(expect.checks(done, spark.createDataFrame([], expect.EXPECTED)))).first() == (0, 0, 0)


def test_line_arrays_of_odd_bodies(spark):
    bodies = spark.createDataFrame([(1, '["a", 2, {"b": 1}, ""]'), (2, "[]"), (3, "no"), (4, None), (5, '{"a": 1}')], "idx long, value string")
    lines, notes = read_line_array(bodies)
    assert [tuple(r) for r in lines.orderBy("row").collect()] == [(1, 1, "a"), (1, 4, "")]
    assert [(r.idx, r.row) for r in notes.orderBy("row").collect()] == [(1, 2), (1, 3)]
