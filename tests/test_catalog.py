import time

import pytest
from pyspark.sql import functions as F

from sluiceway.operators.catalog import reachable, validate
from sluiceway.plans.routing import evaluate
from sluiceway.sources.config import parse_config, parse_lookup
from sluiceway.sources.messages import decode_line, structured_data, with_properties


def run(spark, text, lookups=None, **fields):
    row = {"idx": 1, "transport": "udp", "port": 514, "programname": "sshd", "hostname": "h1", "msg": "hello 42", "rawmsg": "<34>hello 42"} | fields
    df = with_properties(spark.createDataFrame([row]))
    return evaluate(df, parse_config('input(type="imudp" port="514" ruleset="r")\n' + text, lookups)).first()


@pytest.mark.parametrize("test, truth", [
    ("1 + 2 == 3", True), ('"12abc" > 9', True), ('"b" > "a"', True), ("1 / 0 == 0", True), ('$msg contains ["x", "hello"]', True), ('$msg startswith_i "HELLO"', True), ('$msg =~ "4[0-9]$"', True),
    ('$msg =~ "("', False), ('tolower("AB") & toupper("c") == "abC"', True), ('substring("abcdef", 1, 3) == "bcd"', True), ('field("a,b,c", ",", 2) == "b"', True), ('re_extract($msg, "([0-9]+)", 0, 1, "none") == "42"', True),
    ('prifilt("auth.crit")', True), ('prifilt("mail.*")', False), ('not ($hostname == "h1") or strlen($msg) == 8', True), ('"false"', True), ('"0"', False), ('cnum("7x") % 4 == 3', True), ('wrap("", "<", ">") == ""', True),
])
def test_expressions(spark, test, truth):
    out = run(spark, f'ruleset(name="r") {{ if {test} then action(type="omfile" file="/a") }}')
    assert [o.path for o in out.outputs] == (["/a"] if truth else [])


def test_state_stop_and_call(spark):
    text = """
    template(name="t" type="string" string="%$.x%-%hostname:::uppercase%")
    ruleset(name="sub") { if $.x == "two" then stop }
    ruleset(name="r") { set $.x = "one"; action(type="omfile" dynaFile="t") set $.x = "two"; call sub
      action(type="omfile" file="/never") }
    """
    out = run(spark, text)
    assert [o.path for o in out.outputs] == ["one-H1"] and out.stopped and out.vars == {"x": "two"}


def test_selectors_and_no_match(spark):
    out = run(spark, 'auth.*  @@h:601\nmail.* /var/log/mail\n:msg, contains, "hello" -/var/log/hello\n', port=514)
    assert out.ruleset == "r" and out.outputs == []
    df = with_properties(spark.createDataFrame([{"idx": 1, "transport": "udp", "port": 1, "msg": "hello", "rawmsg": "<34>hello"}]))
    lone = evaluate(df, parse_config('auth.*  @@h:601\nmail.* /var/log/mail\n:msg, contains, "hello" -/var/log/hello\n')).first()
    assert [o.label for o in lone.outputs] == ["h:601/tcp", "/var/log/hello"]


def test_checks(spark):
    config = parse_config("""
    input(type="imudp" ruleset="r")
    template(name="unused" type="string" string="x")
    ruleset(name="r") { if $msg == "a" then call daed call gone  action(type="omfile" file="/a") action(type="omfile" file="/a") }
    ruleset(name="dead") { set $.x = "1"; }
    """)
    found = {(r.code, r.name) for r in validate(spark, config).collect()}
    assert {("V_UNDEFINED_RULESET", "gone"), ("V_DEAD_RULESET", "dead"), ("V_UNUSED_TEMPLATE", "unused"), ("V_CONFLICTING_OUTPUT", "/a"), ("V_SILENT_DROP", "dead")} <= found
    said = {r.name: r.message for r in validate(spark, config).collect() if r.code == "V_UNDEFINED_RULESET"}
    assert said["daed"].endswith("did you mean dead?") and "mean" not in said["gone"]
    assert reachable(config) == {"r", "gone", "daed"}


def test_lookup_shapes():
    assert parse_lookup('{"nomatch": "n", "table": [{"index": "a", "value": "b"}, {"index": 1, "value": "c"}]}').entries == {"a": "b"}
    assert parse_lookup('{"a": 1, "b": true, "c": [1]}').entries == {"a": "1", "b": "true"}
    assert parse_lookup('[{"k": "a", "val": "b"}]').entries == {"a": "b"}


def test_decoding(spark):
    lines = ['<165>1 2003-10-11T22:14:15Z host app 77 ID [x@1 k="a\\"b" j="c"] body', "<34>Oct 11 22:14:15 mymachine su[9]: failed", "Oct 11 22:14:15 h prog: text", "<13>rest", "plain"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, v string").select("k", decode_line(F.col("v")).alias("m")).select("k", "m.*", structured_data(F.col("m.sd")).alias("map"))
    got = df.orderBy("k").collect()
    assert [r.format for r in got] == ["rfc5424", "rfc3164", "received", "unknown", "unknown"]
    assert got[0].map == {"x@1_k": 'a"b', "x@1_j": "c"} and got[0].msg == "body" and got[0].syslogtag == "app[77]:"
    assert (got[1].programname, got[1].procid, got[1].msg) == ("su", "9", "failed") and got[2].rawmsg.startswith("<13>") and got[3].msg == "rest"


def test_many_assignments(spark):
    """The plan grows with the statements: a hundred that read themselves, and forty stops."""
    sets = "".join('set $.x = $.x & "b"; ' for _ in range(100))
    began = time.time()
    assert len(run(spark, f'ruleset(name="r") {{ {sets} }}').vars["x"]) == 100
    stops = "".join(f'if $msg == "m{k}" then stop ' for k in range(40))
    assert run(spark, f'ruleset(name="r") {{ {stops} action(type="omfile" file="/a") }}').outputs[0].path == "/a"
    assert time.time() - began < 60


def test_json_and_missing(spark):
    text = 'ruleset(name="r") {{ action(type="mmjsonparse") action(type="omfile" dynafile="none") }}'
    for msg, fields, ok in (('@cee:{"a": "x", "b": null, "c": {"d": [1, true]}}', {"a": "x", "b": "", "c": '{"d":[1,true]}'}, True), ("[1]", {}, False), ("{bad", {}, False), ("", {}, False)):
        out = run(spark, text.format(), msg=msg)
        assert out.fields == fields and out.notes == ["W_TEMPLATE_MISSING"] and len(out.outputs) == 1
    assert run(spark, "", msg="x").notes == ["W_RULESET_MISSING"]


def test_loose_lines(spark):
    lines = ["<34>Oct 1 22:14:15 mach su[9]: failed", "<34>Oct 1 22:14:15 mach su[x]: failed", "Oct 1 22:14:15 h a b: t", '<34>1 - - - - - [a k="v]"][b] body', "<34>2 a b", ""]
    got = [r.m for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, v string").orderBy("k").select(decode_line(F.col("v")).alias("m")).collect()]
    assert (got[0].hostname, got[0].programname, got[0].procid, got[0].msg) == ("mach", "su", "9", "failed")
    assert (got[1].programname, got[1].msg) == (None, "su[x]: failed") and (got[2].programname, got[2].syslogtag) == ("a", "a b:")
    assert (got[3].hostname, got[3].sd, got[3].msg) == (None, '[a k="v]"][b]', "body") and (got[4].format, got[4].msg) == ("unknown", "2 a b") and got[5].msg == ""


def test_reading_goes_on_after_what_cannot_be_read():
    config = parse_config("""
    set $.x = ;
    ruleset(name="r") {
      set $.y = "1" "2";
      if then stop
      action(type="omfile" file="/a")
    }
    module(load=
    """)
    assert [line for line, _ in config.problems] and {line for line, _ in config.problems} >= {2, 4}
    assert any(getattr(s, "kind", "") == "omfile" for s in config.rulesets["r"])
    assert parse_config('ruleset(name="r") { stop').problems and parse_config('template(name="t" type="list") {').problems and parse_config("if (").problems
    assert parse_config('include(file="a.conf")\n$IncludeConfig b/*.conf # all\n').includes == ["a.conf", "b/*.conf"]
