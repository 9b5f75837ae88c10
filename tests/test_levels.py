from pyspark.sql import functions as F

from sluiceway.plans.levels import Levels
from sluiceway.plans.routing import evaluate
from sluiceway.sources.config import parse_config
from sluiceway.sources.messages import read_lines, with_properties


def projections(df):
    return df._jdf.queryExecution().analyzed().toString().count("Project [")


def test_independent_columns_share_a_projection(spark):
    levels = Levels(spark.createDataFrame([(1, None)], "`a.b` int, c int"), "t_")
    tests = [levels.keep(F.col("`a.b`") + k) for k in range(50)]
    sums = [levels.keep(F.col(t) * 10 + F.col(tests[0])) for t in tests]
    levels.keep(F.col(sums[0]))
    last = levels.keep(F.coalesce("c", F.array(*map(F.col, sums))[49]))
    rows = levels.lay_out({last, tests[3]})
    assert rows.columns == ["a.b", "c", tests[3], last] and projections(rows) == 3
    assert [tuple(r) for r in rows.collect()] == [(1, None, 4, 50 * 10 + 1)]
    after = levels.keep(F.col(last) + F.col(tests[3]))
    assert levels.lay_out().select(after).first()[0] == 505


def test_names_that_texts_hold_do_no_harm(spark):
    levels = Levels(spark.range(1), "t_")
    a = levels.keep(F.lit("_t_2 and _t_99"))
    b = levels.keep(F.concat(F.lit(f"{a}: "), F.col(a), F.lit("_t_12")))
    assert levels.lay_out({b}).select(b).first()[0] == "_t_1: _t_2 and _t_99_t_12"


def test_many_statements_make_few_projections(spark):
    lines = with_properties(read_lines(spark.createDataFrame([("<13>Jan  2 03:04:05 h app: up 7",)], "value string")))
    shown = {}
    for n in (10, 60):
        body = "\n".join(f'if $msg contains "{i}" then set $.v{i} = "x{i}";' for i in range(n))
        shown[n] = evaluate(lines, parse_config('input(type="imudp" port="514" ruleset="r")\nruleset(name="r") {\n' + body + '\nset $.all = $.v7 & "!";\naction(type="omfile" file="/a")\n}\n', {}))
    assert projections(shown[10]) == projections(shown[60])
    r = shown[60].select("outputs", "vars").first()
    assert r.vars == {"v7": "x7", "all": "x7!"} and r.outputs[0].label == "/a"
