"""Rules that fail beside rules that hold."""

from loomwright.operators import dispatch as di


def test_faults_stay_alone(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x"), (None, ""), (4, None)], "n int, s string")
    rules = [
        di.Rule("null", "required_fields", "error", {"columns": ["n"]}), di.Rule("half", "min_value", "info", {"column": "n", "least": 2}, 0.5), di.Rule("type", "nothing"), di.Rule("column", "min_value", "info", {"column": "z", "least": 2}),
        di.Rule("parameters", "value_range", "info", {"column": "n"}), di.Rule("kind", "condition", "info", {"broken": "n + 1"}), di.Rule("syntax", "condition", "info", {"broken": "n >"}), di.Rule("run", "condition", "info", {"broken": "CAST(s AS INT) > 3"}),
    ]
    got = {r.rule: r for r in di.validated(df, rules).collect()}
    assert (got["null"].affected, got["null"].violated, got["null"].severity) == (1, True, "error") and (got["half"].affected, got["half"].violated) == (1, False)
    assert {k: r.error for k, r in got.items() if r.error} == {
        "type": "unknown rule type nothing", "column": "UNRESOLVED_COLUMN.WITH_SUGGESTION", "parameters": "TypeError", "kind": "a condition of type integer", "syntax": "PARSE_SYNTAX_ERROR", "run": "CAST_INVALID_INPUT"}
    assert all(r.severity == "error" and r.affected == 1 and r.items == 4 for r in got.values() if r.error)
    assert [r.affected for r in di.validated(df.where("false"), rules[:2]).collect()] == [0, 0] and di.validated(df, []).collect() == []


def test_policies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", None)], "id string, n int")
    high = di.Rule("high", "value_range", "error", {"column": "n", "least": 0, "most": 5})
    results = di.evaluated(df, "id", [di.Policy("p", high, True), di.Policy("q", di.Rule("gone", "min_value", "error", {"column": "z", "least": 1}), True), di.Policy("off", high, True, False)])
    got = {r.id: (r.policies, r.passed, r.failed, r.errors, r.blocked) for r in di.summarised(results, "id").collect()}
    assert got == {"a": (2, 1, 0, 1, False), "b": (2, 0, 1, 1, True), "c": (2, 1, 0, 1, False)}
    assert di.evaluated(df, "id", []).collect() == []


def test_isolated_parts(spark):
    found, faults = di.isolated({"good": lambda: spark.range(3), "bad": lambda: spark.read.parquet("/no/such/path"), "odd": lambda: spark.range(1).select("x")})
    assert list(found) == ["good"] and set(faults) == {"bad", "odd"}
