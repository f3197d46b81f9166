import datetime as dt
import math

import pytest

from weft.errors import GraphError

CASES = [
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("7 % -3", 1), ("-7 % 3", -1), ("2 ^ 3", 8.0), ("7 / 2.0", 3.5), ("1 + 1.5", 2.5),
    ('"a" + "b"', "ab"), ("[1] + [2, 3]", [1, 2, 3]), ("null + 1", None), ("-(-9223372036854775808 + 1)", 9223372036854775807),
    ("1 = 1.0", True), ("9007199254740993 = 9007199254740992.0", False), ('1 = "1"', None), ("true < false", None), ("null = null", None), ("NaN = NaN", True), ("NaN > Inf", True),
    ("[1, 2] < [1, 3]", True), ("[1] < [1, 0]", True), ("true XOR true", False), ("true XOR null", None), ("true OR null", True), ("false AND null", False), ("NOT null", None),
    ("1 IN [1, null]", True), ("2 IN [1, null]", None), ("2 IN []", False), ("null IN [1]", None), ("null IN []", False),
    ('"abc" STARTS WITH "ab"', True), ('"abc" CONTAINS "x"', False), ('null STARTS WITH "a"', None),
    ("[1, 2, 3][0]", 1), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3][-5]", None), ("[1, 2, 3, 4][1..3]", [2, 3]), ("[1, 2, 3][-2..]", [2, 3]), ("[1, 2, 3][2..1]", []), ("[1, 2][0..99]", [1, 2]),
    ("{a: 1, b: 2}.b", 2), ("{a: 1}.z", None), ('{a: 1}["a"]', 1),
    ("[x IN [1, 2, 3] WHERE x > 1 | x * 2]", [4, 6]), ("[x IN [1, 2, 3] WHERE x > 1]", [2, 3]), ("[x IN null | x]", None),
    ("ALL(x IN [null] WHERE x > 0)", False), ("ALL(x IN [] WHERE x > 0)", True), ("NONE(x IN [] WHERE x > 0)", True), ("SINGLE(x IN [1, 2] WHERE x > 1)", True), ("ANY(x IN [1, 2] WHERE x > 2)", False),
    ("REDUCE(s = 0, x IN [1, 2, 3] | s + x)", 6), ("REDUCE(s = 0, x IN [1, 2.5] | s + x)", 3.5), ('REDUCE(s = "", x IN ["a", "b"] | s + x)', "ab"),
    ("CASE WHEN null THEN 1 WHEN true THEN 2 ELSE 3 END", 2), ("CASE 1 WHEN null THEN 1 WHEN 1.0 THEN 2 END", 2), ("CASE null WHEN null THEN 1 ELSE 2 END", 2),
    ("1 IS :: INT", True), ("1.0 IS :: INT", False), ("null IS :: NULL", True), ("null IS :: INT", False), ("1 IS NOT :: STRING", True),
    ('toUpper("aé")', "AÉ"), ('trim("\\t x\\u00a0")', "x"), ('size("añb")', 3), ("size([1, 2])", 2), ("size({a: 1})", 1), ('split("a.b", ".")', ["a", "b"]), ('split("", ",")', [""]),
    ('substring("hello", 1)', "ello"), ('substring("hello", 1, 2)', "el"), ('substring("hi", 9)', ""), ('replace("aXbX", "X", "-")', "a-b-"), ('contains("abc", "b")', True),
    ("abs(-3)", 3), ("abs(-3.5)", 3.5), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("ceil(3)", 3), ("sqrt(9)", 3.0), ("sign(-2)", -1), ("sign(NaN)", None), ("pow(2, 3)", 8.0),
    ("range(1, 5, 2)", [1, 3, 5]), ("range(3, 1)", []), ("range(3, 1, -1)", [3, 2, 1]), ("range(2, 2, -1)", [2]), ("head([])", None), ("head([1, 2])", 1), ("last([1, 2])", 2), ("tail([1])", []), ("tail([1, 2])", [2]), ("reverse([1, 2])", [2, 1]),
    ("keys({b: 1, a: 2})", ["a", "b"]), ("values({b: 1, a: 2})", [2, 1]), ('toInt("-12")', -12), ("toInt(-3.9)", -3), ('toFloat("1e3")', 1000.0), ('toBool("FALSE")', False), ("coalesce(null, 2, 3)", 2), ("coalesce(null, 2.5, 3)", 2.5),
    ("typeOf(1)", "int"), ("typeOf(null)", "null"), ("typeOf([1])", "list"), ("toString(1)", "1"), ("toString(1.0)", "1.0"), ('toString("a\\"b")', '"a\\"b"'), ("toString(true)", "true"), ("toString([1, 2])", "[1, 2]"), ("toString(1e21)", "1e+21"), ("toString(123456789.5)", "123456789.5"), ("toString(0.0001)", "0.0001"), ("toString(0.00001)", "1e-05"), ("toString(1e7)", "10000000.0"), ("toString(NaN)", "NaN"),
    ('bytes("aGk=")', b"hi"), ('size(bytes("aGk="))', 2),
    ('date("2024-02-29")', dt.date(2024, 2, 29)), ('date("2024-01-31") + duration("P1M")', dt.date(2024, 2, 29)), ('date("2024-01-01") + duration("P2D")', dt.date(2024, 1, 3)), ('days(date("2024-03-01") - date("2024-02-01"))', 29),
    ('year(date("2024-05-06"))', 2024), ('quarter(date("2024-05-06"))', 2), ('dayOfWeek(date("2024-05-06"))', 1), ('hour(datetime("2024-01-01T23:30:00+02:00"))', 23), ('day(datetime("2024-01-01T23:30:00-02:00"))', 1), ('date(datetime("2024-01-01T23:30:00-02:00"))', dt.date(2024, 1, 2)),
    ('millisecond(datetime("2024-01-01T00:00:00.123456789"))', 123), ('nanosecond(datetime("2024-01-01T00:00:00.123456789"))', 123456789), ('offsetSeconds(datetime("2024-01-01T00:00:00Z"))', 0), ('offsetSeconds(datetime("2024-01-01T00:00:00"))', None),
    ('datetime("2024-01-01T02:00:00+02:00") < datetime("2024-01-01T01:00:00Z")', True), ('hours(datetime("2024-01-02T00:00:00Z") - datetime("2024-01-01T00:00:00Z"))', 24), ('hour(datetime("2024-01-31T10:00:00Z") + duration("P1MT2H"))', 12), ('day(datetime("2024-01-31T10:00:00Z") + duration("P1M"))', 29),
    ('months(duration("P1Y2M"))', 14), ('days(duration("P2W"))', 14), ('seconds(duration("PT1H0.5S"))', 3600), ('nanoseconds(duration("PT0.5S"))', 500000000), ('days(duration("P3D") * 2 - duration("P1D"))', 5), ('days(duration("P7D") / 2)', 3), ('duration("P1D") = duration("PT24H")', False),
]
ERRORS = [
    ("1 / 0", "InvalidArgument"), ("1.0 / 0", "InvalidArgument"), ("1 % 0", "InvalidArgument"), ("9223372036854775807 + 1", "InvalidArgument"), ("0 ^ -1", "InvalidArgument"), ("(-8) ^ 0.5", "InvalidArgument"), ("sqrt(-1)", "InvalidArgument"), ('1 + "a"', "InvalidArgument"), ("NOT 1", "InvalidArgument"),
    ("1 IN 2", "InvalidArgument"), ('toInt("1.5")', "InvalidArgument"), ('toInt(" 1")', "InvalidArgument"), ('toBool("yes")', "InvalidArgument"), ('split("a", "")', "InvalidArgument"), ('substring("a", -1)', "InvalidArgument"), ("range(1, 2, 0)", "InvalidArgument"), ("range(0, 99999999)", "ResourceExhausted"),
    ('date("2024-02-30")', "InvalidArgument"), ('datetime("2024-01-01")', "InvalidArgument"), ('duration("P")', "InvalidArgument"), ('date("2024-01-01") + duration("PT1H")', "InvalidArgument"), ("nosuch(1)", "InvalidArgument"), ("$missing", "InvalidArgument"), ("sum(true)", "InvalidArgument"), ("percentileDisc(1, 1)", "InvalidArgument"), ('bytes("a")', "InvalidArgument"),
]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return type(a) is type(b) and a == b


def test_values(run):
    for at in range(0, len(CASES), 50):
        part = CASES[at : at + 50]
        row = run("RETURN " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(part)))[0]
        wrong = [(e, want, got) for (e, want), got in zip(part, row, strict=True) if not same(want, got)]
        assert not wrong


@pytest.mark.parametrize(("source", "code"), ERRORS)
def test_errors(run, source, code):
    with pytest.raises(GraphError) as e:
        run(f"RETURN {source} AS x")
    assert e.value.code == code


def test_short_circuit_and_parameters(run):
    assert run("UNWIND [0, 2] AS x WITH x WHERE x <> 0 AND 10 / x > 1 RETURN x") == [(2,)]
    assert run("RETURN $a AS a, $b AS b, $`from` AS c", {"a": 1, "b": ["x"], "from": None}) == [(1, ["x"], None)]


def test_aggregates(run):
    assert run("UNWIND [1, null, 2] AS x RETURN sum(x) AS s, avg(x) AS a, min(x) AS lo, max(x) AS hi, count(x) AS n, count(*) AS rows, collect(x) AS xs, stdev(x) IS NULL AS one") == [(3, 1.5, 1, 2, 2, 3, [1, 2], False)]
    assert run("UNWIND [] AS x RETURN sum(x) AS s, count(x) AS n, size(collect(x)) AS c") == [(None, 0, 0)]
    assert run("UNWIND [1, 4, 2, 3] AS x RETURN percentileDisc(x, 0.5) AS p, percentileDisc(x, 0.0) AS q, percentileDisc(x, 1.0) AS r") == [(2, 1, 4)]
    assert run('UNWIND ["b", "a", "c"] AS x RETURN percentileDisc(x, 0.5) AS p, collect(DISTINCT x) AS c') == [("b", ["b", "a", "c"])]
    assert run("UNWIND [1, 1, 2] AS x RETURN count(DISTINCT x) AS n, sum(DISTINCT x) AS s, 1 + count(*) * 2 AS e") == [(2, 3, 7)]
    assert run("UNWIND [1, 2, 3] AS x RETURN x % 2 AS k, count(*) AS n ORDER BY k") == [(0, 1), (1, 2)]


def test_order(run):
    assert run("UNWIND [2, null, 1] AS x RETURN x ORDER BY x") == [(None,), (1,), (2,)]
    assert run("UNWIND [2, null, 1] AS x RETURN x ORDER BY x DESC") == [(2,), (1,), (None,)]
    assert run("UNWIND [2, null, 1] AS x RETURN x ORDER BY x NULLS LAST") == [(1,), (2,), (None,)]
    assert run("UNWIND [3, 1, 2] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN collect(x) AS xs") == [([3, 2],)]
    with pytest.raises(GraphError):
        run("RETURN 1 AS x LIMIT -1")


def test_mixed_kinds(run):
    assert run('UNWIND [2, "b", true, null, 1.5, "a"] AS x RETURN x, typeOf(x) AS t ORDER BY x') == [(None, "null"), (True, "bool"), (1.5, "float"), (2, "int"), ("a", "string"), ("b", "string")]
    assert run('UNWIND [2, "b", true, 1] AS x WITH x WHERE x > 1 RETURN x') == [(2,)]
    assert run('RETURN 1 IN ["a", 1] AS a, 2 IN ["a", 1] AS b, CASE WHEN true THEN 1 ELSE "x" END AS c, coalesce(null, "a", 1) AS d, toString([1, "a"]) AS e, [1, "a"][1] IS :: STRING AS f') == [(True, None, 1, "a", '[1, "a"]', True)]
    run('CREATE (:M {v: 1}), (:M {v: "s"}), (:M {v: false})')
    assert run("MATCH (m:M) RETURN m.v AS v ORDER BY v") == [(False,), (1,), ("s",)]
    assert run('MATCH (m:M) WHERE m.v = "s" RETURN count(*) AS n') == [(1,)]
