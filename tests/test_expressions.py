import math

import pytest

from quiverlane.lang.errors import QueryError, RunTimeError
from quiverlane.session import connect


@pytest.fixture(scope="module")
def connection(spark):
    return connect(spark)


#: Expression and value. All are evaluated in one query, so that this stays quick.
CASES = [
    ("1 + 2", 3), ("1 + 2.5", 3.5), ("'a' + 'b'", "ab"), ("[1] + [2]", [1, 2]), ("[1] + 2", [1, 2]), ("null + 1", None), ("1 + null", None),
    ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7.0 / 2", 3.5), ("1.0 / 0", math.inf), ("-1.0 / 0", -math.inf), ("5.5 % 2", 1.5), ("- (1 + 1)", -2),
    ("1 = 1.0", True), ("1 = 'a'", False), ("1 <> 'a'", True), ("1 < 'a'", None), ("null = null", None), ("null <> 1", None), ("true > false", True), ("'a' < 'b'", True),
    ("0.0 / 0 = 0.0 / 0", False), ("0.0 / 0 < 1.0", False), ("0.0 / 0 <> 1.0", True),
    ("true AND null", None), ("false AND null", False), ("true OR null", True), ("false OR null", None), ("true XOR null", None), ("true XOR true", False), ("NOT null", None), ("NOT false", True),
    ("1 IN [1, 2]", True), ("3 IN [1, 2]", False), ("3 IN [1, null]", None), ("1 IN [1, null]", True), ("null IN [1]", None), ("null IN []", False), ("null NOT IN []", True), ("'a' IN [1, 'a']", True), ("[1] IN [[1], [2]]", True),
    ("[1, 2] = [1, 2]", True), ("[1, 2] = [1, null]", None), ("[1, 2] = [3, null]", False), ("[1] = [1, 2]", False), ("[1, 2] = [1.0, 2]", True), ("[9] < [1, 2]", True), ("[1, 2] < [1, 3]", True), ("[] = []", True),
    ("{a: 1} = {a: 1}", True), ("{a: 1} = {a: 2}", False), ("{a: 1} = {b: 1}", False), ("{a: 1, b: 'x'}.b", "x"), ("{a: {b: 2}}.a.b", 2), ("{a: 1}.c", None), ("{a: 1}['a']", 1), ("1 IS NULL", False), ("null IS NULL", True), ("null IS NOT NULL", False),
    ("[1, 2, 3][0]", 1), ("[1, 2, 3][null]", None), ("[1, 2, 3][1..5]", [2, 3]), ("[1, 2, 3][..-1]", [1, 2]), ("[1, 2, 3][-2..]", [2, 3]), ("[1, 2, 3][2..1]", []), ("[1, 2, 3][5..]", []), ("[1, 2][null..1]", None), ("[][-1..]", []),
    ("head([1, 2])", 1), ("head([])", None), ("keys({b: 1, a: 2})", ["a", "b"]), ("keys(null)", None), ("range(1, 3)", [1, 2, 3]), ("range(3, 1)", []), ("range(2, 2)", [2]), ("size([1, null])", 2), ("size(null)", None), ("length([1])", 1), ("size({a: 1})", 1),
    ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("coalesce(null, null, 3)", 3), ("coalesce(null)", None), ("properties({a: 1})", {"a": 1}),
    ("toInteger(2.9)", 2), ("toInteger(-2.9)", -2), ("toInteger('12')", 12), ("toInteger(1e30)", 2**63 - 1), ("toInteger(0.0 / 0)", 0), ("toInteger(null)", None),
    ("toString(1.0)", "1"), ("toString(1.5)", "1.5"), ("toString(true)", "true"), ("toString(12)", "12"), ("toString(1e20)", "100000000000000000000"), ("toString(1e-7)", "0.0000001"), ("toString(0.0 / 0)", "NaN"), ("toString('x')", "x"),
    ("[1, 'a', null, true]", [1, "a", None, True]), ("[[1], [2, 3]]", [[1], [2, 3]]), ("{a: [1, {b: 2}][0]}", {"a": 1}), ("[1, 2.5]", [1, 2.5]), ("$p + 1", 42), ("$q", "text"), ("$list[1]", 2), ("1 < 2 = true", True), ("-2147483648 * 4", -8589934592),
]


def test_values(connection):
    text = "RETURN " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(CASES))
    _, row = connection.execute_oc_query(text, {"$p": 41, "q": "text", "$list": [1, 2, 3]})
    wrong = [(e, got, want) for (e, want), got in zip(CASES, row) if got != want or type(got) is not type(want)]
    assert not wrong


@pytest.mark.parametrize(
    "text, name",
    [
        ("RETURN x", "UndefinedVariable"),
        ("RETURN $missing", "UnknownParameter"),
        ("RETURN nofunction(1)", "UnknownFunction"),
        ("RETURN size()", "InvalidNumberOfArguments"),
        ("RETURN size('abc')", "InvalidArgument"),
        ("RETURN ceil(1)", "InvalidArgument"),
        ("RETURN toInteger(true)", "InvalidArgument"),
        ("RETURN 1 + 'a'", "InvalidBinaryOperands"),
        ("RETURN -'a'", "InvalidNegationOperands"),
        ("RETURN NOT 1", "InvalidArgumentType"),
        ("RETURN 1 AND true", "InvalidArgumentType"),
        ("RETURN 1 IN 2", "InvalidArgumentType"),
        ("RETURN 1 IN null", "InvalidArgumentType"),
        ("RETURN [1][-1]", "OutOfBound"),
        ("RETURN {a: 1}[1]", "MapElementAccessByNonString"),
        ("RETURN 1 AS a, 2 AS a", "ColumnNameConflict"),
        ("MATCH (n) WHERE count(n) > 1 RETURN n", "InvalidAggregation"),
        ("RETURN sum(count(*))", "InvalidAggregation"),
        ("RETURN count(1, 2)", "InvalidNumberOfArguments"),
        ("RETURN 1 AS x LIMIT -1", "NegativeIntegerArgument"),
        ("RETURN 1 AS x LIMIT 1.5", "InvalidArgumentType"),
        ("UNWIND [1] AS x RETURN x SKIP x", "NonConstantExpression"),
        ("MATCH (n) RETURN n.a AS a ORDER BY count(n)", "MissingAggregations"),
        ("MATCH (a) MATCH (a:B) RETURN a", "VariableAlreadyBound"),
        ("MATCH (a)-[r]->(b) MATCH (r) RETURN a", "VariableTypeConflict"),
        ("MATCH (a) RETURN count(a) AS n, sum(a.x) AS s ORDER BY a.x", "UndefinedVariable"),
        ("USE nowhere MATCH (n) RETURN n", "UnknownGraph"),
        ("CREATE GRAPH default", "DuplicatedGraph"),
        ("CREATE (a)-[:R]-(b)", "RequiresDirectedRelationship"),
        ("CREATE (a)-->(b)", "NoSingleRelationshipType"),
        ("CREATE (a)-[:R:S]->(b)", "NoSingleRelationshipType"),
        ("MATCH (a) CREATE (a:B)", "VariableAlreadyBound"),
        ("UNWIND [1] AS x DELETE x", "InvalidDelete"),
        ("SET n.a = 1", "UndefinedVariable"),
        ("CALL nothing()", "Unimplemented"),
    ],
)
def test_errors(connection, text, name):
    with pytest.raises(QueryError, match=name):
        connection.execute_oc_query(text)


def test_errors_at_run_time(connection):
    with pytest.raises(Exception, match="OutOfBound"):
        connection.execute_oc_query("UNWIND [5] AS i RETURN [1, 2][i]")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        connection.execute_oc_query("UNWIND ['x'] AS s RETURN toInteger(s)")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        connection.execute_oc_query("UNWIND [0] AS x RETURN 1 / x")


def test_rand(connection):
    _, *rows = connection.execute_oc_query("UNWIND range(1, 20) AS i RETURN rand() AS x")
    assert all(0 <= x < 1 for (x,) in rows)


def test_errors_of_values(spark):
    c = connect(spark)
    for text, name in (("RETURN toInteger('zz')", "InvalidArgument"), ("UNWIND [0] AS x RETURN 1 / x", "InvalidArgument"), ("UNWIND [0] AS x RETURN 1 % x", "InvalidArgument"), ("UNWIND [9223372036854775807] AS x RETURN x + 1", "InvalidArgument"), ("UNWIND [5] AS i RETURN [1, 2][i]", "OutOfBound")):
        with pytest.raises(RunTimeError, match=f"RunTime: {name}"):
            c.execute_oc_query(text)
