"""Parser and analyzer, without a session."""

import pytest
from pyspark.sql import types as T

from quillon.plans.analyzer import analyze
from quillon.plans.dialect import parse
from quillon.plans.spec import Attr, Cond, QueryError, QuerySpec
from quillon.sources.definitions import definition_rows, parse_definition

SCHEMAS = {
    "A": T.StructType([T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("s", T.StringType()), T.StructField("r", T.FloatType()), T.StructField("ts", T.TimestampType())]),
    "B": T.StructType([T.StructField("i", T.IntegerType()), T.StructField("from", T.StringType())]),
}


def test_full_query():
    q = parse('SELECT DISTINCT A.i,MAX(B.from)\nFROM A , B WHERE A.i=B.i,A.s>="x, y" GROUPBY A.i ORDERBY A.i,A.s DESC')
    assert q == QuerySpec((Attr("A", "i"), Attr("B", "from", "MAX")), ("A", "B"), (Cond(Attr("A", "i"), "=", Attr("B", "i")), Cond(Attr("A", "s"), ">=", "x, y")), (Attr("A", "i"),), (Attr("A", "i"), Attr("A", "s")), False, True)


@pytest.mark.parametrize("op", ["<", ">", "<=", ">=", "!=", "="])
def test_operators(op):
    assert parse(f'SELECT * FROM A WHERE A.i{op}"1"').where[0].op == op


def test_keywords_are_upper_case_and_literals_raw():
    assert parse("SELECT A.from FROM A").select == (Attr("A", "from"),)
    assert parse(r'SELECT * FROM A WHERE A.s="a\"b"').where[0].right == r"a\"b"
    assert parse("SELECT A.i FROM A ORDERBY A.i").ascending and parse("SELECT A.i FROM A ORDERBY A.i ASC").ascending


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "select * FROM A", "SELECT * FROM", "SELECT A FROM A", "SELECT * FROM A WHERE", "SELECT * FROM A WHERE A.i=1", "SELECT * FROM A WHERE A.i LIKE \"x\"", "SELECT MAX(MIN(A.i)) FROM A", "SELECT COUNT(*) FROM A", "SELECT * FROM A;", "SELECT * FROM A GROUP BY A.i", "SELECT *,A.i FROM A", 'SELECT * FROM A WHERE A.s="x', "SELECT * FROM A ORDERBY A.i DESC GROUPBY A.i", "SELECT A.i, FROM A"],
)
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM C",
        "SELECT A.x FROM A",
        "SELECT B.i FROM A",
        "SELECT * FROM A,A",
        'SELECT * FROM A WHERE A.i="5.5"',
        'SELECT * FROM A WHERE A.i=" 5"',
        'SELECT * FROM A WHERE A.i="2147483648"',
        'SELECT * FROM A WHERE A.r="x"',
        'SELECT * FROM A WHERE A.ts="2020-01-01"',
        "SELECT * FROM A WHERE A.i=A.s",
        'SELECT A.i FROM A WHERE MAX(A.i)="1"',
        "SELECT A.i,MAX(A.l) FROM A",
        "SELECT A.s,MAX(A.l) FROM A GROUPBY A.i",
        "SELECT * FROM A GROUPBY A.i",
        "SELECT AVG(A.s) FROM A",
        "SELECT MAX(A.ts) FROM A",
        "SELECT A.i,A.i FROM A",
        "SELECT DISTINCT A.i FROM A ORDERBY A.s",
        "SELECT A.i FROM A ORDERBY MAX(A.i)",
        "SELECT MAX(A.i) FROM A GROUPBY A.s ORDERBY A.l",
        "SELECT A.i FROM A GROUPBY MAX(A.i)",
    ],
)
def test_analysis_errors(text):
    with pytest.raises(QueryError):
        analyze(parse(text), SCHEMAS)


def test_literals_take_the_type_of_the_column():
    q = analyze(parse('SELECT * FROM A WHERE A.i="7",A.l="2147483648",A.s="7",A.r="0.5",A.i<A.r'), SCHEMAS)
    assert [c.right for c in q.where] == [7, 2147483648, "7", 0.5, Attr("A", "r")]
    assert [a.label for a in q.select] == ["A.i", "A.l", "A.s", "A.r", "A.ts"]


def test_definitions():
    schema = parse_definition(["2", "24", "id INTEGER 200 PK 4 ", "", "name STRING 10 NK 20"])
    assert schema["id"].dataType == T.IntegerType() and schema["name"].metadata["range"] == 10
    assert definition_rows(schema)[0] == ("id", "INTEGER", 200, "PK", 4)
    for bad in (["1"], ["1", "4", "id LONG 9 PK 4"], ["2", "4", "id INTEGER 9 PK 4"], ["1", "8", "id INTEGER 9 PK 4"], ["1", "4", "id INTEGER 9 XX 4"], ["1", "4", "id INTEGER 9 PK"], ["x", "4"]):
        with pytest.raises(QueryError):
            parse_definition(bad)
