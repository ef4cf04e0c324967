"""Sample table x the six shipped templates (FIXTURES §1)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesteps.operators import grouping as G
from tablesteps.operators import rows as R
from tablesteps.operators.order import asc, chain
from tablesteps.plans import templates as TPL

# The sample table of the templates.
PEOPLE = [
    (1, "João Silva", 28, "São Paulo", Decimal("5500.00")),
    (2, "Maria Santos", 32, "Rio de Janeiro", Decimal("6200.00")),
    (3, "Carlos Oliveira", 25, "Belo Horizonte", Decimal("4800.00")),
    (4, "Ana Costa", 35, "Porto Alegre", Decimal("7100.00")),
    (5, "Pedro Lima", 29, "Recife", Decimal("5300.00")),
    (6, "Lucia Ferreira", 31, "Salvador", Decimal("5900.00")),
    (7, "Roberto Alves", 27, "Fortaleza", Decimal("5100.00")),
    (8, "Fernanda Rocha", 33, "Brasília", Decimal("6800.00")),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "ID int, Name string, Age int, City string, Salary decimal(18,2)")


def ids(df):
    return [r["ID"] for r in df.collect()]


def test_filter(people):
    assert len(TPL.filter_rows(people, "Age > 18").collect()) == 8
    assert sorted(ids(TPL.filter_rows(people, "Age > 28"))) == [2, 4, 5, 6, 8]


def test_sort(people):
    assert ids(TPL.sort_rows(people, "Name")) == [4, 3, 8, 1, 6, 2, 5, 7]


def test_add_column(people):
    out = {r["ID"]: r["FullName"] for r in TPL.add_full_name(people).collect()}
    assert out[1] == "João Silva - São Paulo"


def test_group_by_city(people):
    out = TPL.group_by_city(people).collect()
    assert len(out) == 8
    salary = {p[3]: p[4] for p in PEOPLE}
    for r in out:
        assert r["Count"] == 1 and r["AvgSalary"] == salary[r["City"]]


def test_remove_duplicates(people):
    assert len(TPL.remove_duplicate_names(people).collect()) == 8
    doubled = people.unionByName(people)
    assert len(TPL.remove_duplicate_names(doubled).collect()) == 8


def test_salary_bonus(people):
    out = {r["ID"]: r["Salary"] for r in TPL.salary_bonus(people).collect()}
    expect = ["6050.00", "6820.00", "5280.00", "7810.00", "5830.00", "6490.00", "5610.00", "7480.00"]
    assert [str(out[i]) for i in range(1, 9)] == expect


def test_bankers_rounding(spark):
    df = spark.createDataFrame([("a", Decimal("0.125")), ("b", Decimal("0.135"))], "k string, v decimal(18,3)")
    out = {r["k"]: r["AvgValue"] for r in G.count_and_average(df, "k", "v").collect()}
    assert str(out["a"]) == "0.12" and str(out["b"]) == "0.14"


def test_chain_sort_is_stable(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 2), (3, "b", 1), (4, "a", 1)], "id int, s string, n int")
    keys = chain(chain([asc("id")], [asc("s")]), [asc("n")])
    out = [r.id for r in df.orderBy(*[k.column() for k in keys]).collect()]
    assert out == [4, 3, 2, 1]


def test_unicode_collation_order(spark):
    from tablesteps.operators.order import asc

    df = spark.createDataFrame([("B",), ("a",), ("b",)], "s string")
    assert [r.s for r in df.orderBy(asc("s").column()).collect()] == ["B", "a", "b"]
    assert [r.s for r in df.orderBy(asc("s", "UNICODE").column()).collect()] == ["a", "b", "B"]
