"""Property-based laws (hypothesis): CSV text round trip, column-step laws,
validation keep + drop = input, upsert key uniqueness."""

import os
import string
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesteps.operators import rows as R
from tablesteps.operators import upsert as U
from tablesteps.operators.order import asc
from tablesteps.operators.validate import Validator, validate, validate_with_results
from tablesteps.sinks.files import write_csv
from tablesteps.sources.csv import read_csv

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

# cell text: no surrounding blanks (cells are trimmed), never empty (empty converts to null)
cell = st.text(alphabet=string.ascii_letters + string.digits + ' ,;"\n-./', min_size=1, max_size=12).filter(
    lambda s: s == s.strip() and s != ""
)


@SETTINGS
@given(st.lists(st.tuples(cell, cell, st.integers(-10**6, 10**6)), min_size=1, max_size=20))
def test_csv_text_round_trip(spark, tmpdir_shared, data):
    df = spark.createDataFrame(data, "a string, b string, n long")
    out = os.path.join(tmpdir_shared, uuid.uuid4().hex)
    write_csv(df, out)
    back = read_csv(spark, out, auto_convert=False, multi_line=True)
    got = sorted(tuple(r) for r in back.collect())
    assert got == sorted((a, b, str(n)) for a, b, n in data)


names = st.lists(st.sampled_from(["a", "b", "c", "d", "A", "B"]), min_size=1, max_size=4, unique_by=str.lower)


@SETTINGS
@given(names, st.sampled_from(["a", "b", "x"]), st.sampled_from(["z", "b", "C"]))
def test_column_step_laws(spark, cols, old, new):
    df = spark.createDataFrame([tuple(range(len(cols)))], ",".join(f"{c} int" for c in cols))
    removed = R.remove_column(df, old)
    assert old.lower() not in [c.lower() for c in removed.columns]
    assert len(removed.columns) == len(cols) - (old.lower() in [c.lower() for c in cols])
    added = R.add_column(df, new, F.lit(7))
    assert len(added.columns) == len(cols) + (new.lower() not in [c.lower() for c in cols])
    renamed = R.rename_column(df, old, new)
    low = [c.lower() for c in renamed.columns]
    assert len(low) == len(set(low))  # never two columns with one name
    if old.lower() in [c.lower() for c in cols]:
        assert new.lower() in low
    # renaming back and forth is the identity when there is no collision
    if old.lower() in [c.lower() for c in cols] and new.lower() not in [c.lower() for c in cols]:
        assert R.rename_column(renamed, new, old).first() == df.first()


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), cell), st.one_of(st.none(), st.integers(-50, 200))), min_size=1, max_size=25))
def test_validation_keep_plus_drop_is_input(spark, data):
    df = spark.createDataFrame(data, "e string, n int")
    rules = Validator().column("e").required().email().column("n").range(0, 120).validator
    kept = validate(df, rules, "skip").count()
    res = validate_with_results(df, rules)
    assert kept == res.filter("is_valid").count()
    assert kept + res.filter("not is_valid").count() == len(data)


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 6), st.text(max_size=3)), min_size=0, max_size=8, unique_by=lambda t: t[0]),
    st.lists(st.tuples(st.integers(0, 9), st.text(max_size=3)), min_size=1, max_size=12),
)
def test_upsert_keeps_keys_unique(spark, target, source):
    t = spark.createDataFrame(target, "k int, a string")
    s = spark.createDataFrame([(k, a, i) for i, (k, a) in enumerate(source)], "k int, a string, seq int")
    for out in (
        U.upsert_update(t, s, ["k"], [asc("seq")]),
        U.upsert_do_nothing(t, s, ["k"], [asc("seq")]),
        U.upsert_replace(t, s, "k", [asc("seq")]),
    ):
        keys = [r.k for r in out.collect()]
        assert len(keys) == len(set(keys))
        assert set(keys) == {k for k, _ in target} | {k for k, _ in source}
    last = {}
    for i, (k, a) in enumerate(source):
        last[k] = a
    got = {r.k: r.a for r in U.upsert_update(t, s, ["k"], [asc("seq")]).collect()}
    for k, a in last.items():
        assert got[k] == a


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 5), st.integers(-1000, 1000)), min_size=1, max_size=60, unique=True),
    st.integers(1, 7),
)
def test_row_index_is_dense_and_ordered(spark, data, parts):
    from tablesteps.operators.order import desc, with_row_index

    df = spark.createDataFrame(data, "g int, v int").repartition(parts)
    idx = with_row_index(df, [asc("g"), desc("v")]).collect()
    expect = sorted(data, key=lambda t: (t[0], -t[1]))
    got = sorted(idx, key=lambda r: r.row_index)
    assert [r.row_index for r in got] == list(range(len(data)))
    assert [(r.g, r.v) for r in got] == expect


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=60, unique_by=lambda t: t[1]),
    st.integers(1, 5),
)
def test_keep_first_matches_brute_force(spark, data, parts):
    # key 0 is drawn often: a hot key
    rows = [(0 if i % 3 == 0 else k, v) for i, (k, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(parts)
    got = sorted((r.k, r.v) for r in R.remove_duplicates(df, "k", [asc("v")]).collect())
    best = {}
    for k, v in rows:
        best[k] = min(v, best.get(k, v))
    assert got == sorted(best.items())


def _rename_model(cols, values, old, new):
    """Case-insensitive dictionary: a name keeps its first spelling and
    position; a later write to the same name replaces the value."""
    out = {}
    spelled = {}
    for c, v in zip(cols, values):
        target = new if c.lower() == old.lower() else c
        key = target.lower()
        if key not in out:
            spelled[key] = target
        out[key] = v
    return [spelled[k] for k in out], list(out.values())


@SETTINGS
@given(names, st.sampled_from(["a", "B", "c", "zz"]), st.sampled_from(["A", "b", "d", "C"]))
def test_rename_matches_dictionary_model(spark, cols, old, new):
    values = list(range(len(cols)))
    df = spark.createDataFrame([tuple(values)], ",".join(f"{c} int" for c in cols))
    out = R.rename_column(df, old, new)
    exp_cols, exp_vals = _rename_model(cols, values, old, new)
    assert out.columns == exp_cols
    assert list(out.first()) == exp_vals


import re as _re

_EMAIL = _re.compile(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def _summary_model(email, age, code):
    errs = []
    if email is None or email.strip() == "":
        errs.append("email: Field is required")
    if email is not None and not _EMAIL.search(email):
        errs.append("email: Invalid email format")
    if age is not None:
        try:
            x = float(age)
            if x < 0 or x > 120:
                errs.append("age: Value must be between 0 and 120")
        except ValueError:
            errs.append("age: Value must be numeric")
    if code is not None and code not in ("A", "B"):
        errs.append("code: Value must be one of: A, B")
    if code is not None and len(code) > 3:
        errs.append("code: Maximum length is 3 characters")
    return "; ".join(errs) or "Valid"


text = st.text(alphabet="abc@.AB0123 -", max_size=10)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), text), st.one_of(st.none(), text), st.one_of(st.none(), text)), min_size=1, max_size=30))
def test_validation_matches_rule_model(spark, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, email string, age string, code string")
    rules = (
        Validator()
        .column("email").required().email()
        .column("age").range(0, 120)
        .column("code").is_in(["A", "B"]).max_length(3)
        .validator
    )
    got = {r.id: r.summary for r in validate_with_results(df, rules).collect()}
    for i, (e, a, c) in enumerate(data):
        assert got[i] == _summary_model(e, a, c), (e, a, c)


def _predicate_model(target, source):
    """Each source row updates the first target row with an equal key
    (target order = list order); later source rows overwrite; source
    rows matching nothing are inserted, and found by later rows of their key."""
    rows = [list(t) for t in target]
    inserted = []
    for k, a, _seq in source:
        hit = next((r for r in [*rows, *inserted] if r[0] == k), None) if k is not None else None
        if hit is not None:
            hit[1] = a
        else:
            inserted.append([k, a])
    return sorted(map(tuple, rows + inserted), key=repr)


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 6), st.text(alphabet="xyz", max_size=2)), min_size=0, max_size=8, unique_by=lambda t: t[0]),
    st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.text(alphabet="mno", max_size=2)), min_size=1, max_size=10),
)
def test_predicate_upsert_matches_model(spark, target, source):
    t = spark.createDataFrame(target, "k int, a string")
    src = [(k, a, i) for i, (k, a) in enumerate(source)]
    s = spark.createDataFrame(src, "k int, a string, seq int")
    out = U.upsert_predicate(t, s, [("k", "k")], [asc("k")], [asc("seq")])
    got = sorted((tuple(r) for r in out.select("k", "a").collect()), key=repr)
    assert got == _predicate_model(target, src)


def _conditional_model(target, source):
    """Each source row updates the first target row (by ``o``) of its key with a smaller ``v``; the last one by ``q`` wins;
    rows without such a target are inserted."""
    rows = [[k, v, "old", o] for k, v, o in target]
    hits, inserted = {}, []
    for k, v, a, q in sorted(source, key=lambda r: r[3]):
        at = [i for i, r in enumerate(rows) if k is not None and r[0] == k and None not in (r[1], v) and r[1] < v]
        if at:
            hits[min(at, key=lambda i: rows[i][3])] = (v, a)
        else:
            inserted.append((k, v, a, None))
    for i, (v, a) in hits.items():
        rows[i][1], rows[i][2] = v, a
    return sorted([*map(tuple, rows), *inserted], key=repr)


_KEY = st.one_of(st.none(), st.sampled_from([0, 0, 0, 1, 2]))
_VALUE = st.one_of(st.none(), st.integers(0, 9))


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(_KEY, _VALUE), max_size=25),
    st.lists(st.tuples(_KEY, _VALUE), max_size=25),
    st.sampled_from([1, 3, 4096]),
)
def test_conditional_upsert_matches_model(spark, target, source, block):
    t_rows = [(k, v, i) for i, (k, v) in enumerate(target)]
    s_rows = [(k, v, f"a{i}", i) for i, (k, v) in enumerate(source)]
    t = spark.createDataFrame([(k, v, "old", o) for k, v, o in t_rows], "k int, v int, a string, o int")
    s = spark.createDataFrame(s_rows, "k int, v int, a string, q int")
    smaller = lambda t, s: t("v") < s("v")
    out = U.upsert_predicate(t, s, [("k", "k")], [asc("o")], [asc("q")], smaller, block=block)
    got = sorted((tuple(r) for r in out.select("k", "v", "a", "o").collect()), key=repr)
    assert got == _conditional_model(t_rows, s_rows)
