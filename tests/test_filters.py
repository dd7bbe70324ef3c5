import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.plans import filters as P
from loomspark.types import FilterTooComplex, ValidationError


def test_building_and_counting():
    f = P.eq("a", 1) & P.gt("b", 2) & (P.exists("c") | ~P.eq("a", 3))
    assert len(f.children) == 3 and f.node_count() == 7 and f.depth() == 4 and f.referenced_fields() == ["a", "b", "c"]
    with pytest.raises(FilterTooComplex):
        P.all_of(*[P.eq("a", 1)] * 256).validate()
    deep = P.eq("a", 1)
    for _ in range(32):
        deep = ~deep
    with pytest.raises(FilterTooComplex):
        deep.validate()


@pytest.mark.parametrize("wrong", [{"$xor": []}, {"a": {"$like": "x"}}, {"a": [1]}, {"a": {"$in": 3}}, {"$and": {}}, {"a": {"$startsWith": 1}}, 5, {"a": {"$eq": {"x": 1}}}])
def test_json_that_is_refused(wrong):
    with pytest.raises(ValidationError):
        P.parse(wrong)


def test_json_forms():
    assert P.parse({}) == P.all_of() and P.parse({"a": 1}) == P.eq("a", 1) and P.parse({"a": 2.0}).value == 2
    assert P.parse({"a": {"$exists": False}}) == P.is_null("a") and P.parse({"$not": {"a": None}}) == ~P.eq("a", None)
    assert P.parse({"a": {"$gt": 1, "$lt": 5}}) == P.all_of(P.gt("a", 1), P.lt("a", 5))


LEAF = st.sampled_from([P.eq("a", 1), P.eq("a", None), P.gt("b", "m"), P.lte("b", "m"), P.in_("a", [1, "x"]), P.exists("b"), P.is_null("a"), P.starts_with("b", "z"), P.contains("c", 2), P.ne("b", "zebra")])
TREE = st.recursive(LEAF, lambda x: st.one_of(st.lists(x, max_size=3).map(lambda c: P.all_of(*c)), st.lists(x, max_size=3).map(lambda c: P.any_of(*c)), x.map(P.negate)), max_leaves=6)
ROWS = ['{"a":1,"b":"zebra","c":[1,2]}', '{"a":null,"b":"ant"}', '{"b":5,"c":2}', '{"a":"x","c":[]}', "{}", '{"a":1.0,"b":null}']


@settings(max_examples=25, deadline=None)
@given(TREE)
def test_filters_are_total_and_negation_is_exact(spark, f):
    """Whatever the row, a filter or its negation holds; as a predicate and as a column it says the same."""
    from pyspark.sql import functions as F

    fields = P.VariantFields(F.col("m"))
    rows = spark.createDataFrame(list(enumerate(ROWS)), "id long, j string").select("id", F.parse_json("j").alias("m"))
    told = rows.select("id", P.compile_filter(f, fields, positive=False).alias("x"), P.compile_filter(~f, fields, positive=False).alias("y")).collect()
    assert all(r.x is not None and r.x != r.y for r in told)
    assert {r.id for r in rows.where(P.compile_filter(f, fields)).select("id").collect()} == {r.id for r in told if r.x}
