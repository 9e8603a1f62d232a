from tests.test_oracles import SF

from tuplewright.operators import idioms


def test_two_columns_are_equal(spark):
    rows = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    buyer, at = dict(rows("orders", "o_orderkey", "o_custkey")), dict(rows("customer", "c_custkey", "c_nationkey"))
    seller = dict(rows("supplier", "s_suppkey", "s_nationkey"))
    sales = {(o, at[buyer[o]], seller[s]) for o, s in rows("lineitem", "l_orderkey", "l_suppkey") if buyer.get(o) in at and s in seller}
    want = {(o, a) for o, a, b in sales if a == b}
    got = [tuple(r) for r in idioms.repeated_variable_columns(spark, SF).collect()]
    assert 0 < len(want) < len({o for o, _, _ in sales}) and sorted(got) == sorted(want)
