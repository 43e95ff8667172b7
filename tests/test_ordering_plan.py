"""Rows that get their positions are shuffled once; see ``test_ordering`` for the positions."""

from harness import DATA

from moundworks.operators.ordering import ordered_index


def test_only_counts_meet_the_sorted_rows(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    placed = ordered_index(lines, ["l_orderkey", "l_linenumber"], ["l_suppkey"], stored=True)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    first = {}
    for r in sorted(placed.collect(), key=lambda r: (r.l_suppkey, r.row_idx)):
        before = first.get(r.l_suppkey, (-1, (-1, -1)))
        assert r.row_idx == before[0] + 1 and (r.l_orderkey, r.l_linenumber) >= before[1]
        first[r.l_suppkey] = (r.row_idx, (r.l_orderkey, r.l_linenumber))
