"""Scratch tables: kept results stay readable, the rest of a scope goes."""

import os

from rampart.session import discard, materialize, scratch_scope


def test_scope_keeps_results_and_deletes_the_rest(spark):
    with scratch_scope(spark) as keep:
        step = materialize(spark.range(5), "step")
        out = keep(step.selectExpr("id * 2 as id"), "out")
    assert not os.path.exists(step._scratch_path)
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    discard(out)
    assert not os.path.exists(out._scratch_path)


def test_scopes_nest(spark):
    with scratch_scope(spark) as keep:
        with scratch_scope(spark) as inner:
            a = inner(spark.range(3), "a")
        out = keep(a.selectExpr("id + 1 as id"), "b")
    assert not os.path.exists(a._scratch_path)
    assert out.count() == 3
