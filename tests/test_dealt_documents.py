"""Documents that are dealt out by their id once aren't shuffled again by what groups and orders their boxes."""

from sightstream.operators import layout as L
from sightstream.plans.text import as_lines
from sightstream.sources.derived import observations


def test_one_exchange_of_texts(spark, sf_dir):
    plain, dealt = (L.regions(L.blocks(as_lines(observations(spark, sf_dir, dealt)))) for dealt in (False, True))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange") == 1
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(plain) == key(dealt)


def test_prepared_documents_are_dealt_by_id(spark, sf_dir):
    from sightstream.plans.text import prepared_documents

    plan = prepared_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") > 1 and "Window" in plan
