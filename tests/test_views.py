"""What pages show."""

from bazaarlake.operators import views


def test_offers_and_children_meet_by_their_key(spark, sf_dir):
    """Steps of a ladder, variants and offers are dealt by product and supplier once each; no text made of both is shuffled."""
    plan = views.offer_pages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([d for d in dealt if "l_partkey" in d or "product_id" in d]) == len(dealt) <= 4
