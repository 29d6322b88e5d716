"""The stand-ins for the store's tables under the joins of larger tables."""

import pytest

from factloom.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["-1", "8k", "20k"])
def sized(spark, request):
    """The vectors are too large to broadcast, a few facts are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_facts_meet_all_vectors(sized):
    vectors = {r.vec_id: r.embedding for r in fx.table(sized, SF, "embeddings").collect()}
    few = "namespace = 'user:me' and access_count = 3"
    want = {r.id for r in fx.fx_memory(sized, SF, embedding=False).filter(few).select("id").collect()}
    found = {r.id: r.embedding for r in fx.fx_memory(sized, SF).filter(few).select("id", "embedding").collect()}
    assert set(found) == want and want
    assert all(e == vectors[i % len(vectors)] for i, e in found.items())
    assert len(fx.clustered(sized, SF).filter("id < 9").collect()) == 9
