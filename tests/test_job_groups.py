"""The jobs that store marts are told from those of the query that asks for them."""

from martwright.plans import refresh
from martwright.sources.star_schema import read_star_schema


def test_marts_are_stored_in_a_job_group_of_their_own(spark, small, marts, tmp_path):
    tracker = spark.sparkContext.statusTracker()

    def of_queries():
        # ids, not their number: Spark forgets the oldest jobs of a long session
        return set(tracker.getJobIdsForGroup(None))

    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    other = refresh.MartsOnDemand(read_star_schema(spark, small), str(tmp_path))
    before = of_queries()
    for stored in (other, marts):
        assert stored.sellers is not None and stored.seller_sums is not None
    assert not of_queries() - before
    assert tracker.getJobIdsForGroup("martwright store seller_mart")
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    marts.sellers.count()
    assert of_queries() - before
