"""What the findings of round 5 named: each of these failed before."""

from pyspark.sql import functions as F

from meshwright.storage import discard, stored

SF = "/root/testdata/sf0.001"


def in_place(rows, keys):
    """Whether rows and what is made of them are joined by dataset and keys where they are, and neither goes through the driver."""
    a = stored(rows)
    b = stored(a.groupBy("dataset_id", *keys).agg(F.count(F.lit(1)).alias("n")))
    joined = a.join(b, ["dataset_id", *keys]).groupBy("dataset_id").agg(F.sum("n").alias("n"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    many = sum(r.n for r in joined.collect())
    discard(a, b)
    return "Exchange" not in plan and many == rows.count()


def test_documents_are_joined_where_they_are(spark):
    """tables made of documents were taken for small, and went through the driver to be broadcast."""
    from meshwright.plans import conversion

    assert in_place(conversion.part(spark, SF), ["k"])


def test_documents_of_rules_are_joined_where_they_are(spark, monkeypatch):
    """hints held for the documents' tables alone; what was grouped from them was taken for small and broadcast."""
    from meshwright.plans import samples

    monkeypatch.setattr(samples, "APPLIED", ("TR-04",))
    found = samples.issues(spark, SF)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(1 for k in range(1, 201) if k % samples.N == samples.N - 1)


def test_graphs_are_joined_where_they_are(spark):
    """every join and group of the triples dealt out its rows by id, or passed one side through the driver."""
    from meshwright.plans import graphs

    assert in_place(graphs.texts(spark, SF), ["text"])
