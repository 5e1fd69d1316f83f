from lodestore.llm import quality


def test_buckets_follow_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert quality.bucket_bits(docs.limit(100)) == quality.BITS < quality.bucket_bits(docs)
    judged = quality.quality_rules(docs, labels).join(labels, "doc_id")
    n = {(r.quality, r.low): r["count"] for r in judged.withColumn("low", judged.llr < quality.THRESHOLD).groupBy("quality", "low").count().collect()}
    assert n[0, True] >= 0.95 * (n[0, True] + n.get((0, False), 0))
    assert n.get((1, True), 0) <= 0.01 * n[1, False]


def test_joined_weights_give_the_same_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = ({r.doc_id: r for r in quality.quality_rules(docs, labels, bits=18, broadcast_bits=k).collect()} for k in (18, 17))
    assert a.keys() == b.keys()
    assert all(a[d] == b[d] for d in a)  # sums of whole weights are the same in any order
    kept = quality.quality_filter(docs, labels, bits=18, broadcast_bits=17)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in a if a[d].kept)
