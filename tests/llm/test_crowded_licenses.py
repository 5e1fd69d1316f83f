from lodestore.llm import licenses


def test_no_licence_crowds_out_another(spark):
    bodies = [body for _, body, _ in licenses.TEMPLATES]
    mit = bodies[2]
    texts = [" . ".join(bodies), f"{mit} {bodies[0]}", f"{mit} {bodies[4]}", *["plain words"] * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(docs).collect()}
    assert got[0] == {label for label, _, _ in licenses.TEMPLATES} | {label for _, label in licenses.PHRASES[:2]}
    assert "apache-2.0" in got[1] and "cc-by-nc-4.0" in got[2] and all("mit" in got[k] for k in (1, 2))
