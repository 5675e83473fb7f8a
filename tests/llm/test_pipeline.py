"""The pipeline keeps clean documents, and each stage's decisions take effect."""

import random

import corpus_pipeline
from forgeline.llm import queries


def sentences(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8))) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, n, 9)) + "."


def test_stages(spark, tmp_path):
    clean = {k: sentences(k, 40 + k % 60) for k in range(60)}
    junk = {k: " ".join(w + "&&&" for w in sentences(k, 60).split(" ")) for k in range(100, 115)}
    copies = {200 + k: clean[k] for k in range(5)} | {300 + k: clean[k] + " more" for k in range(10, 15)}
    short = {400: "too short", 401: ""}
    data = [(k, t, "en", "s", len(t)) for k, t in (clean | junk | copies | short).items()]
    data += [(500, None, "en", "s", None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1) for k in clean] + [(k, 0) for k in junk]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids == set(clean)
    assert sum(r.length for r in got if r.doc_id == 0) > 40
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 4


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
