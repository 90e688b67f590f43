"""The pipeline against a plain version of each stage, one after the other."""

import random

import corpus_pipeline
from fabula.llm import pieces, toxicity
from fabula.llm.queries import piece_model

from .test_llm import brute_containment, brute_jaccard, near, prose


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    item = prose(30, r)
    rows = [(i, prose(80, r)) for i in range(200)]
    rows += [(200 + i, near(rows[i][1], 2)) for i in range(20)] + [(220 + i, rows[30 + i][1]) for i in range(10)]
    rows += [(300 + i, prose(20, r) + " " + item + " " + prose(20, r)) for i in range(5)]
    rows += [(400 + i, prose(30, r) + f" password = hunter{i}22 " + prose(9, r)) for i in range(5)]
    rows += [(500 + i, ". ".join(prose(8, r) + " vermin" for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    left = [x for x in rows if toxicity.score_text(x[1], model, model.openings())[0] < toxicity.THRESHOLD]
    assert {i for i, _ in left} == {i for i, _ in rows if i < 500}
    component = {int(d): int(c) for d, _, c in brute_jaccard(left, 5, 80)}
    left = [x for x in left if component[x[0]] == x[0]]
    bad = {d for d, _ in brute_containment(left, [(1, item)])}
    left = [x for x in left if x[0] not in bad]
    encoder = pieces.Encoder(pieces.PieceModel(piece_model()))
    for i, t in left:
        if 400 <= i < 405:
            assert f"hunter{i - 400}22" in t
    want = {i: encoder.encode(t.replace(f"password = hunter{i - 400}22", "<SECRET>")) for i, t in left}
    found = {row.doc_id: list(row.ids) for row in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == want
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
