from pyspark.sql import functions as F

from starling.llm import decontaminate


def test_documents_hash_one_place_per_step_and_every_window_is_met(spark):
    words = [f"w{i}" for i in range(130)]
    frame = spark.createDataFrame([(words,)], "words array<string>")
    for length in (13, 7, 3, 1):
        prints = set(frame.select(decontaminate._fingerprints(F.col("words"), length)).first()[0])
        assert len(prints) <= 126 // (length - min(5, length) + 1) + 5
        for start in range(0, 130 - length + 1, 3):
            window = spark.range(1).select(F.array(*map(F.lit, words[start : start + length])).alias("words")) if start < 40 else None
            if window is not None:
                assert prints & set(window.select(decontaminate._marks(F.col("words"), length)).first()[0])
    short = spark.createDataFrame([(words[:4],)], "words array<string>")
    assert short.select(decontaminate._fingerprints(F.col("words"), 13)).first()[0] == []
