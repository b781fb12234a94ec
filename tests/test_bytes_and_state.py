"""How learned n-grams and the states of streams are kept."""

import glob

from solvara.operators import sentiment
from solvara.plans import QUERIES


def test_n_grams_are_written_as_bytes(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sentiment, "saved", lambda df, name: kept.append(df.cache()) or kept[0])
    df = spark.createDataFrame([("good good day", 2), ("bad day", 0), (None, 1)], "t string, y int")
    scorer = sentiment.fit_scorer(df, "t", "y", bits=8, steps=5)
    assert dict(kept[0].dtypes) == {"at": "binary", "w": "binary", "y": "int"}
    p = scorer(["good", "bad", ""])
    assert p[0].argmax() == 2 and p[1].argmax() == 0 and p.shape == (3, 3)


def test_states_of_windows_are_on_disk(spark):
    assert QUERIES["stm02_sliding"](spark, "/root/testdata/sf0.001").count() > 0
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = [f for f in glob.glob(f"{root}/solvara-sliding-checkpoint-*/state/**", recursive=True)]
    assert files and not [f for f in files if f.endswith(".delta")]
