"""Patterns tried together, by their first letter, find what each finds alone."""

from pyspark.sql import functions as F

from solvara import functions as fx
from solvara.functions import expr


def test_patterns_share_boundary_and_letter(spark):
    found = expr._alternation([r"\bbank run\b", r"\bbond\b", r"\bb?x\b", r"\bone\b|two", r"junk\b", r"\bc[|)]d"])
    assert found == r"(?:\b(?:b(?:ank run\b|ond\b)|c(?:[|)]d))|\bb?x\b|\bone\b|two|junk\b)"
    texts = ["a Bank Run", "vagabond", "bond", "x", "bx", "network", "one", "prone", "ajunk", "junks", "c)d", "c|d", "cd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [t for t, hit in df.select("t", F.col("t").rlike("(?i)" + found)).collect() if hit] == ["a Bank Run", "bond", "x", "bx", "network", "one", "ajunk", "c)d", "c|d"]


def test_every_topic_shares_its_letters():
    for topic in fx.DISTRESS_TOPICS.values():
        assert expr._alternation(list(topic)).count(r"|\b") < 4
