from perkwise.functions.text import WHITE_SPACE, strip
from pyspark.sql import functions as F


def test_white_space_goes_at_the_ends_only(spark):
    texts = [f"{WHITE_SPACE}a{c}b{c}" for c in WHITE_SPACE] + ["", WHITE_SPACE, "\x1f a", None, "x" + " " * 40_000 + "y "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [f"a{c}b" for c in WHITE_SPACE] + ["", "", "\x1f a", None, "x" + " " * 40_000 + "y"]
