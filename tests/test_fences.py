"""Code blocks against the patterns that define them."""

import random
import re
import time

from pyspark.sql import functions as F

from strandline.functions import text

WS = "[" + text.WS_CHARS + "]"
BLOCK = re.compile(r"```(?:(\w*)\n)?([\s\S]*?)```", re.A)
TRIMMED = re.compile(r"```(?:\w*\n)?" + WS + r"*([\s\S]*?)" + WS + "*```", re.A)


def plain(t):
    blocks = [(m[1] or "text", m[2].strip(text.WS_CHARS)) for m in BLOCK.finditer(t)]
    return [b for b in blocks if b[1]], re.sub(r"`([^`\n]+)`", r"\1", TRIMMED.sub(r"\1", t))


def test_fences_equal_the_patterns(spark):
    rng = random.Random(7)
    parts = ["`", "``", "```", "````", "a", "py", "\n", " ", "\r\n", "é", " ", "x y", "```sql\n", " \n", "$1", "\\"]
    texts = ["", "```", "``````", "```a", "```py\n```", "```é\nx```", "```py\r\nx```"] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text.code_blocks(F.col("t")).alias("b"), text.unfenced(F.col("t")).alias("u")).collect()
    for r in rows:
        assert ([tuple(b) for b in r["b"]], r["u"]) == plain(r["t"]), repr(r["t"])


def test_long_runs_of_blanks_are_trimmed_in_linear_time(spark):
    rows = spark.range(4, numPartitions=1).select(F.concat(F.lit("```\nx"), F.repeat(F.lit(" "), F.lit(200_000) + F.col("id")), F.lit("y```")).alias("t"))
    began = time.time()
    assert [len(b[0]["content"]) for (b,) in rows.select(text.code_blocks(F.col("t"))).collect()] == [200_002 + i for i in range(4)]
    assert time.time() - began < 30                                       # the square of 200,000 takes minutes
