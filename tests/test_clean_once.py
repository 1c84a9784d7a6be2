"""The cleaners on long runs of spaces, and bodies that are cleaned once."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.plans import ingest


def test_long_runs_of_spaces_are_trimmed_in_linear_time(one):
    run = "　" * 100_000
    one(text.clean_plaintext("c"), c="warm"), one(text.clean_text("c"), c="warm")
    start = time.perf_counter()
    assert one(text.clean_plaintext("c"), c=f" 　a{run}b{run}\n") == f"a{run}b"
    assert one(text.clean_text("c"), c=f"　a{run}b{run}") == "a b"
    took = time.perf_counter() - start
    assert took < 10, took


def test_only_runs_that_are_no_blank_are_replaced(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab  \t\n\x0b  ﻿") for _ in range(rng.randint(0, 12))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string").select("c", F.regexp_replace("c", text.SPACES, " ").alias("got"))
    assert all(r["got"] == re.sub(r"[\s﻿]+", " ", r["c"]) for r in df.collect())


def test_a_cleaned_body_is_not_cleaned_again(spark):
    bodies = ["", " ", "``` ```", "a &amp;lt; b", "x ```py\nprint(1)\n``` y `z` &amp;amp;", "```\n&lt;b&gt; c", "<p>t</p> &amp;lt;i&amp;gt;", "﻿ plain  text "]
    raw = spark.createDataFrame([(i, b, f"t {b}", "https://e.org/") for i, b in enumerate(bodies)], "position int, full_text string, title string, url string") \
        .withColumn("date_published", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = ingest.normalize_source(raw, F.lit("2025-01-01").cast("timestamp_ntz"))
    once, twice = ingest.clean_sources(rows, body_cleaned=True), ingest.clean_sources(rows)
    columns = ["position", "full_text", "clean_text", "title", "raw_text", "id", "content_hash"]
    assert once.select(columns).orderBy("position").collect() == twice.select(columns).orderBy("position").collect()
