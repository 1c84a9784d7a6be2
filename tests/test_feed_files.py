"""Feed files are streamed by ranges of ids, and their bodies are cleaned in few passes."""

from __future__ import annotations

import re
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import functions as F

from catalog import q_io
from strandline.functions import text


def test_feed_files_follow_the_ids_not_the_items(spark):
    rows = spark.range(0, 20_000, 4).union(spark.range(4, 8)).selectExpr("id AS doc_id", "'s' || id % 3 AS source")
    line = F.when(F.col("doc_id") != 16, F.concat(F.lit("<item>"), F.col("doc_id").cast("string"), F.lit("</item>")))
    path = Path(q_io.write_xml(spark, rows, "channel", "source", line))
    files = sorted(path.glob("source=*/pack=*/*.txt"))
    assert len(files) == 9                                                 # three sources, three ranges of ids
    got = [[int(i.text) for i in ElementTree.parse(f).getroot()] for f in files]
    assert all(g == sorted(g) for g in got)
    assert sorted(n for g in got for n in g) == sorted([n for n in range(0, 20_000, 4) if n != 16] + [4, 5, 6, 7])


def test_xml_text_equals_the_plain_rules(spark):
    bodies = ["", "a", "<b>x</b>&nbsp;&amp;nbsp; y", "a <b", "&amp;#x2F; &#x2F;", " 　 a\t  b \n<i>é ü</i> 😀  z﻿", "a b", "1 <2> 3 &lt;4&gt;", "é  ü", None]
    got = spark.createDataFrame([(b,) for b in bodies], "c string").select(text.xml_text(F.col("c")).alias("t")).collect()
    for body, row in zip(bodies, got):
        want = re.sub(r"<[^>]+>", " ", body or "")
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&#x2F;", "/")):
            want = want.replace(a, b)
        assert row["t"] == re.sub(r"[\s﻿]+", " ", want).strip(" "), body
