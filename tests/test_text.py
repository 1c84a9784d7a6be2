"""Text cleaning and extraction on the fixed strings."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strandline import vocab
from strandline.functions import text
from strandline.plans import ingest

FENCED = "Intro text\n```python\nimport os  # CVE-2024-12345\nhost = '203.0.113.7'\n```\nOutro `inline` text"


def test_fenced_block_keeps_content_inline(one):
    blocks = one(text.code_blocks(F.col("t")), t=FENCED)
    assert [(b.language, b.content.startswith("import os")) for b in blocks] == [("python", True)]
    plain = one(text.unfenced(F.col("t")), t=FENCED)
    assert "```" not in plain and "`" not in plain and "CVE-2024-12345" in plain and "inline" in plain


def test_iocs_come_from_code_too(one):
    got = one(text.iocs(F.col("t")), t=FENCED)
    assert got.cves == ["CVE-2024-12345"] and got.ips == ["203.0.113.7"]


def test_two_blocks_and_default_language(one):
    blocks = one(text.code_blocks(F.col("t")), t="```bash\nls -la\n```\nthen\n```json\n{\"a\": 1}\n```\n``` \n ```")
    assert [(b.language, b.content) for b in blocks] == [("bash", "ls -la"), ("json", '{"a": 1}')]
    assert one(text.code_blocks(F.col("t")), t="```\nx\n```")[0].language == "text"


def test_labelled_hashes_are_lowered_and_distinct(one):
    sha = "A" * 64
    got = one(text.iocs(F.col("t")), t=f"SHA256: {sha} and hash={sha.lower()} md5 = {'b' * 32} bare {'c' * 64}")
    assert got.hashes.sha256 == ["a" * 64] and got.hashes.md5 == ["b" * 32]


def test_url_punctuation_is_cut(one):
    got = one(text.iocs(F.col("t")), t="see https://a.org/x?y=1. and (https://a.org/x?y=1), cve-2023-1111")
    assert got.urls == ["https://a.org/x?y=1"] and got.cves == ["CVE-2023-1111"]


def test_empty_text(one):
    assert one(text.code_blocks(F.col("t")), t="") == []
    assert one(text.iocs(F.col("t")), t="").cves == []
    assert one(text.clean_plaintext("cast(null as string)")) == ""


@pytest.mark.parametrize("raw, want", [
    ("We use \\textbf{bold} and \\cite{smith2020} words.", "We use bold and words."),
    ("Loss $\\frac{a}{b}$ here, n $n=100$ kept", "Loss here, n $n=100$ kept"),
    ("before $$ x = \\sum_i y_i $$ after", "before after"),
    ("a \\[ E = mc^2 \\] b \\( q \\) c", "a b c"),
    ("<p>Tom &amp; Jerry&nbsp;&mdash; <b>win</b></p><script>var x = '<p>';</script>", "Tom & Jerry — win"),
    ("# Title\n\n\n\n**bold** _x_ [link](http://a.b) ![img](http://c.d)", "Title\n\nbold _x_ link !img"),
    ("The post Great news appeared first on Some Blog. Next", "Next"),
    ("Body text. Read more... » End", "Body text. End"),
    ("a ---- b ©2024 c​d­e", "a b 2024 c de"),
    ("x ~ y {z} f{a b}c", "x y z f{a b}c"),
])
def test_clean_plaintext_cases(one, raw, want):
    got = one(text.clean_plaintext("t"), t=raw)
    assert re.sub(r" +", " ", got) == want


def test_guards_never_change_the_result(one):
    """The guarded cleaner equals the same rules applied without guards."""
    plain = text.js_trim(text.apply_rules(F.col("t"), [r for _g, rules in text.PLAINTEXT_RULES for r in rules]))
    for raw in ["plain words only", "a &lt;b&gt; c", "~~ x ~~~~ y", "tab\there  two", "View Full Article here. x", "é à ü ©", FENCED,
                "<style>p{}</style><p>x</p> \\emph{y} ``z``", "- - -- --- ---- =-=-= ***a*** __b__", "subscribe now to it. Click here to win. x"]:
        assert one(text.clean_plaintext("t"), t=raw) == one(plain, t=raw), raw


def test_clean_text_and_counts(one):
    assert one(text.clean_text("t"), t="  <b>A</b>&amp;B® \n c ") == "A &B c"
    assert one(text.word_count(F.col("t")), t=" a  b\nc ") == 3
    assert one(text.word_count(F.col("t")), t="") == 0
    assert one(text.label_format(F.col("t")), t="llm_threats") == "Llm Threats"
    assert one(text.label_format(F.col("t")), t="") == "Unknown"


def test_clean_sources_is_idempotent(spark):
    rows = spark.createDataFrame(
        [("1", "T &amp; U", "<p>x `y`</p>", None), ("2", "T &amp; U", "<p>x</p>", vocab.CLEANING_VERSION)],
        "id string, title string, full_text string, cleaning_version string").withColumn("publisher", F.lit("P"))
    once = ingest.clean_sources(rows)
    got = {r.id: r for r in once.collect()}
    assert got["1"].title == "T & U" and got["1"].full_text == "x y" and got["1"].raw_text == "<p>x `y`</p>"
    assert got["2"].title == "T &amp; U" and got["2"].full_text == "<p>x</p>"
    twice = ingest.clean_sources(once)
    assert sorted(map(str, once.select("id", "title", "full_text", "raw_text").collect())) == \
        sorted(map(str, twice.select("id", "title", "full_text", "raw_text").collect()))
