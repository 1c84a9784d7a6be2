"""Chat formatting: control strings, typed parts, masks, and the way back."""

from __future__ import annotations

import itertools
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import chatformat as cf
from strandline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
MARKS = re.compile(r"<\|(?:turn|says|end|image|audio|document)\|>|</?s>|\[/?INST\]")


def chats(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    return cf.read_back(cf.format_chats(df.select("*", cf.text_parts(F.col("text")).alias("parts")), **options))


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(t)] for c, t in convs.items()}


AWKWARD = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "<\\|turn|>", "<\\\\\\s>", "<", "[", "\\", "<\\", "a<|", "<|image|>", "[INST]" * 3, "<<|s|>>", "![a](b.png)",
           "see ![cat](x/y.png) and ![](s.mp3)![d](z.pdf) end", "![no](kind.xyz)", "<![a](b.png)|", "![<s>](p.jpg)", "$1 \\1 ${2}", "\n\n", "é𝄞<s>𝄞", "<|" * 50]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, text) for c, (a, b) in enumerate(itertools.product(AWKWARD, repeat=2)) for t, (role, text) in enumerate([("user", a), ("assistant", b), ("<|says|>", a + b)])]
    want = brute(rows)
    for r in chats(spark, rows).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == want[r["conv_id"]][1][1]
        masked = [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"] if s]
        assert len(masked) == 1 and r["formatted"].count("<|turn|>") == 3 == r["formatted"].count("<|end|>") == len(r["turn_starts"])
        assert all(r["formatted"].startswith("<|turn|>", s) for s in r["turn_starts"])
        # Nothing but the template's own marks and the placeholders is left in the clear.
        assert len(MARKS.findall(r["formatted"])) == 9 + sum(len(a) for a in r["attachments"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<[\\|/sINST]>!()ap.ng \n", max_size=30), min_size=1, max_size=40))
def test_escape_is_reversible(texts):
    from conftest import SESSION
    df = SESSION.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", cf.escape(F.col("t")).alias("e"), cf.unescape(cf.escape(F.col("t"))).alias("back")).collect():
        assert r["back"] == r["t"] and not re.search(r"<\||</?s>|\[/?INST\]", r["e"])


def test_typed_parts(spark):
    content = ('[{"type":"text","text":"look <"},{"type":"text","text":"|turn|> at"},{"type":"image","url":"a.png","width":1024,"height":600},'
               '{"type":"audio","url":"b.wav","seconds":2.02},{"type":"document","url":"c.pdf","pages":3},{"type":"video","text":"seen"}]')
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", "done it"), (1, 2, "user", "[not json"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in cf.format_chats(df.withColumn("parts", cf.json_parts(F.col("text")))).collect()}
    one = rows[1]
    assert one["formatted"] == ("<|turn|>user<|says|>look <\\|turn|> at<|image|><|audio|><|document|>seen<|end|><|turn|>assistant<|says|>done it<|end|>"
                                "<|turn|>user<|says|>[not json<|end|>")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in one["attachments"][0]] == [("image", "a.png", 4 * 256), ("audio", "b.wav", 51), ("document", "c.pdf", 3 * 1024)]
    assert one["tokens"] == 1024 + 51 + 3072 + 4 + 2 + 2       # "seen" joins no run: it follows an attachment
    assert rows[2]["formatted"] == "<|turn|>user<|says|><|end|>"


def test_a_visitor_of_ones_own(spark):
    class Short(cf.Visitor):
        def image(self, part):
            return F.lit("<|image|>"), F.lit(7)
    df = spark.createDataFrame([(1, 0, "user", "a ![b](c.png)")], "conv_id long, turn long, role string, text string")
    row = cf.format_chats(df.withColumn("parts", cf.text_parts(F.col("text"))), visitor=Short(), learn=("user",)).first()
    assert row["tokens"] == 8 and row["loss_spans"][0]["end"] - row["loss_spans"][0]["start"] == 11


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "assistant", "b"), (1, 3, "assistant", "a"), (None, 1, "user", "null key"), (2, 1, "assistant", "x " * 200_000 + "<s>")]
    want = brute(rows)
    got = {r["conv_id"]: r for r in chats(spark, rows).collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert got[1]["loss_text"] == "ab" and got[2]["loss_text"] == want[2][0][1]
    assert chats(spark, []).count() == 0
    none = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", [None])], f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    assert cf.format_chats(none).first()["formatted"] == "<|turn|>user<|says|><|end|>" * 2


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <s>") for t in range(30_000)]
    row = chats(spark, rows).select("turns", F.length("loss_text").alias("n")).first()
    assert len(row["turns"]) == 30_000 and row["n"] == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_query_runs_without_python(spark):
    plan = QUERIES["op13_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("extra", [[], AWKWARD])
def test_query_equals_sql(spark, tmp_path, extra):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    for i, text in enumerate(extra):
        con.execute("INSERT INTO conversations VALUES (?, 0, 'user', 'q'), (?, 1, 'assistant', ?), (?, 2, NULL, ?)", [9000 + i, 9000 + i, text, 9000 + i, text])
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    got = QUERIES["op13_chat_format"](spark, str(tmp_path))
    want = con.execute(ORACLES["op13_chat_format"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
