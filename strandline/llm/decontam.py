"""Benchmark decontamination by templates.

Numbers, names and units of a text are replaced by typed placeholders, so a benchmark question and the
same question with other values have one template.  Windows of template tokens are hash-joined; what
stood in the placeholders (the slots) is carried along, and windows that lie on one diagonal of a
document and an item count only if their slots are filled consistently: one value of the item is one
value in the document and the other way round.

Items that templates cannot hold (mostly placeholders, or so short that one window decides) are searched for
as they stand, too: windows of their lower-cased words go through the same join, without slots.  Each Chinese
or Japanese character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import words as wd
from strandline.llm.common import bit_test, cut_lineage, hash_bitmap, row_key

WINDOW = 8                # template tokens of a window
LEAST_WORDS = 5           # items with fewer words have no template and are only searched for as they stand
LEAST_LITERALS = 0.5      # share of a window's tokens that are words, not placeholders
COVERAGE = 0.5            # share of an item's windows that a document must hold
FILTER_BITS = 24          # bitmap of benchmark windows: 2 MB, whatever the benchmark holds

NUMBER, NAME, UNIT = (np.uint64(k) for k in (0x11, 0x22, 0x33))
UNITS = ["km", "m", "cm", "mm", "mi", "mile", "miles", "kg", "g", "mg", "lb", "lbs", "l", "ml", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "percent", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "degrees"]
_UNIT_HASHES: list[np.ndarray] = []


def templates(w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """(template token hashes, is it a placeholder).  A number is a run of digits; a unit is a unit word after a
    number; a name is a capitalised word inside a sentence; all other words stand for themselves, lower-cased."""
    if not _UNIT_HASHES:
        _UNIT_HASHES.append(np.sort(np.array([wd.word_hash(u) for u in UNITS], dtype=np.uint64)))
    units = _UNIT_HASHES[0]
    after_number = np.concatenate([[False], w.number[:-1] & (w.doc[1:] == w.doc[:-1])]) if len(w) else w.number
    known = units[np.minimum(np.searchsorted(units, w.hash), len(units) - 1)] == w.hash
    unit = after_number & known
    name = w.capital & ~w.opens & ~unit
    out = np.where(w.number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, w.hash)))
    return out.astype(np.uint64), w.number | unit | name


def windows(w: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, enough literals) of every window of ``size`` words inside one text."""
    token, slot = templates(w)
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), slot
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + token[k:k + n]
    filled = np.concatenate([[0], np.cumsum(slot)])
    literal = size - (filled[size:] - filled[:-size])
    ok = (w.doc[:n] == w.doc[size - 1:]) & (literal >= size * LEAST_LITERALS)
    at = np.flatnonzero(ok)
    return at, wd.mix(h[at]), slot


def exact_windows(w: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``size`` lower-cased words inside one text."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.full(n, 1000 + size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[k:k + n]
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1:])
    return at, wd.mix(h[at])


SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())]))
SCHEMA = "id long, text_a long, text_b long, pos long, size int, h long, slots array<struct<at:int,value:long>>"


def _emit(keys: list[pa.Array], w: wd.Words, base: np.ndarray, size: int, at: np.ndarray, h: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    marks = [[{"at": k, "value": v} for k, v in zip(np.flatnonzero(slot[a:a + size]).tolist(),
                                                    w.hash[a:a + size][slot[a:a + size]].view(np.int64).tolist())] for a in at.tolist()]
    doc = pa.array(w.doc[at])
    return pa.RecordBatch.from_arrays(
        [k.take(doc) for k in keys] + [pa.array(at - base[w.doc[at]]), pa.array(np.full(len(at), size, dtype=np.int32)),
                                       pa.array(h.view(np.int64)), pa.array(marks, SLOTS)],
        ["id", "text_a", "text_b", "pos", "size", "h", "slots"])


def _item_windows(size: int, coverage: float):
    """Windows of the items; an item shorter than ``size`` is one window of its own length.  Exact windows have the
    negative size; they are given to items whose template windows, without the first (its first word may be a name
    elsewhere), do not reach ``coverage``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = wd.scan(batch.column(3).to_pylist(), unspaced=True)
            runs = w.runs(batch.num_rows)
            count = np.diff(runs)
            kept, later = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            keys = [batch.column(i) for i in range(3)]
            for length in sorted({size} | {int(c) for c in count if LEAST_WORDS <= c < size}):
                at, h, slot = windows(w, length)
                mine = count[w.doc[at]]
                keep = mine >= size if length == size else mine == length
                at, h = at[keep], h[keep]
                np.add.at(kept, w.doc[at], 1)
                np.add.at(later, w.doc[at[at > runs[w.doc[at]]]], 1)
                yield _emit(keys, w, runs[:-1], length, at, h, slot)
            few = (count > 0) & ((kept == 0) | (later < coverage * kept))
            none = np.zeros(len(w), dtype=bool)
            for length in sorted({min(int(c), size) for c in count[few]}):
                at, h = exact_windows(w, length)
                keep = few[w.doc[at]] & (np.minimum(count[w.doc[at]], size) == length)
                yield _emit(keys, w, runs[:-1], -length, at[keep], h[keep], none)
    return run


def _hits(bitmap, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for first in range(0, len(texts), 256):
                part = batch.slice(first, 256)
                w = wd.scan(texts[first:first + 256], unspaced=True)
                runs = w.runs(part.num_rows)
                keys = [part.column(i) for i in range(3)]
                for size in sizes:
                    at, h, slot = windows(w, size) if size > 0 else (*exact_windows(w, -size), np.zeros(len(w), dtype=bool))
                    hit = bit_test(bitmap.value, FILTER_BITS, h)
                    if size < 0 and hit.any():  # without slots, one occurrence of a window says all
                        some = np.flatnonzero(hit)
                        _, once = np.unique(np.stack([w.doc[at[some]].astype(np.uint64), h[some]]), axis=1, return_index=True)
                        hit = np.zeros(len(hit), dtype=bool)
                        hit[some[once]] = True
                    if hit.any():
                        yield _emit(keys, w, runs[:-1], size, at[hit], h[hit], slot)
    return run


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    k = row_key(F.col(text).cast("string"))
    return df.select(F.col(key).cast("long").alias("id"), k["a"].alias("text_a"), k["b"].alias("text_b"),
                     F.col(text).cast("string").alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
            item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item it contains: id, text_a, text_b (the document's row), item_id,
    n_windows (of the item), matched (of these, in the document), coverage and kind.

    kind is ``verbatim`` if every slot holds the item's own value, else ``reparameterised``.  Null and empty
    texts match nothing; items that are short or mostly numbers and names also match as they stand, whatever the
    case (the better of the two counts); repeated rows of a document (same key and text) give one row; equal
    items match alike.  Other columns are never read.
    """
    spark = docs.sparkSession
    items = cut_lineage(_keyed(benchmark, item_key, item_text).dropDuplicates(["id", "text_a", "text_b"])
                        .mapInArrow(_item_windows(window, coverage), SCHEMA), "decontam-items")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most twice ``window`` values
    bitmap = spark.sparkContext.broadcast(hash_bitmap(items, "h", FILTER_BITS))
    hits = _keyed(docs, key, text).mapInArrow(_hits(bitmap, sizes), SCHEMA)
    asked = items.select(F.struct("id", "text_a", "text_b", (F.col("size") < 0).alias("exact")).alias("item"), F.col("pos").alias("item_pos"), "size", "h",
                         F.col("slots").alias("item_slots"))
    doc = ["id", "text_a", "text_b"]
    met = hits.join(asked, ["size", "h"])
    filled = F.transform(F.arrays_zip("item_slots", "slots"),
                         lambda z: F.struct(z["item_slots"]["value"].alias("i"), z["slots"]["value"].alias("d")))
    # One diagonal holds each window of the item at most once, so its lists are bounded by the item.
    lines = met.groupBy(*doc, "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(filled))).alias("pairs"))
    one_way = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    back = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"])))
    same = F.forall("pairs", lambda p: p["i"] == p["d"])
    held = lines.where(one_way & back).select(*doc, "item", same.alias("same"), F.explode("at").alias("at"))
    found = held.groupBy(*doc, "item", "at").agg(F.max("same").alias("same")) \
        .groupBy(*doc, "item").agg(F.count("*").alias("matched"), F.min("same").alias("same"))
    totals = asked.groupBy("item").agg(F.countDistinct("item_pos").alias("n_windows"))
    share = F.col("matched") / F.col("n_windows")
    # An item found both by templates and as it stands is one row, of the better of the two.
    best = F.max(F.struct(share.alias("share"), "same", (~F.col("item.exact")).alias("typed"), "n_windows", "matched")).alias("best")
    return found.join(totals, "item").where(share >= coverage) \
        .groupBy(*doc, F.col("item.id").alias("item_id"), F.col("item.text_a").alias("item_a"), F.col("item.text_b").alias("item_b")).agg(best).select(
        *doc, "item_id", "best.n_windows", "best.matched", F.col("best.share").alias("coverage"),
        F.when(F.col("best.same"), "verbatim").otherwise("reparameterised").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; all columns stay, whatever their names.

    Rows with null keys or texts stay (a null text contains nothing)."""
    bad = matches(docs, benchmark, key=key, text=text, **options).select("id", "text_a", "text_b").distinct()
    k = row_key(F.col(text).cast("string"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), k["a"].alias("ka"), k["b"].alias("kb"))
    same = whole["k"].eqNullSafe(bad["id"]) & (whole["ka"] == bad["text_a"]) & (whole["kb"] == bad["text_b"])
    return whole.join(bad, same, "left_anti").select("row.*")
