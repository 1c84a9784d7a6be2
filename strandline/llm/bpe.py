"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text where its content says so, hence equal passages of different documents
give equal chunks.  Chunks that occur more than once are encoded once; a document takes their tokens
by a join and encodes only the rest.

Why a join of chunks can be repaired exactly: every alternative of the splitting pattern that takes a
character that is not white space stops before white space.  So where an ASCII space or line feed
follows a printable ASCII character, a piece starts in every encoding that sees both characters, and
the pieces from there on depend only on the text that follows.  Call such a place a seam.  Between its
first and its last seam a chunk's own tokens are those of the whole text; from the last seam of one
reused chunk to the first seam of the next the text is encoded again, over as many chunks as lie
between, which is where both encodings must agree.  The lengths of all decoded tokens are added up and
compared with the text at the end; a disagreement raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bit_test, cut_lineage, hash_bitmap, int64_bits, sorted_groups

SHARED_BITS = 26          # bitmap of shared chunks: 8 MB, whatever the corpus holds
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 128, 9, 4096
SLAB = 4 << 20            # bytes that are hashed at once

_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)
_CODECS: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """One tokenizer in one process: the merges as ranks where they are proven to agree, else the library itself.

    The rank encoder is used for text whose characters all lie below U+0250 and that holds no special
    token; there both were compared character by character (tests/llm/test_llm_bpe.py).
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(json_path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = {i: t.content for i, t in self.full.get_added_tokens_decoder().items()}
        self.pieces = [b""] * (max([*ranks.values(), *special]) + 1)
        for b, i in ranks.items():
            self.pieces[i] = b
        for i, t in special.items():
            self.pieces[i] = t.encode()
        words = "|".join(map(re.escape, special.values()))
        self.careful = re.compile("[^\\x00-\\u024f]" + (f"|{words}" if words else ""))
        self.width = "<u2" if len(self.pieces) <= 1 << 16 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        if self.careful.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=self.width)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.width)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def codec(json_path: str, ranks_path: str) -> Codec:
    key = (json_path, ranks_path)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


# ---- chunks -----------------------------------------------------------------------------------------

def _rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the 16 bytes before is small, moved on to whole characters."""
    found = []
    for start in range(0, len(data), SLAB):
        part = data[max(0, start - 16):start + SLAB]
        h = _GEAR[part]
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] << np.uint32(k)
        at = np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + max(0, start - 16)
        found.append(at[at >= start] + 1)
    cuts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    cuts = cuts[cuts < len(data)]
    for _ in range(3):
        inside = (data[np.minimum(cuts, len(data) - 1)] & 0xC0) == 0x80
        cuts = cuts + inside
    return cuts[cuts < len(data)]


class Chunks:
    """The chunks of one record batch of texts: bounds, hashes and seams."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        self.bytes = b"".join(parts)
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.doc_start = (ends - np.array([len(p) for p in parts], dtype=np.int64)).tolist()
        self.doc_end = ends.tolist()
        cuts = _rolling_cuts(data)
        lo, hi = np.searchsorted(cuts, self.doc_start, "right"), np.searchsorted(cuts, self.doc_end, "left")
        listed = cuts.tolist()
        start, end, doc = [], [], []
        for d, (s, e) in enumerate(zip(self.doc_start, self.doc_end)):
            pos = s
            for c in listed[lo[d]:hi[d]] + [e]:
                while c - pos > MAX_CHUNK:
                    far = pos + MAX_CHUNK
                    while data[far] & 0xC0 == 0x80:
                        far -= 1
                    start.append(pos), end.append(far), doc.append(d)
                    pos = far
                if c > pos and (c == e or c - pos >= MIN_CHUNK):
                    start.append(pos), end.append(c), doc.append(d)
                    pos = c
        self.start, self.end, self.doc = start, end, doc
        if len(data) > 1:
            gap = (data[1:] == 32) | (data[1:] == 10)
            seams = np.flatnonzero(gap & (data[:-1] > 32) & (data[:-1] < 127)) + 1
        else:
            seams = np.zeros(0, dtype=np.int64)
        first = np.searchsorted(seams, np.array(start, dtype=np.int64) + 1, "left")
        last = np.searchsorted(seams, np.array(end, dtype=np.int64), "left") - 1
        ok = first < last
        pad = np.append(seams, 0)
        self.inner_start = np.where(ok, pad[np.minimum(first, len(seams))], 0).tolist()
        self.inner_end = np.where(ok, pad[np.minimum(np.maximum(last, 0), len(seams))], 0).tolist()
        self.usable = ok
        digests = b"".join(xxhash.xxh3_128_digest(self.bytes[s:e]) for s, e in zip(start, end))
        both = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        self.a, self.b = both[:, 0], both[:, 1]


def _text_keys(texts: list[str | None]) -> tuple[list[int], list[int]]:
    pairs = [xxhash.xxh3_128_intdigest((t or "").encode()) for t in texts]
    low = (1 << 64) - 1
    return [int64_bits(p >> 64) for p in pairs], [int64_bits(p & low) for p in pairs]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = Chunks(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(_signed(c.a[c.usable])), pa.array(_signed(c.b[c.usable]))], ["a", "b"])


def _shared_texts(bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch.column(0).to_pylist())
            hit = np.flatnonzero(c.usable & bit_test(bitmap.value, SHARED_BITS, c.a))
            _, one = np.unique(c.b[hit], return_index=True)
            hit = hit[one]
            inner = [c.bytes[c.inner_start[i]:c.inner_end[i]].decode() for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(c.a[hit])), pa.array(_signed(c.b[hit])),
                                              pa.array(inner, pa.string())], ["a", "b", "inner"])
    return run


def _encode_shared(paths: tuple[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(*paths)
        for batch in batches:
            tokens = [enc.encode(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary())], ["a", "b", "tokens"])
    return run


def _occurrences(bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            c = Chunks(texts)
            hit = np.flatnonzero(c.usable & bit_test(bitmap.value, SHARED_BITS, c.a)).tolist()
            t1, t2 = _text_keys(texts)
            doc = [c.doc[i] for i in hit]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(doc, pa.int64())), pa.array([t1[d] for d in doc], pa.int64()),
                pa.array([t2[d] for d in doc], pa.int64()),
                pa.array([c.inner_start[i] - c.doc_start[d] for i, d in zip(hit, doc)], pa.int64()),
                pa.array(_signed(c.a[hit])), pa.array(_signed(c.b[hit]))], ["id", "t1", "t2", "pos", "a", "b"])
    return run


OWN_SCHEMA = "id long, t1 long, t2 long, pos long, size long, tokens binary"


def _own_parts(bitmap, paths: tuple[str, str], finish: Callable, out: list[str], out_schema: pa.Schema) -> Callable:
    """For a text without shared chunks its finished row (pos -2); else a header (pos -1, the text's
    length) and the tokens of each stretch between reused chunks (pos: where it starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(*paths)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            c = Chunks(texts)
            hit = np.flatnonzero(c.usable & bit_test(bitmap.value, SHARED_BITS, c.a)).tolist()
            by_doc: dict[int, list[int]] = {}
            for i in hit:
                by_doc.setdefault(c.doc[i], []).append(i)
            t1, t2 = _text_keys(texts)
            rows: list[tuple[int, int, int, bytes | None]] = []
            done: list[tuple] = []
            blank = tuple(None for _ in out)
            for d, text in enumerate(texts):
                start, end = c.doc_start[d], c.doc_end[d]
                if d not in by_doc:
                    rows.append((d, -2, end - start, None))
                    done.append(finish(enc, [enc.encode(text or "")], end - start))
                    continue
                rows.append((d, -1, end - start, None))
                done.append(blank)
                at = start
                for i in by_doc[d] + [None]:
                    to = end if i is None else c.inner_start[i]
                    if to > at:
                        rows.append((d, at - start, 0, enc.encode(c.bytes[at:to].decode()).tobytes()))
                        done.append(blank)
                    at = end if i is None else c.inner_end[i]
            doc = [r[0] for r in rows]
            cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([t1[d] for d in doc], pa.int64()),
                    pa.array([t2[d] for d in doc], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())]
            cols += [pa.array([x[k] for x in done], f.type) for k, f in enumerate(out_schema)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "t1", "t2", "pos", "size", "tokens", *out])
    return run


def _assemble(paths: tuple[str, str], finish: Callable, out: list[str], out_schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(*paths)
        for group in sorted_groups(batches, ["id", "t1", "t2"]):
            pos = group.column("pos").to_pylist()
            rows = [tuple(group.column(n)[i].as_py() for n in out) for i, p in enumerate(pos) if p == -2]
            heads = [i for i, p in enumerate(pos) if p == -1]
            if heads:
                tokens = {p: group.column("tokens")[i].as_py() for i, p in enumerate(pos) if p >= 0}
                parts = [np.frombuffer(tokens[p], dtype=enc.width) for p in sorted(tokens)]
                rows += [finish(enc, parts, group.column("size")[heads[0]].as_py())] * len(heads)
            ids = pa.array([group.column("id")[0].as_py()] * len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([ids] + [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out_schema)],
                                             ["id", *out])
    return run


def _checked(enc: Codec, parts: list[np.ndarray], size: int) -> tuple[np.ndarray, bytes]:
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=enc.width)
    text = enc.decode(ids)
    if len(text) != size:
        raise ValueError(f"chunk joins disagree: tokens of {len(text)} bytes for a text of {size}")
    return ids, text


def _digests(enc: Codec, parts: list[np.ndarray], size: int) -> tuple:
    ids, text = _checked(enc, parts, size)
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())


def _id_lists(enc: Codec, parts: list[np.ndarray], size: int) -> tuple:
    ids, _ = _checked(enc, parts, size)
    return len(ids), ids.astype("<u4").tobytes()


_DIGESTS = (_digests, pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
            "n_tokens long, ids_sha256 string, decoded_sha256 string")
_IDS = (_id_lists, pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary())]), "n_tokens long, ids binary")


def encode(docs: DataFrame, *, json_path: str, ranks_path: str, key: str = "doc_id", text: str = "text",
           digests: bool = False) -> DataFrame:
    """Token ids of every text: ``key``, n_tokens and ids (little-endian unsigned 32-bit integers), or, with
    ``digests``, the SHA-256 of the ids and of the text they decode to.

    A null text is encoded as the empty one (0 tokens).  Rows with a null key and repeated rows each give
    a row; columns other than ``key`` and ``text`` are ignored, so their names cannot clash.  Text moves
    through no shuffle: only hashes, the distinct shared chunks, and the tokens of documents that hold
    some.  The bitmap only spares work: a chunk it takes for shared wrongly is encoded like a shared one.
    """
    spark = docs.sparkSession
    paths = (json_path, ranks_path)
    finish, schema, ddl = _DIGESTS if digests else _IDS
    out = schema.names
    texts = docs.select(F.col(text).cast("string").alias("text"))
    both = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    seen = texts.mapInArrow(_hashes, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = spark.sparkContext.broadcast(hash_bitmap(seen, "a", SHARED_BITS))
    shared = texts.mapInArrow(_shared_texts(bitmap), "a long, b long, inner string").dropDuplicates(["a", "b"])
    encoded = cut_lineage(shared.mapInArrow(_encode_shared(paths), "a long, b long, tokens binary"), "bpe-chunks")

    taken = both.mapInArrow(_occurrences(bitmap), "id long, t1 long, t2 long, pos long, a long, b long").join(encoded, ["a", "b"])
    own = both.mapInArrow(_own_parts(bitmap, paths, finish, out, schema), f"{OWN_SCHEMA}, {ddl}")
    parts = own.unionByName(taken.select("id", "t1", "t2", "pos", "tokens"), allowMissingColumns=True)
    dealt = parts.repartition("id", "t1", "t2").sortWithinPartitions("id", "t1", "t2", "pos")
    return dealt.mapInArrow(_assemble(paths, finish, out, schema), f"id long, {ddl}").withColumnRenamed("id", key)


def decode(tokens: DataFrame, *, json_path: str, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of ``encode``'s ids, special tokens kept.  Null ids give a null text; bytes that are no valid
    UTF-8 are replaced as the tokenizers library does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(json_path, ranks_path)
        for batch in batches:
            out = [None if b is None else enc.decode(np.frombuffer(b, dtype="<u4")).decode("utf-8", "replace")
                   for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])
    return (tokens.select(F.col(key).cast("long").alias("id"), F.col(ids).alias("ids"))
            .mapInArrow(run, "id long, text string").withColumnRenamed("id", key))
