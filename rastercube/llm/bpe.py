"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Every chunk is pre-tokenised for itself, in parallel. The
pattern decides at a boundary only from the text after it, so two neighbouring chunks agree from the first boundary
that both have inside their overlap: there they are stitched, and each chunk encodes the pieces that begin in its
stretch. Where an overlap has no common boundary (one word or run longer than it), the earlier chunk is carried on
through the next ones until one is found. Decoding concatenates the raw bytes of the ids.

Cases: a null or empty text has no ids; a null doc_id is kept; repeated rows are encoded row by row; an empty table
gives an empty result; other columns are ignored by the query and kept by ``with_tokens``. The strings of special
tokens are ordinary text. An id out of range makes decoding fail with ``IndexError``.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Code points of a chunk, and of the overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Pieces that are kept with their ids in a worker, longer ones are not.
CACHED, CACHED_CHARS = 1 << 18, 32


class Codec:
    """The vocabulary of a rank file; made once in a worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.raw = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.raw[i] = b
        #: The ids as text, for digests.
        self.names = list(map(str, range(len(self.raw))))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, p: str) -> tuple[int, ...]:
        """The ids of one match of the pattern: its bytes merged by rank."""
        got = self.known.get(p)
        if got is None:
            got = tuple(self.one._encode_single_piece(p.encode()))
            if len(p) <= CACHED_CHARS:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[p] = got
        return got

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Where the pieces of text[start:end] begin, as if it were a text of its own, and ``end``."""
        return [start + m.start() for m in self.pattern.finditer(text[start:end])] + [end]

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        if len(text) <= chunk + overlap:
            return self.pattern.findall(text)
        cuts = [self.boundaries(text, a, min(a + chunk + overlap, len(text))) for a in range(0, len(text), chunk)]
        return [p for a, b in stitch(self, text, cuts) for p in self.pattern.findall(text[a:b])]

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        known, piece = self.known, self.piece
        out: list[int] = []
        for p in self.pieces(text, chunk, overlap):
            out += known.get(p) or piece(p)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def listed(self, ids) -> bytes:
        return ",".join(map(self.names.__getitem__, ids)).encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def stitch(c: Codec, text: str, cuts: list[list[int]]) -> list[tuple[int, int]]:
    """Stretches [a, b) that cover the text and begin and end where pieces of the whole text do.

    ``cuts[i]`` has the boundaries of chunk i, the last one being its end. A piece depends only on the text from its
    first code point to one past its last, so a chunk that has one true boundary is right up to its last piece, and
    the first boundary that two chunks share is where the later one becomes right. Only boundaries after a code point
    that is not white space will do: white space is split by what follows it, which a stretch would not have.
    """
    safe = lambda x: not text[x - 1].isspace()
    out, start, mine = [], 0, cuts[0]
    for theirs in cuts[1:]:
        if theirs[-1] <= mine[-1]:
            continue  # the stretch at hand has grown over this chunk
        ours = set(mine[:-1])
        here = next((x for x in theirs if x in ours and x > start and safe(x)), None)
        if here is None:  # go on from the last good boundary until another one turns up
            here, end = next((x for x in mine[-2::-1] if x > start and safe(x)), start), theirs[-1]
            while not any(map(safe, (theirs := c.boundaries(text, here, end))[1:-1])) and end < len(text):
                end = min(len(text), here + 2 * (end - here))
        if here > start:
            out.append((start, here))
        start, mine = here, theirs
    return [*out, (start, len(text))]


def _encode(batch: pa.RecordBatch, path: str) -> dict:
    c = codec(path)
    n, ids_sha, raw_sha = [], [], []
    for t in batch.column("text").to_pylist():
        ids = c.encode(t or "")
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(c.listed(ids)).hexdigest())
        raw_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
    return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": raw_sha}


def _slices(batch: pa.RecordBatch, chunk: int, overlap: int) -> dict:
    key, part, text = [], [], []
    for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
        for i, a in enumerate(range(0, len(t), chunk)):
            key.append(k)
            part.append(i)
            text.append(t[a : a + chunk + overlap])
    return {"key": key, "part": part, "text": text}


def _pretokenise(batch: pa.RecordBatch, path: str, chunk: int) -> dict:
    c = codec(path)
    cuts = [[i * chunk + x for x in c.boundaries(t, 0, len(t))] for i, t in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True)]
    return {"key": batch.column("key"), "part": batch.column("part"), "text": batch.column("text"), "cuts": cuts}


def _encode_part(batch: pa.RecordBatch, path: str) -> dict:
    c = codec(path)
    ids = [[i for p in c.pattern.findall(t) for i in c.piece(p)] for t in batch.column("text").to_pylist()]
    return {"key": batch.column("key"), "part": batch.column("part"), "ids": ids}


def long_ids(long: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, part, ids) of texts longer than a chunk: the ids of a key are those of its parts in order.

    Slices of one text are dealt out over the cluster to be pre-tokenised; one task a text stitches them, which takes
    the text itself and its boundaries; the stretches are dealt out again to be encoded."""
    deal = lambda df: df.repartition("key", "part")
    slices = deal(per_batch(long.select("key", "text"), _slices, "key string, part int, text string", chunk=chunk, overlap=overlap))
    cut = per_batch(slices, _pretokenise, "key string, part int, text string, cuts array<int>", path=path, chunk=chunk)
    out = pa.schema([("key", pa.string()), ("part", pa.int32()), ("text", pa.string())])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        texts = t["text"].to_pylist()
        text = "".join(x[:chunk] for x in texts)
        found = stitch(codec(path), text, t["cuts"].to_pylist())
        return pa.table([[t["key"][0].as_py()] * len(found), range(len(found)), [text[a:b] for a, b in found]], schema=out)

    pieces = cut.groupBy("key").applyInArrow(join, "key string, part int, text string")
    return per_batch(deal(pieces), _encode_part, "key string, part int, ids array<int>", path=path)


def encode_documents(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    most = chunk + overlap
    own = docs.select("doc_id", "text")
    fits = F.coalesce(F.char_length("text"), F.lit(0)) <= most
    short = per_batch(own.where(fits), _encode, schema, path=path)
    # a key of its own for each row: rows may share a doc_id; equal rows give equal ids, one is enough for both
    long = own.where(~fits).withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
    rows = long.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    parts = long_ids(long.dropDuplicates(["key"]), path, chunk, overlap)

    def digest(t: pa.Table) -> pa.Table:
        c, ids_sha, raw_sha, n = codec(path), hashlib.sha256(), hashlib.sha256(), 0
        for ids in t.sort_by("part")["ids"].to_pylist():
            if ids:
                ids_sha.update((b"," if n else b"") + c.listed(ids))
                raw_sha.update(c.decode(ids))
                n += len(ids)
        return pa.table([[t["key"][0].as_py()], [n], [ids_sha.hexdigest()], [raw_sha.hexdigest()]], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = parts.groupBy("key").applyInArrow(digest, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    done = done.join(rows, "key").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return short.unionByName(done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def _tokens(batch: pa.RecordBatch, path: str) -> dict:
    """Ids as one flat array, a text at a time, so that Python holds the list of one text only."""
    c, flat, offsets, same = codec(path), [np.zeros(0, np.int32)], [0], []
    for t in batch.column("text").to_pylist():
        ids = c.encode(t or "")
        same.append(c.decode(ids) == (t or "").encode())
        flat.append(np.array(ids, np.int32))
        offsets.append(offsets[-1] + len(ids))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))
    return {n: batch.column(n) for n in batch.schema.names} | {"ids": ids, "round_trip": same}


def with_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``ids`` and ``round_trip`` (the ids decode to the text's bytes), row by row (a text's chunks in one
    task), no shuffle."""
    return per_batch(docs, _tokens, f"{docs._jdf.schema().toDDL()}, ids array<int>, round_trip boolean", most=1 << 21, path=path)


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``tokens`` with the bytes of ``ids`` as column ``raw``."""

    def f(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return {n: batch.column(n) for n in batch.schema.names} | {"raw": [c.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return per_batch(tokens, f, f"{tokens._jdf.schema().toDDL()}, raw binary")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
