"""Byte-level BPE encoding and decoding.

Method: ranked merges are folded over the byte arrays of distinct words. `encode_documents` does so
in Arrow batches: it splits texts into words, folds each distinct word of a worker once and
concatenates the ids; decoding concatenates the tokens' byte pieces. `fold_words` is the same fold
as Spark higher-order functions with a literal rank map, for a table of distinct words; it gives the
same ids, but evaluates lambdas per byte pair (figures in the README), so it isn't the main path.

Defined results: a null or empty text has no tokens and decodes to no bytes; special tokens' strings
are ordinary text; repeated rows are encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm import vocab
from basalt.llm.common import map_arrow, text_chunks

ENCODED = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(batch, path: str, pattern: str):
    encode, merges = vocab.byte_encoder(path, pattern), vocab.ranked_merges(path)
    doc_ids = batch.column("doc_id")
    for b, e, texts in text_chunks(batch.column("text"), vocab.TOKEN_CHUNK):
        ids = encode(texts)
        yield doc_ids.slice(b, e - b), ids, [merges.decode(x) for x in ids]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text, and the bytes that the ids decode to.

    `path` is a rank file (base64 piece and rank a line), `pattern` the splitting pattern.
    """

    def run(batch):
        for doc_ids, ids, decoded in _encoded(batch, path, pattern):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32())), pa.array([x.tobytes() for x in decoded], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(_input(docs, id_col, text_col), run, ENCODED)


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and SHA-256 of ids (unsigned 32-bit, little end first) and of decoded bytes."""

    def run(batch):
        for doc_ids, ids, decoded in _encoded(batch, path, pattern):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(list(map(len, ids)), pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_input(docs, id_col, text_col), run, DIGESTS)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def rank_maps(path: str, buckets: int = 2048) -> Column:
    """The ranks as a literal: maps from piece (hexadecimal) to rank, dealt by crc32 since a lookup scans its map."""
    import zlib

    dealt: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    for piece, rank in vocab.ranked_merges(path).ranks.items():
        key = piece.hex().upper()
        dealt[zlib.crc32(key.encode()) % buckets].append((key, rank))
    none = [F.lit("").alias("k"), F.lit(-1).alias("v")]
    return F.array(*[F.map_from_arrays(F.array(*[F.lit(k) for k, _ in d]), F.array(*[F.lit(v) for _, v in d])) if d else F.create_map(*none) for d in dealt])


def fold_words(words: DataFrame, path: str, word_col: str = "word", buckets: int = 2048) -> DataFrame:
    """Column `ids` for a table of distinct words, by higher-order functions only."""
    maps = rank_maps(path, buckets)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(F.col("_ranks"), (F.crc32(piece.cast("binary")) % buckets + 1).cast("int")), piece)

    def merge(parts: Column, _: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.coalesce(rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))), F.lit(1 << 30)))
        lowest = F.array_min(ranks)
        at = F.array_position(ranks, lowest).cast("int")
        joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, F.size(parts)))
        return F.when(F.size(parts) < 2, parts).otherwise(F.when(lowest < (1 << 30), joined).otherwise(parts))

    hexed, size = F.hex(F.col(word_col).cast("binary")), F.octet_length(word_col)
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), size), parts, merge)
    one = words.sparkSession.range(1).select(maps.alias("_ranks"))
    return words.where(F.length(word_col) > 0).crossJoin(F.broadcast(one)).select(word_col, F.transform(folded, rank).alias("ids"))
