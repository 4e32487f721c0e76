"""Token counts by overlap resynchronisation: huge texts are encoded in overlapping chunks and spliced at proven stable boundaries.

A text of at most `chunk` code points is encoded at once. A longer one is cut into chunks that each reach `overlap` code points into the
next one; chunks are rows, so one document's chunks are encoded by many tasks. Two neighbours are spliced at the first token that both
encodings have at the same place. A document with two neighbours that share no token in their overlap (long runs of one character,
say) is encoded anew with an overlap 16 times as wide, in chunks of four overlaps at least, until every seam holds or one chunk is left.

Why such a seam is proven: merging takes the best pair that adjoins anywhere, the leftmost of equals. How merges inside two adjoining tokens
interleave depends on these two alone, so ids are a text's encoding if and only if each two neighbours are the encoding of their own
characters. With the shared token t, every pair up to t is one of the left chunk's, and every pair from t on is one of the right chunk's.
Counts then add up: the chunks' tokens, less what lies behind t on the left and up to t on the right.

Defined edges: a null or empty text has no tokens and no bytes. Repeated rows are counted each. An empty table gives an empty result. A row
without doc_id is counted like any other. Extra columns are ignored. Special tokens' strings in a text are plain text, as the library has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, WIDER = 1 << 14, 64, 16


class PieceCounter:
    """The library's encoder and how many code points each id stands for (0: bytes within a character)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as protos

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = protos.ModelProto.FromString(self.model.serialized_model_proto())
        rules, kinds = proto.normalizer_spec, protos.ModelProto.SentencePiece.Type
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or proto.trainer_spec.model_type != protos.TrainerSpec.BPE:
            raise ValueError("chunks are spliced for BPE models that leave characters as they are")
        n = self.model.get_piece_size()
        self.length, self.is_byte = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for i, piece in enumerate(proto.pieces):
            self.is_byte[i] = piece.type == kinds.BYTE
            self.length[i] = int(not 0x80 <= int(piece.piece[3:5], 16) < 0xC0) if self.is_byte[i] else 1 if piece.type == kinds.UNKNOWN else len(piece.piece)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, id) of each token; the mark that the library puts before a text lies at -1."""
        ids = np.array(self.model.encode(text), dtype=np.int64)
        ends = np.cumsum(self.length[ids])
        return ends - self.length[ids] - 1, ids


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def packed(starts: np.ndarray, ids: np.ndarray) -> bytes:
    return np.stack([starts, ids]).astype("<i4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4").reshape(2, -1).astype(np.int64)


def seam(left: bytes, right: bytes, own: PieceCounter) -> tuple[int, int] | None:
    """(tokens of the left behind the first shared token, tokens of the right up to and with it), or None if no token is shared.

    left: the left chunk's tokens that start in the overlap; right: all of the right chunk's that do, from its first token on. Starts count from the right chunk's start.
    """
    (a, a_ids), (b, b_ids) = unpacked(left), unpacked(right)
    found = np.flatnonzero(np.isin((a << 32) | a_ids, ((b << 32) | b_ids)[b >= 0]) & ~own.is_byte[a_ids])
    if not len(found):
        return None
    at = int(found[0])
    return len(a) - at - 1, int(np.flatnonzero((b == a[at]) & (b_ids == a_ids[at]))[0]) + 1


FIRST = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())])
CHUNKS = pa.schema([("uid", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])
SIDES = pa.schema([("uid", pa.int64()), ("seam", pa.int32()), ("n", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
SEAMS = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("open", pa.bool_())])


def chunk_totals(long_texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """uid, n_tokens, open (whether a seam found no shared token) of texts (uid, text) that are cut into chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text")):
                whole = text.as_py()
                n = max(1, -(-len(whole) // chunk))
                for first in range(0, n, 64):
                    own = range(first, min(n, first + 64))
                    yield batch_of(CHUNKS, uid=[uid] * len(own), chunk=list(own), last=[c == n - 1 for c in own], text=[whole[c * chunk : (c + 1) * chunk + overlap] for c in own])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {f.name: [] for f in SIDES}
                for uid, c, last, text in zip(*(part.column(name).to_pylist() for name in CHUNKS.names)):
                    starts, ids = own.located(text)
                    lead = starts < overlap
                    rows = [(uid, c, len(ids), None, packed(starts[lead], ids[lead]) if c else None)]
                    if not last:
                        rows.append((uid, c + 1, 0, packed(starts[starts >= chunk] - chunk, ids[starts >= chunk]), None))
                    for name, column in zip(out, zip(*rows)):
                        out[name] += column
                yield batch_of(SIDES, **out)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n, open_ = batch.column("n").to_pylist(), [False] * batch.num_rows
            for i, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"))):
                if left.is_valid and right.is_valid:
                    found = seam(left.as_py(), right.as_py(), own)
                    open_[i], n[i] = found is None, n[i] - sum(found or ())
            yield batch_of(SEAMS, uid=batch.column("uid"), n=n, open=open_)

    chunks = long_texts.select("uid", "text").mapInArrow(cut, "uid long, chunk int, last boolean, text string").repartition("uid", "chunk")
    sides = chunks.mapInArrow(encode, "uid long, seam int, n long, left binary, right binary")
    met = sides.groupBy("uid", "seam").agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    seams = met.select("uid", "n", "left", "right").mapInArrow(match, "uid long, n long, open boolean")
    return seams.groupBy("uid").agg(F.sum("n").alias("n_tokens"), F.max("open").alias("open"))


def count_tokens(docs: DataFrame, model: str = "", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t if t is not None else "" for t in part.column("text").to_pylist()]
                counts = [own.count(t) if len(t) <= chunk else None for t in texts]
                yield batch_of(
                    FIRST, uid=part.column("uid"), doc_id=part.column("doc_id"), n_bytes=[len(t.encode()) for t in texts],
                    n_tokens=counts, text=[t if n is None else None for t, n in zip(texts, counts)],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(rows.mapInArrow(run, "uid long, doc_id long, n_bytes long, n_tokens long, text string"))
    long_texts = first.where(F.col("n_tokens").isNull())
    out, waiting = first.where(F.col("n_tokens").isNotNull()).select("doc_id", "n_bytes", "n_tokens"), long_texts
    while not waiting.isEmpty():
        totals = materialize(chunk_totals(waiting, path, chunk, overlap))
        out = out.unionByName(long_texts.select("uid", "doc_id", "n_bytes").join(totals.where(~F.col("open")), "uid").select("doc_id", "n_bytes", "n_tokens"))
        waiting = long_texts.join(totals.where("open").select("uid"), "uid", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
    return out


def token_digests(docs: DataFrame, limit: int = 4096, model: str = "", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """count_tokens() and over_limit (n_tokens > limit)."""
    return count_tokens(docs, model, chunk, overlap).withColumn("over_limit", F.col("n_tokens") > limit)
