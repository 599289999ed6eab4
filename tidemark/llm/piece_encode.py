"""SentencePiece encoding with spans, and decoding, of whole texts.

A text is normalised by the longest rule of the model's character map at each place, with
the source byte of every byte made.  The result is merged into pieces, and running sums of
the pieces' lengths, looked up in that alignment, project each piece to the bytes of the
original text it stands for.

Both directions are one narrow Arrow pass; the model (its tables, well below a few MB) is
sent once.  Nothing is shuffled, and memory follows the longest text.

Null texts are empty: their ids are begin and end only.  Bytes that are no UTF-8 become the
replacement character.  Rows are not told apart: repeated rows, null ids and equal ids each
give their own row.  Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.piece_model import Decoder, Merger, Normalizer, PieceModel, read_model
from tidemark.llm.tokens import pieces

TOGETHER = 3 << 19  # bytes of text encoded at a time: their words are looked up once
ROWS = 256  # decoded at a time


def load_model(path: str) -> PieceModel:
    """The model in a file the driver can open."""
    with open(path, "rb") as f:
        return read_model(f.read())


def shipped(spark: SparkSession, value: Callable) -> Callable[[], Callable]:
    """``value`` in the tasks: sent once, and unpacked once per worker process.

    A reused worker has the same broadcast variable in all its tasks, so a memo inside the
    value stays warm.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> Callable:
        if not hasattr(sent, "unpacked"):
            sent.unpacked = cloudpickle.loads(sent.value)
        return sent.unpacked

    return get


class Encoder:
    """Packed ids with begin and end, and packed source spans of the pieces between."""

    def __init__(self, model: PieceModel):
        self.normalize, self.merge = Normalizer(model), Merger(model)
        self.begin, self.end = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (model.begin, model.end))

    def __call__(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        made = [self.normalize(t) for t in texts]
        found = self.merge([m.decode() for m, _ in made])
        return [
            (self.begin + f[:, 0].tobytes() + self.end, spans(f[:, 1], source).tobytes())
            for f, (_, source) in zip(found, made)
        ]


def spans(sizes: np.ndarray, source: np.ndarray) -> np.ndarray:
    """First source byte and the one after, of pieces of ``sizes`` bytes of the normalised text."""
    stops = np.cumsum(sizes, dtype=np.int64)
    out = np.empty((len(stops), 2), "<u4")
    if len(stops):
        out[:, 1] = source[stops]
        out[0, 0] = source[0]
        out[1:, 0] = out[:-1, 1]
        # A byte of a character that is not its last one has no text of its own.
        none = sizes == 0
        out[none, 1] = out[none, 0]
    return out


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, ids, spans of every text.

    ``ids`` are unsigned 32-bit integers, little-endian, begin and end included; ``spans``
    are pairs (first byte, byte after) of such integers, one per id between them.
    """
    get = shipped(docs.sparkSession, Encoder(model))
    schema = "doc_id long, ids binary, spans binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for i, j, data, offs in pieces(batch.column(1), TOGETHER):
                raw = data.tobytes()
                cuts = offs.tolist()
                found = encoder([raw[a:b] for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([x for x, _ in found], pa.binary()),
                        pa.array([s for _, s in found], pa.binary()),
                    ],
                    names=["doc_id", "ids", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``encoded`` with the text its ``ids`` stand for as ``decoded``; a null row of ids is empty."""
    get = shipped(encoded.sparkSession, Decoder(model))
    names = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*[F.col(f"`{c}`") for c in names])
    schema = kept.limit(0).withColumn("decoded", F.lit("")).schema
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = get()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = [decoder(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return kept.mapInArrow(run, schema)


def digests(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """Number of ids and hashes of ids, spans and the text decoded from the ids.

    Spans are hashed before decoding, so they do not travel through it.
    """
    slim = encoded.select("doc_id", "ids", F.sha2("spans", 256).alias("spans_sha256"))
    return decode(slim, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "spans_sha256",
    )
