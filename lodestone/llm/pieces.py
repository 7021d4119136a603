"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no vocabulary piece holds a white-space marker behind another character, merges never cross from a character into a
marker. A text then falls into chunks (markers, then the characters up to the next marker) that segment independently:
each distinct chunk is segmented once, and a text's ids are its chunks' ids joined by position. Models of another kind
(pieces that cross markers, a normaliser that rewrites text) go through the library text by text.

The table belongs to a worker process and outlives its tasks. It holds a bounded number of chunks in two generations: when
the younger one is full the older one goes, and what is used again moves on, so common chunks are segmented once a worker and
memory does not grow with the corpus. Nothing is shuffled: sending every rare chunk to one place and its ids back by position
would move several times the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, bounded_batches, resident

#: The library's white-space marker.
MARK = "▁"
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Encodes texts with a SentencePiece model; each of two generations holds ``most`` chunks and those of a batch."""

    def __init__(self, model: bytes, most: int = 200_000):
        import sentencepiece

        self.lib, self.most = sentencepiece.SentencePieceProcessor(model_proto=model), most
        #: ids by chunk as decimal text with commas, and the decoded text of chunks that do not read back as themselves
        self.ids, self.before, self.odd = {}, {}, {}
        self.apart = separable(model)

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks. A chunk's key is the chunk without its first marker."""
        if len(self.ids) > self.most:
            self.ids, self.before = {}, self.ids
            self.odd = {k: v for k, v in self.odd.items() if k in self.before}
        new = []
        for c in chunks.difference(self.ids):
            got = self.before.get(c)
            if got is None:
                new.append(c)
            else:
                self.ids[c] = got
        found = self.lib.encode(new, num_threads=1)
        found = [ids if key else [self.lib.piece_to_id(MARK)] for key, ids in zip(new, found)]
        for key, ids, text in zip(new, found, self.lib.decode(found, num_threads=1)):
            self.ids[key] = ",".join(map(str, ids))
            if text != key.replace(MARK, " "):
                self.odd[key] = text

    def chunks(self, text: str) -> list[str]:
        """The keys of the text's chunks, in order."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return [x[1:] for x in _RUN.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def joined(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids as decimal text with commas, and its decoded text."""
        if not self.apart:
            for ids in self.lib.encode(texts, num_threads=1):
                yield ",".join(map(str, ids)), self.lib.decode(ids)
            return
        cut = [self.chunks(t) for t in texts]
        own = set().union(*cut) if cut else set()
        self.learn(own)
        odd = own.intersection(self.odd)
        for text, keys in zip(texts, cut):
            if odd and not odd.isdisjoint(keys):
                said = "".join(" " + self.odd.get(k, k.replace(MARK, " ")) for k in keys)[1:]
            else:
                said = text.replace(MARK, " ")
            yield ",".join(map(self.ids.__getitem__, keys)), said

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        return [[int(x) for x in ids.split(",")] if ids else [] for ids, _ in self.joined(texts)]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, and the SHA-256 of the ids (decimal, commas) and of the decoded text."""
        for ids, said in self.joined(texts):
            yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def separable(model: bytes) -> bool:
    """Whether chunks segment independently: plain normaliser, markers only in front, none inside a piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm, train = proto.normalizer_spec, proto.trainer_spec
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    pieces = {p.piece for p in proto.pieces}
    own = any(p.type == 4 for p in proto.pieces)  # symbols of the user's own match first, wherever they stand
    return bool(plain and not own and train.model_type == 2 and not train.treat_whitespace_as_suffix and MARK in pieces and not any(MARK in p.lstrip(MARK) or " " in p for p in pieces))


def read_model(path: str) -> bytes:
    """A vocabulary file on the driver; its bytes go to the executors."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids. Other columns are not read."""
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(parts):
        table = resident("chunks", (zlib.crc32(model), len(model)), lambda: ChunkTable(model))
        for part in parts:
            rows, texts = part.column(0), part.column(1).to_pylist()
            for a, b in batches(texts):
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), pa.array(table.encode([t or "" for t in texts[a:b]]), schema.field(1).type)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the library's decode of each id list; null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(parts):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([lib.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], schema=schema)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded. A null text counts as empty.

    Rows repeat as they come, ids may be null, other columns are not read, an empty table gives an empty result.
    """
    bounded_batches(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(parts):
        table = resident("chunks", (zlib.crc32(model), len(model)), lambda: ChunkTable(model))
        for part in parts:
            rows, texts = part.column(0), part.column(1).to_pylist()
            for a, b in batches(texts):
                found = list(zip(*table.digests([t or "" for t in texts[a:b]])))
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[1:]))], schema=schema)

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, out)
