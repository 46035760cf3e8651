"""Token files: frequency-ranked ids in byte-aligned codes of variable length with separate control bytes.

A file holds documents in ascending key order. Each document is a block of control bytes followed by a
block of data bytes. An id's code is its frequency rank in little-endian order without leading zero
bytes (one byte at least); its length is a field of the control bytes, 1 bit wide for vocabularies of
up to 65,536 ids and 2 bits beyond. The footer has keys, token counts and block offsets, so a reader
takes documents one by one. The rank table is stored once beside the files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType

from stowline.llm.chunks import id_encoder
from stowline.llm.memos import hold
from stowline.llm.tables import attempt_file, new_folder, opened, stored

MAGIC = b"RKVB0001"
_FOOTER = "<QQ8s"
FILE_TOKENS = 16_000_000
GROUP_BYTES = 1 << 20  # documents coded or decoded at a time; a larger one is alone


class Codec:
    """Ranks to control and data bytes and back. Both ways take many documents at a time, each with blocks of its own."""

    def __init__(self, vocabulary: int):
        self.bits = 1 if vocabulary <= 1 << 16 else 2
        self.fields = 8 // self.bits
        shifts = np.arange(self.fields) * self.bits
        # lengths of all codes that one control byte describes
        self.lengths = (((np.arange(256)[:, None] >> shifts) & ((1 << self.bits) - 1)) + 1).astype(np.uint8)
        self.shifts = shifts.astype(np.uint8)

    def _places(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the control bytes of each document, the place of each code's field): a document's fields begin on a whole byte."""
        controls = -(-counts // self.fields)
        gaps = np.cumsum(controls * self.fields - counts) - (controls * self.fields - counts)
        return controls, np.arange(counts.sum()) + np.repeat(gaps, counts)

    def encode_many(self, ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The control and the data blocks of documents that lie one after another, of so many ranks each."""
        ranks = ranks.astype("<u4", copy=False)
        sizes = 1 + (ranks > 0xFF).astype(np.uint8)
        if ranks.max(initial=0) > 0xFFFF:
            sizes += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
        controls, places = self._places(counts)
        fields = np.zeros(int(controls.sum()) * self.fields, np.uint8)
        fields[places] = sizes - 1
        control = np.bitwise_or.reduce(fields.reshape(-1, self.fields) << self.shifts, axis=1) if self.bits > 1 else np.packbits(fields, bitorder="little")
        widest = int(sizes.max(initial=1))
        byte_rows = ranks.view(np.uint8).reshape(-1, 4)[:, :widest]
        data = byte_rows[np.arange(widest, dtype=np.uint8) < sizes[:, None]]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))]
        return _cut(control.astype(np.uint8, copy=False).tobytes(), np.concatenate(([0], np.cumsum(controls)))), _cut(data.tobytes(), ends)

    def decode_many(self, controls: list[bytes], datas: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The ranks of all documents, one after another."""
        _, places = self._places(counts)
        sizes = self.lengths[np.frombuffer(b"".join(controls), np.uint8)].ravel()[places]
        begins = np.cumsum(sizes, dtype=np.int64) - sizes
        padded = np.frombuffer(b"".join(datas) + bytes(3), np.uint8)
        ranks = padded[begins].astype(np.uint32)
        for place in range(1, int(sizes.max(initial=1))):
            longer = np.flatnonzero(sizes > place)
            ranks[longer] |= padded[begins[longer] + place].astype(np.uint32) << np.uint32(8 * place)
        return ranks

    def encode(self, ranks: np.ndarray) -> tuple[bytes, bytes]:
        (control,), (data,) = self.encode_many(ranks, np.array([len(ranks)]))
        return control, data

    def decode(self, control: bytes, data: bytes, count: int) -> np.ndarray:
        return self.decode_many([control], [data], np.array([count]))


def _cut(block: bytes, edges: np.ndarray) -> list[bytes]:
    edges = edges.tolist()
    return [block[low:high] for low, high in zip(edges, edges[1:])]


def _groups(sizes: list[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(low, high) of consecutive rows of about so many bytes together."""
    low = held = 0
    for at, size in enumerate(sizes):
        held += size
        if held >= most:
            yield low, at + 1
            low, held = at + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian integers of the narrowest width that holds the vocabulary."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = id_encoder(tokenizer_file), end_id.to_bytes(4, "little")
        hold(encoder.memo)
        width = _width(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            ids = [one + end for one in encoder.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(one) // 4 for one in ids], pa.int64()),
                    pa.array([one if width == "<u4" else np.frombuffer(one, "<u4").astype(width).tobytes() for one in ids], pa.binary()),
                ],
                [key, "n_tokens", "ids"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def rank_of_ids(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """The rank of every id of the vocabulary, most frequent first; ties by id. Counts cover all documents."""
    width = _width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    # one row per id that occurs: bounded by the vocabulary
    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for id_, n in rows:
        counts[id_] = n
    ranks = np.empty(vocabulary, np.uint32)
    ranks[np.lexsort((np.arange(vocabulary), -counts))] = np.arange(vocabulary, dtype=np.uint32)
    return ranks


def write_files(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    file_tokens: int = FILE_TOKENS,
) -> tuple[DataFrame, str]:
    """(manifest, folder): the manifest has one row (file_no, path, n_docs, n_tokens) per file, in key order.

    Each document's ids are followed by the end id. Null and empty texts are the end id alone. Repeated keys
    stay apart, null keys come first; keys of other types than whole numbers are refused. An empty table gives no files. File names belong to task attempts and
    only the manifest says which count, so retried tasks do no harm.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"column {key} must hold whole numbers")
    folder = folder or new_folder(spark, "token-files")
    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab_size()
    width = _width(vocabulary)
    encoded = stored(encode_documents(docs, tokenizer_file, end_id, key, text), "ids")
    ranks = spark.sparkContext.broadcast(rank_of_ids(encoded, vocabulary))  # one integer per id of the vocabulary
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // file_tokens))
    # file bounds: quantiles of the key, one per file
    steps = [at / files for at in range(1, files)]
    bounds = np.array(encoded.approxQuantile(key, steps, 0.1 / files) if steps else [], np.float64)

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            file_no = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            blocks = batch.column(2).to_pylist()
            controls, datas = [], []
            for low, high in _groups(list(map(len, blocks))):
                counts = np.array([len(ids) // np.dtype(width).itemsize for ids in blocks[low:high]])
                coded = codec.encode_many(ranks.value[np.frombuffer(b"".join(blocks[low:high]), width)], counts)
                controls += coded[0]
                datas += coded[1]
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    batch.column(1),
                    pa.array(file_no, pa.int32()),
                    pa.array(controls, pa.binary()),
                    pa.array(datas, pa.binary()),
                ],
                ["key", "n_tokens", "file_no", "control", "data"],
            )

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        index: list[tuple] = []
        place = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    file_no, path = row["file_no"], attempt_file(folder, f"tokens-{row['file_no']:06d}", ".rkvb")
                    fs, inside = opened(path)
                    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(inside)
                    out.write(MAGIC)
                    place = len(MAGIC)
                out.write(row["control"])
                out.write(row["data"])
                index.append((row["key"], row["n_tokens"], place, len(row["control"]), len(row["data"])))
                place += len(row["control"]) + len(row["data"])
        if out is not None:
            footer = zlib.compress(json.dumps(index).encode(), 1)
            out.write(footer)
            out.write(struct.pack(_FOOTER, place, len(footer), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file_no": [file_no], "path": [path], "n_docs": [len(index)], "n_tokens": [sum(row[1] for row in index)]},
                pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    kind = encoded.schema[key].dataType.simpleString()
    coded = encoded.mapInArrow(to_codes, f"key {kind}, n_tokens long, file_no int, control binary, data binary")
    written = (
        coded.repartitionById(files, F.col("file_no"))
        .sortWithinPartitions("key")
        .mapInArrow(to_file, "file_no int, path string, n_docs long, n_tokens long")
    )
    manifest = stored(written, "token-manifest")
    fs, inside = opened(f"{folder}/ranks.u4")
    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inside) as out:
        out.write(ranks.value.astype("<u4").tobytes())
    return manifest, folder


def read_files(spark: SparkSession, manifest: DataFrame, folder: str, key: str, kind: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the files of the manifest.

    `start` counts the ids of all documents before it; the crc is over ids as little-endian unsigned
    32-bit integers. `decode_file` gives the ids themselves.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("_first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for name, ids in decode_file(path, folder):
                    rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows, batch_schema)
                        rows = []
                if rows:
                    yield _rows(rows, batch_schema)

    batch_schema = pa.schema(
        [(key, pa.from_numpy_dtype({"bigint": "i8", "long": "i8", "int": "i4"}[kind])), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )
    count = max(1, manifest.count())
    spread = files.select("path", "_first").repartition(count, "path")
    return spread.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def decode_file(path: str, folder: str) -> Iterator[tuple]:
    """(key, ids) of each document of one file, a small group of documents at a time."""
    fs, inside = opened(f"{folder}/ranks.u4")
    with fs.open_input_stream(inside) as file:
        ranks = np.frombuffer(file.read(), "<u4")
    id_of_rank = np.empty(len(ranks), np.uint32)
    id_of_rank[ranks] = np.arange(len(ranks), dtype=np.uint32)
    codec = Codec(len(ranks))
    fs, inside = opened(path)
    with fs.open_input_file(inside) as file:
        file.seek(file.size() - struct.calcsize(_FOOTER))
        place, size, magic = struct.unpack(_FOOTER, file.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        file.seek(place)
        index = json.loads(zlib.decompress(file.read(size)))
    with fs.open_input_stream(inside, buffer_size=1 << 20) as file:
        file.read(len(MAGIC))
        for low, high in _groups([controls + datas for *_, controls, datas in index]):
            group = index[low:high]
            blocks = [(file.read(controls), file.read(datas)) for *_, controls, datas in group]
            counts = np.array([count for _, count, *_ in group])
            ids = id_of_rank[codec.decode_many(*zip(*blocks), counts)]
            at = 0
            for key, count, *_ in group:
                yield key, ids[at : at + count]
                at += count
