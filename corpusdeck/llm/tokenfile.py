"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file's rows are blocks of whole documents in ascending id order. A block holds

* the ids that occur in it, most frequent first (an id's place is its rank),
* control bytes, two bits per token: one less than the number of bytes of its rank, four tokens a byte,
* data bytes: the ranks, little-endian, 1 to 4 bytes each,
* ids and token counts of its documents.

The decoder looks each control byte up in a table of lengths and offsets and gathers whole arrays, so that
no token is handled by itself. Ranks are taken over all tokens of the block: files can be written in one
pass and read in part, and frequent ids of that stretch take one byte.

A null text is empty: its document has the end id only. Null ids come first. Repeated rows are all
written. An empty table gives an empty file. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusdeck.llm.common import raw_text
from corpusdeck.llm.tokens import encoder

#: Ids below this are counted in a table; a vocabulary's ids are. Larger ones are sorted.
TABLE = 1 << 22
#: Tokens after which a block ends.
BLOCK_TOKENS = 4_000_000

#: For each control byte: the four lengths, where each value begins, and the sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
BEGINS = np.cumsum(LENGTHS, axis=1) - LENGTHS
SUMS = LENGTHS.sum(axis=1)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``(ranked ids, control bytes, data bytes)``; equally frequent ids in ascending order."""
    if len(ids) and int(ids.max()) < TABLE:
        counts = np.bincount(ids)
        values, inverse = np.flatnonzero(counts), ids
        counts = counts[values]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(int(values[-1]) + 1 if inverse is ids else len(order), np.uint32)
    rank[values[order] if inverse is ids else order] = np.arange(len(order))
    ranks = np.append(rank[inverse], np.zeros(-len(ids) % 4, np.uint32)).astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= code[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used]
    return values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranked: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    controls = np.frombuffer(control, np.uint8)
    ends = np.cumsum(SUMS[controls])
    at = ((ends - SUMS[controls])[:, None] + BEGINS[controls]).reshape(-1)[:count]
    lengths = LENGTHS[controls].reshape(-1)[:count]
    raw = np.frombuffer(data + bytes(4), np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


BLOCKS = "part long, block long, n_tokens long, ranked binary, control binary, data binary, doc_ids array<long>, sizes array<long>"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _block(part: int, number: int, ids: list[bytes], docs: list[int | None]) -> pa.RecordBatch:
    sizes = [len(x) // 4 for x in ids]
    ranked, control, data = encode_block(np.frombuffer(b"".join(ids), "<u4"))
    whole, binary, longs = pa.int64(), pa.binary(), pa.list_(pa.int64())
    row = [(part, whole), (number, whole), (sum(sizes), whole), (ranked, binary), (control, binary), (data, binary), (docs, longs), (sizes, longs)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=NAMES)


def _blocks(kind: str, path: str, end: int):
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        encode = encoder(kind, path).encode
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids.append(own + tail)
                docs.append(doc)
                held += len(own) // 4 + 1
                if held >= BLOCK_TOKENS:
                    yield _block(part, number, ids, docs)
                    number, ids, docs, held = number + 1, [], [], 0
        if docs:
            yield _block(part, number, ids, docs)

    return run


def write_tokens(
    docs: DataFrame, target: str, path: str, kind: str = "blank_led", end: int = 2, doc: str = "doc_id", text: str = "text"
) -> None:
    """Encode all texts and write token files below ``target``.

    Documents are dealt to tasks by ranges of their id, so that files follow each other in that order;
    rows of one id are spread by their place in the input, so that no id is too large for a task."""
    keyed = docs.select(
        F.col(doc).cast("long").alias("doc_id"), raw_text(text).alias("text"), F.monotonically_increasing_id().alias("_place")
    )
    ordered = keyed.repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id", "_place").select("doc_id", "text")
    ordered.mapInArrow(_blocks(kind, path, end), BLOCKS).write.option("compression", "zstd").parquet(target)


def read_tokens(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files, and its ``ids`` (little-endian
    unsigned 32-bit integers) if asked for."""
    files = spark.read.schema(BLOCKS).parquet(target)
    # One narrow row per block: a block has some million tokens, so this stays small for one task.
    order = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("part", "block", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["ranked"], row["control"], row["data"], row["n_tokens"]).astype("<u4").tobytes()
                sizes = np.array(row["sizes"], np.int64)
                begin = np.cumsum(sizes) - sizes
                own = [ids[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(own), pa.int64()),
                        pa.array([row["block"]] * len(own), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begin),
                        pa.array(sizes),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        pa.array(own if with_ids else [None] * len(own), pa.binary()),
                    ],
                    names=["part", "block", "doc_id", "begin", "n_tokens", "ids_crc32", "ids"],
                )

    found = files.mapInArrow(
        run, "part long, block long, doc_id long, begin long, n_tokens long, ids_crc32 long, ids binary"
    ).join(begins, ["part", "block"])
    return found.select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
