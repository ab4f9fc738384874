"""WARC archives and their Merkle fixity audit.

:func:`write_archives` packs pages into WARC records and those into archives of bounded size; a store is a
table of records with their archive, offset and length. An audit compares two stores that should be
replicas: every record is hashed, records are hashed together by ordered ranges of offsets, ranges by
larger ranges up to a root for each archive. Roots are compared first, and only ranges below a difference
are read on, down to the records that are altered, missing or extra.

Null page ids, urls and htmls are written as empty. Repeated rows are records of their own. An empty table
gives stores without records, and an audit of those no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdeck.llm.common import stored

ARCHIVE_BYTES = 64_000_000
#: Bytes of the smallest ranges, ranges that make the next larger one, and its levels: the largest covers
#: an archive whose last record is not too long; longer archives have several ranges at the top.
RANGE, FANOUT, LEVELS = 1 << 16, 16, 4

STORE = "archive string, offset long, length long, page_id long, url string, record binary"


def record(page: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\n"
        f"WARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def archives(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The store of ``pages``: each task fills archives one after another, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names, offsets, records = [], [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = record(*row)
                if offset and offset + len(own) > ARCHIVE_BYTES:
                    number, offset = number + 1, 0
                names.append(f"{part:06d}-{number:06d}")
                offsets.append(offset)
                records.append(own)
                offset += len(own)
            columns = [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(list(map(len, records)), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column(0), batch.column(1), pa.array(records, pa.binary())],
                names=["archive", "offset", "length", "page_id", "url", "record"],
            )

    given = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return given.mapInArrow(run, STORE)


def write_archives(pages: DataFrame, target: str, **columns: str) -> None:
    archives(pages, **columns).write.option("compression", "zstd").parquet(target)


def tree(store: DataFrame, name: str) -> list[DataFrame]:
    """Levels from the records (``archive, at, hash`` and what names a record) to the ranges at the top."""
    leaves = store.select(
        "archive", F.col("offset").alias("at"), F.sha2("record", 256).alias("hash"), "length", "page_id", "url",
        F.floor(F.col("offset") / RANGE).alias("above"),
    )
    levels = [stored(leaves, f"{name}-records")]
    for _ in range(LEVELS):
        # A range holds few children: their count is bounded by its bytes, or by the fan-out.
        children = F.sort_array(F.collect_list(F.struct("at", "hash")))
        together = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"])), ",")
        ranges = levels[-1].groupBy("archive", F.col("above").alias("at")).agg(F.sha2(together, 256).alias("hash"))
        levels.append(stored(ranges.withColumn("above", F.floor(F.col("at") / FANOUT)), f"{name}-ranges"))
    return levels


def _differing(a: DataFrame, b: DataFrame, keep: list[str]) -> DataFrame:
    left = a.select("archive", "at", *[F.struct("hash", "above", *keep).alias("a")])
    right = b.select("archive", "at", *[F.struct("hash", "above", *keep).alias("b")])
    return left.join(right, ["archive", "at"], "full").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """``archive, offset, page_id, url, n_bytes, status`` of each record that differs between two trees;
    ``status`` is what the second has: ``altered``, ``missing`` or ``extra``."""
    wrong = None
    for level in range(LEVELS, -1, -1):
        sides = [first[level], second[level]]
        if wrong is not None:
            above = wrong.select("archive", F.col("at").alias("above"))
            sides = [s.join(above, ["archive", "above"], "left_semi") for s in sides]
        wrong = _differing(*sides, ["length", "page_id", "url"] if level == 0 else [])
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return wrong.select("archive", F.col("at").alias("offset"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "url")],
                        F.coalesce("a.length", "b.length").alias("n_bytes"), status.alias("status"))


def damaged(store: DataFrame, altered: Column, lost: Column) -> DataFrame:
    """A replica with another byte in the middle of some records, and without others."""
    middle = F.floor(F.col("length") / 2).cast("int")
    byte, rest = F.substr("record", middle, F.lit(1)), F.substr("record", middle + 1)
    other = F.when(byte == F.lit(b"#"), F.lit(b"$")).otherwise(F.lit(b"#"))
    changed = F.concat(F.substr("record", F.lit(1), middle - 1), other, rest)
    return store.filter(~F.coalesce(lost, F.lit(False))).withColumn("record", F.when(altered, changed).otherwise(F.col("record")))
