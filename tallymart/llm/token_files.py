"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt by ranges of their id, sorted, and each range becomes one shard: `*.ids` holds the ids of its
documents back to back (unsigned, little-endian, 2 bytes where the vocabulary allows, else 4), `*.offsets` one more
64-bit offset than there are documents, `*.docs` their 64-bit ids and `*.null` a byte for each null id. A manifest names
the shards with their counts; running sums over it give each shard's base, that is the ids before it. Every attempt of
a task writes files of its own and only finished attempts reach the manifest, so lost executors leave no gap and no
double.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.common import scratch_path, stage
from tallymart.llm.shared_files import file_system, mapped
from tallymart.llm.units import token_store

MANIFEST = "part int, prefix string, dtype string, n_docs long, n_tokens long"


def write_tokens(
    docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shards: int | None = None,
    root: str | None = None,
) -> DataFrame:
    """Encode, write the shards below `root` and return the manifest: one row per shard with its `base`.

    `shards` defaults to the session's shuffle partitions. Null texts count as empty; every document gets `end_id`.
    Null ids come first. Rows with one id are ordered by the hash of their text; rows that repeat all of it are equal.
    Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    root = root or scratch_path(spark, "token-files")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_of = token_store(path)
        kind = "<u2" if max(store_of.vocabulary - 1, end_id) < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        prefix = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}"
        store, local = file_system(prefix)
        store.create_dir(local.rpartition("/")[0], recursive=True)
        sizes, ids = [], []
        with store.open_output_stream(f"{local}.ids") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids.append(batch.column(0))
                for tokens, bounds in store_of.encode(batch.column(1)):
                    f.write(np.insert(tokens.astype(kind), bounds[1:], end_id).tobytes())
                    sizes.append(np.diff(bounds) + 1)
        if not sizes:
            store.delete_file(f"{local}.ids")
            return
        column = pa.chunked_array(ids)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        for name, data in (("offsets", offsets), ("docs", column.fill_null(0).to_numpy().astype("<i8")),
                           ("null", column.is_null().to_numpy().astype("u1"))):
            with store.open_output_stream(f"{local}.{name}") as f:
                f.write(data.tobytes())
        row = [[part], [prefix], [kind], [len(offsets) - 1], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["part", "prefix", "dtype", "n_docs", "n_tokens"],
        )

    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("long").alias("_id"), body.alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    manifest = stage(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    # one row per shard, in the order of the ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return stage(based, "token-bases")


def read_tokens(manifest: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, `start` (ids before it), `n_tokens` and `ids_crc32`.

    The checksum is taken over the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids, offsets = mapped(f"{shard['prefix']}.ids", shard["dtype"]), mapped(f"{shard['prefix']}.offsets", "<u8")
                docs, null = mapped(f"{shard['prefix']}.docs", "<i8"), mapped(f"{shard['prefix']}.null", "u1")
                for at in range(0, len(docs), 10_000):
                    bounds = offsets[at:at + 10_001].astype("i8")
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[at:at + 10_000], mask=null[at:at + 10_000].astype(bool)),
                        pa.array(bounds[:-1] + shard["base"]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()),
                    ], [doc_id, "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartitionByRange(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(read, f"`{doc_id}` long, start long, n_tokens long, ids_crc32 long")
