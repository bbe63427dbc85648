"""Token files: ids of all documents in ascending id order, Simple-8b packed.

``write_token_files`` cuts the documents into key ranges, sorts each range and
writes one Parquet file for it, in the folder given. A row is a block: some
whole documents (one long document may fill a block of its own) with their id
counts, the offset of each document's first word, the words and the escaped
values. ``ids_before`` counts the file's ids before the block; adding the
totals of the files before gives places in the whole corpus without reading
any ids.

Null texts count as empty, a null doc_id sorts first, repeated rows stay.
Columns other than doc_id and text are not stored. Task order is the only
state: a task that runs again writes the same file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import simple8b, word_bpe
from barloom.llm.common import prefix_totals, row_slices, shuffle_partitions

SCHEMA = "file_no int, block int, ids_before long, doc_ids array<long>, n_ids array<int>, word_offsets array<int>, words binary, escaped binary"


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str, block_chars: int = 400_000) -> None:
    """Encode every whole text, append ``end_id``, write the packed files."""
    ranges = shuffle_partitions(documents.sparkSession)
    ordered = documents.select("doc_id", "text").repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = word_bpe.coder(tokenizer_path)
        file_no, before, block = TaskContext.get().partitionId(), 0, 0
        for part in row_slices(batches, "text", block_chars):
            runs = [ids + end for ids in bpe.encode_batch(part.column("text").to_pylist())]
            values = np.frombuffer(b"".join(runs), "<u4")
            sizes = np.array([len(r) // 4 for r in runs], np.int64)
            words, offsets, escaped = simple8b.pack(values, np.cumsum(sizes) - sizes)
            row = [file_no, block, before, part.column("doc_id").to_pylist(), sizes.tolist(), offsets.tolist(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = ["file_no", "block", "ids_before", "doc_ids", "n_ids", "word_offsets", "words", "escaped"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            before, block = before + int(sizes.sum()), block + 1

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the files."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    totals = blocks.select("file_no", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    bases = prefix_totals(totals, "file_no", "n", "file_base")
    schema = "file_no int, doc_id long, in_file long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_ids"], np.int64)
                values = simple8b.unpack(np.frombuffer(row["words"], "<u8"), sizes, np.array(row["word_offsets"], np.int64), np.frombuffer(row["escaped"], "<u8")).astype("<u4")
                ends = np.cumsum(sizes)
                data = values.tobytes()
                crc = [word_bpe.crc32_of(data[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                columns = [pa.array([row["file_no"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["ids_before"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["file_no", "doc_id", "in_file", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    documents = blocks.drop("block").mapInArrow(run, schema)
    # one row for each file: as many as write_token_files had partitions
    joined = documents.join(F.broadcast(bases), "file_no")
    return joined.select("doc_id", (F.col("in_file") + F.col("file_base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
