"""Token ids as binary blocks: frequency ranks in 1 to 4 bytes, control bytes apart.

File format.  A store is a Parquet folder of blocks, one row each:

``part, seq``   place in ascending document order (sort by both)
``n_docs, n_ids``   how much the block holds
``docs``        binary: the documents' ids, int64 little-endian
``lengths``     binary: ids per document, uint32 little-endian
``control``     binary: two bits per id, four ids a byte, low bits first:
                bytes of the id's rank minus one
``data``        binary: the ranks, little-endian, without leading zero bytes

beside ``ranks``, a Parquet folder of (rank, id): the most frequent id has rank
0, ties by id.  256 ranks thus take one byte each.  Decoding looks the byte mask of
each control byte up in a table and scatters the data bytes through it.

Documents are dealt by ranges of doc_id, so no task holds more than a range, and
a hot source or a group of copies is just more documents.  A document without
doc_id comes first, under the id that ``NO_ID`` names; rows that share a doc_id are
ordered by text, so equal rows are interchangeable.  A null text is empty; an
empty table makes an empty store.  Other columns are not read.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemetra.llm import arrays
from telemetra.llm.common import NO_ID, local_file, own_columns, ship_file, stage
from telemetra.llm.pretoken import WordCodes
from telemetra.session import scratch_dir, ship_package

#: Text bytes after which a block is closed.
BLOCK_BYTES = 2 << 20

_BLOCK = "part int, seq int, n_docs int, n_ids long, docs binary, lengths binary"
_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
#: For each control byte, which of its 4 x 4 rank bytes are stored.
_STORED = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    r = ranks.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    stored = _STORED[control].reshape(-1, 4)[: len(r)]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[stored].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again."""
    stored = _STORED[np.frombuffer(control, np.uint8)].reshape(-1)[: 4 * n]
    out = np.zeros(4 * n, np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


@functools.lru_cache(maxsize=2)
def _codes(name: str) -> WordCodes:
    tokenizer = Tokenizer.from_file(local_file(name))

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = tokenizer.encode(
            [w.decode() for w in words], is_pretokenized=True, add_special_tokens=False
        )
        owner = np.array(got.word_ids, np.int64)
        return np.array(got.ids, np.uint32), np.searchsorted(owner, np.arange(len(words) + 1))

    special = tuple((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items())
    return WordCodes(encode, special)


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of plain ids (``ids``: uint32 little-endian) in ascending document order."""
    spark = docs.sparkSession
    ship_package(spark)
    name = ship_file(spark, tokenizer)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        own_columns(docs)
        .withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        .repartitionByRange(deal, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = _codes(name), TaskContext.get().partitionId()
        for seq, piece in enumerate(arrays.slices(batches, "text", BLOCK_BYTES)):
            ids, at = codes.texts(*arrays.flat(piece.column("text")))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            lengths = (np.diff(at) + 1).astype("<u4")
            row = {
                "part": [part], "seq": [seq], "n_docs": [piece.num_rows], "n_ids": [len(ids)],
                "docs": [piece.column("doc_id").to_numpy().astype("<i8").tobytes()],
                "lengths": [lengths.tobytes()], "ids": [ids.tobytes()],
            }
            yield pa.RecordBatch.from_pydict(row, _PLAIN)

    return ordered.mapInArrow(run, f"{_BLOCK}, ids binary")


_HEAD = [
    ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
    ("docs", pa.binary()), ("lengths", pa.binary()),
]
_PLAIN = pa.schema([*_HEAD, ("ids", pa.binary())])
_PACKED = pa.schema([*_HEAD, ("control", pa.binary()), ("data", pa.binary())])


def rank_ids(blocks: DataFrame) -> DataFrame:
    """(rank, id) of every id that occurs, over all blocks; at most one row per vocabulary id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                got = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    counts = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")
    )
    order = Window.orderBy(F.desc("n"), "id")  # one row per vocabulary id, so one task is enough
    return counts.select((F.row_number().over(order) - 1).cast("long").alias("rank"), "id")


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> None:
    """Encode the documents, ``end_id`` after each, and write the store into ``folder``.

    The ranks need the counts of the whole corpus, so plain ids are staged once,
    already in document order; coding them is then a pass without a shuffle.
    """
    spark = docs.sparkSession
    blocks = stage(encode_blocks(docs, tokenizer, end_id), "ids", compression="zstd")
    rank_ids(blocks).coalesce(1).write.parquet(os.path.join(folder, "ranks"))
    ranks = _ranks(spark, folder)
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 0, np.uint32)
    rank_of[ranks] = np.arange(len(ranks))
    held = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), "<u4")
                control, data = pack(held.value[ids])
                head = [row.column(name) for name, _ in _HEAD]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array([control]), pa.array([data])], schema=_PACKED
                )

    coded = blocks.mapInArrow(run, f"{_BLOCK}, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(os.path.join(folder, "blocks"))


def _ranks(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of each rank."""
    rows = spark.read.parquet(os.path.join(folder, "ranks")).toPandas().sort_values("rank")
    return rows["id"].to_numpy(np.int64)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (uint32 little-endian)."""
    id_of = spark.sparkContext.broadcast(_ranks(spark, folder).astype("<u4"))
    blocks = spark.read.parquet(os.path.join(folder, "blocks"))
    # one row per range in the window, then one per block within a range
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part"), F.coalesce(before, F.lit(0)).alias("part_base"))
    earlier = F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = blocks.select("part", "seq", F.coalesce(earlier, F.lit(0)).alias("in_part"))
    bases = bases.join(parts, "part").select(
        "part", "seq", (F.col("part_base") + F.col("in_part")).alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ranks = unpack(row["control"], row["data"], row["n_ids"])
                ids = id_of.value[ranks]
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                at = np.r_[0, np.cumsum(lengths)]
                doc = np.frombuffer(row["docs"], "<i8")
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc, mask=doc == NO_ID),
                        "start": at[:-1] + row["base"],
                        "n_tokens": lengths,
                        "ids": arrays.binary_array(ids.view(np.uint8), at * 4),
                    }
                )

    return (
        blocks.join(bases, ["part", "seq"])
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def store_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return scratch_dir(spark, "tokens")
