"""Packing documents into fixed-length token sequences under a controlled mixture.

Every source is a queue. Windows are filled by deficit round-robin: in each round a source may send its target share of the
window, and what it does not use, because its next document does not fit, it carries on as deficit. A queue that is served in
every round has sent a document by the first round whose accumulated share covers the queue up to the document's end, so the
round follows from running sums, and deficits carry over windows and partitions alike. The rounds one after the other are cut
into sequences of ``length`` tokens; only the last one is shorter.

Steps: tokenize once into a table bucketed by input partition; sum the small (partition, source) totals; order the documents
by (round, source, place in the queue) by range; bring each document's place back to its tokens, which are not shuffled.

Defined cases: a null or empty text is one closing token; a null source is a queue of its own; repeated rows are packed as
often as they come; an empty table gives no pieces. Ties cannot occur, as rows are told apart by their place in the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from proseaudit.llm import prefix, store, text, tokens

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenized(documents: DataFrame, source: str, vocabulary: str, end: int) -> DataFrame:
    """A table of token ids bucketed by input partition: place in it, queue, tokens before it in the queue there, ids (two bytes each, or four where the vocabulary needs them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, sent = tokens.Encoder(vocabulary), TaskContext.get().partitionId(), 0, {}
        for batch, buf, offsets in text.slices(batches, "text", 1 << 21):
            ids, first = encoder.slice(buf, offsets)
            ids, first = np.insert(ids, first[1:], end).astype(np.uint16 if max(encoder.encoding.max_token_value, end) < 1 << 16 else np.uint32), first + np.arange(len(first))
            n, queues, before = np.diff(first), batch.column(1).to_pylist(), []
            for queue, size in zip(queues, n.tolist()):
                before.append(sent.get(queue, 0))
                sent[queue] = before[-1] + size
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ids.itemsize * first).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n), dtype=np.int32)), batch.column(0), batch.column(1), pa.array(before, pa.int64()), pa.array(n), data],
                ["part", "row", "doc_id", "queue", "before", "n", "ids"],
            )
            row += len(n)

    spark = documents.sparkSession
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("queue"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "part int, row int, doc_id bigint, queue string, before bigint, n bigint, ids binary")
    name = f"packing_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "part").option("path", store.new_path(spark, "tokens")).saveAsTable(name)
    return spark.table(name)


def places(rows: DataFrame, window: int, targets: dict[str, float] | None) -> DataFrame:
    """Where each document starts in the packed stream: part, row, begin."""
    slim = rows.select("part", "row", "queue", "before", "n")
    cells = slim.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queues = cells.groupBy("queue").agg(F.sum("n").alias("total"))
    total = queues.agg(F.sum("total")).first()[0] or 1
    share = F.col("total") / F.lit(total)
    if targets:
        given = F.element_at(F.create_map(*[F.lit(x) for pair in targets.items() for x in (pair[0], float(pair[1]))]), F.col("queue"))
        share = F.coalesce(F.greatest(given, F.lit(1e-9)), share)
        share = share / F.lit(queues.agg(F.sum(share)).first()[0] or 1.0)
    cells = cells.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).join(queues.select("queue", (share * window).alias("quantum")), "queue")
    queued = slim.join(cells, ["queue", "part"]).select(
        "part", "row", "queue", "n", (F.col("base") + F.col("before")).alias("at"),
        F.ceil((F.col("base") + F.col("before") + F.col("n")) / F.col("quantum")).alias("round"))
    return prefix.running(queued, ["round", "queue", "at"], "n", "begin").select("part", "row", "begin")


def pack(
    documents: DataFrame, length: int = 2048, window: int = 64 * 2048, targets: dict[str, float] | None = None,
    source: str = "source", vocabulary: str | None = None, end: int = 1,
) -> DataFrame:
    """Pieces of documents in sequences: token ids (little-endian unsigned 32-bit), start in the document, sequence and offset.

    ``targets`` are token shares by source; a source that is not named, or all if it is None, gets its share of the corpus.
    """
    rows = tokenized(documents, source, vocabulary or tokens.vocabulary(), end)
    begins = places(rows, window, targets).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("row", "begin"))).alias("begins"))
    placed = rows.join(begins.hint("shuffle_hash"), "part").select("doc_id", "ids", F.element_at("begins", F.col("row") + 1)["begin"].alias("begin"), "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, begins = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            held = 0
            for doc, data, begin, n in zip(docs, batch.column(1), begins, batch.column(3).to_pylist()):
                data = data.as_buffer()
                ids = np.frombuffer(data, np.uint16 if data.size == 2 * n else np.uint32).astype("<u4")
                at = 0
                while at < len(ids):
                    offset = (begin + at) % length
                    to = min(len(ids), at + length - offset)
                    out.append((doc, at, to - at, ids[at:to].tobytes(), len(ids), (begin + at) // length, offset))
                    held += to - at
                    at = to
                if held > 1 << 20:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return placed.mapInArrow(cut, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
