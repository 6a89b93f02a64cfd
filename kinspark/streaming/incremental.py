"""Incremental embedding of sequence files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinspark.operators.embed import BATCH_SIZE, Encoder, embed
from kinspark.session import path_is_missing, through_table
from kinspark.sources.fasta import parse_records


def stream_fasta(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of ``name, sequence, file_name`` records from FASTA files dropped into a folder."""
    reader = spark.readStream.schema("value string").option("lineSep", "\n>")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.format("text").load(path)
    return parse_records(raw.select("value", F.col("_metadata.file_name").alias("file_name")))


def numbered_rows(table: DataFrame, first: int) -> DataFrame:
    """Add ``centroid_idx``, counting the rows of a written table from ``first`` on.

    Splits of a written table are the same at every reading: one narrow pass counts their
    rows, a second adds each split's offset to the position inside it.
    """
    rows = table.withColumn("_id", F.monotonically_increasing_id())
    split = F.shiftright("_id", 33).alias("_split")
    counts = rows.groupBy(split).agg(F.count("*").alias("n")).orderBy("_split").collect()  # one row per split
    offsets, at = {}, first
    for r in counts:
        offsets[r["_split"]] = at
        at += r["n"]
    base = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.lit(None).cast("map<bigint,bigint>")
    key = base[F.shiftright("_id", 33)] + F.col("_id").bitwiseAND((1 << 33) - 1)
    return rows.select(key.cast("long").alias("centroid_idx"), *table.columns)


def _next_key(spark: SparkSession, store: str, batch: int) -> int:
    """The key after the last of all batches before ``batch``."""
    try:
        stored = spark.read.parquet(store).where(F.col("batch") < batch)
    except AnalysisException as missing:
        if not path_is_missing(missing):
            raise
        return 0
    last = stored.agg(F.max("centroid_idx")).first()[0]
    return 0 if last is None else last + 1


def embed_stream(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    load: Callable[[], Encoder],
    files_per_batch: int | None = None,
    batch_size: int = BATCH_SIZE,
    once: bool = True,
) -> StreamingQuery:
    """Embed every new file of ``source`` once and append it to ``store``.

    The store has ``centroid_idx, name, sequence, embedding, file_name`` and one folder per
    batch; it is both the ``sequences`` and the ``embeddings`` of a ``Database``. Keys go on
    from those of earlier batches. With ``once`` the query takes what is there and stops; run
    it again, with the same checkpoint, for what has arrived since. A batch that is run again
    after a failure replaces its own folder, so none is skipped or stored twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        vectors = embed(batch, load, batch_size).select("name", "sequence", "embedding", "file_name")
        numbered_rows(through_table(vectors, "batch"), _next_key(spark, store, number)).write.mode("overwrite").parquet(
            f"{store.rstrip('/')}/batch={number}"
        )

    stream = stream_fasta(spark, source, files_per_batch)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
