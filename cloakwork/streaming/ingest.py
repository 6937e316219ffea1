"""Streams of texts: the scan and the merge are row by row, so they need no state; jobs expire by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.config import DEFAULT, EngineConfig
from cloakwork.operators.documents import ingest
from cloakwork.operators.reconcile import explode_findings, findings_array
from cloakwork.operators.scan import scan


def stream_hits(docs: DataFrame) -> DataFrame:
    """A stream docs(doc_id, text) → a stream of hits."""
    return scan(docs)


def stream_findings(docs: DataFrame) -> DataFrame:
    """A stream docs(doc_id, text, suggested) → a stream of findings; suggested may be null."""
    return explode_findings(findings_array(docs))


def first_of_jobs(jobs: DataFrame, created: str = "created_at", config: EngineConfig = DEFAULT) -> DataFrame:
    """A stream of jobs without repeats of a doc_id; one is forgotten when it is older than the time to live."""
    return jobs.withWatermark(created, f"{config.ttl_seconds} seconds").dropDuplicatesWithinWatermark(["doc_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there goes to Parquet under path; started again, it goes on where it was."""
    return stream.withColumn("written_at", F.current_timestamp()).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(files: DataFrame, accepted: str, rejected: str, checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """A stream of files (as of format binaryFile: path, length, content) → two Parquet tables, of those that are taken and
    those that aren't, with the reason. A micro-batch has a folder of its own in each, which a retry writes anew."""

    def both(batch: DataFrame, number: int) -> None:
        for table, path in zip(ingest(batch, config), (accepted, rejected)):
            table.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
