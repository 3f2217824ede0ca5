"""The corpus pipeline: documents through quality, near-duplicate, secret, mixing and packing stages."""

from __future__ import annotations

import posixpath
import uuid

from recallgrid.llm._arrow import shared_dir, table
from recallgrid.llm.mixing import mixed
from recallgrid.llm.packing import pack
from recallgrid.llm.quality import keep_good
from recallgrid.llm.secrets import redact
from recallgrid.llm.simhash import drop_near_duplicates
from recallgrid.sources.sync import delete_snapshot


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; null and empty texts go with them. Rows that repeat stay or go
    together; without labels nothing but null and empty texts goes."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (the one of the least doc_id, null last). Null and empty texts stay,
    but for rows that repeat both doc_id and text."""
    return drop_near_duplicates(docs)


def secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark and n_chars follows; every document stays, null and empty texts as they are."""
    return redact(docs)


def mixing(spark, docs, sf_dir):
    """Each document as often as its source's share has it: once at least, twice at most, so that every source is used. A
    null source is a source of its own; null and empty texts cost nothing."""
    return mixed(docs).select(*docs.columns)


def packing(spark, docs, sf_dir):
    """The place of every piece of every document in bins of 2048 tokens; null and empty texts have none."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Trees, fingerprints and networks can't be said in SQL; the pipeline is tested against the operators on small tables.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written as Parquet to the shared folder and read again by the next; a folder goes when
    its successor is written. The last stage's result rests on its own checkpoint, not on the texts."""
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                delete_snapshot(spark, last)
            last = path
    delete_snapshot(spark, folder)
    return docs
