"""Mail boxes and archives: attachments and members as rows of bytes.

Mail servers need a network and are an interface only: a ``fetch`` function
yields (message_id, raw message) and the rest is the same.
"""

from __future__ import annotations

import email
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENTS = "source string, message_id string, subject string, name string, content binary"
ALLOWED = (".pdf", ".xlsx", ".zip", ".png", ".jpg", ".jpeg")


def attachments(raw: bytes, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[str, str, str, bytes]]:
    """(message id, subject, name, bytes) of every allowed part of a MIME tree."""
    message = email.message_from_bytes(raw)
    out = []
    for part in message.walk():
        name = part.get_filename()
        if name and name.lower().endswith(allowed) and (body := part.get_payload(decode=True)):
            out.append((message.get("Message-ID", ""), str(message.get("Subject", "")), name, body))
    return out


def split_mbox(content: bytes) -> list[bytes]:
    """Messages of an mbox file: a line ``From `` after a blank line starts one."""
    out: list[list[bytes]] = []
    blank = True
    for line in content.splitlines(keepends=True):
        if blank and line.startswith(b"From "):
            out.append([])
        elif out:
            out[-1].append(line[1:] if line.startswith(b">From ") else line)
        blank = not line.strip()
    return [b"".join(m) for m in out]


def read_mbox(spark: SparkSession, root: str, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mbox").load(root).select("path", "content")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *a) for m in split_mbox(content) for a in attachments(m, allowed)]
                yield pd.DataFrame(rows, columns=["source", "message_id", "subject", "name", "content"])

    return files.mapInPandas(parts, ATTACHMENTS)


def read_archives(spark: SparkSession, root: str, passwords: tuple[str, ...] = ()) -> DataFrame:
    """source, name, content, n_members: members of ZIP files; one row with -1 for a file that no password opens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = None
                for word in (None, *passwords):
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            names = [n for n in z.namelist() if not n.endswith("/")]
                            rows = [(path, n, z.read(n, pwd=word.encode() if word else None), len(names)) for n in names]
                        break
                    except (RuntimeError, zipfile.BadZipFile):
                        continue
                yield pd.DataFrame(rows if rows is not None else [(path, None, None, -1)], columns=["source", "name", "content", "n_members"])

    return files.mapInPandas(members, "source string, name string, content binary, n_members int")


def mail_query(start: str, end: str, label: str | None = None) -> str:
    """Search text for attachments between two days, both included."""
    after_end = (pd.Timestamp(end) + pd.Timedelta(days=1)).strftime("%Y/%m/%d")
    query = f"has:attachment after:{start.replace('-', '/')} before:{after_end}"
    return f"{query} label:{label}" if label else query


def new_messages(listed: DataFrame, processed: DataFrame) -> DataFrame:
    """Listed messages that are not processed yet."""
    return listed.join(processed.select("message_id").distinct(), "message_id", "left_anti")


def fetched(listed: DataFrame, fetch: Callable[[str], bytes], allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Attachments of listed messages by a function that the caller supplies."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [("mail", i, *a[1:]) for i in batch["message_id"] for a in attachments(fetch(i), allowed)]
            yield pd.DataFrame(rows, columns=["source", "message_id", "subject", "name", "content"])

    return listed.select("message_id").mapInPandas(parts, ATTACHMENTS)


def processed_ids(attachments_: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed ids with those of messages that gave an attachment."""
    return processed.select("message_id").union(attachments_.select("message_id")).filter(F.col("message_id") != "").distinct()
