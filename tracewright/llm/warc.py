"""WARC archives: a record for each page, and reading that trusts only records that a chain reaches.

Writing. Payloads are keyed by their SHA-1. Of the pages with one payload the one with the least id is
written as a response, the others as revisits that name it and carry no payload. Spark's text writer
puts the records out, with the blank lines that end a WARC record as its line separator, so archives go
through its commit protocol into any file system that Spark reaches.

Reading. Archives are read in splits, cut at the magic line that begins a record. A payload may hold that
line too, so a piece is only a candidate:

1. tasks emit, for each candidate, its place in the split and the offset of its successor, as its header
   states it;
2. by archive, places become offsets and pointer jumping (doubling of successor pointers) from the
   file's start finds the candidates that a chain of records reaches; the others are payload, and each
   belongs to the record whose span holds it;
3. records in one piece are complete from step 1. For those that the magic cut, the pieces are read once
   more and put together.

Only offsets and header fields are shuffled for whole records. Archives hold a bounded number of records
(RECORDS of a file), which bounds the offsets of step 2.

Defined cases: a null payload is the empty one; pages with a null id are records of their own: they
revisit the least non-null id of their payload, and without one are responses; rows that share the least
id are all responses; a smaller payload than min_bytes is a response always; line breaks and other
control characters in a URL are percent-encoded, a null URL is left out; an empty table makes an empty
archive. Other columns of the table are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Most records of one archive file.
RECORDS = 20_000
FIELDS = "kind string, page_id long, refers_to long, digest string, bytes long, url string"
CANDIDATE = f"file string, split long, seq long, size long, header long, length long, whole boolean, {FIELDS}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StructType([T.StructField("bytes", T.LongType()), T.StructField("digest", T.StringType())]))
def payload_digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [(t or "").encode("utf-8", "replace") for t in batch]
        yield pd.DataFrame({"bytes": [len(b) for b in raw], "digest": [base32_sha1(b) for b in raw]})


def write_archives(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record for each row of pages (page_id, url, payload) into archives under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("d", payload_digest("payload")).select("page_id", "url", "payload", "d.*")
    first = rows.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    rows = rows.join(first.select("of", "first_id"), F.col("digest") == F.col("of"), "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.col("url")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    record = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.when(revisit, ident(F.col("first_id")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)


def header_of(piece: str) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of magic and header, stated bytes of the block, fields) of a candidate; None if it has none."""
    at = piece.find(END)
    if at < 0:
        return None
    head = piece[: at + len(END)]
    fields = {}
    for x in head.rstrip("\r\n").split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")):
        return None
    return len(MAGIC) + len(head.encode()), int(fields["content-length"]), fields


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def described(fields: dict[str, str], block: bytes | None) -> dict:
    """What a record says, with digest and size of the payload as read where it has one."""
    kind = fields.get("warc-type")
    length = fields.get("x-payload-length", "")
    if kind == "revisit" or block is None:
        digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(length) if length.isdigit() else None
    else:
        digest, size = base32_sha1(block), len(block)
    return {"kind": kind, "page_id": page_of(fields.get("warc-record-id")), "refers_to": page_of(fields.get("warc-refers-to")), "digest": digest, "bytes": size, "url": fields.get("warc-target-uri")}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, value): what stands between magic lines, numbered within each split of a file."""
    text = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = None, 0
        for p in parts:
            seq = []
            for place in zip(p["file"], p["split"], strict=True):
                n = n + 1 if place == own else 0
                own = place
                seq.append(n)
            yield p.assign(seq=seq)[["file", "split", "seq", "value"]]

    return text.mapInPandas(number, "file string, split long, seq long, value string")


def candidate_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    for p in parts:
        out = []
        for file, split, seq, value in zip(p["file"], p["split"], p["seq"], p["value"], strict=True):
            raw = value.encode("utf-8", "replace")
            row = {"file": file, "split": split, "seq": seq, "size": len(raw), "header": None, "length": None, "whole": False}
            if (found := header_of(value)) is not None:
                header, length, fields = found
                row["header"], row["length"] = header, length
                start = header - len(MAGIC)
                # The file's first piece stands before any magic and is empty.
                row["whole"] = len(raw) == start + length + len(END) and raw.endswith(END.encode())
                row |= described(fields, raw[start : start + length] if row["whole"] else None)
            out.append(row)
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("header", "length", "page_id", "refers_to", "bytes")} | {"whole": bool})


def reached(start: np.ndarray, successor: np.ndarray, end: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches: successor pointers are doubled until all jumps are done."""
    n = len(start)
    at = np.searchsorted(start, successor)
    # n stands for the end of the file and for a successor that is no candidate.
    jump = np.append(np.where((at < n) & (start[np.minimum(at, n - 1)] == successor) & (successor < end), at, n), n) if n else np.zeros(1, int)
    on = np.zeros(n + 1, bool)
    if n and start[0] == 0:
        on[0] = True
    for _ in range(max(1, int(n).bit_length() + 1)):
        on[jump[on]] = True  # the prefix of the chain known so far doubles with the pointers
        jump = jump[jump]
    return on[:n]


def chain(part: pd.DataFrame) -> pd.DataFrame:
    """Of one file: each candidate's owner (the reached record whose span holds it) and whether it is one."""
    part = part.sort_values(["split", "seq"], kind="stable").reset_index(drop=True)
    size = part["size"].to_numpy("int64")
    first = ~((part["split"].to_numpy() == 0) & (part["seq"].to_numpy() == 0))
    # Each piece but what stands before the first magic is preceded by one.
    span = size + len(MAGIC) * first
    offset = np.cumsum(span) - span
    real = first
    own = part[real].reset_index(drop=True)
    start = offset[real] - (offset[real][0] if real.any() else 0) + (size[0] if len(size) and not first[0] else 0)
    header, length = own["header"].fillna(-1).to_numpy("int64"), own["length"].fillna(0).to_numpy("int64")
    end = int(start[-1] + span[real][-1]) if len(start) else 0
    successor = np.where(header >= 0, start + header + length + len(END), -1)
    on = reached(start, successor, end) & (header >= 0) & (successor <= end)
    owner = np.maximum.accumulate(np.where(on, np.arange(len(on)), -1)) if len(on) else np.zeros(0, int)
    inside = (owner >= 0) & (start < successor[np.maximum(owner, 0)]) if len(on) else on
    own = own.assign(record=on, owner=np.where(inside, start[np.maximum(owner, 0)], -1) if len(on) else [], at=start, cut=False)
    # A record is cut if the magic within its span divides it into several pieces.
    several = np.bincount(np.maximum(owner, 0)[inside], minlength=len(on)) > 1 if len(on) else on
    own["cut"] = on & several
    own["part_of_cut"] = inside & several[np.maximum(owner, 0)] if len(on) else []
    return own.drop(columns=["size", "header", "length", "whole"])


CHAINED = f"file string, split long, seq long, {FIELDS}, record boolean, owner long, at long, cut boolean, part_of_cut boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """kind, page_id, refers_to, digest, bytes and url of every record that the chains reach."""
    candidates = pieces(spark, path).mapInPandas(candidate_rows, CANDIDATE)
    chained = durable(candidates.groupBy("file").applyInPandas(chain, CHAINED), "chained")
    names = [c.split()[0] for c in FIELDS.split(", ")]
    whole = chained.where("record and not cut").select(names)
    if chained.where("cut").limit(1).count() == 0:
        return whole

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        value = MAGIC.join(part["value"])
        header, length, fields = header_of(value)
        start = header - len(MAGIC)
        row = described(fields, value.encode()[start : start + length])
        return pd.DataFrame([row], columns=names).astype({c: "Int64" for c in ("page_id", "refers_to", "bytes")})

    parts = chained.where("part_of_cut").select("file", "split", "seq", "owner", "at")
    again = pieces(spark, path).join(parts, ["file", "split", "seq"])
    return whole.unionByName(again.groupBy("file", "owner").applyInPandas(join, FIELDS))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back: a row for each record read."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    r = read_archives(spark, path)
    return r.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url")
