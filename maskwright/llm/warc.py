"""WARC: write archives as monolithic gzip, normalise them to one member a record with an offset index, read them back.

write_archives() deals pages by id to files, each of them one gzip stream over all its records, as some crawlers
leave them. normalise() inflates each such file once, as a stream, finds the records by their headers, writes each
as a gzip member of its own and writes the index beside it: file, offset, length, record id. read_records() cuts the
files into ranges of RANGE bytes by their indexes, seeks to each member of a range, inflates it alone and checks its
digest, so a large file is read by many tasks. Files lie in the shared folder and are reached through
its file system, under names that depend on the part alone; each is written beside its place and then renamed, so a
task that runs again on another executor replaces its own file.

Of the records with equal payloads of at least LEAST bytes the one with the smallest page_id is a response, and the
others revisit it. A null html is an empty payload. Pages that share both smallest id and payload are responses each;
a null id comes after all others, and pages of a payload with null ids only are responses. A record is identified by
file and place, so repeated ids keep a row each. Empty tables give empty results; columns other than page_id, url and
html are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import scratch_dir, table
from maskwright.shipping import ship

LEAST = 100
LEVEL = 4
BLOCK = 1 << 18
RANGE = 1 << 22
MISSING = "-"
INDEX = "file string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def _gzip() -> zlib._Compress:
    return zlib.compressobj(LEVEL, zlib.DEFLATED, 31)


def _put(folder: str, name: str):
    """A file system, a temporary path and the final path."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, f"{path}/.{name}.{TaskContext.get().taskAttemptId()}", f"{path}/{name}"


def record(page_id: str | None, url: str | None, html: str | None, digest: str, size: int, refers_to: str | None, revisit: bool) -> bytes:
    body = b"" if revisit else (html or "").encode("utf-8", "surrogatepass")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{MISSING if page_id is None else page_id}>"), ("WARC-Target-URI", (url or MISSING).replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, data[end + 4 : end + 4 + int(fields["Content-Length"])]


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, refers_to, revisit. Payload hashes are summed up before they move; the html moves once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    firsts = rows.filter(F.col("size") >= LEAST).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull())
    out = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", "size", F.col("first").alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One monolithic gzip stream for each partition; returns file and number of records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        system, tmp, path = _put(folder, name)
        n, z = 0, _gzip()
        with system.open_output_stream(tmp) as out:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    out.write(z.compress(record(r.page_id, r.url, r.html, r.digest, r.size, r.refers_to, r.revisit)))
                    n += 1
            out.write(z.flush())
        if not n:
            system.delete_file(tmp)
            return
        system.move(tmp, path)
        yield pd.DataFrame({"file": [name], "records": [n]})

    # ids go as text: beside nulls, pandas would hold longs as floats
    return planned(pages).select(F.col("page_id").cast("string"), "url", "html", "digest", "size", F.col("refers_to").cast("string"), "revisit").mapInPandas(write, "file string, records long")


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Records of an inflated stream, whose blocks may end anywhere; at most one record and one block are held."""
    held = bytearray()
    need = None
    for block in stream:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(held[:end]).split(b"\r\n")
                need = end + 8 + next(int(x[16:]) for x in head if x.startswith(b"Content-Length: "))
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _inflated(source) -> Iterator[bytes]:
    z = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            if out := z.decompress(block, 1 << 22):
                yield out
            block = z.unconsumed_tail
            if z.eof:
                block, z = z.unused_data, zlib.decompressobj(31)


def normalise(files: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite each file, a record a member, with a sidecar index beside it; returns file and number of records."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                system, path = fs.FileSystem.from_uri(folder)
                _, tmp, final = _put(target, name)
                n, at = 0, 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as source, system.open_output_stream(tmp) as out, system.open_output_stream(f"{tmp}.idx") as side:
                    for data in split_records(_inflated(source)):
                        z = _gzip()
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        head = data[: data.index(b"\r\n\r\n")].decode("utf-8", "surrogatepass").split("\r\n")
                        fields = dict(x.split(": ", 1) for x in head[1:])
                        side.write(f"{at}\t{len(member)}\t{fields['WARC-Record-ID']}\t{fields['WARC-Type']}\n".encode())
                        at += len(member)
                        n += 1
                system.move(tmp, final)
                system.move(f"{tmp}.idx", f"{final}.idx")
                yield pd.DataFrame({"file": [name], "records": [n]})

    return files.mapInPandas(rewrite, "file string, records long")


def read_index(files: DataFrame, target: str) -> DataFrame:
    """The sidecar indexes of the files: file, offset, length, record_id, record_type."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                system, path = fs.FileSystem.from_uri(target)
                with system.open_input_stream(f"{path}/{name}.idx") as f:
                    for part in pd.read_csv(f, sep="\t", names=["offset", "length", "record_id", "record_type"], chunksize=20_000):
                        yield part.assign(file=name)[["file", "offset", "length", "record_id", "record_type"]]

    return files.mapInPandas(read, INDEX)


def read_records(index: DataFrame, target: str) -> DataFrame:
    """Every record of the index, read by ranges of its file; a response whose digest or length is wrong raises an error.

    A range lists its members' lengths from its first offset on: members lie side by side, and a record takes more than 200 bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda s: None if s is None or (x := s[len("<urn:page:") : -1]) == MISSING else int(x)
        system, path = fs.FileSystem.from_uri(target)
        for pdf in batches:
            for name, members in zip(pdf["file"], pdf["members"]):
                rows: list[dict] = []
                with system.open_input_file(f"{path}/{name}") as f:
                    for m in members:
                        f.seek(m["offset"])
                        fields, body = parsed(zlib.decompress(f.read(m["length"]), 31))
                        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"{name}: the record at {m['offset']} doesn't match its digest")
                        url = fields["WARC-Target-URI"]
                        rows.append({"page_id": number(fields["WARC-Record-ID"]), "url": None if url == MISSING else url, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "file": name, "offset": m["offset"]})
                yield _frame(rows)

    ranges = index.groupBy("file", F.floor(F.col("offset") / RANGE).alias("range")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))
    return ranges.repartition(_tasks(index.sparkSession), "file", "range").mapInPandas(read, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def _tasks(spark: SparkSession) -> int:
    """Partitions for work that small rows stand for: as many as a shuffle has, never joined together for the rows' few bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; the frame of all records read."""
    spark = pages.sparkSession
    ship(spark)
    root = scratch_dir(spark)
    files = "file string, records long"
    write_archives(pages, f"{root}/monolithic").write.parquet(f"{root}/files")
    names = spark.read.schema(files).parquet(f"{root}/files").select("file")
    normalise(names.repartition(_tasks(spark), "file"), f"{root}/monolithic", f"{root}/members").write.parquet(f"{root}/done")
    done = spark.read.schema(files).parquet(f"{root}/done").select("file")
    return read_records(read_index(done.repartition(_tasks(spark), "file"), f"{root}/members"), f"{root}/members")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = rf"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p
), r AS (SELECT *, payload_bytes >= {LEAST} AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS revisit FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN least END AS refers_to FROM r
"""
