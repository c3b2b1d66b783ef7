"""A deterministic sharded WARC writer, and its reader.

Records are sorted by id range. The bounds of ranges come from histograms of payload bytes over prefixes of the ids' bits: a bin with more
bytes than a shard is split by DIGIT further bits, until none is or it holds one id. So bounds depend on the data alone, dense ids beside far
ones make no hot shard, and a shard is one task of its own. There are at most about MOST_SHARDS shards; larger tables have larger ones. A shard's records follow in order of id into files that roll when their compressed size reaches
`roll_bytes`; a record is one gzip member. Headers and digests are made anew from the payload, with a fixed date. A file is
written under a temporary name of its own; the manifest of finished files is written by Spark, so that only attempts that
ended well count; then the files that it names are renamed, which may be repeated; temporary files that it doesn't name go.

Of records with equal payloads of at least `revisit_bytes` bytes, the one with the smallest id is a response and the others
are revisits that refer to it. The html is shuffled once: the few marks of revisits travel with the pages to the same range
and sort before their page. A hot payload costs one row a mapper in a combined minimum.

Nulls: a null html is an empty payload; a null url has no target URI; a record with a null id is a response, with no id in its
header, and lies in one of the first shards by a hash of url and html. Repeated rows are written each, as responses if theirs is the smallest id of the payload. An empty table gives no file
and no row. Only the named columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch, ship

ship(__name__)

DIGIT, MOST_SHARDS, SHARD_BYTES, ROLL_BYTES = 12, 1 << 16, 8 << 20, 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, temporary string, shard int, records long, bytes long, first_id long, last_id long"


def _digest(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(out_dir: str, roll_bytes: int):
    def write(batches):
        import gzip
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir)
        store.create_dir(f"{root}/_temporary", recursive=True)
        done, stream, now = [], None, {}

        def close():
            if stream is not None:
                stream.close()
                done.append(dict(now))

        shard, roll, mark = None, 0, (None, None)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "refers_to"))):
                if row[4] is not None:  # the mark of a revisit, before its page
                    mark = row[1], row[4]
                    continue
                if row[0] != shard or now["bytes"] >= roll_bytes:
                    close()
                    roll = roll + 1 if row[0] == shard else 0
                    shard = row[0]
                    now = {"file": f"shard-{shard:06d}-{roll:05d}.warc.gz", "temporary": uuid.uuid4().hex, "shard": shard, "records": 0, "bytes": 0, "first_id": row[1], "last_id": row[1]}
                    stream = store.open_output_stream(f"{root}/_temporary/{now['temporary']}", compression=None)
                refers_to = mark[1] if row[1] is not None and mark[0] == row[1] else None
                data = gzip.compress(record(row[1], row[2], (row[3] or "").encode(), refers_to), 6, mtime=0)
                stream.write(data)
                now["records"] += 1
                now["bytes"] += len(data)
                now["last_id"] = row[1]
        close()
        names = ["file", "temporary", "shard", "records", "bytes", "first_id", "last_id"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in done], k) for c, k in zip(names, kinds)], names)

    return write


def _commit(out_dir: str):
    def commit(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for file, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist()):
                there = store.get_file_info(f"{root}/_temporary/{temporary}").type != fs.FileType.NotFound
                if there:
                    store.move(f"{root}/_temporary/{temporary}", f"{root}/{file}")
                elif store.get_file_info(f"{root}/{file}").type == fs.FileType.NotFound:
                    raise OSError(f"{file} is neither committed nor there to commit")
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    return commit


def _bounds(sizes: DataFrame, least: int, most: int, shard_bytes: int) -> list[int]:
    """The first ids of the shards, from rows (page_id, bytes). The driver holds bounds and heavy bins, both at most about MOST_SHARDS."""
    sign, bounds = 1 << 63, set()
    spark = sizes.sparkSession
    bits = ((least + sign) ^ (most + sign)).bit_length()
    shift, top = max(0, bits - DIGIT), True
    rows = sizes.select(F.col("page_id").bitwiseXOR(F.lit(-sign)).alias("u"), "bytes")  # in unsigned order
    while True:
        start = F.shiftleft(F.shiftrightunsigned("u", shift), shift).bitwiseXOR(F.lit(-sign))  # the bin's first id
        parent = F.lit(0) if top else F.shiftrightunsigned(F.col("start").bitwiseXOR(F.lit(-sign)), parent_shift)
        bins = rows.groupBy(start.alias("start")).agg(F.sum("bytes").alias("bytes")).withColumn("heavy", (F.col("bytes") > shard_bytes) & F.lit(shift > 0))
        over = Window.partitionBy(parent).orderBy("start")  # at most 2 ** DIGIT bins
        before = F.coalesce(F.sum("bytes").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = lambda x: F.floor(x / shard_bytes)
        first = F.lag("heavy").over(over)
        cut_here = first.isNull() | first | F.col("heavy") | (part(F.col("before")) != part(F.coalesce(F.lag("before").over(over), F.lit(-1))))
        found = bins.withColumn("before", before).withColumn("cut", cut_here).filter("cut or heavy").select("start", "heavy").collect()
        bounds.update(r["start"] for r in found)
        heavy = [(r["start"],) for r in found if r["heavy"]]
        if not heavy:
            return sorted(bounds)
        rows = rows.withColumn("start", start).join(F.broadcast(spark.createDataFrame(heavy, "start long")), "start").drop("start")
        parent_shift, shift, top = shift, max(0, shift - DIGIT), False


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the pages under out_dir; the manifest: file, shard, records, bytes, first_id, last_id."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    sizes = cut(pages.select("page_id", (F.octet_length("html") + 1024).cast("long").alias("bytes")), "sizes")
    has_id = F.col("page_id").isNotNull()
    least, most, total, unnamed = sizes.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(~has_id, F.col("bytes"))), F.lit(0))).first()
    shard_bytes = max(shard_bytes, total // MOST_SHARDS)
    extra = -(-unnamed // shard_bytes)  # the shards of rows without an id come first
    bounds = _bounds(sizes.filter(has_id), least, most, shard_bytes) if least is not None else []

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), side="right") - 1 + extra, dtype="int32")

    shard = F.when(has_id, place(F.coalesce("page_id", F.lit(0)))).otherwise(F.pmod(F.xxhash64("url", "html"), F.lit(max(1, extra))).cast("int"))
    prints = pages.select("page_id", F.octet_length("html").alias("n"), F.sha1(F.encode("html", "UTF-8")).alias("sha1")).filter((F.col("n") >= revisit_bytes) & F.col("page_id").isNotNull())
    first = prints.groupBy("sha1", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    marks = prints.join(first, ["sha1", "n"]).filter("page_id <> refers_to").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = pages.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks).withColumn("shard", shard)
    sorted_rows = rows.repartitionById(max(1, extra + len(bounds)), F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("refers_to").asc_nulls_last(), "url", "html")
    manifest = f"{out_dir}/_manifest"
    sorted_rows.mapInArrow(_write(out_dir, roll_bytes), MANIFEST).write.parquet(manifest)
    spark.read.parquet(manifest).select("file", "temporary").mapInArrow(_commit(out_dir), "file string").write.format("noop").mode("overwrite").save()
    jvm = spark.sparkContext._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/_temporary")
    temporary.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(temporary, True)
    return spark.read.parquet(manifest).drop("temporary")


def _parse(batches):
    import io
    import gzip

    import pyarrow as pa

    for batch in batches:
        for content in batch.column("content"):
            stream, rows = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer().to_pybytes()))), []
            while line := stream.readline():
                if not line.startswith(b"WARC/"):
                    raise ValueError("no record begins here")
                head = {}
                while (line := stream.readline().rstrip(b"\r\n")):
                    name, _, value = line.decode().partition(": ")
                    head[name] = value
                block = stream.read(int(head["Content-Length"]))
                if stream.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + _digest(block):
                    raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and (size != len(payload) or digest != _digest(payload)):
                    raise ValueError(f"{head['WARC-Record-ID']} has another payload than its header says")
                number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">") or -1) if x and x != "<urn:page:>" else None
                rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, number(head.get("WARC-Refers-To")), payload.decode() if kind == "response" else None))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_archives(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null in revisits). Digests are verified."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{out_dir}/*.warc.gz") if _any(spark, out_dir) else None
    return files.select("content").mapInArrow(_parse, schema) if files else spark.createDataFrame([], schema)


def _any(spark: SparkSession, out_dir: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/*.warc.gz")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All pages to archives in the shared folder, and back."""
    out_dir = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out_dir)
    return read_archives(spark, out_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1 by SQL: 160 bits are 32 groups of 5.
OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT page_id, strlen(html) AS n, h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string([lpad(bin(CAST('0x' || substr(h, i, 5) AS BIGINT)), 20, '0') FOR i IN range(1, 41, 5)], '') AS bits FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(bits[i] AS INT) + 8 * CAST(bits[i + 1] AS INT) + 4 * CAST(bits[i + 2] AS INT) + 2 * CAST(bits[i + 3] AS INT) + CAST(bits[i + 4] AS INT) AS INT), 1) FOR i IN range(1, 161, 5)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
