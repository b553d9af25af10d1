"""Deterministic sharded WARC writer and reader.

Records are range-partitioned by key at splitters drawn from a hash sample, sorted, and written as one
gzip member each; a file is rolled once its compressed size reaches a limit. Headers and digests are
made anew from the payload, dates are a parameter, gzip headers carry no time, and the number of shards
follows from the bytes and parameters alone, so equal input gives equal bytes in every run and on every
cluster.

Commit: tasks write under temporary names of their own and return what they wrote. The table of their
winning attempts is checkpointed; a second job renames its files and writes one manifest for each range,
an empty one too; then the driver sweeps what failed attempts left and writes the manifest of totals,
without which a folder is no archive. A reader raises if a manifest is missing, if totals differ, or if a
file, a record or a digest does not fit.

Of records with equal payloads the one with the smallest key is a response and the others are revisits
without a payload. Which ones is settled on (key, digest, url) alone. Equal rows are one counted row from
then on, dealt in runs of a few thousand, so a key or page that holds a large part of all rows spreads
over the parts of its range. Only the payloads of responses move, where the repeated ones are few enough
to be told apart on the way; they move once.

Record ids are hashes of key, digest, url and copy number, so they are unique; the key is in a header of
its own.

Defined cases: a null payload is an empty one; a null key sorts first, reads back as null, and is a
response only if no equal payload has a key; repeated rows with equal key, url and payload give one
response and revisits of it; payloads may be of any length that a Spark value may have; an empty table
gives an archive of one empty range; null urls get a urn; other columns are ignored, whatever their names.

Folders: a path without a scheme or with file: must be shared by driver and executors; else the scheme
must be one that pyarrow knows (s3, gs, hdfs, abfs and so on; s3a and s3n are taken as s3). The driver
checks that before anything is written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, cut, fresh_dir, looked_up, table, tidy, unit
from .sharding import _locator, sampled_splitters

DATE = "2000-01-01T00:00:00Z"
LEAST = -(1 << 63)
HEAD_BYTES = 512  # what a record weighs besides its payload
RUN = 4096  # copies of one row that lie together


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC files have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    try:
        return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"no way to write to {scheme}:// from tasks: {e}") from e


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _move(store, temp: str, path: str, size: int) -> None:
    """Renames a finished file; a second attempt finds it done."""
    try:
        if _there(store, temp):
            store.move(temp, path)
            return
    except OSError:
        pass  # another attempt was faster, or the check below fails
    if store.get_file_info(path).size != size:
        raise OSError(f"{path} was not committed")


def _write(store, folder: str, name: str, data: bytes) -> None:
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp, compression=None) as f:
        f.write(data)
    _move(store, temp, f"{folder}/{name}", len(data))


def _read(store, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def _manifest(number: int) -> str:
    return f"shard-{number:06d}.json"


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record_id(key: int | None, sha: str, url: str | None, copy: int) -> str:
    """sha: hexadecimal SHA-1 of the payload. copy: the number of this row among rows of equal key, payload and url."""
    name = hashlib.sha256(json.dumps([key, sha, url, copy]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=4)}>"


def _uri(key: int | None, url: str | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else f"urn:row:{key}"


def record(key: int | None, url: str | None, sha: str, size: int, copy: int = 0, payload: bytes | None = None, of: tuple[int | None, str | None] | None = None, date: str = DATE) -> bytes:
    """A response record with its payload, or a revisit of the first record of (key, url) with an equal payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if of else http + payload
    pairs = [
        ("WARC-Type", "revisit" if of else "response"),
        ("WARC-Record-ID", record_id(key, sha, url, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(key, url)),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if key is not None:
        pairs.append(("Row-Key", key))
    if of:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(of[0], sha, of[1], 0)), ("WARC-Refers-To-Target-URI", _uri(*of))]
        pairs += [("Row-Refers-To-Key", of[0])] if of[0] is not None else []
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers(pairs) + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """Writes the files of one shard under temporary names."""

    def __init__(self, store, folder: str, number: int, roll: int, level: int, date: str):
        self.store, self.folder, self.number, self.roll, self.level, self.date = store, folder, number, roll, level, date
        self.files: list[dict] = []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.number:06d}-{len(self.files):05d}.warc.gz"
            self.temp = f".{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.sha, self.size, self.records = self.store.open_output_stream(f"{self.folder}/{self.temp}", compression=None), hashlib.sha256(), 0, 0
            info = f"software: tessera\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.number}\r\n".encode()
            self._put(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
        self._put(data)
        self.records += 1
        if self.size >= self.roll:
            self._close()

    def _put(self, data: bytes) -> None:
        member = _member(data, self.level)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append({"file": self.name, "temp": self.temp, "bytes": self.size, "records": self.records, "sha256": self.sha.hexdigest()})
            self.out = None

    def done(self) -> tuple[int, str]:
        self._close()
        return self.number, json.dumps(self.files)


def _written(folder: str, roll: int, level: int, date: str):
    """Writes rows that come sorted by shard and row: the runs of a row's copies, then its payload if one of them needs it."""
    columns = ("shard", "key", "sha", "url", "kind", "run", "count", "n", "first", "again", "of_key", "of_url", "payload")

    def write(batches):
        store, base = _store(folder)
        shard, row, runs, done = None, None, [], []

        def flush(payload: bytes | None) -> None:
            for run, count, n, first, again, of, small in runs:
                key, sha, url = row
                for copy in range(run * RUN, run * RUN + count):
                    if again and not (first and copy == 0):
                        shard.add(record(key, url, sha, n, copy, of=of, date=date))
                        continue
                    body = small if small is not None else payload
                    if body is None:
                        raise ValueError(f"the payload of row {row} did not come with it")
                    shard.add(record(key, url, sha, n, copy, body, date=date))
            runs.clear()

        for batch in batches:
            lists = [batch.column(c) for c in columns]
            for i in range(batch.num_rows):
                number, key, sha, url, kind, run, count, n, first, again, of_key, of_url = (c[i].as_py() for c in lists[:-1])
                if row != (key, sha, url) or shard is None or shard.number != number:
                    if runs:
                        flush(None)
                    row = (key, sha, url)
                if shard is None or shard.number != number:
                    if shard is not None:
                        done.append(shard.done())
                    shard = _Shard(store, base, number, roll, level, date)
                if kind == 0:
                    runs.append((run, count, n, first, again, (of_key, of_url), lists[-1][i].as_py()))
                elif runs:  # else a further row with this payload
                    flush(lists[-1][i].as_py())
        if runs:
            flush(None)
        if shard is not None:
            done.append(shard.done())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([f for _, f in done], pa.string())], names=["shard", "files"])

    return write


def _committed(folder: str):
    """Renames the files of each range and writes its manifest."""

    def commit(batches):
        store, base = _store(folder)
        for batch in batches:
            out = []
            for number, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                listed = json.loads(files or "[]")
                for f in listed:
                    _move(store, f"{base}/{f.pop('temp')}", f"{base}/{f['file']}", f["bytes"])
                _write(store, base, _manifest(number), json.dumps(listed).encode())
                out.append((len(listed), sum(f["records"] for f in listed), sum(f["bytes"] for f in listed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["files", "records", "bytes"])

    return commit


def _one_of_each(batches):
    """Drops a task's further rows of equal key, digest and url, so a hot row's payload leaves each task once."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "sha", "url")], strict=True)):
            mark = hashlib.blake2b(repr(row).encode(), digest_size=16).digest()
            if mark not in seen:
                seen.add(mark)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_payload: int = 0, shards: int = 64, shard_bytes: int = 1 << 30, roll_bytes: int = 128 << 20, level: int = 5, date: str = DATE) -> dict:
    """Writes all rows and returns the totals. key: a long column. Equal payloads of at least least_payload bytes are revisited.

    shards: how many to make at least, but for tables of under a MB a shard; beyond shard_bytes a shard there are more.
    """
    spark = pages.sparkSession
    store, base = _store(folder)
    if _there(store, f"{base}/manifest.json"):
        raise FileExistsError(f"{folder} holds an archive")
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), data.alias("payload")).withColumn("sha", F.sha1("payload"))
    size = F.octet_length("payload").cast("long")
    small = F.when(size < least_payload, F.col("payload"))
    lean = cut(rows.groupBy("key", "sha", "url").agg(F.count("*").alias("c"), F.first(size).alias("n"), F.first(small).alias("small")).withColumn("k", F.coalesce("key", F.lit(LEAST))))
    order = F.struct(F.col("key").isNull(), "key", F.col("url").isNull(), "url")
    repeats = lean.where(F.col("n") >= least_payload).groupBy("sha").agg(F.min_by(F.struct("key", "url", "c"), order).alias("of"), F.sum("c").alias("copies")).where("copies > 1")
    repeats = cut(repeats.select("sha", F.col("of.key").alias("of_key"), F.col("of.url").alias("of_url"), F.col("of.c").alias("of_copies"), F.lit(True).alias("again")))
    known = looked_up(lean, repeats.drop("of_copies"), ["sha"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    settled = known.withColumn("first", F.col("again") & _same("key", "of_key") & _same("url", "of_url"))
    bodies = F.when(~F.col("again"), F.col("c")).when(F.col("first"), 1).otherwise(0)
    weights = settled.groupBy("k").agg(F.sum(F.col("c") * HEAD_BYTES + bodies * F.col("n")).alias("w"))
    total = weights.agg(F.sum("w")).first()[0] or 0
    splitters = sampled_splitters(weights, total, max(1, min(shards, total >> 20), total // shard_bytes))
    count = int(splitters.parts.sum())
    where = _locator(splitters)
    place = lambda run: where(F.coalesce("key", F.lit(LEAST)), unit(F.col("sha"), F.col("url"), run))
    # A row whose copies all have a payload of their own is short and carries it.
    last = F.floor((F.col("c") - 1) / RUN)
    runs = settled.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    runs = runs.select(place(F.col("run")).alias("shard"), "key", "k", "sha", "url", F.lit(0).alias("kind"), "run", F.least(F.lit(RUN), F.col("c") - F.col("run") * RUN).cast("long").alias("count"), "n", "first", "again", "of_key", "of_url", F.col("small").alias("payload"))
    bulk = rows.where(size >= least_payload).select("key", "sha", "url", "payload")
    if repeats.count() <= MOST_BROADCAST:
        bulk = bulk.join(F.broadcast(repeats), "sha", "left").where(F.col("again").isNull() | _same("key", "of_key") & _same("url", "of_url"))
        alone, hot = bulk.where(F.coalesce("of_copies", F.lit(1)) == 1).select("key", "sha", "url", "payload"), bulk.where("of_copies > 1").select("key", "sha", "url", "payload")
        bulk = alone if repeats.where("of_copies > 1").isEmpty() else alone.unionByName(hot.mapInArrow(tidy(_one_of_each), hot.schema))
    else:
        bulk = bulk.mapInArrow(tidy(_one_of_each), bulk.schema)
    both = runs.unionByName(bulk.select(place(F.lit(0).cast("long")).alias("shard"), "key", F.coalesce("key", F.lit(LEAST)).alias("k"), "sha", "url", F.lit(1).alias("kind"), "payload"), allowMissingColumns=True)
    ordered = both.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "k", "key", "sha", "url", "kind", "run").drop("k")
    store.create_dir(base, recursive=True)
    written = cut(ordered.mapInArrow(tidy(_written(folder, roll_bytes, level, date)), "shard long, files string"))
    ranges = spark.range(0, count).withColumnRenamed("id", "shard")
    done = ranges.join(written, "shard", "left").select("shard", "files").mapInArrow(tidy(_committed(folder)), "files long, records long, bytes long")
    sums = done.agg(F.sum("files").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    totals = {"shards": count, **{k: v or 0 for k, v in sums.asDict().items()}}
    _sweep(store, base)
    _write(store, base, "manifest.json", json.dumps(totals).encode())
    return totals


def _sweep(store, base: str) -> None:
    """Deletes what failed attempts left: all winning files have their names by now."""
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(base)):
        if info.base_name.startswith(".") and info.base_name.endswith(".tmp"):
            store.delete_file(info.path)


def records(stream, chunk: int = 1 << 20):
    """(headers, block) of each record of a gzip stream of members, one at a time."""
    buffer, raw = bytearray(), b""
    unpacker = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal raw, unpacker
        while True:
            if not raw:
                raw = stream.read(chunk)
                if not raw:
                    return False
            before = len(buffer)
            buffer.extend(unpacker.decompress(raw))
            raw = unpacker.unused_data if unpacker.eof else b""
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
            if len(buffer) > before:
                return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("the archive ends inside a record")
                return
        headers = dict(line.split(": ", 1) for line in buffer[:end].decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        while len(buffer) < end + 8 + n:
            if not more():
                raise ValueError("the archive ends inside a record")
        block = bytes(buffer[end + 4 : end + 4 + n])
        del buffer[: end + 8 + n]
        yield headers, block


def _listed(folder: str):
    """The manifest of each range."""

    def read(batches):
        store, base = _store(folder)
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            listed = []
            for number in numbers:
                try:
                    listed.append(json.loads(_read(store, f"{base}/{_manifest(number)}")))
                except FileNotFoundError as e:
                    raise ValueError(f"the archive {folder} lacks {_manifest(number)}") from e
            flat = [(n, f["file"], f["records"], f["bytes"]) for n, files in zip(numbers, listed, strict=True) for f in files]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)], names=["shard", "file", "records", "bytes"])

    return read


def _rows_of(store, base: str, file: str, count: int, with_payload: bool):
    seen = 0
    with store.open_input_stream(f"{base}/{file}", compression=None) as f:
        for headers, block in records(f):
            if headers["WARC-Type"] == "warcinfo":
                continue
            if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {file}")
            http, _, payload = block.partition(b"\r\n\r\n")
            sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            revisit = headers["WARC-Type"] == "revisit"
            if revisit:
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
            else:
                size = len(payload)
                if sha != digest(payload):
                    raise ValueError(f"damaged payload {headers['WARC-Record-ID']} in {file}")
            seen += 1
            key, of = (None if x is None else int(x) for x in (headers.get("Row-Key"), headers.get("Row-Refers-To-Key")))
            yield headers["WARC-Record-ID"], key, headers["WARC-Target-URI"], headers["WARC-Type"], headers.get("WARC-Refers-To"), of, size, sha, *([None if revisit else payload] if with_payload else [])
    if seen != count:
        raise ValueError(f"{file} has {seen} records and not {count}")


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each record: record_id, key, url, record_type, refers_to_id, refers_to (the key there), payload_bytes, payload_digest, and the payload (null for revisits) if asked for. A missing part or a digest that does not fit is an error."""
    store, base = _store(folder)
    totals = json.loads(_read(store, f"{base}/manifest.json"))
    files = spark.range(0, totals["shards"]).mapInArrow(_listed(folder), "shard long, file string, records long, bytes long")
    seen = files.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    for name in ("files", "records", "bytes"):
        if (seen[name] or 0) != totals[name]:
            raise ValueError(f"the archive {folder} promises {totals[name]} {name} and lists {seen[name]}")
    fields = [("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload

    def read(batches):
        store, base = _store(folder)

        def batch(some):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        some: list[tuple] = []
        held = 0
        for listed in batches:
            for file, count in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), strict=True):
                for row in _rows_of(store, base, file, count, with_payload):
                    some.append(row)
                    held += len(row[-1] or b"") if with_payload else 0
                    if len(some) == 4096 or held > 16 << 20:
                        yield batch(some)
                        some, held = [], 0
        if some:
            yield batch(some)

    spec = "record_id string, key long, url string, record_type string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return files.select("file", "records").mapInArrow(tidy(read), spec)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
