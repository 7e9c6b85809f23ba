"""WARC archives: writing with revisit records, reading back, and an external merge of the capture index.

1. Payloads are told apart by SHA-1; of equal payloads the capture with the
   largest id is a response, the others are revisits that refer to it.
2. Each record is a gzip member (of 16 MB and more: several), so the bytes at its
   (run, offset, length) can be fetched and inflated alone. Spark's text sink puts
   the members one after the other: a member of less than 16 MB ends in a zero
   byte (the top byte of its length), which is the sink's line end. A task begins
   a new file past ``file_bytes`` compressed bytes; files are named as the sink
   does, whatever they hold.
3. Reading takes each file whole through Spark, inflates it piece by piece and
   walks the records by Content-Length, so payloads may hold anything. The index
   rows of a file, sorted by (URL key, time, id) where they are read, are one run.
4. Runs are merged by k-way loser trees: splitters, taken from a sample of 40 keys
   for each merge task, cut the sorted runs into blocks of one task's key space
   each, blocks are shuffled, and a task streams its blocks by their first key: a
   block joins the tree when the merge reaches its first key, a drained one leaves
   it. Keys end in the row number, so one URL's captures may fall to several tasks.
   The tasks' outputs follow each other in key order.

Defined cases: null payload is empty and counts as any other; null URL has no
target header and an empty key; null ids are kept, come before all others when
equal payloads choose their response, and are null in what refers to them;
repeated rows have records of their own, of which the first in the table is
taken as the response; an empty table writes no records; further columns are not
read. Archives of others may hold several records in a member: they are read, with
null offset and length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import partition_id, stage, with_uid

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # base32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
INDEX = pa.schema([(n, pa.string()) for n in ("urlkey", "time")] + [(n, pa.int64()) for n in ("id", "uid")]
                  + [("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                     ("uri", pa.string()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
KEY = ["urlkey", "time", "id", "uid"]
#: Longest member: the top byte of its length is zero.
_MEMBER = (1 << 24) - 1


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 8 times 20 bits as 4 letters."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: F.Column) -> F.Column:
    """Sort-friendly key: host labels reversed, without www and port, then path and sorted query, lower case."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\d*\.", "")
    rest = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(low, r"\?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest,
                    F.when(query != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(""))


def _record_id(id_: F.Column, uid: F.Column) -> F.Column:
    """urn:uuid of 16 hex digits of the id and 16 of twice the row number, plus one if the id is null."""
    digits = F.concat(F.lpad(F.hex(F.coalesce(id_, F.lit(0))), 16, "0"),
                      F.lpad(F.hex(uid * 2 + F.when(id_.isNull(), 1).otherwise(0)), 16, "0"))
    cut = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.lower(F.concat_ws("-", *cut)), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  time_col: str | None = None, revisit_from: int = 0, file_bytes: int = 32 << 20) -> None:
    """Write one record for each row of ``pages`` under ``path``.

    Equal payloads of at least ``revisit_from`` bytes share one response. Without
    ``time_col`` (a timestamp) captures are dated by their id, one a second. A file
    holds ``file_bytes`` and one record at most.
    """
    date = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(1_500_000_000) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(1 << 30)))
    base = with_uid(pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")))
    base = base.withColumn("raw", F.encode("payload", "UTF-8")).withColumn("digest", base32_sha1(F.col("raw")))
    base = base.withColumn("size", F.octet_length("raw")).drop("raw")
    best = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), (-F.col("uid")).alias("uid"))
    first = (base.filter(F.col("size") >= revisit_from).select("digest", "id", "uid", "url", "date")
             .groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("n"),
                                    F.max_by(F.struct("url", "date"), best).alias("at"))
             .filter("n > 1").select("digest", "best", "at"))
    rows = base.join(first, "digest", "left")
    again = F.col("best").isNotNull() & (-F.col("best.uid") != F.col("uid"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A"), " ", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("size").cast("string"), F.lit(CRLF + CRLF))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    fields = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("uid"))), line("WARC-Date", F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        F.coalesce(line("WARC-Target-URI", clean(F.col("url"))), F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(_PROFILE)),
                               line("WARC-Refers-To", _record_id(F.col("best.id"), -F.col("best.uid"))),
                               F.coalesce(line("WARC-Refers-To-Target-URI", clean(F.col("at.url"))), F.lit("")),
                               F.coalesce(line("WARC-Refers-To-Date", F.col("at.date")), F.lit("")))).otherwise(""),
        line("Content-Length", (F.length(head) + F.when(again, 0).otherwise(F.col("size"))).cast("string")), F.lit(CRLF))
    record = F.concat(fields, head, F.when(again, "").otherwise(F.col("payload")), F.lit(CRLF + CRLF))
    members = rows.select(F.encode(record, "UTF-8").alias("record")).mapInArrow(_members(file_bytes), "warc_file bigint, member binary")
    (members.select(F.col("member").cast("string").alias("value"), "warc_file").write.mode("overwrite")
     .partitionBy("warc_file").option("lineSep", "\0").text(path))


def _members(file_bytes: int):
    """(record) -> (number of its file, its gzip members without the zero byte they end in)."""

    def compress(batches):
        number, filled = partition_id() << 32, 0
        for b in batches:
            files, members = [], []
            for record in b.column(0):
                raw, out = memoryview(record.as_buffer()), b""
                for at in range(0, len(raw), _MEMBER):
                    out += zlib.compress(raw[at:at + _MEMBER], wbits=31)
                if filled >= file_bytes:
                    number, filled = number + 1, 0
                filled += len(out)
                files.append(number)
                members.append(out[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(members, pa.binary())], names=["warc_file", "member"])
    return compress


class _Inflated:
    """Bytes of a gzip file (any number of members), inflated as they are asked for."""

    def __init__(self, raw: bytes, piece: int = 1 << 16):
        self.raw, self.at, self.piece = memoryview(raw), 0, piece
        self.z, self.buf = None, bytearray()

    def place(self) -> int | None:
        """Compressed bytes before what comes next, if that begins a member."""
        return self.at if self.z is None and not self.buf else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            if self.z is not None:
                raise ValueError("the archive ends within a member")
            return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        piece = self.raw[self.at:self.at + self.piece]
        self.buf += self.z.decompress(piece)
        self.at += len(piece) - len(self.z.unused_data)
        if self.z.eof:
            self.z = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, which is dropped; None at the end of the file."""
        look = 0
        while (i := self.buf.find(mark, look)) < 0:
            look = max(0, len(self.buf) - len(mark) + 1)
            if not self._more():
                if self.buf:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.buf[:i])
        del self.buf[:i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def rest_of_member(self) -> None:
        """Inflate the end mark of a member whose bytes are all taken."""
        while self.z is not None and not self.buf:
            self._more()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for x in head.decode("utf-8").split(CRLF)[1:]:
        name, _, value = x.partition(": ")
        out[name.lower()] = value
    return out


def _id_of(urn: str) -> tuple[int | None, int]:
    digits = urn[len("<urn:uuid:"):-1].replace("-", "")
    n, low = int(digits[:16], 16), int(digits[16:], 16)
    return None if low & 1 else n - (1 << 64) * (n >> 63), low >> 1


def read_records(raw: bytes):
    """(fields, payload, offset, length) of each record of a gzipped archive; payload None for revisits.

    Offset and length are compressed bytes, None where a record shares its member.
    """
    data = _Inflated(raw)
    end = (CRLF + CRLF).encode()
    while True:
        at = data.place()
        head = data.until(end)
        if head is None:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        f = _fields(head)
        http, _, payload = data.take(int(f["content-length"])).partition(end)
        if data.take(4) != end:
            raise ValueError(f"the record at byte {at} has a wrong length")
        data.rest_of_member()
        stop = data.place()
        f["http-length"] = _fields(http)["content-length"]
        alone = at is not None and stop is not None
        yield f, (payload if f["warc-type"] == "response" else None), at if alone else None, stop - at if alone else None


def _index_file(batches):
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
            rows = []
            for f, payload, at, n in read_records(raw.as_py()):
                i, uid = _id_of(f["warc-record-id"])
                digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["http-length"])
                if payload is not None:
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    if "sha1:" + digest != f["warc-payload-digest"]:
                        raise ValueError(f"payload of record {f['warc-record-id']} doesn't match its digest")
                to = _id_of(f["warc-refers-to"])[0] if "warc-refers-to" in f else None
                rows.append((None, f["warc-date"], i, uid, f["warc-type"], size, digest, to, f.get("warc-target-uri"), path, at, n))
            cols = list(zip(*rows)) or [()] * len(INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, INDEX)], schema=INDEX)


class LoserTree:
    """Merges sorted runs: each inner place keeps the loser of its match, so a new head plays only its way up."""

    def __init__(self, runs=()):
        self.runs, self.at = [], []
        self.add(runs)

    def add(self, runs) -> list[int]:
        """Let further runs, none with a key before the last one taken, into the tree; their places, those of drained runs first."""
        drained, places = [i for i, r in enumerate(self.runs) if self.at[i] >= len(r)], []
        for r in runs:
            if drained:
                i = drained.pop()
                self.runs[i], self.at[i] = r, 0
            else:
                i = len(self.runs)
                self.runs.append(r)
                self.at.append(0)
            places.append(i)
        self.k = max(1, len(self.runs))
        self.loser = [-1] * self.k
        for i in range(len(self.runs)):
            self._climb(i)
        return places

    def top(self) -> int | None:
        """The run with the first key; None when all are drained."""
        w = self.loser[0]
        return None if w < 0 or self.at[w] >= len(self.runs[w]) else w

    def step(self) -> None:
        """Take the first key."""
        w = self.loser[0]
        self.at[w] += 1
        self._climb(w)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; an empty run comes last."""
        if self.at[b] >= len(self.runs[b]):
            return True
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def _climb(self, winner: int) -> None:
        i = (winner + self.k) // 2
        while i > 0:
            other = self.loser[i]
            if other < 0:  # first to come here waits for its match
                self.loser[i] = winner
                return
            if not self._before(winner, other):
                self.loser[i], winner = winner, other
            i //= 2
        self.loser[0] = winner

    def __iter__(self):
        """(run, place in the run) in merged order."""
        while (w := self.top()) is not None:
            yield w, self.at[w]
            self.step()


def _keys(b: pa.RecordBatch) -> list[tuple]:
    """Comparable keys of a batch's rows; null ids come first."""
    cols = {n: b.column(n).to_pylist() for n in KEY}
    return list(zip(cols["urlkey"], cols["time"], [(x is not None, x or 0) for x in cols["id"]], cols["uid"]))


_BLOCK = pa.schema([("task", pa.int64()), *(INDEX.field(n) for n in KEY), ("rows", pa.binary())])


def _blocks(splitters: list[tuple]):
    """Rows of sorted runs -> sorted blocks of rows of one run that fall to one merge task."""

    def cut(batches):
        for b in batches:
            b = b.select(INDEX.names).cast(INDEX)
            key, run = _keys(b), b.column("run").to_pylist()
            task = [bisect_right(splitters, k) for k in key]
            first = [i for i in range(len(key)) if not i or run[i] != run[i - 1] or task[i] != task[i - 1] or key[i] < key[i - 1]]
            heads = b.select(KEY).take(pa.array(first, pa.int64()))
            packed = [b.slice(i, j - i).serialize().to_pybytes() for i, j in zip(first, [*first[1:], len(key)])]
            yield pa.RecordBatch.from_arrays([pa.array([task[i] for i in first], pa.int64()), *heads.columns, pa.array(packed, pa.binary())],
                                             schema=_BLOCK)
    return cut


def _merged(blocks):
    """(block, row) in key order from sorted blocks that come by their first key; holds the blocks the merge is within."""
    tree, held = LoserTree(), {}
    coming = next(blocks, None)
    while True:
        w = tree.top()
        while coming is not None and (w is None or coming[0][0] <= tree.runs[w][tree.at[w]]):
            held[tree.add([coming[0]])[0]] = coming[1]
            coming, w = next(blocks, None), tree.top()
        if w is None:
            return
        yield held[w], tree.at[w]
        tree.step()


def _merge(batches):
    """Blocks sorted by (task, first key) -> rows in key order, with their place in the merged index."""

    def unpacked():
        for b in batches:
            for task, rows in zip(b.column("task").to_pylist(), b.column("rows")):
                yield task, pa.ipc.read_record_batch(rows.as_buffer(), INDEX)

    def flush(pieces, place):
        t = pa.Table.from_batches([b.slice(i, n) for b, i, n in pieces], INDEX).combine_chunks()
        return t.append_column("place", pa.array(range(place, place + t.num_rows), pa.int64())).to_batches()

    for task, blocks in groupby(unpacked(), lambda x: x[0]):
        place, pieces, n = task << 33, [], 0
        for block, row in _merged((_keys(b), b) for _, b in blocks):
            if pieces and pieces[-1][0] is block and pieces[-1][1] + pieces[-1][2] == row:
                pieces[-1][2] += 1
            else:
                pieces.append([block, row, 1])
            n += 1
            if n == 10_000:
                yield from flush(pieces, place)
                place, pieces, n = place + n, [], 0
        if pieces:
            yield from flush(pieces, place)


def _files(spark, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
            .select("path", "content"))


def read_index(spark, path: str, task_rows: int = 200_000) -> DataFrame:
    """The merged capture index of the archives under ``path``: INDEX columns and ``place``, ordered by it.

    ``task_rows`` is about what one merge task passes on.
    """
    found = _files(spark, path).mapInArrow(_index_file, _ddl(INDEX)).withColumn("urlkey", url_key(F.col("uri")))
    runs = stage(found.sortWithinPartitions("run", *KEY), "warc-runs")
    n = runs.count()
    tasks = max(1, -(-n // task_rows))
    splitters = []
    if tasks > 1:
        some = runs.select(*KEY).sample(min(1.0, 40 * tasks / n), seed=1).collect()
        keys = sorted((r.urlkey, r.time, (r.id is not None, r.id or 0), r.uid) for r in some)
        splitters = keys[len(keys) // tasks::max(1, len(keys) // tasks)][:tasks - 1]
    blocks = runs.mapInArrow(_blocks(splitters), _ddl(_BLOCK))
    dealt = blocks.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task", *KEY)
    return stage(dealt.mapInArrow(_merge, _ddl(INDEX) + ", place bigint"), "warc-index")


def _fetched(batches):
    for b in batches:
        payloads = []
        for raw in b.column("_member"):
            for _, payload, _, _ in read_records(raw.as_py()):
                payloads.append(payload)
        kept = [n for n in b.schema.names if n != "_member"]
        yield b.select(kept).append_column("payload", pa.array(payloads, pa.binary()))


def read_captures(captures: DataFrame, path: str) -> DataFrame:
    """``captures`` (rows of the index of ``path``) with the ``payload`` of each record, null for revisits.

    Only a record's own members are inflated.
    """
    files = _files(captures.sparkSession, path).withColumnRenamed("path", "run")
    own = captures.filter("offset is not null").join(files, "run").withColumn(
        "_member", F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int"))).drop("content")
    schema = ", ".join(f"`{n}` {t}" for n, t in own.drop("_member").dtypes)
    return own.mapInArrow(_fetched, schema + ", payload binary")


def archive_and_index(pages: DataFrame, revisit_from: int = 0, **columns) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and return their merged index."""
    path = scratch_path(pages.sparkSession, "llm-warc")
    write_archive(pages, path, revisit_from=revisit_from, **columns)
    return read_index(pages.sparkSession, path)
