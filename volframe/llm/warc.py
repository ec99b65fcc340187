"""Web archives: records written and read back, and capture indexes merged into globally ordered histories."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import Opened, _open
from .shared import giving_back, read, save, shared_path
from .url_filters import host_of

#: Payloads from this many bytes on are written once; later records of the same payload revisit the first.
LEAST_REVISITED = 100
#: An archive is closed after this many bytes; this many bytes of an archive are read by one task.
ARCHIVE_BYTES, RANGE_BYTES = 64_000_000, 16_000_000
BATCH_ROWS = 2_000
#: Rows of a run that a merge holds at a time, runs that it merges at a time, rows of a range, keys that cut the ranges.
HEAD_ROWS, FAN_IN, RANGE_ROWS, SPLITTERS = 512, 128, 100_000, 10_000
#: The times that a record's date can state.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def url_key(url: Column) -> Column:
    """The sort key of a url: its host's labels from the last to the first, then what follows the host without a
    fragment, in lower case. Empty for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    return F.lower(F.coalesce(F.concat(host, F.lit(")"), rest), F.lit("")))


class LoserTree:
    """Merges k sorted sequences. Inner node i keeps the loser of the match played there; the winner moves up.

    The next item costs one match on each level from the winner's leaf to the root.
    """

    END = object()

    def __init__(self, runs: Sequence[Iterator], key: Callable):
        self.runs, self.key, self.k = list(runs), key, len(runs)
        self.heads = [next(r, self.END) for r in self.runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a goes before run b: by key, then by run, an ended run last."""
        if self.heads[a] is self.END or self.heads[b] is self.END:
            return self.heads[b] is self.END and (self.heads[a] is not self.END or a < b)
        x, y = self.key(self.heads[a]), self.key(self.heads[b])
        return x < y or x == y and a < b

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits for the other half
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.losers[0]] is not self.END:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], self.END)
            self._play(w)


def revisits(pages: DataFrame, key: str, payload: Column, least: int = LEAST_REVISITED) -> DataFrame:
    """pages with payload (null: empty), payload_bytes, payload_digest and refers_to: for payloads of at least `least`
    bytes the smallest key with an equal payload, where that is another row's; else null. Rows that share the smallest key
    all keep their payload; a row with a null key refers to the smallest key, if there is one.

    Firsts are pre-aggregated by digest, and the digests' side of the join has one row for each, so a payload that very
    many rows share can be split.
    """
    raw = F.coalesce(payload, F.lit(b"").cast("binary"))
    rows = pages.withColumn("payload", raw).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = pages.select(F.col(key), raw.alias("p")).where(F.octet_length("p") >= least).groupBy(F.sha2("p", 256).alias("payload_digest"))
    firsts = narrow.agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(firsts, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("_first").eqNullSafe(F.col(key)), F.col("_first"))).drop("_first")


CAPTURE = "url_key string, captured_at long, page_key string, archive string, first_byte long, after_byte long"


def _record(url: str | None, at: int, key: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    import datetime

    near = min(max(at, FIRST_SECOND), LAST_SECOND)  # a date has four digits of the year; the index keeps the time itself
    day = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=near)).isoformat() + "Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {at} {url}')}>",
        f"WARC-Date: {day}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write a compressed record for each row; returns the index, (url_key, captured_at, page_key, archive, first_byte,
    after_byte), saved.

    pages: url, captured_at (seconds), page_key, payload, payload_digest, refers_to (as text). A task sorts its rows by
    url key, time and page key, so each archive is a sorted run. Archives of failed tasks are on no index.
    """
    ordered = pages.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("url_key", "captured_at", "page_key")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            index: list[tuple] = []
            for r in b.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(name, compression=None)
                record = _record(r["url"], r["captured_at"], r["page_key"], r["payload"], r["payload_digest"], r["refers_to"])
                out.write(record)
                index.append((r["url_key"], r["captured_at"], r["page_key"], name, at, at + len(record)))
                at += len(record)
            if index:
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["url_key", "captured_at", "page_key", "archive", "first_byte", "after_byte"])
        if out is not None:
            out.close()

    columns = ordered.select("url_key", "url", "captured_at", "page_key", "payload", "payload_digest", "refers_to")
    return save(columns.mapInArrow(written, CAPTURE), "captures")


def _parsed(record: bytes) -> dict:
    raw = zlib.decompress(record, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "payload_bytes": int(sent["Content-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else None,
    }


READ = "payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_back(index: DataFrame, path: str) -> DataFrame:
    """The records of an index, read from the archives: its columns and payload_bytes, payload_digest, record_type and
    refers_to. A response's length and digest come from the payload itself, a revisit's from its headers. Rows of one
    stretch of an archive are read by one task in the archive's order, so they are a sorted run."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(path)
        at = Opened(files, "")
        for b in batches:
            found = []
            for archive, first, after in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("archive", "first_byte", "after_byte")), strict=True):
                if archive != at.path:
                    at.close()
                    at = Opened(files, archive)
                found.append(_parsed(at.at(first, after - first)))
            new = [pa.array([x[c] for x in found], t) for c, t in (("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    stretch = F.floor(F.col("first_byte") / RANGE_BYTES)
    runs = index.repartition(F.col("archive"), stretch).sortWithinPartitions("archive", "first_byte")
    return runs.mapInArrow(opened, f"{CAPTURE}, {READ}")


def _key_of(names: Sequence[str], by: Sequence[str]) -> Callable[[tuple], tuple]:
    """The merge order of a row: its values in `by`, nulls first."""
    at = [names.index(c) for c in by]
    return lambda row: tuple((row[i] is not None, row[i]) for i in at)


def _bounds(runs: DataFrame, by: Sequence[str], n: int, range_rows: int) -> list[tuple]:
    """Keys that cut the order of `by` in ranges of about range_rows of the n rows: quantiles of about SPLITTERS rows, every
    so many-th of each run from a place of its own on."""
    ranges = math.ceil(n / range_rows)
    if ranges < 2:
        return []
    step = max(1, n // SPLITTERS)
    place = F.col("_metadata.row_index") + F.pmod(F.xxhash64("_metadata.file_path"), F.lit(step))
    some = runs.where(place % step == 0).select(*by).collect()  # about SPLITTERS keys
    key = _key_of(list(by), by)
    keys = sorted(key(tuple(r)) for r in some)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _within(uri: str, names: list[str], key: Callable[[tuple], tuple], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The rows of a sorted run from low on and before high. One batch of them is held; row groups that end before low or
    begin after high, by the first column of the order, are not read."""
    import pyarrow.parquet as pq

    files, at = _open(uri)
    first = names[0]
    with files.open_input_file(at) as f:
        parquet = pq.ParquetFile(f, pre_buffer=False)
        of = parquet.schema_arrow.names.index(first)
        for g in range(parquet.num_row_groups):
            stats = parquet.metadata.row_group(g).column(of).statistics
            if stats is not None and stats.has_min_max and not stats.null_count:
                if low is not None and (True, stats.max) < low[0]:
                    continue
                if high is not None and (True, stats.min) > high[0]:
                    return
            for batch in parquet.iter_batches(batch_size=HEAD_ROWS, row_groups=[g], use_threads=False):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = key(row)
                    if high is not None and own >= high:
                        return
                    if low is None or own >= low:
                        yield row


def _parts(df: DataFrame) -> list[tuple[int, str]]:
    """(partition that wrote it, name) of the files of a saved table, in order."""
    found = [(int(m[1]), f) for f in df.inputFiles() if (m := re.search(r"/part-(\d+)-[^/]*$", f))]
    return sorted(found)


def merge(captures: DataFrame, by: Sequence[str], range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """captures in the global order of `by`: its partitions, one after the other, are sorted.

    Tasks sort their rows and write them: the runs, one a file. Ranges of the order, of about range_rows rows by a count and
    quantiles, are a task each: it reads its stretch of each run as a stream, a batch of HEAD_ROWS rows at a time, and
    merges the streams by a loser tree, so what a task holds grows with the number of runs, not with the rows of its range.
    Where there are more than fan_in runs, groups of fan_in are merged first, range by range, into longer runs. With a
    column in `by` that tells rows apart, no value of the others makes a range large. Nulls come first; ties keep the
    order of their runs. Runs outlast lost executors, and any range can be merged again from them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, schema = captures.sparkSession, captures.schema
    names = [*by, *(c for c in captures.columns if c not in by)]
    key, fields = _key_of(names, by), to_arrow_schema(captures.select(*names).schema)
    order = [F.asc_nulls_first(c) for c in by]
    runs = save(captures.select(*names).sortWithinPartitions(*order), "runs")
    cuts = _bounds(runs, by, runs.count(), range_rows)
    edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    files: dict[int | None, list[str]] = {None: [f for _, f in _parts(runs)]}  # of a range; None: of every range

    def merging(groups: int, shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, bounds = shared.value
            for b in batches:
                for task in b.column(0).to_pylist():
                    group, of = divmod(task, len(bounds))
                    own = known.get(of, known.get(None, []))
                    own = own[group * fan_in : (group + 1) * fan_in] if groups > 1 else own
                    streams = [_within(f, names, key, *bounds[of]) for f in own]
                    for some in itertools.batched(LoserTree(streams, key), BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], names)

        tasks = groups * len(edges)
        return spark.range(0, tasks, 1, tasks).mapInArrow(giving_back(work), runs.schema)

    while (most := max(map(len, files.values()))) > fan_in:
        groups = math.ceil(most / fan_in)
        longer = save(merging(groups, spark.sparkContext.broadcast((files, edges))), "runs")
        files = {i: [] for i in range(len(edges))}
        for part, f in _parts(longer):
            files[part % len(edges)].append(f)
    return merging(1, spark.sparkContext.broadcast((files, edges))).select(*schema.names)


def op9(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    rows = revisits(pages, "page_id", F.encode("html", "UTF-8")).select(
        "url", F.coalesce("page_id", F.lit(0)).alias("captured_at"), F.col("page_id").cast("string").alias("page_key"), "payload", "payload_digest", F.col("refers_to").cast("string").alias("refers_to")
    )  # pages have no time of capture; the id stands for one
    path = shared_path(spark, "warc")
    index = write(rows, path)
    captures = read_back(index, path)
    history = merge(captures, ("url_key", "captured_at", "page_key"))
    return history.select(F.col("page_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "captured_at")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to,
  lower(coalesce(array_to_string(list_reverse(string_split(translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',') || ')' || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '')) AS url_key,
  coalesce(page_id, 0) AS captured_at
FROM f"""
