"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

A monolithic file is one gzip stream over all records, so nothing in it can be reached
without inflating all before it.  The normaliser inflates each once, in pieces, writes every
record again as a gzip member of its own, and notes the offset and length of each member in a
sidecar index, with which a record can be read alone.

Files are kept in a folder that all machines share and are opened through pyarrow's file
systems.  A task writes under a name of its own attempt and renames at the end, so a task
that runs again replaces its file with an equal one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lekhya.session import stage, staging_root

CHUNK = 1 << 20
LEAST = 100  # smaller payloads are never revisits
INDEX = ("file string, offset long, length long, page_id long, record_type string, "
         "uri string")
READ = ("page_id long, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, uri string")


def open_folder(uri: str):
    """(file system, path) of a folder or file, given as URI or as a plain path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:")
                                          else "file://" + uri)
    return system, path


def one_line(value: str | None) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in value or "")


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A record; a revisit (``first`` is another page) carries headers only."""
    revisit = first is not None and first != page_id
    body = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {one_line(url)}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class Inflated:
    """Reads a gzip file of one or more members as one stream, in pieces."""

    def __init__(self, raw):
        self.raw, self.z, self.held, self.ended = raw, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        data = self.z.unconsumed_tail or self.z.unused_data or self.raw.read(CHUNK)
        if not data:
            if not self.z.eof and self.z.decompress(b"") == b"" and self.started:
                raise EOFError("the gzip stream is cut off")
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.started = True
        self.held += self.z.decompress(data, CHUNK)
        return True

    started = False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is consumed; None at the end of the stream."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held:
                    raise EOFError("the last record is cut off")
                return None
        out = bytes(self.held[:found])
        del self.held[:found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("the last record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(raw) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, whole record) of each record of a gzip file."""
    stream = Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        body = stream.take(int(fields["Content-Length"]))
        yield fields, body, head + b"\r\n\r\n" + body + stream.take(4)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """One gzip stream per task; returns the files written.

    Input: page_id, url, payload (binary), digest, first (page that holds the payload or
    null).  A task without rows writes no file.
    """
    def run(batches):
        system, path = open_folder(folder)
        task = TaskContext.get()
        name = f"{path}/mono-{task.partitionId():06d}.warc.gz"
        part, out, z = f"{name}.{task.taskAttemptId()}", None, zlib.compressobj(6, wbits=31)
        for pdf in batches:
            for page_id, url, payload, digest, first in zip(
                    pdf["page_id"].astype("Int64"), pdf["url"], pdf["payload"], pdf["digest"],
                    pdf["first"].astype("Int64")):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(part)
                out.write(z.compress(record(None if page_id is pd.NA else int(page_id), url,
                                            bytes(payload), digest,
                                            None if first is pd.NA else int(first))))
        if out is not None:
            out.write(z.flush())
            out.close()
            system.move(part, name)
            yield pd.DataFrame({"file": [name.rsplit("/", 1)[1]]})

    return stage(pages.select("page_id", "url", "payload", "digest", "first")
                 .mapInPandas(run, "file string"))


def normalise(files: DataFrame, folder: str, rename=lambda name: "each-" + name) -> DataFrame:
    """Rewrite each file of ``folder`` record by record; returns the index, which also lies
    beside each file as ``.cdxj`` lines.  A file that is cut off raises an error."""
    def run(batches):
        system, path = open_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for source in pdf["file"]:
                rows, offset, name = [], 0, rename(source)
                part = f"{path}/{name}.{attempt}"
                with system.open_input_stream(f"{path}/{source}", compression=None) as raw, \
                        system.open_output_stream(part, compression=None) as out:
                    for fields, _, whole in records(raw):
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        rows.append((name, offset, len(member), page_of(fields["WARC-Record-ID"]),
                                     fields["WARC-Type"], fields["WARC-Target-URI"]))
                        offset += len(member)
                system.move(part, f"{path}/{name}")
                with system.open_output_stream(part + ".cdxj", compression=None) as out:
                    for r in rows:
                        out.write((json.dumps(dict(zip(("file", "offset", "length", "page_id",
                                                        "type", "uri"), r))) + "\n").encode())
                system.move(part + ".cdxj", f"{path}/{name}.cdxj")
                made = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield made.astype({"page_id": "Int64"})

    n = files.count()
    return stage(files.repartition(max(1, n)).mapInPandas(run, INDEX))


def read_indexed(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that an index names, each by offset and length alone.

    A response's digest and size are computed from its payload and have to equal its headers;
    a revisit's are those of its headers.
    """
    def run(batches):
        system, path = open_folder(folder)
        name, source = None, None
        for pdf in batches:
            rows = []
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{path}/{file}")
                source.seek(int(offset))
                whole = zlib.decompress(source.read(int(length)), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                fields = headers(head)
                payload = rest[:int(fields["Content-Length"])]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and (
                        len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file} at {offset}: payload and digest differ")
                rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Type"],
                             page_of(fields.get("WARC-Refers-To")), size, digest,
                             fields["WARC-Target-URI"]))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return index.select("file", "offset", "length").mapInPandas(run, READ)


def deduplicated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, first: the smallest page of equal payloads, null for
    payloads that are alone or small.  Only digests meet in the join, hot ones
    pre-aggregated; AQE may split them."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8")
                        .alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("p"))
    firsts = (slim.filter(F.octet_length("p") >= least)
              .select("page_id", F.sha2("p", 256).alias("digest")).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").drop("n"))
    return rows.join(firsts, "digest", "left")


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple:
    """(index, folder): write ``pages`` (page_id, url, html) monolithic, then normalise.

    Null html is an empty payload; a null page_id is written without a number; repeated rows
    are records each (the repeated row of a response is one as well); an empty table leaves
    an empty index.
    """
    folder = folder or (f"{staging_root(pages.sparkSession).rstrip('/')}"
                        f"/warc-{uuid.uuid4().hex}")
    files = write_monolithic(deduplicated(pages, least), folder)
    return normalise(files, folder), folder
