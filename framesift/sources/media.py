"""Media files as tables. Files come through Spark's own binaryFile reader, so any store that Spark reads will do.

A file is one row; its walk is a map over Arrow batches and gives one row a packet, track or chunk. A damaged
file gives the rows up to the damage and one row with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framesift.functions.codecs import Damaged
from framesift.functions.scalars import sniff
from framesift.sources import containers as C

PACKETS = "track long, seq long, pts long, key boolean, data binary, reason string"
CHUNKS = "seq long, kind string, offset long, size long, data binary, reason string"
TRACKS = "track long, type string, codec string, width long, height long, rate double, channels long, timescale double, reason string"
ROWS = 512


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, format, content of every file under path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), sniff(F.col("content")).alias("format"), "content")


def packets_of(format_: str, data: bytes) -> Iterator[dict]:
    walk = {"ivf": C.ivf_frames, "ogg": C.ogg_packets, "matroska": C.matroska_packets}.get(format_)
    if walk is None:
        raise Damaged(f"no packets in {format_}")
    return walk(data)


def chunks_of(format_: str, data: bytes) -> Iterator[dict]:
    if format_ == "png":
        found: Iterable[dict] = C.png_chunks(data)
    elif format_ in ("wav", "aiff", "webp"):
        found = C.riff_chunks(data)
    elif format_ == "jpeg":
        found = ({**m, "kind": f"{m['marker']:02X}"} for m in C.jpeg_markers(data))
    elif format_ in ("mp4", "avif"):
        found = ({**b, "seq": i, "kind": b["path"]} for i, b in enumerate(C.mp4_boxes(data)))
    elif format_ == "matroska":
        found = ({"seq": i, "kind": f"{n:X}", "offset": a, "data": data[a:b] if n not in C.MASTERS else b"", "size": b - a} for i, (_, n, a, b) in enumerate(C.ebml_elements(data)))
    elif format_ == "ogg":
        found = ({"seq": p["seq"], "kind": "page", "offset": None, "data": p["data"]} for p in C.ogg_pages(data))
    else:
        raise Damaged(f"no chunks in {format_}")
    for c in found:
        yield {"seq": c["seq"], "kind": c["kind"], "offset": c["offset"], "size": c.get("size", len(c["data"])), "data": c["data"]}


def tracks_of(format_: str, data: bytes) -> Iterator[dict]:
    kinds = {1: "video", 2: "audio", 17: "subtitle"}
    if format_ == "matroska":
        for t in C.matroska_tracks(data):
            yield {"track": t["track"], "type": kinds.get(t["type"], "other"), "codec": t["codec"], "width": t["width"], "height": t["height"], "rate": t["rate"], "channels": t["channels"], "timescale": 1e9 / t["scale_ns"]}
    elif format_ == "ivf":
        h = C.ivf_header(data)
        yield {"track": 0, "type": "video", "codec": h["codec"], "width": h["width"], "height": h["height"], "timescale": h["rate"] / max(1, h["scale"])}
    elif format_ == "ogg":
        for p in C.ogg_pages(data):
            if p["first"]:
                codec = "opus" if p["data"][:8] == b"OpusHead" else "vorbis" if p["data"][:7] == b"\x01vorbis" else "unknown"
                channels = p["data"][9] if codec == "opus" else p["data"][11] if codec == "vorbis" else None
                yield {"track": p["serial"], "type": "audio", "codec": codec, "channels": channels, "timescale": 48000.0 if codec == "opus" else None}
    else:
        raise Damaged(f"no tracks in {format_}")


def walked(rows: DataFrame, keys: list[str], walk: Callable[[str, bytes], Iterator[dict]], schema: str, format_: str = "format", content: str = "content") -> DataFrame:
    """keys and the walk's rows of each file; null content gives none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kept = rows.select(*keys, format_, content)
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            key_type = [batch.schema.field(i).type for i in range(len(keys))]
            target = target or pa.schema([*zip(keys, key_type, strict=True), *((n, _arrow(t)) for n, t in (c.strip().split(" ") for c in schema.split(",")))])
            out: list[dict] = []
            for row in batch.to_pylist():
                if row[content] is None:
                    continue
                key = {k: row[k] for k in keys}
                try:
                    for found in walk(row[format_], row[content]):
                        out.append(key | {n: found.get(n) for n in names})
                        if len(out) == ROWS:
                            yield pa.RecordBatch.from_pylist(out, target)
                            out = []
                except Damaged as error:
                    out.append(key | dict.fromkeys(names) | {"reason": str(error)})
            yield pa.RecordBatch.from_pylist(out, target)

    return kept.mapInArrow(work, full)


def _arrow(name: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}[name]


def packets(rows: DataFrame, keys: list[str]) -> DataFrame:
    return walked(rows, keys, packets_of, PACKETS)


def chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return walked(rows, keys, chunks_of, CHUNKS)


def tracks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return walked(rows, keys, tracks_of, TRACKS)


class MediaFiles(DataSource):
    """Sink "media_files": rows of name and content become files of the folder `path`, by Arrow's file systems.

    A task writes under a name of its own and renames at its end, so a task that runs twice leaves one file.
    """

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        where.create_dir(folder, recursive=True)
        for row in rows:
            part = f"{folder}/.{uuid.uuid4().hex}"
            with where.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            where.move(part, f"{folder}/{row['name']}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        """Files are in place already."""

    def abort(self, messages) -> None:
        """Names that were renamed stay; a repeated write replaces them."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaFiles)
