"""Incremental operators on streams: a catalog kept up to date, and chunking of growing files."""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.kernels import Chunker
from ..operators import catalog


KEPT = 3
EARLY_BYTES = 256 << 20


def keep_catalog(changes: DataFrame, target: str, checkpoint: str, key: str = "name", order: str = "entry_idx") -> StreamingQuery:
    """Applies every micro-batch of new entries to the catalog below ``target``: a name's latest
    entry replaces what was there, as repeated updates would. Each version is a folder of its own
    named by the batch, so a batch that runs again writes the same version again; the last KEPT
    versions stay."""
    spark = changes.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg({order: "max"}).withColumnRenamed(f"max({order})", "_newest")
        latest = batch.join(newest, key).where(f"{order} = _newest").drop("_newest").dropDuplicates([key])
        if number == 0:
            latest.write.mode("overwrite").parquet(f"{target}/v0")
            return
        before = spark.read.schema(batch.schema).parquet(f"{target}/v{number - 1}")
        merged = catalog.upsert(before, latest, key, order, renumber=False)
        merged.write.mode("overwrite").parquet(f"{target}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{number - KEPT}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


_CHUNKS = "file string, offset long, length long, hash long"


def chunk_files(pieces: DataFrame) -> DataFrame:
    """Content-defined chunks of files that arrive in pieces: file, seq, content, last (boolean).

    Keyed by file; the state holds at most one chunk's pending bytes, and pieces that came too
    early, of EARLY_BYTES at most (more are an error). The chunks don't depend on how a file is cut into pieces or batches.
    """
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunker, expected, early = pickle.loads(state.get[0]) if state.exists else (Chunker(), 0, {})
        for frame in frames:
            for seq, content, last in zip(frame["seq"], frame["content"], frame["last"], strict=True):
                early[int(seq)] = (bytes(content or b""), bool(last))
        found, done = [], False
        while expected in early and not done:
            content, done = early.pop(expected)
            expected += 1
            found += chunker.feed(content)
            if done:
                found += chunker.finish()
        if done:
            state.remove()
        else:
            _bounded(key[0], early)
            state.update((pickle.dumps((chunker, expected, early)),))
        signed = [(key[0], o, n, h - (1 << 64) if h >> 63 else h) for o, n, h in found]
        yield pd.DataFrame(signed, columns=["file", "offset", "length", "hash"])

    return pieces.groupBy("file").applyInPandasWithState(step, _CHUNKS, "state binary", "append", "NoTimeout")


def _bounded(name: str, early: dict) -> None:
    if sum(len(content) for content, *_ in early.values()) > EARLY_BYTES:
        raise ValueError(f"{name}: a piece is missing, and more than {EARLY_BYTES} bytes wait for it")


WINDOW = 32 << 10
_GZIP_HEAD = bytes.fromhex("1f8b08000000000000ff")


def _packed(content: bytes, before: bytes, level: int) -> bytes:
    """Raw DEFLATE of a piece that may refer to the bytes before it, ended at a byte."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, before) if before else zlib.compressobj(level, zlib.DEFLATED, -15, 9)
    return c.compress(content) + c.flush(zlib.Z_SYNC_FLUSH)


def _unpacked(raw: bytes, before: bytes, cap: int) -> bytes:
    d = zlib.decompressobj(-15, before) if before else zlib.decompressobj(-15)
    out = d.decompress(raw, cap + 1)
    if len(out) > cap:
        raise ValueError("output above its cap")
    return out


def _coded(pieces: DataFrame, work) -> DataFrame:
    """Feeds each file's pieces in order to work(content, last, memory), which returns (bytes, memory)."""
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, expected, early = pickle.loads(state.get[0]) if state.exists else (None, 0, {})
        for frame in frames:
            for seq, content, last in zip(frame["seq"], frame["content"], frame["last"], strict=True):
                early[int(seq)] = (bytes(content or b""), bool(last))
        out, done = [], False
        while expected in early and not done:
            content, done = early.pop(expected)
            made, memory = work(content, done, memory)
            out.append((key[0], expected, made, done))
            expected += 1
        if done:
            state.remove()
        else:
            _bounded(key[0], early)
            state.update((pickle.dumps((memory, expected, early)),))
        yield pd.DataFrame(out, columns=["file", "seq", "content", "last"])

    return pieces.groupBy("file").applyInPandasWithState(step, "file string, seq long, content binary, last boolean", "state binary", "append", "NoTimeout")


def encode_files(pieces: DataFrame, level: int = 6) -> DataFrame:
    """Pieces of files (file, seq, content, last) as pieces of gzip members, fed and finished one after
    another. The state is a window of 32 KiB, a sum and a length, whatever the file's size."""
    def work(content, last, memory):
        before, crc, size = memory or (b"", 0, 0)
        made = (b"" if memory else _GZIP_HEAD) + _packed(content, before, level)
        crc, size = zlib.crc32(content, crc), size + len(content)
        if last:
            made += b"\x03\x00" + struct.pack("<II", crc, size & 0xFFFFFFFF)  # an empty final block, the sum, the length
        return made, ((before + content)[-WINDOW:], crc, size)

    return _coded(pieces, work)


def decode_files(pieces: DataFrame, cap: int = 1 << 30) -> DataFrame:
    """What encode_files made, back to the pieces that it was fed; cap: bytes of a piece at most. A
    wrong sum or length is an error when the last piece comes."""
    def work(content, last, memory):
        before, crc, size = memory or (b"", 0, 0)
        raw = content if memory else content.removeprefix(_GZIP_HEAD)
        made = _unpacked(raw[:-8] if last else raw, before, cap)
        crc, size = zlib.crc32(made, crc), size + len(made)
        if last and struct.unpack("<II", raw[-8:]) != (crc, size & 0xFFFFFFFF):
            raise ValueError("wrong sum or length")
        return made, ((before + made)[-WINDOW:], crc, size)

    return _coded(pieces, work)
