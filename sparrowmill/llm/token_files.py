"""Token-id output: Arrow IPC files of equal-length sequences and masks.

The ids of all documents, in ascending ``doc_id`` order, run through the files of consecutive
blocks.  A file holds record batches of two fixed-size-list columns, ``input_ids`` (16 or 32
bits an id) and ``mask`` (a bit an id, false for the padding at a file's end), so a memory-mapped
file gives any sequence without a copy.  Beside it lies an index file: the documents of the
block, where each begins in the file, and its token count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..scratch import new_dir, shuffle_partitions, written
from ._arrow import batches_of, fields, text_slices
from .blocks import bounds

SEQUENCE = 1024
#: Sequences of one record batch.
BATCH = 512
#: A file is closed after so many tokens, and its block goes on in another.
FILE_TOKENS = 1 << 24
#: A worker keeps the ids of this many distinct units at most, in two halves.
CACHE_UNITS = 2_000_000
_WORKERS: dict[str, "ByteBPE"] = {}
class ByteBPE:
    """Encoder of a byte-level vocabulary of the tokenizers library, one per worker process.

    A single space between characters that are not white space always begins a piece of the
    library's splitting, and so does the character after a lone line feed.  Texts are cut there
    into units; the library encodes the distinct new units of a batch in one call, in which ids
    of tokens with a leading space (or the line feed's id) show where each unit begins.  Texts
    with other white space, or with a special token's spelling, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size(True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.line_feed = self._ids("\n")
        self.fed = np.arange(size) == self.line_feed[0]
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, units: list[str], mark: str, begins: np.ndarray) -> None:
        """Encode units in one text, each behind ``mark``; ``begins`` tells whose ids show a mark."""
        for a in range(0, len(units), 20_000):
            some = units[a : a + 20_000]
            ids = self._ids(mark + mark.join(some))
            at = (np.flatnonzero(begins[ids]) * ids.itemsize).tolist()
            raw = ids.tobytes()
            for unit, x, y in zip(some, at, [*at[1:], len(raw)], strict=True):
                self.units[unit if mark == " " else mark + unit] = raw[x:y]

    def _ready(self, units: set[str]) -> None:
        new = units.difference(self.units)
        if len(self.units) + len(new) > CACHE_UNITS // 2:
            self.older, self.units, new = self.units, {}, units
        old = self.older
        self.units.update([(u, old[u]) for u in new if u in old])
        new = [u for u in new if u not in old]
        self._learn([u for u in new if u[0] != "\n"], " ", self.spaced)
        self._learn([u[1:] for u in new if u[0] == "\n"], "\n", self.fed)

    def forget(self) -> None:
        """Drop all units: the worker lives on in stages that need the memory."""
        self.units, self.older = {}, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text, as little-endian integers of ``kind``.

        Texts are split, and their units told apart, in arrays; Python sees each distinct unit of a
        batch once, and the ids of a text are gathered from those of its units.
        """
        for begin, end in batches_of(texts, 1 << 24):
            some = texts[begin:end]
            plain = [i for i, t in enumerate(some) if self._plain(t)]
            # a line feed before the first unit, whose id is left out again below
            lists = pc.split_pattern(pa.array(["\n" + some[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            units, at, place = coded.dictionary.to_pylist(), lists.offsets.to_numpy(), coded.indices.to_numpy()
            odd = [k for k, u in enumerate(units) if u in ("", "\n")]  # white space that isn't single
            spoilt = set(np.searchsorted(at, np.flatnonzero(np.isin(place, odd)), side="right").tolist()) if odd else ()
            self._ready({u for u in units if u not in ("", "\n")})
            held = [self.units.get(u, b"") for u in units]
            ends = np.cumsum([0, *map(len, held)]) // self.kind.itemsize
            ids = np.frombuffer(b"".join(held), self.kind)
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)).take(coded.indices)
            flat = each.flatten().to_numpy()
            sizes = np.concatenate(([0], np.cumsum(np.diff(ends)[place])))[at]
            found = {i: flat[a + 1 : b] for k, (i, a, b) in enumerate(zip(plain, sizes[:-1].tolist(), sizes[1:].tolist(), strict=True), 1) if k not in spoilt}
            for i, text in enumerate(some):
                yield (found[i] if i in found else self._ids(text)).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether a text has no white space but spaces and line feeds, and spells no special token."""
        plain = text.replace("\n", "").isprintable() or text.split() == text.replace("\n", " ").split(" ")
        return plain and not any(s in text for s in self.special)


def byte_encoder(path: str) -> ByteBPE:
    """The encoder of this process for a vocabulary file."""
    if path not in _WORKERS:
        _WORKERS[path] = ByteBPE(path)
    return _WORKERS[path]


def forget_units() -> None:
    """Let this process's encoders drop their units."""
    for coder in _WORKERS.values():
        coder.forget()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class TokenWriter:
    """Writes one file of sequences and masks, a record batch at a time."""

    def __init__(self, sink, kind: np.dtype, sequence: int = SEQUENCE):
        self.kind, self.sequence = kind, sequence
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema({"input_ids": pa.list_(value, sequence), "mask": pa.list_(pa.bool_(), sequence)})
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        self.tokens += len(raw) // self.kind.itemsize
        full = self.sequence * BATCH * self.kind.itemsize
        if self.size >= full:
            data = b"".join(self.held)
            cut = len(data) // full * full
            for at in range(0, cut, full):
                self._batch(np.frombuffer(data, self.kind, full // self.kind.itemsize, at), full // self.kind.itemsize)
            self.held, self.size = [data[cut:]], len(data) - cut

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.kind)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.sequence) * self.sequence, self.kind)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        self.file.close()


def sequences(source: pa.NativeFile, begin: int, end: int) -> Iterator[np.ndarray]:
    """Ids ``begin`` to ``end`` of a file, by random access: of the record batches that hold them, and
    no others, each a view of the file's memory, without a copy if it is mapped."""
    reader = pa.ipc.open_file(source)
    wide = reader.schema.field("input_ids").type.list_size * BATCH
    for i in range(begin // wide, -(-end // wide)):
        ids = reader.get_batch(i).column("input_ids").flatten().to_numpy()
        yield ids[max(0, begin - i * wide) : end - i * wide]


def file_ids(source: pa.NativeFile) -> np.ndarray:
    """All unpadded ids of a file at once, for small files; padding is at a file's end only."""
    reader = pa.ipc.open_file(source)
    last = reader.num_record_batches - 1
    if last < 0:
        return np.zeros(0, reader.schema.field("input_ids").type.value_type.to_pandas_dtype())
    wide = reader.schema.field("input_ids").type.list_size * BATCH
    real = last * wide + int(reader.get_batch(last).column("mask").flatten().to_numpy(zero_copy_only=False).sum())
    return np.concatenate(list(sequences(source, 0, real)))


def checksums(source: pa.NativeFile, counts: list[int]) -> list[int]:
    """crc32 of each document's ids as 32-bit integers, documents end to end; a batch at a time."""
    out, crc, left, todo = [], 0, 0, iter(counts)
    left = next(todo, None)
    for ids in sequences(source, 0, sum(counts)):
        at = 0
        while left is not None and at + left <= len(ids):
            out.append(zlib.crc32(ids[at : at + left].astype("<u4").tobytes(), crc))
            at, crc, left = at + left, 0, next(todo, None)
        if left is not None:
            crc = zlib.crc32(ids[at:].astype("<u4").tobytes(), crc)
            left -= len(ids) - at
    return out


ENCODED = fields(block=T.IntegerType(), doc_id=T.LongType(), raw=T.BinaryType())
MANIFEST = fields(block=T.IntegerType(), part=T.IntegerType(), path=T.StringType(), index=T.StringType(), n_docs=T.LongType(), n_tokens=T.LongType(), bits=T.IntegerType())
READ = fields(doc_id=T.LongType(), start=T.LongType(), n_tokens=T.LongType(), ids_crc32=T.LongType())


def write_token_files(docs: DataFrame, path: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Encode ``docs``, write the files, and return their manifest in block order.

    A null text counts as empty and gives ``end_id`` alone; rows of equal id stand in the order
    of their compressed ids, which is the same on each run; null ids come first.  A block's ids run on through files of a bounded size.  A task that is lost is run again and writes new
    files, and only files that the manifest names count.
    """
    spark = docs.sparkSession
    edges = np.array(bounds(docs), np.int64)
    where = new_dir(spark, "tokens")

    def encode(batches):
        coder = byte_encoder(path)
        end, pack = np.array([end_id], coder.kind).tobytes(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, texts in text_slices(batch, 1 << 24):
                ids = part.column("doc_id").cast(pa.int64())
                block = np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32)
                block[ids.is_null().to_numpy(zero_copy_only=False)] = 0
                raw = [pack.compress(x + end) for x in coder.encode([t.decode() for t in texts])]
                yield pa.RecordBatch.from_arrays([pa.array(block), ids, pa.array(raw, pa.binary())], names=ENCODED.names)

    def write(batches):
        coder, unpack = byte_encoder(path), zstandard.ZstdDecompressor()
        coder.forget()
        now, part, writer, sink, rows = None, 0, None, None, []

        def done():
            writer.close()
            sink.close()
            table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "begin": pa.array([r[1] for r in rows], pa.int64()), "n_tokens": pa.array([r[2] for r in rows], pa.int64())})
            with fs.open_output_stream(f"{base}.docs.arrow") as out, pa.ipc.new_file(out, table.schema) as file:
                file.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([x], f) for x, f in ((now, pa.int32()), (part, pa.int32()), (f"{name}.arrow", pa.string()), (f"{name}.docs.arrow", pa.string()), (len(rows), pa.int64()), (writer.tokens, pa.int64()), (8 * coder.kind.itemsize, pa.int32()))], names=MANIFEST.names)

        for batch in batches:
            for block, doc, raw in zip(*[batch.column(c).to_pylist() for c in ENCODED.names], strict=True):
                if block != now or writer.tokens >= FILE_TOKENS:
                    if now is not None:
                        yield done()
                    now, part, rows = block, part + 1 if block == now else 0, []
                    name = f"{where}/block-{block:06d}-{uuid.uuid4().hex[:12]}"
                    fs, base = _place(name)
                    fs.create_dir(base.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(f"{base}.arrow")
                    writer = TokenWriter(sink, coder.kind, sequence)
                raw = unpack.decompress(raw)
                rows.append((doc, writer.tokens, len(raw) // coder.kind.itemsize))
                writer.add(raw)
        if now is not None:
            yield done()

    dealt = docs.select("doc_id", "text").mapInArrow(encode, ENCODED).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "raw")
    manifest = written(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    # a row for each file: a window over them in one task is small
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: where its ids begin among all, their count and crc32."""

    def read(batches):
        forget_units()
        for batch in batches:
            for file, index, start in zip(*[batch.column(c).to_pylist() for c in ("path", "index", "start")], strict=True):
                fs, base = _place(file)
                _, docs = _place(index)
                with fs.open_input_file(docs) as source:
                    table = pa.ipc.open_file(source).read_all()
                local = isinstance(fs, pafs.LocalFileSystem)
                with pa.memory_map(base) if local else fs.open_input_file(base) as source:
                    begin, count = table["begin"].to_numpy(), table["n_tokens"].to_numpy()
                    crc = checksums(source, count.tolist())
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(begin + start), pa.array(count), pa.array(crc, pa.int64())], names=READ.names)

    files = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path")
    return files.select("path", "index", "start").mapInArrow(read, READ)


def token_files(docs: DataFrame, path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Write the token files of ``docs`` and read them back, a row for each row of ``docs``."""
    return read_token_files(write_token_files(docs, path, end_id, sequence))


