"""Token ids in length-delimited binary record files with a separate offset index.

A record is ``length (u64) | masked checksum of the length (u32) | payload | masked checksum
of the payload (u32)``, little endian. The payload is the document's id (i64) and its token
ids, 2 bytes each where the vocabulary fits, else 4. A checksum is a CRC-32, rotated and
shifted so that checksums of data that holds checksums stay independent. ``part-N.idx``
holds the offset of every record of ``part-N.rec`` and the end, u64 each: any record is one
seek away, so a shard can be read in any order.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.llm.batches import byte_view, keyed, parallelism, slices, texts_of
from keelstone.llm.segments import LOOKUP_BYTES, SegmentTable, per_text
from keelstone.llm.words import lower_ascii, word_bounds

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_NULL_ID = -(1 << 63)

MANIFEST = "shard int, path string, records long, tokens long, bytes long, id_bytes int"


def masked(data: bytes) -> int:
    """The masked checksum of a record part."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record around a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; a damaged record fails."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("cut off record")
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    body = stream.read(length + _TAIL.size)
    if len(body) < length + _TAIL.size or masked(body[:length]) != _TAIL.unpack(body[length:])[0]:
        raise ValueError("damaged record")
    return body[:length]


def _store(path: str):
    """File system and path: shared folders, HDFS and object stores alike."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


# How a file says that case and white space do not count and words end at marks.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
WORD_SPLITTER = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def splits_at_words(file: dict) -> bool:
    """Whether a tokenizer file encodes words, and signs after letters, on their own."""
    splitter = file["pre_tokenizer"] or {}
    first = splitter.get("pretokenizers", [splitter])[0]
    added = [t for t in file["added_tokens"] if not t["content"].startswith("<|") or t["normalized"] or t["lstrip"] or t["rstrip"]]
    return file["normalizer"] == WORD_NORMALIZER and first == WORD_SPLITTER and not added and not file["model"].get("dropout")


class WordEncoder:
    """The tokenizers library over the distinct words of a slice.

    White space and the change from a letter to ``. , ; : ! ?`` always end a token, so
    words and such signs are encoded on their own; capitals followed by ASCII are lowered
    first, as the vocabulary's normaliser does. Slices that hold ``<|`` stay as they are.
    Files that do not say so encode whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_at_words(json.load(file))
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.table = SegmentTable(self._encode)

    def _encode(self, segments: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        texts = segments.to_pylist()
        flat, counts = [], np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 4096):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            for k, coding in enumerate(found, at):
                ids = coding.ids
                counts[k] = len(ids)
                flat.extend(ids)
        return np.array(flat, np.uint32), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts and their ``n + 1`` offsets."""
        if not self.by_words:
            ids, counts = self._encode(texts_of(texts))
            return ids, np.r_[0, np.cumsum(counts)]
        data, ends = byte_view(texts_of(texts))
        if b"<|" not in data.tobytes():
            plain = np.zeros(len(data), bool)
            plain[:-1] = data[1:] < 128
            data = np.where(plain, lower_ascii(data), data)
        solid = (data != 32) & ((data < 9) | (data > 13))
        starts, _, first = word_bounds(data, ends)
        mark = np.zeros(len(data) + 1, bool)
        mark[starts] = True
        letter = (data >= 97) & (data <= 122)
        sign = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
        mark[1:-1] |= letter[:-1] & sign[1:]
        del first
        # Gaps go; bounds and document offsets move with what is left.
        moved = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(solid, out=moved[1:])
        places = np.flatnonzero(mark)
        bounds = moved[places]
        packed = data[solid]
        ids, counts = self.table.ids(packed, np.r_[bounds, len(packed)])
        return ids, per_text(counts, np.searchsorted(places, ends))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The tokenizer of this worker, read once."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_records(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, shards: int | None = None
) -> DataFrame:
    """Encode documents and write them to record files in ascending ``doc_id`` order.

    Returns the manifest, a row per shard, read back from ``folder/manifest``. Texts are
    range-partitioned by key, sorted and encoded in the task that writes the file. A file
    gets its final name when it is complete, so a repeated task replaces what a lost one
    left. A null text is empty; a null key comes first; equal keys stand in the order of
    their texts; an empty table gives an empty manifest. Extra columns are ignored.
    ``folder`` must be one that all executors reach.
    """
    spark = docs.sparkSession
    shards = shards or parallelism(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{shard:06d}", f"{root}/.part-{shard:06d}-{task.taskAttemptId()}"
        coder = encoder(tokenizer_path)
        kind = np.dtype("<u2" if coder.id_bytes == 2 else "<u4")
        end = np.array([] if end_id is None else [end_id], kind)
        offsets, tokens, at, out = array("Q"), 0, 0, None
        for batch in slices(batches, limit=LOOKUP_BYTES):
            out = out or store.open_output_stream(f"{own}.rec", compression=None, buffer_size=1 << 20)
            ids, ends = coder.encode(batch.column("text"))
            ids = ids.astype(kind)
            keys = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for k, key in enumerate(keys.tolist()):
                row = ids[ends[k] : ends[k + 1]]
                record = frame(struct.pack("<q", key) + row.tobytes() + end.tobytes())
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(row) + len(end)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{own}.idx", compression=None) as index:
            offsets.append(at)
            index.write(np.frombuffer(offsets, np.uint64).astype("<u8").tobytes())
        for kind_of in ("idx", "rec"):
            store.move(f"{own}.{kind_of}", f"{name}.{kind_of}")
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "path": [f"{folder}/part-{shard:06d}"],
                "records": pa.array([len(offsets) - 1], pa.int64()),
                "tokens": pa.array([tokens], pa.int64()),
                "bytes": pa.array([at], pa.int64()),
                "id_bytes": pa.array([coder.id_bytes], pa.int32()),
            }
        )

    ranged = keyed(docs, "doc_id", "text").repartitionByRange(shards, "doc_id")
    manifest = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _payload(payload: bytes, id_bytes: int) -> tuple[int | None, np.ndarray]:
    (key,) = struct.unpack_from("<q", payload)
    return (None if key == _NULL_ID else key), np.frombuffer(payload, f"<u{id_bytes}", offset=8)


def _records(path: str, id_bytes: int, seed: int | None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Number, key and ids of a shard's records, in file order or shuffled by the index."""
    store, root = _store(path)
    if seed is None:
        with store.open_input_stream(f"{root}.rec", compression=None, buffer_size=1 << 20) as stream:
            number = 0
            while (payload := read_frame(stream)) is not None:
                yield number, *_payload(payload, id_bytes)
                number += 1
        return
    with store.open_input_file(f"{root}.idx") as index:
        offsets = np.frombuffer(index.read(), "<u8")
    order = np.random.default_rng([seed, zlib.crc32(root.encode())]).permutation(len(offsets) - 1)
    with store.open_input_file(f"{root}.rec") as stream:
        for number in order.tolist():
            stream.seek(int(offsets[number]))
            yield number, *_payload(read_frame(stream), id_bytes)


def _per_shard(manifest: DataFrame):
    """One task per shard, whatever the number of rows a task would take."""
    shards = max(1, manifest.count())
    return manifest.select("shard", "path", "id_bytes").repartition(shards, "shard")


def read_records(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """``shard, record, doc_id, ids`` from the files; with a seed in shuffled order per shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, id_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for number, key, ids in _records(path, id_bytes, seed):
                    rows.append((shard, number, key, ids))
                    held += len(ids)
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        shard, number, key, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(shard, pa.int32()),
                pa.array(number, pa.int64()),
                pa.array(key, pa.int64()),
                pa.array(ids, pa.list_(pa.int32())),
            ],
            names=["shard", "record", "doc_id", "ids"],
        )

    return _per_shard(manifest).mapInArrow(read, "shard int, record long, doc_id long, ids array<int>")


def record_digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read from the files.

    ``start`` counts the ids of all records before it: the shards' totals, a row each, are
    summed in one place, the rest inside the task that reads the shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, id_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, inside = [], 0
                for _, key, ids in _records(path, id_bytes, None):
                    rows.append((shard, key, inside, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    inside += len(ids)
                    if len(rows) >= 8192:
                        yield digests(rows)
                        rows = []
                if rows:
                    yield digests(rows)

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["shard", "doc_id", "_inside", "n_tokens", "ids_crc32"],
        )

    schema = "shard int, doc_id long, _inside long, n_tokens long, ids_crc32 long"
    found = _per_shard(manifest).mapInArrow(read, schema)
    return found.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"
    )
