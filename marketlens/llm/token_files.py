"""Token files: seekable zstandard shards, one independent frame a document.

Layout of a shard (little-endian): frame 0 holds the index (magic, range partition, shard
number in it, bytes an id, number of documents, their ids and null marks); each further
frame holds one document's token ids, end id included; the trailing skippable frame is the
public zstandard seek table with the compressed size, the decompressed size and the low 32
bits of xxh64 of every frame. A reader fetches the table from the end of the file and
decompresses only the frames that it wants. Shards follow one another in ascending
``doc_id``: by range partition, then by number.

Spark's own writer commits one file a shard row, so any file system, retries and lost
executors are handled as for other sinks. It ends a row with a separator of at least one
byte; the separator set here is the last byte of the table's magic number.

Edge cases: a null text counts as empty and yields the end id alone. Rows without
``doc_id`` come first, repeated ids in the order of the hash of their texts. Other columns
are ignored. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import new_folder, partitions, stored
from marketlens.llm.text import LOWER, per_worker, ragged, slices, utf8

MAGIC = b"MLTOKEN1"
HEAD = "<8siiii"
HEAD_SIZE = struct.calcsize(HEAD)
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
TAIL = b"\x8f"  # last byte of SEEKABLE, written as the row separator
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 50_000
CACHE = 400_000  # pieces whose ids a worker remembers
SLICE = 4_000_000
# fixed value: the pattern of the tokenizer that is cut into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def frame(data: bytes, level: int = 3) -> tuple[bytes, bytes]:
    """A compressed frame and its entry in the seek table."""
    import xxhash
    import zstandard

    packed = zstandard.ZstdCompressor(level=level).compress(data)
    check = xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
    return packed, struct.pack("<III", len(packed), len(data), check)


def shard_bytes(part: int, number: int, docs: list[tuple[int | None, bytes]], width: int) -> bytes:
    """A whole shard file from (doc_id, token bytes)."""
    ids = np.array([i or 0 for i, _ in docs], "<i8").tobytes()
    nulls = bytes(i is None for i, _ in docs)
    head = struct.pack(HEAD, MAGIC, part, number, width, len(docs)) + ids + nulls
    frames = [frame(head), *(frame(tokens) for _, tokens in docs)]
    entries = b"".join(e for _, e in frames)
    foot = struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    table = struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot
    return b"".join(p for p, _ in frames) + table


class Shard:
    """Random access to a shard held in bytes or in any buffer."""

    def __init__(self, content: bytes) -> None:
        self.content = memoryview(content)
        count, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        table = np.frombuffer(self.content[-9 - 12 * count:-9], "<u4").reshape(count, 3)
        self.sizes, self.checks = table[:, 1], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        head = self._frame(0)
        mark, self.part, self.number, self.width, n = struct.unpack(HEAD, head[:HEAD_SIZE])
        if mark != MAGIC or n != count - 1:
            raise ValueError("not a token shard")
        ids = np.frombuffer(head, "<i8", n, HEAD_SIZE)
        nulls = head[HEAD_SIZE + 8 * n:]
        self.doc_ids = [None if nulls[k] else int(ids[k]) for k in range(n)]

    def _frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed = self.content[self.starts[k]:self.starts[k + 1]]
        data = zstandard.ZstdDecompressor().decompress(packed, int(self.sizes[k]) or 1)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document; no other frame is decompressed."""
        return np.frombuffer(self._frame(k + 1), f"<u{self.width}").astype(np.uint32)


def _byte_kinds() -> np.ndarray:
    """Blank 0, letter 1, digit 2, sign 3 for ASCII; 4 for apostrophe, control and other."""
    kind = np.full(256, 4, np.uint8)
    kind[0x21:0x7F] = 3
    kind[0x30:0x3A] = 2
    kind[0x41:0x5B] = kind[0x61:0x7B] = 1
    kind[0x27] = 4
    kind[[0x09, 0x0A, 0x0D, 0x20]] = 0
    return kind


class Encoder:
    """Token ids of texts by the tokenizers library, each distinct piece encoded once.

    A tokenizer that drops white space, lower-cases and takes letters, single digits and
    signs apart is given pieces: its tokens never go across a blank, nor from an ASCII
    letter, digit or sign to one of another kind, nor between digits (an apostrophe may open
    a contraction, so nothing is cut beside one, nor beside other characters). The ids of a
    text are those of its pieces. Texts with a special string, and all texts of any other
    tokenizer, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        patterns = [s["pattern"].get("Regex") for s in
                    (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
                    if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        lowers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_piece = lowers == ["NFC", "Replace", "Lowercase"] and patterns == [PIECES]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kinds = _byte_kinds()
        self.kind_bytes = self.kinds.tobytes()
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [e.ids for e in got]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode(texts)
        return (np.array([i for own in ids for i in own], np.uint32),
                np.array([len(own) for own in ids], np.int64))

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of one piece by the library's own stages.

        A run of ASCII letters or signs comes out of the first two stages as it is.
        """
        text = piece.decode()
        model, kinds = self.tokenizer.model, set(piece.translate(self.kind_bytes))
        parts = [text] if len(kinds) == 1 and kinds <= {1, 3} else [
            mapped for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(
                self.tokenizer.normalizer.normalize_str(text))]
        return [token.id for part in parts for token in model.tokenize(part)]

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces in the tables; unknown ones are encoded and entered."""
        at = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        ids = [self._piece(pieces[k]) for k in missing]
        n, room = len(self.known), len(missing)
        at[missing] = np.arange(n, n + room)
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.array([i for own in ids for i in own], np.uint32)
        for name, need in (("start", n + room), ("size", n + room), ("flat", self.used + len(flat))):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        self.size[n:n + room] = size
        self.start[n:n + room] = self.used + np.cumsum(size) - size
        self.flat[self.used:self.used + len(flat)] = flat
        keep = min(room, max(0, CACHE - n))  # what is past the limit is overwritten next time
        self.known.update(zip([pieces[k] for k in missing[:keep]], range(n, n + keep)))
        self.used += int(size[:keep].sum())
        return at

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = utf8(texts)
        kind = self.kinds[data]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        own, last = kind * (kind < 4), before * (before < 4)
        cut = ((own > 0) & (last > 0) & ((own != last) | (own == 2))) | (before == 0)
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        solid = kind > 0
        cut &= solid
        row = np.searchsorted(np.flatnonzero(cut), bounds)  # pieces before each text
        kept = LOWER[data[solid]]
        offsets = np.append(np.flatnonzero(cut[solid]), len(kept)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
            None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[
            coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[ragged(self.start[place], size)], np.diff(ends[row])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and the number of ids of each row."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_piece:
            return self.whole(texts.to_pylist())
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.pieces(texts)
        parts = [self.whole([texts[k].as_py()]) if marked[k] else self.pieces(texts.slice(k, 1))
                 for k in range(len(texts))]
        return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def _packer(path: str, end_id: int, shard_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker(("encoder", path), lambda: Encoder(path))
        part, number = TaskContext.get().partitionId(), 0
        docs: list[tuple[int | None, bytes]] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            content = shard_bytes(part, number, docs, encoder.width)
            return pa.record_batch([pa.array([content[:-1]], pa.binary())], ["content"])

        for batch in batches:
            _, bounds = utf8(batch.column("text"))
            for lo, hi in slices(bounds, SLICE):
                ids, size = encoder.batch(batch.column("text").slice(lo, hi - lo))
                ends = np.cumsum(size)
                for k, doc_id in enumerate(batch.column("doc_id").slice(lo, hi - lo).to_pylist()):
                    own = np.append(ids[ends[k] - size[k]:ends[k]], end_id)
                    docs.append((doc_id, own.astype(f"<u{encoder.width}").tobytes()))
                    tokens += len(own)
                    if tokens >= shard_tokens or len(docs) >= SHARD_DOCS:
                        yield close()
                        docs, tokens, number = [], 0, number + 1
        if docs:
            yield close()

    return pack


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, write shards in ascending ``doc_id``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.length("text")]
    packed = (rows.repartitionByRange(partitions(docs.sparkSession), *order)
              .sortWithinPartitions(*order)
              .mapInArrow(_packer(tokenizer, end_id, shard_tokens), "content binary"))
    (packed.select(F.col("content").cast("string").alias("value")).write
     .option("lineSep", TAIL.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", 1).option("compression", "none").text(folder))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            shard = Shard(content.as_buffer())
            n, crc = [], []
            for k in range(len(shard.doc_ids)):
                ids = shard.tokens(k)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            size = np.array(n, np.int64)
            yield pa.record_batch({
                "part": pa.array([shard.part] * len(n), pa.int64()),
                "number": pa.array([shard.number] * len(n), pa.int64()),
                "ordinal": pa.array(range(len(n)), pa.int64()),
                "doc_id": pa.array(shard.doc_ids, pa.int64()),
                "before": pa.array(np.cumsum(size) - size), "n_tokens": pa.array(size),
                "ids_crc32": pa.array(crc, pa.int64())})


SCHEMA = ("part long, number long, ordinal long, doc_id long, before long, n_tokens long, "
          "ids_crc32 long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = stored(files.mapInArrow(_reader, SCHEMA), "token-index")
    # one row a shard of millions of tokens
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
             .withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0).cast("long"))))
    return rows.join(bases, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of the wanted documents; only their frames are decompressed."""
    wanted = set(doc_ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer())
                at = [k for k, i in enumerate(shard.doc_ids) if i in wanted]
                yield pa.record_batch({
                    "doc_id": pa.array([shard.doc_ids[k] for k in at], pa.int64()),
                    "ids": pa.array([shard.tokens(k).astype(np.int64) for k in at],
                                    pa.list_(pa.int64()))})

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(pick, "doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return their index."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write(docs, folder, tokenizer, end_id)
    return read_index(spark, folder)
