"""Operator 8: token ids as seekable zstandard files.

Every document becomes one independent zstandard frame (with its own content
checksum) holding its ids as little-endian unsigned 32-bit integers.  A file
ends with two skippable frames of the public seekable format: one with the
document ids (our own magic variant 0), then the seek table with compressed
size, decompressed size and the low 32 bits of XXH64 for each frame.  A reader
fetches the tail, looks a document up and decompresses only its frame.

Spark deals the documents into ranges of ascending ``doc_id`` (one file per
range); tasks write through ``pyarrow.fs`` under a name of their own and rename,
so a repeated or lost task leaves a whole file or none.

Defined results: a null text is an empty one (only the end id); null doc_ids
come first; rows that repeat a doc_id are ordered by text and each gets its own
frame; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.llm.common import slices, table, utf8_values
from stockroom.session import ScratchTable, ensure_checkpoint_dir

# Fixed values of the public zstandard seekable format.
SEEK_TABLE_FRAME = 0x184D2A5E
SEEK_TABLE_FOOTER = 0x8F92EAB1
DOC_ID_FRAME = 0x184D2A50
CHECKSUM_FLAG = 0x80

END_ID = 2
NO_DOC_ID = -(2**63)  # stands for a null doc_id inside a file
TOKENIZER = "word_bpe_49k.json"
TEXT_BYTES = 300_000  # text whose pieces are looked up together
CACHED_PIECES = 120_000  # entries of a cache generation; bounds a worker's memory only

# Fixed values of the tokenizer: its pre-token pattern as it applies to lower-case text of ASCII and Latin-1 letters
# (two bytes each in UTF-8), 's|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+, as kinds of bytes,
# its mark of a pre-token's end, and the characters that its byte-level step writes for bytes.
SPACE, DIGIT, LETTER, SIGN, WHOLE = range(5)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[list(b" \t\n\v\f\r")] = SPACE
KINDS[list(b"0123456789")] = DIGIT
KINDS[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = LETTER
LATIN_BYTES = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
NOT_LETTERS = ("\u00d7".encode(), "\u00f7".encode())
WORD_END = "</w>"
KEPT_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in KEPT_BYTES)}


def lowered(text: bytes) -> bytes | None:
    """The text in lower case if ``pre_tokens`` surely finds its pre-tokens, else none."""

    if b"<|" in text:  # could be a special token
        return None
    if text.isascii():
        return text.lower()
    if text.translate(None, LATIN_BYTES) or any(sign in text for sign in NOT_LETTERS):
        return None
    try:
        return text.decode().lower().encode()
    except UnicodeDecodeError:
        return None


def pre_tokens(text: bytes, whole: list[tuple[int, int]]) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of lower-case text and where each begins; every span in ``whole``, white space around it, is one."""

    chars = np.frombuffer(text + b"   ", np.uint8)  # a contraction has at most two bytes behind its apostrophe
    kinds = KINDS[chars]
    for begin, end in whole:
        kinds[begin:end] = WHOLE
    first = kinds == DIGIT
    first[0] = True
    first[1:] |= kinds[1:] != kinds[:-1]
    # A contraction begins where a run of signs would, takes its letters, and what follows begins anew.
    marks = np.flatnonzero(first & (chars == ord("'")) & (kinds == SIGN))
    after, second = chars[marks + 1], chars[marks + 2]
    one = np.isin(after, list(b"stmd"))
    two = (np.isin(after, list(b"rv")) & (second == ord("e"))) | ((after == ord("l")) & (second == ord("l")))
    first[marks[one | two] + 1] = False
    first[marks[one] + 2] = True
    first[marks[two] + 3] = True
    kept = kinds != SPACE
    first &= kept
    data = chars[kept]
    offsets = np.append(np.flatnonzero(first[kept]), len(data)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return tokens, np.flatnonzero(first)


class Encoder:
    """Text -> packed ids.  The tokenizer drops white space and never merges across
    it, so a text's ids are those of its white-space separated pieces in order, and a
    piece's those of its pre-tokens.  Texts of ASCII and Latin-1 letters are cut into
    lower-case pre-tokens at once; of the others, each piece that isn't such a text
    goes through the whole tokenizer.  Pre-tokens and those pieces repeat a lot and are
    kept in a bounded cache; only the distinct ones of a run of texts become Python objects."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merges = Tokenizer(self.tokenizer.model)  # for what is lower-case and cut already
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.word_end[[number for token, number in tokens.items() if token.endswith(WORD_END)]] = True
        # Two generations: when the young one is full it becomes the old one, so
        # entries in use move on and the others go.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def keep(self, keys: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """Packed ids of every key, which are in ``young`` afterwards; those that neither generation has are encoded now."""

        packed = list(map(self.young.get, keys))
        absent = [i for i, ids in enumerate(packed) if ids is None]
        found = {keys[i]: self.old.get(keys[i]) for i in absent}
        new = [key for key, ids in found.items() if ids is None]
        self.young |= found | dict(zip(new, encode(new), strict=True))
        for i in absent:
            packed[i] = self.young[keys[i]]
        return packed

    def encode_pre_tokens(self, parts: list[bytes]) -> list[bytes]:
        """Of lower-case pre-tokens: only the merges are left to do."""

        if not parts:
            return []
        text = " ".join([part.decode("latin-1") for part in parts])
        for sign in (set(text) & BYTE_LETTERS.keys()) - {" "}:
            text = text.replace(sign, BYTE_LETTERS[sign])
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.word_end[ids]) + 1) * 4
        if len(stops) != len(parts):
            raise ValueError("the tokenizer cut a pre-token")
        packed, bounds = ids.tobytes(), [0, *stops.tolist()]
        return [packed[begin:end] for begin, end in zip(bounds, bounds[1:], strict=False)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([piece.decode("utf-8", "replace") for piece in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def payloads(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text."""

        stream: list[bytes] = []  # pieces and whole texts in lower case, white space between them
        begins, length = [], 0  # where each text begins in the stream
        whole: list[tuple[int, int]] = []  # spans of the pieces that the whole tokenizer takes
        pieces: set[bytes] = set()
        for text in utf8_values(texts):
            begins.append(length)
            plain = lowered(text or b"")
            for piece in text.split() if plain is None else [text]:  # bytes: at ASCII white space only
                part = lowered(piece) if plain is None else plain
                if part is None:
                    part = piece
                    whole.append((length, length + len(part)))
                    pieces.add(part)
                stream.append(part)
                length += len(part) + 1
        tokens, at = pre_tokens(b"\n".join(stream), whole)
        coded = tokens.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()  # cut here: to_pylist takes some four times as long
        cuts, letters = np.frombuffer(offsets, np.int32, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
        distinct = [letters[begin:end] for begin, end in zip(cuts, cuts[1:], strict=False)]
        if len(self.young) > CACHED_PIECES:
            self.old, self.young = self.young, {}
        self.keep(list(pieces), self.encode_pieces)
        packed = self.keep(distinct, self.encode_pre_tokens)
        # The ids of all tokens in order: those of token i are n[i] of ``known`` from offset[its code] on.
        known = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        stops = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - stops[:-1], n)
        places += np.arange(len(places))
        ids = known[places].tobytes()
        bounds = (stops[np.searchsorted(at, [*begins, length])] * 4).tolist()
        return [ids[begin:end] for begin, end in zip(bounds, bounds[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class SeekableWriter:
    """Appends frames to a stream and closes it with the document ids and the seek table."""

    def __init__(self, stream, level: int = 1):
        self.stream, self.entries, self.doc_ids = stream, [], []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, payload: bytes) -> None:
        frame = self.compressor.compress(payload)
        self.stream.write(frame)
        self.entries.append((len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
        self.doc_ids.append(NO_DOC_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        ids = np.array(self.doc_ids, "<i8").tobytes()
        self.stream.write(struct.pack("<II", DOC_ID_FRAME, len(ids)) + ids)
        entries = [*self.entries, (len(ids) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = np.array(entries, "<u4").tobytes()
        footer = struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEK_TABLE_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_TABLE_FRAME, len(body) + len(footer)) + body + footer)


class SeekableReader:
    """Random access to one file: reads the tail first, then only the frames asked for."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_TABLE_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable zstandard file with checksums")
        table_bytes = 12 * count
        stream.seek(size - 9 - table_bytes - 8)
        head, length = struct.unpack("<II", stream.read(8))
        if head != SEEK_TABLE_FRAME or length != table_bytes + 9:
            raise ValueError("broken seek table")
        entries = np.frombuffer(stream.read(table_bytes), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.sizes, self.checksums = entries[:-1, 1], entries[:-1, 2]
        stream.seek(int(self.offsets[-2]))
        head, length = struct.unpack("<II", stream.read(8))
        if head != DOC_ID_FRAME or length != entries[-1, 0] - 8:
            raise ValueError("broken document ids")
        self.doc_ids = np.frombuffer(stream.read(length), "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def payload(self, index: int) -> bytes:
        self.stream.seek(int(self.offsets[index]))
        data = self.decompressor.decompress(self.stream.read(int(self.offsets[index + 1] - self.offsets[index])))
        if len(data) != self.sizes[index] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksums[index]:
            raise ValueError(f"frame {index} fails its checksum")
        return data

    def documents(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this doc_id, decompressing no other frame."""

        wanted = NO_DOC_ID if doc_id is None else doc_id
        return [np.frombuffer(self.payload(int(i)), "<u4") for i in np.flatnonzero(self.doc_ids == wanted)]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace(":/", ":///", 1))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write one file per range of ascending doc_id; returns (part, path, n_docs, n_ids), a row per file.

    Lazy: the files are written when the returned frame is computed.
    """

    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        final, own = f"{root}/part-{part:06d}.ids.zst", f"{root}/.part-{part:06d}.{uuid.uuid4().hex}"
        encode, writer, n_ids = encoder(tokenizer_path), None, 0
        stream = None
        for batch in batches:
            if writer is None and batch.num_rows:
                stream = fs.open_output_stream(own, compression=None)
                writer = SeekableWriter(stream)
            for rows in slices(batch, 1, TEXT_BYTES):
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode.payloads(rows.column(1)), strict=True):
                    payload = ids + end
                    writer.add(doc_id, payload)
                    n_ids += len(payload) // 4
        if writer is not None:
            writer.finish()
            stream.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [final], "n_docs": [len(writer.doc_ids)], "n_ids": [n_ids]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(write, "part int, path string, n_docs long, n_ids long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, part, frame.

    ``files`` is what ``write_token_files`` returned (a row per file; the running
    sum over it is the only ordered step).  Each task opens the files it is given
    and walks their frames one by one.
    """

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("frame", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = filesystem(folder)[0]
        for batch in batches:
            for part, path, start in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "start")), strict=True):
                with fs.open_input_file(path) as stream:
                    reader, rows = SeekableReader(stream, stream.size()), []
                    for frame, doc_id in enumerate(reader.doc_ids.tolist()):
                        payload = reader.payload(frame)
                        rows.append((None if doc_id == NO_DOC_ID else doc_id, start, len(payload) // 4, zlib.crc32(payload), part, frame))
                        start += len(payload) // 4
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # an explicit count: the few, small rows of files would otherwise be merged into one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    return files.withColumn("start", before).select("part", "path", "start").repartition(tasks, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, frame int")


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder under the shared checkpoint folder and return the read-back digests."""

    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"
    files = ScratchTable(write_token_files(docs, folder, public_tokenizers.path(tokenizer), end_id), "token-files")
    return read_token_files(files.df, folder)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
