"""Token ids in binary shards: one zstandard frame for each document, with a dictionary that all of them share.

A shard file is

    magic "TIDS1\\n\\0\\0" | JSON header, padded | dictionary | frames | index | index offset (u64)

The header names the id width, the end id and the SHA-256 of the dictionary;
the index has, for each document in order, its id (i64, and a flag for null),
its frame's offset (u64) and its number of ids (u32). One document is read by
one seek: offset, frame, dictionary.

The dictionary is trained on the serialized ids of at most SAMPLE_DOCS
documents of at most SAMPLE_CHARS each; it changes sizes, never results.

Documents are range-partitioned by doc_id, then by a hash of the text and the
row's number, so that ids that are null or repeated don't fill one partition,
and sorted within a partition; every partition writes one file of its own name
in the shared folder and returns a manifest row with its least and greatest id.
A task that runs again writes another file; only files that the manifest names
are read, so a lost executor costs its tasks only.

Defined results: a null text is empty and has only the end id; a null doc_id
sorts first; rows with one doc_id sort by a hash of the text (equal rows are
equal, so their order doesn't matter); an empty table has no shards; columns
other than the id and the text are not stored, whatever their names; a text of
any length is one frame, encoded whole in memory. The strings of the
vocabulary's added tokens are recognised in a text, as the library does by
default.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallel, scratch, small_batches, written

MAGIC = b"TIDS1\n\0\0"
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 20_000, 32_768
#: Words kept with their ids by each Python worker, in each of two generations.
CACHE_WORDS = 400_000
MANIFEST = "shard int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint, dict_sha256 string, least bigint, most bigint"


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of texts by the tokenizers library: a mapping from pieces to ids that fills itself.

    This vocabulary drops white space and no token crosses it, so the pieces
    between spaces and line ends are encoded once and kept, in two generations
    of CACHE_WORDS. A piece of Latin letters, with or without marks after it,
    needs none of the library's normalizer and splitter but lower case: its
    letters go to the library's model at once. All other pieces take the whole
    way. The strings of added tokens are found in the raw text first, as in the
    library; what stands between two of them is a text of its own.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: The first letter after the Latin ones whose composed and lower-case forms are plain.
    BEYOND = "\u0250"

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tok = Tokenizer.from_file(vocabulary)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.added = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.type = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.packed = struct.Struct("<H" if self.type == "<u2" else "<I").pack
        self.added_ids = {x: self.packed(i) for x, i in added.items()}
        self.model = self.tok.model
        self.visible = _visible_bytes()
        # Only for a pipeline of this kind may letters go to the model at once.
        self.plain = all(x in self.tok.to_str()[:4000] for x in ('"normalizers":[{"type":"NFC"},', '{"type":"Lowercase"}', "|[\\\\p{L}]+|", '"use_regex":false', '"ignore_merges":false'))

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            core = piece.rstrip(self.MARKS)
            if len(core) < len(piece) and core.isalpha() and (core.isascii() or (max(core) < self.BEYOND and core.lower().isalpha())):
                ids = self[core] + self[piece[len(core) :]]
            else:
                ids = self._letters(piece) if self.plain else None
                if ids is None:
                    ids = self._bytes(self.tok.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.packed, ids))

    def _letters(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters, or None if it is another kind of word."""
        if not word.isalpha():
            return None
        low = word.lower()
        if not low.isascii():
            if max(word) >= self.BEYOND or not low.isalpha():
                return None
            low = low.encode().decode("latin-1").translate(self.visible)
        return self._bytes([t.id for t in self.model.tokenize(low)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return [self._text(t) if self.added is None or self.added.search(t) is None else self._parts(t) for t in texts]

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def _parts(self, text: str) -> bytes:
        """A text with the strings of added tokens in it."""
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self._text(text[at : m.start()]), self.added_ids[m[0]]]
            at = m.end()
        return b"".join([*out, self._text(text[at:])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """The shared dictionary, or nothing if there is too little to train on."""
    some = docs.select("text").where(F.length("text").between(1, SAMPLE_CHARS)).limit(SAMPLE_DOCS).collect()
    enc = encoder(vocabulary)
    end = np.array([end_id], enc.type).tobytes()
    samples = [x + end for x in enc.encode([r.text for r in some])]
    if len(samples) < 20 or sum(map(len, samples)) < 2 * DICT_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, vocabulary: str, end_id: int, at: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in ascending doc_id order; return the manifest, written to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    at = at or scratch(spark, "tokens")
    n = parallel(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(train_dictionary(docs, vocabulary, end_id))
    numbered = rows.withColumn("h", F.xxhash64("text")).withColumn("i", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(n, "doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def shards(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        enc, raw = encoder(vocabulary), shared.value
        packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
        end = np.array([end_id], enc.type).tobytes()
        width = np.dtype(enc.type).itemsize
        fs, root = _open(at)
        name = f"shard-{k:06d}-{uuid.uuid4().hex}.tids"
        sha = hashlib.sha256(raw).hexdigest()
        ids, nulls, offsets, sizes, out, pos = [], [], [], [], None, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
                head = json.dumps({"dtype": enc.type, "end_id": end_id, "dict_sha256": sha, "dict_bytes": len(raw)}).encode()
                head += b" " * (-len(head) % 8)
                first = MAGIC + struct.pack("<Q", len(head)) + head + raw
                out.write(first)
                pos = len(first)
            for i in range(0, len(b), 64):
                frames = []
                for x in enc.encode(list(b["text"].iloc[i : i + 64])):
                    x += end
                    f = packed.compress(x)
                    offsets.append(pos)
                    sizes.append(len(x) // width)
                    frames.append(f)
                    pos += len(f)
                out.write(b"".join(frames))
            ids += [0 if pd.isna(x) else int(x) for x in b["doc_id"]]
            nulls += list(b["doc_id"].isna())
        if out is not None:
            index = np.array(ids, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array([*offsets, pos], "<u8").tobytes() + np.array(sizes, "<u4").tobytes()
            out.write(index + struct.pack("<QQ", len(ids), pos))
            out.close()
            known = [i for i, no in zip(ids, nulls, strict=True) if not no]
            ends = [min(known), max(known)] if known else [None, None]
            row = [k, name, len(ids), sum(sizes), pos + len(index) + 16, sha, *ends]
            yield pd.DataFrame([row], columns=[x.split()[0] for x in MANIFEST.split(", ")]).astype({"least": "Int64", "most": "Int64"})

    table = written(dealt.mapInPandas(shards, MANIFEST), "manifest")
    return table.withColumn("path", F.concat(F.lit(at + "/"), "file"))


class Shard:
    """One shard file; documents by position."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - 16)
        n, start = struct.unpack("<QQ", self.file.read(16))
        self.file.seek(0)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no token shard")
        (length,) = struct.unpack("<Q", self.file.read(8))
        self.head = json.loads(self.file.read(length))
        raw = self.file.read(self.head["dict_bytes"])
        if hashlib.sha256(raw).hexdigest() != self.head["dict_sha256"]:
            raise ValueError(f"{path}: its dictionary is another one than its header names")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        self.file.seek(start)
        index = self.file.read(size - 16 - start)
        self.ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.sizes = np.frombuffer(index, "<u4", n, 9 * n + 8 * (n + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def get(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        self.file.seek(a)
        return np.frombuffer(self.unpack.decompress(self.file.read(b - a)), self.head["dtype"])

    def all(self, step: int = 1 << 22):
        """Each document's ids in order, reading the frames in large pieces."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + np.uint64(step))) - 1)
            self.file.seek(int(self.offsets[i]))
            piece = memoryview(self.file.read(int(self.offsets[j] - self.offsets[i])))
            o = (self.offsets[i : j + 1] - self.offsets[i]).astype(int)
            for k in range(j - i):
                yield np.frombuffer(self.unpack.decompress(piece[o[k] : o[k + 1]]), self.head["dtype"])
            i = j


def find_document(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """Ids of one document (the first of that id): the manifest tells which shards may hold it, their index where."""
    for r in manifest.where(F.lit(doc_id).between(F.col("least"), F.col("most"))).orderBy("shard").select("path").toLocalIterator():
        s = Shard(r.path)
        hit = np.flatnonzero((s.ids == doc_id) & (s.nulls == 0))
        if len(hit):
            return s.get(int(hit[0]))
    return None


def read_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))

    def rows(batches):
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                s = Shard(path)
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in s.all()]
                n = s.sizes.astype("int64")
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(s.nulls, 0, s.ids), "Int64").copy(), "start": start + np.concatenate([[0], np.cumsum(n)[:-1]]).astype("int64"),
                    "n_tokens": n, "ids_crc32": np.array(crcs, "int64"),
                }).assign(doc_id=lambda d, s=s: d["doc_id"].mask(s.nulls.astype(bool)))

    return files.repartition(parallel(spark), "shard").mapInPandas(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
