"""Token ids in flat files of unsigned integers, with 64-bit document offsets, to be memory-mapped by training.

Documents are dealt by ranges of ``doc_id``; the task of a range encodes its documents in order and appends their ids to
files of its own. A file ``x.bin`` is nothing but ids, little-endian, of two bytes where the vocabulary has at most 65,536
entries and of four otherwise. ``x.idx`` has a header of 32 bytes (magic, bytes of an id, documents without a doc_id, documents),
the doc_ids (int64; those without one come first and have 0) and one more offset than documents (uint64, in ids from the
start of ``x.bin``). The manifest, a Parquet table of one row a file, has each file's first position among all ids: the
prefix sum of the ids of the files before it.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.llm.token_count import SPLIT, byte_letters
from sylva.runtime import materialize, scratch_path, ship_package

MAGIC, HEADER = b"sylvatok", "<8sQQQ"
#: Bytes of ids after which a task begins another file; pre-tokens, and chunks of them, whose ids a worker remembers.
FILE_BYTES, REMEMBERED = 256 << 20, 1_000_000
_MARKS = tuple(".,;:!?")
_MANIFEST = T.StructType([T.StructField(c, T.StringType() if c == "path" else T.LongType()) for c in ("part", "seq", "path", "docs", "tokens")])
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenFileError(ValueError):
    """A file that isn't what its header or the manifest says."""


class _Memo(dict):
    """A dict that works out what it doesn't have, and forgets all when it is full."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[key] = self.find(key)
        return value


class Encoder:
    """The tokenizers library's ids of texts as little-endian bytes, each different pre-token encoded once while remembered.

    A text is cut before spaces. That never parts a pre-token of the byte-level pattern unless such a space has white space
    before it and none but white space after it; texts with one are cut by the pattern at once. What stands between two
    cuts is cut by the pattern when it is met for the first time (letters alone, or with one mark after them, need no
    pattern), and its pre-tokens go through the library's model. So the ids of a text are those of its pre-tokens in a row,
    which tests hold against the library on whole texts. Vocabularies of another kind go through the library whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        model = json.loads(definition)
        cut = model.get("pre_tokenizer") or {}
        self.by_pieces = (
            model["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and not model.get("normalizer") and not model.get("post_processor") and sys.byteorder == "little"
        )
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.inner_space, self.pattern = re.compile(r"\s (?!\S)"), regex.compile(SPLIT)
        self.letters = str.maketrans({chr(b): x for b, x in byte_letters().items()})
        self.model, self.space = self.library.model, byte_letters()[32]
        self.pieces = _Memo(self._piece)
        self.chunks = _Memo(self._chunk)  # without the space before them

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                return array(self.code, [t.id for t in self.model.tokenize(self.space + chunk)]).tobytes()
            return self._piece(" " + chunk)
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + chunk)))

    def ids(self, text: str) -> bytes:
        if not self.by_pieces or any(s in text for s in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.inner_space.search(text):
            head, rest = text, []
        else:
            head, *rest = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(head))) + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all rows in ascending order of ``doc_id``, each with ``end_id`` after it; returns the manifest.

    The manifest (part, seq, path, docs, tokens, start, id_bytes) is stored as ``<folder>/manifest``. Rows without a doc_id
    come first; rows that share one are in any order among themselves, and may be spread over several tasks: ties are
    broken by the place of the row in the input, so that a doc_id with most of the rows is no burden. Null text is empty:
    just ``end_id``. Other columns aren't looked at; an empty table gives an empty manifest. A text is held whole in its
    task, its ids with it. Tasks write files of their own names and only what committed attempts name is ever read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = (folder or scratch_path(spark, "tokens")).rstrip("/")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast(definition)  # one vocabulary file, of fixed size
    dtype = encoder(definition).dtype
    if not 0 <= end_id < 256**dtype.itemsize:
        raise ValueError(f"id {end_id} doesn't fit {dtype.itemsize} bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(shared.value), TaskContext.get().partitionId(), []
        end = np.asarray([end_id], enc.dtype).tobytes()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/ids", recursive=True)
        name, out, ids, sizes = "", None, [], []

        def close() -> None:
            out.close()
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
            with fs.open_output_stream(f"{base}/ids/{name}.idx", compression=None) as index:
                index.write(struct.pack(HEADER, MAGIC, enc.dtype.itemsize, len(ids) - len(known), len(ids)))
                index.write(np.asarray([0] * (len(ids) - len(known)) + known, "<i8").tobytes())
                index.write(offsets.tobytes())
            done.append((part, len(done), f"{folder}/ids/{name}", len(ids), int(offsets[-1])))

        for batch in batches:
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    name, ids, sizes, held = uuid.uuid4().hex, [], [], 0
                    out = fs.open_output_stream(f"{base}/ids/{name}.bin", compression=None)
                data = enc.ids(t.as_py() or "") + end
                out.write(data)
                ids.append(key)
                sizes.append(len(data) // enc.dtype.itemsize)
                held += len(data)
                if held >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string() if k == 2 else pa.int64()) for k in range(5)], _MANIFEST.names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    files = materialize(dealt.mapInArrow(write, _MANIFEST), "token-files")
    # one row a file: few, however much text there is
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(*_MANIFEST.names, F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"), F.lit(dtype.itemsize).cast("long").alias("id_bytes"))
    files.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class TokenFile:
    """One file and its index; ``file[i]`` are the ids of its i-th document, without a copy where the file is mapped.

    Files of a file system that the machine has mounted are mapped into memory; of any other store each document is read
    when it is asked for.
    """

    def __init__(self, path: str, docs: int | None = None, tokens: int | None = None):
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(f"{base}.idx") as f:
            head = f.read(struct.calcsize(HEADER))
            if len(head) < struct.calcsize(HEADER) or head[:8] != MAGIC:
                raise TokenFileError(f"{path}.idx is no index of token ids")
            _, width, self.without_id, n = struct.unpack(HEADER, head)
            body = f.read()
        if width not in (2, 4) or len(body) != 8 * (2 * n + 1) or self.without_id > n:
            raise TokenFileError(f"{path}.idx doesn't have what its header says")
        self.dtype = np.dtype(f"<u{width}")
        self.doc_ids, self.offsets = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<u8", n + 1, 8 * n).astype(np.int64)
        size = fs.get_file_info(f"{base}.bin").size
        if size != self.offsets[-1] * width or (docs is not None and docs != n) or (tokens is not None and tokens != self.offsets[-1]):
            raise TokenFileError(f"{path} has {n} documents and {size} bytes of ids, which isn't what its index or the manifest says")
        self.mapped = np.memmap(f"{base}.bin", self.dtype, "r") if isinstance(fs, pafs.LocalFileSystem) and size else None
        self.stream = None if self.mapped is not None else fs.open_input_file(f"{base}.bin")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        first, last = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.mapped is not None:
            return self.mapped[first:last]
        return np.frombuffer(self.stream.read_at((last - first) * self.dtype.itemsize, first * self.dtype.itemsize), self.dtype)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.without_id else int(self.doc_ids[i])


class TokenStream:
    """All files of a manifest as one sequence of ids: ``stream[a:b]`` are ids a to b - 1, across files."""

    def __init__(self, manifest: DataFrame):
        # one row a file
        rows = manifest.orderBy("start", "part", "seq").select("path", "docs", "tokens", "start").collect()
        self.rows, self.starts = rows, [r.start for r in rows]
        self.open = lru_cache(maxsize=64)(lambda k: TokenFile(rows[k].path, rows[k].docs, rows[k].tokens))

    def __len__(self) -> int:
        return self.rows[-1].start + self.rows[-1].tokens if self.rows else 0

    def __getitem__(self, span: slice) -> np.ndarray:
        first, last, _ = span.indices(len(self))
        k, out = max(0, bisect_right(self.starts, first) - 1), []
        while first < last:
            r, f = self.rows[k], self.open(k)
            upto, width = min(last, r.start + r.tokens), f.dtype.itemsize
            if upto > first:
                out.append(f.mapped[first - r.start : upto - r.start] if f.mapped is not None else np.frombuffer(f.stream.read_at((upto - first) * width, (first - r.start) * width), f.dtype))
                first = upto
            k += 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def read_token_files(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    unsigned 32-bit little-endian integers), and the ids themselves where asked for.

    Fails where a file isn't as long as its index or the manifest says. A file is read by one task, document by document.
    """
    ship_package(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs, tokens, start in zip(*(batch.column(c).to_pylist() for c in ("path", "docs", "tokens", "start")), strict=True):
                f = TokenFile(path, docs, tokens)
                rows, held = [], 0
                for i in range(len(f)):
                    own = f[i].astype("<u4")
                    rows.append((f.doc_id(i), start + int(f.offsets[i]), len(own), zlib.crc32(own), *([own.astype(np.int64)] if ids else [])))
                    held += len(own) if ids else 1
                    if held >= 50_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        if ids:
            columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    n = max(1, min(manifest.count(), 10 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path", "docs", "tokens", "start").repartition(n).mapInArrow(read, _ROWS + (", ids array<long>" if ids else ""))


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``write_token_files`` wrote."""
    return read_token_files(write_token_files(docs, tokenizer_path, folder))
