"""Token ids in bit-plane shuffled binary files.

Documents are range-partitioned by id and encoded; every partition writes one file. A file holds
fixed-size blocks of ids. Each block is transposed into bit or byte planes, every plane is
compressed with zstandard on its own, and an index of block positions plus the documents' ids and
lengths follows. High planes are nearly constant, so they shrink to almost nothing.

Defined results: null text is empty; an empty document holds only the end id; repeated rows are
encoded as often as they occur; null document ids come first; ties in the id keep any order among
themselves; an empty table writes no file and returns no row; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import attempt_name, open_input, open_output, shared_folder, tidied
from .text import _BYTE, _BYTE2, _Powers, chunks, mix, raw_bytes, string_column

MAGIC = b"FLTOKEN1"
BLOCK_IDS = 65_536
#: Distinct text units a worker remembers, and their ids (40 MB together); beyond either it starts afresh.
CACHE_UNITS = 800_000
CACHE_IDS = 4_000_000
CHUNK_BYTES = 1_000_000


# --- planes -----------------------------------------------------------------------------------

def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """Planes of little-endian ids of ``width`` bytes: one a byte, or one a bit (low bit first)."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [raw[:, b].tobytes() for b in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b]).tobytes() for b in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel()


class TokenWriter:
    """Writes ids of consecutive documents to one file; memory is one block plus the index."""

    def __init__(self, sink, width: int = 2, kind: str = "byte", level: int = 1) -> None:
        self.sink, self.width, self.kind = sink, width, kind
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.blocks: list[list[int]] = []
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.at = sink.write(MAGIC) or len(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths.astype(np.int64))
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK_IDS:
            flat = np.concatenate(self.pending)
            whole = len(flat) // BLOCK_IDS * BLOCK_IDS
            for lo in range(0, whole, BLOCK_IDS):
                self._block(flat[lo : lo + BLOCK_IDS])
            self.pending, self.held = [flat[whole:].copy()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.width, self.kind)]
        self.blocks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        docs = pa.record_batch(
            [pa.concat_arrays(self.doc_ids or [pa.array([], pa.int64())]), pa.array(np.concatenate(self.lengths or [np.empty(0, np.int64)]))],
            names=["doc_id", "n_tokens"],
        )
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, docs.schema) as w:
            w.write_batch(docs)
        table = self.zstd.compress(out.getvalue().to_pybytes())
        index = self.zstd.compress(json.dumps({"width": self.width, "kind": self.kind, "blocks": self.blocks}).encode())
        self.sink.write(table + index + struct.pack("<QQ", len(table), len(index)) + MAGIC)
        self.sink.close()


class TokenReader:
    """Reads one file: the index first, then the blocks that are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 24)
        n_table, n_index, magic = struct.unpack("<QQ8s", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - 24 - n_index - n_table)
        unzstd = self.unzstd = zstandard.ZstdDecompressor()
        docs = pa.ipc.open_stream(unzstd.decompress(source.read(n_table))).read_all()
        index = json.loads(unzstd.decompress(source.read(n_index)))
        self.width, self.kind, self.blocks = index["width"], index["kind"], index["blocks"]
        self.doc_ids = docs.column(0).combine_chunks()
        self.lengths = docs.column(1).to_numpy()

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.blocks[k]
        self.source.seek(at)
        data = self.source.read(sum(sizes))
        cut = np.cumsum([0, *sizes])
        planes = [self.unzstd.decompress(data[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        return from_planes(planes, n, self.width, self.kind)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in order, holding a block and the current document."""
        blocks = iter(range(len(self.blocks)))
        buffer = np.empty(0, dtype=f"<u{self.width}")
        at = 0
        for n in self.lengths.tolist():
            if len(buffer) - at < n:
                parts, have = [buffer[at:]], len(buffer) - at
                while have < n:
                    parts.append(self.block(next(blocks)))
                    have += len(parts[-1])
                buffer, at = np.concatenate(parts), 0
            yield buffer[at : at + n]
            at += n


# --- encoding ---------------------------------------------------------------------------------

def _visible() -> dict[int, int]:
    """A byte-level vocabulary's characters of the bytes that Latin-1 shows as blank or control."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
    return {b: 256 + k for k, b in enumerate(hidden)}


_VISIBLE = _visible()


class UnitEncoder:
    """Encodes texts with the ``tokenizers`` library, each distinct unit of text once.

    A byte-level vocabulary cuts a text before every single space that stands between two
    characters that are not white space, so the ids of a text are those of its units in turn.
    Units are told apart by 128 bits of hash; their ids are kept in arrays, within bounds.

    What the cuts rely on is checked in the file: no normalizer, the byte-level pre-tokenizer with its
    usual pattern, plain merges, special tokens written ``<|name|>``. Any other vocabulary is left to the
    library, text by text.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.cuts = self._cuts_hold()
        self.forget()

    def _cuts_hold(self) -> bool:
        told = json.loads(self.tokenizer.to_str())
        before, model, added = told["pre_tokenizer"] or {}, told["model"], told["added_tokens"]
        return (
            told["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(re.fullmatch(r"<\|[a-z_]+\|>", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        )

    def forget(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[list[int]]:
        """Ids of units: words go straight to the merges, others through the whole library."""
        out: list[list[int] | None] = [None] * len(units)
        model, rest = self.tokenizer.model, []
        for i, u in enumerate(units):
            if (u[1:] if u[:1] == " " else u).isalpha():
                out[i] = [t.id for t in model.tokenize(u.encode().decode("latin-1").translate(_VISIBLE))]
            else:
                rest.append(i)
        simple = [i for i in rest if len(units[i].split()) == 1 and units[i][-1:].strip() and not any(s in units[i] for s in self.special)]
        if len(self.newline) == 1:
            for lo in range(0, len(simple), 512):
                part = simple[lo : lo + 512]
                ids = np.array(self._plain(["\n".join(units[i] for i in part)])[0])
                cut = np.flatnonzero(ids == self.newline[0])
                if len(cut) == len(part) - 1:
                    for i, piece in zip(part, np.split(ids, cut)):
                        out[i] = piece[1:].tolist() if i != part[0] else piece.tolist()
        left = [i for i in rest if out[i] is None]
        for i, ids in zip(left, self._plain([units[i] for i in left])):
            out[i] = ids
        return out

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(column.fill_null("").to_pylist())
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text."""
        data, offsets = raw_bytes(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(column), np.int64)
        if not self.cuts:
            return self._whole(column)
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        up, down = _Powers.get(len(data) + 1)
        both = []
        for table in (_BYTE, _BYTE2):
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(table[data] * up[: len(data)], out=run[1:], dtype=np.uint64)
            both.append(mix((run[ends] - run[starts]) * down[starts]))
        key, rep, inverse = np.unique(both[0], return_index=True, return_inverse=True)
        check = both[1][rep]
        if (check[inverse] != both[1]).any():  # two units with one hash
            return self._whole(column)
        slot = np.searchsorted(self.key, key)
        known = slot < len(self.key)
        known[known] = (self.key[slot[known]] == key[known]) & (self.check[slot[known]] == check[known])
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.key) + len(new) > CACHE_UNITS or len(self.ids) > CACHE_IDS:
                self.forget()
                new = np.arange(len(key))
            whole = data.tobytes()
            encoded = self._units([whole[starts[r] : ends[r]].decode() for r in rep[new].tolist()])
            size = np.fromiter(map(len, encoded), np.int64, len(encoded))
            at = np.cumsum(size) - size + len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in encoded for i in x), np.uint32, int(size.sum()))])
            where = np.searchsorted(self.key, key[new])
            for name, value in (("key", key[new]), ("check", check[new]), ("at", at), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), where, value))
            slot = np.searchsorted(self.key, key)
        at, size = self.at[slot][inverse], self.size[slot][inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[0x21:0x7F] = True
_MARK[0x30:0x3A] = _MARK[_LETTER] = _MARK[0x27] = False


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: the places at which the vocabulary's pattern surely cuts.

    Those are the starts of texts, a space or line feed alone between two characters that aren't
    white space, what follows such a line feed, and a mark other than ' after an ASCII letter.
    Beyond ASCII, white space starts with one of C2, E1, E2, E3 and ends in few ways; there is no
    cut beside such a byte, which only makes a unit longer. Nor is there one inside a special token.
    """
    feed = data == 0x0A
    cut = (data == 0x20) | feed
    near = cut | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    after = near | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    before = near.copy()
    before[1:] |= ((data[1:] == 0x85) | (data[1:] == 0xA0)) & (data[:-1] == 0xC2)
    before[2:] |= (data[2:] >= 0x80) & (data[2:] <= 0xBF) & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    cut[1:] &= ~before[:-1]
    cut[:-1] &= ~after[1:]
    cut[-1] = False
    first = offsets[:-1][offsets[:-1] < len(data)]
    last = offsets[1:] - 1
    cut[first] = False  # white space that starts or ends a text is not between its characters
    cut[last[last >= 0]] = False
    alone = np.flatnonzero(cut & feed) + 1
    cut[alone] = True
    letter = _LETTER[data]
    mark = _MARK[data] & (data != 0x3C) & (data != 0x7C) & (data != 0x3E)
    cut[1:] |= letter[:-1] & mark[1:]
    cut[first] = True
    return np.flatnonzero(cut)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder of the vocabulary file it has used last; what it remembers is bounded."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


# --- operator ---------------------------------------------------------------------------------

MANIFEST = "part int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int | None = 2, kind: str = "byte", folder: str | None = None, partitions: int | None = None) -> list[dict]:
    """Encode ``doc_id, text`` in ascending id order; returns the manifest, one entry a file."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path = attempt_name(folder, ".tok")
        enc, out, n_docs = encoder(vocabulary), None, 0
        for batch in batches:
            texts, keys = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi in chunks(texts, CHUNK_BYTES):
                ids, lengths = enc.encode(texts.slice(lo, hi - lo))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                if out is None:
                    out = TokenWriter(open_output(path), enc.width, kind)
                out.add(keys.slice(lo, hi - lo), ids, lengths)
                n_docs += hi - lo
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([out.total], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    files = sorted((r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()), key=lambda f: f["part"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["n_tokens"]
    return files


def read_tokens(spark, files: list[dict]) -> DataFrame:
    """One row a document, from the files: its place among all ids, its length and their CRC-32."""
    if not files:
        return spark.createDataFrame([], DOCUMENTS)

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as source:
                    reader = TokenReader(source)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4")) for ids in reader.documents()), np.int64, len(reader.lengths))
                start = row["start"] + np.cumsum(reader.lengths) - reader.lengths
                yield pa.record_batch([reader.doc_ids, pa.array(start), pa.array(reader.lengths), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(f["part"], f["path"], f["start"]) for f in files]
    return spark.createDataFrame(rows, "part int, path string, start long").repartitionByRange(len(rows), "part").mapInArrow(read, DOCUMENTS)


def token_binary(docs: DataFrame, vocabulary: str, end_id: int | None = 2, kind: str = "byte") -> DataFrame:
    """Write all documents as token files and return what the files hold, one row a document."""
    return read_tokens(docs.sparkSession, write_tokens(docs, vocabulary, end_id, kind))
