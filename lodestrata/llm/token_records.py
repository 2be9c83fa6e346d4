"""Token-ID / binary output: length-delimited records with masked checksums, and an offset index.

A document's token ids, little-endian in ``width`` bytes each, are the data of one record:

    length (8 bytes, little-endian) | masked CRC-32C of the length (4) | data | masked CRC-32C of the data (4)

Every task writes one shard into the shared folder under a name of its own and gives the
index rows of what it wrote; the index table names only shards of tasks that succeeded,
so a lost or repeated task leaves at most a file that nothing refers to. A reader needs
one seek for each index row, in any order (:func:`read_records`).

Null and empty texts give records of no data. Very long texts are one record each, in memory
at once. Repeated rows and equal texts give a record each; records of a task are in the order
of its rows. A vocabulary that ``width`` bytes can't number is an error. An empty
table gives an empty index. Nulls in other columns don't matter; extra columns aren't
written. The tokenizer is a file of byte-pair ranks, its path a parameter.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from lodestrata.llm import textkit as K
from lodestrata.runtime import cut, shared_dir, ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
INDEX = "doc_id long, shard string, offset long, length long, n_tokens int, length_crc long, data_crc long"


def _tables() -> np.ndarray:
    """CRC-32C register changes: [k][byte] after the byte and k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0x82F63B78) * (t & np.uint32(1)))
    out = [t]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ t[out[-1] & np.uint32(255)])
    return np.array(out)


_T = _tables()


def _advance(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    c = crc.view(np.uint8).reshape(-1, 4)
    return table[0][c[:, 0]] ^ table[1][c[:, 1]] ^ table[2][c[:, 2]] ^ table[3][c[:, 3]]


@cache
def _zeros(k: int) -> np.ndarray:
    """Tables that take a register over 8 * 2**k zero bytes."""
    if k:
        half = _zeros(k - 1)
        return np.array([_advance(half, np.ascontiguousarray(half[i])) for i in range(4)])
    basis = np.zeros((4, 256), np.uint32)
    for i in range(4):
        basis[i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for _ in range(8):
        basis = (basis >> np.uint32(8)) ^ _T[0][basis & np.uint32(255)]
    return basis


def crc32c(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """CRC-32C of the byte strings data[off[i]:off[i + 1]], all at once.

    Leading zeros don't change a register of 0, so each string is put behind as many as
    make its length a multiple of 8; the initial ones are its first four bytes inverted
    (shorter strings go byte by byte). Blocks of 8 bytes are taken separately, carried
    over the rest of their string by powers of two, and added up.
    """
    n = np.diff(off)
    out = np.zeros(len(n), np.uint32)
    for i in np.flatnonzero(n < 4):
        c = 0xFFFFFFFF
        for x in data[off[i] : off[i + 1]].tolist():
            c = (c >> 8) ^ int(_T[0][(c ^ x) & 255])
        out[i] = c ^ 0xFFFFFFFF
    long = np.flatnonzero(n >= 4)
    if not len(long):
        return out
    blocks = -(-n[long] // 8)
    ends = np.cumsum(blocks)
    buf = np.zeros(int(ends[-1]) * 8, np.uint8)
    lead = ends * 8 - n[long]
    src = np.repeat(off[long], n[long]) + (np.arange(int(n[long].sum())) - np.repeat(np.cumsum(n[long]) - n[long], n[long]))
    buf[np.repeat(lead, n[long]) + src - np.repeat(off[long], n[long])] = data[src]
    for k in range(4):
        buf[lead + k] ^= 255
    b = buf.reshape(-1, 8)
    crc = _T[7][b[:, 0]]
    for k in range(1, 8):
        crc ^= _T[7 - k][b[:, k]]
    far = np.repeat(ends, blocks) - 1 - np.arange(int(ends[-1]))
    for k in range(int(far.max()).bit_length()):
        at = np.flatnonzero((far >> k) & 1)
        crc[at] = _advance(_zeros(k), np.ascontiguousarray(crc[at]))
    out[long] = np.bitwise_xor.reduceat(crc, ends - blocks) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The records of byte strings, their offsets, and the checksums of lengths and data."""
    n = np.diff(off)
    head = n.astype("<u8").view(np.uint8)
    a, b = masked(crc32c(head, np.arange(len(n) + 1) * 8)), masked(crc32c(data, off))
    raw, ha, hb, hn = data.tobytes(), a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), head.tobytes()
    rows = [hn[8 * i : 8 * i + 8] + ha[4 * i : 4 * i + 4] + raw[s:e] + hb[4 * i : 4 * i + 4] for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist()))]
    return b"".join(rows), np.concatenate([[0], np.cumsum(n + 16)]), a, b


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_records(docs: DataFrame, to: str | None = None, ranks: str = RANKS, width: int = 2) -> DataFrame:
    """Write a record for every row of ``docs`` into folder ``to`` (by default one in the shared folder); the index."""
    ship(docs.sparkSession)
    folder = f"{to or shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"

    def run(batches):
        enc, where, out, at = encoder(ranks), None, None, 0
        if enc.max_token_value >= 1 << 8 * width:
            raise ValueError(f"token ids up to {enc.max_token_value} don't fit into {width} bytes")
        for b in batches:
            for part in K.slices(b):
                ids = [enc.encode_ordinary(x or "") for x in part.column("text").to_pylist()]
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((x for d in ids for x in d), f"<u{width}", int(count.sum()))
                raw, off, a, c = frame(flat.view(np.uint8), np.concatenate([[0], np.cumsum(count * width)]))
                if out is None:
                    system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                    system.create_dir(base, recursive=True)
                    name = f"shard-{uuid.uuid4().hex}.rec"
                    where, out = f"{folder}/{name}", system.open_output_stream(f"{base}/{name}")
                out.write(raw)
                yield pa.RecordBatch.from_arrays(
                    [K.column(part, "doc_id").cast(pa.int64()), pa.array([where] * len(ids)), pa.array(off[:-1] + at), pa.array(np.diff(off)), pa.array(count.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(c.astype(np.int64))],
                    ["doc_id", "shard", "offset", "length", "n_tokens", "length_crc", "data_crc"],
                )
                at += len(raw)
        if out is not None:
            out.close()

    return cut(docs.select("doc_id", "text").mapInArrow(run, INDEX))


def read_record(f, offset: int, length: int, width: int = 2) -> np.ndarray:
    """Token ids of the record at ``offset`` of an open shard; ValueError if a checksum is wrong."""
    f.seek(offset)
    raw = np.frombuffer(f.read(length), np.uint8)
    (n,) = struct.unpack("<Q", raw[:8].tobytes())
    if n != length - 16:
        raise ValueError(f"record at {offset}: length {n}, the index has {length - 16}")
    want = np.array([*struct.unpack("<I", raw[8:12].tobytes()), *struct.unpack("<I", raw[-4:].tobytes())], np.uint32)
    body = np.concatenate([raw[:8], raw[12:-4]])
    if (masked(crc32c(body, np.array([0, 8, 8 + n]))) != want).any():
        raise ValueError(f"record at {offset}: wrong checksum")
    return raw[12:-4].view(f"<u{width}")


def read_records(index: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, tokens) of the index rows, read in their order within a task and checked."""
    ship(index.sparkSession)

    def run(batches):
        opened = {}
        for b in batches:
            tokens = []
            for shard, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard not in opened:
                    system, path = fs.FileSystem.from_uri(shard if ":" in shard else f"file://{shard}")
                    opened[shard] = system.open_input_file(path)
                tokens.append(read_record(opened[shard], at, n, width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return index.select("doc_id", "shard", "offset", "length").mapInArrow(run, "doc_id long, tokens array<int>")
