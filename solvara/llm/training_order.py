"""Training-order materialisation of token sequences as fixed-stride binary shards.

Documents are encoded and cut into sequences of a fixed length.  The sequences stand in one order
that doesn't depend on how the table is partitioned (doc_id, digest of the text, part; equal rows are
interchangeable), and a keyed Feistel permutation with cycle-walking gives each place a global slot.
Slots are range-partitioned, and each shard holds ``shard_slots`` consecutive slots as equal
records, so a reader finds slot ``s`` at ``(s mod shard_slots) * record_bytes`` of shard
``s div shard_slots`` and can resume anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.llm.common import materialize, small_batches
from solvara.operators.ordered import running_sums

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The file's last rank plus one: free, and used after each document and as padding.
END_ID = 50256
SEQ_LEN, SHARD_SLOTS, KEY = 1024, 1024, 0x5EED
ROUNDS = 6
#: Documents up to which the table of their first places (8 bytes each) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_DOCS = 4_000_000
U64 = np.uint64


# ---------------------------------------------------------------- tokens


@cache
def encoder(path: str, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Encodes whole texts as byte-level BPE without special tokens; kept from task to task.

    ``path`` is a file of ranks that every executor has; ``pattern`` splits texts (that of the public
    tokenizers' package, if none is given).
    """
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SEQUENCE = "task int, block long, place int, doc_id long, digest binary, copy int, n_parts int, part int, n_tokens int, ids binary"
_SEQUENCE = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, pattern: str | None = None) -> DataFrame:
    """Each document's ids and an end id, cut into ``seq_len``: doc_id, part of n_parts, n_tokens and ids.

    ids are little-endian 16-bit (all vocabularies used have under 65,536 ids) and not padded here.
    A null text counts as empty and gives one sequence of the end id alone.  task, block and place say
    where the document was read, digest is that of its text, copy counts equal documents of a task.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, pattern)
        task = TaskContext.get().partitionId()
        seen: dict[tuple[int | None, bytes], int] = {}
        for number, b in enumerate(batches):
            out: tuple[list, ...] = tuple([] for _ in _SEQUENCE)
            for place, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u2")
                digest = hashlib.sha256((text or "").encode("utf-8", "replace")).digest()[:16]
                copy = seen[doc, digest] = seen.get((doc, digest), -1) + 1
                starts = range(0, len(ids), seq_len)
                for part, start in enumerate(starts):
                    own = ids[start : start + seq_len]
                    for column, value in zip(out, (task, task << 32 | number, place, doc, digest, copy, len(starts), part, len(own), own.tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SEQUENCE)], [x.split()[0] for x in SEQUENCE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SEQUENCE)


# ---------------------------------------------------------------- order


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + U64(key & (2**64 - 1))) * U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(29))


def feistel(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each index in 0..n-1 (or the index of each slot): a keyed permutation of 0..n-1.

    A balanced Feistel network permutes 0..4**h-1, the least such range that holds n; values that
    fall outside 0..n-1 are walked on until they fall inside.
    """
    half = max(1, -(-max(int(n) - 1, 1).bit_length() // 2))
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return left << shift | right

    out = once(np.asarray(index).astype(U64))
    while (outside := out >= U64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def first_places(made: DataFrame) -> tuple[DataFrame, int, int, str]:
    """(block, firsts), documents, sequences and fingerprint of ``sequences`` rows (written ones).

    ``firsts`` has, for each document of a block, the place of its first sequence among all sequences
    in the order of (doc_id, digest, task, copy).  Equal documents have equal sequences, so which task
    read them makes no difference.  The fingerprint is that of all (doc_id, digest, n_parts).
    """
    docs = made.where("part = 0").select("task", "block", "place", "doc_id", "digest", "copy", "n_parts")
    held = docs.groupBy("doc_id", "digest", "task").agg((F.count(F.lit(1)) * F.max("n_parts")).alias("size"))
    order = running_sums(held, ["doc_id", "digest", "task"], ["size"])
    order = order.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("task").alias("__task"), (F.col("size_upto") - F.col("size")).alias("first"))
    found = docs.join(order, docs["doc_id"].eqNullSafe(order["__id"]) & (docs["digest"] == order["__digest"]) & (docs["task"] == order["__task"]))
    first = F.struct("place", (F.col("first") + F.col("copy") * F.col("n_parts")).alias("first"))
    firsts = found.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["first"]).alias("firsts"))
    mark = F.xxhash64("doc_id", "digest", "n_parts")
    total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_parts"), F.lit(0)), F.sum(F.pmod(mark, F.lit(2**31))), F.sum(F.pmod(F.shiftright(mark, 31), F.lit(2**31)))).first()
    return firsts, int(total[0]), int(total[1]), hashlib.sha256(repr(tuple(total)).encode()).hexdigest()


def placed_sequences(docs: DataFrame, tokenizer: str, seq_len: int, shard_slots: int, key: int, pattern: str | None) -> tuple[DataFrame, int, str]:
    """(slot, shard, doc_id, part, ids) of all sequences, their number and the input's fingerprint."""
    made = materialize(sequences(docs, tokenizer, seq_len, pattern), "sequences")
    firsts, documents, n, mark = first_places(made)
    if documents <= BROADCAST_DOCS:
        firsts = F.broadcast(firsts)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    index = F.element_at("firsts", F.col("place") + 1) + F.col("part")
    rows = made.join(firsts, "block").select(slot(index).alias("slot"), "doc_id", "part", "ids")
    return rows.withColumn("shard", F.floor(F.col("slot") / shard_slots)), n, mark


def _in_order(placed: DataFrame, n: int, shard_slots: int) -> DataFrame:
    parts = max(1, min(-(-n // shard_slots), max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (16 * shard_slots))))
    return placed.repartitionByRange(parts, "shard").sortWithinPartitions("slot").select("slot", "doc_id", "part", "ids")


def _padded(ids: bytes, record: int) -> bytes:
    return ids + END_ID.to_bytes(2, "little") * ((record - len(ids)) // 2)


SHARD = "shard long, first_slot long, n_slots int, record_bytes int, n_tokens long, payload_sha256 string, doc_ids array<long>, parts array<int>, payload binary"


def training_shards(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY, pattern: str | None = None) -> DataFrame:
    """The shards of all sequences of ``docs`` (doc_id, text) in training order, as rows.

    Each row is one shard: its number, first slot, slots, bytes of a record, ids without padding,
    SHA-256 of the payload, document and part of each slot, and the payload of ``n_slots`` records of
    ``seq_len`` little-endian 16-bit ids, padded with the end id.  Every document gives at least one
    sequence (null and empty texts one end id); repeated rows give sequences of their own; an empty
    table gives no shards; other columns are ignored.  All shards but the last are full.  The same
    rows give the same shards however they are partitioned.
    """
    placed, n, _ = placed_sequences(docs, tokenizer, seq_len, shard_slots, key, pattern)
    record = 2 * seq_len

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard = None

        def flush() -> pa.RecordBatch:
            payload = b"".join(_padded(ids, record) for _, _, _, ids in held)
            row = [shard, shard * shard_slots, len(held), record, sum(len(x[3]) // 2 for x in held), hashlib.sha256(payload).hexdigest(), [x[1] for x in held], [x[2] for x in held], payload]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            for at, doc, part, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                if shard is not None and at // shard_slots != shard:
                    yield flush()
                    held = []
                shard = at // shard_slots
                held.append((at, doc, part, ids))
        if held:
            yield flush()

    return _in_order(placed, n, shard_slots).mapInArrow(pack, SHARD)


# ---------------------------------------------------------------- files

#: What stands beside each record: whether the document has an id, the id, the part.
PLACE = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("part", "<i4")])
_NAME = re.compile(r"shard-(\d{12})\.bin$")


def _store(path: str):
    """The file system of a path or URI (local, HDFS or an object store) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _name(shard: int, kind: str = "bin") -> str:
    return f"shard-{shard:012d}.{kind}"


def _put(store, path: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that a file is whole or absent."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def _header(path: str) -> dict | None:
    """The description of the shards under ``path``, if any were begun."""
    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(f"{root}/_order.json").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/_order.json") as f:
        return json.loads(f.read())


def _whole_shards(path: str, header: dict) -> list[int]:
    """Numbers of the shards that are there with all their records."""
    from pyarrow import fs

    store, root = _store(path)
    slots, n, found = header["shard_slots"], header["sequences"], []
    for info in store.get_file_info(fs.FileSelector(root)):
        if m := _NAME.search(info.base_name):
            shard = int(m[1])
            if info.size == min(slots, n - shard * slots) * 2 * header["seq_len"]:
                found.append(shard)
    return found


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY, pattern: str | None = None) -> int:
    """Writes one file of equal records for each shard under ``path`` (a folder on a shared file system).

    ``shard-<number>.bin`` has the records, ``.idx`` the document and part of each, ``_order.json``
    how they were made.  A shard is moved to its name when whole, so an interrupted write is taken
    up by calling this again: shards that are there are neither sorted nor written again.  Other
    documents, or other parameters, than those the folder was begun with raise ValueError.  Returns
    the number of shards written.
    """
    placed, n, mark = placed_sequences(docs, tokenizer, seq_len, shard_slots, key, pattern)
    header = {"sequences": n, "seq_len": seq_len, "shard_slots": shard_slots, "key": key, "end_id": END_ID, "tokenizer": tokenizer.rsplit("/", 1)[-1], "documents": mark}
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    begun = _header(path)
    if begun is None:
        _put(store, f"{root}/_order.json", json.dumps(header).encode())
    elif begun != header:
        raise ValueError(f"{path} holds shards of {begun}, not of {header}")
    if there := _whole_shards(path, header):
        placed = placed.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in there], "shard long")), "shard", "left_anti")
    record = 2 * seq_len

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = _store(path)
        shard, held, places = None, [], []

        def close() -> pa.RecordBatch:
            _put(own, f"{base}/{_name(shard, 'idx')}", np.array(places, PLACE).tobytes())
            _put(own, f"{base}/{_name(shard)}", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shard"])

        for b in batches:
            for at, doc, part, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                if shard is not None and at // shard_slots != shard:
                    yield close()
                    held, places = [], []
                shard = at // shard_slots
                held.append(_padded(ids, record))
                places.append((doc is not None, doc or 0, part))
        if held:
            yield close()

    return _in_order(placed, n, shard_slots).mapInArrow(save, "shard long").count()


def read_slots(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(slot, doc_id, part, ids) of the slots first..last: each task reads its records and no others.

    Slots beyond the last sequence give no rows; a shard that was not written yet raises an error.
    """
    header = _header(path)
    if header is None:
        raise FileNotFoundError(path)
    slots, record = header["shard_slots"], 2 * header["seq_len"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for b in batches:
            wanted = b.column(0).to_numpy()
            for run in np.split(wanted, np.flatnonzero((np.diff(wanted) != 1) | (np.diff(wanted // slots) != 0)) + 1):
                if not len(run):
                    continue
                shard, at = divmod(int(run[0]), slots)
                data = []
                for kind, size in (("bin", record), ("idx", PLACE.itemsize)):
                    with store.open_input_file(f"{root}/{_name(shard, kind)}") as f:
                        data.append(f.read_at(len(run) * size, at * size))
                place = np.frombuffer(data[1], PLACE)
                ids = [data[0][k : k + record] for k in range(0, len(data[0]), record)]
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(place["doc_id"], mask=place["known"] == 0), pa.array(place["part"]), pa.array(ids, pa.binary())], ["slot", "doc_id", "part", "ids"])

    wanted = spark.range(max(first, 0), max(min(last + 1, header["sequences"]), 0))
    return wanted.mapInArrow(read, "slot long, doc_id long, part int, ids binary")
