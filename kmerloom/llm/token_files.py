"""Token-id files with a minimal perfect hash index from document keys to offsets.

Documents go to shards by ranges of their keys, so that shards in a row hold
ascending keys.  A shard is one file:

    magic, header length, header (JSON: counts, widths, level sizes, positions)
    payload       raw ids, 2 or 4 bytes each, little-endian
    ends          uint64 per record: ids of the shard up to its end
    keys          int64 per record, ascending
    bits          the levels of the hash, one bit per place
    ranks         per 512 places: set bits before them (uint32)
    slots         per distinct key: fingerprint, first record, number of records (uint32)

The hash places every key at the first level where no other key of the shard
meets it; its slot is the number of set bits before its place.  A lookup
therefore reads the header, 64 bytes of bits a level (two levels or so), a
rank, a slot and the record, each by its offset (``ShardFile``), and the
stored fingerprint tells keys that the shard does not hold.

Files are written under another name and then renamed, so a task that runs
again leaves one whole file.

Defined results: null texts are empty documents (the end id alone); a null
key is stored as the smallest 64-bit integer; rows with the same key are
records of that key, ordered by their ids; an empty table writes no file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import tokens
from kmerloom.llm.common import shared_dir, small_batches

MAGIC = b"TOKSHRD1"
NULL_KEY = -(2**63)
#: Bytes of text that a shard is meant to hold.
SHARD_BYTES = 16 << 20
#: Places per key in a level of the hash, and places whose bits are read together.
GAMMA, RANKED = 2, 512
RECORDS = "doc_id bigint, shard bigint, start bigint, n_tokens bigint, ids binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of the keys (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to the numbers 0 to n - 1, without storing the keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        rest = keys
        while len(rest):
            m = GAMMA * len(rest)
            at = (_mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that meet no set bit."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            place = self.first[level] + (_mix(keys[rest], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[place]
            out[rest[hit]] = self.rank[place[hit]]
            rest = rest[~hit]
        return out


class Shard:
    """A shard file in memory, read by key."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + size])
        at = 16 + size
        part = {}
        for name, kind, n in head["parts"]:
            part[name] = np.frombuffer(data, kind, n, at)
            at += part[name].nbytes
        self.ids, self.ends, self.keys = part["payload"], part["ends"].astype(np.int64), part["keys"]
        self.hash = PerfectHash(head["levels"], np.unpackbits(part["bits"], count=sum(head["levels"])).astype(bool))
        self.slots = part["slots"].reshape(-1, 3)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key its first record and how many it has (none if the shard lacks it)."""
        slot = self.hash.slot(keys)
        known = slot >= 0
        known[known] = self.slots[slot[known], 0] == _fingerprint(keys[known])
        first, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], n[known] = self.slots[slot[known], 1], self.slots[slot[known], 2]
        # a fingerprint can agree by chance: the key of the record decides
        right = known.copy()
        right[known] = self.keys[first[known]] == keys[known]
        return first, np.where(right, n, 0)

    def record(self, i: int) -> tuple[int, np.ndarray]:
        """Start in the shard and ids (uint32) of a record."""
        start = int(self.ends[i - 1]) if i else 0
        return start, self.ids[start : self.ends[i]].astype("<u4")


class ShardFile:
    """A shard file in its store, read by offsets: what a key needs and no more."""

    def __init__(self, source):
        self.source, self.bytes_read = source, 0
        lead = self._read(0, 16)
        if lead[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(lead[8:16], "little")
        head = json.loads(self._read(16, size))
        self.levels, self.at, at = head["levels"], {}, 16 + size
        for name, kind, n in head["parts"]:
            self.at[name] = (at, np.dtype(kind))
            at += np.dtype(kind).itemsize * n
        self.n_places = sum(self.levels)

    def _read(self, offset: int, n: int) -> bytes:
        got = self.source.read_at(n, offset) if n else b""
        self.bytes_read += len(got)
        return got

    def _part(self, name: str, first: int, n: int) -> np.ndarray:
        at, kind = self.at[name]
        return np.frombuffer(self._read(at + first * kind.itemsize, n * kind.itemsize), kind)

    def find(self, key: int) -> tuple[int, int]:
        """The key's first record and how many it has (none if the shard lacks it)."""
        own = np.array([key], np.int64)
        before = 0
        for level, m in enumerate(self.levels):
            place = before + int(_mix(own, level)[0] % np.uint64(m))
            before += m
            block = place // RANKED
            n = min(RANKED // 8, -(-(self.n_places - block * RANKED) // 8))
            bits = np.unpackbits(self._part("bits", block * (RANKED // 8), n))
            if bits[place % RANKED]:
                slot = int(self._part("ranks", block, 1)[0]) + int(bits[: place % RANKED].sum())
                mark, first, n = (int(v) for v in self._part("slots", 3 * slot, 3))
                # a fingerprint can agree by chance: the key of the record decides
                if mark == int(_fingerprint(own)[0]) and int(self._part("keys", first, 1)[0]) == key:
                    return first, n
                return 0, 0
        return 0, 0

    def record(self, i: int) -> tuple[int, np.ndarray]:
        """Start in the shard and ids (uint32) of a record."""
        ends = self._part("ends", max(i - 1, 0), 1 + (i > 0)).astype(np.int64)
        start = int(ends[0]) if i else 0
        return start, self._part("payload", start, int(ends[-1]) - start).astype("<u4")


def shard_bytes(keys: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """A shard of records in ascending order of their keys."""
    ends = np.cumsum([len(x) for x in ids]).astype("<u8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    flat = flat.astype("<u2" if flat.max(initial=0) < 1 << 16 else "<u4")
    distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
    perfect = PerfectHash.build(distinct)
    slots = np.zeros((len(distinct), 3), "<u4")
    slots[perfect.slot(distinct)] = np.stack([_fingerprint(distinct), first, n], 1)
    parts = {"payload": flat, "ends": ends, "keys": keys.astype("<i8"), "bits": np.packbits(perfect.bits), "ranks": perfect.rank[:-1:RANKED].astype("<u4"), "slots": slots.reshape(-1)}
    head = json.dumps({"levels": perfect.sizes, "parts": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(v.tobytes() for v in parts.values())])


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, else four; the first byte says which."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def _path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.bin"


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = tokens.TOKENIZER, shard_size: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of all documents under ``folder``; the manifest, a row per shard file.

    The manifest (bounded by the number of files) passes the driver, which
    turns the files' counts into the number of ids before each file.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // shard_size))
    bounds = []
    if n > 1:
        at = [i / n for i in range(1, n)]
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 20 * n)).first()[0] or []))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array(bounds, np.int64)
        coder = tokens.encoder(tokenizer)
        for batch in batches:
            for part in tokens.slices(batch, size=tokens.WORD_SLICE_BYTES):
                keys = part["doc_id"].to_numpy()
                ids = [_narrow(x) for x in coder.encode(part["text"])]
                yield pd.DataFrame({"shard": np.searchsorted(edges, keys, side="left").astype(np.int32), "doc_id": keys, "ids": ids})

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        store, base = _store(folder)
        store.create_dir(base)
        for shard, rows_ in pd.concat(parts).groupby("shard", sort=True):
            keys = rows_["doc_id"].to_numpy()
            ids = [np.frombuffer(x, f"<u{x[0]}", offset=1) for x in rows_["ids"]]
            draft = f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(shard_bytes(keys, ids))
            store.move(draft, _path(base, shard))
            yield pd.DataFrame(
                {
                    "shard": [shard],
                    "first_key": [int(keys[0])],
                    "last_key": [int(keys[-1])],
                    "n_records": [len(keys)],
                    "n_tokens": [sum(map(len, ids))],
                }
            )

    dealt = (
        rows.mapInPandas(deal, "shard int, doc_id bigint, ids binary")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", "ids")
    )
    files = dealt.mapInPandas(save, "shard bigint, first_key bigint, last_key bigint, n_records bigint, n_tokens bigint")
    before, manifest = 0, []
    for r in sorted(files.collect(), key=lambda r: r["shard"]):
        manifest.append((folder, r["shard"], r["first_key"], r["last_key"], r["n_records"], r["n_tokens"], before))
        before += r["n_tokens"]
    return spark.createDataFrame(
        manifest,
        "folder string, shard bigint, first_key bigint, last_key bigint, n_records bigint, n_tokens bigint, ids_before bigint",
    )


def _load(folder: str, shard: int) -> Shard:
    store, base = _store(folder)
    with store.open_input_stream(_path(base, shard)) as f:
        return Shard(f.read())


def _frame(rows: list[tuple[int, int, np.ndarray]], number: int, before: int) -> pd.DataFrame:
    """Records (key, start, ids) of a shard as rows."""
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if k == NULL_KEY else int(k) for k, _, _ in rows], "Int64"),
            "shard": number,
            "start": [before + s for _, s, _ in rows],
            "n_tokens": [len(x) for _, _, x in rows],
            "ids": [x.tobytes() for _, _, x in rows],
        }
    )


def _records(shard: Shard, keys: np.ndarray, number: int, before: int) -> Iterator[pd.DataFrame]:
    first, n = shard.find(keys)
    found = np.repeat(keys, n)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    for lo in range(0, len(at), 4096):
        yield _frame([(k, *shard.record(int(i))) for k, i in zip(found[lo : lo + 4096], at[lo : lo + 4096], strict=True)], number, before)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records, each found through the index by its key; a task reads one file at a time."""
    n = max(1, manifest.count())

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                shard = _load(r.folder, int(r.shard))
                yield from _records(shard, np.unique(shard.keys), int(r.shard), int(r.ids_before))

    return manifest.repartition(n).mapInPandas(load, RECORDS)


def lookup(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The records of the given keys; keys that no file holds give no row.

    The manifest's key ranges (small, a row per file) send a key to its
    file, of which only the key's own bytes are read.
    """
    files = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts = [r["first_key"] for r in files]
    info = [(r["folder"], r["shard"], r["ids_before"]) for r in files]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array(starts, np.int64)
        for batch in batches:
            batch["file"] = (np.searchsorted(edges, batch["doc_id"].to_numpy(), side="right") - 1).astype(np.int32)
            yield batch[batch["file"] >= 0]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at = None, -1
        for batch in batches:
            for file, part in batch.groupby("file"):
                folder, number, before = info[file]
                if file != at:
                    store, base = _store(folder)
                    shard, at = ShardFile(store.open_input_file(_path(base, number))), file
                for key in part["doc_id"].tolist():
                    first, n = shard.find(key)
                    for i in range(first, first + n):
                        yield _frame([(key, *shard.record(i))], number, before)

    wanted = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc_id")).distinct()
    if not files:
        return keys.sparkSession.createDataFrame([], RECORDS)
    routed = wanted.mapInPandas(route, "doc_id bigint, file int").repartitionById(len(files), F.col("file"))
    return routed.mapInPandas(load, RECORDS)


def encode_to_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write and read back: the records of all documents from their files."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or shared_dir(spark), **options))
