"""Token-ID / binary output: a content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ids says so;
a chunk is kept once, under its digest. A document is a recipe, the list of its
chunks' digests, with the Merkle root over them. The manifest holds the
documents in ascending doc_id order with their start in the whole stream. The
roots hold, for each range of the stream, the number of its documents and ids
and the Merkle root over theirs, and so on up to one root over all. Reading
checks every digest, root and count, so what is lost or changed stops it.

Layout under the store's path, all Parquet:
  objects/kind=chunk   key (digest), n, ids (little-endian, 2 bytes an id where all fit, else 4)
  objects/kind=recipe  key (one a row), doc_id, n, parts (digest, n)
  manifest             doc_id, key, start, n, root
  roots                level, group, documents, ids, root: of each range, and of runs of ranges up to one over all
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, running_start, shared_dir, texts_of
from .crc import combine
from .tokens import encoder, text_batches, vocabulary

#: A cut needs these many ids in its chunk, comes once in so many (a power of two), and is forced at the most.
LEAST, EVERY, MOST, WINDOW = 64, 256, 1024, 8
END_ID = 2
MANIFEST = "doc_id long, key binary, start long, n long, root binary"
SCHEMA = "key binary, n long, ids binary, doc_id long, parts array<struct<digest:binary,n:int>>, kind string"
_ARROW = pa.schema([
    ("key", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("doc_id", pa.int64()),
    ("parts", pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))), ("kind", pa.string()),
])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which a rolling hash of the last WINDOW ids asks for a cut."""
    h = ids.astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    span = 1
    while span < WINDOW:  # the sum over 2 * span ids from two sums over span ids
        more = h.copy()
        more[span:] += h[:-span] << np.uint64(span) if len(h) > span else 0
        h, span = more, 2 * span
    return np.flatnonzero(h >> np.uint64(64 - EVERY.bit_length() + 1) == 0)


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the document whose ids lie at start:end."""
    out, at = [], start
    for c in cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, end)].tolist():
        while c + 1 - at > MOST:
            at += MOST
            out.append(at)
        if c + 1 - at >= LEAST and c + 1 < end:
            at = c + 1
            out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    return [*out, end]


def pack_ids(ids: np.ndarray) -> bytes:
    """Two bytes an id if all fit, else four; a first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype=f"<u{data[0]}").astype("<u4")


def _objects(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, row = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in text_batches(batch):
                flat, ends = enc.encode(texts)
                flat = np.insert(flat, ends, np.uint32(end_id))
                ends = ends + np.arange(1, len(ends) + 1)
                cuts, raw, start, lists = cut_points(flat), flat.astype("<u4").tobytes(), 0, [0]
                chunks: dict[bytes, tuple[int, int]] = {}
                digests: list[bytes] = []
                sizes: list[int] = []
                for end in ends.tolist():
                    at = start
                    for e in chunk_ends(cuts, start, end):
                        key = digest(raw[4 * at : 4 * e])
                        chunks.setdefault(key, (at, e))
                        digests.append(key)
                        sizes.append(e - at)
                        at = e
                    lists.append(len(digests))
                    start = end
                n, m = len(texts), len(chunks)
                yield pa.RecordBatch.from_arrays([
                    pa.array(chunks, pa.binary()), pa.array([e - a for a, e in chunks.values()], pa.int64()), pa.array([pack_ids(flat[a:e]) for a, e in chunks.values()], pa.binary()),
                    pa.nulls(m, pa.int64()), pa.nulls(m, _ARROW.field("parts").type), pa.array(["chunk"] * m),
                ], schema=_ARROW)
                parts = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], names=["digest", "n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{part}:{row + i}".encode() for i in range(n)], pa.binary()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.nulls(n, pa.binary()),
                    rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), parts), pa.array(["recipe"] * n),
                ], schema=_ARROW)
                row += n

    return run


def _document_roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        roots = [merkle([p["digest"] for p in parts]) for parts in f.parts]
        yield f[["doc_id", "key", "start", "n"]].assign(root=roots)


#: Ids of a range of documents, 2 ** this, and ranges under one root of the next level, 2 ** that.
RANGE_BITS, LEVEL_BITS = 22, 10
_ROOTS = "level int, group long, documents long, ids long, root binary"


def _group_roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        roots = [merkle([bytes(x["leaf"]) for x in leaves]) for leaves in f.leaves]
        yield f[["level", "group", "documents", "ids"]].assign(root=roots)


def range_roots(manifest: DataFrame) -> DataFrame:
    """level, group, documents, ids, root: at level 0 a row for each range of documents, by
    where they start in the stream of ids; above, for each run of ranges, up to one
    row over all. A leaf is a document's root with its doc_id, start and size."""
    last = manifest.agg(F.max("start")).first()[0]
    said = F.encode(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n"), "utf-8")
    rows = manifest.select(
        F.shiftright("start", RANGE_BITS).alias("group"), F.struct("start", F.concat("root", said).alias("leaf")).alias("leaf"), F.lit(1).cast("long").alias("documents"), F.col("n").alias("ids"),
    )
    found, level, groups = [], 0, 0 if last is None else (last >> RANGE_BITS) + 1
    while True:
        sums = [F.sort_array(F.collect_list("leaf")).alias("leaves"), F.sum("documents").alias("documents"), F.sum("ids").alias("ids")]
        made = rows.groupBy("group").agg(*sums).withColumn("level", F.lit(level)).mapInPandas(_group_roots, _ROOTS)
        found.append(materialize(made, "roots"))
        if groups <= 1:
            break
        groups, level = (groups - 1 >> LEVEL_BITS) + 1, level + 1
        rows = found[-1].select(F.shiftright("group", LEVEL_BITS).alias("group"), F.struct(F.col("group").alias("start"), F.col("root").alias("leaf")).alias("leaf"), "documents", "ids")
    return reduce(DataFrame.unionByName, found)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode all texts (null: empty), end each with end_id, and write the store.

    Repeated rows are documents of their own, in the order in which they are
    read; a null doc_id comes first.
    """
    spark = docs.sparkSession
    rows = texts_of(docs).mapInArrow(_objects(tokenizer or vocabulary(), end_id), SCHEMA)
    rows.dropDuplicates(["key"]).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    recipes = spark.read.schema(SCHEMA).parquet(f"{path}/objects").where("kind = 'recipe'")
    placed = running_start(recipes.select("doc_id", "key", "n", "parts"), "doc_id", ["key"], "n", "start")
    manifest = placed.mapInPandas(_document_roots, MANIFEST)
    manifest.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/manifest")
    range_roots(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")).coalesce(1).write.parquet(f"{path}/roots")


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, if its documents give the roots that were written with it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    written, now = spark.read.schema(_ROOTS).parquet(f"{path}/roots"), range_roots(manifest)
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("documents", "ids", "root")]
    both = written.alias("w").join(now.alias("f"), ["level", "group"], "full")
    if not both.where(~(same[0] & same[1] & same[2])).isEmpty():
        raise ValueError("the manifest's documents don't give its roots")
    return manifest


def _checked(key: bytes, data: bytes) -> bytes:
    """A chunk's ids, four bytes each, if its digest is right."""
    raw = unpack_ids(data).tobytes()
    if digest(raw) != bytes(key):
        raise ValueError(f"chunk {bytes(key).hex()} is damaged")
    return raw


def _checked_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        raw = [_checked(k, x) for k, x in zip(f.key, f.ids, strict=True)]
        yield pd.DataFrame({"digest": f.key, "size": [len(x) for x in raw], "crc": [zlib.crc32(x) for x in raw]})


def _check_document(parts, root: bytes, n: int, size: str) -> None:
    """Raise unless a document's chunks are all there (else their values are None, or not
    a number) and give its root."""
    if parts is None or any(p[size] is None or p[size] != p[size] for p in parts) or merkle([p["digest"] for p in parts]) != bytes(root):
        raise ValueError("a document's recipe or chunks are lost or damaged")
    if sum(p[size] if size == "size" else len(p[size]) for p in parts) != 4 * n:
        raise ValueError("a document's chunks don't hold as many ids as it has")


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        crcs = []
        for parts, root, n in zip(f.parts, f.root, f.n, strict=True):
            _check_document(parts, root, n, "size")
            crc = 0
            for p in parts:
                crc = combine(crc, int(p["crc"]), int(p["size"]))
            crcs.append(crc)
        yield pd.DataFrame({"doc_id": f.doc_id, "start": f.start, "n_tokens": f.n, "ids_crc32": crcs, "n_chunks": [len(p) for p in f.parts]})


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts = []
        for parts, root, n in zip(f.parts, f.root, f.n, strict=True):
            own = None if parts is None else [{"digest": p["digest"], "ids": None if p["ids"] is None else _checked(p["digest"], p["ids"])} for p in parts]
            _check_document(own, root, n, "ids")
            texts.append(b"".join(p["ids"] for p in own))
        yield pd.DataFrame({"doc_id": f.doc_id, "start": f.start, "ids": texts})


def _documents(spark: SparkSession, path: str, chunks: DataFrame, *values: str) -> DataFrame:
    """The manifest with each document's chunks (parts: digest and values), null where its
    recipe is lost; a lost chunk has null values."""
    recipes = spark.read.schema(SCHEMA).parquet(f"{path}/objects").where("kind = 'recipe'")
    each = recipes.select("key", F.posexplode("parts").alias("seq", "part")).select("key", "seq", F.col("part.digest").alias("digest"))
    lists = each.join(chunks, "digest", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", *values))).alias("parts"))
    return checked_manifest(spark, path).join(lists, "key", "left")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/objects").where("kind = 'chunk'").select("key", "ids")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back and verify every chunk by its digest, every document by its
    Merkle root and the manifest by the roots over its ranges: doc_id, start,
    n_tokens, ids_crc32, n_chunks. The checksum of a document is combined from
    those of its chunks, so no ids are shuffled. Whatever is lost raises."""
    chunks = _chunks(spark, path).mapInPandas(_checked_chunks, "digest binary, size int, crc long")
    return _documents(spark, path, chunks, "size", "crc").mapInPandas(_verified, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids again, verified likewise: doc_id, start, ids (bytes, four an id)."""
    return _documents(spark, path, _chunks(spark, path).withColumnRenamed("key", "digest"), "ids").mapInPandas(_joined, "doc_id long, start long, ids binary")


def store_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write a store in the shared folder and return what reading it back gives."""
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, path)
    return read_index(spark, path)
