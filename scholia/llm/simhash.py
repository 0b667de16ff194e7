"""SimHash near-dedup: segment-popcount embedding.

Fingerprints (64 bits over shingles of words) are linked at MOST_BITS or fewer
differing bits. Each is embedded as the bit counts of its 16 segments of 4
bits. Flipping a bit moves the embedding by one step, so the Manhattan
distance of embeddings is at most the number of differing bits. Two points
within two steps of one another have a point within one step of both, so a
point goes to the grid cells of its own and its neighbours, and points are
joined by cell. Of three blocks of segments, two flips leave one as it was:
the grid is laid over the other two blocks, and its cells are told apart by
that block's bits. So a cell holds what agrees in 20 bits or more, however
many fingerprints there are. Last the bits are compared.

`near_duplicates` is that. `near_copies` finds texts whose sets of shingles
are SIMILARITY alike or more. Candidates are those whose sets' fingerprints the
embedding links as above. These are not all: at 0.8 some 10 of the bits differ,
where no cell separates. So fingerprints of samples are taken besides. The
PICKED shingles with the least values of as many hash functions are a sample,
which two texts share with the probability likeness ** PICKED; there are so many
samples that a pair is missed once in MISSED times. Fingerprints of samples are
joined at distance zero, where a cell is the fingerprint. Then the sets of all
candidates are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_named, materialize, shuffle_width, text_mark, texts_of, unplaced
from .components import components
from .linking import connect, shared_cells
from .tokens import text_batches
from .words import data_of, gram_hashes, lower_table, mix, span_hashes, spans

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: The segments of the blocks.
BLOCKS = [range(0, 5), range(5, 10), range(10, 16)]
#: Of near copies: words of a shingle, least likeness, shingles of a sample, and that one pair in so many is missed at that likeness.
WORDS, SIMILARITY, PICKED, MISSED = 5, 0.8, 5, 2000
#: Members that are compared at once, on either side, and values of their sets.
BLOCK, BLOCK_VALUES = 256, 1 << 19
#: Members of a crowded cell that tell which of its shingles are common, and those that share a rare one and are still paired one by one.
SAMPLED, CROWD = 64, 64
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_SETS = "row long, doc_id long, mark string, h1 long, h2 long, n long, fp long, cells array<long>, shingles array<int>"


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[SHINGLE - 1 :].tolist()
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    counts, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 4096):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + 4096], stops[i : i + 4096], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_batches(batch):
            found = [fingerprint(t.as_buffer().to_pybytes()) for t in pc.cast(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def _embedding(fp: Column) -> Column:
    """Bit counts of 16 segments, one to four bits of a long."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in range(1, 4)), fp.bitwiseAND(ones))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(fp: Column) -> Column:
    """The cells of a fingerprint: for each block, those within one step of the embedding
    of the other blocks, with the block's bits."""
    cells = []
    for j, block in enumerate(BLOCKS):
        mask = sum(0xF << 4 * i for i in block)
        own = fp.bitwiseAND(F.lit(_signed(mask)))
        rest = _embedding(fp.bitwiseAND(F.lit(_signed(~mask & (1 << 64) - 1))))
        cell = lambda v, j=j, own=own: F.xxhash64(F.lit(j), own, v)
        cells.append(cell(rest))
        for i in sorted(set(range(16)) - set(block)):
            count = F.shiftrightunsigned(rest, 4 * i).bitwiseAND(F.lit(7))
            step = F.lit(1 << 4 * i).cast("long")
            cells += [F.when(count < 4, cell(rest + step)), F.when(count > 0, cell(rest - step))]
    return F.array_compact(F.array(*cells))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp), links (a, b) at most MOST_BITS bits apart that
    connect all that are connected by such links."""
    # A fingerprint makes 67 rows, so small partitions are kept apart.
    dealt = fps.select("fp").repartition(shuffle_width(fps.sparkSession), unplaced(F.col("fp")))
    members = dealt.select(F.col("fp").alias("node"), F.explode(_cells(F.col("fp"))).alias("cell"))

    def rest(open_: DataFrame) -> DataFrame:
        other = open_.select("cell", F.col("node").alias("b"), F.col("label").alias("of"))
        pairs = open_.where("stray").select("cell", F.col("node").alias("a"), "label").join(other, "cell").where((F.col("label") != F.col("of")) & _near("a", "b"))
        return materialize(pairs.groupBy("a", "of").agg(F.min("b").alias("b")).select("a", "b"), "links")

    return connect(shared_cells(members), lambda pairs: materialize(pairs.where(_near("a", "b")), "links"), rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, fingerprint, component_id (the smallest doc_id that
    links reach).

    Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows keep their number. A null doc_id is larger than any
    other; a component of such rows alone has no id.
    """
    rows = materialize(texts_of(docs).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(fps.select("fp")))
    labelled = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # Dealt anew for the joins: one component, or one fingerprint, may have a third of all rows.
    labels = labelled.select("fp", "root").join(ids.withColumn("root", unplaced(F.col("root"))), "root").select(unplaced(F.col("fp")).alias("fp"), "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def samples_for(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISSED) / -math.log1p(-(min(similarity, 0.999) ** PICKED))))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text, the ascending distinct hashes of k words; of a text of fewer words,
    that of all of them."""
    data, offsets = data_of(texts)
    data = lower_table()[data]
    inside = np.ones(256, bool)
    inside[_SPACE] = False
    starts, ends, counts = spans(inside[data], offsets)
    words = span_hashes(data, starts, ends)
    full, out = gram_hashes(words, k), []
    for lo, hi in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        out.append(np.unique(full[lo : hi - k + 1] if hi - lo >= k else gram_hashes(words[lo:hi], hi - lo)))
    return out


def sample_fingerprints(flat: np.ndarray, at: np.ndarray, samples: int) -> np.ndarray:
    """The SimHash of each sample of each set: PICKED shingles a sample, a bit being 1 if
    it is set in over half of them. Sets start at the positions `at`."""
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 32, (samples, PICKED), np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, (samples, PICKED), np.uint32)
    low, out = (flat >> np.uint64(32)).astype(np.uint32), np.zeros((len(at), samples), np.uint64)
    for j in range(samples):
        # A hash function is one-to-one, so its least value stands for the shingle.
        least = [mix(np.minimum.reduceat(low * a + b, at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for a, b in zip(odd[j], shift[j], strict=True)]
        bits = sum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1) for h in least)
        out[:, j] = np.packbits(2 * bits > PICKED, axis=1).view(np.uint64)[:, 0]
    return out


def set_fingerprints(flat: np.ndarray, at: np.ndarray, width: int = 1 << 15) -> np.ndarray:
    """The SimHash of each set, a bit being 1 if it is set in over half of its shingles, of
    which `width` are looked at at once. Sets start at the ascending positions `at`."""
    counts, sizes = np.zeros((len(at), 64), np.int64), np.diff(np.append(at, len(flat)))
    for lo in range(0, len(flat), width):
        part = flat[lo : lo + width]
        a, b = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(part))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        counts[a:b] += np.add.reduceat(bits, np.maximum(at[a:b] - lo, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(np.uint64)[:, 0]


def _sets(k: int, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        number = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            for rows, texts in text_batches(batch):
                sets = shingle_sets(texts, k)
                n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                held = np.flatnonzero(sizes)
                marks, cells = np.zeros((2, n), np.uint64), np.zeros((len(held), samples), np.uint64)
                prints = np.zeros(n, np.uint64)
                if len(held):
                    at = ends[held]
                    prints[held] = set_fingerprints(flat, at)
                    for i in range(2):
                        marks[i, held] = mix(np.add.reduceat(mix(flat ^ np.uint64(i + 1)), at) ^ sizes[held].astype(np.uint64))
                    cells = mix(sample_fingerprints(flat, at, samples) ^ number)
                stops = np.concatenate([[0], np.cumsum(np.where(sizes > 0, samples, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + n), pa.int64()), rows.column("doc_id"), pc.cast(rows.column("mark"), pa.string()), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), pa.array(sizes), pa.array(prints.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(stops), pa.array(cells.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                    ],
                    names=["row", "doc_id", "mark", "h1", "h2", "n", "fp", "cells", "shingles"],
                )
                row += n

    return run


def _like(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared) >= similarity


def like_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float, width: int = 4096) -> np.ndarray:
    """For each set of the left and each of the right, whether they are like enough; the
    shared values are counted `width` at a time."""
    sizes = [np.array([len(s) for s in side], np.float64) for side in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes).astype(np.int64))
    values, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    shared = np.zeros((len(left), len(right)))
    for lo in range(0, len(values), width):
        a, b = np.searchsorted(number, [lo, lo + width])
        one = np.zeros((len(left) + len(right), width), np.float32)
        one[owner[a:b], number[a:b] - lo] = 1
        shared += one[: len(left)] @ one[len(left) :].T
    return shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9


def _by_group(keys: list[str], columns: list[str], each: Callable[[pd.DataFrame], list[tuple]]):
    """Rows that `each` makes of every group; rows come sorted by the keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for f in frames:
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            starts = np.flatnonzero((f[keys] != f[keys].shift()).any(axis=1).to_numpy()).tolist()
            found = [x for a, b in zip(starts, starts[1:], strict=False) for x in each(f.iloc[a:b])]
            kept = f.iloc[starts[-1] :] if starts else None
            yield pd.DataFrame(found, columns=columns)
        if kept is not None:
            yield pd.DataFrame(each(kept), columns=columns)

    return run


def _compare(similarity: float):
    """Links of rows (cell, i, j, side, node, label, shingles): those of side 0 with those
    of side 1 in the same block."""

    def links(f: pd.DataFrame) -> list[tuple[int, int]]:
        left, right = f[f.side == 0], f[f.side == 1]
        if not len(left) or not len(right):
            return []
        like = like_pairs([np.asarray(s) for s in left.shingles], [np.asarray(s) for s in right.shingles], similarity)
        like &= left.label.to_numpy()[:, None] != right.label.to_numpy()[None, :]
        node, labels, out = right.node.to_numpy(), right.label.to_numpy(), []
        for k, a in enumerate(left.node.tolist()):
            at = np.flatnonzero(like[k])
            out += [(a, int(node[at[x]])) for x in np.unique(labels[at], return_index=True)[1]]
        return out

    return _by_group(["cell", "i", "j"], ["a", "b"], links)


def rarest(shingles: np.ndarray, known: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of `times` (of the ascending `known`; 0 of
    others) and value, so many that two sets that are like enough share one of them."""
    own = np.unique(shingles)
    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
    often = np.where(known[at] == own, times[at], 0) if len(known) else np.zeros(len(own), np.int64)
    return own[np.lexsort((own, often))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]


def _rarest(similarity: float):
    """Of rows (cell, block, side, node, label, stray, shingles), the rarest shingles of
    those of side 1, as the cell's sample on side 0 has it."""

    def keys(f: pd.DataFrame) -> list[tuple]:
        sample = [np.unique(np.asarray(s)) for s in f.shingles[f.side == 0]]
        known, times = np.unique(np.concatenate([*sample, np.zeros(0, np.int32)]), return_counts=True)
        out = []
        for r in f[f.side == 1].itertuples():
            own = np.asarray(r.shingles)
            out += [(r.cell, r.node, r.label, r.stray, len(own), k) for k in rarest(own, known, times, similarity).tolist()]
        return out

    return _by_group(["cell", "block"], ["cell", "node", "label", "stray", "n", "shingle"], keys)


def _widths(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Of members (cell, node), how many blocks each cell takes, and of its members which
    share is a sample."""
    sized = members.join(sets.select(unplaced(F.col("node")).alias("node"), F.size("shingles").alias("n")), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int")
    share = F.least(SAMPLED / F.count("*"), BLOCK_VALUES / 2 / F.sum("n"))
    return sized.groupBy(unplaced(F.col("cell")).alias("cell")).agg(blocks.alias("width"), share.alias("share"))


def _dealt(members: DataFrame, widths: DataFrame) -> DataFrame:
    return members.join(widths, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("width")).cast("int"))


def rare_pairs(members: DataFrame, sets: DataFrame, widths: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of members (cell, node, label, stray) of crowded cells, candidate pairs (a, b), and
    the members of which all pairs of a cell are still to be compared. All like
    pairs of a stray with another label are among the two.

    In an order of a cell's shingles, two sets that are like enough share one of
    their first, some fifth of each at 0.8. The order is by how often a shingle
    occurs in a sample of the cell, so that what a template has in common comes
    last: pages with a template but otherwise unlike meet nowhere. Members that
    share a rare shingle with more than CROWD others aren't paired here.
    """
    dealt = _dealt(members, widths)
    sampled = dealt.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    every = F.explode(F.sequence(F.lit(0), F.col("width") - 1))
    shown = sampled.select("cell", "node", "label", "stray", F.lit(0).alias("side"), every.alias("block"))
    both = shown.unionByName(dealt.select("cell", "node", "label", "stray", F.lit(1).alias("side"), "block")).join(sets.withColumn("node", unplaced(F.col("node"))).hint("merge"), "node")
    grouped = both.repartition("cell", "block").sortWithinPartitions("cell", "block")
    made = grouped.mapInPandas(_rarest(similarity), "cell long, node long, label long, stray boolean, n int, shingle int")
    keyed = materialize(made.withColumn("key", F.xxhash64("cell", "shingle")).drop("shingle"), "rare-shingles")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("stray").alias("strays"), (F.min("label") != F.max("label")).alias("mixed"))
    sizes = sizes.where("size > 1 and strays and mixed").select(unplaced(F.col("key")).alias("key"), "size")
    shared = materialize(keyed.join(sizes, "key"), "rare-cells")
    few = shared.where(F.col("size") <= CROWD)
    left = few.where("stray").select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    right = few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6) & (F.col("la") != F.col("lb"))
    pairs = left.join(right, "key").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, shared.where(F.col("size") > CROWD).select("cell", "node", "label", "stray").distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (row, n, fp): of each fingerprint the first row with its others,
    and the first rows of those that the embedding links. Sets without a shingle have none."""
    held = nodes.where("n > 0")
    fps = materialize(held.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("rows")), "set-fingerprints")
    firsts = fps.select(unplaced(F.col("fp")).alias("fp"), "first")
    side = lambda end: firsts.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(end))
    links = link_fingerprints(fps.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    linked = links.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b")
    several = fps.where("rows > 1").select(unplaced(F.col("fp")).alias("fp"), F.col("first").alias("a"))
    equal = held.join(several, "fp").where("row <> a").select("a", F.col("row").alias("b"))
    return materialize(linked.union(equal), "fingerprint-pairs")


def link_sets(nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all nodes (row, n, fp, cells) that candidate pairs, like
    enough, connect. rows: row, shingles."""
    near = fingerprint_pairs(nodes)
    shared = shared_cells(nodes.select(F.col("row").alias("node"), F.explode("cells").alias("cell")))
    ends = near.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = shared.select("node").union(ends).distinct().select(unplaced(F.col("node")).alias("row"))
    # By a merge join at every size: the wanted rows are a share of all, so past small tables they can't be broadcast.
    sets = materialize(rows.select("row", "shingles").join(wanted.hint("merge"), "row").select(F.col("row").alias("node"), "shingles"), "shingle-sets")

    def star(pairs: DataFrame) -> DataFrame:
        side = lambda end, name: sets.select(unplaced(F.col("node")).alias(end), F.col("shingles").alias(name))
        found = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_like(F.col("x"), F.col("y"), similarity))
        return materialize(found.select("a", "b"), "links")

    def blocks(members: DataFrame, widths: DataFrame) -> DataFrame:
        """A cell's members are dealt to blocks; each pair of blocks is one small table."""
        dealt = _dealt(members, widths)
        every = F.explode(F.sequence(F.lit(0), F.col("width") - 1))
        left = dealt.where("stray").select("cell", "node", "label", F.lit(0).alias("side"), F.col("block").alias("i"), every.alias("j"))
        right = dealt.select("cell", "node", "label", F.lit(1).alias("side"), every.alias("i"), F.col("block").alias("j"))
        both = left.unionByName(right).join(sets.withColumn("node", unplaced(F.col("node"))).hint("merge"), "node")
        grouped = both.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return materialize(grouped.mapInPandas(_compare(similarity), "a long, b long").distinct(), "links")

    def rest(open_: DataFrame) -> DataFrame:
        """Cells of one block are compared as they are; of larger ones what shares a rare
        shingle, and only what many share is compared block by block."""
        widths = materialize(_widths(open_, sets), "widths")
        found = blocks(open_, widths.where("width = 1"))
        large = widths.where("width > 1")
        if large.isEmpty():
            return found
        pairs, crowd = rare_pairs(open_, sets, large, similarity)
        crowd = materialize(crowd, "crowd")
        found = found.union(star(pairs))
        return found if crowd.isEmpty() else found.union(blocks(crowd, materialize(_widths(crowd, sets), "widths")))

    return connect(shared, lambda pairs: star(pairs.union(near).distinct()), rest)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row a document: doc_id, mark (of its text), group (a number; near copies and
    what they reach have the same), kept (whether it is the row that stays: the one
    with the smallest doc_id of its group, a null being larger than any other, and
    of equal ones the smallest mark).

    Null and wordless texts are alike. Rows that share doc_id and text are both kept or neither.
    """
    made = texts_of(docs, text_mark(F.col("text")).alias("mark")).mapInArrow(_sets(words, samples_for(similarity)), _SETS)
    rows = materialize(made, "shingles")
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    # Equal sets are one node: a row that stands for them.
    nodes = materialize(rows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.min("row").alias("row")), "nodes")
    cells = rows.select("row", "n", "fp", "cells").join(nodes.select("row"), "row")
    roots = components(link_sets(cells, rows, similarity))
    labelled = nodes.select("h1", "h2", "row", "least").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("group", F.coalesce("root", "row"))
    first = labelled.groupBy("group").agg(F.min("least").alias("first"))
    labels = labelled.select("h1", "h2", "group").join(first.withColumn("group", unplaced(F.col("group"))), "group")
    labels = labels.withColumn("h1", unplaced(F.col("h1")))
    return rows.select("doc_id", "mark", "h1", "h2").join(labels, ["h1", "h2"]).select("doc_id", "mark", "group", place.eqNullSafe(F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies stays, with all its columns; rows are
    told apart by doc_id and text, and of repeated rows one stays."""
    found = materialize(near_copies(docs, words, similarity).select("doc_id", "mark", "kept"), "near-copies")
    return keep_named(docs, found)
