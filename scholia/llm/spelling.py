"""Spelling variants: words one edit apart, by a Levenshtein automaton over trie shards.

The vocabulary, sorted, is cut into shards of at most SHARD_LETTERS letters.
Each is a trie of flat arrays, and shards go to the tasks in broadcasts of at
most SENT bytes, one broadcast after the other. A task intersects the
distance-one automaton of each of its words with every shard, depth first: it
follows the word's own path, and at each node of it branches once into an
inserted, a deleted or a replaced letter, after which only the rest of the
word is followed. A batch's words go down together, as numpy arrays of
states. Of runs of one letter only one place is edited, so each neighbour is
met once. What a task emits of a word and a shard is how many neighbours there
are, and the best one.

Words of more than LONGEST letters would make shards without a bound. They
are joined by 128-bit hashes of what is left without one letter: two words
are one replacement apart if they agree without the letter at one place, and
one insertion apart if one of them is the other without a letter. So every
joined pair is a pair of neighbours.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, texts_of
from .tokens import text_batches
from .words import mix

#: Every MISSPELT-th occurrence loses a letter; words have SHORTEST letters and LEAST occurrences; a form occurs TIMES as often.
MISSPELT, SHORTEST, LEAST, TIMES = 97, 5, 3, 2
#: Letters of the longest word in a trie and of a shard, and bytes of a broadcast.
LONGEST, SHARD_LETTERS, SENT = 64, 1 << 19, 24 << 20
#: Words that a task counts before it passes them on, and states that are worked on at once.
COUNTED, STATES = 200_000, 1 << 18
#: Latin-1 bytes of letters, A-Z lower-cased; all others end a word.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(text: str) -> Counter[bytes]:
    """How often each run of letters occurs, as Latin-1 bytes."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    total: dict[bytes, int] = {}
    for batch in batches:
        for rows, texts in text_batches(batch):
            for doc, text in zip(rows.column("doc_id").to_pylist(), texts.to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in words_of(text).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                    if h % MISSPELT == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= SHORTEST:
                        total[w] = total.get(w, 0) + n
                if len(total) >= COUNTED:
                    yield out()
                    total = {}
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of all documents."""
    part = texts_of(docs).mapInArrow(_counts, "word string, n long")
    # Dealt before the aggregate, whose partitions would be merged to fewer than there is work for.
    dealt = part.repartition(shuffle_width(docs.sparkSession), "word")
    return dealt.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Trie(NamedTuple):
    """Nodes in the order of their levels and, within one, of their words; 0 is the root.
    key: of each node but the root, parent * 256 + letter, ascending; first: the
    first child of each node and the end; n: occurrences of a node's word or 0."""

    label: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    first: np.ndarray
    n: np.ndarray
    rank: np.ndarray

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, 0 if there is none."""
        if not len(self.key):
            return np.zeros(len(node), np.int64)
        sought = node * 256 + letter
        at = np.searchsorted(self.key, sought)
        return np.where(self.key[np.minimum(at, len(self.key) - 1)] == sought, at + 1, 0)

    def spell(self, nodes: np.ndarray) -> list[str]:
        """The words of nodes."""
        letters, n = np.zeros((len(nodes), LONGEST + 1), np.uint8), np.zeros(len(nodes), np.int64)
        rows, now = np.arange(len(nodes)), nodes.copy()
        while len(rows):
            letters[rows, LONGEST - n[rows]] = self.label[now]
            n[rows] += 1
            now = self.parent[now]
            rows, now = rows[now > 0], now[now > 0]
        return [letters[i, LONGEST + 1 - k :].tobytes().decode("latin-1") for i, k in enumerate(n.tolist())]


def build(words: list[bytes], n: list[int]) -> dict[str, bytes]:
    """The arrays of a trie of ascending distinct words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
    node, own, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 1
    labels, parents = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)]
    live = np.arange(len(words))
    for d in range(int(size.max(initial=0))):
        live = live[size[live] > d]
        letter, above = flat[at[live] + d], node[live]
        new = np.ones(len(live), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (above[1:] != above[:-1])
        node[live] = total - 1 + np.cumsum(new)
        labels.append(letter[new])
        parents.append(above[new])
        total += int(new.sum())
        done = live[size[live] == d + 1]
        own[done] = node[done]
    as_bytes = lambda x, kind: np.asarray(x).astype(kind).tobytes()
    return {"label": as_bytes(np.concatenate(labels), np.uint8), "parent": as_bytes(np.concatenate(parents), np.int32), "node": as_bytes(own, np.int32), "n": as_bytes(n, np.int64)}


def load(label: bytes, parent: bytes, node: bytes, n: bytes) -> Trie:
    labels, above = np.frombuffer(label, np.uint8), np.frombuffer(parent, np.int32).astype(np.int64)
    own, times, rank = np.frombuffer(node, np.int32), np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
    times[own] = np.frombuffer(n, np.int64)
    rank[own] = np.arange(len(own))
    first = 1 + np.searchsorted(above[1:], np.arange(len(labels) + 1))
    return Trie(labels, above, above[1:] * 256 + labels[1:], first, times, rank)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words that come in ascending order, the tries."""
    words: list[bytes] = []
    n: list[int] = []
    letters = 0

    def out() -> pa.RecordBatch:
        trie = build(words, n)
        return pa.RecordBatch.from_arrays([pa.array([words[0].decode("latin-1")]), pa.array([sum(map(len, trie.values()))], pa.int64()), *(pa.array([x], pa.binary()) for x in trie.values())], names=["first", "bytes", *trie])

    for batch in batches:
        for w, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            w = w.encode("latin-1")
            if letters + len(w) > SHARD_LETTERS:
                yield out()
                words, n, letters = [], [], 0
            words.append(w)
            n.append(k)
            letters += len(w)
    if words:
        yield out()


def tries(words: DataFrame) -> DataFrame:
    """The vocabulary's shards: first word, bytes, and the arrays of the trie."""
    spark = words.sparkSession
    short = words.where(F.length("word") <= LONGEST)
    letters = short.agg(F.sum(F.length("word")).alias("x")).first()["x"] or 0
    dealt = short.repartitionByRange(1 + letters // SHARD_LETTERS, "word").sortWithinPartitions("word")
    return materialize(dealt.mapInArrow(_shards, "first string, bytes long, label binary, parent binary, node binary, n binary"), "tries") if letters else spark.createDataFrame([], "first string, bytes long, label binary, parent binary, node binary, n binary")


def one_edit(trie: Trie, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (word, node) of words and the nodes whose words are one edit away. The
    words start at `at` in data, which ends with zeros; no letter is zero."""
    words_found, nodes_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def follow(word: np.ndarray, node: np.ndarray, i: np.ndarray) -> None:
        """The rest of the words, after their edit."""
        while len(word):
            over = i == size[word]
            hit = over & (trie.n[node] > 0)
            words_found.append(word[hit])
            nodes_found.append(node[hit])
            word, node, i = word[~over], node[~over], i[~over]
            node = trie.child(node, data[at[word] + i])
            on = node > 0
            word, node, i = word[on], node[on], i[on] + 1

    stack = [(np.arange(len(at)), np.zeros(len(at), np.int64), 0)]
    while stack:
        word, node, depth = stack.pop()
        fan = trie.first[node + 1] - trie.first[node]
        if len(word) > 1 and fan.sum() > STATES:
            half = len(word) // 2
            stack += [(word[half:], node[half:], depth), (word[:half], node[:half], depth)]
            continue
        left = size[word] > depth
        letter = np.where(left, data[at[word] + depth], 0)
        # An inserted or replacing letter is any child but the word's own next one.
        row = np.repeat(np.arange(len(word)), fan)
        child = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + trie.first[node][row]
        other = trie.label[child] != letter[row]
        row, child = row[other], child[other]
        follow(word[row], child, np.full(len(row), depth))
        swap = left[row]
        follow(word[row[swap]], child[swap], np.full(int(swap.sum()), depth + 1))
        # Of equal letters the last one is deleted.
        gone = left & ((size[word] == depth + 1) | (data[at[word] + np.where(left, depth + 1, 0)] != letter))
        follow(word[gone], node[gone], np.full(int(gone.sum()), depth + 1))
        word, node = word[left], trie.child(node[left], letter[left])
        if (node > 0).any():
            stack.append((word[node > 0], node[node > 0], depth + 1))
    return np.concatenate(words_found), np.concatenate(nodes_found)


_loaded: dict[str, list[Trie]] = {}


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps the tries of one broadcast.
        if sent.value[0] not in _loaded:
            _loaded.clear()
            _loaded[sent.value[0]] = [load(*arrays) for arrays in sent.value[1]]
        shards = _loaded[sent.value[0]]
        for batch in batches:
            words = batch.column("word").to_pylist()
            coded = [w.encode("latin-1") for w in words]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            data = np.frombuffer(b"".join([*coded, b"\0\0"]), np.uint8)
            at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
            for trie in shards:
                word, node = one_edit(trie, data, at, size)
                order = np.lexsort((trie.rank[node], -trie.n[node], word))
                word, node = word[order], node[order]
                heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                near = np.diff(np.concatenate([heads, [len(word)]]))
                best = node[heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in word[heads].tolist()], pa.string()), pa.array(near, pa.int64()), pa.array(trie.n[best], pa.int64()), pa.array(trie.spell(best), pa.string())],
                    names=["word", "n_near", "form_n", "form"],
                )

    return run


_FOUND = "word string, n_near long, form_n long, form string"


def short_neighbours(words: DataFrame) -> DataFrame:
    """Of each word of LONGEST letters at most, and each shard with neighbours: word, n_near,
    form_n, form."""
    spark = words.sparkSession
    shards = tries(words)
    asked = words.where(F.length("word") <= LONGEST).select("word")
    found, group, held = [], [], 0
    listed = [(r["first"], r["bytes"]) for r in shards.select("first", "bytes").orderBy("first").collect()]
    for i, (first, size) in enumerate(listed):
        group.append(first)
        held += size
        if i + 1 == len(listed) or held + listed[i + 1][1] > SENT:
            arrays = [tuple(bytes(x) for x in r) for r in shards.where(F.col("first").between(group[0], group[-1])).select("label", "parent", "node", "n").collect()]
            sent = spark.sparkContext.broadcast((uuid.uuid4().hex, arrays))
            found.append(materialize(asked.mapInArrow(_search(sent), _FOUND), "near-words"))
            sent.destroy()
            group, held = [], 0
    out = spark.createDataFrame([], _FOUND)
    for f in found:
        out = out.unionByName(f)
    return out


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words (place -1) and of what is left of them without the letter at each
    place; last: whether the next letter is another one."""
    bases = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
    names = ["id", "n", "size", "place", "last", "h1", "h2"]
    for batch in batches:
        for w, mark, n in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True):
            letters = np.frombuffer(w.encode("latin-1"), np.uint8).astype(np.uint64)
            place = np.arange(-1, len(letters))
            last = np.concatenate([[False], letters[1:] != letters[:-1], [True]])
            sums = []
            for base in bases:
                powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(letters), base, np.uint64)]))
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(letters + np.uint64(1)) * powers[:-1])])
                # Letters after the place move one to the front.
                back = np.uint64(pow(base, -1, 1 << 64))
                sums.append(mix(np.concatenate([before[-1:], before[:-1] + (before[-1] - before[1:]) * back])).view(np.int64))
            for lo in range(0, len(place), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                k = len(place[part])
                columns = [[mark] * k, [n] * k, np.where(place[part] < 0, len(w), len(w) - 1), place[part], last[part], sums[0][part], sums[1][part]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def long_neighbours(words: DataFrame) -> DataFrame:
    """The same of pairs of which a word, or both, have more than LONGEST letters."""
    # Words go by a mark, so that long ones aren't sent once a letter.
    named = words.where(F.length("word") >= LONGEST).select("word", "n", F.md5("word").alias("id"))
    keys = materialize(named.mapInArrow(_without_one, "id string, n long, size long, place long, last boolean, h1 long, h2 long"), "word-keys")
    other = keys.select(F.col("id").alias("form_id"), F.col("n").alias("form_n"), "size", "place", "last", "h1", "h2")
    replaced = keys.where("place >= 0").join(other.where("place >= 0").drop("last"), ["size", "place", "h1", "h2"]).where("id <> form_id and size + 1 > " + str(LONGEST))
    shorter, longer = keys.where("place < 0").drop("place", "last"), other.where("last").drop("place", "last")
    inserted = shorter.join(longer, ["size", "h1", "h2"]).where("size + 1 > " + str(LONGEST)).select("id", "form_id", "n", "form_n")
    deleted = inserted.select(F.col("form_id").alias("id"), F.col("id").alias("form_id"), F.col("n").alias("form_n"))
    pairs = replaced.select("id", "form_id", "form_n").unionByName(inserted.select("id", "form_id", "form_n")).unionByName(deleted)
    best = pairs.join(named.select(F.col("word").alias("form"), F.col("id").alias("form_id")), "form_id").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    return best.join(named.select("id", "word"), "id").select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """Of (word, form), word and root: where forms end. A form occurs TIMES as often as its
    word, so a path has 62 steps at most, and each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(unplaced_word("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def unplaced_word(name: str) -> Column:
    """The same word, as a column by which no table is known to be dealt."""
    return F.concat(F.col(name), F.lit(""))


def group_variants(docs: DataFrame) -> DataFrame:
    """A row a word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z and a-z, U+00C0 to U+00FF), A-Z lower-cased, some
    of them with a letter left out by the checksum of their document and themselves;
    a null doc_id counts as an empty one there, a null text as none. Words have five
    letters and three occurrences over all documents. A row that repeats counts
    again. form: the most frequent word one edit away, of equal ones the smallest, if
    it occurs twice as often; root: where forms lead, the word itself without one.
    """
    words = materialize(vocabulary(docs), "words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    found = short_neighbours(words).unionByName(long_neighbours(words)).withColumn("n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    rows = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    held = F.coalesce(-F.col("b.m") >= TIMES * F.col("n"), F.lit(False))
    rows = materialize(rows.select("word", "n", "n_near", F.when(held, F.col("b.form")).alias("form"), F.when(held, -F.col("b.m")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
