"""Texts that are lightly changed copies of each other, found through an index of positional bytes.

1. Fingerprint. A text's set of word sequences gets ``POSITIONS`` min-hashes; position i of the fingerprint holds
   two bytes of the i-th. Two texts agree in a position with the probability of their Jaccard similarity.
2. Inverted index. Posting lists are keyed by the bytes of a block of ``WIDTH`` neighbouring positions, because a
   list for one byte of one position would hold 1/256 of all texts and its pairs would grow with the square. The
   positions lie in a grid whose rows and columns are both cut into blocks, so each serves in two of them. A posting
   names its text's class by all 64 bits, and has the size of the text's set in eighths of a doubling: sets whose sizes
   differ by more than the threshold allows are not tallied. Postings travel as packed arrays, one row per task and
   slice of the key space, and each slice is sorted and read in one task.
3. Candidates. The shared blocks of a pair are tallied over all slices. A pair at the threshold of one half shares each
   of the 192 blocks with probability 1/16, 12 of them on average, and is kept from ``MIN_BLOCKS`` on: ``missed()`` tells
   how often fewer are shared. A list of more than ``HOT`` postings isn't read in one task: it is cut into segments of
   about ``SEGMENT`` texts, and every two segments are compared by themselves, by the count of step 4.
4. Count filter. The positional bytes that a pair shares are counted. At the threshold they number ``least_matches`` or
   more but for a chance of ``EPSILON`` (Hoeffding's bound); fewer drop the pair.
5. Verification. The exact similarity of the pairs that are left, from the whole texts.

Texts with the same words are one class and enter the index once; a class gives all pairs of its texts, and linked
classes all pairs of theirs. Only byte-identical copies are spared some of it: of a text that stands more than ``COPIES``
times, the smallest id is paired with the others and represents them in all other pairs, so no link between
different texts is lost and the square of the copies isn't written out.

Defined results: null texts and texts under ``min_words`` words take no part; repeated rows are one record; an id
whose rows have different texts takes part with each of them, never paired with itself; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.words import WordHashes, hashed_words, mix, shingles
from sedimenta.operators.graph import components
from sedimenta.sources import materialize

GRID, WIDTH = (16, 24), 4  # positions lie in a grid; its rows and its columns are cut into blocks
POSITIONS = GRID[0] * GRID[1]
MIN_BLOCKS = 2
COPIES = 64
BATCH = 256  # texts whose sequences fit a core's cache
BUFFER = 16_384  # texts whose postings are packed into one row a slice
SLICE_POSTINGS = 4_000_000  # postings a task sorts at a time
HOT, SEGMENT = 2048, 512  # postings of a list that is read at once; texts of a segment of a longer one
HOT_IN_BUFFER = 256  # postings of one list in a buffer from which on they go round its slice
EPSILON = 1e-9
BROADCAST_IDS = 200_000

_grid = np.arange(POSITIONS).reshape(GRID)
BLOCK_POSITIONS = np.concatenate([_grid.reshape(-1, WIDTH), np.ascontiguousarray(_grid.T).reshape(-1, WIDTH)])
BLOCKS = len(BLOCK_POSITIONS)
_draw = np.random.default_rng(20_240_229)
_XOR = _draw.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 32, POSITIONS, dtype=np.uint32) | np.uint32(1)


def least_matches(threshold: float) -> int:
    """Positional bytes that a pair at the threshold shares at least, but for a chance of ``EPSILON``."""
    return max(1, int(np.floor(POSITIONS * threshold - np.sqrt(POSITIONS * np.log(1 / EPSILON) / 2))))


def missed(similarity: float, draws: int = 200_000, seed: int = 1) -> float:
    """Simulated share of pairs of a similarity that share fewer than ``MIN_BLOCKS`` blocks."""
    rng, few = np.random.default_rng(seed), 0
    for _ in range(draws // 10_000):
        equal = rng.random((10_000, POSITIONS)) < similarity
        few += int(np.count_nonzero(equal[:, BLOCK_POSITIONS].all(axis=2).sum(axis=1) < MIN_BLOCKS))
    return few / (draws // 10_000 * 10_000)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _classes(tag: int, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.array([xxhash.xxh3_64_intdigest(words[e - c : e].tobytes(), seed=tag) for e, c in zip(ends, counts)], dtype=np.uint64)


def _read(batch: pa.RecordBatch, memory: WordHashes, min_words: int, size: int = BATCH):
    """Parts of a batch: row numbers, classes, word hashes, counts; of the texts with enough words only."""
    tags, texts = batch.column("tag").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
    for at in range(0, len(texts), size):
        words, counts = hashed_words(texts[at : at + size], memory)
        enough = counts >= min_words
        if enough.any():
            words = words[np.repeat(enough, counts)]
            rows, counts = at + np.flatnonzero(enough), counts[enough]
            for tag in np.unique(tags[rows]):
                own = tags[rows] == tag
                w = words[np.repeat(own, counts)]
                yield int(tag), rows[own], _classes(int(tag), w, counts[own]), w, counts[own]


def fingerprints(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, POSITIONS) two bytes each."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((POSITIONS, len(starts)), dtype=np.uint32)
    work = np.empty_like(x)
    for i in range(POSITIONS):
        np.bitwise_xor(x, _XOR[i], out=work)
        np.multiply(work, _ODD[i], out=work)
        np.minimum.reduceat(work, starts, out=out[i])
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T


def block_keys(tag: int, prints: np.ndarray) -> np.ndarray:
    """(texts, BLOCKS) keys: a block's number and all its positional bytes."""
    key = np.broadcast_to(mix(np.arange(1, BLOCKS + 1, dtype=np.uint64) + np.uint64(tag * BLOCKS)), (len(prints), BLOCKS)).copy()
    for k in range(WIDTH):
        key ^= prints[:, BLOCK_POSITIONS[:, k]].astype(np.uint64) << np.uint64(16 * k)
    return mix(key)


def _membership(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            parts = list(_read(batch, memory, min_words))
            if parts:
                rows = np.concatenate([p[1] for p in parts])
                cls = _signed(np.concatenate([p[2] for p in parts]))
                tags = np.concatenate([np.full(len(p[1]), p[0], dtype=np.int32) for p in parts])
                texts = batch.column("text").take(pa.array(rows)).to_pylist()
                copy = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(tags), batch.column("id").take(pa.array(rows)), pa.array(cls), pa.array(_signed(copy))], ["tag", "id", "cls", "copy"])

    return run


POSTINGS = ("slice", "keys", "refs", "names", "extents")


def _postings(min_words: int, width: int, slices: int, hot: int):
    """Packed postings, a row a slice. Those of a key that a buffer has more than ``hot`` times go to partitions behind
    the slices, and the slice is told of the key by one posting of class 0."""

    def pack(keys: list, classes: list, extents: list) -> pa.RecordBatch:
        key, known, sizes_of = np.concatenate(keys).ravel(), np.append(np.concatenate(classes), np.uint64(0)), np.append(np.concatenate(extents), np.uint8(0))
        at, key = key % np.uint64(slices), key >> np.uint64(32)
        order = np.argsort(at << np.uint64(32) | key)
        at, key, own = at[order], key[order], np.repeat(np.arange(len(known) - 1), BLOCKS)[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(first, len(key)))
        often = np.repeat(sizes > hot, sizes)
        lists, beside = (at << np.uint64(32) | key)[often], known[own[often]]
        own[first[sizes > hot]] = len(known) - 1
        keep = ~often
        keep[first] = True
        at, key, own = at[keep], key[keep].astype(np.uint32), own[keep]
        cut = np.searchsorted(at, np.arange(slices + 1, dtype=np.uint64))
        rows = []
        for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            local = own[cut[s] : cut[s + 1]]
            names, refs = np.unique(local, return_inverse=True)
            if 9 * len(names) + 2 * len(local) > 9 * len(local) or len(names) > 1 << 16:  # a list of the classes only where it takes less room
                names, refs = local, local[:0]
            rows.append((s, key[cut[s] : cut[s + 1]].tobytes(), refs.astype(np.uint16).tobytes(), known[names].tobytes(), sizes_of[names].tobytes()))
        if len(lists):
            rows.append((slices + int(beside[0] % np.uint64(slices)), lists.tobytes(), b"", beside.tobytes(), b""))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], list(POSTINGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen, keys, classes, extents, held = WordHashes(), set(), [], [], [], 0
        for batch in batches:
            for tag, _, cls, words, counts in _read(batch, memory, min_words):
                new = np.zeros(len(cls), dtype=bool)
                for i, c in enumerate(cls.tolist()):  # copies met before in this task are already indexed
                    if c not in seen:
                        new[i] = True
                        seen.add(c)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not new.any():
                    continue
                words, counts, cls = words[np.repeat(new, counts)], counts[new], cls[new]
                x, starts = shingles(words, counts, width)
                keys.append(block_keys(tag, fingerprints(x, starts)))
                classes.append(cls)
                sizes = np.array([len(np.unique(own)) for own in np.split(x, starts[1:])])
                extents.append(np.floor(np.log2(sizes) * 8).astype(np.uint8))
                held += len(cls)
                if held >= BUFFER:
                    yield pack(keys, classes, extents)
                    keys, classes, extents, held = [], [], [], 0
        if held:
            yield pack(keys, classes, extents)

    return run


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
    n = np.broadcast_to(np.int32(n) if isinstance(n, int) else n.astype(np.int32), a.shape)
    return pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(_signed(b)), pa.array(n)], ["a", "b", "n"])


def _tallied(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.argsort(a * np.uint64(0x9E3779B97F4A7C15) ^ b)  # equal pairs become neighbours; where others come between, they are summed later
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return _rows(a[first], b[first], np.diff(np.append(first, len(a))))


def _shared_blocks(threshold: float, slices: int, hot: int):
    """All postings of a slice in; out, piece by piece, pairs of classes with the number of blocks they share in it, and
    the postings of hot lists as (list, class, -1)."""
    reach = int(np.ceil(8 * np.log2(1 / threshold))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, list, list] = ([], [], [])
        number = 0
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                key, refs, names, extents = (batch.column(c)[i].as_buffer() for c in POSTINGS[1:])
                names, refs = np.frombuffer(names, dtype=np.uint64), np.frombuffer(refs, dtype=np.uint16)
                if number >= slices:
                    yield _rows(np.frombuffer(key, dtype=np.uint64), names, -1)
                    continue
                extents = np.frombuffer(extents, dtype=np.uint8)
                for parts, own in zip(columns, (np.frombuffer(key, dtype=np.uint32), names[refs] if len(refs) else names, extents[refs] if len(refs) else extents)):
                    parts.append(own)
        if not columns[0]:
            return
        key, cls, extent = (np.concatenate(parts) for parts in columns)
        for parts in columns:
            parts.clear()
        order = np.argsort(key.astype(np.uint64) << np.uint64(32) | cls >> np.uint64(32))
        key, cls, extent = key[order], cls[order], extent[order].astype(np.int16)
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls, extent = key[once], cls[once], extent[once]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        known = np.logical_or.reduceat(cls == 0, first)
        often = np.repeat(known | (sizes > hot), sizes)
        if often.any():
            lists = np.uint64(number) << np.uint64(32) | key[often].astype(np.uint64)
            member = cls[often] != 0
            yield _rows(lists[member], cls[often][member], -1)
            key, cls, extent = key[~often], cls[~often], extent[~often]
        at, step, left, right, held = np.arange(len(key)), 0, [], [], 0
        while True:  # the pairs at distance 1, 2, ... within the lists; no list is longer than ``hot``
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            for part in np.array_split(at, len(at) // 1_000_000 + 1):
                part = part[(np.abs(extent[part] - extent[part + step]) <= reach) & (cls[part] != cls[part + step])]
                left.append(np.minimum(cls[part], cls[part + step]))
                right.append(np.maximum(cls[part], cls[part + step]))
                held += len(part)
                if held >= 2_000_000:
                    yield _tallied(left, right)
                    left, right, held = [], [], 0
        if held:
            yield _tallied(left, right)

    return run


def _sets(min_words: int, width: int):
    """(tag, cls, print, items): a class's positional bytes, one a position, and the hashes of its word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            tags, classes, prints, sets = [], [], [], []
            for tag, _, cls, words, counts in _read(batch, memory, min_words):
                x, starts = shingles(words, counts, width)
                tags += [tag] * len(cls)
                classes.append(cls)
                prints += [row.tobytes() for row in fingerprints(x, starts).astype(np.uint8)]
                sets += [np.unique(own).tobytes() for own in np.split(x, starts[1:])]
            if tags:
                yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int32()), pa.array(_signed(np.concatenate(classes))), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["tag", "cls", "print", "items"])

    return run


def _similar(threshold: float, least: int):
    """Pairs that share the positional bytes they must, and whose sets are really similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(f"print_{s}")[i].as_buffer(), dtype=np.uint8) for s in "ab")
                if np.count_nonzero(a == b) < least:
                    continue
                x, y = (np.frombuffer(batch.column(f"items_{s}")[i].as_buffer(), dtype=np.uint64) for s in "ab")
                z = np.concatenate([x, y])
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep[i] = both / (len(z) - both) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _compared(least: int):
    """Pairs of two segments of a hot list that share the positional bytes they must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for s in ("left", "right"):
                    members = batch.column(s)[i].values
                    cls = members.field("cls").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    sides.append((cls, np.frombuffer(b"".join(members.field("print").to_pylist()), dtype=np.uint8).reshape(len(cls), POSITIONS)))
                (x, prints), (y, others) = sides
                at = [(k, np.flatnonzero((others == own).sum(axis=1) >= least)) for k, own in enumerate(prints)]
                p, q = np.concatenate([np.full(len(m), x[k]) for k, m in at]), np.concatenate([y[m] for _, m in at])
                p, q = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(p)), pa.array(_signed(q))], ["a", "b"])

    return run


def _hot_pairs(hot: DataFrame, sets: DataFrame, least: int, segment: int) -> DataFrame:
    """(a, b) out of (list, cls): a list's segments meet two by two, each meeting a row of its own wherever it is joined."""
    sizes = hot.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / segment).cast("int").alias("parts"))
    placed = hot.join(sizes, "list").withColumn("segment", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    packed = placed.join(sets.select("cls", "print"), "cls").groupBy("list", "parts", "segment").agg(F.collect_list(F.struct("cls", "print")).alias("members"))
    packed = materialize(packed, "segments")
    left = packed.select("list", F.col("segment").alias("i"), F.explode(F.sequence(F.col("segment"), F.col("parts") - 1)).alias("j"), F.col("members").alias("left"))
    right = packed.select("list", F.explode(F.sequence(F.lit(0), F.col("segment"))).alias("i"), F.col("segment").alias("j"), F.col("members").alias("right"))
    return left.hint("shuffle_merge").join(right, ["list", "i", "j"]).select("left", "right").mapInArrow(_compared(least), "a long, b long")


def class_links(texts: DataFrame, classes: DataFrame, width: int, min_words: int, threshold: float, hot: int = HOT, segment: int = SEGMENT, hot_in_buffer: int = HOT_IN_BUFFER) -> DataFrame:
    """Pairs (a, b) of classes whose texts differ and are at least ``threshold`` similar."""
    spark, least = texts.sparkSession, least_matches(threshold)
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * BLOCKS // SLICE_POSTINGS))
    packed = texts.select("tag", "text").mapInArrow(_postings(min_words, width, slices, hot_in_buffer), "slice int, keys binary, refs binary, names binary, extents binary")
    shared = packed.repartitionById(2 * slices, F.col("slice")).mapInArrow(_shared_blocks(threshold, slices, hot), "a long, b long, n int")
    counted = materialize(shared.groupBy("a", "b").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_BLOCKS) | (F.col("n") < 0)), "counted")
    pairs, lists = counted.where("n > 0").select("a", "b"), counted.where("n < 0").select(F.col("a").alias("list"), F.col("b").alias("cls"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(lists.select("cls")).distinct()
    representatives = materialize(classes.join(wanted, "cls", "left_semi").select("tag", F.col("head").alias("id")), "representatives")
    if representatives.count() <= BROADCAST_IDS:  # else the join below shuffles
        representatives = F.broadcast(representatives)
    sets = materialize(texts.join(representatives, ["tag", "id"], "left_semi").mapInArrow(_sets(min_words, width), "tag int, cls long, print binary, items binary").dropDuplicates(["cls"]), "sets")
    if not lists.isEmpty():
        pairs = materialize(pairs.unionByName(_hot_pairs(lists, sets, least, segment)).distinct(), "pairs")
    left, right = (sets.select(F.col("tag").alias(f"tag_{s}"), F.col("cls").alias(s), F.col("print").alias(f"print_{s}"), F.col("items").alias(f"items_{s}")) for s in "ab")
    return pairs.join(left, "a").join(right, "b").where("tag_a = tag_b").drop("tag_a", "tag_b").mapInArrow(_similar(threshold, least), "a long, b long")


def _linked(tables: dict[str, DataFrame], width: int, min_words: int, threshold: float) -> tuple[Column, DataFrame, DataFrame]:
    """The table's name by its tag, (tag, id, cls, copy) of all texts that take part, and (a, b) of linked classes."""
    names = sorted(tables)
    texts = None
    for tag, name in enumerate(names):
        part = tables[name].toDF("id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(F.lit(tag).alias("tag"), "id", "text")
        texts = part if texts is None else texts.unionByName(part)
    members = materialize(texts.mapInArrow(_membership(min_words), "tag int, id long, cls long, copy long").distinct(), "members")
    classes = materialize(members.groupBy("cls").agg(F.min("tag").alias("tag"), F.min("id").alias("head")), "classes")  # a class has one tag
    links = materialize(class_links(texts, classes, width, min_words, threshold), "links")
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tag") + 1).alias("table_name"), members, links


def near_duplicate_pairs(tables: dict[str, DataFrame], width: int = 3, min_words: int = 20, threshold: float = 0.5) -> DataFrame:
    """(table_name, id_a, id_b) of the tables' (id, text) rows; texts are compared within their own table."""
    name, members, links = _linked(tables, width, min_words, threshold)
    # of a text that stands very often the smallest id is paired with the rest and stands for it elsewhere
    often = members.groupBy("cls", "copy").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("head")).where(F.col("size") > COPIES).select("cls", "copy", "head")
    placed = members.join(materialize(often, "often"), ["cls", "copy"], "left")
    star = placed.where("id != head").select("tag", F.col("head").alias("id_a"), F.col("id").alias("id_b"))
    shown = materialize(placed.where("head IS NULL OR id = head").select("tag", "cls", "id").distinct(), "shown")
    left, right = (shown.select("tag", F.col("cls").alias(s), F.col("id").alias(f"id_{s}")) for s in "ab")
    within = left.withColumnRenamed("a", "cls").join(right.withColumnRenamed("b", "cls"), ["tag", "cls"]).where("id_a < id_b").select("tag", "id_a", "id_b")
    across = links.join(left, "a").join(right.drop("tag"), "b").select("tag", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b")
    return within.unionByName(star).unionByName(across).distinct().select(name, "id_a", "id_b")


def near_duplicate_groups(tables: dict[str, DataFrame], width: int = 3, min_words: int = 20, threshold: float = 0.5) -> DataFrame:
    """(table_name, id, group_id, n_links): every text that takes part, the smallest id of those it is connected with by
    links, and how many different texts it is linked to itself."""
    name, members, links = _linked(tables, width, min_words, threshold)
    connected = components(links).toDF("cls", "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    placed = members.select("tag", "id", "cls").distinct().join(connected, "cls", "left").join(degree, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = placed.groupBy("component").agg(F.min("id").alias("group_id"))
    return placed.join(heads, "component").select(name, "id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
