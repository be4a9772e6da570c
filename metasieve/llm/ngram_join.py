"""N-gram Jaccard self-join by rare-first prefix filtering.

A document is its set of distinct word n-grams, each a 64-bit token whose upper
bits rank how frequent it is, so that sorting tokens puts rare ones first. Two
sets of sufficient overlap share a token among the first few of each (their
prefixes). The steps:

1. Count all n-grams in a table of fixed size (every document, every n-gram).
2. Give each document its prefix and the digest of its set. Documents with the
   same set are one class from here on.
3. Keep the prefix tokens that two classes or more share.
4. Pair each class with one hub of each such token: the class where the token
   comes first, so the one with the fewest n-grams of its own. Verify the pairs
   that pass the length, positional and suffix filters, once each; merge what is
   linked. Further rounds take hubs from other components while they link much.
5. Where a token's classes are still in several components, pair the classes
   outside the largest one with all of other components, with the same filters,
   and verify those pairs.

So a group of near copies costs its size times its prefixes, not its square,
and no link between different components is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import broadcast_if_small, discard, stored, texts_to_python, trimmed

#: Buckets of the n-gram count table, and buckets in one row of it.
BUCKETS, CHUNK = 1 << 22, 1 << 16
_FREQUENCY_BITS = 8


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of n-gram hashes of texts."""

    def __init__(self, n: int, most_kept: int = 100_000):
        self.n, self.most_kept, self.words = n, most_kept, _WordHashes()
        odd = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        self.factors = _mix(odd) | np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's word n-grams.

        A-Z are lower-cased; words are runs of bytes other than ASCII white
        space. A text of fewer words is one n-gram; one without words, none.
        """
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.most_kept:
            self.words.clear()
        h = np.array(list(map(self.words.__getitem__, words)), np.uint64)
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : i + len(total)] * self.factors[i]
        return np.unique(_mix(total))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def tokens_of(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorted tokens: the rank of an n-gram's count above, its hash below; rare ones first."""
    top = rank[shingles & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(63 - _FREQUENCY_BITS)
    return np.sort(top | (shingles >> np.uint64(_FREQUENCY_BITS + 1))).astype(np.int64)


def least_overlap(size: int, percent: int) -> int:
    """Fewest common n-grams of a set with any that it links with."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int) -> int:
    return size - least_overlap(size, percent) + 1


def pair_overlap(x: int, y: int, percent: int) -> int:
    """Fewest common n-grams of two linked sets of these sizes."""
    return -(-percent * (x + y) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Most common tokens that two sorted sets can have, by cutting both at the middle token of the second."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = int(at < len(x) and x[at] == y[mid])
    return suffix_bound(x[:at], y[:mid], depth - 1) + hit + suffix_bound(x[at + hit :], y[mid + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of tokens overlap enough; the suffix filter comes before the full count."""
    need = pair_overlap(len(x), len(y), percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y, 3) < need:
        return False
    common = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * common >= percent * (len(x) + len(y) - common)


# --- 1: counts of all n-grams ------------------------------------------------


def _counting(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingler = np.zeros(BUCKETS, np.uint32), Shingler(n)
        seen = False
        for b in batches:
            for t in b.column(0):
                s = shingler.shingles(t.as_py())
                counts[s & np.uint64(BUCKETS - 1)] += 1
                seen = True
        if seen:
            yield _chunk_rows(counts)

    return run


def _chunk_rows(counts: np.ndarray) -> pa.RecordBatch:
    found = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=["chunk", "counts"])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts of buckets as bytes that sort like them: a quarter of an octave a step, above or below the median.

    In a large corpus every bucket holds many rare n-grams. Their number is the
    median, about; what stands out from it is a frequent n-gram's own count.
    """
    off = counts.astype(np.float64) - np.median(counts)
    return np.clip(128 + np.sign(off) * np.rint(4 * np.log2(1 + np.abs(off))), 0, 255).astype(np.uint8)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0), b.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
            at = totals.setdefault(k.as_py(), np.zeros(CHUNK, np.uint64))
            at += part
    for k, c in totals.items():
        # counts of a chunk are ranks from here on
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_ranks(c).tobytes()], pa.binary())], names=["chunk", "counts"])


def frequency_ranks(texts: DataFrame, n: int) -> np.ndarray:
    """A rank from 0 to 255 for each bucket of n-grams, by its count.

    ``texts`` has one column. A task sends its counts once, compressed, in
    ``BUCKETS / CHUNK`` rows; what reaches the driver is ``BUCKETS`` bytes,
    whatever the corpus. N-grams that share a bucket share a rank, which changes
    the order of tokens but not the result.
    """
    schema = "chunk int, counts binary"
    sums = texts.mapInArrow(trimmed(_counting(n)), schema).repartition(BUCKETS // CHUNK, "chunk").mapInArrow(_add_chunks, schema)
    rank = np.zeros(BUCKETS, np.uint8)
    for k, c in sums.collect():
        rank[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(c, np.uint8)
    return rank


# --- 2: sets, digests and prefixes -------------------------------------------

_PAIR = ["x", "y"]


def _rows_of(n: int, ranks):
    """What is common to the passes over texts: for slices of a batch, sizes, digests and sorted tokens."""
    shingler, rank = Shingler(n), ranks.value

    def run(texts: pa.Array) -> tuple[list[int], list[tuple[int, int]], list[np.ndarray]]:
        sets = [shingler.shingles(t.as_py()) for t in texts]
        return [len(s) for s in sets], [set_digest(s) for s in sets], [tokens_of(s, rank) for s in sets]

    return run


def _lists(tokens: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64()))


def _prefixing(n: int, percent: int, ranks):
    """Documents ``id, digest, text`` to ``id, digest, n, h1, h2`` and the prefix of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows_of(n, ranks)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sizes, digests, tokens = rows(part.column(2))
                prefixes = [t[: prefix_length(k, percent)] if k else t for k, t in zip(sizes, tokens, strict=True)]
                halves = [pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), *halves, _lists(prefixes)], names=["id", "digest", "n", "h1", "h2", "tokens"])

    return run


def _collecting(n: int, ranks):
    """Rows ``text, cls`` to the class and all its tokens; a class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, done = _rows_of(n, ranks), set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                found = {}
                for i, c in enumerate(b.column(1).slice(lo, 256).to_pylist(), lo):
                    if c not in done:
                        found[c] = i
                done.update(found)
                _, _, tokens = rows(b.column(0).take(pa.array(list(found.values()), pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), _lists(tokens)], names=["cls", "tokens"])

    return run


def _lengths_fit(percent: int) -> Column:
    return F.lit(100) * F.least("x_n", "y_n") >= F.lit(percent) * F.greatest("x_n", "y_n")


def _places_fit(percent: int) -> Column:
    """Positional filter at a common token, if no token before it is common.

    A linked pair passes at the first token that it has in common.
    """
    most = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col("x_n") + F.col("y_n"))


def _side(entries: DataFrame, name: str, *more: str) -> DataFrame:
    return entries.select("token", F.col("cls").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "pos", "root", *more)])


_PAIR = ["x", "y"]
_ROOTED = [*_PAIR, "x_root", "y_root"]


def _pairs(joined: DataFrame, percent: int, tried: list[DataFrame]) -> DataFrame:
    """The pairs that pass the filters, each once, the lesser class first; without those tried before."""
    x_first = F.col("x") < F.col("y")
    ends = [F.when(x_first, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x", "y"), ("y", "x"), ("x_root", "y_root"), ("y_root", "x_root"))]
    pairs = joined.filter((F.col("x_root") != F.col("y_root")) & _lengths_fit(percent) & _places_fit(percent)).select(*ends).distinct()
    for before in tried:
        pairs = pairs.join(before, _PAIR, "left_anti")
    return pairs


def _verifying(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(x.values.to_numpy(), y.values.to_numpy(), percent) for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=_ROOTED).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by their whole sets. ``pairs`` is a stored table; few pairs are sent to the sets."""
    x, y = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in _PAIR)
    ends = stored(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct(), "ends")
    ends_x, ends_y = (broadcast_if_small(ends.withColumnRenamed("cls", c)) for c in _PAIR)
    x, y = x.join(ends_x, "x", "left_semi"), y.join(ends_y, "y", "left_semi")
    both = pairs.join(x, "x").join(y, "y").select(*_ROOTED, "x_tokens", "y_tokens")
    found = stored(both.mapInArrow(trimmed(_verifying(percent)), "x long, y long, x_root long, y_root long"), "found")
    discard(ends)
    return found


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose sets of word n-grams overlap by ``percent`` of their union or more.

    Returns ``id_col, n_shingles long, component_id`` (the least id reachable by
    links, itself included), one row per input row. Rows with equal ids are
    documents of their own. Texts that are null or without words have an empty
    set, link with nothing and keep their own id; a null id is the least of a
    component only where all its ids are null. Other columns are not read; an
    empty table gives an empty one. Exact, whatever the sizes of groups and the
    frequencies of n-grams.

    Classes whose sets are to be compared, and pairs, are broadcast where they
    number ``MOST_BROADCAST`` at most, else they meet texts and sets in shuffles.
    """
    spark = docs.sparkSession
    texts_to_python(spark)
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(frequency_ranks(source.select("text"), n))

    schema = f"id {id_type}, digest long, n long, h1 long, h2 long, tokens array<long>"
    prefixed = stored(source.mapInArrow(trimmed(_prefixing(n, percent, ranks)), schema), "prefixes")
    by_set = prefixed.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("least"), F.count("*").alias("rows"))
    classes = stored(by_set.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "least.id", "least.digest", "rows"), "classes")

    # one document of each class has its prefix compared
    same = (F.col("p.h1") == F.col("c.h1")) & (F.col("p.h2") == F.col("c.h2")) & (F.col("p.digest") == F.col("c.digest")) & F.col("p.id").eqNullSafe(F.col("c.id"))
    first = prefixed.alias("p").join(classes.select("cls", "h1", "h2", "id", "digest").alias("c"), same).select("cls", "n", "tokens")
    entries = first.select("cls", "n", F.posexplode("tokens").alias("pos", "token"))
    # the same columns on both sides, so that Spark makes the exchange below them once
    several = entries.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.min("n").alias("n")).filter("a <> b AND n > 0").select("token")
    shared_entries = stored(entries.join(several, "token").distinct(), "entries")

    wanted = stored(classes.join(shared_entries.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("id").alias("wanted_id"), F.col("digest").alias("wanted")), "wanted")
    meets = (F.col("digest") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("wanted_id"))
    texts = source.join(broadcast_if_small(wanted), meets).select("text", "cls")
    sets = stored(texts.mapInArrow(trimmed(_collecting(n, ranks)), "cls long, tokens array<long>"), "sets")
    if sets.count() > wanted.count():  # rows with one id and text, in several tasks
        sets = stored(sets.dropDuplicates(["cls"]), "sets")

    roots = _linked_roots(shared_entries, sets, percent)
    rooted = classes.join(roots, "cls", "left").filter("rows > 1 OR root IS NOT NULL").select("id", "h1", "h2", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = stored(rooted.join(least, "root").select("h1", "h2", "component_id"), "components")
    discard(shared_entries, sets, classes, wanted, roots)
    out = prefixed.select("id", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


#: Rounds of pairs with hubs at most, and the pairs an entry (by classes of other components) beyond which a round follows.
_HUB_ROUNDS, _PAIRS_AN_ENTRY = 4, 20


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots of classes (``cls, root``; none for a class without links) after links between roots."""
    grown = connected_components(links.select(F.col("x_root").alias("a"), F.col("y_root").alias("b")))
    if roots is None:
        out = stored(grown.withColumnRenamed("node", "cls"), "roots")
        discard(grown)
        return out
    higher = grown.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    moved = roots.join(higher, "root", "left").select("cls", F.coalesce("higher", "root").alias("root"))
    new = grown.join(roots, F.col("node") == F.col("cls"), "left_anti").select(F.col("node").alias("cls"), "root")
    out = stored(moved.union(new), "roots")
    discard(grown, roots)
    return out


def _open(entries: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, int, int]:
    """Entries of tokens whose classes are in several components, with ``root`` and whether that is the token's largest one.

    Also their number, and that of the pairs to look at: classes outside the
    largest component, times all.
    """
    rooted = entries.withColumn("root", F.col("cls"))
    if roots is not None:
        rooted = entries.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stored(rooted.select("token", "cls", "n", "pos", "root"), "rooted")
    sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("k"))
    spans = sizes.groupBy("token").agg(F.max(F.struct("k", (-F.col("root")).alias("least"))).alias("most"), F.sum("k").alias("all")).filter("most.k < all")
    spans = spans.select("token", (-F.col("most.least")).alias("largest"), "all")
    out = stored(rooted.join(spans, "token").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"), "open")
    discard(rooted)
    found = out.agg(F.count("*"), F.sum(F.when(F.col("outside"), F.col("all")))).first()
    return out, found[0], found[1] or 0


def _linked_roots(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of classes by all links: ``cls, root``; a class without links may be missing."""
    roots: DataFrame | None = None
    tried: list[DataFrame] = []
    some = True
    for step in range(_HUB_ROUNDS + 1):
        rooted, n_entries, n_pairs = _open(entries, roots)
        last = step == _HUB_ROUNDS or (step > 0 and (not some or n_pairs <= _PAIRS_AN_ENTRY * n_entries))
        if last:
            # of two classes outside the largest component, the one of the lesser root is x
            joined = _side(rooted.filter("outside"), "x").join(_side(rooted, "y", "outside"), "token").filter("NOT y_outside OR x_root < y_root")
        else:
            # the class where the token comes first; after the first round, of those outside the largest component
            pool = rooted.filter("outside") if step else rooted
            hubs = pool.groupBy("token").agg(F.min(F.struct("pos", "cls", "n", "root")).alias("hub")).select("token", "hub.*")
            joined = _side(rooted, "x").join(_side(hubs, "y"), "token")
        pairs = stored(_pairs(joined, percent, tried), "pairs")
        found = _verified(pairs, sets, percent)
        roots, some = _merged(roots, found), not found.isEmpty()
        discard(rooted, found)
        tried.append(pairs)
        if last:
            break
    discard(*tried)
    return roots
