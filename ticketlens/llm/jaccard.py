"""N-gram Jaccard join with PartEnum signatures.

A set of shingles is a set of 64-bit hashes, and nodes of the join are distinct sets. Sizes fall into bands: two
sets that are similar enough are in one band or in neighbouring ones, and differ by at most k elements, where k
follows from the band. The hash domain is cut into n1 ranges. Two sets with k differences differ in one of the
ranges by k // n1 elements at most; there, of n2 subranges, the ones left after leaving out any k // n1 agree.
So a signature for every range and every such choice of subranges is shared by all similar sets, and the sets
that share one are verified exactly. Below a similarity of 85 a signature has so few elements that many would have
none and be shared by unlike sets. There the plan has further ranges: with m more, similar sets agree in m + 1 ranges
at least, so that each set leaves out its signatures of up to t elements, t being the largest number that touches at
most m of its ranges. Of two similar sets, the larger t leaves out all that the other does, and one range remains.

Groups of many similar sets are not compared pair by pair: each set that shares a signature is verified against
the first set of the group, links found so are joined to components, and only pairs of a group that are still in
different components are verified afterwards. A pair is verified only if its sizes and sketches allow the similarity:
a sketch has the parities of the numbers of elements in 512 parts of the domain, and two sketches differ in no more
bits than the sets do in elements, so no similar pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import exchange as ex
from ticketlens.llm import graph
from ticketlens.llm import textops as tx
from ticketlens.session import clear_scratch, scratch_tables, small_side, stage_table

SHINGLE = 3
# Similarity in hundredths: linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 90
# Subranges of a range when one difference may fall into it.
SUBRANGES = 3
# Below this similarity a plan has this many further ranges, one for each so many.
THIN, FURTHER = 85, 3
SKETCH = [f"s{k}" for k in range(8)]
# A wide sketch has so many parts for each element, and this many at least.
WIDE, WIDE_LEAST = 4, 2048
# Of the groups of a node, so many go with it, to tell whether a pair meets in an earlier one.
FIRST_GROUPS = 8
# A text has several times as many bytes of signatures as its own, so that a bucket takes the less text.
SIGNED = 2


def band_of(size: int, similarity: int = SIMILARITY) -> int:
    """The band of a size: bands begin at 1, and each ends at the largest size that its first size can be similar to."""
    band, last = 0, 0
    while last < size:
        last = (last + 1) * 100 // similarity
        band += 1
    return band


def plan_of(band: int, similarity: int = SIMILARITY) -> tuple[int, np.ndarray, list[tuple[int, ...]], int]:
    """Ranges, the bounds of all subranges in the hash domain, the choices of subranges in a range, and the further ranges."""
    return tx.kept(f"partenum {band} {similarity}", lambda: _plan(band, similarity))


def _plan(band: int, similarity: int) -> tuple[int, np.ndarray, list[tuple[int, ...]], int]:
    last = 0
    for _ in range(band):
        last = (last + 1) * 100 // similarity
    # |x| + |y| - 2 * common <= differences; with common >= s / (100 + s) * (|x| + |y|) and both sizes at most last.
    most = 2 * last * (100 - similarity) // (100 + similarity)
    ranges = (most + 2) // 2
    spare = most // ranges
    parts = SUBRANGES if spare else 1
    further = -(-ranges // FURTHER) if spare and similarity < THIN else 0
    ranges += further
    bounds = np.array([k * (1 << 64) // (ranges * parts) for k in range(1, ranges * parts)], np.uint64)
    return ranges, bounds, list(combinations(range(parts), parts - spare)), further


def signatures(own: np.ndarray, sums: np.ndarray, band: int, similarity: int = SIMILARITY) -> np.ndarray:
    """All signatures of a sorted set in a band. sums: running sums of the elements' mixed hashes, from 0 on."""
    ranges, bounds, choices, further = plan_of(band, similarity)
    edges = np.concatenate([[0], np.searchsorted(own, bounds), [own.size]])
    part = tx.mix(np.diff(sums[edges]) + np.diff(edges).astype(np.uint64)).reshape(ranges, -1)
    salt = tx.mix(np.arange(ranges, dtype=np.uint64) + np.uint64(band << 32), 1)
    out = []
    for k, chosen in enumerate(choices):
        h = salt + np.uint64(k)
        for c in chosen:
            h = tx.joined(h, part[:, c])
        out.append(h)
    if further:
        sizes = np.diff(edges).reshape(ranges, -1)
        sizes = np.stack([sizes[:, chosen].sum(axis=1) for chosen in choices])
        least = np.partition(sizes.min(axis=0), further)[further]
        return np.concatenate(out)[sizes.ravel() >= least]
    return np.concatenate(out)


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = tx.utf8(batch.column("text"))
    raw = tx.LOWER[raw]
    starts, ends, bounds = tx.words(raw, offsets)
    h = tx.word_hashes(raw, starts, ends)
    wide = tx.window_hashes(h, size)
    for k in range(batch.num_rows):
        first, last = bounds[k], bounds[k + 1]
        if last - first >= size:
            own = np.sort(wide[first : last - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif last > first:
            # The whole short text is one shingle of its own length.
            yield tx.mix(tx.window_hashes(h[first:last], int(last - first)) + np.uint64(last - first), 1)
        else:
            yield h[:0]


def _fingerprint(own: np.ndarray) -> tuple[int, int, np.ndarray]:
    sums = np.zeros(own.size + 1, np.uint64)
    np.cumsum(tx.mix(own), out=sums[1:])
    other = tx.mix(own, 1).sum(dtype=np.uint64) + np.uint64(own.size)
    return int(sums[-1:].view(np.int64)[0]), int(np.array([other]).view(np.int64)[0]), sums


def _sketch(own: np.ndarray) -> np.ndarray:
    parity = np.bincount((tx.mix(own, 1) >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """For each row its set's size, 128-bit fingerprint (a, b) and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large()
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                found = [(own.size, *_fingerprint(own)[:2], *_sketch(own).tolist()) for own in shingle_sets(batch, size)]
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column("ident"), *columns], ["ident", *names])

    names = ["n", "a", "b", *SKETCH]
    return docs.mapInArrow(run, tx.schema_of(docs, ["ident"], ", ".join(f"{c} long" for c in names)))


def _signed(docs: DataFrame, size: int, similarity: int, buckets: int) -> DataFrame:
    """Packed entries (lower half of a signature, node's a), each node once in a slice.

    The upper half of a signature chooses the bucket. Signatures that agree in what is left only bring candidates together,
    and so do nodes that agree in a: their pairs are verified by both halves of their fingerprints.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large()
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                nodes: set[tuple[int, int]] = set()
                order, found = [], []
                for own in shingle_sets(batch, size):
                    a, b, sums = _fingerprint(own)
                    if own.size and (a, b) not in nodes:
                        nodes.add((a, b))
                        order.append((a, b))
                        band = band_of(own.size, similarity)
                        found.append(np.concatenate([signatures(own, sums, x, similarity) for x in (band, band + 1)]))
                if found:
                    a = np.array([x[0] for x in order], np.int64)
                    owner = np.repeat(np.arange(len(found), dtype=np.int32), [f.size for f in found])
                    h = np.concatenate(found)
                    yield ex.packed(ex.bucket_of(h, buckets), buckets, owner, [a], [h.astype(np.uint32)])

    return docs.select("text").mapInArrow(run, ex.packed_schema(2))


def _groups(group: pa.Table) -> pa.Table:
    """Sets of nodes that share a signature: one row for each node of each group, with the group's first node."""
    owner, (keys,), h = ex.owned(group, ["<i8"], "<u4")
    order = np.argsort(h)
    h = h[order]
    # Most signatures are of one node only, and go before anything is made for them.
    shared = np.zeros(h.size, bool)
    same = h[1:] == h[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    h, a = h[shared], keys[owner[order[shared]]]
    del order, shared, same, owner
    order = np.lexsort((a, h))
    a, h = a[order], h[order]
    first = np.ones(h.size, bool)
    first[1:] = h[1:] != h[:-1]
    fresh = first.copy()
    fresh[1:] |= a[1:] != a[:-1]
    a, first = a[fresh], first[fresh]
    lead = np.flatnonzero(first)
    sizes = np.diff(np.append(lead, first.size))
    many = np.repeat(sizes > 1, sizes)
    # Groups with the same members are told once: their sum of mixed keys is the same.
    key = np.add.reduceat(tx.mix(a.view(np.uint64)), lead) if lead.size else np.zeros(0, np.uint64)
    _, once = np.unique(key, return_index=True)
    new = np.zeros(lead.size, bool)
    new[once] = True
    many &= np.repeat(new, sizes)
    key, ends = np.repeat(key.view(np.int64), sizes), np.repeat(lead, sizes)
    out = pa.table({c: pa.array(x[many]) for c, x in {"g": key, "a": a, "ha": a[ends]}.items()})
    tx.release()
    return out


GROUPS = "g long, a long, ha long"
PAIR = ["xa", "xb", "ya", "yb"]


def wide_sketch(own: np.ndarray) -> np.ndarray:
    """The parities of the numbers of elements in some parts of the domain, WIDE times as many as elements, a power of two."""
    parts = max(WIDE_LEAST, 1 << (WIDE * own.size - 1).bit_length())
    part = tx.mix(own, 1) & np.uint64(parts - 1)
    return np.packbits(np.bincount(part.astype(np.int64), minlength=parts).astype(np.uint8) & 1).view(np.uint64)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """The bits in which two wide sketches differ, the longer folded to the length of the other: no more than the elements do."""
    x, y = (x, y) if x.size > y.size else (y, x)
    while x.size > y.size:
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(rows: DataFrame, size: int, sketch: bool) -> DataFrame:
    """For each row its set's fingerprint, its size, and its sorted elements, or their wide sketch, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                found = [(*_fingerprint(own)[:2], own.size, (wide_sketch(own) if sketch else own).tobytes()) for own in shingle_sets(batch, size)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "own"])

    return rows.select("text").mapInArrow(run, "a long, b long, n long, own binary")


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, size: int, similarity: int) -> DataFrame:
    """Those of the distinct pairs (xa, xb, ya, yb) that are similar enough, as pairs of ids x and y; written.

    Only texts of nodes in a pair are read again, one row's text for each node: first for wide sketches, and for the sets
    where these allow the similarity. Sketches are an eighth of the sets at most, but for small ones, and leave few pairs.
    """
    def kept(similar: Callable[[np.ndarray, np.ndarray, int], bool], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column("xown"), batch.column("yown"), batch.column("sizes").to_pylist(), strict=True)
                keep = [similar(*(np.frombuffer(v.as_buffer(), "<u8") for v in (x, y)), sizes) for x, y, sizes in both]
                yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

        return run

    def may_be(x: np.ndarray, y: np.ndarray, sizes: int) -> bool:
        return bits_apart(x, y) * (100 + similarity) <= sizes * (100 - similarity)

    def are(x: np.ndarray, y: np.ndarray, sizes: int) -> bool:
        both = np.sort(np.concatenate([x, y]))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= similarity * (sizes - common)

    def with_sets(pairs: DataFrame, sketch: bool) -> DataFrame:
        """The pairs with the sets of both nodes, or their sketches, their ids and the sum of their sizes."""
        nodes = pairs.select(F.col("xa").alias("a"), F.col("xb").alias("b")).union(pairs.select("ya", "yb")).distinct()
        nodes = stage_table(known.select("a", "b", "lead").join(nodes, ["a", "b"]))
        rows = docs.join(nodes.select(F.col("lead").alias("ident")).distinct(), "ident")
        sets = stage_table(_sets(rows, size, sketch).join(nodes, ["a", "b"]).dropDuplicates(["a", "b"]))
        out = pairs
        for s in "xy":
            held = small_side(pairs.select(F.col(s + "a").alias("a"), F.col(s + "b").alias("b")).distinct())
            out = out.join(sets.join(held, ["a", "b"]).select(*[F.col(c).alias(s + c) for c in ("a", "b", "n", "own", "lead")]), [s + "a", s + "b"])
        return out.select(*PAIR, F.col("xlead").alias("x"), F.col("ylead").alias("y"), (F.col("xn") + F.col("yn")).alias("sizes"), "xown", "yown")

    since = scratch_tables()
    near = stage_table(with_sets(pairs, True).mapInArrow(kept(may_be, PAIR), ", ".join(f"{c} long" for c in PAIR)))
    kind = known.schema["lead"].dataType.simpleString()
    out = stage_table(with_sets(near, False).mapInArrow(kept(are, ["x", "y"]), f"x {kind}, y {kind}"))
    clear_scratch(since, out)
    return out


def _with_firsts(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (g, a) of groups with the columns of their nodes, and those of a node's first groups that come before the group.

    A node has no more groups than signatures.
    """
    firsts = members.groupBy("a").agg(F.slice(F.sort_array(F.collect_list("g")), 1, FIRST_GROUPS).alias("firsts"))
    return members.join(nodes.join(firsts, "a"), "a").withColumn("firsts", F.filter("firsts", lambda g: g < F.col("g")))


def _meetings(members: DataFrame, which: Column) -> DataFrame:
    """Pairs of members of a group, with their columns under the prefixes x and y, of those that the condition chooses.

    Similar nodes share many groups. A pair is left out of a group if an earlier one is among the first groups of both: of
    all groups that two nodes share, the first one keeps their pair.
    """
    x, y = (members.select("g", *[F.col(c).alias(s + c) for c in members.columns if c != "g"]) for s in "xy")
    # The condition comes first, as it costs less.
    return x.join(y, "g").filter(which & ~F.arrays_overlap("xfirsts", "yfirsts"))


def link(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """For each row: ident, n_shingles, component_id (smallest id reachable by links) and n_copies (rows with its set).

    Words are runs without ASCII blanks, A-Z in lower case. The set of a text holds its distinct shingles of size
    words, or its whole sequence if it has fewer. Texts link when 100 * |intersection| >= similarity * |union|. A null
    or empty text has size 0, no copies and is its own component; a row without id links with nothing and has no
    component. Rows that share an id are one document of the links. Other columns are left out, whatever their names.
    """
    tx.short_batches(docs.sparkSession)
    own = docs.select(F.col(ident).alias("ident"), F.col(text).cast("string").alias("text"))
    some = own.filter("ident is not null")
    nodes = stage_table(_nodes(own, size))
    classes = stage_table(nodes.filter("n > 0 and ident is not null").groupBy("a", "b").agg(
        F.min("ident").alias("lead"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ("n", *SKETCH)]
    ))
    # What is written from here on goes when the components are found.
    since = scratch_tables()
    buckets = SIGNED * ex.bucket_count(own, "text")
    groups = stage_table(_signed(some, size, similarity, buckets).groupBy("bucket").applyInArrow(_groups, GROUPS).distinct())

    # Nodes that share a signature, each with one row of its documents. What is joined by a key that very many rows
    # have is staged, so that both sides are plain exchanges and the key can be split.
    known = stage_table(classes.join(groups.select("a").distinct(), "a"))

    def under(prefix: str, *more: str) -> DataFrame:
        """The known nodes with their columns under a prefix."""
        return known.select(*[F.col(c).alias(prefix + c) for c in ("a", "b", "n", *SKETCH, *more)])

    def possible(x: str, y: str) -> Column:
        sizes = F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * similarity
        apart = sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCH), F.lit(0))
        return sizes & (apart * (100 + similarity) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - similarity))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (xa, ya) that link, as leads x and y."""
        both = pairs.join(under("x"), "xa").join(under("y"), "ya").filter(possible("x", "y"))
        return _verified(stage_table(both.select(*PAIR)), own, known, size, similarity)

    def with_part(rows: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
        """Rows of nodes' a with the smallest and the largest component of the nodes that have it."""
        each = known.select("a", "lead").join(labels.select(F.col("x").alias("lead"), "y"), "lead", "left").select("a", F.coalesce("y", "lead").alias("part"))
        each = each.groupBy(F.col("a").alias(prefix + "a")).agg(F.min("part").alias(prefix + "part"), F.max("part").alias(prefix + "last"))
        return rows.join(each, prefix + "a")

    # Each set is verified against the first set of one of its groups, that of the most groups. Most sets find their
    # component so. What is left are the first sets that it is not yet linked to.
    hubs = stage_table(groups.filter("a <> ha").groupBy(F.col("a").alias("xa"), F.col("ha").alias("ya")).agg(F.count("*").alias("n")))
    best = hubs.groupBy("xa").agg(F.max(F.struct("n", "ya")).alias("_best")).select("xa", F.col("_best.ya").alias("ya"))
    labels = stage_table(graph.components(linked(best)))
    rest = with_part(with_part(hubs.select("xa", "ya").join(best, ["xa", "ya"], "left_anti"), labels, "x"), labels, "y")
    more = linked(rest.filter("xpart <> ypart or xpart <> xlast or ypart <> ylast").select("xa", "ya"))
    labels = stage_table(graph.components(labels.unionByName(more)))

    # What is left: pairs of a group in different components.
    members = stage_table(with_part(groups.select("g", "a"), labels))
    mixed = members.groupBy("g").agg(F.min("part").alias("l"), F.max("last").alias("m")).filter("l < m").select("g")
    parts = known.join(labels.select(F.col("x").alias("lead"), "y"), "lead", "left").withColumn("part", F.coalesce("y", "lead")).select("a", "b", "n", *SKETCH, "part")
    members = _with_firsts(stage_table(members.select("g", "a").join(mixed, "g")), parts)
    second = stage_table(_meetings(stage_table(members), (F.col("xpart") < F.col("ypart")) & possible("x", "y")).select(*PAIR).distinct())
    late = _verified(second, own, known, size, similarity)
    if not late.isEmpty():
        labels = stage_table(graph.components(labels.unionByName(late)))
    clear_scratch(since, labels)

    classes = classes.select("a", "b", "lead", "copies")
    rows = nodes.join(classes, ["a", "b"], "left").join(labels.select(F.col("x").alias("lead"), F.col("y").alias("least")), "lead", "left")
    alone = (F.col("n") == 0) | F.col("ident").isNull()
    return rows.select(
        F.col("ident").alias(ident), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("ident")).otherwise(F.coalesce("least", "lead")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )
