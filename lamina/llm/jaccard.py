"""N-gram Jaccard join with PartEnum signatures, as components of the exact similarity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.components import connected_components
from lamina.llm.staging import col, doc_text, maybe_in, spare, stage
from lamina.llm.words import mixed, shingles, slices, windows, word_hashes

SHINGLE = 5
#: Similarity as a fraction, 75 / 100: sets of sizes x and y are linked when they differ in at most (x + y) / 7 elements.
DIFFER = 7
#: Counters of the signature frequencies, a fixed number.
SKETCH_BITS = 18
#: Bytes of signatures that one bucket should hold, about.
BUCKET_BYTES = 8 << 20
#: Pivots per group in the second round of comparisons.
NEXT_PIVOTS = 8
#: Links whose components one task finds.
LINKS_PER_TASK = 2_000_000
#: Rows compared with one pivot in one task, about.
PIVOT_ROWS = 2_000

U64 = np.uint64


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles, sorted within each text, and the offsets of the texts' sets."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    parts = []
    count = np.maximum(n - SHINGLE + 1, 0)
    every = windows(h, SHINGLE)
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    parts.append(every[np.repeat(at[:-1] - first, count) + np.arange(len(doc))] if len(doc) else np.zeros(0, U64))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    parts += [shingles(h[at[i] : at[i + 1]], SHINGLE) for i in short]
    s, doc = np.concatenate(parts), np.concatenate([doc, short])
    order = np.argsort(s)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: the same for equal sets only, but for hash collisions; 0 for an empty one."""
    total = np.zeros(len(s) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(s ^ U64(0x6A09E667F3BCC909)), out=total[1:])
        out = mixed((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(U64))
    return np.where(np.diff(at) > 0, out, U64(0)).view(np.int64)


def odd_sketch(s: np.ndarray) -> bytes:
    """A bit per slot, set where an odd number of elements fall into it; about two to four slots per element.

    Every element in which two sets differ turns one bit at most, so sketches of linked sets differ in
    at most (x + y) / 7 bits: an exact filter at a thirtieth of the sets' size.
    """
    slots = 1 << max(6, int(len(s) - 1).bit_length() + 1)
    at = (mixed(s ^ U64(0x3C6EF372FE94F82B)) & U64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(bool), bitorder="little").tobytes()


def odd_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ once the longer one is folded to the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    width = 8 * len(a)
    while width > 8 * len(b):
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (x ^ y).bit_count()


class Emission:
    """The size bands in which each set takes part, with what PartEnum needs there.

    Band b holds sizes from 2**b to 2**(b+1) - 1, and the smaller sets that may have a partner of such a
    size.  Two linked sets meet in the band of the larger one.  They differ in at most ``k`` elements, so
    they agree in all but ``k`` of the band's partitions of the shingle domain (first-level pairs of two
    second-level partitions, from which every subset of one is a signature).
    """

    def __init__(self, sizes: np.ndarray):
        own = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        most = sizes * 4 // 3
        doc = np.flatnonzero(sizes > 0)
        up = np.flatnonzero((sizes > 0) & (most >= 2 << own))
        self.doc = np.concatenate([doc, up])
        self.band = np.concatenate([own[doc], own[up] + 1])
        partner = np.concatenate([np.minimum(most[doc], (2 << own[doc]) - 1), most[up]])
        self.k = (sizes[self.doc] + partner) // DIFFER
        self.partitions = 2 * (2 * ((2 << self.band) - 1) // DIFFER + 1)


def _signature(content: np.ndarray, band: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(content + mixed((band.astype(U64) << U64(40) | place) + U64(1)))


def signatures(s: np.ndarray, at: np.ndarray) -> tuple[Emission, np.ndarray, np.ndarray, np.ndarray]:
    """The emission, and (row of it, partition, signature) for each partition in which a set has elements."""
    sizes = np.diff(at)
    e = Emission(sizes)
    n = sizes[e.doc]
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    element = np.repeat(at[e.doc] - first, n) + np.arange(len(row))
    x = mixed(s ^ U64(0xBB67AE8584CAA73B))
    place = ((x >> U64(32))[element] * e.partitions[row].astype(U64)) >> U64(32)
    key = (row.astype(U64) << U64(32)) | place
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(mixed(x)[element[order]], starts) if len(key) else np.zeros(0, U64)
    owner, place = (key[starts] >> U64(32)).astype(np.int64), key[starts] & U64(0xFFFFFFFF)
    return e, owner, place, _signature(content, e.band[owner], place)


def chosen(e: Emission, owner: np.ndarray, place: np.ndarray, sig: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the k + 1 signatures that come first in one order of all signatures, rare ones first.

    Linked sets agree in all but k partitions, so the first partition in which they agree is among the
    first k + 1 of both.  Any order that depends on the signature alone will do; frequencies keep
    passages that many texts share out of the way.  Where a set has elements in fewer partitions, its
    empty partitions follow, in their own order.
    """
    common = np.minimum(sketch[sig >> U64(64 - SKETCH_BITS)], (1 << 20) - 1).astype(U64)
    order = np.argsort(common << U64(44) | sig >> U64(20))
    order = order[np.argsort(owner[order], kind="stable")]
    owner, sig, place = owner[order], sig[order], place[order]
    filled = np.bincount(owner, minlength=len(e.k))
    first = np.cumsum(filled) - filled
    take = np.arange(len(owner)) - np.repeat(first, filled) <= e.k[owner]
    rows, out = [owner[take]], [sig[take]]
    for r in np.flatnonzero(filled <= e.k):
        empty = np.setdiff1d(np.arange(e.partitions[r], dtype=U64), place[first[r] : first[r] + filled[r]])[: e.k[r] + 1 - filled[r]]
        out.append(_signature(np.zeros(len(empty), U64), np.full(len(empty), e.band[r]), empty))
        rows.append(np.full(len(empty), r))
    return np.concatenate(rows), np.concatenate(out)


def _batches(batches: Iterator[pa.RecordBatch], id_at: int = 0, text_at: int = 1) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for part in slices(batch, text_at):
            s, offsets = shingle_sets([(t or "").encode("utf-8").lower() for t in part.column(text_at).to_pylist()])
            yield part.column(id_at).to_pylist(), s, offsets, part


# ---- the passes over the documents ----

SETS = "doc_id long, n_shingles long, set_id long, sketch binary, part int, counts binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the task's counts of signatures, in parts."""
    names = ["doc_id", "n_shingles", "set_id", "sketch", "part", "counts"]
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for ids, s, at, _ in _batches(batches):
        _, _, _, sig = signatures(s, at)
        sketch += np.bincount(sig >> U64(64 - SKETCH_BITS), minlength=len(sketch))
        none = pa.nulls(len(ids))
        odd = pa.array([odd_sketch(s[at[i] : at[i + 1]]) for i in range(len(ids))], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(set_ids(s, at)), odd, none.cast(pa.int32()), none.cast(pa.binary())], names
        )
    parts = sketch.astype("<i8").reshape(-1, 1 << 12)
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"]
    )


def _sketch(described: DataFrame) -> np.ndarray:
    """The counts of all tasks added up: ``1 << SKETCH_BITS`` numbers, whatever the corpus."""
    counts = described.where("part is not null").select("part", "counts")
    added = counts.mapInArrow(_added, "part int, counts binary").repartition("part").mapInArrow(_added, "part int, counts binary")
    sketch = np.zeros((1 << SKETCH_BITS >> 12, 1 << 12), np.int64)
    for r in added.collect():
        sketch[r["part"]] += np.frombuffer(r["counts"], "<i8")
    return sketch.ravel()


def _candidate_pairs(docs: DataFrame, sketch: np.ndarray, buckets: int) -> DataFrame:
    """(set_id, pivot, mass): sets that share a signature, each with the smallest set of that signature.

    Signatures travel packed, by bucket.  Every two sets with a common signature are members of one pivot.
    ``mass`` adds up how many sets have each of the signatures met.
    """
    shift = 64 - (buckets - 1).bit_length()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, at, _ in _batches(batches):
            names = set_ids(s, at)
            e, owner, place, sig = signatures(s, at)
            row, sig = chosen(e, owner, place, sig, sketch)
            pair = np.stack([sig, names[e.doc[row]].view(U64)], axis=1)
            if not len(pair):
                continue
            pair = pair[np.argsort(pair[:, 0])]
            bucket = (pair[:, 0] >> U64(shift)).astype(np.int64) if buckets > 1 else np.zeros(len(pair), np.int64)
            found, first = np.unique(bucket, return_index=True)
            ends = [*first[1:].tolist(), len(pair)]
            # Below the bucket's bits, 40 bits of a signature are enough: a collision only adds a candidate.
            short = ((pair[:, 0] << U64(64 - shift)) >> U64(24) if shift < 64 else pair[:, 0] >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            packed = np.concatenate([short, pair[:, 1].copy().view(np.uint8).reshape(-1, 8)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array([packed[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["bucket", "packed"]
            )

    def meet(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(-1, 13)
        sig = np.zeros((len(raw), 8), np.uint8)
        sig[:, :5] = raw[:, :5]
        sig, name = sig.view("<u8").ravel(), np.ascontiguousarray(raw[:, 5:]).view("<i8").ravel()
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        pivot, mass = np.repeat(name[first], size), np.repeat(size, size)
        other = name != pivot
        pairs, place = np.unique(np.stack([name[other], pivot[other]], axis=1), axis=0, return_inverse=True)
        mass = np.bincount(place.ravel(), mass[other], minlength=len(pairs)).astype(np.int64)
        return pa.table({"set_id": pairs[:, 0], "pivot": pairs[:, 1], "mass": mass})

    packed = docs.mapInArrow(emit, "bucket int, packed binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "set_id long, pivot long, mass long")
    return met.groupBy("set_id", "pivot").agg(F.sum("mass").alias("mass"))


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, b, part, role) of the sets to compare (role 1) and of their pivots b (role 0).

    A pivot of many sets is sent to several tasks, each of which has a part of them.
    """
    many = stage(pairs.groupBy("b").agg(F.count("*").alias("n")), "pivot-sizes").select("b", F.ceil(F.col("n") / PIVOT_ROWS).cast("int").alias("parts"))
    asked = pairs.join(many, "b").select(F.col("a").alias("set_id"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    pivots = many.select(F.col("b").alias("set_id"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    return asked, pivots


def _compared(rows: DataFrame, linked) -> DataFrame:
    """Distinct (a, b) for which ``linked(value of a, value of b)``, from rows (b, part, role, a, value)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, b""
        for few in (x for batch in batches for x in slices(batch, 4)):
            out = []
            for b, part, role, a, value in zip(*(c.to_pylist() for c in few.columns), strict=True):
                if role == 0:
                    now, pivot = (b, part), value
                elif now == (b, part) and linked(value, pivot):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(compare, "a long, b long").distinct()


def _plausible(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids) that sizes and sketches do not rule out."""

    def linked(a: bytes, b: bytes) -> bool:
        n, m = int.from_bytes(a[:8], "big"), int.from_bytes(b[:8], "big")
        return odd_distance(a[8:], b[8:]) * DIFFER <= n + m

    asked, pivots = _dealt(pairs)
    known = asked.unionByName(pivots).join(_sketched(reps), "set_id")
    return _compared(known.select("b", "part", "role", F.col("set_id").alias("a"), "value"), linked)


def _same_enough(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the plausible ``pairs`` (a, b: set ids) whose sets are linked.

    One document of each set brings the set to every pivot b that it is compared with.
    """
    pairs = stage(pairs, "plausible-pairs")
    if pairs.isEmpty():
        return pairs
    asked, pivots = _dealt(pairs)
    roles = asked.unionByName(pivots).join(reps.select("set_id", F.col("min_doc_id").alias("doc_id")), "set_id")
    wanted = stage(roles.groupBy("doc_id", "set_id").agg(F.collect_list(F.struct("b", "part", "role")).alias("roles")), "set-roles")
    texts = maybe_in(docs, F.col("doc_id"), wanted.select("doc_id")).join(wanted, "doc_id")

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, at, part in _batches(batches):
            out = []
            names = set_ids(s, at).tolist()
            for i, (name, roles) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if names[i] == name:
                    blob = s[at[i] : at[i + 1]].tobytes()
                    out += [(r["b"], r["part"], r["role"], name, blob) for r in roles]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["b", "part", "role", "a", "elements"])

    kept = texts.select("doc_id", "text", "set_id", "roles").mapInArrow(bring, "b long, part int, role int, a long, elements binary")
    return _compared(kept, _same_enough)


def _near(x: str, y: str) -> F.Column:
    """Whether sizes alone allow the similarity."""
    return (F.least(x, y) * 100 >= F.greatest(x, y) * 75)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the links in one task, by union and find; the smallest node names a component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in parent], pa.int64())], ["node", "component"])


def _labels(links: DataFrame) -> DataFrame:
    """Stored (node, component) of the links.

    Each task contracts up to ``LINKS_PER_TASK`` links to a forest.  One forest is the answer; of several, the
    edges left go through star contraction.
    """
    tasks = -(-links.count() // LINKS_PER_TASK)
    if tasks <= 1:
        return stage(links.coalesce(1).mapInArrow(_forest, "node long, component long"), "link-components")
    forests = links.repartition(tasks).mapInArrow(_forest, "node long, component long")
    return stage(connected_components(forests.select(F.col("node").alias("a"), F.col("component").alias("b"))), "link-components")


def _sketched(reps: DataFrame) -> DataFrame:
    """(set_id, value): size and sketch in one binary."""
    return reps.select("set_id", F.concat(F.unhex(F.lpad(F.hex("n_shingles"), 16, "0")), F.col("sketch")).alias("value"))


def _rest_plausible(reps: DataFrame, named: DataFrame) -> DataFrame:
    """Plausible (a, b) among the members of each pivot that lie in different components, b outside the main one.

    Members outside the pivot's most frequent component are dealt out in blocks of about ``PIVOT_ROWS``; all members
    pass by each block and are held against it by their sketches.  Only plausible pairs become rows.
    """
    counts = named.groupBy("pivot", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("pivot").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = stage(main.where("most < all").select("pivot", "main", F.ceil((F.col("all") - F.col("most")) / PIVOT_ROWS).cast("int").alias("blocks")), "split-pivots")
    met = named.join(main, "pivot").join(_sketched(reps), "set_id")
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    outside = met.where("component <> main").select("pivot", block.alias("block"), F.lit(0).alias("role"), "set_id", "component", "value")
    passing = met.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "set_id", "component", "value")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for few in (x for batch in batches for x in slices(batch, 5)):
            out = []
            for pivot, block, role, a, part, value in zip(*(c.to_pylist() for c in few.columns), strict=True):
                if now != (pivot, block):
                    now, held = (pivot, block), []
                size, sketch = int.from_bytes(value[:8], "big"), value[8:]
                if role == 0:
                    held.append((a, part, size, sketch))
                    continue
                for b, other, m, against in held:
                    if other != part and 4 * min(size, m) >= 3 * max(size, m) and odd_distance(sketch, against) * DIFFER <= size + m:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = outside.unionByName(passing).repartition("pivot", "block").sortWithinPartitions("pivot", "block", "role")
    pairs = dealt.mapInArrow(hold, "a long, b long")
    return pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def _components(docs: DataFrame, reps: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, component) of linked sets, as the full similarity graph of the candidates connects them.

    Sets with a common signature are members of one pivot, and all are compared with it first.  Members that then
    lie in one component need no more comparisons among themselves.  Where a pivot's members lie in several,
    the few with the most mass (near the text that the others were copied from) are pivots next.  In the end every
    member outside a pivot's main component is held against all its members of other components, so no link
    between two components is lost, and a group of similar texts costs comparisons in proportion to its size.
    """
    size = reps.select("set_id", "n_shingles")
    members = candidates.join(size, "set_id").withColumnRenamed("n_shingles", "n")
    members = stage(members.join(size.select(F.col("set_id").alias("pivot"), F.col("n_shingles").alias("m")), "pivot"), "pivot-members")
    first = members.where(_near("n", "m")).select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    links = stage(_verified(docs, reps, _plausible(reps, first)), "links")

    def named() -> tuple[DataFrame, DataFrame]:
        labels = _labels(links)
        known = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
        return labels, stage(known.select("pivot", "set_id", "n", "mass", F.coalesce("component", "set_id").alias("component")), "named-members")

    _, rows = named()
    split = rows.groupBy("pivot").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("pivot")
    rest = stage(rows.join(stage(split, "split-pivots"), "pivot", "left_semi"), "split-members")
    order = Window.partitionBy("pivot").orderBy(F.desc("mass"), "set_id")
    following = rest.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= NEXT_PIVOTS)
    following = stage(following.select("pivot", F.col("set_id").alias("q"), F.col("component").alias("c"), F.col("n").alias("m")), "next-pivots")
    pairs = rest.join(following, "pivot").where((F.col("component") != F.col("c")) & _near("n", "m"))
    second = stage(pairs.select(F.col("set_id").alias("a"), F.col("q").alias("b")).distinct(), "next-pairs")
    links = stage(links.unionByName(_verified(docs, reps, _plausible(reps, second))), "links")
    labels, rows = named()
    last = _verified(docs, reps, _rest_plausible(reps, rows))
    if last.isEmpty():
        return labels
    links = stage(links.unionByName(last), "links")
    return _labels(links)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, set_id), one per row of ``docs``.

    Sets hold the distinct five-word shingles of the lower-cased (A-Z) text, or the whole sequence of
    fewer words.  Two documents are linked when 100 times the intersection is at least 75 times the union;
    ``component_id`` is the smallest doc_id that links reach.  Without words or text (null too) a set is
    empty and linked with nothing: component_id is the row's own doc_id.  Rows with null doc_id are in the
    component of documents with an equal set, or have null.  Repeated rows get equal rows; an empty
    table gives none.  Equal sets are one node, so copies are never compared.
    """
    docs = doc_text(docs, id_col, text_col)
    described = stage(docs.mapInArrow(_describe, SETS), "shingle-sets")
    rows = described.where("part is null").select("doc_id", "n_shingles", "set_id", "sketch")
    reps = stage(rows.where("n_shingles > 0").groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("min_doc_id"), F.first("sketch").alias("sketch")), "set-classes")
    total = reps.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 1 << max(8, (total * 13 // 2 // BUCKET_BYTES).bit_length())
    candidates = stage(_candidate_pairs(docs, _sketch(described), buckets), "candidates")
    labels = _components(docs, reps, candidates)
    classes = reps.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    classes = stage(classes.select("set_id", "component", "min_doc_id"), "class-components")
    least = stage(classes.groupBy("component").agg(F.min("min_doc_id").alias("component_id")), "component-ids")
    found = stage(classes.join(least, "component").select("set_id", "component_id"), "set-components")
    return rows.join(found, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_id")


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id is the component's.

    Documents with an empty set stay, and so do rows with null doc_id, which nothing can name.  Rows that repeat
    an id share its fate; an id of different texts goes only if none of them stays.  Only rows whose
    id may be among those that go are shuffled.
    """
    similar = similar_documents(docs, id_col, text_col).where("doc_id is not null")
    fate = similar.groupBy("doc_id").agg(F.min((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).alias("goes"))
    lost = stage(fate.where("goes").select("doc_id"), "lost-documents")
    (key,) = spare(docs, "lost_id")
    named = docs.withColumn(key, col(id_col).cast("long"))
    sure = maybe_in(named, col(key), lost, "left_anti").drop(key)
    asked = maybe_in(named, col(key), lost)
    return sure.unionByName(asked.join(lost.select(F.col("doc_id").alias(key)), key, "left_anti").drop(key))
