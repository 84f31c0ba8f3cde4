"""Operator 8: SimHash fingerprints, linked at few differing bits through anchor points of a covering code.

A 64-bit fingerprint is split into three parts; if two differ in at most five bits, they differ in at most one bit of
some part. The anchors of a part are the words of a linear code of covering radius 1, a Hamming code on 15 bits beside
the bare other bits (262,144 anchors of the part of 22 bits, 131,072 of each of 21): every part lies within one bit of an anchor, its home. A part is replicated
to every anchor within two bits, so a pair that differs in one bit of the part meets at the home of either. Homes and
replicas are compared at each anchor by all 64 bits. Nothing is lost.

Equal fingerprints are one row from the start. Anchors with more than HOMES homes are split by salt, their replicas
repeated for each salt. An anchor gives a spanning forest of its links, not all pairs.

Null and empty text has fingerprint zero and links like any other. Null doc_ids are kept and take part; component_id is
the smallest id that is not null, or null. Repeated rows and ties give equal results. An empty table gives an empty table.
Texts of any length are taken whole, in memory in proportion to the longest. Other columns are left out; a key that is called
like a column of the result is refused.

Near copies in the pipeline (near_copies) are texts whose sets of COPY_SHINGLE words have a Jaccard similarity of at least SIMILAR.
Fingerprints and their links by anchors are taken as above; texts that these links join are one band, and an exact check of the
sets follows. Fingerprints of pairs at 0.8 differ in about ten bits of 64, where no covering code tells them from chance, so sets
also share one of BANDS bands of BAND minima (a pair at 0.8 is missed with probability 0.0002), and the sets of every band are
compared exactly. A band of many sets is dealt to groups of
about GROUP, each with the band's first set, its pivot; sets that aren't linked to the pivot within their group are then
compared with all sets of the band, GROUP by GROUP. Two sets that are both linked to the pivot need no comparison. So no link is lost, a
task holds twice GROUP sets, and a large group of near copies costs its size and not its square."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialize, small_batches, table, texts_of
from .components import components, stars

SHINGLE = 4
SEED = 42
DISTANCE = 4
PARTS = ((0, 22), (22, 21), (43, 21))
#: Bits of the widest part; a part's number stands above them in an anchor.
BITS = 22
RADIUS = 1
#: near_copies: words of a shingle, similarity, bands and minima of a band.
COPY_SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND = 16, 4
#: Sets of a band that are compared with each other, or with as many others, in one task.
GROUP = 400
#: Homes of an anchor in one task.
HOMES = 20_000


def fingerprint(text: str) -> int:
    """Signed 64-bit number; a bit is set if it is set in over half the shingles' hashes."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        said = [b" ".join(words)]
    else:
        said = list(map(b" ".join, zip(words, words[1:], words[2:], words[3:], strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in said), dtype=np.uint64, count=len(said))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key and fp (long)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts_of(batch, "__text")], pa.int64())], ["__key", "fp"])

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=len(PARTS))
def covering(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of parts of n bits, for each syndrome: the pattern to the home; then all patterns to anchors within radius + 1, with their bounds; last the bits' parity checks."""
    columns = [*range(1, 16), *[0] * (n - 15)]  # a Hamming code on 15 bits; the others are in no check
    by: list[list[int]] = [[] for _ in range(16)]
    for weight in range(RADIUS + 2):
        for bits in combinations(range(n), weight):
            s = p = 0
            for b in bits:
                s ^= columns[b]
                p |= 1 << b
            by[s].append(p)  # by weight, so the first is the home's
    if any(not x or x[0].bit_count() > RADIUS for x in by):
        raise AssertionError("the code doesn't cover")
    bounds = np.cumsum([0, *map(len, by)])
    return np.array([x[0] for x in by], dtype=np.int64), np.array([p for x in by for p in x], dtype=np.int64), bounds, np.array(columns, dtype=np.int64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor (with its part's number above), home (whether it is the home) and the row of fp."""
    out = []
    for k, (low, n) in enumerate(PARTS):
        home, patterns, bounds, columns = covering(n)
        part = (fp >> low) & ((1 << n) - 1)
        s = np.zeros(len(fp), dtype=np.int64)
        for b in range(n):
            s ^= columns[b] * ((part >> b) & 1)
        sizes = bounds[s + 1] - bounds[s]
        row = np.repeat(np.arange(len(fp)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[s], sizes)
        out.append(((k << BITS) | (part[row] ^ patterns[at]), patterns[at] == home[s[row]], row))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _replicate(homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            anchor, home, row = anchors(fp)
            if homes_only:
                anchor, row, home = anchor[home], row[home], home[home]
            for i in range(0, len(anchor), 50_000):
                c = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[c], pa.int32()), pa.array(home[c]), pa.array(fp[row[c]])], ["anchor", "home", "fp"])

    return run


def _compare(distance: int):
    """Rows come sorted by anchor and salt, homes first. A group's homes stay in memory, its replicas pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, links = None, [], []

        def close() -> pa.RecordBatch | None:
            if not links:
                return None
            node, root = stars(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            home, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            edges = np.flatnonzero(np.diff(key)) + 1
            for i, j in zip([0, *edges], [*edges, len(key)], strict=True):
                if key[i] != now:
                    if (made := close()) is not None:
                        yield made
                    now, homes = key[i], []
                own = home[i:j]
                homes.append(fp[i:j][own])
                base = np.concatenate(homes) if len(homes) > 1 else homes[0]
                homes = [base]
                if len(base) == 0:
                    continue
                step = max(1, 2_000_000 // len(base))
                for s in range(i, j, step):
                    some = fp[s : min(j, s + step)]
                    near = np.bitwise_count((some[:, None] ^ base[None, :]).view(np.uint64)) <= distance
                    x, y = np.nonzero(near)
                    if len(x) > len(some):  # more than each with itself
                        apart = some[x] != base[y]
                        links.append(stars(some[x][apart], base[y][apart]))
                    elif len(x):
                        apart = some[x] != base[y]
                        if apart.any():
                            links.append((some[x][apart], base[y][apart]))
                if sum(len(x) for x, _ in links) > 1_000_000:
                    links[:] = [stars(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))]
        if (made := close()) is not None:
            yield made

    return run


def links(fps: DataFrame, distance: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """node, root: a forest with the components of all pairs of distinct fingerprints (column fp) at most `distance` <= 5 bits apart."""
    if distance > 5:
        raise ValueError("three parts cover up to five bits")
    ddl = "anchor int, home boolean, fp long"
    crowded = fps.mapInArrow(_replicate(True), ddl).groupBy("anchor").count().where(F.col("count") > homes)
    crowded = materialize(crowded.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("salts")), "anchors")
    rows = join_checked(fps.mapInArrow(_replicate(False), ddl), crowded, "anchor").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # homes are dealt to salts; every row, homes too, is a replica for the homes under the other salts
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("home"), own)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = rows.select("anchor", "salt", (F.col("home") & (F.col("salt") == F.col("own"))).alias("home"), "fp")
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return rows.mapInArrow(_compare(distance), "node long, root long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """key, fp (long) and component_id (smallest key reachable)."""
    if key in ("fp", "component_id"):
        raise ValueError(f"the operator makes {key} itself")
    own = materialize(fingerprints(df, key, text), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("__key").alias("__least")), "fps")
    found = components(links(least.select("fp"), distance, homes))
    named = least.join(found, least["fp"] == found["node"], "inner").select("fp", "root", "__least")
    smallest = named.groupBy("root").agg(F.min("__least").alias("component_id"))
    linked = named.join(smallest, "root").select("fp", "component_id")
    known = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "__least").alias("component_id"))
    known = materialize(known, "known")  # a plain shuffle on either side of the join, so that AQE can split a fingerprint that many documents share
    return own.join(known, "fp").select(F.col("__key").alias(key), "fp", "component_id")


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the different shingles of COPY_SHINGLE words; of fewer words, of all of them."""
    words = text.encode("utf-8").lower().split()
    said = {b" ".join(words[i : i + COPY_SHINGLE]) for i in range(max(1, len(words) - COPY_SHINGLE + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in said), dtype=np.uint64, count=len(said)))


def bands(said: np.ndarray) -> list[int]:
    """A number for each band of minima; none of an empty set."""
    if not len(said):
        return []
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND), dtype=np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(said), 4096):
        least = np.minimum(least, ((said[i : i + 4096, None] ^ odd[0]) * (odd[1] | np.uint64(1))).min(axis=0))
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(least[BAND * t : BAND * (t + 1)].tobytes(), t)).view(np.int64))) for t in range(BANDS)]


def _name(said: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(said.tobytes(), SEED)).view(np.int64))


class Holders:
    """Sets by their members, for comparing others with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.members, self.counts = np.unique(every, return_counts=True)
        self.starts = np.cumsum(self.counts) - self.counts
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def jaccard(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.members, own).clip(0, len(self.members) - 1)
        at = at[self.members[at] == own]
        n = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.holder[places], minlength=len(self.sizes))
        return shared / (self.sizes + len(own) - shared)


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first set reachable from each by pairs of at least this Jaccard similarity."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    lab = np.arange(n)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
    met = np.bincount(at)
    ends = np.cumsum(met)
    starts = np.cumsum(sizes) - sizes
    for x in range(n):
        if not lab.any():  # all are linked to the first
            break
        own = at[starts[x] : starts[x] + sizes[x]]
        own = own[met[own] > 1]
        if len(own):
            shared = np.zeros(n, dtype=np.int64)
            for o in own:
                shared[holder[ends[o] - met[o] : ends[o]]] += 1
            near = lab[shared >= similarity * (sizes + sizes[x] - shared) - 1e-9]
            if len(near) and (near != lab[x]).any():
                joined = np.zeros(n, dtype=bool)
                joined[near] = joined[lab[x]] = True
                lab[joined[lab]] = np.flatnonzero(joined)[0]
    return lab


def _in_groups(dealt: DataFrame, said: DataFrame) -> DataFrame:
    """Every set beside its band and group; a group's rows together, those that are first before the others."""
    return dealt.join(said, "name").select("band", "group", "groups", "first", "name", "said").repartition("band", "group").sortWithinPartitions("band", "group", F.desc("first"), "name")


def _edges(band: int, node: np.ndarray, root: np.ndarray | None) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(node), band)), pa.array(node), pa.array(root) if root is not None else pa.nulls(len(node), pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["band", "node", "root"])


def _within(similarity: float):
    """Links within each group; of bands in several groups also the sets that aren't linked to the first, with root null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            if names:
                name, lab = np.array(names, dtype=np.int64), similar(held, similarity)
                root = name[lab]
                yield _edges(now[0], name[root != name], root[root != name])
                if now[2] > 1:
                    yield _edges(now[0], name[lab != 0], None)

        now, names, held = None, [], []
        for batch in batches:
            sets = batch.column("said")
            for i, at in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "group", "groups")), strict=True)):
                if at != now:
                    yield from close()
                    now, names, held = at, [], []
                names.append(batch.column("name")[i].as_py())
                held.append(sets[i].values.to_numpy())
        yield from close()

    return run


def _across(similarity: float):
    """A forest of the links between each group's first sets and those that come after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held, known, links = None, [], [], None, []

        def close() -> Iterator[pa.RecordBatch]:
            if links:
                node, root = stars(*(np.array(x, dtype=np.int64) for x in zip(*links, strict=True)))
                links.clear()
                yield _edges(now[0], node, root)

        for batch in batches:
            sets = batch.column("said")
            for i, (band, group, first, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "group", "first", "name")), strict=True)):
                if (band, group) != now:
                    yield from close()
                    now, names, held, known = (band, group), [], [], None
                if first:
                    names.append(name)
                    held.append(sets[i].values.to_numpy())
                    continue
                if not held:  # no stray was dealt here
                    continue
                if known is None:
                    known = Holders(held)
                near = np.flatnonzero(known.jaccard(sets[i].values.to_numpy()) >= similarity - 1e-12).tolist()
                links += [(name, names[j]) for j in near if names[j] != name]
                if len(links) > 500_000:
                    links[:] = list(zip(*(x.tolist() for x in stars(*(np.array(x, dtype=np.int64) for x in zip(*links, strict=True)))), strict=True))
        yield from close()

    return run


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILAR, group: int = GROUP, distance: int = DISTANCE) -> DataFrame:
    """key (of any type that can be ordered) and component_id (smallest key reachable) of the rows that have a key; texts without words are equal."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shingles(t) for t in texts_of(batch, "__text")]
            fps = [fingerprint(t) for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_name(x) for x in said], pa.int64()), pa.array([bands(x) for x in said], pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["__key", "name", "bands", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shingles(t) for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in said], pa.int64()), pa.array([x.view(np.int64) for x in said], pa.list_(pa.int64()))], ["name", "said"])

    own = materialize(rows.mapInArrow(named, f"__key {kind}, name long, bands array<long>, fp long"), "names")
    least = materialize(own.groupBy("name").agg(F.min("__key").alias("__least"), F.first("bands").alias("bands")), "sets")
    # texts that links of fingerprints join are a band too; texts without words have no set to compare
    prints = materialize(own.where(F.size("bands") > 0).select("name", "fp").distinct(), "fingerprints")
    linked = components(links(prints.select("fp").distinct(), distance))
    prints = prints.join(linked, prints["fp"] == linked["node"], "left").select("name", F.xxhash64(F.lit(BANDS), F.coalesce("root", "fp")).alias("band"))
    cells = materialize(least.select("name", F.explode("bands").alias("band")).unionAll(prints).distinct(), "cells")
    met = cells.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("name")).alias("who"), F.min("name").alias("pivot")).where("n > 1")
    met = met.groupBy("n", "who", "pivot").agg(F.min("band").alias("band"))  # bands with the same members are compared once
    met = materialize(met.select("band", "pivot", F.ceil(F.col("n") / group).cast("int").alias("groups")), "bands")
    members = materialize(cells.join(met, "band"), "members")
    asked = members.select("name").distinct().join(least, "name").select(F.col("__least").alias("__key")).distinct()
    said = join_checked(rows, materialize(asked, "asked"), "__key", "left_semi").mapInArrow(sets, "name long, said array<long>")
    said = materialize(said.groupBy("name").agg(F.first("said").alias("said")), "said")
    groups = F.sequence(F.lit(0), F.col("groups") - 1)
    dealt = members.select("band", "groups", "name", (F.col("name") == F.col("pivot")).alias("first"))
    dealt = dealt.withColumn("group", F.explode(F.when(F.col("first"), groups).otherwise(F.array(F.pmod(F.xxhash64("name"), F.col("groups")).cast("int")))))
    ddl = "band long, node long, root long"
    near = _in_groups(dealt, said).mapInArrow(_within(similarity), ddl)
    near = materialize(near, "near")
    strays = near.where("root is null").select("band", F.col("node").alias("name"))
    deal = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    split = strays.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("held"))
    split = materialize(split.join(met, "band").select("band", "held", F.col("groups").alias("passing")), "strays")
    # each part of the strays meets each part of the band
    homes = strays.join(split, "band").withColumn("part", every(F.col("passing"))).select("band", "name", F.lit(True).alias("first"), (deal(F.col("held")) * F.col("passing") + F.col("part")).alias("group"))
    others = members.select("band", "name").join(split, "band").withColumn("part", every(F.col("held"))).select("band", "name", F.lit(False).alias("first"), (F.col("part") * F.col("passing") + deal(F.col("passing"))).alias("group"))
    far = _in_groups(homes.unionAll(others).withColumn("groups", F.lit(0)), said).mapInArrow(_across(similarity), ddl)
    found = components(near.where("root is not null").select("node", "root").unionAll(far.select("node", "root")))
    linked = least.select("name", "__least").join(found, least["name"] == found["node"], "left").select("name", "__least", F.coalesce("root", "name").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("__least").alias("component_id"))
    known = materialize(linked.join(smallest, "root").select("name", "component_id"), "known")
    return own.select("__key", "name").join(known, "name").select(F.col("__key").alias(key), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
