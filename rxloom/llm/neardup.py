"""Near-duplicate texts in a collection too large for pairwise comparison (problem 5).

Circulant MinHash: one permutation (sigma) places every word in a universe of UNIVERSE slots, a second
one (pi), circularly shifted by k, gives the k-th coordinate of the signature: a word at slot s gives
pi[s], pi[s+1], ... So the whole signature is the elementwise minimum of one contiguous slice of pi for
each word, and two permutations serve all coordinates. The coordinates are banded; texts that agree
in a band are candidates. Candidates are thinned by one-bit sketches and verified by the exact Jaccard
similarity of their words. With 64 bands of 9 a pair at similarity 0.8 is missed with probability
1e-4, one at 0.85 with 5e-8.

A bucket of a band is never expanded into all its pairs: each member is paired with the bucket's
first, the links found are joined into groups, and only members of different groups of one bucket
are paired after that, those whose sketches agree. Links inside a group can't change it, so none that
matters is lost. Exact copies are one text throughout.

Bands are shuffled as sorted arrays of short keys, about 7 bytes for each text and band, in parts of
PART_BYTES, whatever the size of the collection: each part is one task. A part that a frequent key makes
larger is spread over several tasks by chunk; each pairs its members with its own first, and the firsts
of one key are then paired with the first of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.llm.components import connected_components
from rxloom.session import Scratch

THRESHOLD = 0.8
BANDS, ROWS = 64, 9
UNIVERSE = 1 << 18
KEY_BYTES = 5
CHUNK = 1 << 15
SKETCH_BITS = 128
#: Of 128 one-bit coordinates a pair at similarity 0.8 agrees in 115 on average, sigma 3.4.
SKETCH_AGREE = 92
#: Ids up to so many are broadcast (16 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of keys that one task gathers and sorts; beyond SPREAD times as much a part is spread.
PART_BYTES, SPREAD = 15 << 20, 2
SEED = 20240229


def distinct_words(text: Column) -> Column:
    """The distinct lower-cased words (longest runs of letters and digits), each as a hash of 64 bits."""
    words = F.array_remove(F.split(F.lower(text), r"[^a-z0-9\p{L}\p{Nd}]+"), "")
    return F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))


def _pi(universe: int, coordinates: int) -> np.ndarray:
    pi = np.random.default_rng(SEED).permutation(universe).astype(np.uint32)
    return np.concatenate([pi, pi[:coordinates]])


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slots_of(hashes: np.ndarray, universe: int) -> np.ndarray:
    """The slots (sigma) of word hashes."""
    return (_mix(hashes) % np.uint64(universe)).astype(np.int32)


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each set of words, whatever their order: a sum of hashes, and one of mixed hashes."""
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(hashes, starts), np.add.reduceat(_mix(hashes + np.uint64(0x9E3779B97F4A7C15)), starts)], 1)


def signatures(slots: list[np.ndarray], pi: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima for each text's slots (none empty)."""
    slices = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    out = np.empty((len(slots), coordinates), np.uint32)
    for i, s in enumerate(slots):
        slices[s].min(axis=0, out=out[i])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int, key_bytes: int) -> np.ndarray:
    """A key of key_bytes bytes for each text and band."""
    held = sig.reshape(len(sig), bands, rows)
    odd = np.random.default_rng(SEED + 1).integers(1, 1 << 62, size=(bands, rows + 1), dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(odd[:, rows], (len(sig), bands)).copy()
        for r in range(rows):
            acc = _mix(acc + held[:, :, r].astype(np.uint64) * odd[:, r])
    return acc >> np.uint64(64 - 8 * key_bytes)


_SIGNED = "kind string, sid long, id long, fp binary, words int, sketch binary, pid int, base long, keys binary, ordinals binary"


def _binary(held: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array of bytes."""
    held = np.ascontiguousarray(held)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(held.shape[1]), len(held), [None, pa.py_buffer(held)]).cast(pa.binary())


def _rows(**columns) -> pa.RecordBatch:
    """Rows of _SIGNED; columns that aren't given are null."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    made = [pa.array(columns[c]).cast(types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in (x.split() for x in _SIGNED.split(", "))]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in _SIGNED.split(", ")])


def _signer(bands: int, rows: int, parts: int, key_bytes: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coordinates = max(bands * rows, SKETCH_BITS)
        pi = _pi(UNIVERSE, coordinates)
        context = TaskContext.get()
        task, chunks = context.partitionId() if context else 0, 0
        waiting: list[tuple] = []

        def flush():
            nonlocal chunks
            base = ((task << 24) + chunks) << 16
            chunks += 1
            ids, sizes, flat = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            fps, slots = fingerprints(flat, starts), slots_of(flat, UNIVERSE)
            order = np.lexsort(fps.T)  # equal texts beside each other
            fresh = np.r_[True, (fps[order[1:]] != fps[order[:-1]]).any(axis=1)]
            ordinal = np.empty(len(ids), np.int64)
            ordinal[order] = np.cumsum(fresh) - 1
            own, keys, bits = order[fresh], [], []
            for at in range(0, len(own), 256):
                sig = signatures([slots[starts[i] : starts[i] + sizes[i]] for i in own[at : at + 256]], pi, coordinates)
                keys.append(band_keys(sig[:, : bands * rows], bands, rows, key_bytes))
                bits.append(np.packbits((sig[:, :SKETCH_BITS] & 1).astype(bool), axis=1))
            yield _rows(kind=np.repeat("doc", len(ids)), sid=base + ordinal, id=ids, fp=_binary(fps.view(np.uint8)), words=sizes, sketch=_binary(np.concatenate(bits)[ordinal]))
            flat = np.concatenate(keys).ravel()
            ordinals = np.repeat(np.arange(len(own), dtype=np.uint16), bands)
            by = np.argsort(flat, kind="stable")
            flat, ordinals = flat[by], ordinals[by]
            cuts = np.searchsorted(flat, (np.arange(parts + 1, dtype=object) * (1 << 8 * key_bytes) // parts).astype(np.uint64))
            held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            raw = lambda p: flat[cuts[p] : cuts[p + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :key_bytes].tobytes()
            yield _rows(
                kind=np.repeat("band", len(held)), pid=np.array(held, np.int32), base=np.repeat(base, len(held)),
                keys=pa.array([raw(p) for p in held], pa.binary()), ordinals=pa.array([ordinals[cuts[p] : cuts[p + 1]].astype("<u2").tobytes() for p in held], pa.binary()),
            )

        for batch in batches:
            lists = batch.column("hashes")
            ends = lists.offsets.to_numpy()
            sizes = np.diff(ends)
            kept = sizes > 0  # a text without a word is no case
            if not kept.any():
                continue
            waiting.append((batch.column("id").to_numpy()[kept], sizes[kept].astype(np.int64), lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)))
            if sum(len(w[0]) for w in waiting) >= CHUNK:
                yield from flush()
        if waiting:
            yield from flush()

    return sign


def _pairs(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(kind, len(a)), pa.string()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["kind", "a", "b"])


def _bucketer(key_bytes: int):
    """Per partition of keys: ('pair', a, b) of each bucket's first with every other, and, of buckets
    of more than two, ('member', bucket, sid) for the second pass. Equal buckets are given once. Of a
    spread part also ('head', key, first), and ('spread', key, sid) of all members.

    A key and the place of its text (chunk and ordinal) are one number of 64 bits: the more chunks there
    are, the more parts, and the fewer bits the keys of one part need."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spread = [], False
        for batch in batches:
            for base, raw, ordinals, part in zip(*(batch.column(c).to_pylist() for c in ("base", "keys", "ordinals", "spread"))):
                held.append((base, raw, ordinals))
                spread = part
        if not held:
            return
        held.sort(key=lambda h: h[0])
        bases = np.array([h[0] for h in held], np.int64)
        low = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, key_bytes)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :key_bytes] = low
        key = wide.view("<u8").ravel()
        place = np.frombuffer(b"".join(h[2] for h in held), "<u2").astype(np.uint64) | np.repeat(np.arange(len(held), dtype=np.uint64) << np.uint64(16), [len(h[2]) // 2 for h in held])
        del held, low, wide
        least, width = key.min(), 16 + int(len(bases) - 1).bit_length()
        if int(key.max() - least).bit_length() + width > 64:
            raise ValueError("a part holds too many chunks")
        one = (key - least) << np.uint64(width) | place
        one.sort()
        key, place = one >> np.uint64(width), one & np.uint64((1 << width) - 1)
        sid_of = lambda p: bases[(p >> np.uint64(16)).astype(np.int64)] + (p & np.uint64(0xFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        if spread:
            yield _pairs("head", (key + least)[starts], sid_of(place[starts]))
            yield _pairs("spread", key + least, sid_of(place))
        several = sizes > 1
        starts, sizes = starts[several], sizes[several]
        if not len(starts):
            return
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1]) - np.repeat(np.r_[0, ends[:-1]], sizes)
        member, first = place[np.repeat(starts, sizes) + within], place[np.repeat(starts, sizes)]
        other = member != first
        if 2 * width > 64:
            raise ValueError("a part holds too many chunks")
        pairs = np.unique(first[other] << np.uint64(width) | member[other])
        yield _pairs("pair", sid_of(pairs >> np.uint64(width)), sid_of(pairs & np.uint64((1 << width) - 1)))
        if (sizes > 2).any() and not spread:
            # a bucket is named by a hash of its members, so that equal ones come once
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(_mix(sid_of(member).astype(np.uint64) + np.uint64(1)), np.r_[0, ends[:-1]])
            chosen = np.zeros(len(sizes), bool)
            chosen[np.unique(sums, return_index=True)[1]] = True
            chosen = np.repeat(chosen & (sizes > 2), sizes)
            yield _pairs("member", np.repeat(sums, sizes)[chosen].view(np.int64), sid_of(member[chosen]))

    return bucket


def _placed(chunks: DataFrame, parts: int, part_bytes: int) -> DataFrame:
    """The chunks of each part (pid) in one partition, of a large one in several, by their base.

    Only the large parts are named to all tasks: there are fewer of them than 1/SPREAD of the parts."""
    sized = chunks.groupBy("pid").agg(F.sum(F.length("keys") + F.length("ordinals")).alias("bytes")).where(F.col("bytes") > SPREAD * part_bytes)
    large = sized.withColumn("n", F.ceil(F.col("bytes") / part_bytes)).select("pid", "n").orderBy("pid").collect()
    if not large:
        return chunks.withColumn("spread", F.lit(False)).repartitionById(parts, F.col("pid"))
    ahead, rows = parts, []
    for r in large:
        rows.append((r["pid"], ahead, r["n"]))
        ahead += r["n"]
    named = chunks.sparkSession.createDataFrame(rows, "pid int, start long, n long")
    slot = F.when(F.col("start").isNull(), F.col("pid")).otherwise(F.col("start") + F.pmod(F.xxhash64("base"), F.col("n"))).cast("int")
    marked = chunks.join(F.broadcast(named), "pid", "left").select("pid", "base", "keys", "ordinals", F.col("start").isNotNull().alias("spread"), slot.alias("slot"))
    return marked.repartitionById(ahead, F.col("slot")).drop("slot")


def _agreeing(a: str, b: str) -> Column:
    """How many bits two sketches (as four longs) share."""
    same = None
    for k in range(SKETCH_BITS // 64):
        n = F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
        same = n if same is None else same + n
    return F.lit(SKETCH_BITS) - same


def near_duplicates(
    spark: SparkSession, texts: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, parts: int | None = None, key_bytes: int = KEY_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """id, group_id, links of every text (id, text) in a group of two or more; group_id is its smallest id.

    Null and blank texts, and texts without a letter or digit, are no cases; a row given twice counts
    once. links is the number of other texts with which the text was verified to be linked (copies of
    one text count as one). Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    parts = parts or max(8, -(-texts.count() * bands * (key_bytes + 2) // part_bytes))
    source = texts.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    hashed = source.select("id", distinct_words(F.col("text")).alias("hashes"))
    signed_at = f"{scratch.root}/signed"
    hashed.mapInArrow(_signer(bands, rows, parts, key_bytes), _SIGNED).write.partitionBy("kind").option("compression", "zstd").parquet(signed_at)
    signed = spark.read.schema(_SIGNED).parquet(signed_at)
    word = lambda k: F.conv(F.substring(F.hex("sketch"), 1 + 16 * k, 16), 16, -10).cast("long").alias(f"s{k}")
    docs = signed.where("kind = 'doc'").select("sid", "id", "fp", "words", *(word(k) for k in range(SKETCH_BITS // 64)))
    owners = docs.groupBy("fp").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    chunks = _placed(signed.where("kind = 'band'").select("pid", "base", "keys", "ordinals"), parts, part_bytes)
    buckets, _ = scratch.keep(chunks.mapInArrow(_bucketer(key_bytes), "kind string, a long, b long"))
    # firsts of one key in several tasks; without spread parts these are empty
    heads = buckets.where("kind = 'head'").select(F.col("a").alias("key"), F.col("b").alias("sid"))
    across_tasks = heads.join(heads.groupBy("key").agg(F.min("sid").alias("first"), F.count("*").alias("n")).where("n > 1"), "key").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    spread = buckets.where("kind = 'spread'").select(F.xxhash64("a").alias("bucket"), F.col("b").alias("sid"))
    wide = spread.join(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2").select("bucket"), "bucket")
    sketches, _ = scratch.keep(
        docs.groupBy("sid").agg(F.min("fp").alias("fp"), F.min("words").alias("words"), *(F.min(f"s{k}").alias(f"s{k}") for k in range(SKETCH_BITS // 64))).join(owners.select("fp", "rep"), "fp").drop("fp")
    )
    scratch.drop(f"{signed_at}/kind=band")

    held = F.struct("rep", "words", *(f"s{k}" for k in range(SKETCH_BITS // 64)))

    def likely() -> Column:
        """Of sketches x and y of different texts: they agree, and so do the numbers of words."""
        return (F.col("x.rep") != F.col("y.rep")) & (F.least("x.words", "y.words") >= threshold * F.greatest("x.words", "y.words")) & (_agreeing("x", "y") >= SKETCH_AGREE)

    def by_rep(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()

    def thinned(pairs: DataFrame) -> DataFrame:
        """a, b (representatives' ids) of the pairs of sids whose sketches agree."""
        return by_rep(pairs.join(sketches.select(F.col("sid").alias("a"), held.alias("x")), "a").join(sketches.select(F.col("sid").alias("b"), held.alias("y")), "b").where(likely()))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose words have the similarity, exactly. Only the texts in question are moved."""
        pairs, _ = scratch.keep(pairs)
        wanted, _ = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        few = wanted.count() <= BROADCAST_IDS
        asked = source.dropDuplicates(["id"]) if not few else source.join(F.broadcast(wanted), "id", "left_semi").dropDuplicates(["id"])
        words = asked.select("id", distinct_words(F.col("text")).alias("w"))  # taken once a text, not once a pair
        both = pairs.join(words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
        common = both.withColumn("n", F.size(F.array_intersect("wa", "wb")))
        return common.where(F.col("n") >= threshold * (F.size("wa") + F.size("wb") - F.col("n")) - 1e-9).select("a", "b")

    found, _ = scratch.keep(verified(thinned(buckets.where("kind = 'pair'").select("a", "b").unionByName(across_tasks).distinct())))
    groups = connected_components(spark, found)
    # members of one bucket that are in different groups so far: every such pair is looked at
    grouped = (
        buckets.where("kind = 'member'").select(F.col("a").alias("bucket"), F.col("b").alias("sid")).unionByName(wide).distinct()
        .join(sketches.select("sid", "rep"), "sid").join(groups.select(F.col("node").alias("rep"), F.col("component").alias("g")), "rep", "left")
        .select("bucket", "sid", F.coalesce("g", "rep").alias("g"))
    )
    # every such pair has a member outside the bucket's largest group: these meet all, the largest group doesn't meet itself
    sizes = grouped.groupBy("bucket", "g").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    open_, _ = scratch.keep(grouped.join(sizes.select("bucket", "main"), "bucket"))
    # a bucket's pairs are thinned where they arise
    told = open_.join(sketches.select("sid", held.alias("h")), "sid").select("bucket", "g", "main", "h")
    met = told.where("g <> main").select("bucket", F.col("g").alias("gx"), F.col("h").alias("x")).join(told.select("bucket", F.col("g").alias("gy"), F.col("h").alias("y")), "bucket")
    also, _ = scratch.keep(verified(by_rep(met.where((F.col("gx") != F.col("gy")) & likely()))))
    links = found
    if not also.isEmpty():
        links, _ = scratch.keep(found.unionByName(also).distinct())
        groups = connected_components(spark, links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    placed = owners.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("g")), "rep", "left").join(degree, "rep", "left")
    cases = placed.where("g is not null or copies > 1").select("fp", F.coalesce("g", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return docs.select("id", "fp").distinct().join(cases, "fp").select("id", "group_id", "links")
