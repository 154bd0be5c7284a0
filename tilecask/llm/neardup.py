"""MinHash near-dedup with odd sketches, exact confirmation and components.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set is its distinct k-word
shingles (fewer words, but not none: the whole sequence as one). Documents are linked where
``100 * |intersection| >= percent * |union|``; components follow from the links.

1. Signatures. Each set gives 160 MinHash samples, cut into 32 bands of 5, and an odd sketch: the samples' hashes toggle
   bits of a 512-bit map, so that the number of ones in the XOR of two sketches estimates how many samples differ.
   Documents with equal sets (a 128-bit digest) are one class from here on, named by its smallest id; its copies are
   never paired. At similarity 0.8 a pair shares no band with probability 3e-6.
2. Candidates. Classes that share a band meet: in buckets of at most ``SMALL`` classes all pairs; of its larger buckets
   each class meets the leaders of two, so that groups of near copies collapse at two pairs a class. Pairs whose set sizes or sketches rule the threshold out (beyond five standard deviations,
   probability 3e-7) go.
3. Confirmation on the full sets, as sorted arrays of 64-bit shingle hashes. Texts are read once more for the classes
   that are in a pair; they never travel. Pairs are grouped by the least id near both ends, so that those of a cluster
   meet in one place, and a set goes once to each group that has a pair of it, not to each pair. Groups of more than some
   ``GROUP_PAIRS`` or ``GROUP_SHINGLES`` are dealt into parts by the end of a pair that is in fewer pairs; each pair is in
   one part.
4. Larger buckets in which several components are left are compared exactly in blocks: the rows of a bucket are dealt
   into blocks of some ``BLOCK`` rows, a component that fills a block has blocks of its own, and two blocks meet in one
   task unless both belong to one such component. Inside, numpy rules pairs out by component, size, an earlier shared
   band (they were compared there) and sketch. Few remaining pairs go through step 3. Where they are many, the blocks
   meet once more with their shingles: those that two rows share become bitmaps, whose AND gives the intersections, and
   of the confirmed links one at most for two components comes out, fewer than the blocks have rows.

No bucket or group is cut, and no pair of a large bucket becomes a row. The work of step 4 grows with the square of the
number of classes in a bucket that no leader joins (pages on one template with similarities just under the threshold),
spread over that many pairs of blocks; groups of near copies collapse in step 2 and cost their number of rows.

Groups of any size (copies, buckets, a leader's pairs, a hub of links) are dealt over several tasks wherever they are joined.

Rows with one doc_id are one document: linked where any of their texts is. Repeated rows are one class and change
nothing. Documents without words (null, empty or blank texts) are linked with nothing; rows with a null id take no part,
have a null component and are kept. Very long texts are one row like others. An empty table gives an empty one; columns
beyond id and text are not looked at, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dealt import dealt, mask
from .common import WordHash, evenly, forget, hashed, mixed, slices, written

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SMALL = 12
#: Rows and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: A pair of blocks gives so many candidates, and one more for four of its rows, or is compared as a whole.
FEW_PAIRS = 64
#: Pairs that are confirmed in one place, and shingles of their sets, as pairs count them.
GROUP_PAIRS, GROUP_SHINGLES = 128, 1 << 20
#: A filter of ids has so many words of 64 bits, 8 MB. Up to three ids a word, under 1 % of other ids pass.
FEW_NODES = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of one document's word hashes, as sorted 64-bit hashes."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    take = min(k, len(h))
    out = np.full(n, take, np.uint64)
    for j in range(take):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


class Signer:
    """Signatures of documents: set size, set digest, band keys and odd sketch."""

    def __init__(self, k: int, seed: int = 97):
        self.k, self.known = k, WordHash()
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
        self.band_salt = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.sample_salt = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(s), 512):
            x = s[at : at + 512, None] * self.a[None, :]
            x += self.b
            np.minimum(out, x.min(0), out=out)
        return out

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        flat, starts = hashed([words_of(t) for t in texts], self.known)
        sets = [shingle_hashes(flat[a:b], self.k) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        digest = [_digest(s) for s in sets]
        minima = np.stack([self.minima(s) for s in sets])
        bands = np.zeros((len(sets), BANDS), np.uint64) + self.band_salt
        parts = minima.reshape(len(sets), BANDS, ROWS)
        for j in range(ROWS):
            bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
        bit = mixed(minima ^ self.sample_salt) % np.uint64(64 * SKETCH_WORDS)
        parity = np.zeros((len(sets), 64 * SKETCH_WORDS), np.uint8)
        np.add.at(parity, (np.arange(len(sets))[:, None], bit.astype(np.int64)), 1)
        sketch = np.packbits(parity & 1, axis=1).view(">u8").astype(np.uint64)
        return {"n": [len(s) for s in sets], "key": digest, "bands": bands.view(np.int64), "sketch": sketch.view(np.int64)}


def most_ones(percent: int) -> int:
    """The largest number of ones in the XOR of two odd sketches that a pair at the threshold may show: the mean and
    five standard deviations, of the number of differing samples and of the bits that they share."""
    j, m = percent / 100, 64 * SKETCH_WORDS
    differ = 2 * SAMPLES * (1 - j)
    ones = m / 2 * (1 - np.exp(-2 * differ / m))
    samples = 2 * np.sqrt(SAMPLES * j * (1 - j)) * np.exp(-2 * differ / m)
    bits = np.sqrt(m / 4 * (1 - np.exp(-4 * differ / m)))
    return int(np.ceil(ones + 5 * np.hypot(samples, bits)))


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        sign = Signer(k)
        for part in slices(batches):
            s = sign(part.column("text").to_pylist())
            bands = pa.FixedSizeListArray.from_arrays(pa.array(s["bands"].ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(s["n"], pa.int64()), pa.array(s["key"], pa.binary()), bands, *(pa.array(np.ascontiguousarray(s["sketch"][:, i])) for i in range(SKETCH_WORDS))],
                ["doc_id", "n", "key", "bands", *SKETCH],
            )

    return docs.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _may_link(percent: int, x: str, y: str) -> Column:
    """Whether set sizes and sketches allow a link of two rows, whose columns begin with ``x`` and ``y``."""
    differ = [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in SKETCH]
    few, many = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    return (few * 100 >= many * percent) & (sum(differ[1:], differ[0]) <= most_ones(percent))


def _named(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select(F.col("rep").alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def _with_both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of ``of`` (rep, ...) for both ends; a is the end that many pairs may share."""
    hubs = pairs.groupBy("a").agg(mask("b")).join(_named(of, "a", columns), "a")
    return dealt(pairs.join(_named(of, "b", columns), "b"), hubs, ["a"], "b")


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``rep`` is in ``nodes`` (rep), and a few others; rows stay where they are.

    What is broadcast is a Bloom filter of ``FEW_NODES`` words, however many nodes there are: an id sets three bits of one
    word. With more nodes more others pass, and none that is wanted is lost.
    """
    h = F.xxhash64("rep", F.lit(13))
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int")) for at in (40, 46, 52)]
    told = lambda df: df.withColumns({"__word": F.pmod(h, F.lit(max(1, FEW_NODES))), "__bits": bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2])})
    words = told(nodes.select("rep")).groupBy("__word").agg(F.bit_or("__bits").alias("__all"))
    return told(rows).join(F.broadcast(words), "__word").where("rep is not null and __all & __bits = __bits").drop("__word", "__bits", "__all")


def _sets(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """rep, key, h (sorted shingle hashes) of the texts of the ids in ``nodes`` (rep) and a few others; each once, in the
    partitions of rep."""

    def run(batches):
        known, seen = WordHash(), set()
        for part in slices(batches):
            flat, starts = hashed([words_of(t) for t in part.column("text").to_pylist()], known)
            sets = [shingle_hashes(flat[a:b], k) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            reps, digests, new = part.column("rep").to_pylist(), [_digest(x) for x in sets], []
            for i, one in enumerate(zip(reps, digests, strict=True)):
                if one not in seen:  # repeated rows end here, so that no id has more rows than texts in a task
                    seen.add(one)
                    new.append(i)
            edges = np.zeros(len(new) + 1, np.int32)
            np.cumsum([len(sets[i]) for i in new], out=edges[1:])
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in new)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i in new], pa.int64()), pa.array([digests[i] for i in new], pa.binary()), pa.ListArray.from_arrays(pa.array(edges), values)], ["rep", "key", "h"])

    texts = _among(evenly(rows).select(F.col("doc_id").alias("rep"), "text"), nodes)
    return texts.mapInArrow(run, "rep long, key binary, h array<long>").repartition("rep").groupBy("rep", "key").agg(F.any_value("h").alias("h"))


def _grouped(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, g, part: each of ``pairs`` (a, b) once, and the part of a group in which it is confirmed."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    ends = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"), mask("v")).withColumn("m", F.least("u", "m"))
    ends = ends.join(classes.groupBy(F.col("rep").alias("u")).agg(F.sum("n").alias("n")), "u")
    told = dealt(both, ends, ["u"], "v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    each = written(told.agg(F.min("m").alias("g"), F.sum("n").alias("n"), F.min(F.struct("d", "u"))["u"].alias("x")))
    parts = F.ceil(F.greatest(F.count("*") / GROUP_PAIRS, F.sum("n") / GROUP_SHINGLES)).alias("parts")
    groups = each.groupBy("g").agg(parts, mask("x"))
    part = F.pmod(F.xxhash64("x", F.lit(11)), F.col("parts")).alias("part")
    out = written(dealt(each, groups, ["g"], "x").select("a", "b", "g", part))
    forget(each)
    return out


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: those of ``pairs`` (a, b) whose full sets are similar enough."""
    grouped = _grouped(pairs, classes)
    ends = grouped.select(F.explode(F.array("a", "b")).alias("rep"), F.struct("g", "part").alias("to"))
    sets = _sets(rows, ends, k).join(ends.groupBy("rep").agg(F.collect_set("to").alias("to")), "rep")
    sent = sets.select(F.explode("to").alias("to"), "rep", "h").select("to.g", "to.part", F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "h")
    asked = grouped.select("g", "part", "a", "b", F.lit(None).cast("array<long>").alias("h"))
    met = sent.unionByName(asked).repartition("g", "part").sortWithinPartitions("g", "part")
    out = written(met.mapInArrow(_similar(percent), "u long, v long"), records=2000)
    forget(grouped)
    return out


def _similar(percent: int):
    """For sorted rows of sets (g, part, a: id, h) and pairs (g, part, a, b): the pairs that are links."""

    def links(sets, pairs):
        for a, b in pairs:
            if any(_linked(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ())):
                yield a, b

    def run(batches):
        at, sets, pairs = None, {}, []
        for batch in batches:
            out, h = [], batch.column("h")
            for r, (g, part, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "part", "a", "b")), strict=True)):
                if (g, part) != at:
                    out += links(sets, pairs)
                    at, sets, pairs = (g, part), {}, []
                if b is None:
                    sets.setdefault(a, []).append(h[r].values.to_numpy(zero_copy_only=False))
                else:
                    pairs.append((a, b))
            yield _links(out)
        yield _links(list(links(sets, pairs)))

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= (len(x) + len(y)) * percent


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, root of each node of ``links`` (u, v): the smallest node of its component.

    Alternates large and small stars until every node hangs on a root; each round is one written table.
    """
    pairs = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), mask("v")).withColumn("m", F.least("u", "m"))
        large = dealt(both, least, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"), mask("v"))
        hung = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        before, pairs = pairs, written(dealt(large, small, ["u"], "v").select(F.explode(hung).alias("p")).select("p.*").where("u <> v").distinct())
        forget(before)
        # Done when no node hangs on two nodes, or on one that hangs itself.
        ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``. Ids are integers."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signatures = written(_signatures(evenly(rows), k))
    # A class: all documents with one set. Its representative is its smallest id.
    classes = written(signatures.where("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), mask("doc_id"), *(F.any_value(c).alias(c) for c in ("n", "bands", *SKETCH))))
    signed = written(signatures.select("doc_id", "n", "key"))  # from here on bands and sketches are those of classes
    forget(signatures)
    part = signed.where("doc_id is not null and n > 0")
    sketches = classes.select("rep", "n", *SKETCH)
    bands = classes.select("rep", F.explode("bands").alias("band"))
    leaders = [F.min("rep").alias("leader0"), F.max("rep").alias("leader1")]
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), *leaders, mask("rep")).where("size > 1")
    members = written(dealt(bands, buckets, ["band"], "rep"))
    small = members.where(F.col("size") <= SMALL).select("band", "rep")
    close = small.alias("x").join(small.alias("y"), F.expr("x.band = y.band and x.rep < y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    # Of its large buckets a class meets a leader of the largest one, and another leader of any.
    chosen = members.where(F.col("size") > SMALL).groupBy("rep").agg(F.max(F.struct("size", F.col("leader0").alias("a"))).alias("l0"), F.max(F.struct(F.xxhash64("band", "rep").alias("h"), F.col("leader1").alias("a"))).alias("l1"))
    led = chosen.select(F.explode(F.array("l0.a", "l1.a")).alias("a"), F.col("rep").alias("b")).where("a <> b")
    met = written(close.unionByName(led).distinct())
    pairs = written(_with_both(met, sketches, ["n", *SKETCH]).where(_may_link(percent, "a_", "b_")).select("a", "b").distinct())
    links = _confirmed(pairs, classes, rows, k, percent)
    # Rows with one id and different texts are one document.
    several = part.groupBy("doc_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").select("doc_id")
    same = part.join(several, "doc_id").join(classes, "key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(links.unionByName(same))
    large = written(members.where(F.col("size") > SMALL).select("band", "rep"))
    forget(members, met, pairs, links)
    more = None if large.isEmpty() else _in_blocks(large, roots, classes, rows, k, percent)
    if more is not None and not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    of_class = classes.select("key", "rep", "__mask").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "__mask", F.coalesce("root", "rep").alias("of_class"))
    out = dealt(signed.select("doc_id", "n", "key"), of_class, ["key"], "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _in_blocks(large: DataFrame, roots: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame | None:
    """u, v: links that join the components left in each bucket; None if every bucket has one."""
    rooted = large.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    now = written(rooted.join(classes.select("rep", "n"), "rep"))
    of_root = now.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"), mask("rep"))
    of_root = of_root.withColumn("big", (F.col("c") >= BLOCK) | (F.col("s") >= BLOCK_SHINGLES)).withColumnRenamed("__mask", "rows")
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES, F.lit(1))).cast("int")
    rest = [F.coalesce(F.sum(F.when(~F.col("big"), F.col(c))), F.lit(0)).alias(f"rest_{c}") for c in ("c", "s")]
    of_band = of_root.groupBy("band").agg(F.count("*").alias("roots"), *rest, mask("root")).where("roots > 1")
    if of_band.isEmpty():
        forget(now)
        return None
    facts = dealt(of_root, of_band, ["band"], "root")
    n_parts = F.when(F.col("big"), parts(F.col("c"), F.col("s"))).otherwise(parts(F.col("rest_c"), F.col("rest_s")))
    facts = facts.select("band", "root", "big", n_parts.alias("parts"), F.col("rows").alias("__mask"))
    place = F.pmod(F.xxhash64(F.when(F.col("big"), F.col("rep")).otherwise(F.col("root")), F.lit(7)), F.col("parts")).cast("int")
    placed = dealt(now, facts, ["band", "root"], "rep").select("band", "rep", "root", "big", F.when(F.col("big"), F.col("root")).otherwise(0).alias("of"), place.alias("part"))
    placed = written(placed)
    block = ["band", "big", "of", "part"]
    whole, own = Window.partitionBy("band"), Window.partitionBy("band", "big", "of")  # over blocks, not rows
    number = F.row_number().over(whole.orderBy("big", "of", "part")) - 1
    blocks = placed.select(*block).distinct().select(*block, number.alias("no"), F.count("*").over(whole).alias("n_blocks"))
    blocks = written(blocks.select("*", F.min("no").over(own).alias("low"), F.max("no").over(own).alias("high")))
    placed, before = written(placed.join(blocks.select(*block, "no"), block).select("band", "no", "rep", "root")), placed
    others = F.filter(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1), lambda x: ~F.col("big") | (x < F.col("low")) | (x > F.col("high")))
    ends = F.transform(others, lambda x: F.struct(F.least("no", x).alias("i"), F.greatest("no", x).alias("j")))
    told = classes.select("rep", "n", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands"), *SKETCH)
    told = written(_among(told, placed))  # of all classes few are in such a bucket
    near = written(_met(placed, told, blocks.select("band", "no", ends.alias("ends")), _near(percent), "band long, i int, j int, u long, v long"), records=64)
    more = _confirmed(near.where("u is not null").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), classes, rows, k, percent)
    dense = near.where("u is null").select("band", "i", "j")
    if not dense.isEmpty():
        sides = dense.unionByName(dense.select("band", F.col("j").alias("i"), F.col("i").alias("j")))
        ends = F.collect_set(F.struct(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))
        sides = written(sides.groupBy("band", F.col("i").alias("no")).agg(ends.alias("ends")))
        some = placed.join(sides.select("band", "no"), ["band", "no"])
        sets = written(_sets(rows, some.select("rep"), k), records=2000)
        full = sets.join(classes.select("rep", "key"), ["rep", "key"]).drop("key").join(told, "rep")
        found = _met(some, full, sides, _exact(percent), "u long, v long")
        links = written(more.unionByName(found).distinct(), records=8)
        forget(more, sides, sets)
        more = links
    forget(now, before, blocks, placed, near, told)
    return more


def _met(placed: DataFrame, of: DataFrame, sides: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of the pairs of blocks in ``sides`` (band, no, ends: a list of i, j, one of which is no).

    A block is one row, the list of its rows (``placed``: band, no, rep, root) with what ``of`` (rep, ...) tells of
    them. It goes to each of its pairs, so that no join has a key with more than two rows.
    """
    rows = placed.join(of, "rep")
    packed = rows.groupBy("band", "no").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in ("band", "no")))).alias("rows"))
    sent = packed.join(sides, ["band", "no"]).select("band", "no", "rows", F.explode("ends").alias("p")).select("band", "no", "rows", "p.i", "p.j")
    left, right = (sent.where(f"no = {c}").select("band", "i", "j", F.col("rows").alias(name)) for c, name in (("i", "a"), ("j", "b")))
    return left.join(right, ["band", "i", "j"]).select("band", "i", "j", "a", "b").mapInArrow(run, schema)


def _pairs_of_blocks(batches):
    """band, i, j and the two blocks of each row of what ``_met`` joins."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield *(batch.column(c)[r].as_py() for c in ("band", "i", "j")), *(Block(batch.column(c)[r].values) for c in "ab")


def _near(percent: int):
    """For a pair of blocks: the pairs of rows that may be links, or one row without a pair where they are many."""

    def run(batches):
        for band, i, j, a, b in _pairs_of_blocks(batches):
            p, q = candidates(a, b, band, i == j, percent)
            if len(p) > FEW_PAIRS + (len(a.rep) + len(b.rep)) // 4:
                u = v = [None]
            else:
                u, v = a.rep[p], b.rep[q]
            n = len(u)
            yield pa.RecordBatch.from_arrays([pa.array([band] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["band", "i", "j", "u", "v"])

    return run


def _exact(percent: int):
    """For a pair of blocks: the links that join their components."""

    def run(batches):
        for band, i, j, a, b in _pairs_of_blocks(batches):
            yield _links(links_of_blocks(a, b, band, i == j, percent))

    return run


class Block:
    """The rows of a block as arrays."""

    def __init__(self, rows: pa.StructArray):
        of = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
        self.rep, self.root, self.n = (of[c].to_numpy(zero_copy_only=False) for c in ("rep", "root", "n"))
        self.sketch = np.stack([of[c].to_numpy(zero_copy_only=False) for c in SKETCH], 1).view(np.uint64)
        self.bands = of["bands"].flatten().to_numpy(zero_copy_only=False).reshape(len(self.rep), -1)
        if "h" in of:
            self.h, self.size = of["h"].flatten().to_numpy(zero_copy_only=False), of["h"].value_lengths().to_numpy(zero_copy_only=False)

    def shingles(self, some: np.ndarray) -> np.ndarray:
        """The shingle hashes of the rows ``some`` (sorted), one after the other."""
        return self.h[np.repeat(np.isin(np.arange(len(self.rep)), some), self.size)]


def overlaps(a: Block, b: Block, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of rows ``p`` of ``a`` with rows ``q`` of ``b``, by bitmaps of shared shingles."""
    (some_a, p), (some_b, q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    owner = np.repeat(np.arange(len(some_a) + len(some_b)), np.r_[a.size[some_a], b.size[some_b]])
    _, column, count = np.unique(np.r_[a.shingles(some_a), b.shingles(some_b)], return_inverse=True, return_counts=True)
    shared = count > 1
    column, keep = (np.cumsum(shared) - 1)[column], shared[column]
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, width = np.zeros(len(p), np.int64), 1 << 14
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        some = slice(*np.searchsorted(column, (low, low + width)))
        flags = np.zeros((len(some_a) + len(some_b), width), bool)
        flags[owner[some], column[some] - low] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        for at in range(0, len(p), 1 << 13):
            to = slice(at, at + (1 << 13))
            out[to] += np.bitwise_count(bits[p[to]] & bits[len(some_a) + q[to]]).sum(1, dtype=np.int64)
    return out


def candidates(a: Block, b: Block, band: int, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` of different components whose sizes and sketches allow a link. Pairs that share
    an earlier band are left to it. (Bands are told by 32 bits here.)"""
    ok = a.root[:, None] != b.root[None, :]
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    ok &= np.minimum(a.n[:, None], b.n[None, :]) * 100 >= np.maximum(a.n[:, None], b.n[None, :]) * percent
    for t in range(int((a.bands == band >> 32).any(0).argmax())):
        ok &= a.bands[:, t, None] != b.bands[None, :, t]
    ones = np.zeros(ok.shape, np.uint16)
    for w in range(SKETCH_WORDS):
        ones += np.bitwise_count(a.sketch[:, w, None] ^ b.sketch[None, :, w])
    ok &= ones <= most_ones(percent)
    return np.nonzero(ok)


def links_of_blocks(a: Block, b: Block, band: int, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links of rows of ``a`` with rows of ``b`` that lie in different components: enough of them to join whatever any
    such link joins."""
    p, q = candidates(a, b, band, same, percent)
    if not len(p):
        return []
    hit = overlaps(a, b, p, q) * (100 + percent) >= (a.n[p] + b.n[q]) * percent
    p, q = p[hit], q[hit]
    ends = np.stack([np.minimum(a.root[p], b.root[q]), np.maximum(a.root[p], b.root[q])], 1)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out = []
    for (x, y), at in zip(*(v.tolist() for v in np.unique(ends, axis=0, return_index=True)), strict=True) if len(p) else ():
        x, y = top(x), top(y)
        if x != y:
            up[y] = x
            out.append((int(a.rep[p[at]]), int(b.rep[q[at]])))
    return out
