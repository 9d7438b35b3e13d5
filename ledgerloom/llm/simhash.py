"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius r is covered by 2^(r+1)-1 bit masks: every bit position gets a non-zero vector of r+1 bits, and the mask of a
non-zero vector v holds the positions whose vector has odd parity with v. Any r differing positions leave some v
orthogonal to all of theirs, so two fingerprints within r agree under that mask (Pagh, 2016). Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, components, staged

BITS = 64
SEED = 42
#: Shingles that are hashed at once.
CHUNK = 1 << 14
#: Tasks that a component's members are dealt to when they get what their root has.
SPREAD = 32
#: Texts of a large component that all others of it are compared with first.
PIVOTS = 8
#: Texts a side that one task compares exactly.
COMPARED = 1024
#: Times that links within the buckets are merged.
MERGES = 3
#: Members of a bucket that one task holds; larger buckets are covered again on the bits that their mask leaves free.
BUCKET = 1 << 16


def majority(parts: Iterator[bytes], n: int) -> int:
    """The bits that are set in more than half of the n parts' hashes."""
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    while hashes := [digest(x, SEED) for x in islice(parts, CHUNK)]:
        part = np.array(hashes, "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None, width: int = 4) -> int:
    """The fingerprint of a text's word shingles, repeats included; 0 for a null text or one without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    del words  # of a long text they take ten times its size
    starts, last = np.r_[0, ends[:-1] + 1], ends[width - 1 :]
    pieces = (joined[a:b] for i in range(0, last.size, CHUNK) for a, b in zip(starts[i : i + CHUNK].tolist(), last[i : i + CHUNK].tolist()))
    return majority(pieces, last.size)


def word_simhashes(text: str | None, least: int, count: int = 1) -> list[int] | None:
    """`count` fingerprints of a text's distinct words, by different hashes; null if there are fewer than `least` words.
    A hash of 128 bits gives two."""
    words = list(set(words_of(text)))
    if len(words) < least:
        return None
    found: list[int] = []
    for seed in range(SEED, SEED + (count + 1) // 2):
        counts = np.zeros(2 * BITS, np.int64)
        for at in range(0, len(words), CHUNK):
            part = b"".join([xxhash.xxh3_128_digest(w, seed) for w in words[at : at + CHUNK]])
            counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found += np.packbits(2 * counts > len(words), bitorder="little").view("<u8").tolist()
    return found[:count]


def covering(radius: int, positions: list[int]) -> list[int]:
    """Masks of a covering for differences of at most radius among the positions; each mask fixes half of them or so."""
    vectors = {p: 1 + i % (2 ** (radius + 1) - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p, x in vectors.items() if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, width: int = 4, least_words: int | None = None, word_hashes: int = 1) -> DataFrame:
    """(doc_id, fp, words_fp, text_hash): the fingerprints' 64 bits as signed longs; words_fp, one for each hash, is null
    without least_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, words = [], []
            for x in batch.column(1):
                text = x.as_py()
                fps.append(signed(simhash(text, width)))
                other = None if least_words is None else word_simhashes(text, least_words, word_hashes)
                words.append(None if other is None else [signed(x) for x in other])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(words, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "fp", "words_fp", "text_hash"])

    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, words_fp array<long>, text_hash long")


def forest(x: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join whatever is within the radius among the distinct fingerprints x: a spanning forest, no more."""
    while x.size > 1:
        todo, x = [x[0]], x[1:]
        while todo and x.size:
            node = todo.pop()
            near = np.bitwise_count(x ^ node) <= radius
            if near.any():
                found, x = x[near], x[~near]
                todo.extend(found)
                yield from ((int(node), int(y)) for y in found)


LINKS = "a long, b long, over int"


def starred(rows: DataFrame) -> DataFrame:
    """From (a, bs array): links (a, b) that join what links of a to all its bs do: a's to the smallest, and the others' to
    it, which are the same for many a."""
    each = rows.select("a", F.array_min("bs").alias("least"), F.explode("bs").alias("b"))
    return each.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).where("a <> b")


def merged(links: DataFrame, times: int = 1) -> DataFrame:
    """Distinct links (a, b) with the components of those given, and fewer of them. An a's links are gathered by a, so they
    must be few; a b may have any number."""
    for _ in range(times):
        links = starred(links.groupBy("a").agg(F.collect_set("b").alias("bs")))
    return links.distinct()


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """From rows (tbl int, key long, fp long) sorted by tbl and key: links (a, b, over null) within the buckets, b being the
    smallest of what the bucket joins a to.

    The members of a bucket of more than `most` come out as (fp, null, tbl) instead, as they are read.
    """
    out: list[tuple[int, int | None, int | None]] = []

    def flush() -> pa.RecordBatch:
        cols = [list(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([signed(x & (2**64 - 1)) for x in cols[0]], pa.int64()), pa.array([None if x is None else signed(x & (2**64 - 1)) for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int32())], ["a", "b", "over"])

    held, held_key, spilling = [], None, False

    def close() -> None:
        if held and not spilling:
            x = np.sort(np.concatenate(held).view(np.int64)).view(np.uint64)
            least: dict[int, int] = {}
            for a, b in forest(x, radius):  # a tree comes after the other, from its smallest on
                least[b] = least.get(a, a)
            out.extend((a, b, None) for a, b in least.items())

    for batch in batches:
        if not batch.num_rows:
            continue
        tbl, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fp = batch.column(2).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((tbl[1:] != tbl[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, tbl.size]
        lone = ends - starts == 1
        for i in np.flatnonzero(~lone | (np.arange(lone.size) == 0) | (np.arange(lone.size) == lone.size - 1)):
            now = (tbl[starts[i]], key[starts[i]])
            if now != held_key:
                close()
                held, held_key, spilling = [], now, False
            held.append(fp[starts[i] : ends[i]])
            if spilling or most is not None and sum(h.size for h in held) > most:
                spilling = True
                out.extend((int(x), None, int(now[0])) for h in held for x in h)
                held = []
            if len(out) > 50_000:
                yield flush()
    close()
    if out:
        yield flush()


def near_links(distinct: DataFrame, radius: int = 4, most: int = BUCKET) -> DataFrame:
    """Links (a, b) between fingerprints of the one-column frame distinct (fp) whose components are those of all pairs
    within the radius. A bucket of over `most` fingerprints is covered again on its free bits, at most 16 of 32 of
    which stay free (radius 4), so no second bucket has more than 65,536 members (2^17 for radius 5).

    A fingerprint has a link for every mask, to the smallest that its bucket joins it to. merged() leaves about one link a
    fingerprint of these, whatever the size of its group. It gathers a link a mask at first, then for the smallest of a
    bucket one for each other smallest that the bucket's members know, at most."""
    masks = covering(radius, list(range(BITS)))
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("tbl", "key"))

    def linked(rows: DataFrame, most: int | None) -> DataFrame:
        dealt = rows.select("tbl", "key", "fp").repartition("tbl", "key").sortWithinPartitions("tbl", "key")
        return dealt.mapInArrow(lambda batches: bucket_links(batches, radius, most), LINKS)

    first = staged(linked(rows, most), "simhash-links")
    links = first.where("over is null").select("a", "b")
    if not first.where("over is not null").isEmpty():
        again = []
        for m in masks:
            free = covering(radius, [p for p in range(BITS) if not m >> p & 1])
            again.append(F.array(*[F.lit(signed(m | x)) for x in free]))
        many = F.lit(2 ** (radius + 1) - 1)
        over = first.where("over is not null").select(F.col("a").alias("fp"), "over", F.posexplode(F.element_at(F.array(*again), F.col("over") + 1)).alias("sub", "mask"))
        second = over.select((F.col("over") * many + F.col("sub")).cast("int").alias("tbl"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        links = links.unionByName(linked(second, None).select("a", "b"))
    return merged(links, MERGES)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a text of fewer words is one shingle."""
    words = words_of(text)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `least`."""
    if min(a.size, b.size) < least * max(a.size, b.size):
        return False
    common = a.size + b.size - np.union1d(a, b).size
    return common >= least * (a.size + b.size - common)


def similar_links(words: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, radius: int, least: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) of links whose components are those of all similar pairs of which some fingerprint (a column of words)
    is within the radius. Pairs that are joined already aren't compared; if both sides 0 and 1 occur, only pairs across
    them are."""
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    two = bool(sides.min() != sides.max())
    for i in range(len(sets) - 1):
        near = (np.bitwise_count(words[i + 1 :] ^ words[i]) <= radius).any(axis=1)
        if two:
            near &= sides[i + 1 :] != sides[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b and similar(sets[i], sets[j], least):
                up[b] = a
                yield i, j


def spread_join(members: DataFrame, by_root: DataFrame, key: str) -> DataFrame:
    """members (root, key, ...) with what by_root has for their root, a row a root. A large component's members share a
    root: they are dealt to SPREAD tasks by their key, and each of those gets the root's row. Sorted and merged, as copies
    of the rows would be broadcast by the size of one."""
    rows = by_root.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = members.withColumn("_spread", F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int"))
    return dealt.join(rows.hint("merge"), ["root", "_spread"]).drop("_spread")


def word_links(texts: DataFrame, hashes: int, radius: int, most: int) -> DataFrame:
    """Links (a, b) between text_hash of texts (words_fp, text_hash) whose components hold all pairs of which one of the
    words' fingerprints is within the radius. Texts of one fingerprint link to the first of them. A text has a link or so
    for each hash; merged() leaves about one."""
    out = None
    for i in range(hashes):
        own = texts.select(F.element_at("words_fp", i + 1).alias("w"), "text_hash")
        heads = staged(own.groupBy("w").agg(F.min("text_hash").alias("head")), "simhash-words")
        near = near_links(heads.select(F.col("w").alias("fp")), radius, most)
        head = lambda c, name: heads.select(F.col("w").alias(c), F.col("head").alias(name))  # noqa: B023, E731
        near = near.join(head("a", "x"), "a").join(head("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        same = own.join(heads, "w").where("text_hash <> head").select(F.col("text_hash").alias("a"), F.col("head").alias("b"))
        part = near.unionByName(same)
        out = part if out is None else out.unionByName(part)
    return merged(out)


def verified_links(docs: DataFrame, texts: DataFrame, near: DataFrame, radius: int, least: float, width: int) -> DataFrame:
    """Links (a, b) between fp of texts (words_fp, fp, text_hash) of which one of the words' fingerprints is within the
    radius and whose word shingles' exact Jaccard similarity is at least `least`; near: word_links().

    A component's distinct texts are compared in blocks of about COMPARED on a side. Those of a larger component first
    meet PIVOTS of them: whatever links to one pivot is joined by that, so that of the largest such cluster only pairs with
    the texts outside it are left to compare. Texts are reduced to their shingles' hashes where they are scanned.
    """
    places = staged(texts.join(components(near), F.col("text_hash") == F.col("node")).select("words_fp", "fp", "text_hash", "root"), "simhash-places")
    sizes = places.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / COMPARED).cast("int").alias("parts"))
    places = staged(spread_join(places, sizes, "text_hash"), "simhash-places")
    hashed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    wanted = staged(places.select("text_hash").distinct(), "simhash-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), width).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    sets = hashed.join(wanted, "text_hash", "left_semi").mapInArrow(cut, "text_hash long, shingles array<long>")
    sets = staged(sets, "simhash-sets").dropDuplicates(["text_hash"])
    held = staged(places.join(sets, "text_hash"), "simhash-held")
    hits, most = pivot_hits(held.where("parts > 1"), radius, least)
    stars = starred(hits.select(F.col("fp").alias("a"), F.col("hits.fp").alias("bs")))
    # parts of what is outside the largest cluster come first, then the cluster's, whose texts meet only the former
    outside, inside = F.ceil(F.col("outside") / COMPARED).cast("int"), F.ceil(F.col("inside") / COMPARED).cast("int")
    dealing = spread_join(hits.drop("fp"), most.where("outside > 0").select("root", "pivot", outside.alias("first"), inside.alias("second")), "text_hash")
    at_home = F.exists("hits", lambda h: h["pivot"] == F.col("pivot"))
    place = F.xxhash64("text_hash")
    dealing = dealing.select("text_hash", F.when(at_home, F.col("first") + F.pmod(place, F.col("second"))).otherwise(F.pmod(place, F.col("first"))).cast("int").alias("part"), F.when(at_home, F.col("first")).otherwise(F.col("first") + F.col("second")).alias("meets"))
    large = held.join(dealing, "text_hash").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    small = held.where("parts = 1").withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    columns = ["root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"), "words_fp", "fp", "shingles"]
    dealt = small.select(*columns).unionByName(large.select(*columns))

    def compare(t: pa.Table) -> pa.Table:
        fp, words = t["fp"].to_numpy(), t["words_fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        held = t["shingles"].combine_chunks()
        cuts, flat = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
        found = list(similar_links(words, [flat[a:b] for a, b in zip(cuts, cuts[1:])], t["side"].to_numpy(), radius, least))
        return pa.table({"a": pa.array([int(fp[i]) for i, _ in found], pa.int64()), "b": pa.array([int(fp[j]) for _, j in found], pa.int64())})

    return dealt.groupBy("root", "low", "high").applyInArrow(compare, "a long, b long").where("a <> b").unionByName(stars).distinct()


def pivot_hits(held: DataFrame, radius: int, least: float) -> tuple[DataFrame, DataFrame]:
    """From texts of large components, held (root, text_hash, words_fp, fp, shingles): (root, text_hash, fp, hits), the hits
    being (pivot, fp) of the component's pivots that a text links to; and (root, pivot, inside, outside), the pivot with the
    most hits and how many texts it has and hasn't. Pivots are the smallest hashes of PIVOTS classes of them."""
    few = held.groupBy("root", F.pmod("text_hash", F.lit(PIVOTS)).alias("c")).agg(F.min("text_hash").alias("text_hash")).select("root", "text_hash")
    names = ["root", "text_hash", "fp", "words_fp", "shingles"]
    few = held.join(few, ["root", "text_hash"]).select(F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.lit(0).alias("kind"), *names)
    rows = few.unionByName(held.select(F.pmod(F.xxhash64("text_hash"), F.lit(SPREAD)).cast("int").alias("part"), F.lit(1).alias("kind"), *names))
    # a task reads a part's pivots and then its texts
    rows = rows.repartition("root", "part").sortWithinPartitions("root", "part", "kind", "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for batch in batches:
            out, keep = [], np.flatnonzero(batch.column(1).to_numpy() == 1)
            for part, kind, root, name, fp, words, own in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), batch.column(6)):
                words, own = words.values.to_numpy().view(np.uint64), own.values.to_numpy().view(np.uint64)
                if (root, part) != key:
                    key, pivots = (root, part), []
                if kind == 0:
                    pivots.append((name, fp, words, own))
                    continue
                near = [(n, f, x) for n, f, w, x in pivots if (np.bitwise_count(words ^ w) <= radius).any()]
                out.append([{"pivot": n, "fp": f} for n, f, x in near if similar(own, x, least)])
            hits = pa.array(out, pa.list_(pa.struct([("pivot", pa.int64()), ("fp", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in (2, 3, 4)), hits], ["root", "text_hash", "fp", "hits"])

    hits = rows.mapInArrow(run, "root long, text_hash long, fp long, hits array<struct<pivot: long, fp: long>>")
    hits = staged(hits, "simhash-hits")
    by_pivot = hits.select("root", F.explode("hits").alias("h")).groupBy("root", F.col("h.pivot").alias("pivot")).agg(F.count("*").alias("inside"))
    best = by_pivot.groupBy("root").agg(F.max(F.struct("inside", "pivot")).alias("best"))
    most = hits.groupBy("root").agg(F.count("*").alias("n")).join(best, "root")
    return hits, staged(most.select("root", "best.pivot", "best.inside", (F.col("n") - F.col("best.inside")).alias("outside")), "simhash-most")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, most: int = BUCKET, words_radius: int | None = None, least_words: int = 16, word_hashes: int = 1, least_similar: float | None = None, similar_width: int = 5) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    With words_radius, documents of at least least_words distinct words also link if one of word_hashes fingerprints of
    their distinct words differs in at most that many bits. A changed word spoils `width` shingles but one word, so this
    finds copies with more changes; with several hashes chance misses fewer. With least_similar only those pairs link
    whose shingles of similar_width words have that Jaccard similarity or more; every pair within the bits is looked at,
    unless others join it already.

    Null, empty and blank texts have fingerprint zero and link like others. Rows without doc_id keep a row, and count
    for a component_id only if no member has one (then it is null). Repeated rows each keep theirs; an empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    fps = staged(fingerprints(docs, width, None if words_radius is None else least_words, word_hashes), "simhash")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    links = near_links(classes.select("fp"), radius, most)
    if words_radius is not None:
        texts = staged(fps.where("words_fp is not null").select("words_fp", "fp", "text_hash").distinct(), "simhash-texts")
        near = word_links(texts, word_hashes, words_radius, most)
        if least_similar is not None:
            more = verified_links(docs, texts, near, words_radius, least_similar, similar_width)
        else:
            fp_of = lambda c, name: texts.select(F.col("text_hash").alias(c), F.col("fp").alias(name))
            more = near.join(fp_of("a", "x"), "a").join(fp_of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b")
        links = links.unionByName(more)
    roots = components(links).withColumnRenamed("node", "fp")
    linked = staged(classes.join(roots, "fp"), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    members = spread_join(linked, least, "fp").select("fp", "component_id")
    alone = classes.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    by_fp = members.unionByName(alone)
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
