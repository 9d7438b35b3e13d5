"""Bottom-k sketches of documents: the k smallest distinct hashes of a text's character shingles.

Shingles are windows of SHINGLE code points (a shorter text is one shingle), so that a text of a few words has several.
Sketches merge: the bottom k of two parts' sketches is the sketch of the whole's shingles. They estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches

K = 128
SHINGLE = 12
_BASE = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of all windows, by doubling: the hash of 2n characters is made of those of n and n."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not x.size:
        return np.empty(0, np.uint32)
    x, width = x + np.uint64(1), min(width, x.size)
    total, done, step, at = None, 0, 1, x
    while step <= width:
        if width & step:
            n = x.size - width + 1
            part = at[done : done + n]
            total = part.copy() if total is None else total * np.uint64(pow(_BASE, step, 2**64)) + part
            done += step
        if 2 * step <= width:
            at = at[:-step] * np.uint64(pow(_BASE, step, 2**64)) + at[step:]
        step *= 2
    total ^= total >> np.uint64(30)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(27)
    total *= np.uint64(0x94D049BB133111EB)
    return (total >> np.uint64(32)).astype(np.uint32)


def sketch(text: str, k: int = K, width: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct hashes of a text's shingles, ascending; empty for an empty text."""
    return bottom(shingle_hashes(text, width), k)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if hashes.size > 8 * k:
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if few.size > k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of what either sketch's text holds."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(a.size) if a.size < k else (k - 1) * 2.0**32 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two texts' shingle sets; 1 for two empty ones, exact for short texts."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    both = merge(a, b, k)
    return float(np.isin(both, a[np.isin(a, b)], assume_unique=True).sum() / both.size)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not a.size:
        return 1.0
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n)


def encoded(a: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes as little-endian 32-bit numbers."""
    return base64.b64encode(a.astype("<u4").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def edited(text: str, following: str | None) -> str:
    """The text with its last third of code points replaced by as many of the next text's first, or all of them."""
    n = len(text) // 3
    return text[: len(text) - n] + (following or "")[:n]


COMPARED = "resemblance double, contained_a double, contained_b double, distinct_a double, distinct_b double"


def _held(x: pa.Scalar) -> np.ndarray:
    return decoded(x.as_py() or "")


def compared(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """pairs with what the sketches in its columns a and b say: resemblance, the share of each one's shingles that the
    other has (contained_a, contained_b), and numbers of distinct shingles.

    A null sketch counts as that of an empty text; two empty ones are alike. Columns of these names are replaced, others
    kept; rows may repeat; an empty table gives an empty result. Nothing is shuffled.
    """
    names = [x.split()[0] for x in COMPARED.split(", ")]
    kept = pairs.drop(*[n for n in names if n not in (a, b)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in names), COMPARED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(a), batch.column(b)):
                s, t = _held(x), _held(y)
                rows.append((resemblance(s, t, k), containment(s, t, k), containment(t, s, k), distinct(s, k), distinct(t, k)))
            old = [i for i, n in enumerate(batch.schema.names) if n not in names]
            new = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in old), *new], [*(batch.schema.names[i] for i in old), *names])

    return kept.mapInArrow(run, schema)


#: Groups that a task holds before it passes them on, and parts in which a group's sketches are merged first.
HELD, PARTS = 4096, 256


def merged(rows: DataFrame, by: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint, n, distinct_shingles): the sketch of what the rows of each group hold together, how many rows there
    are, and the estimated number of their distinct shingles.

    Tasks merge what they scan, then PARTS parts of each group are merged, then those: no task ever has a group's rows,
    whatever their share. A null sketch counts as that of an empty text; null keys are a group; rows may repeat; an empty
    table gives an empty result; other columns, whatever their names, are not read.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    narrow = rows.select(*[F.col(c).alias(n) for c, n in zip(by, keys)], F.col(column).cast("string").alias("_s"))
    kinds = ", ".join(f"{n} {t}" for n, t in narrow.dtypes if n != "_s")
    schema = f"{kinds}, _part int, _s binary, _n long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        held: dict[tuple, tuple[np.ndarray, int]] = {}

        def flush() -> pa.RecordBatch:
            groups = [pa.array([g[i] for g in held], target.field(i).type) for i in range(len(keys))]
            out = [*groups, pa.array([part] * len(held), pa.int32()), pa.array([s.astype("<u4").tobytes() for s, _ in held.values()], pa.binary()), pa.array([n for _, n in held.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, [*keys, "_part", "_s", "_n"])

        target = None
        for batch in batches:
            target = batch.schema
            for *group, s in zip(*(batch.column(i).to_pylist() for i in range(len(keys))), batch.column(len(keys))):
                old, n = held.get(tuple(group), (np.empty(0, np.uint32), 0))
                held[tuple(group)] = merge(old, _held(s), k), n + 1
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    def fold(table: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["_s"]]))[:k]
        return table.slice(0, 1).set_column(table.schema.get_field_index("_s"), "_s", pa.array([found.astype("<u4").tobytes()], pa.binary())).set_column(table.schema.get_field_index("_n"), "_n", pa.array([sum(table["_n"].to_pylist())], pa.int64()))

    parts = narrow.mapInArrow(scan, schema).groupBy(*keys, "_part").applyInArrow(fold, schema)
    whole = parts.groupBy(*keys).applyInArrow(fold, schema)
    size = F.length("_s") / 4
    estimate = F.when(size < k, size).otherwise((k - 1) * 2.0**32 / (_largest(F.col("_s")) + 1))
    return whole.select(*[F.col(n).alias(c) for n, c in zip(keys, by)], F.translate(F.base64("_s"), "\r\n", "").alias("fingerprint"), F.col("_n").alias("n"), estimate.cast("double").alias("distinct_shingles"))


def _largest(hashes: Column) -> Column:
    """The last of little-endian 32-bit numbers."""
    byte = lambda i: F.conv(F.hex(F.substring(hashes, F.length(hashes) - 3 + i, F.lit(1))), 16, 10).cast("double")
    return sum((byte(i) * 256.0**i for i in range(1, 4)), byte(0))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness to it and to the next row's.

    The next row is that of the next smaller doc_id; the last's is the first. Rows that repeat a doc_id follow one
    another by text, null first. Rows without doc_id have no next one: their last third is replaced by nothing and
    near_next is 0. Null texts count as empty; two empty texts are alike. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    Texts move once: ranges of doc_id are dealt to tasks, each with a copy of the row that follows its last; the range
    borders, and a row a range, are all that the driver sees.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = texts.select("doc_id").where("doc_id is not null")
    found = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    borders = np.array(sorted({int(x) for x in found}), np.int64)
    count = borders.size + 1

    @F.arrow_udf("int")
    def part_of(x: pa.Array) -> pa.Array:
        return pa.array(borders.size - np.searchsorted(borders, x.to_numpy(zero_copy_only=False)), pa.int32())

    heads = dict(ids.withColumn("part", part_of("doc_id")).groupBy("part").agg(F.max("doc_id")).collect())
    order = sorted(heads)
    halo = {heads[order[(i + 1) % len(order)]]: p for i, p in enumerate(order)}
    wanted = sorted(halo)

    @F.arrow_udf("int")
    def halo_of(x: pa.Array) -> pa.Array:
        return pa.array([halo.get(y) for y in x.to_pylist()] if wanted else [None] * len(x), pa.int32())

    known = texts.where("doc_id is not null")
    placed = known.select("doc_id", "text", part_of("doc_id").alias("part"), halo_of("doc_id").alias("extra"))
    placed = placed.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("part", F.lit(0).alias("halo")), F.when(F.col("extra").isNotNull(), F.struct(F.col("extra").alias("part"), F.lit(1).alias("halo")))))).alias("to"))
    lone = texts.where("doc_id is null").select("doc_id", "text", F.struct(F.pmod(F.xxhash64("text"), F.lit(count)).cast("int").alias("part"), F.lit(2).alias("halo")).alias("to"))
    rows = placed.unionByName(lone).select("to.part", "to.halo", "doc_id", "text")
    rows = rows.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # part, doc_id, text, sketch

        def emit(doc_id: int | None, text: str, own: np.ndarray, following: str | None, other: np.ndarray | None) -> None:
            new = edited(text, following)
            changed = own if new == text else sketch(new, k, width)
            out.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(own), encoded(changed), resemblance(own, changed, k), 0.0 if other is None else resemblance(own, other, k)))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in OUT.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for part, kind, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py() or ""
                if kind == 2:
                    emit(doc_id, text, sketch(text, k, width), None, None)
                elif kind == 0 or held is not None:
                    own = sketch(text, k, width)
                    if held is not None:
                        emit(held[1], held[2], held[3], text, own)
                    held = (part, doc_id, text, own) if kind == 0 else None
                if len(out) >= 512:
                    yield flush()
        if held is not None:
            raise RuntimeError("a range of ids has no row that follows its last")
        if out:
            yield flush()

    return rows.mapInArrow(run, OUT)
