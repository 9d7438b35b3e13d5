"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are lower-cased; letters stay, every other run becomes one space. The models' n-grams lie in sorted arrays of
64-bit keys (four 16-bit symbols), one array an order and language; for few languages, one an order for all of them, with
a column of log-probabilities for each.
A document goes to the language of the lowest cross-entropy a character. It is rejected where even that lies above what
held-back training rows of the language and of like length reached, by a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, staged

ORDER = 4
#: Code points above 16 bits share 4,096 symbols of the private-use area.
_LETTER: np.ndarray | None = None
UNKNOWN = "und"
#: Characters of a text that are scored at once.
PIECE = 1 << 18
#: Languages whose counts of rows the driver takes; more are an error, as labels are then hardly languages.
MOST_LANGS = 1000
#: Bytes of the table that has every language's log-probability of every n-gram. Where it would be larger, languages are
#: looked up one by one in their own arrays, which is slower and gives the same.
MOST_DENSE = 256 << 20


def symbols(text: str) -> np.ndarray:
    """A text's letters in lower case with single spaces between, ORDER - 1 spaces before and one after; empty without
    letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[x]
    if not letter.any():
        return np.empty(0, np.uint64)
    x = np.where(x > 0xFFFF, 0xE000 + x % 0x1000, x)
    x = np.where(letter, x, 0x20)
    keep = letter | np.r_[False, letter[:-1]]
    x = x[keep]
    x = x[1:] if x[0] == 0x20 else x
    tail = [] if x[-1] == 0x20 else [0x20]
    return np.r_[[0x20] * (ORDER - 1), x, tail].astype(np.uint64)


def keys(x: np.ndarray) -> np.ndarray:
    """The ORDER-grams of symbols as 64-bit keys, the last symbol lowest."""
    return x[:-3] << np.uint64(48) | x[1:-2] << np.uint64(32) | x[2:-1] << np.uint64(16) | x[3:]


def lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array and whether the wanted are there."""
    if not table.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(table, wanted), table.size - 1)
    return at, table[at] == wanted


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language from its ORDER-gram counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, letters: int) -> None:
        self.base = 1.0 / max(2, letters)
        self.levels = []
        for n in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            context, where, types = np.unique(grams >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(where, counts)
            self.levels.append((grams, (counts - discount) / total[where], context, discount * types / total))
            if n > 1:
                lower = grams & np.uint64((1 << 16 * (n - 1)) - 1)
                grams, counts = np.unique(lower, return_counts=True)
                counts = counts.astype(float)

    def probability(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(wanted.size, self.base)
        grams, share, context, rest = self.levels[ORDER - n]
        out = np.zeros(wanted.size)
        at, there = lookup(grams, wanted)
        out[there] = share[at[there]]
        at, there = lookup(context, wanted >> np.uint64(16))
        weight = np.ones(wanted.size)
        weight[there] = rest[at[there]]
        return out + weight * self.probability(wanted & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[ORDER - n][2:]


@dataclass
class Model:
    """Sorted keys and, by language, log-probabilities; contexts and, by language, log-weights of the lower order."""

    langs: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    scale: float = 1.0
    limits: np.ndarray | None = None
    own: list[KneserNey] | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], most_dense: int = MOST_DENSE) -> Model:
        langs = sorted(counts)
        letters = len(np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in counts.values()]))) + 1 if langs else 2
        own = {k: KneserNey(*counts[k], letters) for k in langs}
        grams, logs, contexts, weights = [], [], [], []
        floor = np.full(len(langs), np.log(1.0 / max(2, letters)), np.float32)
        if sum(x.size + y.size for o in own.values() for x, _, y, _ in o.levels) * 4 * len(langs) > most_dense:
            return cls(langs, grams, logs, contexts, weights, floor, own=[own[k] for k in langs])
        for n in range(ORDER, 0, -1):
            union = np.unique(np.concatenate([own[k].levels[ORDER - n][0] for k in langs])) if langs else np.empty(0, np.uint64)
            above = np.unique(np.concatenate([own[k].contexts(n)[0] for k in langs])) if langs else np.empty(0, np.uint64)
            grams.append(union)
            logs.append(np.stack([np.log(own[k].probability(union, n)) for k in langs], 1).astype(np.float32) if langs else np.empty((0, 0), np.float32))
            table = np.zeros((above.size, len(langs)), np.float32)
            for i, k in enumerate(langs):
                context, rest = own[k].contexts(n)
                table[np.searchsorted(above, context), i] = np.log(rest)
            contexts.append(above)
            weights.append(table)
        return cls(langs, grams, logs, contexts, weights, floor)

    def log_probabilities(self, wanted: np.ndarray, n: int = ORDER) -> np.ndarray:
        """A row a key, a column a language; keys in no language's array go down an order by their contexts' weights."""
        if self.own is not None:
            return np.stack([np.log(o.probability(wanted, n)) for o in self.own], 1).astype(np.float32)
        if n == 0:
            return np.broadcast_to(self.floor, (wanted.size, len(self.langs)))
        i = ORDER - n
        at, there = lookup(self.grams[i], wanted)
        if there.all():
            return self.logs[i][at]
        out = np.empty((wanted.size, len(self.langs)), np.float32)
        out[there] = self.logs[i][at[there]]
        lost = wanted[~there]
        lower = self.log_probabilities(lost & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        at, there_too = lookup(self.contexts[i], lost >> np.uint64(16))
        out[~there] = lower + np.where(there_too[:, None], self.weights[i][at] if self.weights[i].size else 0, 0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters and spaces scored of every text, and its cross-entropy (nats a character) in every language."""
        sizes, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        held: list[np.ndarray] = []
        owners: list[int] = []
        waiting = 0

        def score() -> None:
            starts = np.cumsum([0, *(k.size for k in held)])[:-1]
            parts = np.add.reduceat(self.log_probabilities(np.concatenate(held)).astype(np.float64), starts, axis=0)
            np.add.at(sums, owners, parts)
            held.clear(), owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            x = symbols(text)
            if not x.size:
                continue
            k = keys(x)
            sizes[i] = k.size
            for at in range(0, k.size, PIECE):
                held.append(k[at : at + PIECE])
                owners.append(i)
                waiting += held[-1].size
                if waiting >= PIECE:
                    score()
                    waiting = 0
        if held:
            score()
        return sizes, -sums / np.maximum(sizes, 1)[:, None]

    def confidence(self, sizes: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        """The best language's share of the likelihoods, tempered by the fitted scale."""
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * (np.sqrt(np.maximum(sizes, 1)) * self.scale)[:, None]
        return 1.0 / np.exp(z).sum(axis=1)

    def bins(self, sizes: np.ndarray) -> np.ndarray:
        return np.minimum(np.log2(np.maximum(sizes, 8)).astype(int) - 3, 7)

    def calibrate(self, langs: list[str], sizes: np.ndarray, entropy: np.ndarray, margin: float) -> None:
        """The scale by least log-loss, and by language and length the largest cross-entropy that is accepted: the
        largest that the rows of that length or longer reached, and the margin; of too few rows the language's all, of
        none all languages'."""
        truth = np.array([self.langs.index(k) for k in langs], int)
        some = sizes > 0
        best = np.inf
        for scale in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            z = -(entropy - entropy.min(axis=1, keepdims=True)) * (np.sqrt(np.maximum(sizes, 1)) * scale)[:, None]
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(truth.size), truth])[some].mean() if some.any() else 0.0
            if loss < best:
                best, self.scale = loss, scale
        own_entropy = entropy[np.arange(truth.size), truth]
        everyone = own_entropy[some].max() + margin if some.any() else np.inf
        self.limits = np.full((len(self.langs), 8), everyone)
        for i in range(len(self.langs)):
            own = some & (truth == i)
            if not own.any():
                continue
            for b in range(8):
                rows = own & (self.bins(sizes) >= b)
                self.limits[i, b] = own_entropy[rows if rows.sum() >= 30 else own].max() + margin


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, rows_per_lang: int = 1500, margin: float = 1.0, chars_per_lang: int = 20_000_000) -> Model:
    """Fits a model to at most rows_per_lang rows of each language (lang not null, remainder not 0), those of the
    smallest hash of doc_id for as long as they have chars_per_lang characters together, whole texts all; a quarter of
    them only calibrates. The counts come from tasks; the driver gets the sample's distinct n-grams, of which there are
    at most as many as the sample has letters."""
    bound_batches(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not sizes:
        return Model.fit({})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], rows_per_lang / r["n"])])
    few = labelled.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang")))
    few = staged(few.select("doc_id", "lang", "text", "place"), "langid-sample")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text")))
    upto = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("rank"))
    ranked = ranked.withColumn("upto", upto).where((F.col("rank") <= rows_per_lang) & ((F.col("upto") <= chars_per_lang) | (F.col("rank") == 1)))
    few = ranked.select("lang", "text", (F.col("rank") % 4 == 0).alias("held"))
    few = few.repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = symbols(text.as_py())
                if x.size:
                    found.setdefault(lang, []).append(keys(x))
        for lang, parts in found.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * grams.size), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = few.where("not held").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    fitted = {}
    for lang, rows in table.groupby("lang"):
        grams, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
        order = np.argsort(grams)
        fitted[lang] = grams[order], n[order]
    model = Model.fit(fitted)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h = shared.value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(list(h), pa.list_(pa.float64()))], ["lang", "n", "h"])

    held = [r for r in few.where("held").select("lang", "text").mapInArrow(score, "lang string, n long, h array<double>").toArrow().to_pylist() if r["lang"] in model.langs]
    if held:
        model.calibrate([r["lang"] for r in held], np.array([r["n"] for r in held]), np.array([r["h"] for r in held]), margin)
    shared.unpersist()
    return model


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def judged(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of every text; ties go to the first language. Texts without letters, and all
    texts where nothing was learned, are UNKNOWN with score 0 and rejected."""
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    sizes, entropy = model.entropies(texts)
    first = entropy.argmin(axis=1)
    none = sizes == 0
    score = np.where(none, 0.0, model.confidence(sizes, entropy))
    over = none if model.limits is None else none | (entropy[np.arange(first.size), first] > model.limits[first, model.bins(sizes)])
    return [UNKNOWN if n else model.langs[i] for n, i in zip(none, first)], score, over


def identify(docs: DataFrame, rows_per_lang: int = 1500, margin: float = 1.0) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred, score (0 to 1) and rejected, from its whole text alone.

    Null, empty and letterless texts are `und`, score 0, rejected. Ids may be null (held out) or repeated; null langs
    teach nothing; an empty table gives an empty result; other columns, whatever their names, are not read. The model,
    bounded by train()'s sample and MOST_DENSE, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_lang, margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, score, over = judged(shared.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(over)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), (remainder(doc_id) == 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def accepted(docs: DataFrame, rows_per_lang: int = 1500, margin: float = 1.0) -> DataFrame:
    """The rows of docs whose text isn't rejected, all columns as they are, whatever their names. Null, empty and
    letterless texts go; where nothing was learned, only those. Ids may be null or repeated; an empty table gives an empty
    result."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows_per_lang, margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at).to_pylist()
                over = judged(shared.value, texts)[2] if shared.value.langs else np.array([not t or symbols(t).size == 0 for t in texts], bool)
                yield part.filter(pa.array(~over))

    return docs.mapInArrow(run, docs.schema)
