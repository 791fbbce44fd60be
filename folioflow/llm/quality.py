"""Quality rules: word statistics, and the perplexity of each text under a language's own n-gram model.

The model has modified Kneser-Ney discounts and n-grams of characters, the space between words being one (so that invented, rare
and long words have a probability too, and the order of words counts). Each n-gram of a text lies in a unit: a word with the
spaces around it, or two characters on both sides of a space. Spark counts units over all documents, then n-grams over distinct
units; probabilities are joined in Spark as well, and all n-grams stay in a table. Workers hold the most frequent ones, KEPT at
most, as sorted arrays of hashes; units with any other n-gram are priced by a join with the table, so that prices do not depend
on what workers hold. A text's verdict compares its mean surprise a word with a band of its language, found from all texts: too high and
too low are both rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, in_arrow, map_batches, saved, small

ORDER = 4
START, END = "\x02", "\x03"
#: The most n-grams that workers hold; the others are joined.
KEPT = 1 << 21
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\v\f\r"
#: Of each byte: 1 for a symbol, 2 for a line feed.
KINDS = np.array([1 if chr(b) in SYMBOLS else 2 if b == 10 else 0 for b in range(256)], np.uint8)
UNKNOWN = "und"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Half the width of a band, in robust standard deviations; the lower band is as wide.
WIDTH = 5.0
#: The least deviation between texts, and of a word within one: near copies of one text must not make a band of no width.
LEAST_BETWEEN, LEAST_WITHIN = 0.05, 1.0
#: A unit less likely than e ** -UNKNOWN_WORD counts as an unknown one, at that price: a key or an address does not outweigh a text.
UNKNOWN_WORD = 18.0
REMEMBERED_UNITS = 200_000
CHUNK = 256

SCORED = "row bigint, doc_id bigint, lang string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_p double, missing array<struct<unit:string,times:bigint>>"
STATS = ("doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise")


def language(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all words of all documents; each word stands between start marks and an end mark."""
    words = docs.select(language().alias("lang"), F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    units = counted.select("lang", F.concat(F.lit(START * (order - 1)), "word", F.lit(END)).alias("unit"), "n")
    return windowed(units, order).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """The units of some texts, each once, and where they occur. A joint is five characters: two on each side of a space."""

    words: pa.Array
    word_ids: np.ndarray
    word_owners: np.ndarray
    joints: pa.Array
    joint_ids: np.ndarray
    joint_owners: np.ndarray


def units_of(texts: pa.Array) -> Units:
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    owners = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    nothing = pc.index(words, pa.scalar("", words.type)).as_py()
    if nothing >= 0:
        owners, ids = owners[ids != nothing], ids[ids != nothing]
    ends = pc.utf8_lpad(pc.utf8_slice_codeunits(words, -2), 2).dictionary_encode()
    begins = pc.utf8_rpad(pc.utf8_slice_codeunits(words, 0, 2), 2).dictionary_encode()
    lefts = pa.concat_arrays([ends.dictionary, pa.array([f" {START}"], words.type)])
    rights = pa.concat_arrays([begins.dictionary, pa.array([f"{END} "], words.type)])
    left, right = (x.indices.to_numpy().astype(np.int64)[ids] for x in (ends, begins))
    first = np.r_[True, owners[1:] != owners[:-1]][: len(ids)]
    last = np.r_[owners[1:] != owners[:-1], True][: len(ids)]
    before = np.where(first, len(lefts) - 1, np.roll(left, 1))
    keys = np.concatenate([before * len(rights) + right, left[last] * len(rights) + len(rights) - 1])
    found, joint_ids = np.unique(keys, return_inverse=True)
    joints = pc.binary_join_element_wise(lefts.take(pa.array(found // len(rights))), rights.take(pa.array(found % len(rights))), pa.scalar(" ", words.type))
    return Units(words, ids, owners, joints, joint_ids, np.concatenate([owners, owners[last]]))


def by_language(langs: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each language with its rows; rows without one are left out."""
    coded = langs.dictionary_encode()
    ids = coded.indices.fill_null(-1).to_numpy()
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(ids == i)


def text_ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all texts, their words parted by one space. Units are counted in each batch, then by Spark before it shuffles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                for lang, which in by_language(batch.column("lang")):
                    u = units_of(batch.column("text").take(pa.array(which)))
                    for unit, ids in ((u.words, u.word_ids), (u.joints, u.joint_ids)):
                        n = np.bincount(ids, minlength=len(unit))
                        met = np.flatnonzero(n)
                        if len(met):
                            units = unit.take(pa.array(met)).cast(pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), units, pa.array(n[met])], ["lang", "unit", "n"])

    counted = in_arrow(docs.select(language().alias("lang"), "text"), each, "lang string, unit string, n bigint")
    unit = F.when(F.instr("unit", " ") > 0, F.col("unit")).otherwise(F.concat(F.lit(" "), "unit", F.lit(" ")))
    units = counted.groupBy("lang", "unit").agg(F.sum("n").alias("n")).select("lang", unit.alias("unit"), "n")
    return windowed(units).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def windowed(units: DataFrame, order: int = ORDER) -> DataFrame:
    """units (unit and other columns) with each n-gram of the unit as `gram`."""
    others = [c for c in units.columns if c != "unit"]
    # Long units in chunks: positions within a string are found by walking it.
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"(length(unit) - {order}) div {CHUNK}")), lambda k: F.substring("unit", k * CHUNK + 1, F.lit(CHUNK + order - 1)))
    kept = [*others, "unit"]
    pieces = units.where(F.length("unit") >= order).select(*kept, F.explode(chunks).alias("part")).where(F.length("part") >= order)
    grams = F.transform(F.sequence(F.lit(1), F.length("part") - order + 1), lambda i: F.substring("part", i, F.lit(order)))
    return pieces.select(*kept, F.explode(grams).alias("gram"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(order, lang, gram, tokens, value), all of them: logarithms of interpolated probabilities of n-grams, and of the back-off weights of contexts."""
    top = grams.withColumnRenamed("n", "tokens").withColumn("c", F.col("tokens"))
    levels = {order: top}
    for n in range(order - 1, 0, -1):  # below the top, an n-gram counts the different symbols that stand before it
        shorter = levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram"))
        levels[n] = saved(shorter.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("c")), f"grams{n}")
    probabilities, weights, below = None, None, None
    for n in range(1, order + 1):
        level = levels[n].withColumn("context", F.substring("gram", 1, n - 1) if n > 1 else F.lit(""))
        counts = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        rule = [F.coalesce(k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(0.5 + 0.25 * k)) for k in (1, 2, 3)]
        bounded = [F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k, d in enumerate(rule, 1)]
        discounts = small(saved(level.groupBy("lang").agg(*counts).select("lang", *bounded), f"discounts{n}"))
        context = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("a1"), F.count_if(F.col("c") == 2).alias("a2"), F.count_if(F.col("c") >= 3).alias("a3"), F.sum("tokens").alias("context_tokens"), F.count(F.lit(1)).alias("kinds"))
        mass = (F.col("d1") * F.col("a1") + F.col("d2") * F.col("a2") + F.col("d3") * F.col("a3")) / F.col("total")
        context = context.join(discounts, "lang").withColumn("back", mass)
        own = F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        joined = level.join(context, ["lang", "context"])
        if n == 1:
            joined = joined.withColumn("lower", 1.0 / (F.col("kinds") + 1))
        else:
            joined = joined.withColumn("suffix", F.substring("gram", 2, n - 1)).join(below, ["lang", "suffix"])
        joined = joined.withColumn("p", own / F.col("total") + F.col("back") * F.col("lower"))
        here = saved(joined.select("lang", "gram", "tokens", "p"), f"p{n}")
        below = here.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        p = here.select(F.lit(n).alias("order"), "lang", "gram", "tokens", F.log("p").alias("value"))
        value = F.log("back") - (F.log(F.col("kinds") + 1) if n == 1 else F.lit(0.0))  # what an unknown symbol gets
        w = context.select(F.lit(n).alias("order"), "lang", F.col("context").alias("gram"), F.col("context_tokens").alias("tokens"), value.alias("value"))
        probabilities, weights = (p, w) if n == 1 else (probabilities.unionByName(p), weights.unionByName(w))
    return probabilities, weights


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def salt(lang: str, order: int) -> np.uint64:
    h = np.uint64(order)
    with np.errstate(over="ignore"):
        for b in lang.encode():
            h = h * np.uint64(0x100000001B3) + np.uint64(b + 1)
    return h


def step(h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, one symbol longer."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + symbols + np.uint64(1))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashed(rows: DataFrame) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        orders, keys = batch.column("order").to_numpy(), np.empty(batch.num_rows, np.uint64)
        for n in np.unique(orders).tolist():
            of_order = np.flatnonzero(orders == n)
            for lang, which in by_language(batch.column("lang").take(pa.array(of_order))):
                which = of_order[which]
                symbols = codes("".join(batch.column("gram").take(pa.array(which)).to_pylist()))
                symbols = symbols.reshape(len(which), len(symbols) // len(which))
                h = np.full(len(which), salt(lang, n))
                for k in range(symbols.shape[1] - 1, -1, -1):  # from the last symbol back, as scoring goes
                    h = step(h, symbols[:, k])
                keys[which] = h
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("value").cast(pa.float64())], ["key", "value"])

    return map_batches(rows.select("order", "lang", "gram", "value"), one, "key bigint, value double")


class Table:
    """Values by sorted 64-bit hashes. As hashes are spread evenly, their first bits tell about where they lie."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        firsts = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(keys, firsts).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are there, and their values (0 without)."""
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = self.starts[wanted >> self.shift]
        last = np.int32(len(self.keys) - 1)
        found = self.keys[np.minimum(at, last)]
        behind = np.flatnonzero((found < wanted) & (at < last))
        while len(behind):
            at[behind] += 1
            there = self.keys[at[behind]]
            found[behind] = there
            behind = behind[(there < wanted[behind]) & (at[behind] < last)]
        hit = found == wanted
        return hit, np.where(hit, self.values[np.minimum(at, last)], 0.0)


@dataclass
class Model:
    """Tables of n-grams with log probabilities, and of contexts with log back-off weights."""

    order: int
    grams: Table
    contexts: Table

    def back(self, lang: str, n: int, text: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The back-off weights of the contexts of n-grams that end at places of a text."""
        if not len(self.contexts.keys):
            return np.zeros(len(where))
        c = np.full(len(where), salt(lang, n))
        for k in range(1, n):
            c = step(c, text[where - k])
        return self.contexts.find(c)[1]

    def words(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word."""
        return self.units(lang, [padded(w, self.order) for w in words])[0]

    def units(self, lang: str, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each unit's n-grams, and whether the model has all of them."""
        pad = self.order - 1
        text = codes("".join(units))
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        starts, sizes = np.cumsum(lengths) - lengths, np.maximum(lengths - pad, 0)
        owner = np.repeat(np.arange(len(units)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner] + pad
        out, open_, n = np.zeros(len(at)), np.ones(len(at), bool), self.order
        whole = np.ones(len(units), bool)
        while n and open_.any():
            where = at[open_]
            g = np.full(len(where), salt(lang, n))
            for k in range(n):
                g = step(g, text[where - k])
            hit, value = self.grams.find(g)
            back = self.back(lang, n, text, where)
            index = np.flatnonzero(open_)
            if n == self.order:
                whole[owner[index[~hit]]] = False
            out[index] += np.where(hit, value, back)
            open_[index[hit]] = False
            n -= 1
        return np.bincount(owner, out, len(units)), whole


def padded(word: str, order: int = ORDER) -> str:
    return START * (order - 1) + word + END


def held(rows: DataFrame) -> Table:
    got = hashed(rows).toArrow()
    keys = got.column("key").to_numpy().astype(np.int64).view(np.uint64)
    values = got.column("value").to_numpy().astype(np.float32)
    by = np.lexsort((values, keys))
    return Table(keys[by], values[by])


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """The whole model of words in memory."""
    probabilities, weights = kneser_ney(saved(ngram_counts(docs, order), "ngrams"), order)
    return Model(order, held(probabilities), held(weights))


def frequent(grams: DataFrame, kept: int) -> tuple[DataFrame, bool]:
    """The most frequent n-grams, at most kept of them, and whether these are all."""
    level = F.floor(F.log2(F.col("tokens").cast("double"))).cast("int")
    counts = {r["level"]: r["n"] for r in grams.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 64, 0
    for k in sorted(counts, reverse=True):
        held += counts[k]
        if held > kept:
            break
        least = k
    return grams.where(level >= least), held <= kept


def repeated(ids: np.ndarray) -> int:
    """Words (by their numbers) that lie in a window of three words which the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pairs[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def repeated_words(u: Units, texts: int) -> np.ndarray:
    """repeated() of each text. Texts whose windows all have hashes of their own have none; the others are read one by one."""
    out = np.zeros(texts, np.int64)
    if len(u.word_ids) < 4:
        return out
    h = u.word_owners[2:].astype(np.uint64)
    for k in range(3):
        h = step(h, u.word_ids[k : len(u.word_ids) - 2 + k].astype(np.uint64))
    inside = u.word_owners[2:] == u.word_owners[:-2]
    owners, h = u.word_owners[2:][inside], h[inside]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        starts = np.searchsorted(u.word_owners, np.arange(texts + 1))
        for i in np.unique(owners[np.isin(h, twice)]).tolist():
            out[i] = repeated(u.word_ids[starts[i] : starts[i + 1]])
    return out


def marks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """How many symbols and line feeds each text has, by the bytes: ASCII characters are no parts of others."""
    binary = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    ends = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    kinds = KINDS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data else np.zeros(0, np.uint8)
    return tuple(np.diff(np.searchsorted(np.flatnonzero(kinds == k), ends - ends[0])) for k in (1, 2))


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """Word statistics of every text and its mean surprise (nats a word; null without words), under the model of these texts."""
    probabilities, _ = kneser_ney(saved(text_ngram_counts(docs), "ngrams"))
    table = saved(probabilities.where(F.col("order") == ORDER), "prices")
    known_grams, complete = frequent(table, kept)
    no_contexts = Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    scored = saved(score(docs, Model(ORDER, held(known_grams), no_contexts)), "scored")
    log_p = F.col("log_p")
    if not complete:
        scored = scored.join(joined_prices(scored, table), "row", "left")
        log_p = log_p + F.coalesce("more", F.lit(0.0))
    return scored.withColumn("surprise", F.when(F.col("n_words") > 0, -log_p / F.col("n_words"))).select(*STATS)


def joined_prices(scored: DataFrame, table: DataFrame) -> DataFrame:
    """row, more: what the missing units of each row add to its logarithm."""
    missing = scored.select("row", "lang", F.explode("missing").alias("m")).select("row", "lang", "m.*")
    grams = windowed(missing.select("lang", "unit").distinct())
    values = table.select("lang", "gram", F.col("value").cast("float").cast("double").alias("value"))
    prices = grams.join(values, ["lang", "gram"]).groupBy("lang", "unit").agg(F.greatest(F.sum("value"), F.lit(-UNKNOWN_WORD)).alias("price"))
    return missing.join(prices, ["lang", "unit"]).groupBy("row").agg(F.sum(F.col("times") * F.col("price")).alias("more"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Statistics of each text, the logarithm of its units' probabilities, and the units that the model does not have whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: dict[str, dict[str, float]] = {}  # of a worker, by language; nan for what the model lacks

    def prices(lang: str, lm: Model, units: list[str]) -> np.ndarray:
        known = tables.setdefault(lang, {})
        new = [u for u in units if u not in known]
        if new:
            log_p, whole = lm.units(lang, new)
            known.update(zip(new, np.where(whole, np.maximum(log_p, -UNKNOWN_WORD), np.nan).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, units), np.float64, len(units))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        if sum(map(len, tables.values())) > REMEMBERED_UNITS:
            tables.clear()
        n_words, word_chars, n_repeat, log_p = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        missing: list[list[dict]] = [[] for _ in range(n)]
        for lang, which in by_language(batch.column("lang")):
            u, k = units_of(batch.column("text").take(pa.array(which))), len(which)
            n_words[which] = np.bincount(u.word_owners, minlength=k)
            word_chars[which] = np.bincount(u.word_owners, pc.utf8_length(u.words).to_numpy()[u.word_ids], k).astype(np.int64)
            n_repeat[which] = repeated_words(u, k)
            for units, ids, owners in (([f" {w} " for w in u.words.to_pylist()], u.word_ids, u.word_owners), (u.joints.to_pylist(), u.joint_ids, u.joint_owners)):
                price = prices(lang, shared.value, units)[ids]
                lacking = np.isnan(price)
                log_p[which] += np.bincount(owners, np.where(lacking, 0.0, price), k)
                pairs, times = np.unique(owners[lacking] * len(units) + ids[lacking], return_counts=True)
                for pair, count in zip(pairs.tolist(), times.tolist(), strict=True):
                    missing[which[pair // len(units)]].append({"unit": units[pair % len(units)], "times": count})
        symbols, feeds = marks(batch.column("text"))
        lines = np.zeros(n, np.int64)
        for i in np.flatnonzero(feeds).tolist():
            lines[i] = repeated_lines(batch.column("text")[i].as_py())
        counts = [pa.array(x, pa.int64()) for x in (n_words, word_chars, symbols, lines, n_repeat)]
        units_type = pa.list_(pa.struct([("unit", pa.string()), ("times", pa.int64())]))
        arrays = [*(batch.column(c) for c in ("row", "doc_id", "lang", "text_hash")), *counts, pa.array(log_p), pa.array(missing, units_type)]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCORED.split(", ")])

    return map_batches(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), language().alias("lang"), F.xxhash64("text").alias("text_hash"), "text"), one, SCORED)


def judged(stats: DataFrame, width: float = WIDTH) -> DataFrame:
    """stats (saved) with base_failed, the band of the language and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # Each text once, however many copies it has.
    good = stats.where(~F.col("base_failed")).groupBy("lang", "text_hash").agg(F.min("surprise").alias("surprise"), F.min("n_words").alias("n_words"))
    good = saved(good, "good")
    middle = small(saved(good.groupBy("lang").agg(F.percentile_approx("surprise", 0.5, 10_000).alias("middle")), "middles"))
    off = good.join(middle, "lang").withColumn("off", F.abs(F.col("surprise") - F.col("middle")))
    spread = off.groupBy("lang").agg(
        (1.4826 * F.percentile_approx(F.when(F.col("n_words") >= 400, F.col("off")), 0.5, 10_000)).alias("between"),
        (1.4826 * F.percentile_approx(F.when(F.col("n_words") < 400, F.col("off") * F.sqrt("n_words")), 0.5, 10_000)).alias("within"),
    )
    bands = small(saved(spread.join(middle, "lang"), "bands"))
    between = F.greatest(F.coalesce("between", F.lit(0.1)), F.lit(LEAST_BETWEEN))
    within = F.greatest(F.coalesce("within", F.lit(4.0)), F.lit(LEAST_WITHIN))
    half = width * F.sqrt(between**2 + within**2 / F.greatest("n_words", F.lit(1)))
    out = stats.join(bands, "lang", "left").withColumn("half", half)
    inside = F.abs(F.col("surprise") - F.col("middle")) <= F.col("half")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return out.select(*stats.columns, F.exp("surprise").alias("perplexity"), F.exp(F.col("middle") - F.col("half")).alias("lower"), F.exp(F.col("middle") + F.col("half")).alias("upper"), kept.alias("kept"))


def rate(docs: DataFrame, width: float = WIDTH, kept: int = KEPT) -> DataFrame:
    """Statistics, perplexity, its band and the verdict for every row of docs (doc_id, text, lang).

    Null and empty texts have no words and fail the base rules. A null lang is a language of its own, `und`. Repeated rows
    count each and get the same verdict. An empty table gives no rows. More columns are ignored; texts are read whole. How many
    n-grams workers hold (kept) decides where words are priced, not their prices.
    """
    docs = docs.select("doc_id", "text", "lang")
    return judged(saved(statistics(docs, kept), "quality"), width)


def passing(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """docs, all columns, without the rows that rate() rejects, each by its own language and text, whether it has an id or not."""
    names = docs.columns
    kept = rate(docs, width).where("kept").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (language() == F.col("__lang")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(kept, same, "left_semi").select(*names)
