"""Near duplicates by SuperMinHash.

Word shingles become signatures in which each element draws the places of a permutation one by one, so that places are
correlated and the estimate varies less; drawing stops as soon as no later draw can lower a value. Bands of the signature
name buckets. Documents with equal shingle sets are one class from the start. Each bucket's centre, the class that meets most
others in all its buckets, is held against the other members, and links are confirmed on full sets.

What a centre's members lie apart is then settled by differences. Elements that most members of a centre have are their
consensus; each member differs from it by few elements, and two sets are linked exactly if their differences have enough in
common. So the member nearest to the consensus is linked with all that are near enough, without any pair being read, and the
others can only be linked with members that share some of their rarest differences (a prefix filter). No group is spread into all its
pairs. Components are found by alternating stars on tables, never on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, forget, in_arrow, saved

WORDS, SIMILARITY = 5, 0.8
#: 40 bands of 6 values: a pair with similarity 0.8 meets in none of them with a chance of 0.000 005.
BANDS, ROWS = 40, 6
#: Elements whose permutations are drawn together.
ELEMENTS = 20_000
#: Standard deviations under the similarity at which a signature's estimate rules a pair out without its texts.
DEVIATIONS = 6.5
REMEMBERED_WORDS = 200_000
#: Pairs of texts that are held against each other before they are handed on.
PAIR_ROWS = 128
#: Bytes of a text whose words are hashed together.
PART = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Parts into which the members of a centre are dealt when they meet what is known of it, so that a large group has many tasks.
SALTS = 16


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, known: Words) -> np.ndarray:
    """Hashes of the words, with A to Z in lower case. A long text is split in parts, at white space."""
    data, parts, at = text.encode().lower(), [], 0
    while at < len(data):
        gap = GAP.search(data, at + PART) if len(data) - at > PART else None
        end = gap.start() if gap else len(data)
        found = data[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of runs of words; of the whole sequence if it is shorter; none without words."""
    h = word_hashes(text or "", known)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)  # a short sequence is not a part of a longer shingle
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (sets x m) of non-empty sets of 64-bit hashes. The elements of one long set are drawn in parts."""
    if len(sets) == 1 and len(sets[0]) > ELEMENTS:
        out = np.full(m, np.inf)
        for at in range(0, len(sets[0]), ELEMENTS):
            drawn(np.zeros(min(ELEMENTS, len(sets[0]) - at), np.int64), sets[0][at : at + ELEMENTS], out, m)
        return out.reshape(1, m)
    out = np.full(len(sets) * m, np.inf)
    drawn(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), out, m)
    return out.reshape(-1, m)


def drawn(owner: np.ndarray, key: np.ndarray, out: np.ndarray, m: int) -> None:
    """Lowers the values of out (m for each owner) by the draws of elements."""
    places = np.tile(np.arange(m, dtype=np.int16), (len(key), 1))
    row = np.arange(len(key))
    for j in range(m):
        open_ = out.reshape(-1, m).max(1) >= j  # draws are j at least from here on
        if not open_.any():
            break
        if not open_.all():
            stay = open_[owner]
            if stay.sum() < 0.7 * len(row):
                owner, key, places, row = owner[stay], key[stay], places[stay], np.arange(stay.sum())
        u = mixed(key + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (mixed(u) % np.uint64(m - j)).astype(np.int64)
        place = places[row, k]
        places[row, k] = places[row, j]
        np.minimum.at(out, owner * m + place, (u >> np.uint64(11)) * 2.0**-53 + j)


def batches_of(sizes: np.ndarray, most: int = ELEMENTS) -> Iterator[np.ndarray]:
    """Indices of sets, by size, in runs of about most elements."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    ends = np.cumsum(sizes[order])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield order[at:end]
        at = end


def signed(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (of the set), low (a byte of each value), bands (a hash of each)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        m = bands * rows
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                sets = [shingles(t, words, known) for t in batch.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                keys, low, hashes = [b""] * len(sets), [b""] * len(sets), [[]] * len(sets)
                for part in batches_of(sizes):
                    values = mixed(super_minhash([sets[i] for i in part], m).view(np.uint64))
                    h = np.tile(np.arange(bands, dtype=np.uint64), (len(part), 1))
                    for r in range(rows):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows][:, :bands])
                    for i, v, b in zip(part.tolist(), values, h.view(np.int64), strict=True):
                        keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        low[i], hashes[i] = v.astype(np.uint8).tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(low, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_key", "low", "bands"],
                )

    return in_arrow(docs.select("doc_id", "text"), each, "doc_id bigint, n_shingles bigint, set_key binary, low binary, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of edges (a, b), by alternating large and small stars."""
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, saved(small.where("a <> b").distinct().select(F.col("b").alias("a"), F.col("a").alias("b")), "small")
        forget(before)
        forget(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    out = saved(leaves.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()), "labels")
    forget(edges)
    return out


def _likely(pairs: DataFrame, similarity: float, values: int) -> DataFrame:
    """pairs (a, b, a_low, b_low) whose signatures do not rule them out."""
    share = similarity - DEVIATIONS * (similarity * (1 - similarity) / values) ** 0.5

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, values) for c in ("a_low", "b_low"))
                yield batch.filter(pa.array((a == b).mean(1) >= share)).select(["a", "b"])

    return in_arrow(pairs, each, "a bigint, b bigint")


def _measured(pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs (a, b, a_text, b_text): the size of b's full set, whether both are linked, and the elements that only one has."""
    percent = round(similarity * 100)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, recent = Words(), {}
        for whole in batches:
            for start in range(0, whole.num_rows, PAIR_ROWS):
                batch = whole.slice(start, PAIR_ROWS)
                sizes, linked, apart = [], [], []
                for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "a_text", "b_text")), strict=True):
                    if a not in recent:  # centres come many times
                        if len(recent) > 50:
                            recent.clear()
                        recent[a] = shingles(x, words, known)
                    s, t = recent[a], shingles(y, words, known)
                    d = np.setxor1d(s, t, assume_unique=True)
                    sizes.append(len(t))
                    # With d elements apart, both share (|s| + |t| - d) / 2: the rule on intersection and union, in whole numbers.
                    linked.append((100 + percent) * len(d) <= (100 - percent) * (len(s) + len(t)))
                    apart.append(d.view(np.int64))
                arrays = [batch.column("a"), batch.column("b"), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "n_shingles", "linked", "apart"])

    return in_arrow(pairs, each, "a bigint, b bigint, n_shingles bigint, linked boolean, apart array<bigint>")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b; saved)."""
    if links.isEmpty():
        return labels
    for end in ("a", "b"):
        names = labels.select(F.col("node").alias(end), F.col("label").alias("_name"))
        links = links.join(names, end, "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    found = components(links.select("a", "b"))
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = found.join(labels, "node", "left_anti").select("node", "label")
    out = saved(moved.unionByName(fresh), "labels")
    forget(found, labels)
    return out


def _with_centre(members: DataFrame, known: DataFrame, how: str = "inner", by: str = "node") -> DataFrame:
    """members (centre, by, ...) with what is known of their centres; those of one centre are dealt to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return members.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(known.withColumn("_salt", salts), ["centre", "_salt"], how).drop("_salt")


def _about_consensus(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (centre, node, n_shingles, apart: the elements in which node and centre differ) with `apart` about the centre's consensus.

    An element in which most members differ from the centre is turned over for all of them. `excess` is above the sum 0 of two
    members only if their differences must share elements for a link: with d apart and n shingles, two sets x and y are linked if
    and only if excess(x) + excess(y) <= 2 (100 + percent) |shared differences|, excess being (100 + percent) d - (100 - percent) n.
    """
    percent = round(similarity * 100)
    counts = sets.select("centre", F.explode("apart").alias("element")).groupBy("centre", "element").agg(F.count(F.lit(1)).alias("n"))
    members = sets.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    turned = _with_centre(counts, members, by="element").where("2 * n > members").groupBy("centre").agg(F.collect_list("element").alias("turned"))
    rows = _with_centre(sets, turned, "left")
    apart = F.when(F.col("turned").isNull(), F.col("apart")).otherwise(F.concat(F.array_except("apart", "turned"), F.array_except("turned", "apart")))
    rows = rows.withColumn("apart", apart).drop("turned")
    return rows.withColumn("excess", (100 + percent) * F.size("apart") - (100 - percent) * F.col("n_shingles"))


def _possible(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (centre, node, node2) of rows (of _about_consensus(), with label, best: the centre's least excess, and outside) that could be linked.

    One of each pair lies outside of the label of the member nearest to the consensus, and so its excess is above -best. The
    least number of differences that it must share with any other member, and any other with it, follows from that; sets that
    share s of d elements have one in common among their first d - s + 1, in any order that both have: from the rarest.
    """
    percent = round(similarity * 100)
    unit = 2 * (100 + percent)
    listed = rows.select("centre", "node", F.explode("apart").alias("element"))
    counts = listed.groupBy("centre", "element").agg(F.count(F.lit(1)).alias("n"))
    order = listed.join(counts, ["centre", "element"]).groupBy("centre", "node").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("order"))
    facts = rows.select("centre", "node", "n_shingles", "label", "outside", "excess", "best").join(order, ["centre", "node"])

    def first(least: Column) -> DataFrame:
        shared = F.greatest(F.lit(1), F.ceil(least / F.lit(unit)))
        kept = facts.withColumn("take", (F.size("order") - shared + 1).cast("int")).where("take > 0")
        kept = kept.select("*", F.posexplode(F.slice("order", 1, F.col("take"))).alias("at", "e")).where("e.n > 1")
        return kept.select("centre", F.col("e.element").alias("element"), "node", "n_shingles", "label", "outside", "excess", (F.size("order") - F.col("at")).alias("left"))

    outside = first(F.col("excess") + F.col("best")).where("outside")
    others = first(F.col("excess") - F.col("best") + 1)
    # An element that one label has to itself leads to no pair.
    labels = others.unionByName(outside).groupBy("centre", "element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("outside").alias("any")).where("low <> high and any")
    others = others.join(labels.select("centre", "element"), ["centre", "element"], "left_semi")
    right = others.select("centre", "element", *(F.col(c).alias(f"{c}2") for c in ("node", "n_shingles", "label", "outside", "excess", "left")))
    once = ~F.col("outside2") | (F.col("node") < F.col("node2"))  # both outside: the pair comes from either end
    near = 100 * F.least("n_shingles", "n_shingles2") >= percent * F.greatest("n_shingles", "n_shingles2")
    # At the first element that both share, what is left of either must hold all that they have to share.
    enough = F.col("excess") + F.col("excess2") <= unit * F.least("left", "left2")
    either = outside.join(right, ["centre", "element"]).where((F.col("label") != F.col("label2")) & near & enough)
    return either.select("centre", F.when(once, F.col("node")).otherwise(F.col("node2")).alias("node"), F.when(once, F.col("node2")).otherwise(F.col("node")).alias("node2")).distinct()


def _further_links(sets: DataFrame, labels: DataFrame, similarity: float) -> Iterator[DataFrame]:
    """Links (a, b) among the members of each centre (sets as in _about_consensus()): those with the member nearest to the
    consensus, then, given labels that know of the former (sent in), all others."""
    percent = round(similarity * 100)
    about = saved(_about_consensus(sets, similarity), "about")
    best = saved(about.groupBy("centre").agg(F.min(F.struct("excess", "node")).alias("b")).select("centre", F.col("b.excess").alias("best"), F.col("b.node").alias("middle")), "best")
    inner = _with_centre(about.drop("apart"), best).where("excess + best <= 0 and node <> middle")
    labels = yield inner.select(F.col("middle").alias("a"), F.col("node").alias("b"))
    name = lambda df, node, label: df.join(labels.select(F.col("node").alias(node), F.col("label").alias("_name")), node, "left").withColumn(label, F.coalesce("_name", node)).drop("_name")
    rows = name(_with_centre(about, name(best, "middle", "middle_label").drop("middle")), "node", "label")
    labelled = saved(rows.withColumn("outside", F.col("label") != F.col("middle_label")).drop("middle_label"), "labelled")
    forget(about, best)
    rows = labelled.join(labelled.where("outside").select("centre").distinct(), "centre", "left_semi")
    pairs = saved(_possible(rows, similarity), "possible")
    facts = rows.select("centre", "node", "apart", "excess")
    held = pairs.join(facts, ["centre", "node"]).join(facts.select("centre", *(F.col(c).alias(f"{c}2") for c in ("node", "apart", "excess"))), ["centre", "node2"])
    shared = F.size(F.array_intersect("apart", "apart2"))
    links = saved(held.where(F.col("excess") + F.col("excess2") <= 2 * (100 + percent) * shared).select(F.col("node").alias("a"), F.col("node2").alias("b")), "links")
    forget(labelled, pairs)
    yield links


def grouped(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); class_id is the smallest id with the same set.

    Null and empty texts and those without words have an empty set: linked with nothing, kept. Rows with a null doc_id take no
    part: their component is null and they are kept. Repeated rows fall into one component; an id names one text. An empty table
    gives no rows. More columns are ignored. Texts are read whole; no bucket, candidate or partner is capped.
    """
    docs = docs.select("doc_id", "text")
    signed_ = saved(signed(docs, words, bands, rows), "signed")
    named = signed_.where("n_shingles > 0 and doc_id is not null")
    classes = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    # One row for each class: that of its smallest id.
    heads = named.join(classes, "set_key").where("doc_id = class_id").dropDuplicates(["class_id"]).select("class_id", "n_shingles", "low", "bands")
    heads = saved(heads, "heads")
    entries = heads.select(F.col("class_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = saved(entries.join(shared, "bucket"), "entries")
    meets = entries.groupBy("node").agg(F.sum("n").alias("meets"))
    centres = entries.join(meets, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("meets"), "node", "n_shingles")).alias("c"))
    centres = centres.select("bucket", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("centre_size"))
    stars = saved(entries.join(centres, "bucket").where("node <> centre").select("centre", "node", "n_shingles", "centre_size").distinct(), "stars")
    low = heads.select("class_id", "low")
    texts = docs.join(entries.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = saved(texts, "texts", compression="zstd")

    def measure(pairs: DataFrame) -> DataFrame:
        with_texts = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
        return _measured(with_texts, words, similarity)

    near = 100 * F.least("n_shingles", "centre_size") >= round(similarity * 100) * F.greatest("n_shingles", "centre_size")
    pairs = stars.where(near).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    with_low = pairs.join(low.select(F.col("class_id").alias("a"), F.col("low").alias("a_low")), "a").join(low.select(F.col("class_id").alias("b"), F.col("low").alias("b_low")), "b")
    measured = saved(measure(_likely(with_low, similarity, bands * rows)), "measured")
    labels = components(measured.where("linked").select("a", "b"))
    # Centres whose members have more than one label: all their members are held against them, the unlikely ones too.
    named_ = stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named_.groupBy("centre").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("centre")
    members = stars.join(open_, "centre", "left_semi").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    known = measured.join(open_.withColumnRenamed("centre", "a"), "a", "left_semi")
    known = known.unionByName(measure(members.join(measured.select("a", "b"), ["a", "b"], "left_anti")))
    own = stars.join(open_, "centre", "left_semi").select("centre", F.col("centre").alias("node"), F.col("centre_size").alias("n_shingles")).distinct()
    sets = known.select(F.col("a").alias("centre"), F.col("b").alias("node"), "n_shingles", "apart").unionByName(own.withColumn("apart", F.array().cast("array<bigint>")))
    found = _further_links(sets, labels, similarity)
    inner = saved(next(found), "inner")
    forget(heads, entries)
    labels = _relabelled(labels, inner)
    links = found.send(labels)
    labels = _relabelled(labels, links)
    forget(stars, texts, measured, inner, links)
    members = signed_.join(classes, "set_key", "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    members = members.withColumn("class_id", F.when(own, F.col("class_id")).otherwise(F.col("doc_id")))
    out = members.join(labels.select(F.col("node").alias("class_id"), F.col("label")), "class_id", "left")
    component = F.coalesce("label", "class_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")


def first_of_group(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each component: its smallest id (one row of those that repeat it)."""
    names = docs.columns
    gone = grouped(docs, **options).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*names)
    # Rows that repeat an id: the first by text stays, in one of each id; rows without an id stay.
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = kept.where("doc_id is not null").withColumn("__number", number).where("__number = 1").drop("__number")
    return once.unionByName(kept.where("doc_id is null"))
